"""What image and audio blocks are: told by their format, by a layout of their record, or by the last configuration.

Works on ``decoded_blocks``: rows without payloads, so only numbers and texts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklode.functions.formats import AUDIO_FORMATS, IMAGE_FORMATS, PIXEL_FORMATS, SAMPLE_FORMATS, audio_block_size, raw_image_size
from tracklode.functions.text import enum_names
from tracklode.operators.ordered import last_known

FILE_STREAM = ("file_id", "type_id", "instance_id")
# Names of the pieces that tell a spec, and their Spark types.
PIECES = (
    "image_width long, image_height long, image_stride long, image_stride_2 long, image_pixel_format int, image_bytes_per_pixel int, image_codec_name string, image_codec_quality int, "
    "image_key_frame_timestamp double, image_key_frame_index long, "
    "audio_format int, audio_sample_format int, audio_channel_count int, audio_sample_stride int, audio_sample_rate long, audio_sample_count long"
)
#: Pixel formats by bytes a pixel, for layouts that don't name one.
BY_BYTES = {1: "grey8", 3: "rgb8", 4: "depth32f", 8: "scalar64F"}
IMAGE = ("pixel", "width", "height", "stride", "stride_2", "codec", "quality")
AUDIO = ("coding", "sample", "channels", "sample_stride", "rate", "samples")


def image_of(p: Column) -> Column:
    """The image spec that a layout tells; null unless it names size and pixel format."""
    named = enum_names(p["image_pixel_format"], dict(enumerate(PIXEL_FORMATS[1:], 1)))
    pixel = F.coalesce(named, enum_names(p["image_bytes_per_pixel"], BY_BYTES))
    fields = (pixel, p["image_width"], p["image_height"], F.coalesce(p["image_stride"], F.lit(0)), F.coalesce(p["image_stride_2"], F.lit(0)), p["image_codec_name"], p["image_codec_quality"])
    whole = (p["image_width"] > 0) & (p["image_height"] > 0) & pixel.isNotNull()
    return F.when(whole, F.struct(*(c.alias(n) for c, n in zip(fields, IMAGE))))


def audio_of(p: Column) -> Column:
    """The audio spec that a layout tells, PCM where it names no coding; null unless samples, channels and rate are known."""
    sample = enum_names(p["audio_sample_format"], dict(enumerate(SAMPLE_FORMATS[1:], 1)))
    coding = F.when(p["audio_format"].isNull(), "pcm").otherwise(enum_names(p["audio_format"], dict(enumerate(AUDIO_FORMATS[1:], 1))))
    stride = F.coalesce(p["audio_sample_stride"], F.lit(0))
    least = audio_block_size(sample, p["audio_channel_count"], F.lit(0), F.lit(1))
    fits = (stride == 0) | stride.between(least, least + p["audio_channel_count"] * 3)
    fields = (coding, sample, p["audio_channel_count"], stride, p["audio_sample_rate"], p["audio_sample_count"])
    whole = coding.isNotNull() & sample.isNotNull() & (p["audio_channel_count"] > 0) & (p["audio_sample_rate"] > 0) & fits
    return F.when(whole, F.struct(*(c.alias(n) for c, n in zip(fields, AUDIO))))


def inline(spec: Column) -> tuple[Column, Column]:
    """The image and the audio spec that a block's own text tells, null where it doesn't."""

    def number(name: str, kind: str = "long") -> Column:
        return F.regexp_extract(spec, rf"(?:^|/){name}=(\d+)", 1).try_cast(kind)

    def word(pattern: str) -> Column:
        found = F.regexp_extract(spec, pattern, 1)
        return F.when(found != "", found)

    size = r"/(\d+)x(\d+)(?:/|$)"
    image = (word(r"/pixel=(\w+)"), F.regexp_extract(spec, size, 1).try_cast("long"), F.regexp_extract(spec, size, 2).try_cast("long"), F.coalesce(number("stride"), F.lit(0)), F.coalesce(number("stride_2"), F.lit(0)), word(r"/codec=([^/]+)"), number("codec_quality", "int"))
    samples = "|".join(SAMPLE_FORMATS[1:])
    audio = (word(r"^audio/(pcm|opus)"), word(rf"/({samples})(?:/|$)"), number("channels", "int"), F.coalesce(number("stride", "int"), F.lit(0)), number("rate"), number("samples"))
    whole_image = (image[1] > 0) & (image[2] > 0) & image[0].isNotNull()
    whole_audio = audio[0].isNotNull() & audio[1].isNotNull() & (audio[2] > 0) & (audio[4] > 0)
    return (
        F.when(whole_image, F.struct(*(c.alias(n) for c, n in zip(image, IMAGE)))),
        F.when(whole_audio, F.struct(*(c.alias(n) for c, n in zip(audio, AUDIO)))),
    )


def block_specs(blocks: DataFrame) -> DataFrame:
    """Image and audio blocks of ``decoded_blocks`` with IMAGE and AUDIO columns, key_frame_timestamp, key_frame_index and told_by.

    An image's spec is told by its format, else by the last layout before it in its record,
    else by the last configuration of its stream at or before it (its last layout that
    tells one); an audio block's likewise, by the layout just before it.  told_by is null
    where nothing tells it.  A size that the format leaves open follows from the spec.
    """
    pieces = F.from_json("content", PIECES)
    rows = blocks.where(F.col("kind").isin("data_layout", "image", "audio")).withColumn("_p", F.when(F.col("kind") == "data_layout", pieces))
    rows = rows.withColumn("_image", image_of(F.col("_p"))).withColumn("_audio", audio_of(F.col("_p")))
    within = Window.partitionBy(*FILE_STREAM, "ts_us", "file_offset", "record_type").orderBy("block")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    adjoins = F.lag("block").over(within) == F.col("block") - 1
    rows = rows.select(
        "*",
        F.last("_image", ignorenulls=True).over(so_far).alias("_image_here"),
        F.last("_audio", ignorenulls=True).over(so_far).alias("_audio_so_far"),
        F.when(adjoins, F.lag("_audio").over(within)).alias("_audio_here"),
        F.when(adjoins, F.lag(F.struct("_p.image_key_frame_timestamp", "_p.image_key_frame_index")).over(within)).alias("_key"),
    )
    told = F.when(F.col("record_type") == "configuration", F.struct(F.col("_image_here").alias("image"), F.col("_audio_so_far").alias("audio")))
    rows = last_known(rows, FILE_STREAM, ("ts_us", "file_offset", "block"), told, "_past").where("kind != 'data_layout'")
    own_image, own_audio = inline(F.col("spec"))
    later = F.col("record_type") != "configuration"
    past_image, past_audio = F.when(later, F.col("_past.image")), F.when(later, F.col("_past.audio"))
    is_image = F.col("kind") == "image"
    rows = rows.select(
        *(c for c in blocks.columns if c != "content"),
        F.when(is_image, F.coalesce(own_image, F.col("_image_here"), past_image)).alias("i"),
        F.when(~is_image, F.coalesce(own_audio, F.col("_audio_here"), past_audio)).alias("a"),
        F.when(F.coalesce(F.when(is_image, own_image.isNotNull()).otherwise(own_audio.isNotNull()), F.lit(False)), "format")
        .when(F.when(is_image, F.col("_image_here").isNotNull()).otherwise(F.col("_audio_here").isNotNull()), "record")
        .when(F.when(is_image, past_image.isNotNull()).otherwise(past_audio.isNotNull()), "configuration")
        .alias("told_by"),
        F.when(is_image & (F.col("format") == "video"), F.col("_key")).alias("k"),
    )
    raw = F.when(F.col("format") == IMAGE_FORMATS[1], raw_image_size(F.col("i.pixel"), F.col("i.width"), F.col("i.height"), F.col("i.stride"), F.col("i.stride_2")))
    pcm = F.when(F.col("a.coding") == AUDIO_FORMATS[1], audio_block_size(F.col("a.sample"), F.col("a.channels"), F.col("a.sample_stride"), F.col("a.samples")))
    return rows.select(
        *(c for c in blocks.columns if c not in ("content", "size")),
        F.coalesce("size", raw, pcm).cast("long").alias("size"),
        "i.*",
        "a.*",
        F.col("k.image_key_frame_timestamp").alias("key_frame_timestamp"),
        F.col("k.image_key_frame_index").alias("key_frame_index"),
        "told_by",
    )


def decode_status(blocks: DataFrame) -> DataFrame:
    """Per file: n_records, n_decoded (every block placed and no byte left over), n_images, n_audio."""
    record = [*FILE_STREAM, "record_type", "ts_us", "file_offset"]
    sized = F.col("size").isNotNull() | (F.col("kind") == "empty")
    per = blocks.groupBy(*record).agg(
        (F.every(sized) & (F.coalesce(F.sum("size"), F.lit(0)) == F.max("n_bytes"))).alias("good"),
        F.count_if((F.col("kind") == "image") & sized).alias("images"),
        F.count_if((F.col("kind") == "audio") & sized).alias("audio"),
    )
    return per.groupBy("file_id").agg(F.count("*").alias("n_records"), F.count_if("good").alias("n_decoded"), F.sum("images").alias("n_images"), F.sum("audio").alias("n_audio"))

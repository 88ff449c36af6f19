"""Registered queries through the binary source and sink, formats, layouts and the command line."""

from __future__ import annotations

import json
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklode import cli
from tracklode.functions import formats, layouts, text
from tracklode.operators import decode, filters, specs, streams
from tracklode.operators.filters import Bound, Selection
from tracklode.plans.catalog import DAY_US, KEY, STREAM, K, S, query
from tracklode.plans.catalog_more import TAGGED, tagged_streams
from tracklode.sources import recording
from tracklode.sources.events import event_records

#: Folders of the recordings that this process has written, by application and table folder.
WRITTEN: dict[tuple[str, str], str] = {}
P = "file_id, type_id, instance_id, record_type, ts_us"


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only in a local session."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/recordings-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tracklode-recordings-")


def named(df: DataFrame) -> DataFrame:
    return df.withColumn("file_id", F.concat(F.lit("f"), F.col("file_id").cast("string")))


def made(spark: SparkSession, d: str) -> str:
    """The event table written as two binary recordings, payloads as they are; the folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in WRITTEN:
        folder = scratch(spark)
        tags = tagged_streams(spark, d)
        private = F.map_concat("private_tags", F.create_map(F.lit("x_Recordable_Flavor"), "flavor", F.lit("x_Serial_Number"), "serial_number"))
        recording.write_recordings(named(event_records(spark, d)), folder, {"session_id": "events"}, recording.NONE, named(tags.withColumn("private_tags", private))).collect()
        WRITTEN[key] = folder
    return WRITTEN[key]


def back(spark: SparkSession, path: str, table: str = "records", **options: str) -> DataFrame:
    """A table of recordings, file_id turned back into a number."""
    spark.dataSource.register(recording.RecordingSource)
    df = spark.read.format("recording").options(table=table, **options).load(path)
    return df.withColumn("file_id", F.regexp_extract("file_id", r"f(\d+)\.rec$", 1).cast("long"))


@query("source_records", f"SELECT {P}, coalesce(payload, '') AS payload FROM rec")
def source_records(spark, d):
    return back(spark, f"{made(spark, d)}/*.rec").select(*KEY[:5], F.col("payload").cast("string").alias("payload"))


@query("source_index", f"SELECT {S}, record_type, count(*) AS n, CAST(sum(record_size) AS BIGINT) AS size, min(ts_us) AS first_us, max(ts_us) AS last_us FROM rec GROUP BY ALL")
def source_index(spark, d):
    held = back(spark, f"{made(spark, d)}/*.rec", "index").groupBy(*STREAM, "record_type")
    return held.agg(F.count("*").alias("n"), F.sum("record_size").alias("size"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query("source_rebuilt", f"SELECT {P}, coalesce(payload, '') AS payload FROM rec WHERE record_type <> 'data'")
def source_rebuilt(spark, d):
    held = back(spark, f"{made(spark, d)}/*.rec", rebuild="true").where("record_type != 'data'")
    return held.select(*KEY[:5], F.col("payload").cast("string").alias("payload"))


@query(
    "source_streams",
    f", {TAGGED} SELECT {S}, flavor, 'SN' || instance_id AS serial_number, side FROM st",
)
def source_streams(spark, d):
    return back(spark, f"{made(spark, d)}/*.rec", "streams").select(*STREAM, "flavor", "serial_number", text.tag(F.col("user_tags"), "side").alias("side"))


@query("source_files", "SELECT file_id, 'events' AS session_id, true AS has_index, CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY file_id")
def source_files(spark, d):
    folder = made(spark, d)
    n = back(spark, f"{folder}/*.rec", "index").groupBy("file_id").agg(F.count("*").alias("n"))
    return back(spark, f"{folder}/*.rec", "files").join(n, "file_id").select("file_id", text.tag(F.col("tags"), "session_id").alias("session_id"), "has_index", "n")


@query(
    "source_pushdown",
    f", b AS (SELECT min(ts_us) + {2 * DAY_US} AS lo FROM rec) SELECT {P} FROM rec, b WHERE ts_us > lo AND ts_us <= lo + {3 * DAY_US} AND record_type = 'data' AND type_id = 202",
)
def source_pushdown(spark, d):
    folder = made(spark, d)
    lo = back(spark, f"{folder}/*.rec", "index").agg(F.min("ts_us")).first()[0] + 2 * DAY_US
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    held = back(spark, f"{folder}/*.rec", pushdown="true")
    return held.where((F.col("ts_us") > lo) & (F.col("ts_us") <= lo + 3 * DAY_US) & (F.col("record_type") == "data") & (F.col("type_id") == 202)).select(*KEY[:5])


@query("source_check", "SELECT file_id, count(*) AS total, count(*) AS good, 100.0::DOUBLE AS percent FROM rec GROUP BY file_id")
def source_check(spark, d):
    folder = made(spark, d)
    held = cli.run(spark, ["check", f"{folder}/f0.rec", f"{folder}/f1.rec"])
    return held.withColumn("file_id", F.regexp_extract("file_id", r"f(\d+)\.rec$", 1).cast("long"))


COPIED = f"""{TAGGED}, lo AS (SELECT min(ts_us) + {3 * DAY_US} AS t FROM rec WHERE file_id = 0 AND type_id IN (200, 201) AND record_type = 'data'),
r AS (SELECT rec.*, t FROM rec, lo WHERE file_id = 0 AND type_id IN (200, 201)),
c AS (SELECT * FROM r WHERE ts_us > t UNION ALL SELECT * FROM r WHERE ts_us <= t AND record_type IN ('configuration', 'state')
  QUALIFY row_number() OVER (PARTITION BY type_id, instance_id, record_type ORDER BY ts_us DESC, file_offset DESC) = 1)"""


@query(
    "copy_with_tags",
    f", {COPIED} SELECT c.type_id, c.instance_id, c.record_type, c.ts_us, coalesce(c.payload, '') AS payload, st.flavor, st.side FROM c JOIN st ON st.file_id = 0 AND st.type_id = c.type_id AND st.instance_id = c.instance_id",
)
def copy_with_tags(spark, d):
    to = scratch(spark)
    path = cli.run(spark, ["copy", f"{made(spark, d)}/f0.rec", "--to", to, "+", "200", "+", "201", "--after", f"+{3 * DAY_US // 10**6}"]).first()["path"]
    tags = back(spark, path, "streams").select("type_id", "instance_id", "flavor", text.tag(F.col("user_tags"), "side").alias("side"))
    held = back(spark, path).join(tags, ["type_id", "instance_id"])
    return held.select("type_id", "instance_id", "record_type", "ts_us", F.col("payload").cast("string").alias("payload"), "flavor", "side")


@query("compare_with_copy", f"SELECT type_id, CAST(row_number() OVER (PARTITION BY type_id ORDER BY instance_id) AS INT) AS place, n AS n_left, n AS n_matched, CAST(0 AS BIGINT) AS n_different, CAST(0 AS BIGINT) AS n_missing FROM (SELECT {S}, count(*) AS n FROM rec WHERE file_id = 0 GROUP BY ALL)")
def compare_with_copy(spark, d):
    source = f"{made(spark, d)}/f0.rec"
    path = cli.run(spark, ["copy", source, "--to", scratch(spark)]).first()["path"]
    return cli.run(spark, ["compare", source, path])


LAYOUT = json.dumps(
    {
        "data_layout": [
            {"name": "v", "type": "DataPieceValue<double>", "offset": 0},
            {"name": "n", "type": "DataPieceValue<int64_t>", "offset": 8},
            {"name": "pair", "type": "DataPieceArray<int32_t>", "offset": 16, "size": 2},
            {"name": "s", "type": "DataPieceString", "index": 0},
            {"name": "names", "type": "DataPieceVector<string>", "index": 1},
        ]
    }
)
EXPECTED = json.dumps(
    {
        "data_layout": [
            {"name": "n", "type": "DataPieceValue<int64_t>", "offset": 0},
            {"name": "gain", "type": "DataPieceValue<double>", "offset": 8, "default": 2.5},
            {"name": "v", "type": "DataPieceValue<float>", "offset": 16},
            {"name": "s", "type": "DataPieceString", "index": 0},
        ]
    }
)


@F.pandas_udf(T.BinaryType())
def packed_event(v: pd.Series, n: pd.Series, s: pd.Series) -> pd.Series:
    """Events in the packed form of LAYOUT, with four bytes of an image behind."""
    layout = layouts.Layout.parse(LAYOUT)
    return pd.Series([layout.pack({"v": a, "n": b, "pair": [b % 7, -1], "s": c, "names": ["x", c]}) + b"\1\2\3\4" for a, b, c in zip(v, n, s)])


def packed_records(spark: SparkSession, d: str) -> DataFrame:
    r = event_records(spark, d)
    body = packed_event(F.coalesce("value", F.lit(0.0)), F.col("file_offset"), F.coalesce("payload", F.lit("")))
    return r.withColumn("payload", body).withColumn("format_version", F.lit(3))


def packed_streams(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("Data", "State", "Configuration")
    tags = {f"RF:{k}:3": "data_layout+image/raw" for k in kinds} | {f"DL:{k}:3:0": LAYOUT for k in kinds}
    made_of = F.create_map(*(F.lit(x) for pair in tags.items() for x in pair))
    return event_records(spark, d).select(*STREAM).distinct().withColumn("private_tags", made_of)


@query(
    "decode_blocks",
    f"SELECT {K}, coalesce(value, 0.0) AS v, file_offset AS n, CAST(file_offset % 7 AS INT) AS first, coalesce(payload, '') AS s, coalesce(payload, '') AS last FROM rec",
)
def decode_blocks(spark, d):
    blocks = decode.decoded_blocks(packed_records(spark, d), packed_streams(spark, d)).where("block = 0")
    j = F.from_json("content", "v double, n long, pair array<int>, s string, names array<string>")
    return blocks.select(*KEY, j.alias("j")).select(*KEY, "j.v", "j.n", F.col("j.pair")[0].alias("first"), "j.s", F.col("j.names")[1].alias("last"))


@query(
    "block_places",
    f"SELECT {K}, 1 AS block, 'image' AS kind, 'raw' AS format, CAST(24 + 16 + 5 + 4 + 2 * strlen(coalesce(payload, '')) AS BIGINT) AS start, CAST(4 AS BIGINT) AS size FROM rec",
)
def block_places(spark, d):
    return decode.decoded_blocks(packed_records(spark, d), packed_streams(spark, d)).where("block = 1").select(*KEY, "block", "kind", "format", "start", "size")


CAMERA = json.dumps({"data_layout": [{"name": f"image_{n}", "type": "DataPieceValue<uint32_t>", "offset": 4 * i} for i, n in enumerate(("width", "height", "pixel_format"))]})
SOUND = json.dumps({"data_layout": [{"name": f"audio_{n}", "type": "DataPieceValue<uint32_t>", "offset": 4 * i} for i, n in enumerate(("sample_format", "channel_count", "sample_rate", "sample_count"))]})


@F.pandas_udf(T.BinaryType())
def packed_numbers(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    import struct

    return pd.Series([struct.pack("<4I", *x) for x in zip(a, b, c, d)])


def spec_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Configurations tell the size of raw images; data records hold an image, a layout and sound that it tells."""
    r = event_records(spark, d).where("record_type != 'state'")
    n = F.col("file_offset")
    camera = F.substring(packed_numbers(n % 50 + 1, F.lit(2), n % 3, F.lit(0)), 1, 12)
    sound = F.concat(F.lit(b"1234"), packed_numbers(F.lit(5), n % 2 + 1, F.lit(48000), n % 9))
    r = r.withColumn("payload", F.when(F.col("record_type") == "configuration", camera).otherwise(sound)).withColumn("format_version", F.lit(1))
    tags = {"RF:Configuration:1": "data_layout", "DL:Configuration:1:0": CAMERA, "RF:Data:1": "image/raw/size=4+data_layout+audio", "DL:Data:1:1": SOUND}
    private = F.create_map(*(F.lit(x) for pair in tags.items() for x in pair))
    return specs.block_specs(decode.decoded_blocks(r, event_records(spark, d).select(*STREAM).distinct().withColumn("private_tags", private)))


LAST_CONFIGURATION = f"c AS (SELECT *, last_value(CASE WHEN record_type = 'configuration' THEN file_offset END IGNORE NULLS) OVER (PARTITION BY {S} ORDER BY ts_us, file_offset) AS n FROM rec)"


@query(
    "image_specs",
    f""", {LAST_CONFIGURATION} SELECT {K}, CASE n % 3 WHEN 1 THEN 'grey8' WHEN 2 THEN 'bgr8' ELSE '' END AS pixel, CASE WHEN n % 3 > 0 THEN n % 50 + 1 ELSE -1 END AS width,
    CASE WHEN n % 3 > 0 THEN 'configuration' ELSE '' END AS told_by FROM c WHERE record_type = 'data'""",
)
def image_specs(spark, d):
    b = spec_blocks(spark, d).where("kind = 'image'")
    return b.select(*KEY, F.coalesce("pixel", F.lit("")).alias("pixel"), F.coalesce("width", F.lit(-1)).alias("width"), F.coalesce("told_by", F.lit("")).alias("told_by"))


@query("audio_specs", f"SELECT {K}, 'int16le' AS sample, CAST(file_offset % 2 + 1 AS INT) AS channels, CAST(48000 AS BIGINT) AS rate, CAST(file_offset % 9 AS BIGINT) AS samples, 'record' AS told_by FROM rec WHERE record_type = 'data'")
def audio_specs(spark, d):
    return spec_blocks(spark, d).where("kind = 'audio'").select(*KEY, "sample", "channels", "rate", "samples", "told_by")


@query("decode_status", "SELECT file_id, count(*) AS n_records, count(*) AS n_decoded, count(*) AS n_images, CAST(0 AS BIGINT) AS n_audio FROM rec GROUP BY file_id")
def decode_status(spark, d):
    return specs.decode_status(decode.decoded_blocks(packed_records(spark, d), packed_streams(spark, d)))


@query("chunked_copy", "SELECT file_id, true AS has_index, CAST(count(*) AS BIGINT) AS n, CAST(sum(record_size) AS BIGINT) AS size, CAST(count_if(record_type = 'data') AS BIGINT) AS n_data FROM rec WHERE file_id = 0 GROUP BY file_id")
def chunked_copy(spark, d):
    to = scratch(spark)
    recording.write_recordings(named(event_records(spark, d).where("file_id = 0")), to, {}, recording.NONE, chunk_size=16 << 10, split=True).collect()
    held = back(spark, f"{to}/*", "index").groupBy("file_id").agg(F.count("*").alias("n"), F.sum("record_size").alias("size"), F.count_if(F.col("record_type") == "data").alias("n_data"))
    return back(spark, f"{to}/*", "files").select("file_id", "has_index").join(held, "file_id")


@query("compare_verbatim", "SELECT 'itself' AS against, true AS same, true AS agrees UNION ALL SELECT 'another', false, false", base="unused AS (SELECT 1)")
def compare_verbatim(spark, d):
    a, b = (f"{made(spark, d)}/f{i}.rec" for i in (0, 1))
    rows = [cli.run(spark, ["compare-verbatim", a, x]).select(F.lit(name).alias("against"), "same", F.col("first_difference").isNull().alias("agrees")) for name, x in (("itself", a), ("another", b))]
    return rows[0].unionByName(rows[1])


@query("layout_evolution", f"SELECT {K}, file_offset AS n, 2.5::DOUBLE AS gain, true AS v_missing, coalesce(payload, '') AS s FROM rec")
def layout_evolution(spark, d):
    old, new = layouts.Layout.parse(LAYOUT), layouts.Layout.parse(EXPECTED)
    rows = packed_records(spark, d).withColumn("e", layouts.evolved(layouts.decoded(F.col("payload"), LAYOUT), old, new))
    return rows.select(*KEY, "e.n", "e.gain", F.col("e.v").isNull().alias("v_missing"), "e.s")


@query("record_formats", f"SELECT {S}, 'data' AS record_type, CAST(1 AS INT) AS format_version, CASE WHEN type_id = 200 THEN 2 ELSE 1 END AS n_blocks FROM (SELECT DISTINCT {S} FROM rec)")
def record_formats(spark, d):
    return streams.record_formats(tagged_streams(spark, d)).select(*STREAM, "record_type", "format_version", F.size("blocks").alias("n_blocks"))


@query("layout_lookup", f"SELECT {S}, record_type, 3 AS format_version, 0 AS block, 5 AS n_pieces FROM (SELECT DISTINCT {S} FROM rec), (VALUES ('data'), ('state'), ('configuration')) t(record_type)")
def layout_lookup(spark, d):
    pieces = F.size(F.from_json("layout", "data_layout array<struct<name:string>>")["data_layout"])
    return streams.layouts(packed_streams(spark, d)).select(*STREAM, "record_type", "format_version", "block", pieces.alias("n_pieces"))


@query("stream_by_serial", f"SELECT {S} FROM (SELECT DISTINCT {S} FROM rec) WHERE instance_id = 7 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY type_id) = 1")
def stream_by_serial(spark, d):
    return streams.stream_by_serial(tagged_streams(spark, d), "SN7").select(*STREAM)


@query("stream_by_name", f"SELECT {S} FROM (SELECT DISTINCT {S} FROM rec) WHERE type_id = 203 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY instance_id) = 2")
def stream_by_name(spark, d):
    return streams.stream_by_name(tagged_streams(spark, d), "203+2").select(*STREAM)


@query("streams_of_type", f", {TAGGED} SELECT {S} FROM st WHERE type_id = 204 AND flavor = 'f1'")
def streams_of_type(spark, d):
    from tracklode.operators.temporal import streams_of_type as of_type

    return of_type(tagged_streams(spark, d), 204, "f1").select(*STREAM)


@query("flavor_filter", f", {TAGGED} SELECT {K} FROM rec JOIN st USING ({S}) WHERE type_id = 201 AND flavor = 'f2' OR type_id = 203 AND flavor <> 'f0'")
def flavor_filter(spark, d):
    r = filters.with_flavor(event_records(spark, d), tagged_streams(spark, d))
    return filters.select_records(r, Selection(streams=[("+", "201-f2"), ("+", "203"), ("-", "203-f0")])).select(*KEY)


@query("nth_stream_filter", f"SELECT {K} FROM rec JOIN (SELECT {S} FROM (SELECT DISTINCT {S} FROM rec) WHERE type_id = 200 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY instance_id) = 2) USING ({S})")
def nth_stream_filter(spark, d):
    return filters.select_records(event_records(spark, d), Selection(streams=[("+", "200+2")])).select(*KEY)


@query(
    "constrained_range",
    f"SELECT min(ts_us) + {2 * DAY_US} AS first_us, max(ts_us) - {DAY_US} AS last_us FROM rec WHERE record_type = 'data'",
)
def constrained_range(spark, d):
    found = filters.constrained_range(Selection(after=Bound.parse(f"+{2 * DAY_US // 10**6}"), before=Bound.parse(f"-{DAY_US // 10**6}")), event_records(spark, d))
    return spark.createDataFrame([found], "first_us long, last_us long")


@query(
    "up_to_damage",
    f""", bad AS (SELECT file_id AS f, min(row(ts_us, type_id, instance_id, file_offset)) AS b FROM rec WHERE file_offset % 997 = 500 GROUP BY file_id)
    SELECT {K} FROM rec LEFT JOIN bad ON f = file_id WHERE b IS NULL OR row(ts_us, type_id, instance_id, file_offset) < b""",
)
def up_to_damage(spark, d):
    return filters.up_to_damage(event_records(spark, d).withColumn("ok", F.col("file_offset") % 997 != 500)).select(*KEY)


@query("pixel_names", f"SELECT p_partkey, ({list(formats.PIXEL_FORMATS)})[p_size % 40 + 1] AS name FROM part", base="unused AS (SELECT 1)")
def pixel_names(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", text.enum_names(F.col("p_size") % 40, formats.PIXEL_FORMATS).alias("name"))


@query(
    "audio_block_math",
    """SELECT p_partkey, CAST(n * CASE WHEN stride > 0 THEN stride ELSE 2 * ch END AS BIGINT) AS size, CASE WHEN size % (2 * ch) = 0 THEN size // (2 * ch) ELSE -1 END AS samples
    FROM (SELECT p_partkey, p_size AS n, p_partkey % 4 + 1 AS ch, p_partkey % 3 * 8 AS stride, p_size * 6 AS size FROM part)""",
    base="unused AS (SELECT 1)",
)
def audio_block_math(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("n"), (F.col("p_partkey") % 4 + 1).alias("ch"), (F.col("p_partkey") % 3 * 8).alias("stride"))
    size = formats.audio_block_size(F.lit("int16le"), F.col("ch"), F.col("stride"), F.col("n"))
    return p.select("p_partkey", size.cast("long").alias("size"), F.coalesce(formats.sample_count(F.col("n") * 6, F.col("ch") * 2), F.lit(-1)).alias("samples"))


@query("tag_lists", "SELECT c_custkey, c_name AS first, c_mktsegment AS second, 2 AS n FROM customer", base="unused AS (SELECT 1)")
def tag_lists(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    held = text.parsed_tag_list(text.tag_list(F.array("c_name", "c_mktsegment")))
    return c.select("c_custkey", held[0].alias("first"), held[1].alias("second"), F.size(held).alias("n"))


@query(
    "text_columns",
    """SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y-%m-%d %H:%M:%S') AS at, CAST(left(o_orderpriority, 1) AS BIGINT) AS priority, o_orderpriority AS q, o_orderstatus = 'O' AS is_open,
    list_aggregate([trim(x) FOR x IN string_split(o_orderpriority, 'I') IF trim(x) <> ''], 'string_agg', '|') AS parts FROM orders""",
    base="unused AS (SELECT 1)",
)
def text_columns(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    url = F.concat(F.lit("http://x/y?a=1&c="), F.url_encode("o_orderpriority"), F.lit("&b"))
    return o.select(
        "o_orderkey",
        text.datetime_text(F.to_utc_timestamp(text.readable_datetime(F.col("o_orderkey") * 86399).cast("timestamp"), F.current_timezone())).alias("at"),
        F.array_join(text.split_trimmed(F.col("o_orderpriority"), "I"), "|").alias("parts"),
        text.leading_number(F.col("o_orderpriority")).alias("priority"),
        text.query_values(url)["c"].alias("q"),
        text.same_text(F.col("o_orderstatus"), F.lit("o")).alias("is_open"),
    )


@query("checksums")
def checksums(spark, d):
    return cli.run(spark, ["checksums", f"{made(spark, d)}/f0.rec"]).select("name", "checksum")

"""Commands over recordings, composed of the operators.

    python -m tracklode.cli details /data/a.rec + 1201 --range +1 -2
    python -m tracklode.cli copy /data/a.rec --to /data/out + 200 - 200-3 --after +2
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklode.operators import compare, decimate, decode, digest, filters, merge, specs, stats
from tracklode.operators.filters import Bound, Selection
from tracklode.sources import export
from tracklode.sources.recording import TAGS, RecordingSource, write_recordings

COMMANDS = ("details", "json-description", "list", "print", "print-json", "record-formats", "copy", "merge", "check", "decode", "checksums", "compare", "compare-verbatim", "rage", "hexdump", "fps")


@dataclass
class Command:
    name: str
    paths: list[str] = field(default_factory=list)
    chosen: Selection = field(default_factory=Selection)
    intervals: dict[int, int] = field(default_factory=dict)
    bucket: int = 0
    to: str = ""
    chunk_size: int = 0
    split: bool = False
    tags: dict[str, str] = field(default_factory=dict)


def is_type(name: str) -> bool:
    return name[:1].isalpha() and filters.named_type(name) is not None


def parse(words: Sequence[str]) -> Command:
    """Words of a command line; a bare path stands for ``details``."""
    words = list(words)
    if not words:
        raise ValueError("which file?")
    command = Command(words.pop(0)) if words[0] in COMMANDS else Command("details")
    need = iter(words)

    def take(what: str) -> str:
        try:
            return next(need)
        except StopIteration:
            raise ValueError(f"{what} needs a value") from None

    for w in need:
        if w in ("+", "-"):
            name = take(w)
            (command.chosen.types if is_type(name) else command.chosen.streams).append((w, name))
        elif w == "--after":
            command.chosen.after = Bound.parse(take(w))
        elif w == "--before":
            command.chosen.before = Bound.parse(take(w))
        elif w == "--range":
            command.chosen.after, command.chosen.before = Bound.parse(take(w)), Bound.parse(take(w))
        elif w == "--around":
            command.chosen.around = (Bound.parse(take(w)), float(take(w)))
        elif w == "--first-records":
            command.chosen.first_only = True
        elif w == "--decimate":
            type_id, seconds = int(take(w).split("-")[0]), float(take(w))
            command.intervals[type_id] = round(seconds * 1e6)
        elif w == "--bucket-interval":
            command.bucket = round(float(take(w)) * 1e6)
        elif w == "--to":
            command.to = take(w)
        elif w == "--chunk-size":  # in MB
            command.chunk_size = int(take(w)) << 20
        elif w == "--index-first":
            command.split = True
        elif w == "--file-tag":
            name, value = take(w), take(w)
            command.tags[name] = value
        elif w.startswith("--"):
            raise ValueError(f"{w} isn't known")
        else:
            command.paths.append(w)
    if not command.paths:
        raise ValueError("which file?")
    if command.name in ("copy", "merge") and not command.to:
        raise ValueError(f"{command.name} needs --to")
    if command.name.startswith("compare") and len(command.paths) != 2:
        raise ValueError(f"{command.name} needs two files")
    return command


def opened(spark: SparkSession, command: Command, table: str = "records", pushdown: bool = False) -> DataFrame:
    """A table of the command's files; ``pushdown`` only where it is scanned once, as Spark holds the filters pushed last against all scans."""
    spark.dataSource.register(RecordingSource)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("recording").option("pushdown", str(pushdown).lower()).option("table", table).load(",".join(command.paths))


def undamaged(spark: SparkSession, command: Command) -> DataFrame:
    """Records up to the first damaged one of each file, by a load for each, so that a filter by file_id leaves the others out of the plan."""
    loads = [filters.up_to_damage(opened(spark, replace(command, paths=[p]), "checked")).withColumn("file_id", F.lit(p)) for p in command.paths]
    return functools.reduce(DataFrame.unionByName, loads)


def thinned(records: DataFrame, command: Command) -> DataFrame:
    """Interval decimation; the bucket grid applies only where no interval is asked for."""
    if command.intervals:
        return decimate.interval_decimate(records, command.intervals)
    return decimate.bucket_decimate(records, command.bucket) if command.bucket else records


def merged_tags(parts: list) -> tuple[dict[str, str], dict[str, str]]:
    """Tags of streams that become one, in the order of their files."""
    user: dict[str, str] = {}
    private: dict[str, str] = {}
    for p in parts:
        user, private = merge.merge_tags(user, dict(p["user"])), merge.merge_tags(private, dict(p["private"]), private=True)
    return user, private


def renamed(streams: DataFrame, records: DataFrame, instance: str, file: str, joined: bool) -> DataFrame:
    """Tags of the streams that ``records`` hold under their new instance and file; where streams are ``joined`` the first file's tags decide, others are merged."""
    keys = ["file_id", "type_id", "instance_id"]
    rows = streams.join(records.select(*keys, F.col(instance).alias("new")).distinct(), keys)
    if joined:
        part = F.struct("file_id", "instance_id", F.map_entries("user_tags").alias("user"), F.map_entries("private_tags").alias("private"))
        rows = rows.groupBy("type_id", "new").agg(F.sort_array(F.collect_list(part)).alias("parts"))
        rows = rows.withColumn("tags", F.udf(lambda parts: merged_tags(parts), T.StructType([T.StructField("user", TAGS), T.StructField("private", TAGS)]))("parts")).select("type_id", "new", F.col("tags.user").alias("user_tags"), F.col("tags.private").alias("private_tags"))
    return rows.select(F.lit(file).alias("file_id"), "type_id", F.col("new").alias("instance_id"), "user_tags", "private_tags")


def file_tags(spark: SparkSession, command: Command, joined: bool) -> dict[str, str]:
    """The tags of the output: of the first file that has one, or merged; the command's own on top."""
    tags = [dict(r["tags"]) for r in opened(spark, command, "files").orderBy("file_id").collect()]  # one row a file
    if not merge.related(tags):
        raise ValueError("these recordings don't belong together")
    out: dict[str, str] = {}
    for t in tags:
        out = merge.merge_tags(out, t) if joined else merge.first_tags([out, t])
    return merge.with_tags(out, command.tags)


def written(spark: SparkSession, command: Command, records: DataFrame) -> DataFrame:
    """The copy of one file, of several side by side, or merged: written at once, one row a file.

    Records are chosen once and kept on the executors' disks, as writing goes through them several times.
    """
    name = "merged" if command.name == "merge" else "copied"
    if name == "merged":
        records, instance = merge.merged(records), "fused_instance"
    elif len(command.paths) > 1:
        records, instance = merge.with_unique_ids(records), "unique_instance"
    else:
        records, instance = records.withColumn("own_instance", F.col("instance_id")), "own_instance"
    records = records.persist(StorageLevel.DISK_ONLY)
    try:
        streams = renamed(opened(spark, command, "streams"), records, instance, name, name == "merged")
        out = records.withColumn("file_id", F.lit(name)).drop("instance_id").withColumnRenamed(instance, "instance_id")
        done = write_recordings(out, command.to, file_tags(spark, command, name == "merged"), streams=streams, chunk_size=command.chunk_size, split=command.split)
        return spark.createDataFrame(done.collect(), done.schema)
    finally:
        records.unpersist()


def run(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    """The relation that a command shows or writes."""
    command = parse(words)
    if command.name == "compare-verbatim":
        return export.compare_verbatim(spark, *command.paths)
    streams = opened(spark, command, "streams")
    if command.name == "record-formats":
        tags = streams.select("file_id", "stream_id", F.explode("private_tags").alias("name", "format"))
        return tags.where(F.col("name").startswith("RF:"))
    slim = command.name in ("details", "json-description", "list", "fps")
    counted = any("+" in name for _, name in command.chosen.streams)  # the N-th of a type needs a scan more
    once = command.name in ("details", "json-description", "list") and not counted
    records = undamaged(spark, command) if command.name == "compare" else opened(spark, command, "index" if slim else "checked", once)
    if command.chosen.streams:
        records = filters.with_flavor(records, streams)
    if command.name == "check":
        return stats.decode_check(filters.select_records(records, command.chosen))
    if not slim and command.name != "compare":
        records = filters.up_to_damage(records)
    with_context = command.name not in ("list", "details", "json-description")
    out = thinned(filters.select_records(records, command.chosen, with_context), command)
    if command.name == "details":
        return stats.overview(out)
    if command.name == "json-description":
        return stats.json_description(out)
    if command.name == "list":
        return merge.canonical(out)
    if command.name == "fps":
        return stats.fps_estimate(out)
    if command.name == "rage":
        return merge.canonical(filters.first_records(out))
    if command.name in ("print", "print-json"):
        return decode.decoded_blocks(merge.canonical(out), streams)
    if command.name == "decode":
        return specs.decode_status(decode.decoded_blocks(out, streams))
    if command.name == "hexdump":
        return merge.canonical(out.withColumn("hex", F.hex("payload")).withColumn("checksum", digest.bytes_checksum("payload")).drop("payload"))
    if command.name == "checksums":
        return digest.checksums(out, streams, opened(spark, command, "files"))
    if command.name == "compare":
        left, right = (out.where(F.col("file_id") == p) for p in command.paths)
        return compare.compare_records(left, right)
    return written(spark, command, out)


def main() -> None:
    spark = SparkSession.builder.appName("recordings").getOrCreate()
    run(spark, sys.argv[1:]).show(1000, truncate=False)


if __name__ == "__main__":
    main()

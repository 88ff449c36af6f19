"""Registered queries of the recording engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklode.operators import compare, decimate, digest, filters, merge, stats, temporal
from tracklode.operators.filters import Bound, Selection
from tracklode.sources.events import ITEMS_SQL, RECORDS_SQL, event_records, item_records

DAY = 86_400
DAY_US = DAY * 1_000_000
KEY = ["file_id", "type_id", "instance_id", "record_type", "ts_us", "file_offset"]
STREAM = ["file_id", "type_id", "instance_id"]
K, S = ", ".join(KEY), ", ".join(STREAM)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str = RECORDS_SQL):
    """Register a query under ``name``; ``sql`` continues WITH rec AS (...)."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = f"WITH RECURSIVE {base.strip()} {sql.strip()}"
        return f

    return add


def known(name: str) -> F.Column:
    """A nullable number with -1 for null, so that every reader sees whole numbers."""
    return F.coalesce(name, F.lit(-1)).alias(name)


# --- scans, catalog ---------------------------------------------------------------


@query("canonical_records", f"SELECT {K}, record_size FROM rec")
def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    return merge.canonical(event_records(spark, d)).select(*KEY, "record_size")


@query("stream_list", f"SELECT {S}, stream_id, CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY ALL")
def stream_list(spark, d):
    return event_records(spark, d).groupBy(*STREAM, "stream_id").agg(F.count("*").alias("n"))


@query(
    "nth_stream_of_type",
    f"SELECT {S} FROM (SELECT DISTINCT {S} FROM rec) QUALIFY row_number() OVER (PARTITION BY file_id, type_id ORDER BY instance_id) = 3",
)
def nth_stream_of_type(spark, d):
    streams = event_records(spark, d).select(*STREAM).distinct()
    return merge.fused(streams).where("fused_instance = 3").select(*STREAM)


@query(
    "stream_signature",
    """SELECT file_id, string_agg(type_id || '-' || ('SN' || instance_id) || '-' || c || '-' || s || '-' || dd, ',' ORDER BY type_id, instance_id) AS signature
    FROM (SELECT file_id, type_id, instance_id, count(*) FILTER (WHERE record_type = 'configuration') AS c,
                 count(*) FILTER (WHERE record_type = 'state') AS s, count(*) FILTER (WHERE record_type = 'data') AS dd FROM rec GROUP BY ALL) GROUP BY file_id""",
)
def stream_signature(spark, d):
    r = event_records(spark, d)
    streams = r.select(*STREAM).distinct().withColumn("serial", F.concat(F.lit("SN"), "instance_id"))
    return stats.stream_signature(r, streams)


@query("record_list", "SELECT format('{} {} {} @ {:.6f}', stream_id, record_type, file_offset, ts_us / 1e6) AS line FROM rec")
def record_list(spark, d):
    return event_records(spark, d).select(F.format_string("%s %s %d @ %.6f", "stream_id", "record_type", "file_offset", F.col("ts_us") / 1e6).alias("line"))


@query(
    "json_description",
    f"""SELECT {S}, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(sum(record_size) AS BIGINT) AS size FROM rec GROUP BY ALL""",
)
def json_description(spark, d):
    j = stats.json_description(event_records(spark, d))
    v = F.from_json("json", "stream_id string, n long, first_us long, last_us long, size long")
    out = j.select("file_id", v.alias("v")).select("file_id", "v.*")
    return out.select(
        "file_id", F.split_part("stream_id", F.lit("-"), F.lit(1)).cast("int").alias("type_id"), F.split_part("stream_id", F.lit("-"), F.lit(2)).cast("int").alias("instance_id"), "n", "first_us", "last_us", "size"
    )


@query(
    "record_sizes",
    f"SELECT {K}, coalesce(lead(file_offset) OVER (PARTITION BY file_id ORDER BY file_offset), -1) AS next_offset FROM rec",
)
def record_sizes(spark, d):
    return temporal.record_limits(event_records(spark, d)).select(*KEY, known("next_offset"))


@query(
    "decode_props",
    f"SELECT {K}, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract_string(payload, '$.missing') AS BIGINT), -1) AS missing FROM rec WHERE record_type = 'data'",
)
def decode_props(spark, d):
    r = event_records(spark, d).where("record_type = 'data'").withColumn("v", F.from_json("payload", "k long, missing long"))
    return r.select(*KEY, F.col("v.k").alias("k"), F.coalesce("v.missing", F.lit(-1)).cast("long").alias("missing"))


# --- aggregates ---------------------------------------------------------------------


@query(
    "stream_counts",
    f"""SELECT {S}, count(*) AS n_total, count(*) FILTER (WHERE record_type = 'configuration') AS n_configuration,
    count(*) FILTER (WHERE record_type = 'state') AS n_state, count(*) FILTER (WHERE record_type = 'data') AS n_data FROM rec GROUP BY ALL""",
)
def stream_counts(spark, d):
    return stats.stream_counts(event_records(spark, d))


@query(
    "data_time_range",
    """SELECT file_id, coalesce(min(ts_us) FILTER (WHERE record_type = 'data'), 0) AS first_us,
    coalesce(max(ts_us) FILTER (WHERE record_type = 'data'), 0) AS last_us FROM rec GROUP BY file_id""",
)
def data_time_range(spark, d):
    return stats.data_time_range(event_records(spark, d))


RPS = "CASE WHEN count(*) > 1 AND max(ts_us) > min(ts_us) THEN (count(*) - 1) * 1e6 / (max(ts_us) - min(ts_us)) END"


@query("stream_type_stats", f"SELECT {S}, record_type, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, {RPS} AS rps FROM rec GROUP BY ALL")
def stream_type_stats(spark, d):
    return stats.stream_type_stats(event_records(spark, d))


@query(
    "overview_rollup",
    f"""SELECT CAST(2 - grouping(stream_id) - grouping(record_type) AS INT) AS level, file_id, stream_id, record_type, count(*) AS n,
    min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(sum(record_size) AS BIGINT) AS size, {RPS} AS rps
    FROM rec GROUP BY GROUPING SETS ((file_id), (file_id, stream_id), (file_id, stream_id, record_type))""",
)
def overview_rollup(spark, d):
    return stats.overview(event_records(spark, d))


@query("image_time_extent", "SELECT file_id, min(ts_us) AS first_us, max(ts_us) AS last_us FROM rec WHERE record_type = 'data' AND type_id IN (200, 203) GROUP BY file_id")
def image_time_extent(spark, d):
    return event_records(spark, d).where("record_type = 'data' AND type_id IN (200, 203)").groupBy("file_id").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query("grouped_size", f"SELECT {S}, CAST(sum(record_size) AS BIGINT) AS size FROM rec GROUP BY ALL")
def grouped_size(spark, d):
    return event_records(spark, d).groupBy(*STREAM).agg(F.sum("record_size").alias("size"))


BUCKET = """CASE WHEN g < 0.01 THEN CASE WHEN CAST(floor(g * 1000) AS BIGINT) > 0 THEN CAST(floor(g * 1000) AS BIGINT) WHEN g < 0.00075 THEN 0 ELSE 1 END
  WHEN g < 1 THEN CAST(floor(g * 1000) AS BIGINT) - CAST(floor(g * 1000) AS BIGINT) % 5 ELSE CAST(floor(g) AS BIGINT) * 1000 END"""


@query(
    "gap_histogram",
    f""", gaps AS (SELECT {S}, ts_us - lag(ts_us) OVER (PARTITION BY {S} ORDER BY ts_us, file_offset) AS gap FROM rec WHERE record_type = 'data')
    SELECT {S}, {BUCKET} AS bucket, count(*) AS n, CAST(sum(gap) AS BIGINT) AS sum_us FROM (SELECT *, gap / 1e6 AS g FROM gaps WHERE gap IS NOT NULL) GROUP BY ALL""",
)
def gap_histogram(spark, d):
    return stats.gap_histogram(event_records(spark, d))


@query("fps_estimate")
def fps_estimate(spark, d):
    return stats.fps_estimate(event_records(spark, d))


AUDIO = "SELECT *, 20000 + file_offset % 7 * 3000 AS samples FROM rec WHERE record_type = 'data'"


def audio_blocks(spark, d):
    return event_records(spark, d).where("record_type = 'data'").withColumn("samples", (F.lit(20000) + F.col("file_offset") % 7 * 3000).cast("long"))


@query(
    "audio_gap_stats",
    f""", blocks AS ({AUDIO}), g AS (SELECT {S}, samples, lag(samples) OVER w AS prior, (ts_us - lag(ts_us) OVER w) / 1e6 AS gap
      FROM blocks WINDOW w AS (PARTITION BY {S} ORDER BY ts_us, file_offset))
    SELECT {S}, min(gap) AS min_gap, max(gap) AS max_gap, min(prior / 4) AS min_mid_duration, max(prior / 4) AS max_mid_duration,
      CAST(sum(CASE WHEN gap / greatest(prior / 4, samples / 4) > 1.8 THEN floor(gap / greatest(prior / 4, samples / 4) - 0.5) ELSE 0 END) AS BIGINT) AS missed,
      sum(samples) / 4 AS total_duration FROM g GROUP BY ALL""",
)
def audio_gap_stats(spark, d):
    return stats.audio_summary(audio_blocks(spark, d), 4).drop("first_sample_ratio")


@query(
    "segment_sessions",
    f""", f AS (SELECT {K}, file_offset // 40 % 3 AS form FROM rec WHERE record_type = 'data'),
    c AS (SELECT *, lag(form) OVER (PARTITION BY {S} ORDER BY ts_us, file_offset) AS prior FROM f)
    SELECT {K}, form, CAST(sum(CASE WHEN prior IS NOT NULL AND prior <> form THEN 1 ELSE 0 END) OVER (PARTITION BY {S} ORDER BY ts_us, file_offset) AS BIGINT) AS segment FROM c""",
)
def segment_sessions(spark, d):
    r = event_records(spark, d).where("record_type = 'data'").withColumn("form", F.floor(F.col("file_offset") / 40) % 3)
    return stats.segments(r).select(*KEY, "form", "segment")


@query(
    "jitter_flags",
    f""", b AS (SELECT *, file_offset // 4000 AS segment FROM ({AUDIO})),
    e AS (SELECT *, min(ts_us) OVER (PARTITION BY {S}, segment) AS start,
      CAST(sum(samples) OVER (PARTITION BY {S}, segment ORDER BY ts_us, file_offset) AS BIGINT) - samples AS sofar FROM b)
    SELECT {K}, start + CAST(floor(sofar * 1000000 / 4) AS BIGINT) AS expected_us, abs(ts_us - (start + CAST(floor(sofar * 1000000 / 4) AS BIGINT))) > 10000 AS late FROM e""",
)
def jitter_flags(spark, d):
    r = audio_blocks(spark, d).withColumn("segment", F.floor(F.col("file_offset") / 4000))
    return stats.jitter(r, 4).select(*KEY, "expected_us", "late")


@query(
    "decode_check",
    """, s AS (SELECT *, file_offset % 997 <> 990 AS ok FROM rec), b AS (SELECT file_id, min(ts_us) FILTER (WHERE NOT ok) AS bad FROM s GROUP BY file_id)
    SELECT file_id, count(*) AS total, count(*) FILTER (WHERE bad IS NULL OR ts_us < bad) AS good,
      count(*) FILTER (WHERE bad IS NULL OR ts_us < bad) * 100.0 / count(*) AS percent FROM s JOIN b USING (file_id) GROUP BY file_id""",
)
def decode_check(spark, d):
    return stats.decode_check(event_records(spark, d).withColumn("ok", F.col("file_offset") % 997 != 990))


# --- filters ------------------------------------------------------------------------


@query(
    "trim_range",
    f", b AS (SELECT min(ts_us) + {2 * DAY_US} AS lo FROM rec) SELECT {K} FROM rec, b WHERE ts_us > lo AND ts_us <= lo + {5 * DAY_US}",
)
def trim_range(spark, d):
    r = event_records(spark, d)
    lo = r.agg(F.min("ts_us")).first()[0] + 2 * DAY_US
    return filters.in_range(r, lo, lo + 5 * DAY_US).select(*KEY)


@query(
    "around",
    f", b AS (SELECT min(ts_us) + {10 * DAY_US} AS t FROM rec WHERE record_type = 'data') SELECT {K} FROM rec, b WHERE ts_us > t - {DAY_US} AND ts_us <= t + {DAY_US}",
)
def around(spark, d):
    chosen = Selection(around=(Bound(10 * DAY, True), 2 * DAY))
    return filters.select_records(event_records(spark, d), chosen, with_context=False).select(*KEY)


@query(
    "relative_range",
    f", b AS (SELECT min(ts_us) + {3 * DAY_US} AS lo, max(ts_us) - {4 * DAY_US} AS hi FROM rec WHERE record_type = 'data') SELECT {K} FROM rec, b WHERE ts_us > lo AND ts_us <= hi",
)
def relative_range(spark, d):
    chosen = Selection(after=Bound.parse(f"+{3 * DAY}"), before=Bound.parse(f"-{4 * DAY}"))
    return filters.select_records(event_records(spark, d), chosen, with_context=False).select(*KEY)


@query("stream_filter_fold", f"SELECT {K} FROM rec WHERE type_id IN (200, 201) AND stream_id <> '200-3' AND stream_id <> '201-5' OR stream_id = '203-2'")
def stream_filter_fold(spark, d):
    signs = [("+", "200"), ("+", "201"), ("-", "200-3"), ("-", "201-5"), ("+", "203+2")]
    return filters.select_records(event_records(spark, d), Selection(streams=signs)).select(*KEY)


@query("type_filter", f"SELECT {K} FROM rec WHERE record_type IN ('configuration', 'state')")
def type_filter(spark, d):
    return filters.select_records(event_records(spark, d), Selection(types=[("-", "d")])).select(*KEY)


@query("skip_predicate", f"SELECT {K} FROM rec WHERE NOT value > 100")
def skip_predicate(spark, d):
    return filters.select_records(event_records(spark, d), Selection(skip=F.col("value") > 100)).select(*KEY)


FIRST = f"QUALIFY row_number() OVER (PARTITION BY {S}, record_type ORDER BY ts_us, file_offset) = 1"


@query("first_records", f"SELECT {K} FROM rec {FIRST}")
def first_records(spark, d):
    return filters.first_records(event_records(spark, d)).select(*KEY)


@query("last_records", f"SELECT {K} FROM rec QUALIFY row_number() OVER (PARTITION BY {S}, record_type ORDER BY ts_us DESC, file_offset DESC) = 1")
def last_records(spark, d):
    return filters.last_records(event_records(spark, d)).select(*KEY)


TRIM = f"""b AS (SELECT min(ts_us) + {2 * DAY_US} AS lo, max(ts_us) - {DAY_US} AS hi FROM rec
    WHERE record_type = 'data' AND type_id IN (200, 201) AND stream_id <> '200-3'),
  r AS (SELECT * FROM rec WHERE type_id IN (200, 201) AND stream_id <> '200-3'),
  pre AS (SELECT r.* FROM r, b WHERE ts_us <= lo AND record_type IN ('configuration', 'state') AND file_id IN (SELECT file_id FROM r, b WHERE ts_us > lo)
    QUALIFY row_number() OVER (PARTITION BY {S}, record_type ORDER BY ts_us DESC, file_offset DESC) = 1),
  cut AS (SELECT * FROM pre UNION ALL SELECT r.* FROM r, b WHERE ts_us > lo AND ts_us <= hi)"""
TRIMMED = Selection(streams=[("+", "200"), ("+", "201"), ("-", "200-3")], after=Bound.parse(f"+{2 * DAY}"), before=Bound.parse(f"-{DAY}"))


@query("preroll_trim", f", {TRIM} SELECT {K} FROM cut")
def preroll_trim(spark, d):
    return filters.select_records(event_records(spark, d), TRIMMED).select(*KEY)


@query("trim_report", f", {TRIM} SELECT {S}, record_type, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, {RPS} AS rps FROM cut GROUP BY ALL")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    return stats.stream_type_stats(filters.select_records(event_records(spark, d), TRIMMED))


# --- lookups ------------------------------------------------------------------------


def probes(records: DataFrame) -> DataFrame:
    """Probe times half an hour off every state record's time."""
    return records.where("record_type = 'state'").select(*STREAM, (F.col("ts_us") + 1_800_000_000).alias("ts_us"), F.col("file_offset").alias("probe"))


PROBES = f"p AS (SELECT {S}, ts_us + 1800000000 AS ts_us, file_offset AS probe FROM rec WHERE record_type = 'state'), dat AS (SELECT * FROM rec WHERE record_type = 'data')"


@query(
    "record_by_time",
    f""", {PROBES} SELECT p.file_id, p.type_id, p.instance_id, p.ts_us, p.probe, coalesce(r.ts_us, -1) AS hit_ts_us, coalesce(r.file_offset, -1) AS hit_offset
    FROM p ASOF LEFT JOIN dat r ON p.file_id = r.file_id AND p.type_id = r.type_id AND p.instance_id = r.instance_id AND p.ts_us <= r.ts_us""",
)
def record_by_time(spark, d):
    r = event_records(spark, d)
    out = temporal.lower_bound_join(probes(r), r.where("record_type = 'data'"))
    return out.select(*STREAM, "ts_us", "probe", known("hit_ts_us"), known("hit_offset"))


EPS = 6 * 3_600_000_000


@query(
    "nearest_record",
    f""", {PROBES}, a AS (SELECT p.*, r.ts_us AS rt, r.file_offset AS ro FROM p ASOF LEFT JOIN dat r ON p.file_id = r.file_id AND p.type_id = r.type_id AND p.instance_id = r.instance_id AND p.ts_us <= r.ts_us),
    l AS (SELECT a.*, r.ts_us AS lt, r.file_offset AS lo FROM a ASOF LEFT JOIN dat r ON a.file_id = r.file_id AND a.type_id = r.type_id AND a.instance_id = r.instance_id AND a.ts_us >= r.ts_us),
    n AS (SELECT *, lt IS NULL OR (rt IS NOT NULL AND rt - ts_us < ts_us - lt) AS take FROM l)
    SELECT {S}, ts_us, probe, CASE WHEN abs((CASE WHEN take THEN rt ELSE lt END) - ts_us) <= {EPS} THEN CASE WHEN take THEN rt ELSE lt END ELSE -1 END AS hit_ts_us,
      CASE WHEN abs((CASE WHEN take THEN rt ELSE lt END) - ts_us) <= {EPS} THEN CASE WHEN take THEN ro ELSE lo END ELSE -1 END AS hit_offset FROM n""",
)
def nearest_record(spark, d):
    r = event_records(spark, d)
    out = temporal.nearest_join(probes(r), r.where("record_type = 'data'"), EPS)
    return out.select(*STREAM, "ts_us", "probe", known("hit_ts_us"), known("hit_offset"))


@query(
    "config_asof",
    f""", c AS (SELECT * FROM rec WHERE record_type = 'configuration')
    SELECT r.file_id, r.type_id, r.instance_id, r.record_type, r.ts_us, r.file_offset, coalesce(c.ts_us, -1) AS config_ts_us, c.payload AS config
    FROM (SELECT * FROM rec WHERE record_type = 'data') r ASOF LEFT JOIN c ON r.file_id = c.file_id AND r.type_id = c.type_id AND r.instance_id = c.instance_id AND r.ts_us >= c.ts_us""",
)
def config_asof(spark, d):
    return temporal.config_asof(event_records(spark, d)).select(*KEY, known("config_ts_us"), "config")


@query(
    "index_numbers",
    f"""SELECT {K}, row_number() OVER (PARTITION BY file_id ORDER BY ts_us, type_id, instance_id, file_offset) - 1 AS index_number,
    row_number() OVER (PARTITION BY {S} ORDER BY ts_us, file_offset) - 1 AS stream_index_number FROM rec""",
)
def index_numbers(spark, d):
    return temporal.index_numbers(event_records(spark, d)).select(*KEY, "index_number", "stream_index_number")


@query("kth_record", f"SELECT {K} FROM rec QUALIFY row_number() OVER (PARTITION BY {S}, record_type ORDER BY ts_us, file_offset) = 5")
def kth_record(spark, d):
    return temporal.kth_record(event_records(spark, d), 4).select(*KEY)


@query("record_gaps", f"SELECT {K}, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY {S}, record_type ORDER BY ts_us, file_offset), -1) AS gap_us FROM rec")
def record_gaps(spark, d):
    return temporal.record_gaps(event_records(spark, d)).select(*KEY, known("gap_us"))


# --- decimation ---------------------------------------------------------------------


@query(
    "interval_decimate",
    f""", dd AS (SELECT * FROM rec WHERE record_type = 'data'), nxt AS (
      SELECT a.file_id, a.type_id, a.instance_id, a.ts_us, min(b.ts_us) AS hop FROM dd a JOIN dd b
      ON a.file_id = b.file_id AND a.type_id = b.type_id AND a.instance_id = b.instance_id AND a.ts_us + {DAY_US} <= b.ts_us GROUP BY ALL),
    walk AS (SELECT {S}, min(ts_us) AS ts_us FROM dd GROUP BY ALL UNION ALL
      SELECT n.file_id, n.type_id, n.instance_id, n.hop FROM walk w JOIN nxt n ON w.file_id = n.file_id AND w.type_id = n.type_id AND w.instance_id = n.instance_id AND w.ts_us = n.ts_us WHERE n.hop IS NOT NULL)
    SELECT r.file_id, r.type_id, r.instance_id, r.record_type, r.ts_us, r.file_offset FROM rec r LEFT JOIN walk w USING (file_id, type_id, instance_id, ts_us) WHERE r.record_type <> 'data' OR w.ts_us IS NOT NULL""",
)
def interval_decimate(spark, d):
    return decimate.interval_decimate(event_records(spark, d), DAY_US).select(*KEY)


@query("bucket_decimate")
def bucket_decimate(spark, d):
    return decimate.bucket_decimate(event_records(spark, d), 3600 * 1_000_000, 600 * 1_000_000).select(*KEY)


# --- merge and compare ----------------------------------------------------------------


FUSED = f"""u AS (SELECT {S}, row_number() OVER (PARTITION BY file_id, type_id ORDER BY instance_id) AS fused_instance FROM (SELECT DISTINCT {S} FROM rec)),
  fu AS (SELECT rec.*, CAST(fused_instance AS INT) AS fused_instance FROM rec JOIN u USING (file_id, type_id, instance_id))"""


@query("fuse_streams", f", {FUSED} SELECT {K}, fused_instance FROM fu")
def fuse_streams(spark, d):
    return merge.fused(event_records(spark, d)).select(*KEY, "fused_instance")


@query(
    "merge_dedup",
    """, c AS (SELECT *, CASE WHEN instance_id = 1 THEN 1 ELSE 2 END AS fused_instance FROM item),
    p AS (SELECT *, lag(ts_us) OVER (PARTITION BY type_id, fused_instance, record_type ORDER BY ts_us, file_id, file_offset) AS before FROM c)
    SELECT type_id, instance_id, record_type, ts_us, file_offset FROM p WHERE before IS NULL OR before <> ts_us""",
    base=ITEMS_SQL,
)
def merge_dedup(spark, d):
    r = item_records(spark, d).withColumn("fused_instance", F.when(F.col("instance_id") == 1, 1).otherwise(2))
    return merge.drop_repeated_times(r).select("type_id", "instance_id", "record_type", "ts_us", "file_offset")


@query(
    "merge_union",
    f""", ids AS (SELECT DISTINCT {S} FROM rec), z AS (SELECT type_id, instance_id FROM ids WHERE file_id = 0)
    SELECT {K}, unique_instance FROM rec JOIN (SELECT *, CAST(instance_id AS INT) AS unique_instance FROM ids WHERE file_id = 0
      UNION ALL SELECT i.*, CAST(i.instance_id AS INT) FROM ids i WHERE file_id = 1 AND NOT EXISTS (SELECT 1 FROM z WHERE z.type_id = i.type_id AND z.instance_id = i.instance_id)
      UNION ALL SELECT i.*, CAST(m.top + row_number() OVER (PARTITION BY i.type_id ORDER BY i.instance_id) AS INT) FROM ids i
        JOIN (SELECT type_id, max(instance_id) AS top FROM ids GROUP BY type_id) m USING (type_id)
        WHERE file_id = 1 AND EXISTS (SELECT 1 FROM z WHERE z.type_id = i.type_id AND z.instance_id = i.instance_id)) USING (file_id, type_id, instance_id)""",
)
def merge_union(spark, d):
    return merge.with_unique_ids(event_records(spark, d)).select(*KEY, "unique_instance")


@query("stream_digests")
def stream_digests(spark, d):
    return digest.stream_digests(event_records(spark, d))


@query(
    "compare_streams",
    """, st AS (SELECT DISTINCT file_id, type_id, instance_id FROM rec),
    l AS (SELECT type_id, instance_id AS left_instance, row_number() OVER (PARTITION BY type_id ORDER BY instance_id) AS place FROM st WHERE file_id = 0),
    r AS (SELECT type_id, instance_id AS right_instance, row_number() OVER (PARTITION BY type_id ORDER BY instance_id) AS place FROM st WHERE file_id = 1)
    SELECT type_id, CAST(place AS INT) AS place, left_instance, right_instance FROM l FULL JOIN r USING (type_id, place)""",
)
def compare_streams(spark, d):
    r = event_records(spark, d)
    return compare.stream_pairs(r.where("file_id = 0"), r.where("file_id = 1"))


@query(
    "compare_records",
    """, a AS (SELECT * FROM rec WHERE file_id = 0), b AS (SELECT * REPLACE (CASE WHEN file_offset % 50 = 0 THEN 'x' ELSE payload END AS payload) FROM a WHERE file_offset % 70 <> 0),
    pl AS (SELECT type_id, instance_id, row_number() OVER (PARTITION BY type_id ORDER BY instance_id) AS place FROM (SELECT DISTINCT type_id, instance_id FROM a))
    SELECT type_id, CAST(place AS INT) AS place, count(*) AS n_left, count(*) FILTER (WHERE b.payload = a.payload) AS n_matched,
      count(*) FILTER (WHERE b.payload <> a.payload) AS n_different, count(*) FILTER (WHERE b.payload IS NULL) AS n_missing
    FROM a JOIN pl USING (type_id, instance_id) LEFT JOIN b USING (type_id, instance_id, ts_us, record_type) GROUP BY ALL""",
)
def compare_records(spark, d):
    a = event_records(spark, d).where("file_id = 0")
    b = a.where("file_offset % 70 <> 0").withColumn("payload", F.when(F.col("file_offset") % 50 == 0, "x").otherwise(F.col("payload")))
    return compare.compare_records(a, b)

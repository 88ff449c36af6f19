"""Exact dedup by skew-safe combining, with DataFrame functions only.

Copies are texts that are equal once every character of ``[\\x20\\x09-\\x0D]`` is
deleted.  They are combined in three steps, and each step groups by digest *and*
full normalised text, so a digest collision never merges two texts:

1. each task combines its own rows (the partial side of the aggregation),
2. the partial groups meet by (digest, text, salt), so that a text with a third
   of all rows is spread over ``salts`` tasks,
3. the salt winners, at most ``salts`` per text, meet by (digest, text).

A document then finds its group by digest.  Step 3 also numbers the texts of a
digest; where a digest has more than one text, its documents find their group by
digest and text instead.

Cases: a null text counts as empty; all empty texts are copies of each other; of
equal lengths the smallest doc_id stays (null ids come last); repeated rows of one
doc_id count as separate copies and all get that doc_id's group, ``kept`` being
true for each row whose doc_id is the group's; very long texts are grouped and compared
whole; an empty table gives an empty result; other columns of the input are ignored,
unless the caller has them carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklode.llm.shared import staged, strip_ascii_space

SALTS = 16


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def copy_groups(docs: DataFrame, digest=sha256_hex, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, check, keep_id, group_size.

    ``check`` is a second hash of the text; it only serves where one doc_id
    carries several texts whose digests collide.
    """
    norm = strip_ascii_space(F.col("text"))
    rows = docs.select(
        "doc_id",
        norm.alias("content"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
    ).withColumn("digest", digest(F.col("content")))
    # The longest original first, then the smallest id; a null id sorts last.
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "content", "salt")
        .agg(best.alias("best"), F.count("*").alias("n"))
    )
    groups = salted.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    slim = groups.select(
        "digest", F.xxhash64("content").alias("check"), F.col("best.doc_id").alias("keep_id"), "group_size"
    )
    return staged(slim, "copy-groups")


def clashes(groups: DataFrame) -> DataFrame:
    """Digests that stand for more than one text."""
    return groups.groupBy("digest").agg(F.count("*").alias("n_texts")).where("n_texts > 1").select("digest")


def exact_dedup(docs: DataFrame, digest=sha256_hex, salts: int = SALTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256, and the columns of docs in ``carry``."""
    groups = copy_groups(docs, digest, salts)
    norm = strip_ascii_space(F.col("text"))
    rows = docs.select("doc_id", norm.alias("content"), *carry)
    clashing = clashes(groups)
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")]
    hashed = rows.withColumn("digest", digest(F.col("content")))
    text_sha = F.col("digest") if digest is sha256_hex else sha256_hex(F.col("content"))
    slim = hashed.select("doc_id", "digest", text_sha.alias("text_sha256"), *carry)
    if clashing.isEmpty():
        return slim.join(groups, "digest").select(*out, "text_sha256", *carry)
    clear = slim.join(clashing, "digest", "left_anti").join(groups, "digest").select(*out, "text_sha256", *carry)
    # Colliding digests: the group is found by comparing the texts themselves.
    held = hashed.join(clashing, "digest", "left_semi")
    keepers = (
        held.alias("k")
        .join(groups.alias("g"), (F.col("k.digest") == F.col("g.digest")) & F.col("k.doc_id").eqNullSafe(F.col("g.keep_id")))
        .where(F.xxhash64("k.content") == F.col("g.check"))
        .select("k.digest", "k.content", "g.keep_id", "g.group_size")
        .distinct()
    )
    resolved = held.join(keepers, ["digest", "content"]).select(*out, sha256_hex(F.col("content")).alias("text_sha256"), *carry)
    return clear.unionByName(resolved)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE = {"op1_exact_dedup": OP1_SQL}

"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last adds what the tokeniser found.  ``run`` writes each
stage as Parquet to the shared folder and reads it back for the next one, so a lost
executor never costs more than the stage at hand; tables that a stage staged on its way
are deleted when it is written.

A row is told by doc_id and a hash of doc_id and text, not by doc_id alone, so rows of
one id, or without one, have fates of their own.

Cases, for every stage: null texts count as empty, null ids are rows like any other
and never learned from; very long texts are taken whole; an empty table gives an empty
result; columns of any name pass through unchanged, those that an operator adds by the
same name too (but for the three that ``tokens`` replaces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklode.llm import shared
from tracklode.llm.bpe import default_vocabulary, encode_column
from tracklode.llm.decontaminate import contamination
from tracklode.llm.exact_dedup import exact_dedup
from tracklode.llm.quality import quality_scores
from tracklode.llm.shared import staged
from tracklode.llm.simhash import near_dedup


def told(docs: DataFrame) -> DataFrame:
    """doc_id, text, k (hash of both), size (code points)."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"), F.char_length(F.coalesce("text", F.lit(""))).alias("size"))


def keep_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id and hash are among ``keep``(doc_id, k), null ids included."""
    held = keep.select(F.col("doc_id").alias("_held"), F.col("k").alias("_k"))
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col("_held")) & (F.xxhash64("doc_id", "text") == F.col("_k")), "left_semi")


def keep_one(docs: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """One row of docs for each group in ``found``(doc_id, k, size, group): the longest text, then the least hash.

    Rows with all of that in common are the same document, and one of them stays.
    """
    rows = found.groupBy(group, "doc_id", "k", "size").agg(F.count("*").alias("n"))
    best = rows.groupBy(group).agg(F.min(F.struct((-F.col("size")).alias("less"), "k", "doc_id", "n")).alias("b"))
    keep = staged(best.select("b.doc_id", "b.k", "b.n"), "kept-rows")
    once = keep_rows(docs, keep.where("n = 1"))
    again = keep.where("n > 1")
    if again.isEmpty():
        return once
    return once.unionByName(keep_rows(docs, again).dropDuplicates(["doc_id", "text"]))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects; equal texts share a fate."""
    own = {c: f"_own_{c}" for c in ("held_out", "score", "predicted") if c in docs.columns}
    scored = quality_scores(docs.withColumnsRenamed(own), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the longest original, then the smallest id; of repeated rows one."""
    found = exact_dedup(told(docs), carry=("k", "size")).where("kept")
    return keep_one(docs, found, "text_sha256")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies keep the smallest id; of that id's several texts the longest."""
    found = near_dedup(told(docs), carry=("k", "size")).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return keep_one(docs, found, "root")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = told(docs).select(F.struct("doc_id", "k").alias("doc_id"), "text")
    return keep_rows(docs, contamination(rows, items).where("not contaminated").select("doc_id.*").distinct())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256."""
    return encode_column(docs, default_vocabulary(), with_ids=False)


STAGES = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: Classifier, fingerprints and tokeniser can't be written in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(shared.STAGED)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        shared.clear(spark, since, keep=1)
    return docs

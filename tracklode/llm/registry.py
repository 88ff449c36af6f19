"""All queries and SQL oracles of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklode.llm import bpe, decontaminate, exact_dedup, html_text, langid, line_dedup, pii, quality, simhash, substring_dedup

MODULES = (exact_dedup, simhash, bpe, pii, substring_dedup, langid, decontaminate, quality, html_text, line_dedup)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

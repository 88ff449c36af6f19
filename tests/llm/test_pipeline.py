"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.llm import brute
from tracklode.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline

    docs, labels, items = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    out = corpus_pipeline.run(spark, SF).toPandas()
    rows = quality.training_rows(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")), quality.SAMPLE)
    vectors, net = quality.fit(rows)
    kept = docs[quality.scores_of(list(docs.text), vectors, net, quality.Tokens()) >= quality.THRESHOLD]
    pairs = list(zip(kept.doc_id, kept.text))
    ids = {i for i, keep, *_ in brute.exact(pairs) if i == keep}
    fps = [(i, brute.fingerprint(t)) for i, t in pairs if i in ids]
    least = brute.near(fps)
    ids = {i for i, f in fps if least[f] == i}
    leaks = brute.leaks([(i, t) for i, t in pairs if i in ids], list(zip(items.item_id, items.text)))
    ids = {i for i, *_, leak in leaks if not leak}
    assert set(out.doc_id) == ids and len(out) == len(ids)
    codec = bpe.codec(bpe.default_vocabulary())
    text = dict(pairs)
    assert all(n == len(codec.encode(text[i])) // 4 for i, n in zip(out.doc_id, out.n_tokens))
    assert list(out.columns) == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    assert np.isin(out.doc_id, docs.doc_id).all()


CLASH = ["k", "size", "held", "n", "held_out", "score", "predicted", "root", "kept", "b", "component_id", "row", "term"]


def stage_frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def kept(df):
    assert all(r[c] == f"own {c}" for r in df.collect() for c in CLASH)
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_exact_stage_by_row(spark):
    import corpus_pipeline as c

    rows = [(1, "ab"), (1, "ab"), (2, "ab"), (None, "first text"), (None, "ab"), (3, None), (4, ""), (5, " "), (1, "c d"), (1, "cd"), (1, "cd"), (6, "x" * 100_000), (6, "x" * 100_000 + "\n")]
    want = [(1, "ab"), (None, "first text"), (5, " "), (1, "c d"), (6, "x" * 100_000 + "\n")]
    assert kept(c.exact(spark, stage_frame(spark, rows), SF)) == sorted(want, key=repr)
    assert kept(c.exact(spark, stage_frame(spark, []), SF)) == []


def test_near_stage_by_row(spark):
    import corpus_pipeline as c

    rows = [(1, "one two three"), (1, "one two three"), (1, "four five six"), (2, "ONE two  three"), (None, "seven eight"), (None, "seven  eight"), (None, None), (None, "nine ten"), (7, "nine ten")]
    want = [(1, "one two three"), (1, "four five six"), (None, "seven  eight"), (None, None), (7, "nine ten")]
    assert kept(c.near(spark, stage_frame(spark, rows), SF)) == sorted(want, key=repr)
    assert kept(c.near(spark, stage_frame(spark, []), SF)) == []


def test_decontaminate_stage_by_row(spark):
    import corpus_pipeline as c

    item = next(t for t in pd.read_parquet(f"{SF}/benchmark.parquet").text if t)
    rows = [(1, "clean words"), (1, f"before {item} after"), (None, item), (None, "clean"), (2, None), (1, "clean words")]
    want = [(1, "clean words"), (1, "clean words"), (None, "clean"), (2, None)]
    assert kept(c.decontaminate(spark, stage_frame(spark, rows), SF)) == sorted(want, key=repr)


def test_other_stages_on_awkward_rows(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, None), (None, ""), (1, "some words"), (1, "some words"), (2, "x" * 50_000)]
    some = kept(c.quality(spark, stage_frame(spark, rows), SF))
    assert set(some) <= set(rows) and some.count((1, "some words")) in (0, 2)
    out = c.tokens(spark, stage_frame(spark, rows), SF)
    assert kept(out) == sorted(rows, key=repr) and {r["n_tokens"] for r in out.where("text IS NULL OR text = ''").collect()} == {0}
    assert c.quality(spark, docs.limit(0), SF).count() == 0 and c.tokens(spark, docs.limit(0), SF).count() == 0


def test_run_leaves_one_table(spark):
    import os

    import corpus_pipeline
    from tracklode.llm import shared

    before = set(os.listdir(shared.shared_dir(spark)))
    corpus_pipeline.run(spark, SF)
    assert len(set(os.listdir(shared.shared_dir(spark))) - before) == 1


def test_every_query_is_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)

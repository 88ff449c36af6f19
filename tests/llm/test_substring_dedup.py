"""Repeated substrings against a dictionary of all windows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.cases import DOCS, frame, got
from tracklode.llm import substring_dedup


@pytest.mark.parametrize(("length", "group"), [(400, 128), (24, 2), (7, 3)])
def test_substring_dedup(spark, length, group):
    rng = np.random.default_rng(1)
    base = "".join(map(chr, rng.integers(97, 101, 1500)))
    rows = [r for r in DOCS if length == 400 or r[0] not in (12, 13)]
    for i in range(40):
        cut = [base[(a := rng.integers(0, 1400)) : a + rng.integers(1, 120)] for _ in range(4)]
        rows.append((100 + i, "".join(cut)))
    # Text with a period, whole and cut; two rows that are one; a passage among changing neighbours.
    rows += [(200, "xyz" * 400), (201, "yz" + "xyz" * 150 + "!"), (202, "ä" * 500), (None, "xyz" * 150), (None, "xyz" * 150), (203, base[:500]), (203, base[:500])]
    rows += [(300 + i, "".join(map(chr, rng.integers(97, 123, 400))) + base[:390] + "".join(map(chr, rng.integers(97, 99, 30)))) for i in range(12)]
    want = brute.repeats([(t or "").encode() for _, t in rows], length)
    out = substring_dedup.substring_dedup(frame(spark, rows), length, group)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)
    assert substring_dedup.substring_dedup(frame(spark, []), length).count() == 0


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_run_index_statistics():
    rng = np.random.default_rng(2)
    texts = [b"abracadabra", b"cadabrac", b"xxxxxx", b"abracadabra", *(bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (40, 1, 77, 40, 5))]
    groups = [0, 0, 0, 0, 1, 1, 1, 2, 2]
    all_ = [(i, p) for i, t in enumerate(texts) for p in range(len(t))]
    want = [[max((common(t[p:], texts[j][q:]) for j, q in all_ if (j, q) != (i, p) and groups[i] == groups[j])) for p in range(len(t))] for i, t in enumerate(texts)]
    assert [x.tolist() for x in substring_dedup.RunIndex(texts, groups, [False] * 9).statistics()] == want
    once = [0, 1, 2, 4, 5, 6, 7, 8]  # text 3 is a copy of text 0
    held = substring_dedup.RunIndex([texts[i] for i in once], [groups[i] for i in once], [i == 0 for i in once]).statistics()
    assert [x.tolist() for x in held] == [want[i] for i in once]


def test_run_index_is_run_compressed():
    unit = bytes(np.random.default_rng(4).integers(97, 123, 500).astype(np.uint8))
    assert len(substring_dedup.RunIndex([unit] * 200, [0] * 200, [False] * 200).head) < 2 * len(unit)


def test_periodic_text_is_a_few_rows():
    grams = substring_dedup.Grams(48)
    assert len(list(substring_dedup.runs(b"a" * 50_000, 400, grams))) <= 3
    assert len(list(substring_dedup.runs(b"abcdefghij" * 5000, 400, grams))) <= 4


def test_index_steps_seldom_search_for_their_run(monkeypatch):
    rng = np.random.default_rng(5)
    base = bytes(rng.integers(0, 256, 3000).astype(np.uint8))
    texts = [base[a : a + 500] for a in rng.integers(0, 2500, 60).tolist()] + [bytes(rng.integers(97, 101, 400).astype(np.uint8)) for _ in range(20)]
    groups = [0] * 40 + [1] * 20 + [2] * 20
    searched, search = [0], np.searchsorted

    def counted(a, v, *args, **named):
        searched[0] += np.size(v)
        return search(a, v, *args, **named)

    index = substring_dedup.RunIndex(texts, groups, [False] * 80)
    monkeypatch.setattr(np, "searchsorted", counted)
    found = index.statistics()
    monkeypatch.undo()
    # A step leads to the run that its own run's head leads to, or seldom to one behind it.
    assert searched[0] < sum(map(len, texts)) // 4
    place = [(i, p) for i, t in enumerate(texts) for p in range(len(t))]
    for i, p in (place[k] for k in rng.integers(0, len(place), 40).tolist()):
        assert found[i][p] == max(common(texts[i][p:], texts[j][q:]) for j, q in place if (j, q) != (i, p) and groups[j] == groups[i])


def test_marks_are_told_apart_by_context():
    texts = [b"abcab", b"abcab", b"zabcz"]
    assert substring_dedup.marked(texts[:2], [0, 0], [False] * 2, 3) == [(0, 0, 2), (1, 0, 2)]
    assert substring_dedup.marked(texts, [0, 1, 1], [False] * 3, 3) == [(1, 0, 0), (2, 1, 1)]
    assert substring_dedup.marked(texts[:1], [0], [True], 3) == [(0, 0, 2)]
    assert substring_dedup.marked([b"aa", b"aa"], [0, 0], [False] * 2, 1) == [(0, 0, 1), (1, 0, 1)]


@pytest.mark.parametrize("budget", [4 << 20, 0])
def test_a_large_gram_is_shared_by_tasks(spark, monkeypatch, budget):
    rng = np.random.default_rng(6)
    passage = "".join(map(chr, rng.integers(97, 123, 60)))
    rows = [(i, "".join(map(chr, rng.integers(97, 123, 30))) + passage + "".join(map(chr, rng.integers(97, 123, 30)))) for i in range(200)]
    spread, read = [], substring_dedup.contexts_of

    def counted(docs, kinds, length):
        parts = kinds.groupBy("g", F.spark_partition_id().alias("p")).count().groupBy("g").agg(F.sum("count").alias("m"), F.count("*").alias("tasks"))
        spread.append(parts.orderBy(F.desc("m")).first())
        return read(docs, kinds, length)

    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", budget)
    monkeypatch.setattr(substring_dedup, "contexts_of", counted)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = substring_dedup.substring_dedup(frame(spark, rows), 50, 8)
        found = got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == sorted(((i, *w) for (i, _), w in zip(rows, brute.repeats([t.encode() for _, t in rows], 50))), key=repr)
    # Every row has a context of its own around the passage's gram; no join gathers them.
    assert spread[0]["m"] > 100 and spread[0]["tasks"] > 1

"""Every operator against its plain version, with the awkward cases in one table."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.cases import DOCS, LONG, PROSE, frame, got
from tracklode.llm import bpe, decontaminate, exact_dedup, html_text, langid, line_dedup, pii, quality, simhash

def test_exact_dedup(spark):
    want = sorted(brute.exact(DOCS), key=repr)
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(exact_dedup.exact_dedup(frame(spark)), *names) == want
    # A digest of two values makes nearly every text collide; results stay the same.
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(2)).cast("string")
    assert got(exact_dedup.exact_dedup(frame(spark), digest=weak, salts=3), *names) == want
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_plan_is_native(spark):
    plan = exact_dedup.exact_dedup(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_simhash(spark):
    fps = [(i, brute.fingerprint(t)) for i, t in DOCS]
    least = brute.near(fps)
    want = sorted(((i, f"{f:016x}", least[f]) for i, f in fps), key=repr)
    assert got(simhash.near_dedup(frame(spark)), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_dedup(frame(spark, [])).count() == 0


def test_simhash_triples_leave_one_bit():
    from itertools import combinations_with_replacement

    for errors in combinations_with_replacement(range(6), 4):
        assert any(sum(errors.count(b) for b in t) <= 1 for t in simhash.TRIPLES)


@pytest.mark.parametrize("limit", [20_000, 6])
def test_simhash_links_clusters(spark, limit):
    rng = np.random.default_rng(0)
    out = set()
    for base in rng.integers(0, 2**63, 12):
        for _ in range(12):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 8)):
                x ^= 1 << int(k)
            out.add(x)
    fps = [(x, x) for x in sorted(out)]
    least = brute.near(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in out], "fp long")
    stars = {r["a"]: r["b"] for r in simhash.components(simhash.links(df, 4, limit)).collect()}
    label = {x: stars.get(v := (x - (1 << 64) if x >> 63 else x), v) for x in out}
    pairs: dict = {}
    assert all(pairs.setdefault(least[x], label[x]) == label[x] for x in out) and len(pairs) == len(set(label.values()))


@pytest.mark.parametrize("batch", [1, 2, 3])
def test_simhash_links_across_batches(spark, batch):
    # Pairs whose difference leaves one triple equal: bits 0, 11, 22 and 33 of the blocks 0 to 3.
    pairs = [(x := int(v), x ^ (1 | 1 << 11 | 1 << 22 | 1 << 33)) for v in np.random.default_rng(3).integers(0, 2**62, 25)]
    df = spark.createDataFrame([(x,) for p in pairs for x in p], "fp long")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        stars = {r["a"]: r["b"] for r in simhash.components(simhash.links(df)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert all(stars.get(a, a) == stars.get(b, b) for a, b in pairs)


@pytest.mark.parametrize("cut", [1, 2])
def test_simhash_group_cut_by_a_batch(cut):
    # [home A, replica A | replica B] and [home A, replica B | replica A]: the carried home meets the rest.
    a, b = 5, 7
    fps = np.array([[a, a, b], [a, b, a]][cut - 1], np.uint64)
    home = np.array([True, False, False])
    first = simhash.compared(np.zeros(2, np.int64), fps[:2], home[:2], 4)
    rest = simhash.compared(np.zeros(2, np.int64), fps[[0, 2]], home[[0, 2]], 4)
    assert [(int(x), int(y)) for out in (first, rest) for x, y in zip(*out)] == [(b, a)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    t = Tokenizer.from_file(path)
    t.no_padding(), t.no_truncation()
    want = []
    for i, text in DOCS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.decode(ids, skip_special_tokens=False))))
    coded = bpe.encode_column(frame(spark), path)
    assert got(coded, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = bpe.decode_ids(coded.select("doc_id", "ids", "decoded_sha256"), path)
    assert all(brute.sha(r["text"]) == r["decoded_sha256"] for r in back.collect())
    assert bpe.encode_column(frame(spark, []), path).count() == 0


def test_bpe_equals_the_library_on_the_table(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    t = Tokenizer.from_file(path)
    t.no_padding(), t.no_truncation()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    coded = {r["doc_id"]: r for r in bpe.decode_ids(bpe.encode_column(docs, path), path).collect()}
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert coded[r["doc_id"]]["ids"] == ids and coded[r["doc_id"]]["text"] == t.decode(ids, skip_special_tokens=False)


def test_bpe_skips_stale_pairs():
    c = bpe.codec(bpe.default_vocabulary())
    c.ranks = {("a", "a"): 1, ("aa", "aa"): 0, ("a", "b"): 2}
    try:
        assert c.merge(list("aaaab")) == ["aaaa", "b"]
        assert c.merge(list("aab")) == ["aa", "b"]
    finally:
        bpe.codec.cache_clear()


def test_pii(spark):
    f = pii.Feistel(b"key")
    card = "4111 1111 1111 1111"
    text = f"pay {card} or {card}, mail a.b@c.example.com, on 2020-02-29 from 10.0.0.1 +1 (168) 555-5254 token = \"abcdef0123456789\" 4111111111111112 4.0. x"
    out, found = pii.pseudonymised(text, f)
    assert found == {"card": 2, "email": 1, "date": 1, "ipv4": 1, "phone": 1, "secret": 1}
    a, b = out.split("pay ")[1].split(", mail")[0].split(" or ")
    assert a == b != card and pii.luhn(a.replace(" ", "")) and "4111111111111112 4.0. x" in out
    assert pii.pseudonymised(PROSE, f) == (PROSE, {})
    assert pii.pseudonymised(None, f) == (None, {}) and pii.pseudonymised("", f) == ("", {})
    r = {x["doc_id"]: x for x in pii.pseudonymise(frame(spark, [*DOCS, (20, text), (21, "again " + card)]), b"key").collect()}
    assert r[20]["n_found"] == 7 and r[4]["text"] is None and r[12]["text"] == LONG
    assert pii.pseudonymise(frame(spark, []), b"key").count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("pay 4111 1111 1111 1111 12/25", "card", "4111 1111 1111 1111"),
        ("pay 4111 1111 1111 1111 123 now", "card", "4111 1111 1111 1111"),
        ("order 12 4111 1111 1111 1111.", "card", "4111 1111 1111 1111"),
        ("4111111111111111 2024-01-31", "card", "4111111111111111"),
        ("on 2020-02-29 3782 822463 10005 12 34", "card", "3782 822463 10005"),
        ("12 34 56 78 90 12 5555-5555-5555-4444 99 88 77", "card", "5555-5555-5555-4444"),
        ("AT61 1904 3002 3457 3201 EUR", "iban", "AT61 1904 3002 3457 3201"),
        ("AT611904300234573201 BIC BKAUATWW", "iban", "AT611904300234573201"),
        ("AB12 AT61 1904 3002 3457 3201 EUR 50", "iban", "AT61 1904 3002 3457 3201"),
        ("NO93 8601 1117 947 NOK", "iban", "NO93 8601 1117 947"),
    ],
)
def test_pii_finds_validated_numbers_among_others(text, kind, value):
    f = pii.Feistel(b"key")
    out, found = pii.pseudonymised(text, f)
    assert found[kind] == 1 and value not in out and pii.MAKERS[kind](value, f) in out


def test_pii_leaves_numbers_that_fail():
    f = pii.Feistel(b"key")
    for text in ("4111 1111 1111 1112 12", "AT61 1904 3002 3457 3202 EUR", "0000 0000 0000 0000 1", "x-4111111111111111", "4111111111111111.5", "41111111111111111111111"):
        assert pii.pseudonymised(text, f) == (text, {})


@pytest.mark.parametrize(
    ("text", "kind", "gone"),
    [
        ("write to 用户@例子.com now", "email", "用户"),
        ("jürgen.müller@straße.de", "email", "ü"),
        ("x" * 80 + "@example.org", "email", "x" * 16),
        ("born 25/12/1990, here", "date", "25/12/1990"),
        ("born 1990/12/25, here", "date", "1990/12/25"),
        ("am 25-12-1990 um", "date", "25-12-1990"),
        ("call 020 7946 0018 now", "phone", "7946"),
        ("call (030) 1234 5678", "phone", "1234 5678"),
        ("aws_secret_access_key        =        'abcdef123456'", "secret", "abcdef123456"),
        ("an-uncommonly-long-name-of-a-service-and-its-token: Zyxw9876543", "secret", "Zyxw9876543"),
    ],
)
def test_pii_of_other_forms(text, kind, gone):
    out, found = pii.pseudonymised(text, pii.Feistel(b"key"))
    assert found[kind] == 1 and gone not in out and len(out) == len(text)
    assert [c.isalnum() for c in out] == [c.isalnum() for c in text]


def test_pii_leaves_versions_and_prose():
    f = pii.Feistel(b"key")
    for text in ("version 1.2.3.4 of it", "v1.2.3.4", "12.13.14 and 30/30/1990", "the token: a word", "Password:\n\nAnother line", "@ home", "2:1 = two"):
        assert pii.pseudonymised(text, f) == (text, {})


def test_pii_dates_stay_linked_and_apart():
    f = pii.Feistel(b"key")
    forms = ("1990-12-25", "25.12.1990", "12/25/1990", "25/12/1990", "1990/12/25")
    days = {tuple(sorted(x.replace("/", "-").replace(".", "-").split("-"))) for x in (pii.date(t, f) for t in forms)}
    assert len(days) == 1
    every = [pii.date((datetime.date(1990, 1, 1) + datetime.timedelta(i)).strftime("%d/%m/%Y"), f) for i in range(366)]
    assert len(set(every)) == 366


def test_pii_leaves_no_planted_value_on_the_table(spark):
    """A plain search, place by place, finds none of the input's values in the output, and nothing else has changed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs, b"key").collect()}
    n = 0
    for r in docs.collect():
        values, new = brute.private(r["text"]), out[r["doc_id"]]["text"]
        n += len(values)
        assert all(v not in (new or "") for v in values), r["doc_id"]
        if not values:
            assert new == r["text"] and out[r["doc_id"]]["n_found"] == 0
    assert n > 50


def test_pii_key_comes_from_the_session(spark):
    held = spark.conf.get(pii.KEY_CONF, None)
    try:
        spark.conf.set(pii.KEY_CONF, "one")
        one = pii.session_key(spark)
        spark.conf.set(pii.KEY_CONF, "two")
        assert one != pii.session_key(spark)
        spark.conf.unset(pii.KEY_CONF)
        assert pii.session_key(spark) == pii.session_key(spark)
    finally:
        spark.conf.set(pii.KEY_CONF, held) if held else spark.conf.unset(pii.KEY_CONF)


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"key")
    for size in (1, 2, 7, 100, 1000):
        assert sorted(f.number("x", i, size) for i in range(size)) == list(range(size))
    assert len({f.symbols("s", f"{i:03d}") for i in range(1000)}) == 1000
    days = {pii.date((datetime.date(1999, 1, 1) + datetime.timedelta(i)).isoformat(), f) for i in range(800)}
    assert len(days) == 800 and all(datetime.date.fromisoformat(d) for d in days)
    assert pii.iban_rest(pii.iban("DE89370400440532013000", f)) == 1


def test_language_id(spark):
    texts = {"en": "the house and the garden with the old tree near the water", "de": "das haus und der garten mit dem alten baum nahe dem wasser"}
    rows = [(i, texts[k] + f" {w}", k) for i, (k, w) in enumerate([(k, w) for k in texts for w in "abcdefghij"])]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (103, "der alte garten", None), (None, "the old house", None), (104, LONG, None), (103, "der alte garten", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    r = {x["doc_id"]: x for x in langid.identify(df, langid.default_pieces()).collect()}
    assert [r[i]["lang_pred"] for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "de", "en"]
    assert all(r[i]["lang_pred"] == k for i, _, k in rows[:20]) and all(0 <= x["score"] <= 1 for x in r.values())
    assert langid.identify(df.limit(0), langid.default_pieces()).count() == 0
    assert {x["lang_pred"] for x in langid.identify(df.withColumn("lang", F.lit(None).cast("string")), langid.default_pieces()).collect()} == {"und"}


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.default_pieces()).withColumnRenamed("doc_id", "id")
    r = found.join(docs, found["id"] == docs["doc_id"]).where("held_out AND lang IS NOT NULL AND lang_pred != 'und'").select("lang", "lang_pred", "score").collect()
    assert len(r) > 200 and np.mean([x["lang"] == x["lang_pred"] for x in r]) > 0.98


def test_language_fit_equals_one_machine(spark):
    """The fit by tasks against the same rounds over all words at once."""
    rows = [("en", "the house and the garden"), ("de", "das haus und der garten"), ("en", "a house"), ("de", None), ("en", "x" * 3000)]
    langs, logp = langid.fit(spark.createDataFrame(rows, "lang string, text string").repartition(3), langid.default_pieces(), 2)
    counts = [{}, {}]
    for lang, text in rows:
        for w in langid.words_of(text or ""):
            own = counts[langs.index(lang)]
            own[w] = own.get(w, 0) + 1
    words = sorted(set(counts[0]) | set(counts[1]))
    weight = np.array([[c.get(w, 0) for c in counts] for w in words], float)
    size = langid.pieces(langid.default_pieces()).size + 1
    want = np.full((size, 2), -np.log(size))
    for _ in range(2):
        total = langid.Lattice(words, langid.pieces(langid.default_pieces())).expected(want, weight) + langid.PRIOR
        want = np.log(total) - np.log(total.sum(axis=0))
    assert langs == ["de", "en"] and np.allclose(logp, want)


def test_forward_sums_all_segmentations():
    vocabulary = langid.Pieces({p: i for i, p in enumerate(["a", "aa", "ab", "b", "▁", "▁a"])}, 2)
    p = np.full((7, 1), 0.1)

    def total(s):
        return 1.0 if not s else sum(0.1 * total(s[len(x) :]) for x in ["a", "aa", "ab", "b", "▁", "▁a"] if s.startswith(x))

    lattice = langid.Lattice(["aab", "b", "aaaa"], vocabulary)
    assert np.allclose(np.exp(lattice.totals(np.log(p)))[:, 0], [total("▁" + w) for w in ("aab", "b", "aaaa")])
    assert np.isclose(lattice.expected(np.log(p), np.ones((3, 1))).sum() > 3, True)


NAMES7 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("bound", [decontaminate.TERM_BYTES, 0])
def test_decontaminate(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "TERM_BYTES", bound)
    items = [(1, PROSE), (2, "old FRIENDS by"), (3, None), (4, "--"), (5, "words that never occur in any of these documents at all"), (6, "old friends by"), (7, "word5 OF5 word6 of6"), (8, "Lazy"), (9, "of of of")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit("clash"))
    # Rows of one id keep their own results.
    docs = [*DOCS, (3, "nothing here"), (1, "old friends by old friends by the lazy dog"), (21, "of of of of old lazy"), (None, PROSE)]
    got7 = got(decontaminate.contamination(frame(spark, docs), bench), *NAMES7)
    assert got7 == sorted(brute.leaks(docs, items), key=repr) and any(r[0] is None and r[2] for r in got7)
    few = bench.where("item_id IN (1, 5)")  # no item of one word
    assert got(decontaminate.contamination(frame(spark), few), *NAMES7) == sorted(brute.leaks(DOCS, [items[0], items[4]]), key=repr)
    clean = decontaminate.contamination(frame(spark), bench.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(DOCS)
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def test_decontaminate_of_frequent_words(spark):
    # A benchmark of a few words that stand everywhere: many windows share their rarest term.
    rng = np.random.default_rng(6)
    text = [" ".join(rng.choice(["a", "b", "c"], n)) for n in (80, 200, 3, 12, 40)]
    docs, items = [(i, t) for i, t in enumerate(text)], [(7, text[0][10:60]), (8, "a b a"), (9, "c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.contamination(frame(spark, docs), bench, 4), *NAMES7) == sorted(brute.leaks(docs, items, 4), key=repr)


def near_places(docs, items, slop, width):
    """{(doc_id, words of the window, pos)} and {doc_id: (windows, items)}, by trying all pairs of places."""
    words = [(i, brute.WORD.findall((t or "").translate(brute.AZ))) for i, t in docs]
    tf, whose = {}, {}
    for _, w in words:
        for x in w:
            tf[x] = tf.get(x, 0) + 1
    for item, t in items:
        w = brute.WORD.findall((t or "").translate(brute.AZ))
        for s in range(max(1, len(w) - width + 1) if w else 0):
            whose.setdefault(tuple(w[s : s + width]), set()).add(item)
    places = set()
    for win in whose:
        rare = sorted((tf[x], x, k) for k, x in enumerate(win) if x in tf)[:2]
        for i, w in words:
            for p, x in enumerate(w):
                if rare and x == rare[0][1] and (
                    len(win) == 1
                    or len(rare) == 2
                    and any(y == rare[1][1] and q != p and abs(q - p - rare[1][2] + rare[0][2]) <= slop for q, y in enumerate(w))
                ):
                    places.add((i, " ".join(win), p))
    near = {}
    for i, win, _ in places:
        near.setdefault(i, (set(), set()))
        near[i][0].add(win)
        near[i][1].update(whose[tuple(win.split(" "))])
    return places, {i: (len(a), len(b)) for i, (a, b) in near.items()}


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity_equals_all_pairs(spark, slop):
    rng = np.random.default_rng(slop)
    often = [f"w{k}" for k in range(8)]
    # A rare term next to ones far over RATIO times as frequent, absent terms, a word twice, one word.
    docs = [(i, " ".join(rng.choice([*often, "rare", "seldom"], 60, p=[0.12] * 8 + [0.01, 0.03]))) for i in range(30)]
    docs += [(None, "w1 rare w2"), (40, None), (41, "Seldom W3"), (42, "w0 w0"), (43, "w0")]
    items = [(1, "rare w1 w2"), (2, "absent w3 seldom missing w4"), (3, "seldom"), (4, "nowhere"), (5, "w0 x w0"), (6, " ".join([*often, "rare", *often])), (7, "rare w1 w2"), (8, None), (9, "gone w5")]
    want, per_doc = near_places(docs, items, slop, 4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, rows = decontaminate.proximity_matches(frame(spark, docs), bench, slop, 4)
    out = found.join(rows, "row").collect()
    wins = {r["win"]: " ".join(r["words"]) for r in decontaminate.windows(bench, 4).collect()}
    assert {(r["doc_id"], wins[r["win"]], r["pos"]) for r in out} == want and len(out) == len(want) > 100
    rows = got(decontaminate.proximity(frame(spark, docs), bench, slop, 4), "doc_id", "n_near", "n_near_items", "near")
    assert rows == sorted(((i, *per_doc.get(i, (0, 0)), i in per_doc) for i, _ in docs), key=repr)
    assert decontaminate.proximity(frame(spark, []), bench).count() == 0 and not decontaminate.proximity(frame(spark, docs), bench.limit(0)).where("near").count()


def test_decontaminate_is_native(spark):
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    plan = decontaminate.contamination(frame(spark), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_quality(spark):
    good = [(i, PROSE.replace("fox", f"fox{i}")) for i in range(60)]
    bad = [(100 + i, f"buy{i} !!! " * 20 + "NOW NOW NOW") for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(1, None)], "doc_id long, quality int")
    r = {x["doc_id"]: x for x in quality.quality_scores(frame(spark, [*good, *bad, *[d for d in DOCS if d[0] not in (1, 2, 3)]]), labels).collect()}
    assert np.mean([r[i]["predicted"] == 1 for i, _ in good]) > 0.95 and np.mean([r[i]["predicted"] == 0 for i, _ in bad if i in r]) > 0.95
    assert all(0 <= x["score"] <= 1 for x in r.values())
    assert quality.quality_scores(frame(spark, []), labels).count() == 0
    assert {x["score"] for x in quality.quality_scores(frame(spark), labels.limit(0)).collect()} == {0.5}
    assert {x["score"] for x in quality.quality_scores(frame(spark, good), labels.where("quality = 1")).collect()} == {1.0}


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_scores(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
    r = found.join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    y, p = np.array([x["quality"] for x in r]), np.array([x["score"] for x in r])
    assert len(r) > 50 and np.mean([x["predicted"] == x["quality"] for x in r]) > 0.9
    # Calibration: in bins of the score, the mean score is near the share of label 1.
    bins = np.minimum((p * 5).astype(int), 4)
    error = sum(abs(p[bins == k].mean() - y[bins == k].mean()) * (bins == k).mean() for k in range(5) if (bins == k).any())
    assert error < 0.1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>
<div class="ad">Buy this now, it is good.</div><article><h1>A  title</h1><p>First &amp; longest paragraph, with\n words; and more of them.<p><b>Open<br><p>Last.</p></article>
<div id="comments"><p>I liked this article very much, thank you for writing it.</p></div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "A title\n\nFirst & longest paragraph, with words; and more of them.\n\nOpen\n\nLast."
    assert html_text.main_text(PAGE) == want
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<html><body><p>Just text, alone.</p>"), (1, "u", PAGE), (None, "u", "<nav>x</nav>"), (6, "u", PAGE[:-60] * 3), (7, "u", "plain text without tags")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    r = [(x["page_id"], x["text"], x["n_chars"]) for x in html_text.extract(df).collect()]
    assert r.count((1, want, len(want))) == 2 and (2, "", 0) in r and (3, "", 0) in r and (5, "Just text, alone.", 17) in r and (None, "", 0) in r
    assert html_text.extract(df.limit(0)).count() == 0


def paragraphs(*sizes):
    """Paragraphs of so many sentences, as blocks and as marked up."""
    texts = [" ".join(f"Part {i} has, in its sentence {k}, some words to read." for k in range(n)) for i, n in enumerate(sizes)]
    return texts, [f"<p>{t}</p>" for t in texts]


def blocks_of(page):
    return html_text.main_text(page).split("\n\n")


def test_html_keeps_nested_and_sibling_containers():
    (lead, a, b, c), (lead_p, a_p, b_p, c_p) = paragraphs(7, 5, 5, 3)
    nav, end = "<html><body><nav><a href=x>Home</a></nav>", "<footer>me</footer></body></html>"
    page = f"{nav}<article><h1>A title</h1><div class=lead>{lead_p}</div><div class=text>{a_p}{b_p}{c_p}</div></article>{end}"
    assert blocks_of(page) == ["A title", lead, a, b, c]
    page = f"{nav}<div id=page><h1>A title</h1><section><h2>One</h2>{a_p}{b_p}{c_p}</section><section><h2>Two</h2>{lead_p}</section></div>{end}"
    assert blocks_of(page) == ["A title", "One", a, b, c, "Two", lead]
    page = f"{nav}<h1>A title</h1><table><tr><td>{a_p}{b_p}{c_p}</td></tr><tr><td>{lead_p}</td></tr></table>{end}"
    assert blocks_of(page) == ["A title", a, b, c, lead]
    page = f"{nav}<h1><b>A title</b></h1><div>{a_p}{b_p}</div><div class=ad>{c_p}</div>{end}"
    assert blocks_of(page) == ["A title", a, b]


@pytest.mark.parametrize(
    "mark", ["id=page class='with-sidebar'", "class='post no-comments'", "class='content social-on'", "class=notice", "id=search class='page'", "role=search"]
)
def test_html_names_do_not_veto_the_page(mark):
    (a, b, c), (a_p, b_p, c_p) = paragraphs(3, 5, 4)
    page = f"<html><body><nav>x</nav><div {mark}><div class='entry-header'><h1>A title</h1></div>{a_p}<p><span class=notice>Note:</span> {b}</p>{c_p}<div class=comments><p>I liked this.</p></div></div></body></html>"
    assert blocks_of(page) == ["A title", a, "Note: " + b, c]
    page = f"<html><body><div class=notice>{a_p}{b_p}</div><div class=search>{b_p}{a_p}</div></body></html>"
    assert blocks_of(page) == [a, b, b, a]
    page = f"<html><body><article><h1>A title</h1>{c_p}</article><div id=comments>{b_p}{a_p}{b_p}</div></body></html>"
    assert blocks_of(page) == ["A title", c]


@pytest.mark.parametrize(
    ("inner", "said"),
    [
        ("<svg class=x />", ""), ("<svg>", ""), ("<svg><path d='M0'></svg>", ""), ("<svg><text>T</text></svg>", ""), ("<math/>", ""), ("<noscript>", ""), ("<object data=x>", ""), ("<template>", ""), ("<noscript>N</noscript>", "N"), ("<object data=x>O</object>", "O"), ("<textarea>T</textarea>", ""),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"), ("<math><mi>y</mi>", "y"), ("<script>var a = '<p>';</script>", ""), ("<style>p{}</style>", ""),
    ],
)
def test_html_reads_on_after_raw_elements(inner, said):
    (a, b, c), (a_p, b_p, c_p) = paragraphs(3, 5, 4)
    page = f"<html><body><article><h1>A title</h1>{a_p}<p>Here {inner} {b}</p>{c_p}</article></body></html>"
    assert blocks_of(page) == ["A title", a, " ".join(filter(None, ("Here", said, b))), c]


def test_html_is_linear_in_depth():
    import time

    def seconds(n):
        start = time.perf_counter()
        assert html_text.main_text("<div>" * n + "<p>Some words, to read.</p>" + "</div>" * n) == "Some words, to read."
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 40 * min(seconds(2000) for _ in range(3))


def test_html_equals_a_plain_reader_on_the_table(spark):
    """Pages of the table hold their text in one <article>; the library's parser reads it."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    r = {x["page_id"]: (x["text"], x["n_chars"]) for x in html_text.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    want = {i: brute.article(h) for i, h in zip(pages.page_id, pages.html)}
    assert {i: t for i, (t, _) in r.items()} == want and all(n == len(t) for t, n in r.values())


@pytest.mark.parametrize(("hot", "bound"), [(1 << 17, 1 << 20), (1, 0), (30, 0)])
def test_line_dedup(spark, monkeypatch, hot, bound):
    monkeypatch.setattr(line_dedup, "HIT_BYTES", bound)
    rows = [*DOCS, *((100 + i, f"line {i // 4}\nLINE {i % 3} \n\n own {i}") for i in range(40)), (None, None), (None, "line 1\nline 1")]
    want = sorted(brute.lines(rows, 3), key=repr)
    out = line_dedup.line_dedup(frame(spark, rows), min_docs=3, shard_keys=2, hot_keys=hot)
    assert got(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert sum(w[2] for w in want) > 40
    assert line_dedup.line_dedup(frame(spark, []), hot_keys=hot).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    h1, h2 = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    counts = np.arange(5000)
    p = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(h1, h2, counts, np.uint64, 5000).dump())
    assert (p.count(h1, h2) == counts).all() and len(p.counts) == 5000
    assert p.count(h1 ^ np.uint64(1), h2 ^ np.uint64(5)).sum() == 0
    small = line_dedup.PerfectHash.build(h1, h2, counts)
    assert (small.count(h1, h2) == np.minimum(counts, 255)).all() and len(small.dump()) < 4 * 5000

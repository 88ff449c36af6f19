"""Benchmark decontamination over a positional inverted index, DataFrame functions only.

A window is a run of ``width`` consecutive words of a benchmark item (an item
with fewer words, but not none, is one window).  The index is made of postings
(term, row, pos) of the corpus.

Phrases: a term is a word with the word after it, so that the lists of frequent words
are cut to where they stand as in the benchmark; an item of one word has that word as
its term.  The text is read once, and postings of all the benchmark's terms are stored.
Each window starts from the list of its rarest term, moved back by the term's place in
the window; the second rarest list is intersected with it, then all others at once.  A
window occurs where every one of its terms has a posting at its place: nothing but the
index is asked.

Proximity: terms are words; the lists of a window's two rarest words that the corpus
has are intersected with slack.

Postings carry a row number of their own, fixed by being written, so rows of one
doc_id keep their own results.  Benchmark tables (terms, rarest terms) are broadcast
where they, measured first, take at most ``TERM_BYTES``; beyond that the postings are
dealt by term and by ``SALTS`` salts of the row, so a frequent term is work for many tasks.

Words: A-Z are lower-cased, then maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
Cases: a null or empty text has no words; items without words have no window;
equal windows of several items count for each of them; very long texts are postings
like any other; ties between equally rare terms go to the term that sorts first, then to
the first place; repeated rows get a result each, null ids too; an empty benchmark leaves
every document clean; an empty corpus gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklode.llm.shared import fits, staged

WIDTH = 10
#: The most that a table of the benchmark may take to be broadcast.
TERM_BYTES = 16 << 20
#: Ways that the postings of a term are dealt beyond that.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands once in every row, for its id and length; no word is empty.
END = ""


def words(text: Column) -> Column:
    """The words of a text as an array, case kept; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != F.lit(""))


def folded(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """items(item_id, text) -> win, words, n, items: each distinct window once."""
    held = items.select("item_id", words(folded(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = held.select(
        "item_id",
        "w",
        F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("start"),
    )
    return (
        starts.select("item_id", F.slice("w", F.col("start"), F.lit(width)).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("items"))
        .select(F.sha2(F.array_join("words", " "), 256).alias("win"), "words", F.size("words").alias("n"), "items")
    )


def pair_places(wins: DataFrame) -> DataFrame:
    """win, place, first, second: the words of each window with the next; a lone word has no second."""
    w = F.col("words")
    pairs = F.arrays_zip(w.alias("first"), F.slice(w, F.lit(2), F.size(w)).alias("second"))
    rows = wins.select("win", "n", F.posexplode(pairs).alias("place", "p"))
    return rows.select("win", "n", "place", F.col("p")["first"].alias("first"), F.col("p")["second"].alias("second")).where("second IS NOT NULL OR n = 1")


def term_of(first: Column, second: Column) -> Column:
    return F.concat_ws(" ", first, second)


def met(postings: DataFrame, table: DataFrame, on: list[str], how: str, salt_by: str) -> DataFrame:
    """Postings joined with a table of the benchmark: broadcast if that fits, else dealt by salt too."""
    if fits(table, TERM_BYTES):
        return postings.join(F.broadcast(table), on, how)
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).join(copies, [*on, "salt"], how).drop("salt")


def pair_postings(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The index of the benchmark's terms: row, pos, term, doc_id; the END row's pos is the row's number of words.

    doc_id stands in END rows only.
    """
    low = places.select(F.lower("first").alias("la"), F.coalesce(F.lower("second"), F.lit(END)).alias("lb"))
    sieve = staged(low.union(docs.sparkSession.createDataFrame([(END, END)], "la string, lb string")).distinct(), "bench-terms")
    lone = not places.where("second IS NULL").isEmpty()
    held = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    w = F.col("w")
    pairs = F.transform(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    rows = held.select("row", "doc_id", F.size("w").alias("n"), F.posexplode(F.concat(pairs, F.array(F.struct(F.lit(END).alias("a"), F.lit(END).alias("b"))))).alias("pos", "p"))
    rows = rows.select("row", "doc_id", "n", "pos", F.col("p")["a"].alias("a"), F.col("p")["b"].alias("b"))
    if lone:  # words by themselves are terms too
        alone = F.when(F.col("a") != END, F.array("b", F.lit(END))).otherwise(F.array("b"))
        rows = rows.withColumn("b", F.explode(alone))
    # lower() agrees with A-Z folding as a first sieve, and costs less.
    found = met(rows.withColumn("la", F.lower("a")).withColumn("lb", F.lower("b")), sieve, ["la", "lb"], "left_semi", "row")
    last = F.col("a") == END
    term = F.when(last, F.lit(END)).otherwise(term_of(folded(F.col("a")), F.when(F.col("b") != END, folded(F.col("b")))))
    return found.select("row", F.when(last, F.col("n")).otherwise(F.col("pos")).alias("pos"), term.alias("term"), F.when(last, F.col("doc_id")).alias("doc_id"))


def ranked_terms(index: DataFrame, places: DataFrame) -> DataFrame:
    """win, n, place, term, rank from the rarest; a window with a term that the corpus lacks can't occur, and goes."""
    terms = places.select("win", "n", "place", term_of(F.col("first"), F.col("second")).alias("term"))
    counts = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("tf"))
    seen = terms.join(counts, "term", "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy("tf", "term", "place")))
    return ranked.withColumn("least", F.min("tf").over(Window.partitionBy("win"))).where("least > 0").select("win", "n", "place", "term", "rank")


def phrase_matches(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Where windows occur, by the index alone: row, start, win, n."""
    postings = index.where(F.col("term") != END).select("row", "pos", "term")

    def places(low: int, high: int) -> DataFrame:
        asked = ranked.where(F.col("rank").between(low, high)).groupBy("win").agg(F.collect_list(F.struct("place", "term")).alias("asked"))
        return asked

    rarest = ranked.where("rank = 1").select("win", "n", "place", "term")
    out = met(postings, rarest, ["term"], "inner", "row").select("row", (F.col("pos") - F.col("place")).alias("start"), "win", "n").where("start >= 0")
    for low, high in ((2, 2), (3, 1 << 30)):
        # Each start asks for the postings that these terms need; those without more terms are through.
        due = met(out, places(low, high), ["win"], "left", "row")
        done = due.where("asked IS NULL").select("row", "start", "win", "n")
        need = due.where("asked IS NOT NULL").select("row", "start", "win", "n", F.size("asked").alias("due"), F.explode("asked").alias("t"))
        need = need.select("row", "start", "win", "n", "due", F.col("t")["term"].alias("term"), (F.col("start") + F.col("t")["place"]).alias("pos"))
        got = need.join(postings, ["row", "pos", "term"]).groupBy("row", "start", "win", "n", "due").agg(F.count("*").alias("got"))
        out = staged(got.where("got = due").select("row", "start", "win", "n").unionByName(done), f"intersected-{low}")
    return out


def word_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index of ``terms``(term), words: row, pos, term, doc_id, with END rows as above."""
    marked = terms.union(docs.sparkSession.createDataFrame([(END,)], "term string"))
    sieve = staged(marked.select(F.lower("term").alias("low")).distinct(), "bench-words")
    held = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(words(F.col("text")), F.array(F.lit(END))).alias("w"))
    held = held.select("row", "doc_id", F.posexplode("w").alias("pos", "raw"))
    found = met(held.withColumn("low", F.lower("raw")), sieve, ["low"], "left_semi", "row")
    return found.select("row", "pos", folded(F.col("raw")).alias("term"), F.when(F.col("raw") == END, F.col("doc_id")).alias("doc_id"))


def rarest_pairs(index: DataFrame, wins: DataFrame) -> DataFrame:
    """Each window's two rarest words that the corpus has: win, term, place, term2, place2.

    Other words may be missing there.  A window of one word has no second; a
    longer one with fewer than two present words has no proximity, and goes.
    """
    counts = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("tf"))
    present = wins.select("win", F.posexplode("words").alias("place", "term")).join(counts, "term")
    two = present.groupBy("win").agg(F.slice(F.array_sort(F.collect_list(F.struct("tf", "term", "place"))), 1, 2).alias("t"))
    held = two.join(wins.select("win", "n"), "win").where((F.size("t") == 2) | (F.col("n") == 1))
    one, other = F.col("t")[0], F.get("t", F.lit(1))
    return held.select("win", one["term"].alias("term"), one["place"].alias("place"), other["term"].alias("term2"), other["place"].alias("place2"))


def near_places(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """Places where a window's two rarest words stand within ``slop`` of their distance: row, win, pos (of the rarest).

    Looser than a phrase: other words may differ.  A window of one word matches where
    the word stands.  Each posting meets the other list through blocks of
    ``2 * slop + 1`` positions, of which it reaches two at most, so no all-pairs join arises.
    """
    postings = index.where(F.col("term") != END).select("row", "pos", "term")
    want = met(postings, pairs, ["term"], "inner", "row")
    single = want.where("term2 IS NULL").select("row", "win", "pos")
    due = want.where("term2 IS NOT NULL").select("row", "win", "pos", "term2", (F.col("pos") + F.col("place2") - F.col("place")).alias("due"))
    wide = 2 * slop + 1
    ends = F.array_distinct(F.array(F.floor((F.col("due") - slop) / wide), F.floor((F.col("due") + slop) / wide)))
    due = due.withColumn("block", F.explode(ends)).alias("d")
    other = postings.withColumn("block", F.floor(F.col("pos") / wide)).alias("o")
    hits = due.join(
        other,
        (F.col("d.term2") == F.col("o.term"))
        & (F.col("d.block") == F.col("o.block"))
        & (F.col("d.row") == F.col("o.row"))
        & (F.abs(F.col("o.pos") - F.col("d.due")) <= slop)
        & (F.col("o.pos") != F.col("d.pos")),  # a word isn't its own neighbour
        "left_semi",
    )
    return hits.select("row", "win", "pos").union(single).distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 3, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Near places (row, win, pos, items) and rows (row, doc_id)."""
    wins = staged(windows(items, width), "bench-windows")
    vocabulary = wins.select(F.explode("words").alias("term")).distinct()
    index = staged(word_postings(docs, vocabulary), "word-postings")
    pairs = staged(rarest_pairs(index, wins), "rarest-pairs")
    found = near_places(index, pairs, slop).join(wins.select("win", "items"), "win")
    return found.select("row", "win", "pos", "items"), index.where(F.col("term") == END).select("row", "doc_id")


def proximity(docs: DataFrame, items: DataFrame, slop: int = 3, width: int = WIDTH) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> one row per document: doc_id, n_near (windows near some place), n_near_items, near."""
    places, rows = proximity_matches(docs.select("doc_id", "text"), items, slop, width)
    # One row a document and window, so that items aren't repeated for every place.
    near = staged(places.groupBy("row", "win").agg(F.first("items").alias("items")), "proximity-windows")
    n_windows = near.groupBy("row").agg(F.count("*").alias("n_near"))
    n_items = near.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.count("*").alias("n_near_items"))
    n = F.coalesce("n_near", F.lit(0))
    out = rows.join(n_windows, "row", "left").join(n_items, "row", "left")
    return out.select("doc_id", n.alias("n_near"), F.coalesce("n_near_items", F.lit(0)).alias("n_near_items"), (n > 0).alias("near"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> one row per document.

    doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256,
    contaminated.
    """
    wins = staged(windows(items, width), "bench-windows")
    places = pair_places(wins)
    index = staged(pair_postings(docs.select("doc_id", "text"), places), "postings")
    ranked = staged(ranked_terms(index, places), "ranked-terms")
    found = phrase_matches(index, ranked)
    # Words covered: each run adds what lies beyond the furthest end so far.
    runs = found.groupBy("row", "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    reach = F.coalesce(F.max(end).over(before), F.lit(0))
    fresh = runs.withColumn("fresh", F.greatest(end - F.greatest("start", reach), F.lit(0)))
    hits = fresh.groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    ids = (
        found.select("row", "win")
        .distinct()
        .join(wins.select("win", "items"), "win")
        .select("row", F.explode("items").alias("item"))
        .distinct()
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("ids"))
    )
    none = F.sha2(F.lit(""), 256)
    rows = index.where(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(hits, "row", "left").join(ids, "row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("ids", ","), 256), none).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items.select("item_id", "text"))


def op7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return proximity(docs, items.select("item_id", "text"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
), hit AS (
  SELECT DISTINCT doc_id, s, n, item_id FROM occ JOIN win USING (n, phrase)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

PROXIMITY_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, w[s:s + 9] AS terms
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
), tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
tf AS (SELECT term, count(*) AS tf FROM tok GROUP BY term),
ranked AS (
  SELECT terms, term, place, row_number() OVER (PARTITION BY terms ORDER BY tf, term, place) AS r
  FROM (SELECT terms, unnest(terms) AS term, generate_subscripts(terms, 1) AS place FROM (SELECT DISTINCT terms FROM win)) JOIN tf USING (term)
), pair AS (
  SELECT x.terms, x.term AS t1, y.term AS t2, y.place - x.place AS away
  FROM ranked x LEFT JOIN ranked y ON x.terms = y.terms AND y.r = 2 WHERE x.r = 1 AND (y.r = 2 OR len(x.terms) = 1)
), near AS (
  SELECT a.doc_id, p.terms FROM tok a JOIN pair p ON a.term = p.t1 WHERE p.t2 IS NULL
  UNION
  SELECT a.doc_id, p.terms FROM pair p JOIN tok a ON a.term = p.t1 JOIN tok b ON b.doc_id = a.doc_id AND b.term = p.t2
  WHERE a.pos <> b.pos AND abs(b.pos - a.pos - p.away) <= 3
), n AS (SELECT doc_id, count(DISTINCT terms) AS n_near FROM near GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM near JOIN win USING (terms) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_near, 0) AS n_near, coalesce(n_near_items, 0) AS n_near_items, coalesce(n_near, 0) > 0 AS near
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

QUERIES = {"op7_decontaminate": op7_decontaminate, "op7_proximity": op7_proximity}
ORACLE = {"op7_decontaminate": OP7_SQL, "op7_proximity": PROXIMITY_SQL}

"""Language ID by unigram piece models that sum over all segmentations.

The pieces are those of a fixed public vocabulary.  For each language, piece
probabilities are fitted by expectation maximisation: the forward-backward pass
of a word gives the expected number of times each piece is used over all of its
segmentations.  A text's score under a language is the sum of its words' log
probabilities, each found by the forward algorithm, so it is marginal over every
segmentation; pieces never cross a word.

Fitting uses at most ``per_lang`` labelled rows per language (those with the
smallest hash of their id), whatever their length.  Their words are counted and every
round of expectation maximisation is run by tasks; the driver gets sums by piece and
language, never texts.  The model is a table of pieces by languages, whose size the
vocabulary bounds; it is broadcast.  Prediction is a map over whole texts with a
bounded memo of words.

Cases: a text that is null or has no letter gets ``und`` and score 0; without
labelled rows every text does; ties go to the language that sorts first; a row
with a null id isn't held out and is never learned from; a very long text is one row
like any other, and a very long word takes time in proportion; repeated rows are
predicted each, and learned from each if their id is chosen; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklode.llm.shared import fits, staged

PER_LANG = 500
#: Groups by hash of the id in which a language's rows are chosen first.
SALTS = 64
ROUNDS = 4
#: Added to the expected count of every piece.
PRIOR = 0.05
MEMO = 200_000
#: The most that the chosen ids may take to be broadcast.
ID_BYTES = 4 << 20
UNDEFINED = "und"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """Pieces of letters, numbered in order.

    The last number, one past the pieces, stands for a character without a piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    found = {p: i for i, p in enumerate(sorted({p for p in plain if p.strip("▁").isalpha() or p == "▁"}))}
    return Pieces(found, max(map(len, found)))


class Pieces:
    """The vocabulary as sorted hashes of all prefixes of pieces, by length."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ids: dict[str, int], longest: int) -> None:
        self.size, self.tables = len(ids), []
        for n in range(1, longest + 1):
            at: dict[str, int] = {}
            for p, i in ids.items():
                if len(p) >= n:
                    at[p[:n]] = max(i if len(p) == n else -1, at.get(p[:n], -1))
            codes = np.frombuffer("".join(at).encode("utf-32-le"), np.uint32).reshape(-1, n)
            h = np.zeros(len(codes), np.uint64)
            for k in range(n):
                h = h * self.BASE + codes[:, k] + np.uint64(1)
            order = np.argsort(h)
            self.tables.append((h[order], np.array(list(at.values()), np.int64)[order]))

    def edges(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of every piece in ``codes``; room: characters left in the word."""
        places, lengths, pieces_ = [], [], []
        left, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        lone = np.ones(len(codes), bool)  # characters that are no piece
        for n, (hashes, ids) in enumerate(self.tables, 1):
            fits = room[left] >= n
            left, h = left[fits], h[fits]
            if not len(left):
                break
            h = h * self.BASE + codes[left + n - 1] + np.uint64(1)
            slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            alive = hashes[slot] == h
            left, h, slot = left[alive], h[alive], slot[alive]
            piece = ids[slot]
            whole = piece >= 0
            places.append(left[whole]), pieces_.append(piece[whole])
            lengths.append(np.full(int(whole.sum()), n))
            if n == 1:
                lone[left[whole]] = False
        rest = np.flatnonzero(lone)  # every position stays reachable
        places.append(rest), pieces_.append(np.full(len(rest), self.size)), lengths.append(np.ones(len(rest), np.int64))
        return np.concatenate(places), np.concatenate(lengths), np.concatenate(pieces_)


class Lattice:
    """All segmentations of a batch of words, as edges between character positions."""

    def __init__(self, words: list[str], vocabulary: Pieces) -> None:
        codes = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.concatenate(([0], np.cumsum(chars)))
        owner = np.repeat(np.arange(len(words)), chars)
        place, length, piece = vocabulary.edges(codes, begin[owner + 1] - np.arange(len(codes)))
        who = owner[place]
        start = place - begin[who]
        stop = start + length
        self.sizes = np.array([len(w) + 2 for w in words], np.int64)  # nodes: before "▁", after it, after each character
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))
        order = np.lexsort((who, stop))
        self.who, self.piece = who[order], piece[order]
        self.start, self.stop = start[order], stop[order]
        self.head, self.tail = self.base[self.who] + self.start, self.base[self.who] + self.stop
        self.first, self.last = self.base[:-1], self.base[1:] - 1

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """log of the sum over all ways to reach each node, by language."""
        alpha = np.full((self.base[-1], logp.shape[1]), -np.inf)
        alpha[self.first] = 0.0
        cuts = np.flatnonzero(np.diff(self.stop)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(self.stop)]):
            if lo == hi:
                continue
            value = alpha[self.head[lo:hi]] + logp[self.piece[lo:hi]]
            tails = self.tail[lo:hi]
            group = np.concatenate(([0], np.flatnonzero(np.diff(tails)) + 1))
            alpha[tails[group]] = np.logaddexp.reduceat(value, group, axis=0)
        return alpha

    def totals(self, logp: np.ndarray) -> np.ndarray:
        return self.forward(logp)[self.last]

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language; weight: words by languages."""
        alpha = self.forward(logp)
        beta = np.full_like(alpha, -np.inf)
        beta[self.last] = 0.0
        order = np.lexsort((self.who, -self.start))
        head, tail, piece, start = self.head[order], self.tail[order], self.piece[order], self.start[order]
        cuts = np.flatnonzero(np.diff(start)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(start)]):
            if lo == hi:
                continue
            value = beta[tail[lo:hi]] + logp[piece[lo:hi]]
            heads = head[lo:hi]
            group = np.concatenate(([0], np.flatnonzero(np.diff(heads)) + 1))
            beta[heads[group]] = np.logaddexp.reduceat(value, group, axis=0)
        post = np.exp(alpha[self.head] + logp[self.piece] + beta[self.tail] - alpha[self.last][self.who])
        post *= weight[self.who]
        return np.stack([np.bincount(self.piece, post[:, k], minlength=len(logp)) for k in range(logp.shape[1])], axis=1)


def words_of(text: str) -> list[str]:
    return LETTERS(text.lower())


def word_counts(rows: DataFrame) -> DataFrame:
    """rows(lang, text) -> lang, word, n."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((lang, w) for w in words_of(text or ""))
            langs, words = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    return rows.select("lang", "text").mapInArrow(emit, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_uses(counts: DataFrame, langs: list[str], logp: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece by language over all counted words, summed by Spark."""
    model = counts.sparkSession.sparkContext.broadcast((langs, logp))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        number = {x: i for i, x in enumerate(names)}
        total = np.zeros(table.shape)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            words, n = batch.column(1).to_pylist(), np.asarray(batch.column(2), float)
            weight = np.zeros((len(words), len(names)))
            weight[np.arange(len(words)), lang] = n
            for at in range(0, len(words), 10_000):
                total += Lattice(words[at : at + 10_000], pieces(path)).expected(table, weight[at : at + 10_000])
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "uses"])

    # At most one row a piece and language.
    found = counts.mapInArrow(emit, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
    model.destroy()
    out = np.zeros(logp.shape)
    out[found["piece"].to_numpy(int), found["lang"].to_numpy(int)] = found["uses"]
    return out


def fit(rows: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """rows(lang, text) -> languages and log probabilities, pieces by languages."""
    counts = staged(word_counts(rows), "word-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    size = pieces(path).size + 1
    logp = np.full((size, len(langs)), -np.log(size))
    for _ in range(rounds if langs else 0):
        total = expected_uses(counts, langs, logp, path) + PRIOR
        logp = np.log(total) - np.log(total.sum(axis=0))
    return langs, logp


class Scorer:
    """Scores texts; remembers the log probabilities of white-space chunks."""

    def __init__(self, langs: list[str], logp: np.ndarray, path: str) -> None:
        self.langs, self.logp, self.vocabulary = langs, logp, pieces(path)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(langs) + 1), np.float32)
        self.words: dict[str, int] = {}
        self.values = np.zeros((0, len(langs)), np.float32)

    def learn(self, chunks: set[str]) -> None:
        """Rows of new chunks: log probability by language, and the number of words."""
        if len(self.rows) + len(chunks) > MEMO:
            self.rows, self.table = {}, self.table[:0]
        new = [c for c in chunks if c not in self.rows]
        parts = [words_of(c) for c in new]
        if len(self.words) > MEMO:
            self.words, self.values = {}, self.values[:0]
        unseen = list({w for p in parts for w in p} - self.words.keys())
        totals = [self.values]
        for at in range(0, len(unseen), 20_000):
            totals.append(Lattice(unseen[at : at + 20_000], self.vocabulary).totals(self.logp).astype(np.float32))
        self.words.update(zip(unseen, range(len(self.values), len(self.values) + len(unseen))))
        self.values = np.vstack(totals)
        owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
        used = np.fromiter((self.words[w] for p in parts for w in p), np.int64, len(owner))
        rows = np.stack([np.bincount(owner, self.values[used, k], minlength=len(new)) for k in range(len(self.langs))] + [np.bincount(owner, minlength=len(new))], axis=1)
        start = len(self.table)
        self.table = np.vstack([self.table, rows.astype(np.float32)])
        self.rows.update(zip(new, range(start, start + len(new))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        if not self.langs:
            return [UNDEFINED] * len(texts), [0.0] * len(texts)
        for at in range(0, len(texts), 256):
            chunks = [(t or "").split() for t in texts[at : at + 256]]
            fresh = set().union(*map(set, chunks)) - self.rows.keys()
            if fresh:
                if len(self.rows) + len(fresh) > MEMO:
                    fresh = set().union(*map(set, chunks))
                self.learn(fresh)
            for own in chunks:
                total = self.table[np.fromiter(map(self.rows.__getitem__, own), np.int64, len(own))].sum(axis=0, dtype=float)
                if not total[-1]:
                    langs.append(UNDEFINED), scores.append(0.0)
                    continue
                # Words aren't independent: the evidence grows as the root of their number.
                x = total[:-1] / np.sqrt(total[-1])
                p = np.exp(x - x.max())
                langs.append(self.langs[int(p.argmax())]), scores.append(float(p.max() / p.sum()))
        return langs, scores


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, held_out: Column, per_lang: int) -> DataFrame:
    """lang, text of at most ``per_lang`` ids of each language, labelled and not held out.

    A language's rows are ranked in groups by hash of their id first, so that one
    language may hold most of the corpus.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    chosen = usable.withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for groups in (("lang", "salt"), ("lang",)):
        order = Window.partitionBy(*groups).orderBy("h", "doc_id")
        chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    chosen = staged(chosen.select("lang", "doc_id").distinct(), "chosen-rows")
    keep = F.broadcast(chosen) if fits(chosen, ID_BYTES) else chosen
    return docs.select("lang", "doc_id", "text").join(keep, ["lang", "doc_id"], "left_semi")


def identify(docs: DataFrame, path: str, folds: int = 3, held: int = 1, per_lang: int = PER_LANG) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    held_out = F.coalesce(id_fold(F.col("doc_id"), folds) == held, F.lit(False))
    langs, logp = fit(training_rows(docs, held_out, per_lang), path)
    model = docs.sparkSession.sparkContext.broadcast((langs, logp.astype(np.float32)))
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        scorer = Scorer(names, table.astype(np.float64), path)
        for batch in batches:
            found, scores = scorer.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], schema.names
            )

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, schema)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, default_pieces())


QUERIES = {"op6_language_id": op6_language_id}
ORACLE: dict[str, str] = {}

"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word and every word shape owns a sparse ternary index vector drawn from its
hash.  A word's vector is the sum of the index vectors met within ``SPAN`` words of
it in the training sample, scaled to length one.  A document is pooled: the mean of
its word vectors, the mean of its shapes' index vectors, and how often words repeat
near by, at several distances.  A two-layer network (numpy, Adam) is trained on
the pooled vectors; its logit is divided by a temperature fitted on training rows
that the network hasn't seen.

Fitting uses at most ``sample`` labelled rows (those with the smallest hash of
their id), whatever their length.  Word vectors are summed, and the sample's documents
pooled, by tasks; the driver gets at most ``WORDS`` word vectors and one pooled vector a
sampled row, never texts, and trains the network on them.  The model's size is fixed by
its constants; it is broadcast.  Scoring is a map over whole texts.

Cases: a null or empty text is scored as a document without words; a very long text is
pooled like any other; equal texts get equal scores; of several
labels of one doc_id the smallest counts; null labels are left out; without
labels, or with labels of one kind only, the score is the share of label 1 among
them (0.5 without any); a row with a null id is never learned from and isn't held
out; repeated rows are scored each; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklode.llm.shared import staged

SAMPLE = 8000
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
#: Buckets that words and shapes are hashed to; more words than buckets share vectors.
WORDS, SHAPES = 1 << 15, 1 << 11
DIM, NONZERO, SPAN, HIDDEN = 48, 4, 2, 32
#: Distances at which a repeated word is noted.
AGAIN = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
MEMO = 300_000

RUN = regex.compile(r"(.)\1+")
LETTER = regex.compile(r"\p{L}+")


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse ternary index vectors."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    rows = np.arange(n)[:, None]
    out[rows, rng.integers(0, DIM, (n, NONZERO))] = rng.choice(np.array([-1, 1], np.float32), (n, NONZERO))
    return out


WORD_INDEX, SHAPE_INDEX = index_vectors(WORDS, 1), index_vectors(SHAPES, 2)


def shape(chunk: str) -> str:
    """Letters by case, digits, and the rest as it is, runs cut to one or two."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in chunk)
    return RUN.sub(lambda m: m[1] if m[1] in "Aa9" else m[1] * 2, kinds)


class Tokens:
    """Maps white-space chunks to (word bucket, shape bucket), with a bounded memo."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def new(self, chunk: str) -> int:
        word = "".join(LETTER.findall(chunk.lower())) or chunk
        code = (zlib.crc32(word.encode("utf-8", "replace")) % WORDS) * SHAPES + zlib.crc32(shape(chunk).encode("utf-8", "replace")) % SHAPES
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[chunk] = code
        return code

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        get, new = self.memo.get, self.new
        codes = np.array([c if (c := get(x)) is not None else new(x) for x in (text or "").split()], np.int64)
        return codes // SHAPES, codes % SHAPES


def summed_vectors(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of the index vectors near each word."""
    out = np.zeros((WORDS, DIM), np.float64)
    for words, shapes in docs:
        if not len(words):
            continue
        own = WORD_INDEX[words] + SHAPE_INDEX[shapes]
        near = np.zeros_like(own)
        for d in range(1, SPAN + 1):
            near[d:] += own[:-d]
            near[:-d] += own[d:]
        order = np.argsort(words, kind="stable")
        starts = np.flatnonzero(np.diff(words[order], prepend=-1))
        out[words[order][starts]] += np.add.reduceat(near[order], starts, axis=0)
    return out


def word_vectors(rows: DataFrame) -> np.ndarray:
    """rows(text) -> the vector of every word bucket, scaled to length one.

    Sums are of whole numbers, so their order doesn't matter.
    """
    names = [f"v{i}" for i in range(DIM)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = Tokens(), np.zeros((WORDS, DIM))
        for batch in batches:
            for x in batch.column(0):
                total += summed_vectors([tokens(x.as_py())])
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, i]) for i in range(DIM))], ["word", *names])

    schema = "word long, " + ", ".join(f"{n} double" for n in names)
    sums = rows.select("text").mapInArrow(emit, schema).groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # at most WORDS rows
    out = np.zeros((WORDS, DIM), np.float32)
    out[sums["word"].to_numpy(int)] = sums[names].to_numpy(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pooled(words: np.ndarray, shapes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The vector of a document."""
    out = np.zeros(2 * DIM + len(AGAIN) + 2, np.float32)
    n = len(words)
    if n:
        out[:DIM] = vectors[words].mean(axis=0)
        out[DIM : 2 * DIM] = SHAPE_INDEX[shapes].mean(axis=0)
        for k, d in enumerate(AGAIN):
            out[2 * DIM + k] = (words[d:] == words[:-d]).mean() if n > d else 0.0
        out[-2] = len(np.unique(words)) / n
    out[-1] = np.log1p(n)
    return out


class Network:
    """relu layer, then one logit; trained by Adam on the whole sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 400, rate: float = 0.01, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(0)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.std
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, epochs + 1):
            h = np.maximum(x @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
            gh = np.outer(g, p[2]) * (h > 0)
            for i, grad in enumerate((x.T @ gh + decay * p[0], gh.sum(axis=0), h.T @ g + decay * p[2], np.array([g.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        # Rows stay near what was seen, so a document unlike any other isn't scored by extrapolation.
        x = np.clip((x - self.mean) / self.std, -8, 8)
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on (x, y)."""
        logits = self.logits(x)

        def loss(t: float) -> float:
            p = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -30, 30))), 1e-6, 1 - 1e-6)
            return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

        self.temperature = min(np.geomspace(0.25, 16, 61), key=loss)


def pooled_rows(rows: DataFrame, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows(h, doc_id, text, quality), a bounded sample -> pooled vectors and labels, in order of h and id."""
    model = rows.sparkSession.sparkContext.broadcast(vectors)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            found = [pooled(*tokens(x.as_py()), model.value).tobytes() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.binary())], schema.names)

    schema = T.StructType([*(rows.schema[n] for n in ("h", "doc_id", "quality")), T.StructField("x", T.BinaryType())])
    held = rows.select("h", "doc_id", "quality", "text").mapInArrow(emit, schema).orderBy("h", "doc_id", "x").collect()
    model.destroy()
    return np.array([np.frombuffer(r["x"], np.float32) for r in held], float), np.array([r["quality"] for r in held], float)


def fit(rows: DataFrame) -> tuple[np.ndarray, Network | float]:
    """Sampled rows -> word vectors and the network, or a constant score."""
    kinds = rows.groupBy("quality").count().collect()  # labels are 0 and 1
    if len(kinds) < 2:
        return np.zeros((WORDS, DIM), np.float32), float(kinds[0]["quality"]) if kinds else 0.5
    vectors = word_vectors(rows)
    x, y = pooled_rows(rows, vectors)
    kept = np.arange(len(y)) % 5 != 4
    if kept.all() or len(set(y[kept])) < 2:
        return vectors, Network(x, y)
    net = Network(x[kept], y[kept])
    net.calibrate(x[~kept], y[~kept])
    return vectors, net


def scores_of(texts: list[str | None], vectors: np.ndarray, net: Network | float, tokens: Tokens) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    if isinstance(net, float):
        return np.full(len(texts), net)
    return net.scores(np.stack([pooled(*tokens(t), vectors) for t in texts]).astype(float))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """h, doc_id, text, quality of the at most ``sample`` labelled ids with the least hashes; one row an id."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    usable = labels.where(F.col("quality").isNotNull() & (fold != HELD)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    held = F.broadcast(staged(chosen, "sampled-labels"))  # at most ``sample`` rows of three numbers
    rows = docs.select("doc_id", "text").join(held, "doc_id")
    # Repeated ids: the least text that is there.
    return staged(rows.groupBy("h", "doc_id", "quality").agg(F.min("text").alias("text")), "sampled-rows")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Every column of docs, with held_out, score and predicted added (or replaced)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels.select("doc_id", "quality"), sample)))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    added = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = [c for c in docs.columns if c not in {f.name for f in added}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *added])
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = model.value
        tokens = Tokens()
        for batch in batches:
            parts = [scores_of([x.as_py() for x in batch.column(place)[at : at + 256]], vectors, net, tokens) for at in range(0, batch.num_rows, 256)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            new = [batch.column(len(kept)), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *new], schema.names)

    return docs.select(*kept, F.coalesce(fold == HELD, F.lit(False)).alias("held_out")).mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}

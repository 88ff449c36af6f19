"""Line dedup with a sharded minimal perfect hash.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.
Keys of at least ``min_points`` code points found in at least ``min_docs``
documents lose all their lines in every document.

1. Each task emits the distinct keys of its documents as 128-bit hashes with a
   count; Spark adds the counts up (partial sums first, so a key in a third of
   all documents is a handful of rows).
2. All distinct hashes are dealt to shards of about ``shard_keys`` by their leading
   bits.  Each shard becomes a minimal perfect hash: bit arrays, level by level, with
   a fingerprint array and a count array in the order of the hash.  Every line that
   can be asked for has its slot, so 16 bits of fingerprint and a count that stops at
   what its type holds are enough, and the count says whether a line goes.
3. Documents probe the arrays.  The at most ``hot_keys`` most frequent keys have a
   shard of their own, small by construction, which is broadcast and probed where
   the document is.  The document's other hashes travel to their shards; none of
   them stands in more than one ``hot_keys``-th of all (document, line) pairs, so no shard is
   a hot spot.  Only hits travel back to the document.

Cases: a null or empty text is one empty line (never a key where
``min_points`` >= 1); a key counts once per row, so repeated rows count each;
very long texts have many lines or long ones, and are read one at a time; keys with
equal counts are on one side of ``min_docs`` together; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklode.llm.shared import fits, staged

MIN_DOCS = 10
MIN_POINTS = 1
SHARD_KEYS = 1 << 16
HOT_KEYS = 1 << 17
#: The most that all hits of the shards may take to be broadcast to the documents.
HIT_BYTES = 4 << 20
#: Slots per key in a level of the perfect hash.
GAMMA = 2.0


def lines_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def line_key(line: bytes) -> bytes:
    """bytes.strip() and lower() touch just the ASCII characters asked for."""
    return line.strip().lower()


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else sum((b & 0xC0) != 0x80 for b in key)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of (h1, h2) for a level."""
    x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * 0xD1B54A32D192ED03) & (2**64 - 1)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct (h1, h2) with fingerprints and counts by slot."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int], prints: np.ndarray, counts: np.ndarray) -> None:
        self.levels, self.sizes, self.prints, self.counts = levels, sizes, prints, counts  # levels: bits as 64-bit words
        base, self.ranks = 0, []  # ones before each word
        for words in levels:
            ones = np.bitwise_count(words).astype(np.uint32)
            sums = np.cumsum(ones, dtype=np.uint32)
            self.ranks.append(sums - ones + np.uint32(base))
            base += int(ones.sum())

    def slot(self, level: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the bit at each place is one, and the ones before it."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        held = self.levels[level][word]
        return (held >> bit) & np.uint64(1) == 1, self.ranks[level][word] + np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, prints: type = np.uint16, most: int = 255) -> PerfectHash:
        """``prints``: type of the fingerprints; ``most``: counts beyond it needn't be told apart."""
        levels, sizes, left = [], [], np.arange(len(h1))
        slot_level = np.zeros(len(h1), np.int32)
        slot_place = np.zeros(len(h1), np.int64)
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            place = (mixed(h1[left], h2[left], len(levels)) % np.uint64(size)).astype(np.int64)
            load = np.bincount(place, minlength=-(-size // 64) * 64)
            alone = load[place] == 1
            levels.append(np.packbits(load == 1, bitorder="little").view(np.uint64)), sizes.append(size)
            slot_level[left[alone]], slot_place[left[alone]] = len(levels) - 1, place[alone]
            left = left[~alone]
            if len(levels) > 200:
                raise ValueError("keys of a shard aren't distinct")
        kind = np.min_scalar_type(most)
        out = cls(levels, sizes, np.zeros(len(h1), prints), np.zeros(len(h1), kind))
        for level in range(len(levels)):
            own = np.flatnonzero(slot_level == level)
            slot = out.slot(level, slot_place[own])[1]
            out.prints[slot] = h2[own].astype(prints)
            out.counts[slot] = np.minimum(counts[own], np.iinfo(kind).max)
        return out

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for keys that aren't in the index."""
        out, left = np.zeros(len(h1), np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            place = (mixed(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            set_, slot = self.slot(level, place)
            at, slot = left[set_], slot[set_]
            out[at] = np.where(self.prints[slot] == h2[at].astype(self.prints.dtype), self.counts[slot], 0)
            left = left[~set_]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), len(self.prints), self.prints.itemsize, self.counts.itemsize, *self.sizes], np.int64)
        return b"".join([head.tobytes(), *(x.tobytes() for x in self.levels), self.prints.tobytes(), self.counts.tobytes()])

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        n_levels, n, print_bytes, count_bytes = np.frombuffer(blob, np.int64, 4).tolist()
        sizes = np.frombuffer(blob, np.int64, n_levels, 32).tolist()
        at, levels = 32 + 8 * n_levels, []
        for size in sizes:
            levels.append(np.frombuffer(blob, np.uint64, -(-size // 64), at))
            at += 8 * len(levels[-1])
        prints = np.frombuffer(blob, f"u{print_bytes}", n, at)
        return cls(levels, sizes, prints, np.frombuffer(blob[at + print_bytes * n :], f"u{count_bytes}", n))


def split_hashes(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def shard_of(h1: np.ndarray, bits: int) -> np.ndarray:
    return (h1 >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h1), np.int32)


def key_counts(docs: DataFrame, min_points: int) -> DataFrame:
    """key (16 bytes), n: rows of docs that hold the key."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                keys = {line_key(x) for x in lines_of(text)}
                seen.update(key_hash(k) for k in keys if code_points(k) >= min_points)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["key", "n"]
            )

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(emit, "key binary, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def build_index(counts: DataFrame, bits: int, min_docs: int, prints: type = np.uint16) -> DataFrame:
    """counts(key, n) -> shard, blob."""

    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(shard_of(split_hashes(list(keys))[0], bits) if len(keys) else np.zeros(0, np.int32))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = split_hashes(list(pdf["key"]))
        blob = PerfectHash.build(h1, h2, pdf["n"].to_numpy(), prints, min_docs).dump()
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "blob": [blob]})

    shard = F.pandas_udf(number, "int")
    return counts.withColumn("shard", shard("key")).groupBy("shard").applyInPandas(build, "shard int, blob binary")


def frequent(keys: list[bytes], hot: PerfectHash | None, min_docs: int) -> set[bytes]:
    """Hashes that the broadcast shard holds with enough documents; it holds no other that it would tell."""
    if hot is None or not keys:
        return set()
    return {keys[i] for i in np.flatnonzero(hot.count(*split_hashes(keys)) >= min_docs)}


OUT = [("n_lines", "long"), ("n_dropped", "long"), ("kept_sha256", "string"), ("kept_text", "string")]


def dropped(docs: DataFrame, hot, min_docs: int, min_points: int) -> DataFrame:
    """docs(doc_id, text, hits) without the lines that the hot shard or their ``hits`` name."""
    kept_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kept_type), *(T.StructField(n, {"long": T.LongType(), "string": T.StringType()}[t]) for n, t in OUT)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = PerfectHash.load(hot.value) if hot.value else None
        for batch in batches:
            texts = [lines_of(t) for t in batch.column(1).to_pylist()]
            keys = [[line_key(x) for x in lines] for lines in texts]
            hashes = {k: key_hash(k) for ks in keys for k in ks if code_points(k) >= min_points}
            often = frequent(list(hashes.values()), shard, min_docs)
            marks = []
            for ks, hits in zip(keys, batch.column(2).to_pylist()):
                own = set(hits or ())
                marks.append([(h := hashes.get(k)) is not None and (h in often or h in own) for k in ks])
            kept = [b"\n".join([x for x, m in zip(lines, ms) if not m]) for lines, ms in zip(texts, marks)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([sum(x) for x in marks], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", *(n for n, _ in OUT)],
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), "hits").mapInArrow(apply, schema)


def routed_hits(docs: DataFrame, index: DataFrame, hot, bits: int, min_docs: int, min_points: int) -> DataFrame:
    """docs(doc_id, k, text) -> doc_id, k, hits: the frequent keys of each row that its shards tell."""
    asked = T.StructType([T.StructField("shard", T.IntegerType()), docs.schema["doc_id"], T.StructField("k", T.LongType()), T.StructField("data", T.BinaryType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = PerfectHash.load(hot.value) if hot.value else None
        for batch in batches:
            whose, keys = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = [key_hash(k) for k in {line_key(x) for x in lines_of(text)} if code_points(k) >= min_points]
                whose += [i] * len(own)
                keys += own
            if keys and shard is not None:
                often = shard.count(*split_hashes(keys)) >= min_docs  # told where the document is
                whose, keys = [i for i, x in zip(whose, often) if not x], [k for k, x in zip(keys, often) if not x]
            shards = shard_of(split_hashes(keys)[0], bits) if keys else np.zeros(0, np.int32)
            at = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary())], asked.names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None  # one shard in memory at a time; its row comes first
        for batch in batches:
            leads = np.flatnonzero(np.asarray(batch.column(4)))
            data = batch.column(3)
            found: list[int] = []
            edges = [-1, *leads.tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo >= 0:
                    part = PerfectHash.load(data[lo].as_py())
                if hi - lo > 1:
                    h1, h2 = split_hashes(data.slice(lo + 1, hi - lo - 1).to_pylist())
                    found += (lo + 1 + np.flatnonzero(part.count(h1, h2) >= min_docs)).tolist()
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), data.take(at)], told.names)

    told = T.StructType([docs.schema["doc_id"], T.StructField("k", T.LongType()), T.StructField("key", T.BinaryType())])
    keys = docs.select("doc_id", "k", F.col("text").cast("binary").alias("text")).mapInArrow(emit, asked).withColumn("lead", F.lit(0))
    shards = index.select("shard", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("k"), F.col("blob").alias("data"), F.lit(1).alias("lead"))
    # Every key asked for is in the index, so each shard's own row leads what was sent to it.
    dealt = keys.unionByName(shards).repartition("shard").sortWithinPartitions("shard", F.desc("lead"))
    hits = dealt.select("shard", "doc_id", "k", "data", "lead").mapInArrow(probe, told)
    return hits.groupBy("doc_id", "k").agg(F.collect_set("key").alias("hits"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS, shard_keys: int = SHARD_KEYS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_lines, n_dropped, kept_sha256, kept_text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = staged(key_counts(docs, min_points), "line-counts")
    n_keys, n_pairs = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = (n_keys // shard_keys).bit_length()
    index = staged(build_index(counts, bits, min_docs), "line-index")
    # At most hot_keys keys can stand in that many documents.
    often = counts.where(F.col("n") >= max(min_docs, n_pairs // hot_keys + 1))
    shard = build_index(often, 0, min_docs, np.uint64).first()  # one row; fingerprints that turn other lines away
    hot = spark.sparkContext.broadcast(bytes(shard["blob"]) if shard else b"")
    keyed = docs.withColumn("k", F.xxhash64("doc_id", "text"))
    hits = staged(routed_hits(keyed, index, hot, bits, min_docs, min_points), "line-hits")
    near = F.broadcast(hits) if fits(hits, HIT_BYTES) else hits
    joined = keyed.alias("d").join(near.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.k") == F.col("h.k")), "left")
    return dropped(joined.select("d.doc_id", "d.text", "h.hits"), hot, min_docs, min_points)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line,
         translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line,
               generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS i FROM documents)
), often AS (
  SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (SELECT l.*, o.key IS NOT NULL AS gone FROM l LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE = {"op10_line_dedup": OP10_SQL}

"""SimHash near-dedup by anchor-point covering.

Two fingerprints of 64 bits link at ``THRESHOLD`` or fewer differing bits.  The bits
are cut into six blocks; of the ``TRIPLES`` of blocks, at least one holds at most one
of any four differing bits.  On 31 bits of each triple the anchors are the words of
the perfect [31,26] Hamming code, whose covering radius is 1.  Every fingerprint has
one home anchor (within the radius) and is replicated to every anchor within radius
plus the one bit that may differ, so a linked pair meets at the home of either side.
Per anchor, homes are compared with replicas; what is emitted is a spanning star of
each anchor's links, never its pairs.

Equal fingerprints are one row before anything is replicated, so groups of copies
cost nothing here.  An anchor that is home to more than ``home_limit`` fingerprints
is split into blocks of homes; its replicas go to every block, and no task holds
more than a block.  Links become components by alternating large-star and
small-star steps, each written to the shared folder.

Words: A-Z are lower-cased, runs of ``[^\\x20\\x09-\\x0D]``, shingles of ``SHINGLE`` words
with repeats; a shingle's hash is XXH64 with seed 42.
Cases: fewer words than a shingle are one shingle; null, empty and wordless texts
have fingerprint zero and link like any other; very long texts are hashed in pieces of
their shingles; repeated rows are returned each, with
one component; a null doc_id is passed over as component_id unless a component has no
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklode.llm.shared import staged

SHINGLE, SEED, THRESHOLD = 4, 42, 4
BLOCKS = (11, 11, 11, 11, 10, 10)
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))
HOME_LIMIT = 20_000
#: Homes of an anchor that are compared for the whole batch at once.
FEW = 24
ONE = np.uint64(1)


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    begin, end = starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    digest, count = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(begin), 1 << 15):
        own = b"".join([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + (1 << 15)], end[at : at + (1 << 15)])])
        count += np.unpackbits(np.frombuffer(own, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(begin)).tobytes(), "big")


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the fingerprint as a signed long), and the columns in ``carry``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], schema.names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType()), *(docs.schema[c] for c in carry)])
    return docs.select("doc_id", F.col("text").cast("binary"), *carry).mapInArrow(run, schema)


def table_bits(table: int) -> np.ndarray:
    """The 31 bit places of a triple of blocks."""
    starts = np.concatenate(([0], np.cumsum(BLOCKS)))
    return np.concatenate([np.arange(starts[b], starts[b + 1]) for b in TRIPLES[table]])[:31]


def masks() -> list[np.ndarray]:
    """By syndrome: what turns a 31-bit word into the code words within 2 bits, home first."""
    out = []
    for s in range(32):
        pairs = [(1 << (a - 1)) | (1 << (b - 1)) for a in range(1, 32) if a < (b := a ^ s) <= 31] if s else []
        out.append(np.array([1 << (s - 1) if s else 0, *pairs], np.uint64))
    return out


MASKS = masks()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, home) for every anchor of every fingerprint; a home comes as replica too."""
    keys, whose, homes = [], [], []
    for table in range(len(TRIPLES)):
        word, syndrome = np.zeros(len(fps), np.uint64), np.zeros(len(fps), np.int64)
        for place, bit in enumerate(table_bits(table)):
            b = (fps >> np.uint64(bit)) & ONE
            word |= b << np.uint64(place)
            syndrome ^= np.where(b == 1, place + 1, 0)
        for s in range(32):
            own = np.flatnonzero(syndrome == s)
            near = (word[own, None] ^ MASKS[s][None, :]) | np.uint64(table << 31)
            keys += [near[:, 0], near.ravel()]
            whose += [fps[own], np.repeat(fps[own], near.shape[1])]
            homes += [np.ones(len(own), bool), np.zeros(near.size, bool)]
    return np.concatenate(keys).view(np.int64), np.concatenate(whose), np.concatenate(homes)


def replicas(fps: DataFrame) -> DataFrame:
    """fps(fp) -> key, fp, home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for at in range(0, len(held), 2000):
                key, fp, home = anchors(held[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.array(home)], ["key", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, home boolean")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indexes over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low), np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def near(x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= threshold


def compared(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links among rows sorted by key, homes first in each key."""
    start = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    size = np.diff(np.concatenate((start, [len(key)])))
    n_homes = np.add.reduceat(home.astype(np.int64), start)
    left, right = [], []
    # Some row differs from the first, which is a home; a batch may end before that home's own replica.
    live = (n_homes > 0) & np.logical_or.reduceat(fp != np.repeat(fp[start], size), start)
    first, count = np.repeat(start, size), np.repeat(np.where(live & (n_homes <= FEW), n_homes, 0), size)
    member = np.flatnonzero((count > 0) & ~home)
    for k in range(FEW):
        member = member[count[member] > k]
        if not len(member):
            break
        other = first[member] + k
        hit = near(fp[member], fp[other], threshold) & (fp[member] != fp[other])
        left.append(member[hit]), right.append(other[hit])
    for g in np.flatnonzero(live & (n_homes > FEW)):
        lo, mid, hi = start[g], start[g] + n_homes[g], start[g] + size[g]
        for at in range(mid, hi, 512):
            rows = np.arange(at, min(at + 512, hi))
            hit = near(fp[rows, None], fp[None, lo:mid], threshold)
            # Each row keeps a link to its first home; homes that share a row are linked in a chain.
            i, j = np.nonzero(hit)
            if len(i):
                new = np.concatenate(([True], np.diff(i) != 0))
                left.append(rows[i[new]]), right.append(lo + j[new])
                chain = np.unique(np.stack([lo + j[:-1][~new[1:]], lo + j[1:][~new[1:]]], axis=1), axis=0)
                left.append(chain[:, 0]), right.append(chain[:, 1])
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    used, index = np.unique(np.concatenate((fp[a], fp[b])), return_inverse=True)
    label = roots(len(used), index[: len(a)], index[len(a) :])
    own = np.flatnonzero(label != np.arange(len(used)))
    return used[own], used[label[own]]


def links(fps: DataFrame, threshold: int = THRESHOLD, home_limit: int = HOME_LIMIT) -> DataFrame:
    """Distinct fps(fp) -> a, b: links that span the graph of pairs within ``threshold``."""
    if threshold > THRESHOLD:
        raise ValueError(f"the triples of blocks cover {THRESHOLD} differing bits")
    rows = replicas(fps)
    hot = staged(rows.where("home").groupBy("key").agg(F.count("*").alias("homes")).where(F.col("homes") > home_limit), "hot-anchors")
    block = F.lit(0)
    if not hot.isEmpty():
        rows = rows.join(hot, "key", "left")
        blocks = F.coalesce(F.ceil(F.col("homes") / home_limit), F.lit(1)).cast("int")
        of_home = F.array(F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        rows = rows.withColumn("block", F.explode(F.when(F.col("home"), of_home).otherwise(F.sequence(F.lit(0), blocks - 1))))
        block = F.col("block")
    dealt = (
        rows.select("key", block.alias("block"), "fp", "home")
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", F.desc("home"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # (key, block) and homes of the last group seen
        for batch in batches:
            key, blk, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.astype(np.int64).view(np.uint64)
            if not len(key):
                continue
            if carry is not None and carry[0] == (key[0], blk[0]):
                n = len(carry[1])
                key, blk = np.concatenate((np.full(n, key[0]), key)), np.concatenate((np.full(n, blk[0]), blk))
                fp, home = np.concatenate((carry[1], fp)), np.concatenate((np.ones(n, bool), home))
            group = np.cumsum(np.concatenate(([0], (np.diff(key) != 0) | (np.diff(blk) != 0))))
            a, b = compared(group, fp, home, threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            carry = ((key[-1], blk[-1]), fp[(group == group[-1]) & home])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> a, b: every vertex a that isn't the smallest of its component, and that b."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).distinct()

    edges = staged(edges.where("a != b"), "links")
    if edges.isEmpty():
        return edges
    was = None
    while was != (now := state(edges)):
        was = now
        edges = staged(small(large(edges)), "stars")
    return edges


def near_dedup(docs: DataFrame, threshold: int = THRESHOLD, home_limit: int = HOME_LIMIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (hex), component_id, root (a fingerprint of the component, the same for all of it), and the columns in ``carry``."""
    fps = staged(fingerprints(docs.select("doc_id", "text", *carry), carry), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    stars = components(links(nodes, threshold, home_limit)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    held = staged(nodes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted-fingerprints")
    # Most components are one fingerprint; the larger ones alone are brought together by root.
    large = held.where("fp != root").groupBy("root").agg(F.min("rep").alias("other"))
    tops = held.where("fp = root").join(large, "root", "left").select("root", F.least("rep", "other").alias("component_id"))
    alone = tops.join(large.select("root"), "root", "left_anti").select(F.col("root").alias("fp"), "root", "component_id")
    several = held.join(tops.join(large.select("root"), "root", "left_semi"), "root").select("fp", "root", "component_id")
    found = alone.unionByName(several)
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *carry)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("root")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}

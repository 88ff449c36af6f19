"""Repeated-substring dedup with run-length indexes.

Every byte that a string of ``length`` bytes covers goes, if that string also starts
anywhere else in the corpus (in the same document too; overlaps count).

1. Each window of ``length`` bytes names its anchor: the place of its least hashed
   ``GRAM``-byte gram, leftmost among equals.  That depends on the window's bytes
   alone, so equal windows have equal anchors at equal distance.  Windows that share
   an anchor place are a run, with one context: the bytes from the run's first window
   to its last one's end.  One row per run goes on: gram hash, context hash, place.
   Runs that follow each other with one gram and one context (text with a period)
   are one row with a number of copies.
2. Runs whose gram hash occurs once hold no repeat.  Of every other gram each distinct
   context is read from the text, and from a second place too if it has copies.
3. A gram with more than ``group`` distinct contexts is split: windows are told apart
   by whether their anchor lies in their first or second half, and each half's
   contexts meet under a longer key, the bytes that all of that half's windows hold.
   Halves are halved again while they stay too large; at the end a key is a whole
   window and has one context, so this ends for any input, and every level is a
   shuffle by key.  Which grams are large is told by a table of these alone, so that no
   join gathers the contexts of one gram.
4. The contexts of some grams form a repetitive text with a run-length index: the runs
   of its Burrows-Wheeler transform, and for both ends of each run a sample of how far
   the suffix before agrees with its neighbour.  Contexts are streamed through the
   index from their last byte to their first, a step to the byte before at a time.
   Inside a run the match with a neighbour grows by one byte; at a run's head or end
   the sample says what it is.  The longer of both is the matching statistic of the
   place: how long a string from there also starts elsewhere.  Windows with a statistic
   of ``length`` or more are repeats.  Windows of one run never see themselves: a run's
   windows lie in its own context only.

Documents get their spans by id and text hash; the text is joined once to read
contexts and once to cut.

Cases: a null text counts as empty; texts shorter than ``length`` keep all bytes;
very long texts are read in overlapping pieces of ``PIECE`` windows; repeated rows are
copies of each other and lose their repeats; ties between grams go to the leftmost; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklode.llm.shared import fits, staged

LENGTH = 400
GRAM = 48
PIECE = 1 << 19
#: Distinct contexts that meet under one key.
GROUP = 128
#: Bytes of context indexed at a time.
BATCH = 1 << 20
#: The most symbols that the first sort looks at, and the most groups indexed at a time, so that it looks at one at least.
FIRST, MOST_GROUPS = 8, 30_000
BROADCAST_BYTES = 4 << 20
#: Tasks that share the rows of a gram where the large grams aren't broadcast.
SALTS = 64
MIX = 0x9E3779B97F4A7C15


class Grams:
    """Hashes of all grams of a text, by differences of one running sum."""

    def __init__(self, gram: int) -> None:
        self.gram, self.powers, self.inverse = gram, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            for name, base in (("powers", MIX), ("inverse", pow(MIX, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - self.gram + 1
        self.reach(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        h = (sums[self.gram :] - sums[:n]) * self.inverse[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def runs(text: bytes, length: int, grams: Grams) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(gram hash, context hash, first window, last window, anchor's distance, copies) of each run.

    Copies beyond the first follow it, as wide as it is.
    """
    width = length - grams.gram + 1
    for base in range(0, max(0, len(text) - length + 1), PIECE):
        piece = text[base : base + PIECE + length - 1]
        h = grams.hashes(np.frombuffer(piece, np.uint8))
        place = np.arange(len(h), dtype=np.uint64)
        # The place in the low bits makes the leftmost of equal hashes the least.
        low = sliding_min((h & np.uint64(2**64 - 2**20)) | place, width)
        heads = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        ends = np.concatenate((heads[1:], [len(low)])) - 1
        at = (low[heads] & np.uint64(2**20 - 1)).astype(np.int64)
        held = None
        for g, first, last, away in zip(h[at].view(np.int64).tolist(), heads.tolist(), ends.tolist(), (at - heads).tolist()):
            c = signed(xxhash.xxh3_64_intdigest(piece[first : last + length]))
            if held is not None and held[:2] == (g, c):
                held = (*held[:5], held[5] + 1)
                continue
            if held is not None:
                yield held
            held = (g, c, base + first, base + last, away, 1)
        yield held


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k (hash of id and text), text as binary."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def run_rows(docs: DataFrame, length: int) -> DataFrame:
    """keyed docs -> g, c, first, last, away, copies, doc_id, k."""
    names = ["g", "c", "first", "last", "away", "copies"]
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in names), docs.schema["doc_id"], T.StructField("k", T.LongType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(GRAM if length > 2 * GRAM else max(1, length // 2))
        for batch in batches:
            whose, found = [], []
            for i, text in enumerate(batch.column(2)):
                own = list(runs(text.as_py(), length, grams))
                whose += [i] * len(own)
                found += own
            columns = [pa.array(x, pa.int64()) for x in (zip(*found) if found else [()] * len(names))]
            at = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(at), batch.column(1).take(at)], schema.names)

    return docs.mapInArrow(emit, schema)


def suffix_order(data: np.ndarray, left: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """(order, row, ranks, parted) of all suffixes within groups.

    order lists the suffixes' places, row is its inverse, ranks are those by the first k, 2k,
    4k ... symbols, and parted tells of each row at which of them it differs from the row
    before (len(ranks): at none).  left: symbols from each place to its context's end mark.
    Equal suffixes stay in the order of the text.
    """
    n = len(data)
    # Symbols by their number among those present; as many as leave room for a place in 63 bits.
    present = np.bincount(data, minlength=257) > 0
    base, most, span = int(present.sum()), 1 << (63 - n.bit_length()), 1
    n_groups = int(group.max()) + 1
    while span < FIRST and n_groups * base ** (span + 1) <= most:
        span += 1
    digits = np.concatenate(((np.cumsum(present) - 1)[data], np.zeros(span, np.int64)))
    key = digits[:n].copy()
    for i in range(1, span):
        key *= base
        key += digits[i : n + i]
    # Nothing counts beyond an end mark.
    near = np.flatnonzero(left < span - 1)
    short = np.zeros(len(near), np.int64)
    for i in range(span):
        short = short * base + np.where(left[near] >= i, digits[near + i], 0)
    key[near] = short
    key += group * base**span
    del digits

    def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order of the keys, the first place of each place's equals in it, whether it is that place, and whether it has equals."""
        bits = len(key).bit_length()
        if int(key.max()) >> (63 - bits) == 0:  # keys with their places: a plain sort is faster than one of places
            key = np.sort((key << bits) | np.arange(len(key)))
            order = key & ((1 << bits) - 1)
            key >>= bits
        else:
            order = np.argsort(key)
            key = key[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        heads = np.flatnonzero(fresh)
        first = np.repeat(heads, np.diff(heads, append=len(key)))
        return order, first, fresh, ~(fresh & np.concatenate((fresh[1:], [True])))

    order, first, fresh, tied = numbered(key)
    rank = np.empty(n, np.int32)
    rank[order] = first
    parted = np.where(fresh, 0, 255).astype(np.uint8)
    ranks, open_ = [(span, rank)], order[tied]
    longest = int(left.max())
    while len(open_) and span <= longest:
        # Only places with equals are sorted again: by what they are equal in, then by what follows.
        ahead = np.zeros(len(open_), np.int64)
        more = np.flatnonzero(left[open_] >= span)
        ahead[more] = rank[open_[more] + span] + 1
        sub, first, fresh, tied = numbered(rank[open_].astype(np.int64) * (n + 1) + ahead)
        open_ = open_[sub]
        # Equals of the span before start at the rank they share.
        shared = rank[open_].astype(np.int64)
        head = np.concatenate(([True], shared[1:] != shared[:-1]))
        heads = np.flatnonzero(head)
        start = np.repeat(heads, np.diff(heads, append=len(open_)))
        new = np.flatnonzero(fresh & ~head)
        parted[shared[new] + new - start[new]] = len(ranks)
        rank = rank.copy()
        rank[open_] = shared + first - start
        open_ = open_[tied]
        span *= 2
        ranks.append((span, rank))
    row = rank.astype(np.int64)
    # What is equal to the end is told apart by its place.
    shared, open_ = np.divmod(np.sort(row[open_] * n + open_), n)
    heads = np.flatnonzero(np.concatenate(([True], shared[1:] != shared[:-1]))) if len(open_) else open_
    row[open_] += np.arange(len(open_)) - np.repeat(heads, np.diff(heads, append=len(open_)))
    order = np.empty(n, np.int64)
    order[row] = np.arange(n)
    parted[parted == 255] = len(ranks)
    return order, row, ranks, parted


def common_prefix(a: np.ndarray, b: np.ndarray, text: bytes, ranks: list[tuple[int, np.ndarray]], left: np.ndarray, parted: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, end marks not counted.

    text: the bytes of all places, and eight more; parted: which of the ranks are the first to tell a and b apart.
    """
    room = np.minimum(left[a], left[b])
    done = np.concatenate(([0], [span for span, _ in ranks]))[parted]
    np.minimum(done, room, out=done)
    for k in range(len(ranks) - 2, -1, -1):
        span, rank = ranks[k]
        # Ranks of twice the span told them apart, so at most one more span is equal.
        live = np.flatnonzero((parted > k + 1) & (done + span <= room))
        same = rank[a[live] + done[live]] == rank[b[live] + done[live]]
        done[live[same]] += span
    # Less symbols are left to compare than the first ranks tell apart: eight at once.
    eight = np.ndarray((len(left),), "<u8", text, strides=(1,))
    live = np.flatnonzero(done < room)
    differ = eight[a[live] + done[live]] ^ eight[b[live] + done[live]]
    equal = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3
    done[live] = np.minimum(done[live] + equal, room[live])
    return done


class RunIndex:
    """Run-length index of grouped contexts, with samples at both ends of every run.

    A context with copies is held once; at each of its places a copy agrees with it to
    its end.  Holds, by run of the transform: its first row, the row that its first row steps to
    and that row's run, and how far the suffixes that its ends step to agree with the suffix before (at the
    head) and after (at the end).  Nothing as long as the text stays.
    """

    def __init__(self, contexts: list[bytes], groups: list[int], copied: list[bool]) -> None:
        self.copied = np.array(copied, bool)
        self.sizes = np.array([len(c) for c in contexts], np.int64)
        ends = np.cumsum(self.sizes + 1)  # an end mark after each context
        starts = ends - self.sizes - 1
        text = b"\0".join(contexts) + bytes(9)
        data = np.frombuffer(text, np.uint8)[: ends[-1]] + np.int16(1)
        data[ends - 1] = 0
        left = np.repeat(ends - 1, self.sizes + 1) - np.arange(len(data))
        group = np.repeat(np.array(groups, np.int64), self.sizes + 1)
        order, row, ranks, parted = suffix_order(data, left, group)
        # The transform: the byte before each suffix; a context's start has a symbol of its own.
        before = np.concatenate((data[:1], data[:-1])).astype(np.int32)
        before[starts] = 257 + np.arange(len(contexts))
        before = before[order]
        group = np.sort(group)  # of each row
        fresh = np.concatenate(([True], group[1:] != group[:-1]))
        turn = fresh.copy()
        turn[1:] |= before[1:] != before[:-1]
        self.head = np.flatnonzero(turn)
        tail = np.concatenate((self.head[1:], [len(order)])) - 1
        self.start_row = row[ends - 1]  # the rows of the end marks, where contexts enter
        # The head and the tail of a run step to neighbours of other runs: sample how far they agree.
        live = before[self.head] < 257
        target, above, below = (np.zeros(len(self.head), np.int64) for _ in range(3))
        first, last = (row[order[rows[live]] - 1] for rows in (self.head, tail))
        wanted = np.zeros(len(order) + 1, bool)
        wanted[first] = wanted[last + 1] = True
        wanted[:-1] &= ~fresh
        wanted[-1] = False
        agree = np.zeros(len(order) + 1, np.int64)  # of each row with the row before, where that is wanted
        rows = np.flatnonzero(wanted)
        agree[rows] = common_prefix(order[rows - 1], order[rows], text, ranks, left, parted[rows])
        target[live], above[live], below[live] = first, agree[first], agree[last + 1]
        run = np.searchsorted(self.head, target, side="right") - 1
        # By run, in one place of memory: head, tail, samples, step, the run stepped to, and its tail.
        self.steps = np.column_stack((self.head, tail, above, below, target - self.head, run, tail[run])).astype(np.int32)

    def statistics(self) -> list[np.ndarray]:
        """Of each context, at each place, the longest match that starts elsewhere in its group."""
        found, starts = self.matches()
        return np.split(found, starts[1:])

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """The statistics of all contexts, one after the other, and where each starts."""
        order = np.argsort(-self.sizes, kind="stable")
        sizes, copied = self.sizes[order], self.copied[order]
        table = np.zeros((int(sizes.max(initial=0)), len(order)), np.int32)
        at, above, below = self.start_row[order].astype(np.int32), np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        run = (np.searchsorted(self.head, at, side="right") - 1).astype(np.int32)
        active = np.searchsorted(-sizes, -np.arange(1, len(table) + 1), side="right")
        for step, n in enumerate(active.tolist()):
            at, above, below = at[:n], above[:n], below[:n]
            head, tail, first, last, ahead, run, end = self.steps.take(run[:n], axis=0).T
            above = np.where(at == head, first, above + 1)
            below = np.where(at == tail, last, below + 1)
            at = at + ahead
            # A run's rows may step into several: those beyond the first look for theirs.
            beyond = np.flatnonzero(at > end)
            if len(beyond):
                run[beyond] = np.searchsorted(self.head, at[beyond], side="right") - 1
            np.maximum(above, below, out=table[step, :n])
            table[step, :n][copied[:n]] = step + 1
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        ends = np.cumsum(self.sizes)
        back = np.repeat(ends - 1, self.sizes) - np.arange(ends[-1])
        return table[back, np.repeat(column, self.sizes)], ends - self.sizes


def marked(contexts: list[bytes], groups: list[int], copied: list[bool], length: int) -> list[tuple[int, int, int]]:
    """(context, first, last) of each run of repeated windows."""
    index = RunIndex(contexts, groups, copied)
    found, starts = index.matches()
    # A place that is no window stands before each context, so that runs don't go on from one to the next.
    starts = starts + np.arange(len(starts))
    hit = np.zeros(len(found) + len(starts) + 1, bool)
    hit[np.arange(len(found)) + np.repeat(np.arange(len(starts)), index.sizes) + 1] = found >= length
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    first, last = edge[::2], edge[1::2] - 1
    whose = np.searchsorted(starts, first, side="right") - 1
    return list(zip(whose.tolist(), (first - starts[whose]).tolist(), (last - starts[whose]).tolist()))


def told_large(rows: DataFrame, large: DataFrame, by: str) -> DataFrame:
    """rows(g, ..), with whether their g is among large(g), each once.

    Rows of one g stay where they are, or are dealt to SALTS tasks by the column ``by``.
    """
    marked = large.withColumn("large", F.lit(True))
    if fits(large, BROADCAST_BYTES):
        found = rows.join(F.broadcast(marked), "g", "left")
    else:
        salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
        each = marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("salt", salt).join(each, ["g", "salt"], "left").drop("salt")
    return found.withColumn("large", F.coalesce("large", F.lit(False)))


def contexts_of(docs: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """kinds(g, c, n, large, size, away, a, b) -> g, c, n, large, away, copy, context; copy 1 where n > 1."""
    places = F.array(F.struct(F.lit(0).alias("copy"), F.col("a").alias("at")), F.struct(F.lit(1).alias("copy"), F.col("b").alias("at")))
    wanted = kinds.select("g", "c", "n", "large", "size", "away", F.explode(F.slice(places, 1, F.when(F.col("n") > 1, 2).otherwise(1))).alias("p"))
    asked = wanted.groupBy(F.col("p.at.doc_id").alias("doc_id"), F.col("p.at.k").alias("k")).agg(
        F.collect_list(F.struct("g", "c", "n", "large", "away", "size", F.col("p.copy").alias("copy"), F.col("p.at.first").alias("first"))).alias("asked")
    )
    # Repeated rows are read once.
    held = docs.dropDuplicates(["doc_id", "k"]).alias("d").join(asked.alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.k") == F.col("a.k")))

    def cut(r: Column) -> Column:
        context = F.substring(F.col("text"), (r["first"] + 1).cast("int"), (r["size"] + length - 1).cast("int"))
        return F.struct(*(r[x].alias(x) for x in ("g", "c", "n", "large", "away", "copy")), context.alias("context"))

    return held.select(F.explode(F.transform("a.asked", cut)).alias("r")).select("r.*")


def indexed_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """contexts(g, c, context) -> g, c, lo, hi by the run-length index of each gram.

    A gram with one context, held once, has no repeat and isn't indexed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # gram, context hash, context, whether it has copies
        size = 0

        def alone() -> bool:
            """Whether the last context held is the only one of its gram, without copies."""
            return bool(held) and not held[-1][3] and (len(held) == 1 or held[-2][0] != held[-1][0])

        def solve() -> pa.RecordBatch:
            number = {g: i for i, g in enumerate(dict.fromkeys(x[0] for x in held))}
            hits = marked([x[2] for x in held], [number[x[0]] for x in held], [x[3] for x in held], length)
            columns = [[held[i][0] for i, _, _ in hits], [held[i][1] for i, _, _ in hits], [a for _, a, _ in hits], [b for _, _, b in hits]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["g", "c", "lo", "hi"])

        for batch in batches:
            for g, c, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and held[-1][0] == g and held[-1][2] == text:
                    held[-1][3] = True  # a second place, byte for byte
                    continue
                if alone() and held[-1][0] != g:
                    size -= len(held.pop()[2])
                if held and (size > BATCH or len(held) > MOST_GROUPS) and held[-1][0] != g:
                    yield solve()
                    held.clear()
                    size = 0
                held.append([g, c, text, False])
                size += len(text)
        if alone():
            held.pop()
        if held:
            yield solve()

    return contexts.select("g", "c", "context").repartition("g").sortWithinPartitions("g", "c").mapInArrow(run, "g long, c long, lo long, hi long")


def halves(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts of split grams -> their halves.

    contexts(g, c, n, away, copy, context, root_g, root_c, shift, lo, hi): windows whose
    anchor is at a distance in [lo, hi).  The half's key is what all its windows hold.
    """
    schema = contexts.select("g", "c", "n", "away", "copy", "context", "root_g", "root_c", "shift", "lo", "hi").schema

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, _, n, away, copy, context, root_g, root_c, shift, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                mid, least = (lo + hi) // 2, away - (len(context) - length)
                for lo_, hi_ in ((lo, mid), (mid, hi)):
                    top, low = min(away, hi_ - 1), max(least, lo_)
                    if top < low:
                        continue  # no window of this context
                    at = away - top
                    part = context[at : at + (top - low) + length]
                    key = struct.pack("<qqq", g, lo_, hi_) + context[away - lo_ : away - hi_ + 1 + length]
                    out.append((signed(xxhash.xxh3_64_intdigest(key)), signed(xxhash.xxh3_64_intdigest(part)), n, top, copy, part, root_g, root_c, shift + at, lo_, hi_))
            columns = list(zip(*out)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, batch.schema)], schema.names)

    return contexts.select(*schema.names).mapInArrow(split, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """keyed docs -> doc_id, k, spans: array of (lo, hi), bytes to remove, may overlap."""
    found = staged(run_rows(docs, length), "window-runs")
    grams = found.groupBy("g").agg(F.sum("copies").alias("n")).where("n > 1").select("g")
    # A table of its own: the join then reads two shuffles, and a gram that a third of
    # the corpus shares is split over tasks.
    met = staged(found.join(staged(grams, "repeated-grams"), "g"), "repeated-runs")
    size = F.col("last") - F.col("first") + 1
    ends = F.col("first") + (F.col("copies") - 1) * size
    kinds = met.groupBy("g", "c").agg(
        F.sum("copies").alias("n"),
        F.max(size).alias("size"),
        F.max("away").alias("away"),
        F.min(F.struct("doc_id", "k", "first")).alias("a"),
        F.max(F.struct("doc_id", "k", ends.alias("first"))).alias("b"),
    )
    kinds = staged(kinds, "context-kinds")
    crowded = staged(kinds.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > group).select("g"), "large-grams")
    contexts = staged(contexts_of(docs, told_large(kinds, crowded, "c"), length), "contexts")
    marks = [indexed_repeats(contexts.where("not large"), length)]
    reach = length - (GRAM if length > 2 * GRAM else max(1, length // 2)) + 1
    level, large = 0, contexts.where("large")
    large = large.select(
        "g", "c", "n", "away", "copy", "context", F.col("g").alias("root_g"), F.col("c").alias("root_c"), F.lit(0).cast("long").alias("shift"), F.lit(0).cast("long").alias("lo"), F.lit(reach).cast("long").alias("hi")
    )
    while not large.isEmpty():
        level += 1
        parts = staged(halves(large, length), f"halves-{level}")
        crowded = parts.where("copy = 0").groupBy("g").agg(F.count_distinct("c").alias("m")).where(F.col("m") > group).select("g")
        crowded = staged(crowded, f"large-halves-{level}")
        # Each kind once, with a second copy where it has one.
        own = F.when(F.col("copy") == 0, F.col("n")).otherwise(0)
        kinds = parts.groupBy("g", "c").agg(F.sum(own).alias("n"), F.min("context").alias("x"), F.max("context").alias("y"))
        pair = F.slice(F.array("x", "y"), 1, F.when(F.col("n") > 1, 2).otherwise(1))
        few = told_large(kinds, crowded, "c").where("not large").select("g", "c", F.explode(pair).alias("context"))
        roots = parts.where("copy = 0").select("g", "c", "root_g", "root_c", "shift")
        hits = staged(indexed_repeats(few, length), f"half-marks-{level}")
        marks.append(hits.join(roots, ["g", "c"]).select(F.col("root_g").alias("g"), F.col("root_c").alias("c"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi")))
        large = told_large(parts, crowded, "root_c").where("large").drop("large")
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    # All copies of a row that stands for several are repeats of each other.
    last = F.when(F.col("copies") > 1, ends + size - 1).otherwise(F.col("first") + F.col("hi"))
    spans = met.join(every, ["g", "c"]).select("doc_id", "k", (F.col("first") + F.col("lo")).alias("lo"), (last + length).alias("hi"))
    return spans.groupBy("doc_id", "k").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal runs removed)."""
    kept, at, removed, n = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(spans):
        if lo > end:  # touching spans are one run
            n += 1
            kept.append(text[at:lo])
            removed += hi - lo
            at = end = hi
        elif hi > end:
            removed += hi - end
            at = end = hi
    kept.append(text[at:])
    return b"".join(kept), removed, n


def substring_dedup(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary)."""
    rows = keyed(docs.select("doc_id", "text"))
    spans = checked_broadcast_spans(staged(repeated_spans(rows, length, group), "spans"))
    joined = rows.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.k") == F.col("s.k")), "left")
    schema = T.StructType(
        [docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = [cut_text(t, [(s["lo"], s["hi"]) for s in spans or ()]) for t, spans in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([r for _, r, _ in done], pa.int64()),
                    pa.array([n for _, _, n in done], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in done], pa.string()),
                    pa.array([k for k, _, _ in done], pa.binary()),
                ],
                schema.names,
            )

    return joined.select("d.doc_id", "d.text", "s.spans").mapInArrow(run, schema)


def checked_broadcast_spans(spans: DataFrame) -> DataFrame:
    """Broadcast where all spans together, counted first, take at most BROADCAST_BYTES."""
    total = spans.agg(F.sum(F.size("spans") * 32 + 64)).first()[0] or 0
    return F.broadcast(spans) if total <= BROADCAST_BYTES else spans


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = substring_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    # What is left as text; where a cut parts a character, its bytes show as U+FFFD.
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE: dict[str, str] = {}

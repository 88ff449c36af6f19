"""BPE encoding and decoding by a priority queue of merges over a linked list.

Reads a ``tokenizers`` vocabulary file of the word-end kind: NFC, lower case,
words by pattern, bytes written as printable characters, ``</w>`` after the last
symbol of a word.  A word's symbols form a doubly linked list; a heap holds
(rank, place) of every mergeable pair.  Popping an entry whose pair has changed
meanwhile skips it as stale.  Decoding looks every id up in the vocabulary and
concatenates the strings, parted by one space as the file's decoder asks.

The work is a map over documents: no shuffle, one Arrow batch in memory, and a
memo of words that is emptied when it holds ``MEMO`` words.

Cases: a null text counts as empty; an empty text has no ids and decodes to the
empty string; special tokens in a text are found before normalising; repeated
rows are encoded each; an empty table gives an empty result; other columns pass
through ``encode_column`` unless they bear the name of an added column, which
then replaces them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose ids are remembered by a worker at a time.
MEMO = 300_000
#: Longer runs aren't remembered, so the memos are bounded in bytes too.
MEMO_CHARS = 64
#: Unicode white space.
SPACE = r"[\t-\r \x85\xa0  -     　]"
#: White space for str.split() that the pattern above doesn't hold.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character of each byte: itself where it has one, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.strings = {i: s for s, i in (self.ids | special).items()}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_starts = {c[0] for c in special}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", SPACE[1:-1])).findall
        self.spaces = regex.compile(SPACE + "+").split
        self.symbol = byte_symbols()
        self.memo: dict[str, bytes] = {}
        self.piece_memo: dict[str, bytes] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply merges by rank, the leftmost first among equals."""
        ranks, n = self.ranks, len(symbols)
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # stale: the pair is gone or has changed
            symbols[i] += symbols[j]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [s for s, a in zip(symbols, alive) if a]

    def word(self, chunk: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers, of a run without white space."""
        held = self.piece_memo
        out = b"".join([ids if (ids := held.get(p)) is not None else self.piece(p) for p in self.pieces(chunk)])
        if len(chunk) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[chunk] = out
        return out

    def piece(self, piece: str) -> bytes:
        """The ids of one word of the pattern."""
        symbols = [self.symbol[b] for b in piece.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        out = np.array([self.ids[s] for s in self.merge(symbols) if s in self.ids], "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self.piece_memo) >= MEMO:
                self.piece_memo.clear()
            self.piece_memo[piece] = out
        return out

    def plain(self, text: str) -> bytes:
        """Encode text that holds no special token."""
        if not text.isascii():
            # Lower case by single characters: no final form of sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        chunks = self.spaces(text) if ODD_SPACE.search(text) else text.split()
        memo, word = self.memo.get, self.word
        return b"".join([ids if (ids := memo(c)) is not None else word(c) for c in chunks])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(c in text for c in self.special_starts):
            return self.plain(text)
        parts = self.special_at.split(text)
        return b"".join(
            [self.special[p].to_bytes(4, "little") if i % 2 else self.plain(p) for i, p in enumerate(parts)]
        )

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker and file."""
    return Codec(path)


ADDED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode_column(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Add n_tokens, ids (if ``with_ids``), ids_sha256 and decoded_sha256 of ``text``."""
    added = [f for f in ADDED if with_ids or f.name != "ids"]
    names = {f.name for f in added} | {"ids"}
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + added)
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, all_ids, shas, decoded = [], [], [], []
            for text in batch.column(place):
                ids = c.encode(text.as_py())
                n.append(len(ids) // 4)
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int64))
                shas.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
            new = [pa.array(n, pa.int64()), *([pa.array(all_ids, pa.list_(pa.int64()))] if with_ids else []), pa.array(shas), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *(f.name for f in added)])

    return docs.select(*kept).mapInArrow(run, schema)


def decode_ids(frame: DataFrame, path: str) -> DataFrame:
    """frame with ``ids`` -> the same with ``text`` decoded from them; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            texts = [None if x is None else c.decode(np.array(x, "<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(texts, pa.string())], [*kept, "text"])

    kept = [k for k in frame.columns if k != "text"]
    return frame.select(*kept).mapInArrow(run, T.StructType([*(frame.schema[k] for k in kept), T.StructField("text", T.StringType())]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_column(docs, default_vocabulary(), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op3_bpe": op3_bpe}
ORACLE: dict[str, str] = {}

"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1 is a minimal perfect hash over the vocabulary: a pre-token that is
itself a token is resolved by one probe and one comparison.  Tier 2 merges
the bytes of all other pre-tokens: a heap of candidate merges over a doubly
linked list of byte runs, lowest rank first and leftmost among equals.

The work is one narrow map over the documents, with no shuffle.  The
vocabulary is read in each Python worker from a path that is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm._shared import Memo, in_slices, keyed_text, lean, rows

#: Pre-tokens that a worker remembers in each of two generations (some 170 bytes each): bounds memory, never results.
CACHE_ENTRIES = 200_000
#: Bytes of text that a task handles at a time.
SLICE_BYTES = 4 << 20


class PerfectHash:
    """Minimal perfect hash by levels of bit arrays with rank directories.

    Keys that share a position at one level move on to the next; a key's slot
    is the number of set bits before its own.
    """

    def __init__(self, keys: list[bytes], gamma: float = 2.0):
        left = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("two keys have the same 64-bit hash")
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        before = 0
        while len(left):
            size = max(64, int(gamma * len(left)) | 1)
            at = self._positions(left, len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            ranks = np.cumsum(bits) - bits + before
            self.levels.append((size, bits, ranks.astype(np.uint32)))
            before += int(bits.sum())
            left = left[~bits[at]]

    @staticmethod
    def _positions(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (((hashes >> np.uint64(level)) ^ (hashes << np.uint64(level))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; any slot, or -1, for what is no key."""
        left = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        out, of = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = self._positions(left, level, size)
            here = bits[at]
            out[of[here]] = ranks[at[here]]
            left, of = left[~here], of[~here]
        return out


class ByteBpe:
    """A vocabulary of byte strings with merge ranks, and the pattern of its pre-tokens."""

    def __init__(self, vocabulary_path: str, pattern: str):
        self.ranks: dict[bytes, int] = {}
        with open(vocabulary_path, "rb") as lines:
            for token, rank in map(bytes.split, lines):
                self.ranks[base64.b64decode(token)] = int(rank)
        tokens = list(self.ranks)
        self.hash = PerfectHash(tokens)
        self.slot_token: list[bytes] = [b""] * len(tokens)
        self.slot_rank = [0] * len(tokens)
        for token, slot in zip(tokens, self.hash.slots(tokens).tolist()):
            self.slot_token[slot], self.slot_rank[slot] = token, self.ranks[token]
        self.token_of = {rank: token for token, rank in self.ranks.items()}
        self.pairs: list[int | None] = [self.ranks.get(bytes([a, b])) for a in range(256) for b in range(256)]
        self.pretokens: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.words = Memo(self._words, CACHE_ENTRIES)

    def _words(self, pretokens: list[str]) -> Iterator[bytes]:
        """The ids of pre-tokens: whole ones by the hash, the others merged."""
        raws = [x.encode("utf-8") for x in pretokens]
        tokens, ranks = self.slot_token, self.slot_rank
        for raw, slot in zip(raws, self.hash.slots(raws).tolist()):
            if slot >= 0 and tokens[slot] == raw:
                yield ranks[slot].to_bytes(4, "little")
            else:
                yield array("I", self.merge(raw)).tobytes()

    def merge(self, raw: bytes) -> list[int]:
        """Merge the bytes of one pre-token by rank; equal ranks from the left.

        ``end`` links each run of bytes to the next (0: merged into another),
        ``before`` to the one before; a heap entry packs rank, begin and stop.
        """
        known, pairs, n = self.ranks.get, self.pairs, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width = n.bit_length()
        low = (1 << width) - 1
        heap = []
        for i, (a, b) in enumerate(zip(raw, raw[1:])):
            rank = pairs[a << 8 | b]
            if rank is not None:
                heap.append((rank << width | i) << width | i + 2)
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, stop = entry >> width & low, entry & low
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                rank = known(raw[i : end[stop]])
                if rank is not None:
                    heappush(heap, (rank << width | i) << width | end[stop])
            h = before[i]
            if h >= 0:
                rank = known(raw[h:stop])
                if rank is not None:
                    heappush(heap, (rank << width | h) << width | stop)
        ids, i = [], 0
        while i < n:
            ids.append(known(raw[i : end[i]]))
            i = end[i]
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.words.joined([self.pretokens(x or "") for x in texts])

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.token_of.__getitem__, ids))


@lru_cache(2)
def codec(vocabulary_path: str, pattern: str) -> ByteBpe:
    """One codec for each Python worker."""
    return ByteBpe(vocabulary_path, pattern)


def encode(df: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids``: the token ids of every whole text, as ``array<int>``.

    Null and empty texts have no ids; repeated rows and null ids are each
    encoded; an empty table gives an empty one.  Other columns are left out, so names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary_path, pattern)
        for ids, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            out = [np.frombuffer(raw, dtype="<i4") for raw in bpe.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["id", "ids"])

    return keyed_text(df, id_col, text_col).mapInArrow(lambda batches: lean(run(batches)), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, bytes``: what ids stand for; null ids give null, no ids no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary_path, pattern)
        for keys, lists in rows(batches, "id", "ids"):
            out = [None if x is None else bpe.decode(x) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["id", "bytes"])

    return (
        df.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids")
        .mapInArrow(lambda batches: lean(run(batches)), "id long, bytes binary")
        .withColumnRenamed("id", id_col)
    )


def round_trip(
    df: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``): encode every whole text, decode the ids, give digests.

    ``ids_sha256`` is of the decimal ids joined by commas.  A null text counts
    as empty: no tokens and the digests of nothing.  Repeated rows and null ids
    are each encoded; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary_path, pattern)
        decimal = {rank: str(rank) for rank in bpe.token_of}.__getitem__
        for keys, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            counts, digests, decoded, lists = [], [], [], []
            for raw in bpe.encode(texts):
                ids = array("I", raw)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(np.frombuffer(raw, dtype="<i4"))
            columns = [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return keyed_text(df, id_col, text_col).mapInArrow(lambda batches: lean(run(batches)), schema).withColumnRenamed("id", id_col)

"""Token ids in directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS``.  Level 0 holds the low chunk of
every id; a bitmap marks the ids that continue, whose next chunks form the
next level, and so on.  A rank directory counts the marks before each block of
``RANK_BITS``, so the chunk of token ``i`` on the next level is found with one
lookup and one population count: any token is read without decoding others.

Documents are range-partitioned and sorted by id; each task encodes its run of
documents into files of bounded size.  A file is one row of a table in the
shared folder, so Spark's committer keeps only the files of finished tasks and
any store that Spark can write will do.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm._shared import Memo, in_slices, keyed_text, lean, rows

CHUNK_BITS, RANK_BITS = 8, 512
MAGIC = b"DAC1"
#: A file is closed once it holds so many ids; one document is never split.
FILE_IDS = 1_000_000
#: Bytes of text that a task handles at a time.
SLICE_BYTES = 4 << 20
#: Words that a worker remembers in each of two generations (some 170 bytes each): bounds memory, never results.
CACHE_ENTRIES = 200_000
#: Below this code point every character is its own NFC form; from it on, texts are cut at spaces and odd pieces are encoded as they are.
PLAIN_BELOW = "\u0250"

FILES = "part int, file int, n_docs int, n_ids long, payload binary"


# ---------------------------------------------------------------- the format


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file: the documents' ids and lengths, then the coded token ids."""
    levels, left = [], ids
    while True:
        chunk = (left & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        more = left >> CHUNK_BITS != 0
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = (np.cumsum(counts) - counts).astype(np.uint32)
        levels.append((len(left), chunk.tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        left = left[more] >> CHUNK_BITS
    keys = np.array([-1 if x is None else x for x in doc_ids], dtype="<i8").tobytes()
    known = np.packbits(np.array([x is not None for x in doc_ids], bool), bitorder="little").tobytes()
    out = [MAGIC, struct.pack("<QQI", len(doc_ids), len(ids), len(levels)), keys, known, np.array(lengths, dtype="<u8").tobytes()]
    for n, *parts in levels:
        out += [struct.pack("<Q", n), *parts]
    return b"".join(out)


class TokenFile:
    """Reads one file; ``token(i)`` touches only the chunks of that token."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_ids, n_levels = struct.unpack_from("<QQI", payload, 4)
        self._at, self._payload = 4 + 20, payload
        keys, known = self._take("<i8", n_docs), np.unpackbits(self._take("u1", (n_docs + 7) // 8), bitorder="little")
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known)]
        self.lengths = self._take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", payload, self._at)
            self._at += 8
            self.levels.append((self._take("u1", n), self._take("u1", (n + 7) // 8), self._take("<u4", -(-n // RANK_BITS))))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._payload, dtype=kind, count=n, offset=self._at)
        self._at += out.nbytes
        return out

    def token(self, i: int) -> int:
        """The id at position ``i`` of the file."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            between = bits[block * RANK_BITS // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(between).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids of the file, as unsigned 32-bit integers."""
        out = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            low = chunks.astype(np.uint32)
            if len(out):
                low[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(CHUNK_BITS)
            out = low
        return out


# ---------------------------------------------------------------- encoding


def _plain_pattern() -> re.Pattern:
    """The vocabulary's pre-tokens in lower-cased text of characters below ``PLAIN_BELOW``, with its classes spelt out."""
    plain = [chr(i) for i in range(ord(PLAIN_BELOW))]
    letters = re.escape("".join(c for c in plain if unicodedata.category(c)[0] == "L"))
    numbers = re.escape("".join(c for c in plain if unicodedata.category(c)[0] == "N"))
    space = r"\t-\r \x85\xa0"
    # lower-casing takes some letters beyond, where nothing else can be
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}{PLAIN_BELOW}-\U0010ffff]+|[{numbers}]|[^{space}{letters}{numbers}{PLAIN_BELOW}-\U0010ffff]+")


class WordEncoder:
    """The tokenizers library with a memory of words.

    The vocabulary's pre-tokens never hold white space and its normalisation
    looks at no neighbours across a space.  Text of plain Latin letters is
    lower-cased and cut into pre-tokens here, so that only words not seen before
    go to the library, many in one call.  Pieces between spaces that hold other
    characters go to it as they are, and so does a whole text with an added
    token in it.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec["added_tokens"]]
        suffix = spec["model"]["end_of_word_suffix"]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.pretokens = _plain_pattern().findall
        self.words = Memo(self._many, CACHE_ENTRIES)

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _many(self, keys: list[str]) -> list[bytes]:
        """The ids of words, odd pieces and whole texts.

        Short keys that are one plain pre-token, and so end with exactly one id
        of a word's end, go to the library joined by spaces; all others alone.
        """
        out: list[bytes] = [b""] * len(keys)
        plain = [i for i, x in enumerate(keys) if 0 < len(x) <= self.words.longest and _is_plain(x) and self.pretokens(x) == [x]]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            (found,) = self.library.encode_batch_fast([" ".join([keys[i] for i in some])], add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.kind)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some):
                raw, stops = ids.tobytes(), (ends * self.kind.itemsize).tolist()
                for i, a, b in zip(some, [0, *stops[:-1]], stops):
                    out[i] = raw[a:b]
            else:
                for i in some:
                    out[i] = self._ids(keys[i])
        for i in set(range(len(keys))).difference(plain):
            out[i] = self._ids(keys[i])
        return out

    def _cut(self, text: str) -> list[str]:
        """What the ids of a text are joined from."""
        if "<" in text and any(x in text for x in self.added):
            return [text]
        if _is_plain(text):
            return self.pretokens(text.lower())
        out = []
        for piece in text.replace("\n", " ").split(" "):
            if _is_plain(piece):
                out += self.pretokens(piece.lower())
            else:
                out.append(piece)
        return out

    def encode(self, texts: list[str | None], end: int | None = None) -> list[bytes]:
        """The ids of each text as bytes of ``kind``, with the id ``end`` after them."""
        return self.words.joined([self._cut(x or "") for x in texts], b"" if end is None else np.array([end], dtype=self.kind).tobytes())


def _is_plain(text: str) -> bool:
    """Whether all characters are below ``PLAIN_BELOW`` and lower-case to one (the dotted capital I alone gives two)."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return max(text) < PLAIN_BELOW and "\u0130" not in text


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)


def write(df: DataFrame, path: str, vocabulary_path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write the files to the folder ``path``, in ascending order of ``id_col``.

    A null or empty text is the end id alone.  Rows with a null id come first;
    rows with equal ids are ordered by their texts, and rows that repeat as a
    whole are each written.  An empty table writes no files.  Only the two named
    columns are used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, file = encoder(vocabulary_path), TaskContext.get().partitionId(), 0
        keys, found, total, width = [], [], 0, words.kind.itemsize

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(found), dtype=words.kind)
            values = [[part], [file], [len(keys)], [len(ids)], [pack(keys, [len(x) // width for x in found], ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["part", "file", "n_docs", "n_ids", "payload"])

        for some, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            for key, ids in zip(some, words.encode(texts, end_id)):
                keys.append(key)
                found.append(ids)
                total += len(ids) // width
                if total >= FILE_IDS:
                    yield close()
                    keys, found, total, file = [], [], 0, file + 1
        if keys:
            yield close()

    ordered = keyed_text(df, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(lambda batches: lean(run(batches)), FILES).write.parquet(path)


def read(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32``, from the files alone.

    ``start`` counts the ids of all documents before this one: those before it
    in its file, plus those of all files before (a running sum over the files'
    counts within a part, and over one row for each part).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, files, payloads in rows(batches, "part", "file", "payload"):
            for part, file, payload in zip(parts, files, payloads):
                one = TokenFile(payload)
                raw, ends = one.all().astype("<u4").tobytes(), np.cumsum(one.lengths)
                starts = ends - one.lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array(one.doc_ids, pa.int64()), pa.array(starts), pa.array(one.lengths), pa.array(crcs, pa.int64())],
                    ["part", "file", "id", "local", "n_tokens", "ids_crc32"],
                )

    table = spark.read.schema(FILES).parquet(path)
    index = table.select("part", "file", "n_ids")
    # one row a part, and there are as many parts as Spark has partitions
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    files = index.join(parts, "part").select(
        "part", "file", (F.col("before_part") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("file")) - F.col("n_ids")).alias("before")
    )
    docs = table.mapInArrow(lambda batches: lean(run(batches)), "part int, file int, id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(files, ["part", "file"]).select(
        F.col("id").alias(id_col), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )

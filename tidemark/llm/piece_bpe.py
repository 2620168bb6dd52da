"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All new words of a slice lie in one flat array of symbols.  A round finds the
smallest rank among the neighbouring pairs of each word, merges the leftmost
occurrences of it in all words at once, looks up only the pairs that changed,
and takes out the words in which no pair is left.

The result is that of merging one pair at a time, best first and leftmost among
equals: where a merge makes a pair that comes no later than the one merged, the
later occurrences in that word wait for another round.  Words that are not done
after ``MAX_ROUNDS`` (long ones, and long runs of spaces, whose pieces all have
the same score) are finished pair by pair on a heap, with the same result.

Texts are cut where no piece of the vocabulary can reach across, so a word is
encoded once and remembered by the worker.  The work is one narrow map over the
documents; the model is read in each Python worker from a path that is a
parameter.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from tidemark.llm._shared import Memo, in_slices, keyed_text, lean, rows

SPACE = "▁"
#: Words that a worker remembers in each of two generations (some 170 bytes each): bounds memory, never results.
CACHE_ENTRIES = 200_000
#: Bytes of text that a task handles at a time, and characters of new words that are merged together.
SLICE_BYTES, FLAT_CHARS = 4 << 20, 1 << 19
#: Rounds after which a word is finished on a heap: bounds time, never results.
MAX_ROUNDS = 64
_NONE = np.iinfo(np.int64).max
#: In decoding, each byte that is no UTF-8 becomes one U+FFFD, as in the library.
codecs.register_error("each byte", lambda e: ("\ufffd", e.start + 1))


class PieceBpe:
    """A BPE model: symbols are its pieces, and characters that only occur inside pieces."""

    def __init__(self, path: str):
        model = self.library = SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules, how = spec.normalizer_spec, spec.trainer_spec
        if how.model_type != how.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or how.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that leave text as it is, but for a space before it, are supported")
        ids = range(model.get_piece_size())
        kind = {i: spec.pieces[i].type for i in ids}
        known = spec.SentencePiece
        if any(k in (known.USER_DEFINED, known.UNUSED) for k in kind.values()) or not how.byte_fallback:
            raise ValueError("models with own or unused pieces, or without byte fallback, are not supported")
        self.end_id = model.eos_id()
        pieces = {model.id_to_piece(i): i for i in ids if kind[i] == known.NORMAL}
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if kind[i] == known.BYTE}
        self.byte_ids = [byte_ids[b] for b in range(256)]
        #: What each id stands for; control pieces stand for nothing.
        self.bytes_of = [b"" if kind[i] == known.CONTROL else b" \xe2\x81\x87 " if kind[i] == known.UNKNOWN else model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        for b, i in byte_ids.items():
            self.bytes_of[i] = bytes([b])
        self.spaced = {i for p, i in pieces.items() if p.startswith(SPACE)}
        self._symbols(pieces, {p: model.get_score(i) for p, i in pieces.items()})
        self.pieces = list(pieces)
        self.cut = self._cut_pattern(pieces).findall
        self.words = Memo(self.encode_words, CACHE_ENTRIES)

    def _symbols(self, pieces: dict[str, int], score: dict[str, float]) -> None:
        """The table of pairs: for each two symbols that join to a piece, its rank (equal scores share one) and its symbol."""
        inside = {c for p in pieces for c in p}
        symbol = {**pieces, **{c: self.size_of(pieces) + n for n, c in enumerate(sorted(inside.difference(pieces)))}}
        self.n_pieces, self.n_symbols = self.size_of(pieces), self.size_of(symbol)
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        found = sorted((symbol[p[:k]] * self.n_symbols + symbol[p[k:]], order[score[p]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.pair, self.rank, self.joined = (np.array(x, dtype=np.int64) for x in zip(*found))
        self.of_char = np.full(0x110000, -1, dtype=np.int64)
        for c in inside:
            self.of_char[ord(c)] = symbol[c]
        self.text_of = {i: p for p, i in symbol.items()}
        beside = {symbol[a] * self.n_symbols + symbol[b] for p in pieces for a, b in zip(p, p[1:])}
        self.beside = np.array(sorted(beside), dtype=np.int64)

    @staticmethod
    def size_of(symbols: dict[str, int]) -> int:
        return max(symbols.values()) + 1

    @staticmethod
    def _cut_pattern(pieces: dict[str, int]) -> re.Pattern:
        """Words with the spaces before them, and line ends on their own if no longer piece holds one."""
        longer = [p for p in pieces if len(p) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer):
            return re.compile(r"(?s).+")
        return re.compile(r" *[^ ]+| +" if any("\n" in p for p in longer) else r" *[^ \n]+| +|\n")

    # ------------------------------------------------------------ rounds

    def _look_up(self, left: np.ndarray, right: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of each pair; a rank beyond all others where there is none."""
        rank, joined = np.full(len(left), _NONE), np.full(len(left), -1, dtype=np.int64)
        at = np.flatnonzero(valid & (left >= 0) & (right >= 0))
        key = left[at] * self.n_symbols + right[at]
        slot = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[slot] == key
        rank[at[hit]], joined[at[hit]] = self.rank[slot[hit]], self.joined[slot[hit]]
        return rank, joined

    def merge(self, points: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their first positions, for the characters ``points`` of words numbered in ``word``.

        Characters in no piece are -1.  Words are first cut further, between
        characters that stand side by side in no piece.
        """
        sym, pos = self.of_char[points], np.arange(len(points))
        near = np.zeros(len(sym), bool)
        if len(sym) > 1:
            key = sym[:-1] * self.n_symbols + sym[1:]
            slot = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
            near[1:] = (word[1:] == word[:-1]) & (sym[:-1] >= 0) & (sym[1:] >= 0) & (self.beside[slot] == key)
        seg = np.cumsum(~near)
        rank, joined = self._ranks(sym, seg)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(MAX_ROUNDS):
            if not len(sym):
                break
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            left = least != _NONE
            if not left.all():  # compaction
                done.append((pos[~left], sym[~left]))
                sym, pos, seg, rank, joined, least = (x[left] for x in (sym, pos, seg, rank, joined, least))
                if not len(sym):
                    break
            sym, pos, seg, rank, joined = self._round(sym, pos, seg, rank, joined, least)
        if len(sym):
            bounds = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                keep, symbols = self._by_heap(sym[a:b].tolist())
                done.append((pos[a:b][keep], np.array(symbols, dtype=np.int64)))
        pos, sym = (np.concatenate(x) for x in zip(*done)) if done else (pos, sym)
        order = np.argsort(pos, kind="stable")
        return sym[order], pos[order]

    def _ranks(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.r_[sym[1:], -1]
        return self._look_up(sym, after, np.r_[seg[1:] == seg[:-1], False])

    def _round(self, sym, pos, seg, rank, joined, least):
        """Merge the leftmost pairs of each word's smallest rank."""
        at = np.flatnonzero(rank == least)
        run = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]  # of pairs that share symbols, each second one
        n, new, own = len(sym), joined[at], seg[at]
        # the neighbours as they are when this pair's turn comes: merged on the left, not yet on the right
        before = np.maximum(at - 1, 0)
        left = sym[before]
        follows = np.r_[False, at[1:] == at[:-1] + 2]
        left[follows] = new[np.flatnonzero(follows) - 1]
        after = np.minimum(at + 2, n - 1)
        left_rank, _ = self._look_up(left, new, (at > 0) & (seg[before] == own))
        right_rank, _ = self._look_up(new, sym[after], (at + 2 < n) & (seg[after] == own))
        early = np.minimum(left_rank, right_rank) <= rank[at]
        if early.any():
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sizes = np.diff(np.r_[first, len(at)])
            seen = np.cumsum(early) - early
            at = at[seen == np.repeat(seen[first], sizes)]  # up to and with the first of each word
            new = joined[at]
        sym[at] = new
        stays = np.ones(n, bool)
        stays[at + 1] = False
        place = np.cumsum(stays) - 1
        sym, pos, seg, rank, joined = sym[stays], pos[stays], seg[stays], rank[stays], joined[stays]
        at = place[at]
        changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
        last = np.minimum(changed + 1, len(sym) - 1)
        rank[changed], joined[changed] = self._look_up(sym[changed], sym[last], (changed + 1 < len(sym)) & (seg[last] == seg[changed]))
        return sym, pos, seg, rank, joined

    def _by_heap(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same merges for one word, pair by pair: indices of the symbols that begin one, and what they are."""
        n = len(symbols)
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap: list[tuple[int, int, int, int]] = []

        def pair(i: int, j: int) -> tuple[int, int, int, int] | None:
            key = symbols[i] * self.n_symbols + symbols[j]
            slot = int(np.searchsorted(self.pair, key))
            if slot < len(self.pair) and self.pair[slot] == key:
                return int(self.rank[slot]), i, size[i] + size[j], int(self.joined[slot])
            return None

        heap = [x for i in range(n - 1) if (x := pair(i, i + 1))]
        heapify(heap)
        while heap:
            _, i, total, into = heappop(heap)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != total:
                continue
            symbols[i], size[i], size[j] = into, total, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if x := pair(i, k):
                    heappush(heap, x)
            if before[i] >= 0 and (x := pair(before[i], i)):
                heappush(heap, x)
        keep = [i for i in range(n) if size[i]]
        return keep, [symbols[i] for i in keep]

    # ------------------------------------------------------------ texts

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word, in flat arrays of at most about ``FLAT_CHARS`` characters."""
        start = total = 0
        for i, word in enumerate(words):
            if total and total + len(word) > FLAT_CHARS:
                yield from self._flat(words[start:i])
                start, total = i, 0
            total += len(word)
        if words:
            yield from self._flat(words[start:])

    def _flat(self, words: list[str]) -> Iterator[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), dtype="<u4")
        sym, pos = self.merge(points, np.repeat(np.arange(len(words)), lengths))
        odd = np.flatnonzero((sym < 0) | (sym >= self.n_pieces))
        if len(odd):  # characters that are no piece: the ids of their bytes
            raws = [chr(points[p]).encode() for p in pos[odd].tolist()]
            times = np.ones(len(sym), dtype=np.int64)
            times[odd] = [len(r) for r in raws]
            into = np.repeat(np.isin(np.arange(len(sym)), odd), times)
            sym, pos = np.repeat(sym, times), np.repeat(pos, times)
            sym[into] = [self.byte_ids[b] for r in raws for b in r]
        ends = np.searchsorted(pos, np.cumsum(lengths)).tolist()
        raw = sym.astype("<i4").tobytes()
        for a, b in zip([0, *ends[:-1]], ends):
            yield raw[4 * a : 4 * b]

    def pieces_of(self, marked: str) -> list[str]:
        """The words of a text that has its leading space, each encoded apart from all others."""
        return self.cut(marked.replace(SPACE, " "))

    def encode(self, texts: list[str | None], end: bool = False) -> list[bytes]:
        """The ids of each text as little-endian signed 32-bit integers, with the end id if asked for; without text there are none before it."""
        last = np.array([self.end_id], dtype="<i4").tobytes() if end else b""
        return self.words.joined([self.pieces_of(" " + x) if x else [] for x in texts], last)

    def decode(self, ids: array | list[int]) -> str:
        """The text that ids stand for, without the space of the first piece."""
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        first = next((i for i in ids if self.bytes_of[i]), None)
        return out[first in self.spaced :].decode("utf-8", "each byte")


@lru_cache(2)
def codec(path: str) -> PieceBpe:
    """One codec for each Python worker."""
    return PieceBpe(path)


def encode(df: DataFrame, model_path: str, *, end: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids``: the piece ids of every whole text, as ``array<int>``.

    Null and empty texts have no ids but the end id, if that is asked for;
    repeated rows and null ids are each encoded; an empty table gives an empty
    one.  Other columns are left out, so names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path)
        for ids, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            out = [np.frombuffer(raw, dtype="<i4") for raw in model.encode(texts, end)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["id", "ids"])

    return keyed_text(df, id_col, text_col).mapInArrow(lambda batches: lean(run(batches)), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text``: what ids stand for; null ids give null, no ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path)
        for keys, lists in rows(batches, "id", "ids"):
            out = [None if x is None else model.decode(x) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["id", "text"])

    return df.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids").mapInArrow(lambda batches: lean(run(batches)), "id long, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: encode every whole text with the end id, decode the ids, give digests.

    ``ids_sha256`` is of the decimal ids joined by spaces.  A null text counts
    as empty: the end id alone and the digest of nothing.  Repeated rows and
    null ids are each encoded; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path)
        decimal = [str(i) for i in range(len(model.bytes_of))].__getitem__
        for keys, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            counts, digests, decoded = [], [], []
            for raw in model.encode(texts, end=True):
                ids = array("i", raw)
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            columns = [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return keyed_text(df, id_col, text_col).mapInArrow(lambda batches: lean(run(batches)), schema).withColumnRenamed("id", id_col)

"""Alignment of two tokenizers over the same bytes, composed from fragments.

A group is a stretch of bytes between two neighbouring offsets at which tokens
of both tokenizers end.  The tokens of a byte range form a fragment: an open
prefix (what ends with the first common offset, and may have begun before), the
closed groups behind it, and an open suffix (what comes after the last common
offset).  Fragments compose: the suffix of the left and the prefix of the right
one are joined and cut at the offsets that have become common.  The operation is
associative with the empty fragment as its unit, so the chunks of a very long
text are encoded and composed by many tasks, as a tree.

Texts are cut only where each tokenizer's tokens are sure to end, and the two
need not agree on such a place: a chunk is given to each tokenizer from its own
first place after the chunk's offset on.  Groups that are closed stay where they
are; only open parts, which are short, move between the levels of the tree.

A short text is a single chunk.  It is cut into units at places that are sure
for both tokenizers, and a worker remembers the alignment of units it has seen.

A pair of ids that overlap is counted once for each text that holds it.  The
counts go back to the texts by a join: frequent pairs, of which there cannot be
more than a bound, are broadcast; each of the others has few rows, so that a
shuffle spreads them evenly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import piece_bpe
from tidemark.llm._shared import in_slices, keyed_text, lean, rows, stored

#: Texts of more bytes are cut into chunks of about so many.
CHUNK_BYTES = 64 << 10
#: Fragments that one task composes at a time; the tree has the logarithm to this base of the most chunks of a text as its depth.
FAN = 16
#: Frequent pairs that are broadcast at most; all others are joined by a shuffle.
BROADCAST_PAIRS = 250_000
#: Bytes of text that a task handles at a time; units, and characters of them, that a worker remembers before it begins anew.
SLICE_BYTES, CACHE_ENTRIES, CACHE_CHARS = 2 << 20, 300_000, 8 << 20
#: Units that go to a library in one call.
JOINED_UNITS = 500
#: Marks that often stand right behind a word.
MARKS = ".,;:!?)]\""


# ---------------------------------------------------------------- the monoid


@dataclass
class Tokens:
    """Consecutive tokens of one tokenizer: ids, and the byte offsets at which they end."""

    ids: np.ndarray
    ends: np.ndarray

    @staticmethod
    def none() -> Tokens:
        return Tokens(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, other.ends]))

    def between(self, low: int, high: int) -> Tokens:
        """Those that end after ``low`` and not after ``high``."""
        a, b = np.searchsorted(self.ends, [low, high], side="right")
        return Tokens(self.ids[a:b], self.ends[a:b])

    def pack(self) -> bytes:
        return np.stack([self.ids, self.ends]).astype("<i8").tobytes()

    @staticmethod
    def unpack(raw: bytes) -> Tokens:
        return Tokens(*np.frombuffer(raw, "<i8").reshape(2, -1))


@dataclass
class Closed:
    """Groups from a byte offset on that nothing before or behind can change."""

    start: int
    a: Tokens
    b: Tokens


@dataclass
class Fragment:
    """``first`` and ``last`` are the outermost common offsets; without any, all tokens are in the prefix."""

    prefix: tuple[Tokens, Tokens]
    first: int | None
    last: int | None
    suffix: tuple[Tokens, Tokens]

    @staticmethod
    def empty() -> Fragment:
        return Fragment((Tokens.none(), Tokens.none()), None, None, (Tokens.none(), Tokens.none()))


_BEYOND = np.iinfo(np.int64).max


def fragment(a: Tokens, b: Tokens) -> tuple[Fragment, list[Closed]]:
    """The fragment of two streams of tokens, and its closed groups."""
    common = np.intersect1d(a.ends, b.ends)
    if not len(common):
        return Fragment((a, b), None, None, (Tokens.none(), Tokens.none())), []
    first, last = int(common[0]), int(common[-1])
    closed = [Closed(first, a.between(first, last), b.between(first, last))] if last > first else []
    return Fragment((a.between(-1, first), b.between(-1, first)), first, last, (a.between(last, _BEYOND), b.between(last, _BEYOND))), closed


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, list[Closed]]:
    """What ``left`` and ``right`` are together, and the groups that close by it; those of the two stay closed."""
    open_left = left.prefix if left.first is None else left.suffix
    a, b = (x + y for x, y in zip(open_left, right.prefix))
    middle, closed = fragment(a, b)
    prefix, first = (middle.prefix, middle.first) if left.first is None else (left.prefix, left.first)
    if left.first is not None and middle.first is not None:  # what ends at the first common offset began at the left's last one
        closed = [Closed(left.last, *(x.between(left.last, middle.last) for x in (a, b)))]
    if right.first is not None:
        return Fragment(prefix, first, right.last, right.suffix), closed
    if middle.first is not None:
        return Fragment(prefix, first, middle.last, middle.suffix), closed
    if left.first is not None:
        return Fragment(prefix, first, left.last, (a, b)), closed
    return Fragment((a, b), None, None, middle.suffix), closed


# ---------------------------------------------------------------- groups and links


def _starts(tokens: Tokens, start: int) -> np.ndarray:
    return np.concatenate([[start], tokens.ends[:-1]]).astype(np.int64) if len(tokens.ends) else tokens.ends


def links(a: Tokens, b: Tokens, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two streams that both begin at ``start`` and end together: codes of all overlapping pairs, and how many each token of ``a`` has."""
    low = np.searchsorted(b.ends, _starts(a, start), side="right")
    high = np.searchsorted(_starts(b, start), a.ends, side="left")
    counts = high - low
    which = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    return np.repeat(a.ids, counts) << 32 | b.ids[which], counts


class Decimals:
    """The ids below a bound in decimal, with each of the marks that may follow one in a group."""

    def __init__(self, bound: int):
        self.with_mark = {m: np.array([f"{i}{m}" for i in range(bound)], dtype=object) for m in ",|;"}

    def groups(self, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of two such streams the common ends, where each group begins in the list of parts, and the parts.

        The parts of a group are its ids, each with the mark behind it, as in ``a1,a2|b1;``.
        """
        common = np.intersect1d(a.ends, b.ends, assume_unique=True)
        p, q = (np.searchsorted(x.ends, common, side="right") for x in (a, b))  # tokens up to each group's end
        group_a, group_b = (np.searchsorted(common, x.ends, side="left") for x in (a, b))
        at_a = np.arange(len(a.ids)) + np.concatenate([[0], q])[group_a]
        at_b = np.arange(len(b.ids)) + p[group_b]
        parts = np.empty(len(a.ids) + len(b.ids), dtype=object)
        parts[at_a], parts[at_b] = self.with_mark[","][a.ids], self.with_mark[","][b.ids]
        parts[at_a[p - 1]], parts[at_b[q - 1]] = self.with_mark["|"][a.ids[p - 1]], self.with_mark[";"][b.ids[q - 1]]
        return common, np.concatenate([[0], p + q]), parts.tolist()


@lru_cache(1)
def decimals(bound: int) -> Decimals:
    """One table for each Python worker."""
    return Decimals(bound)


def group_texts(a: Tokens, b: Tokens) -> tuple[np.ndarray, list[str]]:
    """The common ends of two such streams, and each group as ``a1,a2|b1``."""
    bound = int(max(a.ids.max(initial=0), b.ids.max(initial=0))) + 1
    common, begins, parts = decimals(1 << bound.bit_length()).groups(a, b)
    return common, ["".join(parts[x:y])[:-1] for x, y in zip(begins[:-1].tolist(), begins[1:].tolist())]


# ---------------------------------------------------------------- the tokenizers


class Units:
    """What each stretch of text between two sure places gives, remembered in columns until there are too many."""

    def __init__(self, make: Callable[[list[str]], tuple]):
        self.make = make
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.size, self.groups = 0, []
        #: For each unit: whether both tokenizers give its bytes, its tokens of A and B, groups and links; then all links.
        self.columns, self.pairs = np.zeros((5, 0), np.int64), np.zeros(0, np.int64)

    def of(self, units: list[str]) -> np.ndarray:
        """The numbers of units, after new ones have been aligned; valid until the next call."""
        if len(self.number) > CACHE_ENTRIES or self.size > CACHE_CHARS:
            self.forget()
        new = list(set(units).difference(self.number))
        if new:
            new, columns, groups, pairs = self.make(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.size += sum(map(len, new))
            self.columns, self.pairs = np.concatenate([self.columns, columns], axis=1), np.concatenate([self.pairs, pairs])
            self.groups += groups
        return np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))


def _byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(0x100 + n): b for n, b in enumerate(others)}}


class Aligner:
    """A byte-level BPE of the tokenizers library (A) and a piece BPE (B), both given a text with a space before it."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = piece_bpe.codec(b_path)
        byte_of, vocabulary = _byte_characters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b.bytes_of))
        #: A's words begin with white space after anything else; B's begin with a space after anything else.
        self.sure = {"a": re.compile(r"(?<=\S)\s"), "b": re.compile(r"(?<=[^ ]) ")}
        self.places, self.marks = self._places()
        self.odd_space = re.compile(r"\s ").search
        self.units = Units(self._align)
        self.all_b = len(self.b.bytes_of)

    def tokens_of(self, which: str, text: str, start: int) -> tuple[Tokens, bool]:
        """The tokens of a stretch of text that begins at a sure place, and whether they give its bytes."""
        if which == "a":
            ids, table, sizes = np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.int64), self.a_bytes, self.a_sizes
        else:
            (raw,) = self.b.words.joined([self.b.pieces_of(text)])
            ids, table, sizes = np.frombuffer(raw, "<i4").astype(np.int64), self.b.bytes_of, self.b_sizes
        return Tokens(ids, start + np.cumsum(sizes[ids])), b"".join([table[i] for i in ids.tolist()]) == text.encode()

    def _places(self) -> tuple[re.Pattern, str]:
        """Places where units begin: a space after anything but white space, line ends, and marks after a letter.

        A's words end before white space, and those of letters before any mark; a
        single line end is a token of A (of several, the last one is, and only if
        more text follows).  Such a place is sure for B where none of its pieces
        reaches across it.
        """
        letter = re.compile(r"[^\W\d_]").match
        inside = {y for piece in self.b.pieces for x, y in zip(piece, piece[1:]) if letter(x)}
        marks = "".join(m for m in MARKS if m not in inside)
        lines = "" if any("\n" in piece for piece in self.b.pieces if len(piece) > 1) else r"|(?<=\S)(?=\n)|(?<=\S\n)(?=\S)"
        return re.compile(r"(?<=\S)(?= )" + lines + (rf"|(?<=[^\W\d_])(?=[{re.escape(marks)}])" if marks else "")), marks

    def cut(self, marked: str) -> list[str]:
        """The units of a text that has its leading space."""
        if self.odd_space(marked):
            return self.places.split(marked)
        out, marks, split = [], self.marks, self.places.split
        for word in marked.split(" ")[1:]:  # plain words need no pattern
            if word.isalpha():
                out.append(" " + word)
            elif word[-1:] in marks and word[:-1].isalpha():
                out += (" " + word[:-1], word[-1])
            else:
                out += split(" " + word)
        return out

    def _tokens(self, plain: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of both tokenizers for all units, one after the other, and how many each unit has.

        Plain units begin with a space and end with anything but white space, so
        they go to the libraries joined; each of the rest is encoded alone.
        """
        found: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(plain), JOINED_UNITS):
            some = plain[at : at + JOINED_UNITS]
            joined, ends = "".join(some), np.cumsum([len(u.encode()) for u in some])
            a = self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            for k, ids, sizes in ((0, a, self.a_sizes), (2, self.b.library.encode(joined[1:]), self.b_sizes)):
                ids = np.array(ids, dtype=np.int64)
                found[k].append(ids)
                found[k + 1].append(np.diff(np.searchsorted(np.cumsum(sizes[ids]), ends, side="right"), prepend=0))
        if rest:
            a = [x.ids for x in self.a.encode_batch_fast(rest, add_special_tokens=False)]
            pieces = [self.b.pieces_of(u) for u in rest]
            b = list(self.b.encode_words(list(chain.from_iterable(pieces))))
            ends = np.cumsum([0] + [len(x) // 4 for x in b])[np.cumsum([0] + [len(x) for x in pieces])]
            more = np.fromiter(chain.from_iterable(a), np.int64), np.fromiter(map(len, a), np.int64, len(a)), np.frombuffer(b"".join(b), "<i4").astype(np.int64), np.diff(ends)
            for one, x in zip(found, more):
                one.append(x)
        return tuple(np.concatenate(x) for x in found)  # type: ignore[return-value]

    def _gives(self, units: list[str], tokens: tuple[np.ndarray, ...]) -> bool:
        """Whether the tokens of all units are the units' own bytes."""
        a, n_a, b, n_b = tokens
        raw = [u.encode() for u in units]
        ends, whole = np.cumsum([len(r) for r in raw]), b"".join(raw)
        at = [np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum(n)] for ids, n, sizes in ((a, n_a, self.a_sizes), (b, n_b, self.b_sizes))]
        if not ((at[0] == ends).all() and (at[1] == ends).all()):
            return False
        return b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole == b"".join(map(self.b.bytes_of.__getitem__, b.tolist()))

    def _align(self, units: list[str]) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
        """New units, aligned all at once, as if they stood one after the other: the units in a new order, columns, groups and links."""
        plain = [u for u in units if u[0] == " " and not u[-1].isspace()]
        rest = [u for u in units if u[0] != " " or u[-1].isspace()]
        units, tokens = plain + rest, self._tokens(plain, rest)
        if not self._gives(units, tokens):  # some are bad: halve until they stand alone
            if len(units) == 1:
                return units, np.zeros((5, 1), np.int64), [""], np.zeros(0, np.int64)
            half = len(units) // 2
            (u, c, g, p), (v, d, h, q) = self._align(units[:half]), self._align(units[half:])
            return u + v, np.concatenate([c, d], axis=1), g + h, np.concatenate([p, q])
        a, n_a, b, n_b = tokens
        left, right = Tokens(a, np.cumsum(self.a_sizes[a])), Tokens(b, np.cumsum(self.b_sizes[b]))
        pairs, counts = links(left, right, 0)
        common, begins, parts = decimals(1 << max(len(self.a_bytes), self.all_b).bit_length()).groups(left, right)
        token_ends = np.cumsum(n_a)
        group_ends = np.searchsorted(common, left.ends[token_ends - 1], side="right")
        link_ends = np.concatenate([[0], np.cumsum(counts)])[token_ends]
        bounds = [0, *begins[group_ends].tolist()]
        groups = ["".join(parts[x:y]) for x, y in zip(bounds, bounds[1:])]
        ok = np.ones(len(units), np.int64)
        return units, np.stack([ok, n_a, n_b, np.diff(group_ends, prepend=0), np.diff(link_ends, prepend=0)]), groups, pairs

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Whole texts: their tokens of A and B and groups, the groups' texts, and the distinct links of each.

        The links are three arrays: where each text's begin, the codes, and how often each occurs in the text.
        """
        cut = [self.cut(" " + t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        units = self.units.of(list(chain.from_iterable(cut)))
        doc = np.repeat(np.arange(len(cut)), sizes)
        known = self.units.columns[:, units]
        good = np.bincount(doc, weights=1 - known[0], minlength=len(cut)) == 0
        known *= good[doc]
        totals = np.stack([np.bincount(doc, weights=known[i], minlength=len(cut)).astype(np.int64) for i in (1, 2, 3)])
        numbers, ends, groups = units.tolist(), np.cumsum(sizes).tolist(), self.units.groups
        joined = ["".join([groups[u] for u in numbers[x:y]])[:-1] if ok else "" for x, y, ok in zip([0, *ends[:-1]], ends, good.tolist())]
        begins = np.cumsum(self.units.columns[4]) - self.units.columns[4]
        counts = known[4]
        at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins[units], counts)
        code = self.units.pairs[at]
        span = len(self.a_bytes) * self.all_b
        key, times = np.unique(np.repeat(doc, counts) * span + (code >> 32) * self.all_b + (code & 0xFFFFFFFF), return_counts=True)
        starts = np.searchsorted(key, np.arange(len(cut) + 1) * span)
        pair = key % span
        return totals, joined, starts, pair // self.all_b << 32 | pair % self.all_b, times.astype(np.int64)


@lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(a_path, b_path)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, times = np.unique(codes, return_counts=True)
    return kinds, times.astype(np.int64)


# ---------------------------------------------------------------- Spark

_DOC = "key long, id long, n_a long, n_b long, n_groups long, digest string, codes array<long>, times array<long>, groups string"
_CHUNK = "key long, id long, chunk int, a_start long, a_text string, b_start long, b_text string"
#: kind 0: closed groups of a text from the offset ``start`` on; kind 1: a fragment, with the chunk it begins with.
_PART = "kind int, key long, id long, chunk int, start long, n_a long, n_b long, bad boolean, n_groups long, groups string, codes array<long>, times array<long>, pre_a binary, pre_b binary, first long, last long, suf_a binary, suf_b binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batch(schema: str, records: list[dict]) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in records], _ARROW[kind]) for name, kind in fields], [name for name, _ in fields])


def _short(docs: DataFrame, a_path: str, b_path: str, with_groups: bool) -> DataFrame:
    """Texts of one chunk, each with its distinct links; the key is that of the task and a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, key = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        for ids, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            totals, groups, starts, codes, times = both.texts(texts)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            listed = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int64())) for x in (codes, times)]
            kept = pa.array(groups if with_groups else [None] * len(ids), pa.string())
            keys = pa.array(np.arange(key, key + len(ids)))
            key += len(ids)
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.int64()), *map(pa.array, totals), pa.array(digests, pa.string()), *listed, kept], [f.split(" ")[0] for f in _DOC.split(", ")])

    return docs.mapInArrow(lambda batches: lean(run(batches)), _DOC)


def _chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int) -> DataFrame:
    """Long texts as chunks; each tokenizer's part begins at its first sure place after the chunk's first byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for keys, ids, texts in rows(in_slices(batches, "text", SLICE_BYTES), "key", "id", "text"):
            for key, doc_id, text in zip(keys, ids, texts):
                marked = " " + text
                raw, places, at = marked.encode(), [0], 0
                for x in range(chunk_bytes, len(raw), chunk_bytes):
                    while raw[x : x + 1] and raw[x] & 0xC0 == 0x80:
                        x += 1
                    places.append(places[-1] + len(raw[at:x].decode()))
                    at = x
                cuts = {}
                for name, pattern in both.sure.items():
                    found = [0, *(m.start() if (m := pattern.search(marked, p)) else len(marked) for p in places[1:]), len(marked)]
                    cuts[name] = [(marked[p:q]) for p, q in zip(found, found[1:])]
                starts = {name: np.cumsum([0] + [len(t.encode()) for t in some]).tolist() for name, some in cuts.items()}
                for n, (a_text, b_text) in enumerate(zip(cuts["a"], cuts["b"])):
                    if a_text or b_text:
                        yield _batch(_CHUNK, [{"key": key, "id": doc_id, "chunk": n, "a_start": starts["a"][n], "a_text": a_text, "b_start": starts["b"][n], "b_text": b_text}])

    keyed = docs.select((-1 - F.monotonically_increasing_id()).alias("key"), "id", "text")
    return keyed.mapInArrow(lambda batches: lean(run(batches)), _CHUNK).repartition("key", "chunk")


def _closed_part(key: int, closed: Closed) -> dict:
    _, texts = group_texts(closed.a, closed.b)
    codes, times = _distinct(links(closed.a, closed.b, closed.start)[0])
    return {"kind": 0, "key": key, "start": closed.start, "n_a": 0, "n_b": 0, "bad": False, "n_groups": len(texts), "groups": ";".join(texts), "codes": codes, "times": times}


def _open_part(key: int, chunk: int, one: Fragment) -> dict:
    packed = dict(zip(("pre_a", "pre_b", "suf_a", "suf_b"), (x.pack() for x in (*one.prefix, *one.suffix))))
    return {"kind": 1, "key": key, "chunk": chunk, "first": one.first, "last": one.last, **packed}


def _fragments(chunks: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each chunk as its fragment and its closed groups, with the counts of its tokens in a row of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for columns in rows(in_slices(batches, "a_text", SLICE_BYTES), *(f.split(" ")[0] for f in _CHUNK.split(", "))):
            for key, doc_id, chunk, a_start, a_text, b_start, b_text in zip(*columns):
                (a, good_a), (b, good_b) = both.tokens_of("a", a_text, a_start), both.tokens_of("b", b_text, b_start)
                one, closed = fragment(a, b)
                counts = {"kind": 0, "key": key, "id": doc_id, "start": -1, "n_a": len(a.ids), "n_b": len(b.ids), "bad": not (good_a and good_b), "n_groups": 0, "codes": [], "times": []}
                yield _batch(_PART, [counts, *(_closed_part(key, c) for c in closed), _open_part(key, chunk, one)])

    return chunks.mapInArrow(lambda batches: lean(run(batches)), _PART)


def _compose_group(table: pa.Table, fan: int) -> pa.Table:
    """Up to ``fan`` neighbouring fragments as one; the groups between them close."""
    out, one, key, chunk = [], Fragment.empty(), None, 0
    for r in sorted(table.to_pylist(), key=lambda r: r["chunk"]):
        key, chunk = r["key"], r["chunk"] // fan
        pre_a, pre_b, suf_a, suf_b = (Tokens.unpack(r[n]) for n in ("pre_a", "pre_b", "suf_a", "suf_b"))
        one, closed = compose(one, Fragment((pre_a, pre_b), r["first"], r["last"], (suf_a, suf_b)))
        out += [_closed_part(key, c) for c in closed]
    return pa.Table.from_batches([_batch(_PART, [*out, _open_part(key, chunk, one)])])


def _heads(fragments: DataFrame) -> DataFrame:
    """The first group of each text, from the one fragment that is left of it; a text whose tokens do not end together is bad."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, pre_a, pre_b, firsts, suf_a, suf_b in rows(batches, "key", "pre_a", "pre_b", "first", "suf_a", "suf_b"):
            out = []
            for key, a, b, first, *rest in zip(keys, pre_a, pre_b, firsts, suf_a, suf_b):
                bad = first is None or any(rest)
                part = _closed_part(key, Closed(0, *(Tokens.none() if bad else Tokens.unpack(x) for x in (a, b))))
                out.append({**part, "bad": bad})
            yield _batch(_PART, out)

    return fragments.mapInArrow(run, _PART)


def _digests(parts: DataFrame, with_groups: bool) -> DataFrame:
    """One row for each long text, from its closed parts in the order of their offsets; only the state of a digest is kept between rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def finish(x: dict) -> dict:
            bad = x["bad"]
            digest = "" if bad else x["hash"].hexdigest()
            counts = {n: 0 if bad else x[n] for n in ("n_a", "n_b", "n_groups")}
            return {"key": x["key"], "id": x["id"], **counts, "digest": digest, "codes": [], "times": [], "groups": ("" if bad else ";".join(x["all"])) if with_groups else None}

        for columns in rows(batches, "key", "id", "start", "n_a", "n_b", "bad", "n_groups", "groups"):
            out = []
            for key, doc_id, start, n_a, n_b, bad, n_groups, groups in zip(*columns):
                if now is None or now["key"] != key:
                    if now:
                        out.append(finish(now))
                    now = {"key": key, "id": None, "n_a": 0, "n_b": 0, "n_groups": 0, "bad": False, "hash": hashlib.sha256(), "all": []}
                if start < 0:
                    now["id"] = doc_id
                now["n_a"], now["n_b"], now["bad"] = now["n_a"] + n_a, now["n_b"] + n_b, now["bad"] or bad
                if n_groups:
                    now["hash"].update((b";" if now["n_groups"] else b"") + groups.encode())
                    now["n_groups"] += n_groups
                    if with_groups:
                        now["all"].append(groups)
            if out:
                yield _batch(_DOC, out)
        if now:
            yield _batch(_DOC, [finish(now)])

    ordered = parts.select("key", "id", "start", "n_a", "n_b", "bad", "n_groups", "groups").repartition("key").sortWithinPartitions("key", "start")
    return ordered.mapInArrow(run, _DOC)


def _long(docs: DataFrame, most_bytes: int, a_path: str, b_path: str, with_groups: bool, chunk_bytes: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Texts of several chunks, and their distinct links: encoded by chunk, composed as a tree."""
    chunks = stored(_chunks(docs, a_path, b_path, chunk_bytes), "chunks")
    level = stored(_fragments(chunks, a_path, b_path), "fragments")
    parts, most = [level.where("kind = 0")], most_bytes // chunk_bytes + 2
    while most > 1:
        grouped = level.where("kind = 1").groupBy("key", F.expr(f"chunk div {fan}").alias("upper"))
        level = stored(grouped.applyInArrow(lambda table: _compose_group(table, fan), _PART), "fragments")
        parts.append(level.where("kind = 0"))
        most = -(-most // fan)
    closed = _heads(level.where("kind = 1"))
    for some in parts:
        closed = closed.unionByName(some)
    digests = stored(_digests(closed, with_groups), "digests")
    good = digests.where("digest <> ''").select("key")
    one = closed.select("key", F.posexplode("codes").alias("at", "code"), "times").selectExpr("key", "code", "times[at] AS times")
    return digests, stored(one.groupBy("key", "code").agg(F.sum("times").alias("times")).join(good, "key", "left_semi"), "links")


@dataclass
class Alignment:
    """Stored results: ``docs`` (key, id, n_a, n_b, n_groups, digest, groups), ``links`` (key, code, times), ``pairs`` (code, n_docs, best)."""

    docs: DataFrame
    links: DataFrame
    pairs: DataFrame

    def id_pairs(self) -> DataFrame:
        """``a_id, b_id, n_docs, best``: in how many texts two ids overlap, and whether no other id of B does so with A's in more."""
        return self.pairs.selectExpr("CAST(shiftright(code, 32) AS INT) AS a_id", "CAST(code & 4294967295 AS INT) AS b_id", "n_docs", "best")


def align(df: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> Alignment:
    """Align every whole text of ``df``; ``with_groups`` keeps the groups of each text as one string.

    Texts of more than ``chunk_bytes`` are dealt out as chunks, whose fragments
    are composed ``fan`` at a time; neither changes a result.

    Null and empty texts, and those whose bytes one of the tokenizers does not
    give back, have no tokens.  Each row is a text of its own, so repeated rows
    count twice and ids may be null; an empty table gives empty results.  Only
    the two named columns are used.
    """
    docs = keyed_text(df, id_col, text_col)
    most = docs.where(F.octet_length("text") > chunk_bytes).agg(F.max(F.octet_length("text"))).first()[0]
    short = docs if most is None else docs.where(F.expr(f"coalesce(octet_length(text), 0) <= {chunk_bytes}"))
    table = stored(_short(short, a_path, b_path, with_groups), "aligned")
    links_ = table.select("key", F.posexplode("codes").alias("at", "code"), "times").selectExpr("key", "code", "times[at] AS times")
    if most is not None:
        long, more = _long(docs.where(F.octet_length("text") > chunk_bytes), most, a_path, b_path, with_groups, chunk_bytes, fan)
        table, links_ = table.unionByName(long), links_.unionByName(more)
    counted = links_.groupBy("code").agg(F.count("*").alias("n_docs"))
    # one id of A has at most as many rows as B has ids
    most_of = F.max("n_docs").over(Window.partitionBy(F.shiftright("code", 32)))
    pairs = stored(counted.withColumn("best", F.col("n_docs") == most_of), "pairs")
    return Alignment(table.drop("codes", "times"), links_, pairs)


def _least_count(pairs: DataFrame) -> int:
    """A count that at most ``BROADCAST_PAIRS`` pairs reach; counts are told apart by their powers of two."""
    sizes = {r.power: r["count"] for r in pairs.groupBy(F.expr("length(bin(n_docs)) - 1").alias("power")).count().collect()}
    total, least = 0, 1 << 62
    for power in sorted(sizes, reverse=True):
        total += sizes[power]
        if total > BROADCAST_PAIRS:
            break
        least = 1 << power if power > min(sizes) else 0
    return least


def report(df: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """One row for each row of ``df``: counts, the sums over its links, and the digest of its groups ('' without tokens)."""
    found = align(df, a_path, b_path, id_col=id_col, text_col=text_col, chunk_bytes=chunk_bytes, fan=fan)
    least = _least_count(found.pairs)
    sums = [F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")]
    parts = found.links.join(F.broadcast(found.pairs.where(F.col("n_docs") >= least)), "code").groupBy("key").agg(*sums)
    if least:  # pairs of fewer texts than that: no key has many rows
        rest = found.pairs.where(F.col("n_docs") < least).hint("merge")
        parts = parts.unionByName(found.links.join(rest, "code").groupBy("key").agg(*sums)).groupBy("key").agg(*(F.sum(n).alias(n) for n in ("n_links", "n_best", "count_sum")))
    none = F.lit(0).cast("long")
    return found.docs.join(parts, "key", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", *(F.coalesce(n, none).alias(n) for n in ("n_links", "n_best", "count_sum")), F.col("digest").alias("groups_sha256")
    )

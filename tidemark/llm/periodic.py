"""Periodic runs of words, found on a harmonic grid with LCE queries on a recompression grammar.

A run of period q that holds at least 4q words covers four neighbouring points
of the grid 0, q, 2q, ... of its text.  For each q the words at four such points
are compared, which costs the harmonic sum of the length; where they are equal,
the run through them is extended to both sides.

How far two positions agree is asked of a grammar.  Recompression makes it:
stretches of one symbol become a symbol (block compression), then pairs of a
left and a right symbol become one (pair compression), until texts are short or
nothing can be joined.  Equal stretches get equal symbols but for a few at their
ends, so a query climbs the levels, compares a bounded number of symbols on each,
and goes down again at the first that differs: no suffix arrays, and time
logarithmic in the length.  All queries of a slice go through the levels at once.

The texts of a slice share one grammar, with a symbol of its own between them.
The work is one narrow map over the documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._shared import in_slices, keyed_text, lean, rows

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that a task handles at a time (one text at least).
SLICE_BYTES = 2 << 20
#: Grid points that are compared at a time: bounds memory, never results.
BLOCK_POINTS = 1 << 20
#: Turns in which only the first point of each chain is asked for.
CHAIN_TURNS = 3


class _Level:
    """One sequence of symbols: for each, how many of the same stand from it on, and the next level's symbol that holds it."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        n = len(symbols)
        changes = np.flatnonzero(np.r_[symbols[1:] != symbols[:-1], True]) if n else np.zeros(0, np.int64)
        #: Where the stretch of equal symbols of each position ends (exclusive).
        self.stretch_end = np.repeat(changes + 1, np.diff(np.r_[-1, changes]))
        self.parent: np.ndarray | None = None
        self.first: np.ndarray | None = None


class Grammar:
    """A run-length grammar of one sequence; positions compare through its levels."""

    def __init__(self, symbols: np.ndarray):
        self.levels = [_Level(symbols)]
        next_symbol = int(symbols.max(initial=0)) + 1
        while (before := len(self.levels[-1].symbols)) > 1:
            low = self.levels[-1]
            for step in (self._blocks, self._pairs):
                starts, made, next_symbol = step(low, next_symbol)
                low.first = starts
                begins = np.zeros(len(low.symbols), np.int64)
                begins[starts] = 1
                low.parent = np.cumsum(begins) - 1
                low = _Level(made)
                self.levels.append(low)
            if len(low.symbols) == before or len(np.unique(low.symbols)) == len(low.symbols):
                break  # nothing was joined, or no two positions agree any more

    @staticmethod
    def _blocks(level: _Level, next_symbol: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Stretches of one symbol become the symbol of (what, how many); single ones stay."""
        s = level.symbols
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        sizes = level.stretch_end[starts] - starts
        made = s[starts].copy()
        many = np.flatnonzero(sizes > 1)
        if len(many):
            _, number = np.unique(made[many] * (int(sizes.max()) + 1) + sizes[many], return_inverse=True)
            made[many] = next_symbol + number
            next_symbol += int(number.max()) + 1
        return starts, made, next_symbol

    @staticmethod
    def _pairs(level: _Level, next_symbol: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Symbols are left or right by a hash of theirs, another one on each level; a left one and the right one after it become one symbol."""
        s = level.symbols
        mixed = (s.astype(np.uint64) + np.uint64(next_symbol)) * np.uint64(0x9E3779B97F4A7C15)
        for shift in (30, 27):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
        right = mixed >> np.uint64(63) == 1
        joins = np.r_[~right[:-1] & right[1:], False]
        starts = np.flatnonzero(~np.r_[False, joins[:-1]])
        made = s[starts].copy()
        two = np.flatnonzero(joins[starts])
        if len(two):
            at = starts[two]
            kinds, number = np.unique(s[at] * (int(s.max()) + 1) + s[at + 1], return_inverse=True)
            made[two] = next_symbol + number
            next_symbol += len(kinds)
        return starts, made, next_symbol

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each i < j, how many symbols from i on equal those from j on.

        ``i`` and ``j`` move together.  On the way up, while they agree and one
        of them stands inside the symbol above it, a stretch of equal symbols is
        passed at once; two positions that both begin a symbol above climb.
        Where symbols differ, the query is at its top, and goes down through
        first children, passing what agrees on each level.
        """
        n = len(self.levels[0].symbols)
        i, j = i.astype(np.int64).copy(), j.astype(np.int64).copy()
        tops = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for height, level in enumerate(self.levels):
            tops[live] = height
            if level.parent is None or not len(live):
                break
            moving, climbs = live, []
            while len(moving):
                a, b = i[moving], j[moving]
                inside = b < len(level.symbols)
                begin_a, begin_b = self._begins(level, a), self._begins(level, b)
                up = inside & begin_a & begin_b
                climbs.append(moving[up])
                moving = moving[inside & ~up]
                moving = self._pass(level, i, j, moving)
            live = np.concatenate(climbs) if climbs else live[:0]
            i[live], j[live] = level.parent[i[live]], level.parent[j[live]]
        for height in range(len(self.levels) - 1, -1, -1):
            level = self.levels[height]
            moving = np.flatnonzero(tops >= height)
            while len(moving):
                moving = self._pass(level, i, j, moving)
            if height:
                below = self.levels[height - 1]
                first = np.append(below.first, len(below.symbols))
                down = np.flatnonzero(tops >= height)
                i[down], j[down] = first[i[down]], first[j[down]]
        assert (j <= n).all()
        return i

    @staticmethod
    def _begins(level: _Level, at: np.ndarray) -> np.ndarray:
        """Whether positions begin a symbol of the next level."""
        near = np.minimum(at, len(level.symbols) - 1)
        return level.first[level.parent[near]] == near

    @staticmethod
    def _pass(level: _Level, i: np.ndarray, j: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Move the pairs ``which`` over one stretch of equal symbols; those that moved are returned."""
        which = which[j[which] < len(level.symbols)]
        a, b = i[which], j[which]
        same = level.symbols[a] == level.symbols[b]
        which, a, b = which[same], a[same], b[same]
        step = np.minimum(level.stretch_end[a] - a, level.stretch_end[b] - b)
        i[which], j[which] = a + step, b + step
        return which


# ---------------------------------------------------------------- runs


def _candidates(words: np.ndarray, base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, period and first position of all grid points from which four hold the same word."""
    periods = np.where(n >= LEAST_WORDS, n // LEAST_PERIODS, 0)
    text = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    counts = (n[text] - 1) // period - (LEAST_PERIODS - 2)
    ends = np.cumsum(counts)
    out, at = [], 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_POINTS, "right")))
        some = np.repeat(np.arange(at, stop), counts[at:stop])
        q = period[some]
        x = base[text[some]] + (np.arange(len(some)) - np.repeat(ends[at:stop] - counts[at:stop] - (ends[at - 1] if at else 0), counts[at:stop])) * q
        for k in range(1, LEAST_PERIODS):
            same = words[x] == words[x + k * q]
            some, q, x = some[same], q[same], x[same]
        out.append((text[some], q, x))
        at = stop
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (text, period, text)  # type: ignore[return-value]


def runs_of(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All maximal runs of several texts, whose words lie one text after the other: text, start, length, smallest period.

    Sorted by text, start and period.  Texts without candidates are no part of the grammar.
    """
    base = np.cumsum(n) - n
    text, q, x = _candidates(words, base, n)
    with_any = np.unique(text)
    sizes = n[with_any]
    # those texts one after the other, each with a symbol of its own behind it
    new_base = np.cumsum(sizes + 1) - (sizes + 1)
    flat = int(words.max(initial=0)) + 1 + np.repeat(np.arange(len(with_any)), sizes + 1)
    inside = np.ones(len(flat), bool)
    inside[new_base + sizes] = False
    flat[inside] = words[np.repeat(base[with_any], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    forward, backward, last = Grammar(flat), Grammar(flat[::-1].copy()), len(flat) - 1
    of = np.searchsorted(with_any, text)
    x = x - base[text] + new_base[of]
    order = np.lexsort((x, q, text))
    of, q, x = of[order], q[order], x[order]
    found = []
    for turn in count():  # the first of each chain of neighbouring grid points; what its run covers needs no query of its own
        if not len(x):
            break
        lead = np.r_[True, (of[1:] != of[:-1]) | (q[1:] != q[:-1]) | (x[1:] != x[:-1] + q[1:])]
        if turn >= CHAIN_TURNS:  # mostly points that are in no run: a block of them at once
            lead[:BLOCK_POINTS] = True
        a, b = x[lead], x[lead] + q[lead]
        right = forward.lce(a, b)
        start, end = last + 1 - backward.lce(last + 1 - b, last + 1 - a), right + q[lead]
        start -= q[lead]
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q[lead])
        found.append((of[lead][long], start[long], end[long], q[lead][long]))
        rest = ~lead & (x + q >= end[np.cumsum(lead) - 1])
        of, q, x = of[rest], q[rest], x[rest]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    of, start, end, q = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((q, end, start))
    of, start, end, q = of[order], start[order], end[order], q[order]
    least = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
    of, start, end, q = of[least], start[least], end[least], q[least]
    order = np.lexsort((q, start))
    return with_any[of][order], (start - new_base[of])[order], (end - start)[order], q[order]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the words of a text are made periodic, and with which period; None for nine of ten ids and for null."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    return (a := g % n), 1 + (n - a) // (3 + g % 8)


def _texts(keys: list[int | None], texts: list[str | None], plant: Callable[[int | None, int], tuple[int, int] | None] | None):
    """Words of each text, and the runs of all in one go: (key, words, starts, lengths, periods, kept words)."""
    number: dict[bytes, int] = {}
    cut, ids = [], []
    for key, text in zip(keys, texts):
        words = (text or "").encode().split()
        made = plant(key, len(words)) if plant else None
        if made:
            a, p = made
            words = words[:a] + (words[a : a + p] * (-(-(len(words) - a) // p)))[: len(words) - a]
        cut.append(words)
        ids.extend([number.setdefault(w, len(number)) for w in words])
    text, start, length, period = runs_of(np.array(ids, dtype=np.int64), np.array([len(w) for w in cut], dtype=np.int64))
    bounds = np.searchsorted(text, np.arange(len(cut) + 1)).tolist()
    for key, words, a, b in zip(keys, cut, bounds, bounds[1:]):
        kept = words
        if a < b:
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, start[a:b] + period[a:b], 1)
            np.add.at(cover, start[a:b] + length[a:b], -1)
            kept = [w for w, dropped in zip(words, np.cumsum(cover[:-1]).tolist()) if not dropped]
        yield key, words, start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), kept


def collapse(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, runs, text``: the runs of every whole text, and its words without the repetitions, joined by spaces.

    ``runs`` is an array of (start, length, period), by start and then period.  Words
    are divided by ASCII white space.  A null or empty text has no runs and gives an
    empty one; repeated rows and null ids are each treated; an empty table gives an
    empty one.  Other columns are left out, so names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for keys, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            out = [([{"start": s, "length": n, "period": q} for s, n, q in zip(*runs)], b" ".join(kept).decode()) for _, _, *runs, kept in _texts(keys, texts, None)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([r for r, _ in out], kind), pa.array([t for _, t in out], pa.string())], ["id", "runs", "text"])

    schema = "id long, runs array<struct<start long, length long, period long>>, text string"
    return keyed_text(df, id_col, text_col).mapInArrow(lambda batches: lean(run(batches)), schema).withColumnRenamed("id", id_col)


def report(df: DataFrame, *, plant: Callable[[int | None, int], tuple[int, int] | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: how many runs, the longest (smallest start, then period, among equals), and digests.

    ``plant`` may make texts periodic first, as ``planted`` does.  Odd rows are
    treated as in ``collapse``; without runs the four numbers are null and
    ``runs_sha256`` is that of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            out = []
            for key, _, starts, lengths, periods, kept in _texts(keys, texts, plant):
                runs = list(zip(starts, lengths, periods))
                s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                out.append((key, len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    schema = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return keyed_text(df, id_col, text_col).mapInArrow(lambda batches: lean(run(batches)), schema).withColumnRenamed("id", id_col)

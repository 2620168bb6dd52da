"""Repeated byte strings of a collection, by column-wise suffix sorting.

A byte goes if a ``SPAN``-byte string that covers it also starts elsewhere.

Buckets.  Of the ``GRAM``-byte grams of a window of ``SPAN`` bytes, the one
with the smallest hash (the leftmost of equals) depends on the window alone, so
equal windows have equal smallest grams at equal places.  Successive windows
with the same smallest gram form a run; runs are dealt out by its hash.  A run
whose bytes occur twice is repeated as a whole; a gram that occurs once repeats
nothing.  Only grams with several different runs are left: their runs, each
content once, are a collection of short strings that share a gram.

Columns.  Such a collection is sorted column by column from the right, one
symbol of every string a round: the strings are in the order of their suffixes,
the inserted symbols (this round's part of the Burrows-Wheeler transform) move
them stably, and the common prefixes of neighbours grow by one where symbols
agree and fall to the least between them otherwise.  The shared gram is a
single column, so a window is ``WIDTH`` columns wide; where neighbours share
that many, the windows that begin in this column are equal.  A bucket's
collection is bounded, so the arrays of a round stay in memory in place of the
method's external files.  Grams with more than ``HOT_RUNS`` different runs are
split: each of their windows is grouped by its own hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import give_back, in_slices, lean, rows, stored

SPAN, GRAM = 200, 64
#: Places of a gram in a window, and columns of a window once its gram is one.
PLACES, WIDTH = SPAN - GRAM + 1, SPAN - GRAM + 1
HOT_RUNS = 20_000
#: Low bits of a gram's hash that give way to its place, always as many, so that the choice depends on the window alone.
PLACE_BITS = 31
#: Bytes hashed at a time; one longer text is still handled whole.
SLICE_BYTES = 2 << 20
#: Bits of the filter that keeps untouched texts out of the shuffle: its size is fixed.
FILTER_BITS = 1 << 24

_U = np.uint64
_NONE = ~_U(0)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Hashes of any stretches of bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = (np.full(len(data) + 1, _U(x)) for x in (_BASE, _INVERSE))
        up[0] = self.down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.sums[1:])

    def at(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length).astype(np.uint64))


_RUN = np.dtype([("gram", "<u8"), ("bytes", "<u8"), ("start", "<u4"), ("place", "<u1"), ("windows", "<u1")])


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of some texts, and the text of each.

    start: of the first window, in its text; place: of the gram in that window.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < SPAN:
        return np.zeros(0, _RUN), np.zeros(0, np.int64)
    stop = np.cumsum(size)
    text_of = np.repeat(np.arange(len(size)), size)
    roll, at = Rolling(data), np.arange(n - GRAM + 1)
    low = _U((1 << PLACE_BITS) - 1)
    hashes = roll.at(at, GRAM)
    # the place in the low bits: the smallest is the leftmost of equal grams
    keys = np.full(-(-(n + PLACES) // PLACES) * PLACES, _NONE)
    keys[: len(at)] = np.where(at + GRAM <= stop[text_of[at]], (hashes & ~low) | at.astype(np.uint64), _NONE)
    blocks = keys.reshape(-1, PLACES)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    window = np.arange(n - SPAN + 1)
    window = window[window + SPAN <= stop[text_of[window]]]
    if not len(window):
        return np.zeros(0, _RUN), np.zeros(0, np.int64)
    gram = (np.minimum(tail[window], head[window + PLACES - 1]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (window[1:] != window[:-1] + 1)]))
    count = np.diff(np.append(first, len(window)))
    window, gram = window[first], gram[first]
    out = np.empty(len(first), _RUN)
    out["gram"], out["bytes"] = hashes[gram], roll.at(window, count + SPAN - 1)
    out["start"] = window - (stop - size)[text_of[window]]
    out["place"], out["windows"] = gram - window, count
    return out, text_of[window]


_SENT = "part int, runs binary, keys binary"
_FOUND = "kind string, key long, start long, windows int, gram long, place int"


def _send(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Runs by bucket, packed."""
    for keys, texts in rows(in_slices(batches, "text", SLICE_BYTES), "key", "text"):
        found, of = runs([(x or "").encode() for x in texts])
        own = np.array(keys, dtype=np.int64)[of]
        part = (_mix(found["gram"]) % _U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        out = [(p, found[order[a:b]].tobytes(), own[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
        if out:
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["part", "runs", "keys"])


def _rows(kind: np.ndarray | str, run: np.ndarray, key: np.ndarray) -> pa.Table:
    kinds = [kind] * len(run) if isinstance(kind, str) else kind
    return pa.table(
        {
            "kind": pa.array(kinds, pa.string()),
            "key": pa.array(key, pa.int64()),
            "start": pa.array(run["start"].astype(np.int64)),
            "windows": pa.array(run["windows"].astype(np.int32)),
            "gram": pa.array(run["gram"].view(np.int64)),
            "place": pa.array(run["place"].astype(np.int32)),
        }
    )


def _meet(table: pa.Table) -> pa.Table:
    """ "mark" rows: runs that are repeated as a whole; "sort" and "hot" rows: runs to be looked into, each content once."""
    run = np.concatenate([np.frombuffer(x, _RUN) for x in table["runs"].to_pylist()])
    key = np.concatenate([np.frombuffer(x, np.int64) for x in table["keys"].to_pylist()])
    order = np.lexsort((run["bytes"], run["gram"]))
    run, key = run[order], key[order]
    new_gram = np.concatenate([[True], run["gram"][1:] != run["gram"][:-1]])
    new_bytes = new_gram | np.concatenate([[True], run["bytes"][1:] != run["bytes"][:-1]])
    content, gram = np.cumsum(new_bytes) - 1, np.cumsum(new_gram) - 1
    copied = np.bincount(content)[content] > 1
    different = np.bincount(gram[new_bytes])[gram]
    ask = new_bytes & (different > 1)
    kinds = np.where(different[ask] > HOT_RUNS, "hot", "sort")
    return pa.concat_tables([_rows("mark", run[copied], key[copied]), _rows(kinds, run[ask], key[ask])])


def equal_windows(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows are equal in two strings of a group, by column-wise sorting.

    ``symbols`` has a row for each string and ``2 * PLACES - 1`` columns around
    the shared gram, which is the middle one; 256 stands for bytes that a string
    does not have.  Returns, for strings and places of the gram in a window,
    whether the window is in another string as well.
    """
    n, columns = symbols.shape
    found = np.zeros((n, PLACES), bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(n + 1, np.int32)  # between each string in order and the one before it
    for column in range(columns - 1, -1, -1):
        inserted = symbols[order, column]
        key = group[order].astype(np.int64) * 512 + inserted
        moved = np.argsort(key, kind="stable")
        order, key = order[moved], key[moved]
        same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % 512 != 256))
        grown = np.zeros(n + 1, np.int32)
        if len(same):
            between = np.stack([moved[same] + 1, moved[same + 1] + 1], 1).ravel()
            grown[same + 1] = np.minimum.reduceat(common, between)[::2] + 1
        common = grown
        place = columns // 2 - column
        if place >= 0:
            wide = np.flatnonzero(common[1:n] >= WIDTH) + 1
            found[order[wide], place] = found[order[wide - 1], place] = True
    return found


_STRINGS = "part int, asked binary, strings binary"
_ASK = np.dtype([("key", "<i8"), ("gram", "<u8"), ("start", "<u4"), ("place", "<u1"), ("windows", "<u1")])


def _cut(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The bytes of asked runs beside their grams, packed by bucket."""
    side = PLACES - 1
    for keys, texts, asks in rows(in_slices(batches, "text", SLICE_BYTES), "key", "text", "asks"):
        asked, strings = [], []
        for key, text, some in zip(keys, texts, asks):
            data = text.encode()
            for a in some:
                begin, at = a["start"], a["start"] + a["place"]
                end = begin + a["windows"] - 1 + SPAN
                asked.append((key, a["gram"] & 0xFFFFFFFFFFFFFFFF, begin, a["place"], a["windows"]))
                strings.append((data[begin:at], data[at + GRAM : end]))
        asked = np.array(asked, dtype=_ASK)
        part = (_mix(asked["gram"]) % _U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        out = []
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                packed = b"".join(left.rjust(side, b"\0") + right.ljust(side, b"\0") for left, right in (strings[i] for i in order[a:b]))
                out.append((p, asked[order[a:b]].tobytes(), packed))
        if out:
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["part", "asked", "strings"])


_MARKS = "key long, start long, windows int"


def _columns(table: pa.Table) -> pa.Table:
    """Marks of the windows that column-wise sorting finds equal."""
    asked = np.concatenate([np.frombuffer(x, _ASK) for x in table["asked"].to_pylist()])
    side = PLACES - 1
    raw = np.frombuffer(b"".join(table["strings"].to_pylist()), np.uint8).reshape(len(asked), 2 * side)
    symbols = np.zeros((len(asked), 2 * side + 1), np.uint16)
    symbols[:, :side], symbols[:, side + 1 :] = raw[:, :side], raw[:, side:]
    place, last = asked["place"].astype(np.int64)[:, None], asked["place"].astype(np.int64)[:, None] - asked["windows"][:, None] + 1
    column = np.arange(-side, side + 1)[None, :]
    symbols[(column < -place) | (column > side - last)] = 256
    _, group = np.unique(asked["gram"], return_inverse=True)
    found = equal_windows(symbols, group)[:, ::-1]  # by place from the largest: in the order of the text
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    start = asked["start"][row].astype(np.int64) + asked["place"][row] - (side - begin)
    return pa.table({"key": pa.array(asked["key"][row]), "start": pa.array(start), "windows": pa.array((end - begin).astype(np.int32))})


def _hot_marks(asked: DataFrame) -> DataFrame:
    """Marks for grams with very many different runs: every window is grouped by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, asks in rows(in_slices(batches, "text", SLICE_BYTES), "key", "text", "asks"):
            for key, text, some in zip(keys, texts, asks):
                roll = Rolling(np.frombuffer(text.encode(), np.uint8))
                starts = np.concatenate([a["start"] + np.arange(a["windows"]) for a in some])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), key)), pa.array(starts), pa.array(roll.at(starts, SPAN).view(np.int64))], ["key", "start", "hash"])

    windows = stored(asked.mapInArrow(lambda batches: lean(run(batches)), "key long, start long, hash long"), "hot-windows")
    again = stored(windows.groupBy("hash").count().where("count > 1").select("hash"), "hot-hashes")
    return windows.join(again, "hash").select("key", "start", F.lit(1).alias("windows"))


def _filter(docs: DataFrame, keys: DataFrame, hits: bool) -> DataFrame:
    """``docs`` whose key passes (or not) a filter of fixed size over ``keys``; what does not pass is surely not among them."""
    word = F.shiftright(F.pmod("key", F.lit(FILTER_BITS)), 5).cast("int")
    words = keys.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(key, {FILTER_BITS}) & 31 AS INT))")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.collect():
        bitmap[r.word] = r.bits
    held = keys.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint32)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) % FILTER_BITS
            yield batch.filter(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool) == hits))

    return docs.mapInArrow(passes, docs.schema)


def find(docs: DataFrame) -> DataFrame:
    """``key, start, windows``: starts of repeated windows, as stretches, for ``key, text``."""
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.where("text IS NOT NULL").mapInArrow(lambda batches: lean(_send(batches, parts)), _SENT)
    found = stored(sent.groupBy("part").applyInArrow(_meet, _FOUND), "runs")
    marks = found.where("kind = 'mark'").select("key", "start", "windows")
    asks = found.where("kind <> 'mark'")
    per_text = asks.groupBy("key", "kind").agg(F.collect_list(F.struct("start", "windows", "gram", "place")).alias("asks"))
    per_text = stored(per_text, "asked-runs")
    texts = _filter(docs.where("text IS NOT NULL"), per_text.select("key").distinct(), True).dropDuplicates(["key"])
    asked = texts.join(per_text, "key")
    cut = asked.where("kind = 'sort'").select("key", "text", "asks").mapInArrow(lambda batches: lean(_cut(batches, parts)), _STRINGS)
    marks = marks.union(stored(cut.groupBy("part").applyInArrow(_columns, _MARKS), "sorted-marks"))
    if not per_text.where("kind = 'hot'").isEmpty():
        marks = marks.union(_hot_marks(asked.where("kind = 'hot'").select("key", "text", "asks")))
    return marks


def _stretches(size: int, marks: list[dict]) -> list[tuple[int, int]]:
    """Merged stretches of bytes that marked windows cover."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((m["start"], m["start"] + m["windows"] - 1 + SPAN) for m in marks):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def remove(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, binary) for every row of ``df``.

    Texts are judged as UTF-8 bytes on the input; matches stay within a text.
    Null and empty texts have no bytes; rows repeated as a whole repeat each
    other from ``SPAN`` bytes on; an empty table gives an empty one.  Only the
    two named columns are used.
    """
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    marks = find(docs.select("key", "text"))
    per_text = stored(marks.groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("marks")), "repeats")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, lists in rows(batches, "id", "text", "marks"):
            out = []
            for i, text, some in zip(ids, texts, lists):
                data = (text or "").encode()
                gone = _stretches(len(data), some or [])
                edges = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((i, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    keyed = docs.select("key", "id", "text")
    keys = per_text.select("key")
    touched = _filter(keyed, keys, True).join(per_text, "key", "left").select("id", "text", "marks")
    untouched = _filter(keyed, keys, False).select("id", "text", F.lit(None).cast(per_text.schema["marks"].dataType).alias("marks"))
    out = touched.mapInArrow(lambda batches: lean(run(batches)), schema).union(untouched.mapInArrow(lambda batches: lean(run(batches)), schema)).withColumnRenamed("id", id_col)
    return out if with_bytes else out.drop("kept")

"""N-gram Jaccard self-join by universe-partition pigeonhole.

A document is the set of its distinct word n-grams.  Two sets link at
``PERCENT`` percent Jaccard similarity, so sets of n and s elements differ in
at most (n + s) / 7 of them (for 75 percent).  The universe is cut into
segments by hash, as many as the size band asks for; if two sets differ in H
elements, then of any H + 1 segments one is the same in both, or of fewer
segments one differs in one element at most.  Empty segments say nothing and
are never used.

* Index: a set writes one signature for each of its segments (in bands of small
  sets also one for each segment without one element; in bands of tiny sets
  every element is a segment).
* Probe: the larger set of a pair looks up H + 1 of its segments, in its own
  band and the next lower one, and picks those of least cost: rare ones, by a bounded sample of documents and by
  its own batch (the costs decide which segments are looked up, never what is
  found); where it has fewer, some are looked up with their one-deletion neighbourhoods.  A
  set that cannot reach H + 1 even so is joined by all its n-grams instead.
* Signatures travel as packed arrays, one row for each batch and bucket: 47 bits
  of each and the gap to the id before it (signatures that agree by chance cost
  a comparison, no result).

A bucket never lists its pairs.  It names its smallest member as pivot, and two
sets of one bucket both stand in the group of its pivot.  Groups are compared
inside tasks, in blocks of bounded size, on the n-gram sets themselves; what a
block emits is one link for each set and component.  Equal texts are one set
from the start, so groups of copies never count by their size.  Where a group
is larger than a block, only sets outside its largest component meet the other
blocks, and of those blocks only the ones that they can link with: n-grams that
no other set of a large group holds are no part of any intersection there, which
bounds the sizes that a set links with.  A set that links with nothing for the
n-grams that it has alone is in no block, so such sets cost a pass over their
n-grams, not one over their group.  All links between different texts are thus
verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import give_back, in_slices, keyed_text, lean, rows, stored, unused
from tidemark.llm.components import connected

WORDS, PERCENT = 5, 75
#: Bands whose smallest set is below these have every element as a segment, or one-deletion neighbourhoods where segments run short.
TINY, SMALL = 16, 64
SLICE_BYTES = 1 << 20
#: Documents that common n-grams are estimated from, chosen by a hash, and how many must hold one that counts as common.
COST_DOCS, COMMON_DOCS = 6_000, 2
#: Members of one pivot that are compared in one block, besides the pivot.
BLOCK = 384
#: Bits of the filter that keeps texts without candidates out of the shuffle: its size is fixed.
FILTER_BITS = 1 << 24

#: Seeds of two hashes of a text, which Spark gives as xxhash64(text) and xxhash64(1, text).
_SEEDS = (42, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42))

_U = np.uint64
_ONE = _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS = _mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | _ONE


def shingles(text: str | None) -> np.ndarray:
    """The distinct n-grams of a text, as sorted 64-bit hashes.

    Words are runs of other characters than ASCII white space, with A-Z
    lower-cased; fewer than ``WORDS`` are one n-gram; without any there is none.
    """
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, WORDS)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += _mix(h[i : n - k + 1 + i] ^ _POWERS[i]) * _POWERS[i]
    return np.unique(_mix(total))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets link; empty sets link with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _differ(total: np.ndarray) -> np.ndarray:
    """Elements in which two linked sets can differ, from the sum of their sizes."""
    return (total * (100 - PERCENT)) // (100 + PERCENT)


def _bands() -> np.ndarray:
    """The smallest size of each band: a set links only with sets of its own band and the bands beside it."""
    sizes = [1]
    while sizes[-1] < 1 << 40:
        sizes.append(sizes[-1] * 100 // PERCENT + 1)
    return np.array(sizes)


_BANDS = _bands()


def _segments(least: np.ndarray) -> np.ndarray:
    """Segments of the universe for bands by their smallest set: so many that a set may pass over its costly ones; in bands of tiny sets none are drawn."""
    return (0.47 * least + 1.2 * np.sqrt(least)).astype(np.int64) + 1


class _Sets:
    """The sets of a batch, end to end."""

    def __init__(self, sets: list[np.ndarray], common: np.ndarray):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.all = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(common, self.all), max(0, len(common) - 1))
        self.common = common[at] == self.all if len(common) else np.zeros(len(self.all), bool)
        self.band = np.searchsorted(_BANDS, self.size, side="right") - 1


def _signatures(sets: _Sets, chosen: np.ndarray, band: np.ndarray, need: np.ndarray, index: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the chosen sets (a mask) under the scheme of ``band``.

    Returns signatures, sets, whether they probe, and the sets that found no
    allocation.  ``need`` is how many differing segments must be outvoted, H + 1.
    """
    of_element = np.repeat(np.arange(len(sets.size)), sets.size)
    on = chosen[of_element]
    of_element, element, common = of_element[on], sets.all[on], sets.common[on]
    least = _BANDS[band]
    tiny, small = least < TINY, (least >= TINY) & (least < SMALL)
    m = np.where(chosen, np.where(tiny, sets.size, _segments(least)), 0)
    base = np.cumsum(m) - m
    start = np.cumsum(np.where(chosen, sets.size, 0)) - np.where(chosen, sets.size, 0)
    drawn = ((_mix(element ^ _U(0x5851F42D4C957F2D)) >> _U(20)) % m[of_element].astype(np.uint64)).astype(np.int64)
    segment = np.where(tiny[of_element], np.arange(len(element)) - start[of_element], drawn)
    slot = base[of_element] + segment
    mixed = _mix(element)
    total = np.zeros(int(m.sum()), np.uint64)
    np.add.at(total, slot, mixed)
    count = np.bincount(slot, minlength=len(total))
    owner = np.repeat(np.arange(len(m)), m)
    place = np.where(tiny[owner], 0, np.arange(len(total)) - base[owner]).astype(np.uint64)
    salt = _mix(place + (band[owner].astype(np.uint64) << _U(40)) + _ONE)
    full = np.flatnonzero(count)
    plain, by = _mix(total[full] ^ salt[full]), owner[full]
    _, inverse, often = np.unique(plain, return_inverse=True, return_counts=True)
    rare = np.bincount(slot, ~common, minlength=len(total))[full]  # a segment of common n-grams alone is costly
    order = np.lexsort((often[inverse], rare == 0, by))  # the rarest segments of each set first
    first = np.searchsorted(by[order], np.arange(len(m)))
    rank = np.empty(len(full), np.int64)
    rank[order] = np.arange(len(full)) - first[by[order]]
    probes = rank < need[by]
    having = np.bincount(by, minlength=len(m))
    short = np.maximum(need - having, 0) * chosen  # so many segments must also allow one difference
    if not (short.any() or (index and small[chosen].any())):
        return (plain, by, probes, np.zeros(0, np.int64)) if index else (plain[probes], by[probes], probes[probes], np.zeros(0, np.int64))
    several = (count[full] > 1) & small[by]
    widened = np.zeros(len(total), bool)
    order = np.lexsort((count[full], ~several, by))
    rank[order] = np.arange(len(full)) - first[by[order]]
    widened[full] = several & (rank < short[by])
    failed = np.flatnonzero(short > np.bincount(owner[widened], minlength=len(m)))
    without = np.flatnonzero(small[of_element] & (count[slot] > 1))
    deleted = _mix((total[slot[without]] - mixed[without]) ^ salt[slot[without]])
    d_by, d_probes = of_element[without], widened[slot[without]]
    sigs, owners, flags = np.concatenate([plain, deleted]), np.concatenate([by, d_by]), np.concatenate([probes, d_probes])
    return (sigs, owners, flags, failed) if index else (sigs[flags], owners[flags], flags[flags], failed)


_SENT = "part int, sigs binary, gaps binary, ids binary"
_FOUND = "kind string, a long, b long, n long"


def _packed(sigs: np.ndarray, probes: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """47 bits of each signature with its probe flag in six bytes, the gaps of the sorted ids in as few as they need, the first id."""
    gaps = np.diff(ids, prepend=ids[:1]).view(np.uint64)
    width = next(w for w in ("<u1", "<u2", "<u4", "<u8") if gaps.max() <= np.iinfo(w).max)
    words = ((sigs >> _U(17)) << _U(1) | probes.astype(np.uint64)).astype("<u8")
    return words.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), gaps.astype(width).tobytes(), ids[:1].astype("<i8").tobytes()


def _unpacked(raw: bytes, gaps: bytes, first: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures (their 47 bits), probe flags and ids."""
    words = np.zeros((len(raw) // 6, 8), np.uint8)
    words[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    words = words.view("<u8")[:, 0]
    ids = np.cumsum(np.frombuffer(gaps, f"<u{len(gaps) // len(words)}").astype(np.uint64), dtype=np.uint64).view(np.int64)
    return words >> _U(1), (words & _ONE).astype(bool), ids + np.frombuffer(first, "<i8")


def _send(batches: Iterator[pa.RecordBatch], parts: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Signatures by bucket, packed; under negative buckets the texts' sizes, and the sets without an allocation."""
    for ids, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
        sets = _Sets([shingles(x) for x in texts], common)
        known, keys = np.array([i is not None for i in ids]), np.array([-1 if i is None else i for i in ids], dtype=np.int64)
        own = known & (sets.size > 0)
        under = np.maximum(sets.band - 1, 0)
        lower = own & (sets.band > 0) & (-(-sets.size * PERCENT // 100) < _BANDS[sets.band])
        a = _signatures(sets, own, sets.band, _differ(2 * sets.size) + 1, True)
        b = _signatures(sets, lower, under, _differ(sets.size + _BANDS[sets.band] - 1) + 1, False)
        sigs = np.concatenate([a[0], b[0]])
        owners, probes = keys[np.concatenate([a[1], b[1]])], np.concatenate([a[2], b[2]])
        part = (sigs % _U(parts)).astype(np.int32)
        order = np.lexsort((owners, part))
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        digests = np.array([xxhash.xxh64_intdigest(x or "", seed) for x in texts for seed in _SEEDS], dtype=np.uint64)
        out = [(-1 - int(_mix(digests[:1])[0] % _U(parts)), sets.size.astype("<i8").tobytes(), b"", digests.tobytes())]
        if failed := np.union1d(a[3], b[3]).tolist():
            out.append((-1 - parts, b"", b"", keys[failed].tobytes()))
        for p in range(parts):
            if cuts[p] < cuts[p + 1]:
                some = order[cuts[p] : cuts[p + 1]]
                out.append((p, *_packed(sigs[some], probes[some], owners[some])))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["part", "sigs", "gaps", "ids"])


def _table(kind: str, a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.Table:
    size = len(a)
    return pa.table(
        {
            "kind": pa.array([kind] * size, pa.string()),
            "a": pa.array(a, pa.int64()),
            "b": pa.nulls(size, pa.int64()) if b is None else pa.array(b, pa.int64()),
            "n": pa.nulls(size, pa.int64()) if n is None else pa.array(n, pa.int64()),
        }
    )


def _meet(table: pa.Table, parts: int) -> pa.Table:
    """What the signatures of one bucket number show.

    "size" rows give texts (a, b: hashes) the sizes of their sets; "star" rows (a: smallest member, b, n: signatures shared there) are
    candidates; "rest" rows are sets without allocation.
    """
    part = table["part"][0].as_py()
    blobs = [table[n].to_pylist() for n in ("sigs", "gaps", "ids")]
    if part == -1 - parts:
        return _table("rest", np.concatenate([np.frombuffer(x, np.int64) for x in blobs[2]]), None, None)
    if part < 0:
        size, digests = (np.concatenate([np.frombuffer(x, np.int64) for x in xs]) for xs in (blobs[0], blobs[2]))
        return _table("size", digests[::2], digests[1::2], size)
    sigs, probes, ids = (np.concatenate(x) for x in zip(*map(_unpacked, *blobs)))
    order = np.argsort(sigs, kind="stable")
    again = sigs[order][1:] == sigs[order][:-1]
    shared = np.concatenate([again, [False]]) | np.concatenate([[False], again])
    order = order[shared]
    order = order[np.lexsort((ids[order], sigs[order]))]
    sigs, ids, probes = sigs[order], ids[order], probes[order]
    if not len(sigs):
        return _table("star", np.zeros(0, np.int64), None, None)
    begin = np.concatenate([[True], sigs[1:] != sigs[:-1]])
    group = np.cumsum(begin) - 1
    fresh = begin | np.concatenate([[True], ids[1:] != ids[:-1]])  # the first row of a member in its bucket
    probed = np.bincount(group, probes) > 0
    pivot = ids[begin][group]
    star = fresh & ~begin & probed[group] & (ids != pivot)
    pivot, ids = pivot[star], ids[star]
    order = np.lexsort((ids, pivot))
    pivot, ids = pivot[order], ids[order]
    begin = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (ids[1:] != ids[:-1])])) if len(ids) else np.zeros(0, np.int64)
    return _table("star", pivot[begin], ids[begin], np.diff(np.append(begin, len(ids))))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over ``ids``; what does not pass is surely not among them."""
    words = ids.groupBy(F.expr(f"shiftright({_BIT}, 5)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {_BIT} & 31)")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.collect():
        bitmap[r.word] = r.bits
    return bitmap


_BIT = f"CAST(pmod(xxhash64(id), {FILTER_BITS}) AS INT)"


def _passed(batches: Iterator[pa.RecordBatch], bits: np.ndarray, hits: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text, bit) without the rows that the filter sends the other way, and without the bit."""
    for batch in batches:
        at = batch.column(2).to_numpy(zero_copy_only=False)
        yield batch.select([0, 1]).filter(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool) == hits))


def _passing(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``docs`` whose id passes the filter."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _passed(batches, np.frombuffer(held.value, np.uint32), True)

    return docs.select("id", "text", F.expr(_BIT).alias("bit")).mapInArrow(run, "id long, text string")


def _signed(docs: DataFrame, gone: DataFrame, parts: int, common: np.ndarray) -> DataFrame:
    """What :func:`_send` makes of ``docs`` without the ids in ``gone``: only documents that the filter cannot clear are joined with them."""
    bitmap = _bitmap(gone)
    held = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # filter and signatures in one worker
        return lean(_send(_passed(batches, np.frombuffer(held.value, np.uint32), False), parts, common))

    sure = docs.select("id", "text", F.expr(_BIT).alias("bit")).mapInArrow(cleared, _SENT)
    others = _passing(docs, bitmap).join(gone, "id", "left_anti")
    return sure.union(others.mapInArrow(lambda batches: lean(_send(batches, parts, common)), _SENT))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections within a block, by products of incidence columns."""
    k = len(sets)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    owner = np.repeat(np.arange(k), [len(s) for s in sets])[order]
    column = np.cumsum(np.concatenate([[False], grams[order][1:] != grams[order][:-1]]))
    often = np.bincount(column)
    several = often[column] > 1
    owner, column = owner[several], (np.cumsum(often > 1) - 1)[column[several]]
    common = np.zeros((k, k), np.int64)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        incidence = np.zeros((k, 4096), np.float32)
        incidence[owner[a:b], column[a:b] - begin] = 1
        common += np.rint(incidence @ incidence.T).astype(np.int64)
    return common


def _block(ids: list[int], texts: list[str]) -> list[tuple[int, int]]:
    """Links that join each set of a block to the smallest id of its component there."""
    sets = [shingles(t) for t in texts]
    if len(ids) == 2:
        return [(min(ids), max(ids))] if linked(*sets) else []
    size = np.array([len(s) for s in sets])
    common = _intersections(sets)
    link = (common > 0) & (100 * common >= PERCENT * (size[:, None] + size[None, :] - common))
    np.fill_diagonal(link, True)
    label = np.array(ids, dtype=np.int64)
    while True:
        least = np.where(link, label[None, :], np.iinfo(np.int64).max).min(1)
        if (least == label).all():
            return [(int(a), int(b)) for a, b in zip(label, ids) if a != b]
        label = least


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the blocks of a sorted partition, one after the other."""
    current, ids, texts = None, [], []

    def links() -> pa.RecordBatch:
        found = _block(ids, texts) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for pivots, blocks, some, more in rows(in_slices(batches, "text", SLICE_BYTES), "a", "g", "id", "text"):
        for block, i, text in zip(zip(pivots, blocks), some, more):
            if block != current:
                yield links()
                current, ids, texts = block, [], []
            ids.append(i)
            texts.append(text)
    yield links()


def _verify(docs: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """``a, b``: links within blocks; ``places`` has pivot a, block g and id of each set that a block compares."""
    places = stored(places.distinct(), f"{name}-places")
    ids = stored(places.select("id").distinct(), f"{name}-ids")
    texts = _passing(docs, _bitmap(ids))
    placed = texts.join(places, "id").select("a", "g", "id", "text")
    return stored(placed.repartition("a", "g").sortWithinPartitions("a", "g", "id").mapInArrow(lambda batches: lean(_compare(batches)), "a long, b long"), f"{name}-links")


def _labelled(pairs: DataFrame, components: DataFrame, column: str) -> DataFrame:
    """Adds ``component`` for a column of ids; one without links is its own component."""
    own = components.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    return pairs.join(own, F.col(column) == F.col("_id"), "left").withColumn("component", F.coalesce("_component", column)).drop("_id", "_component")


def _common(docs: DataFrame) -> np.ndarray:
    """Sorted n-grams that several of at most ``COST_DOCS`` sampled documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows(in_slices(batches, "text", SLICE_BYTES), "text"):
            grams = np.concatenate([shingles(x) for x in texts])
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    n = docs.count()
    share = min(1.0, COST_DOCS / max(1, n))
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    often = some.mapInArrow(lambda batches: lean(run(batches)), "gram long").groupBy("gram").count().where(F.col("count") >= COMMON_DOCS)
    got = often.orderBy(F.desc("count"), "gram").limit(50_000).toPandas().gram.to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def join(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row of ``df``.

    Null and empty texts have no n-grams and link with nothing; rows with a
    null id are counted but linked with nothing (null component); rows that
    repeat an id are one node, linked if any of their texts is; an empty table
    gives an empty one.  Only the two named columns are used.
    """
    spark: SparkSession = df.sparkSession
    docs = keyed_text(df, id_col, text_col)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    # equal texts are one set; a repeated id joins those of all its texts
    texts = docs.select("id", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.sha1("text"))).alias("digest"))
    texts = stored(texts.where("id IS NOT NULL"), "text-digests")
    owners = stored(texts.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("n")).where("n > 1"), "owners")
    copies = stored(texts.join(owners, "digest").where("id <> owner").select(F.col("owner").alias("a"), F.col("id").alias("b")), "copies")
    held = stored(texts.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    gone = stored(copies.select(F.col("b").alias("id")).distinct().join(held, "id", "left_anti"), "copied-ids")
    own = docs.where("text IS NOT NULL")

    def meet(table: pa.Table) -> pa.Table:
        out = _meet(table, parts)
        give_back()
        return out

    sent = _signed(own, gone, parts, _common(own))
    found = stored(sent.groupBy("part").applyInArrow(meet, _FOUND), "ngram-buckets")
    stars = stored(found.where("kind = 'star'").select("a", "b").distinct(), "stars")

    # groups of a pivot, in blocks that all hold it
    degrees = stored(stars.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "degrees")
    dealt = stored(stars.join(degrees, "a").withColumn("g", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")), "dealt")
    places = dealt.select("a", "g", F.col("b").alias("id")).union(dealt.select("a", "g", F.col("a").alias("id")))
    links = copies.union(_verify(own, places, "stars"))
    rest = found.where("kind = 'rest'").select(F.col("a").alias("id")).distinct()
    if not rest.isEmpty():  # sets without an allocation, by all their n-grams
        links = links.union(_verify(own, _pairs_as_places(_by_all_ngrams(own, rest)), "rest"))
    components = stored(connected(links), "components")

    # groups of several blocks: what is outside the largest component meets all blocks that it can link with
    large = dealt.where("blocks > 1").select("a", F.col("b").alias("id"))
    if not large.isEmpty():
        members = stored(_labelled(large, components, "id"), "large-groups")
        sizes = members.groupBy("a", "component").agg(F.count("*").alias("n"))
        top = sizes.groupBy("a").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
        top = stored(top.where("n > top.n").select(F.col("a").alias("p"), F.col("top.component").alias("most")), "large-tops")
        late = _verify(own, _outside(own, members.join(top, F.col("a") == F.col("p"))), "large")
        components = stored(connected(components.select(F.col("component").alias("a"), F.col("id").alias("b")).union(late)), "components")

    sizes = found.where("kind = 'size'").groupBy(F.col("a").alias("hash"), F.col("b").alias("more")).agg(F.max("n").alias("n_shingles"))
    counted = docs.select("id", F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("more")).join(stored(sizes, "sizes"), ["hash", "more"], "left")
    out = _labelled(counted, components, "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def _reach(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, low, reach``: a set links with none of ``ids`` whose ``low`` is above its ``reach``.

    ``low`` is the size of its set.  Of its n-grams only those that another of
    ``ids`` holds can be in an intersection, which bounds the union and so the
    other's size.  Ids with several texts have the wider bounds of all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            sets = [shingles(x) for x in texts]
            size = np.array([len(s) for s in sets])
            held = np.concatenate([np.concatenate(sets).view(np.int64), np.zeros(len(sets), np.int64)])
            owner = np.concatenate([np.repeat(np.arange(len(sets)), size), np.arange(len(sets))])
            last = np.arange(len(held)) >= size.sum()  # one row for the set itself
            kinds = [pa.array(held, mask=last), pa.array(np.array(keys, np.int64)[owner]), pa.array(size[owner], mask=~last)]
            yield pa.RecordBatch.from_arrays(kinds, ["gram", "id", "size"])

    texts = _passing(docs, _bitmap(ids)).join(ids, "id").select("id", "text")
    held = texts.mapInArrow(lambda batches: lean(run(batches)), "gram long, id long, size long")
    own = F.when(F.col("gram").isNull(), F.col("id")).alias("own")
    once = held.groupBy("gram", own).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))
    each = once.where("n = 1 OR gram IS NULL").groupBy("id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.count("gram").alias("alone"), F.max(F.expr("gram IS NULL AND n > 1")).alias("several")
    )
    alone = F.when(F.col("several"), 0).otherwise(F.col("alone"))
    return stored(each.select("id", "low", F.floor((100 * F.col("high") - (100 + PERCENT) * alone) / PERCENT).alias("reach")), "large-reach")


def _outside(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Places in which each set outside its group's largest component meets all sets of the group that it can link with.

    ``members`` has pivot a, id, component and the group's largest component,
    ``most``.  A group is cut into classes of like size, and a set meets those
    within its reach that reach it.
    """
    bounds = _reach(docs, stored(members.select("id").distinct(), "large-members"))
    sized = members.join(bounds, "id").withColumn("class", F.floor(F.log(F.greatest("low", F.lit(1))) * 16).cast("int"))
    sized = stored(sized.select("a", "id", "class", "low", "reach", (F.col("component") != F.col("most")).alias("out")), "large-sizes")
    each = sized.groupBy("a", "class").agg(F.min("low").alias("least"), F.max("reach").alias("most"), F.count("*").alias("n"))
    found = sized.where("out").select("a", "id", "low", "reach").join(each, "a").where("least <= reach AND low <= most")
    found = stored(found.select("a", "class", "id", "n", "low", "reach"), "large-outside")
    half = BLOCK // 2
    cut = found.groupBy("a", "class").agg(
        F.ceil(F.count("*") / half).cast("int").alias("outside"), F.ceil(F.max("n") / half).cast("int").alias("inside"),
        F.min("low").alias("from"), F.max("reach").alias("to"),
    )
    cut = stored(cut, "large-cuts")
    row, column = F.pmod(F.xxhash64("id", F.lit(1)), F.col("outside")), F.pmod(F.xxhash64("id", F.lit(2)), F.col("inside"))
    keys = ["a", "class"]
    outer = found.select(*keys, "id").join(cut, keys).select("*", F.explode(F.expr("sequence(0, inside - 1)")).alias("c"), row.alias("r"))
    inner = sized.join(cut, keys).where("low <= `to` AND `from` <= reach")
    inner = inner.select("*", column.alias("c"), F.explode(F.expr("sequence(0, outside - 1)")).alias("r"))
    g = F.col("r") * F.col("inside") + F.col("c") + F.shiftleft(F.col("class").cast("long"), 40)
    return outer.select("a", g.alias("g"), "id").union(inner.select("a", g.alias("g"), "id"))


def _pairs_as_places(pairs: DataFrame) -> DataFrame:
    """A block for each pair."""
    g = F.xxhash64("b").cast("int")
    return pairs.select("a", g.alias("g"), F.col("a").alias("id")).union(pairs.select("a", g.alias("g"), F.col("b").alias("id")))


def _by_all_ngrams(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``a, b``: pairs of the given sets with all sets that share an n-gram with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            sets = [shingles(x) for x in texts]
            owners = np.repeat(np.array(keys, np.int64), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate(sets).view(np.int64))], ["id", "gram"])

    grams = docs.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "id long, gram long")
    own = grams.join(ids, "id").select(F.col("id").alias("own"), "gram").distinct()
    pairs = own.join(grams, "gram").where("own <> id")
    return pairs.select(F.least("own", "id").alias("a"), F.greatest("own", "id").alias("b")).distinct()


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the smallest id of each component alone; all columns stay, whatever their names.

    Rows that repeat an id with the same text, or a text under null ids, are
    one document as well: one row of them stays.  Null and empty texts are no
    copies of each other and stay; an empty table stays empty.
    """
    found = join(df, id_col=id_col, text_col=text_col)
    (gone_id, again) = unused(df, "gone", "again")
    gone = stored(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone_id)).distinct(), "near-copies")
    kept = df.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
    # rows that repeat an id, or have none, are few: only they are compared by digest and numbered
    held = df.groupBy(F.col(id_col).alias(gone_id)).count().where("count > 1").select(gone_id)
    held = stored(held, "held-ids")
    if held.isEmpty():
        return kept
    same = F.col(id_col).eqNullSafe(F.col(gone_id))
    several = kept.join(held, same, "left_semi")
    empty = ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    distinct = several.where(~empty).withColumn(again, F.sha1(text_col)).dropDuplicates([id_col, again]).drop(again)
    return kept.join(held, same, "left_anti").union(several.where(empty)).union(distinct)

"""Helpers that several operators share: shared storage, column checks, batches."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine (tests, notebooks).
_FALLBACK_DIR = "/tmp/tidemark-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    If the session names none, a local one is set where the master is local;
    on a cluster that would lose data without a word, so it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    set_by_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_context.isDefined():
        return set_by_context.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(_FALLBACK_DIR)
    return _FALLBACK_DIR


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text) under fixed names, so that other columns cannot clash."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def hash_sample(df: DataFrame, bound: int, *key: str) -> DataFrame:
    """At most ``bound`` rows of ``df``, those whose keys have the smallest hashes.

    The rows are counted first, and those that surely have larger hashes go
    before anything is sorted, so no task gathers a share of all partitions.
    """
    n = df.count()
    out = df.withColumn("_hash", F.xxhash64(*key))
    if n > 2 * bound:  # twice the expected number is left: more than the bound, but for chance beyond measure
        out = out.where(F.pmod("_hash", F.lit(1 << 40)) < int(2 * bound / n * (1 << 40)))
    return out.orderBy(F.pmod("_hash", F.lit(1 << 40)), *key).limit(bound).drop("_hash")


#: Rows of whole texts that Spark hands to a Python worker at a time: a few MB, where its default of 10,000 would be some 30.
TEXT_BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Make Arrow batches small enough for whole texts, unless the session names a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(TEXT_BATCH_ROWS))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return memory that this worker holds but does not use to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, with unused memory given back after some and at the end, as workers are used again."""
    try:
        for n, batch in enumerate(batches, 1):
            yield batch
            if n % 8 == 0:
                del batch
                give_back()
    finally:
        give_back()


class Memo(dict):
    """What ``make`` gives for many short strings at once, in two generations of about ``limit`` entries each.

    A full generation becomes the older one, in place of the last; what is
    asked for again comes back from there.  This bounds memory, never results.
    """

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], limit: int, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def joined(self, cut: list[list[str]], last: bytes = b"") -> list[bytes]:
        """For each list of strings what they give, joined, and ``last`` after it."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        new = set(chain.from_iterable(cut)).difference(self)
        for key in new.intersection(self.older):
            self[key] = self.older[key]
        left = list(new.difference(self.older))
        self.update(zip(left, self.make(left)))
        out = [b"".join([*map(self.__getitem__, keys), last]) for keys in cut]
        for key in left:
            if len(key) > self.longest:
                del self[key]
        return out


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Each Arrow batch as Python lists of the named columns."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def in_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(False)
        start = total = 0
        for i, size in enumerate(sizes):
            if total + size > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)

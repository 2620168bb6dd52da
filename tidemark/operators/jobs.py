"""Jobs on a store: swaps of whole partitions, healing, merges by precedence, frontier patches and pinned snapshots."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.schemas import STORE_KEY, VINTAGE, conform
from tidemark.storage import delete

PARTITION = ["source", "seasonally_adjusted"]
#: Where a rewrite lies until it is in place; readers pass over names that begin so.
STAGED = "_staged"


def _in(partitions: list[tuple]) -> Column:
    """Rows of these partitions; as a condition on the partition columns it prunes folders."""
    each = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(PARTITION, p)]) for p in partitions]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def _partitions(df: DataFrame) -> list[tuple]:
    """The partitions of rows: pairs of a source and an adjustment, so few."""
    return sorted((tuple(r) for r in df.select(*PARTITION).distinct().collect()), key=repr)


def swap(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in place of the partitions that they have, and leave all others alone.

    The rows are staged beside the store first, which ends with a marker, and
    then overwrite their partitions.  A run that dies before the marker has
    changed nothing; one that dies after it is finished by ``resume``.
    """
    spark = rows.sparkSession
    staged = f"{path}/{STAGED}"
    if store.exists(spark, staged):
        delete(spark, staged)
    rows.write.partitionBy(*PARTITION).parquet(staged)
    _place(spark, path)


def _place(spark: SparkSession, path: str) -> None:
    staged = f"{path}/{STAGED}"
    whole = spark.read.schema(VINTAGE).parquet(staged)
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)
    delete(spark, staged)


def resume(spark: SparkSession, path: str, keys: list[str] = STORE_KEY) -> bool:
    """Finish a swap that died after its rows were staged; true if there was one.

    What has come into those partitions since is kept: both are compacted together.
    """
    staged = f"{path}/{STAGED}"
    if not store.exists(spark, staged):
        return False
    if not store.exists(spark, f"{staged}/_SUCCESS"):
        delete(spark, staged)
        return False
    old = spark.read.schema(VINTAGE).parquet(staged)
    # the staged rows are moved, so that the swap may stage their union
    kept = f"{path}/_resumed"
    if store.exists(spark, kept):
        delete(spark, kept)
    here = store.read(spark, path).where(_in(_partitions(old)))
    store.compact(old.unionByName(here), keys).write.partitionBy(*PARTITION).parquet(kept)
    swap(spark.read.schema(VINTAGE).parquet(kept), path)
    delete(spark, kept)
    return True


def fragmented(spark: SparkSession, path: str) -> DataFrame:
    """Partitions that lie in more than one file, with the number of files, from file metadata alone."""
    files = store.read(spark, path).select(*PARTITION, F.col("_metadata.file_path").alias("file"))
    return files.groupBy(*PARTITION).agg(F.count_distinct("file").alias("n_files")).where("n_files > 1")


def heal(spark: SparkSession, path: str, keys: list[str] = STORE_KEY) -> list[tuple]:
    """Finish what a crash left, and compact the partitions that lie in several files; the others keep their files.

    A partition is written as files of the advisory size, one at least, so a large one may stay in several.
    """
    resume(spark, path, keys)
    broken = _partitions(fragmented(spark, path))
    if broken:
        rows = store.compact(store.read(spark, path).where(_in(broken)), keys)
        swap(rows.hint("rebalance", *PARTITION), path)
    return broken


def priority_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row for each key: that of the first frame which has it, there the latest vintage.  Nulls in keys are equal."""
    ranked = [conform(f, VINTAGE, fill=True).withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(DataFrame.unionByName, ranked)
    w = Window.partitionBy(*keys).orderBy("_rank", F.desc("vintage_date"), F.desc("employment"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_rank")


def build_store(history: DataFrame, current: DataFrame, path: str, keys: list[str] = STORE_KEY) -> list[tuple]:
    """Merge two sources into a store: ``current`` goes before ``history``, and both before what is stored.

    Only the partitions of the two are read and rewritten; which they are is returned.
    """
    spark = current.sparkSession
    touched = sorted({*_partitions(history), *_partitions(current)}, key=repr)
    frames = [current, history]
    if store.exists(spark, path):
        resume(spark, path, keys)
        frames.append(store.read(spark, path).where(_in(touched)))
    if touched:
        swap(priority_merge(frames, keys).hint("rebalance", *PARTITION), path)
    return touched


@dataclass
class Patch:
    """What a patch did or would do."""

    appended: int
    would_append: int
    skipped: int
    corrected: DataFrame


def patch_plan(window: DataFrame, path: str, through: Column, source: str = "ces", keys: list[str] = STORE_KEY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of a window past the store's frontier, those of them that are new, and stored levels that differ.

    The frontier is the newest vintage of the source; prints from that day on up
    to ``through`` are looked at.  Of the store only the partitions and reference
    dates of the window are read.
    """
    spark = window.sparkSession
    rows = conform(window, VINTAGE, fill=True).where((F.col("source") == source) & (F.col("vintage_date") <= through))
    if not store.exists(spark, path):
        return rows, store.compact(rows, keys), spark.createDataFrame([], VINTAGE).withColumn("stored", F.lit(None).cast("double"))
    edge = store.frontier(store.read(spark, path).where(F.col("source") == source)).first()["frontier"]
    rows = rows.where(F.col("vintage_date") >= F.lit(edge))
    span = rows.agg(F.min("ref_date").alias("a"), F.max("ref_date").alias("b")).first()
    here = _in(_partitions(rows)) & F.col("ref_date").between(F.lit(span["a"]), F.lit(span["b"]))
    stored = store.read(spark, path).where(here)
    return rows, store.new_rows(rows, stored, keys), store.drift(rows, stored, keys)


def patch_frontier(window: DataFrame, path: str, through: Column, *, apply: bool = False, source: str = "ces", keys: list[str] = STORE_KEY) -> Patch:
    """Append what a window has past the frontier, or only count it; the same plan does both, and a second run appends nothing."""
    rows, new, corrected = patch_plan(window, path, through, source, keys)
    new = new.persist()
    try:
        n, looked_at = new.count(), rows.count()
        if apply and n:
            new.write.mode("append").partitionBy(*PARTITION).parquet(path)
        return Patch(n if apply else 0, n, looked_at - n, corrected)
    finally:
        new.unpersist()


def snapshot(df: DataFrame, path: str, as_of: str) -> str:
    """Write a table as of a day under its content hash, the manifest last; returns the hash.

    A snapshot that is there already is left as it is.  Without its manifest a
    folder is no snapshot, so one that a crash left behind does no harm.
    """
    spark = df.sparkSession
    draft = f"{path}/as_of={as_of}/_draft"
    if store.exists(spark, draft):
        delete(spark, draft)
    df.write.parquet(draft)  # written once: what is hashed is what is kept
    found = store.content_hash(spark.read.schema(df.schema).parquet(draft)).first()
    home = f"{path}/as_of={as_of}/{found['hash'][:12]}"
    if store.exists(spark, f"{home}/manifest"):
        delete(spark, draft)
        return found["hash"]
    if store.exists(spark, home):
        delete(spark, home)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(f"{home}/data")
    files = source.getFileSystem(conf)
    files.mkdirs(target.getParent())
    files.rename(source, target)
    manifest = {"as_of": as_of, "n": found["n"], "hash": found["hash"], "schema": df.schema.simpleString()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{home}/manifest")
    return found["hash"]


def load_snapshot(spark: SparkSession, path: str, as_of: str, content: str) -> DataFrame:
    """The pinned table; a missing manifest, another hash or other rows than the manifest's are refused."""
    home = f"{path}/as_of={as_of}/{content[:12]}"
    if not store.exists(spark, f"{home}/manifest/_SUCCESS"):
        raise ValueError(f"no snapshot at {home}")
    manifest = json.loads(spark.read.text(f"{home}/manifest").first()["value"])
    df = spark.read.parquet(f"{home}/data")
    found = store.content_hash(df).first()
    if (manifest["hash"], manifest["n"]) != (content, found["n"]) or found["hash"] != content or df.schema.simpleString() != manifest["schema"]:
        raise ValueError(f"the snapshot at {home} is not the one that was pinned")
    return df

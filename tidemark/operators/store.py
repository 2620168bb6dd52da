"""Maintenance of a vintage store: what is new, what drifted, compaction and status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import first_friday_release
from tidemark.operators.calendar import quarterly_vintage
from tidemark.schemas import STORE_KEY, VINTAGE, conform


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in keys])


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str] = STORE_KEY) -> DataFrame:
    """Rows whose key is not stored; nulls in keys are equal.  Of several incoming rows of a key the earliest vintage counts."""
    known = stored.select(*keys)
    return compact(incoming.join(known, _same(incoming, known, keys), "left_anti"), keys)


def drift(incoming: DataFrame, stored: DataFrame, keys: list[str] = STORE_KEY) -> DataFrame:
    """Keys that are stored with another level: ``employment`` is incoming, ``stored`` the old one."""
    old = stored.select(*keys, F.col("employment").alias("stored"))
    joined = incoming.join(old, _same(incoming, old, keys))
    return joined.where("employment <> stored").select(*[incoming[c] for c in keys], incoming["employment"], "stored")


def compact(df: DataFrame, keys: list[str] = STORE_KEY) -> DataFrame:
    """One row for each key: the earliest vintage, then the smallest level."""
    w = Window.partitionBy(*keys).orderBy("vintage_date", "employment")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def append(incoming: DataFrame, path: str) -> int:
    """Write the new rows to the store at ``path``, and return how many; a second run appends none."""
    spark = incoming.sparkSession
    rows = conform(incoming, VINTAGE, fill=True)
    if exists(spark, path):
        rows = new_rows(rows, read(spark, path))
    else:
        rows = compact(rows)
    rows = rows.persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").partitionBy("source", "seasonally_adjusted").parquet(path)
        return n
    finally:
        rows.unpersist()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store with its fixed schema: columns that older files lack are null, partition filters prune folders."""
    return spark.read.schema(VINTAGE).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at a path of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def rewrite(spark: SparkSession, path: str, staging: str) -> None:
    """Compact all partitions: written to ``staging`` first, then over the partitions it holds."""
    compact(read(spark, path)).write.mode("overwrite").partitionBy("source", "seasonally_adjusted").parquet(staging)
    spark.read.schema(VINTAGE).parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "source", "seasonally_adjusted"
    ).parquet(path)


def content_hash(df: DataFrame) -> DataFrame:
    """One row ``n, hash``: the same for any order of the same rows, repeats included."""
    h = F.xxhash64(*sorted(df.columns))
    parts = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return parts.select("n", F.sha2(F.concat_ws(":", "n", "x", "s"), 256).alias("hash"))


def coverage(df: DataFrame, by: tuple[str, ...] = ("source", "seasonally_adjusted")) -> DataFrame:
    """Rows, reference range, newest vintage and number of vintages of each partition."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.min("ref_date").alias("first_ref"), F.max("ref_date").alias("last_ref"),
        F.max("vintage_date").alias("last_vintage"), F.count_distinct("vintage_date").alias("n_vintages"),
    )


def month_gaps(df: DataFrame, by: list[str]) -> DataFrame:
    """Months inside a series' range that it lacks."""
    months = df.select(*by, F.trunc("ref_date", "MM").alias("month")).distinct()
    span = months.groupBy(*by).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    full = span.select(*by, F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return full.join(months, [*by, "month"], "left_anti")


def frontier(df: DataFrame) -> DataFrame:
    """The newest vintage, or 1900-01-01 for an empty store."""
    return df.agg(F.coalesce(F.max("vintage_date"), F.lit("1900-01-01").cast("date")).alias("frontier"))


def status(df: DataFrame, as_of: Column, headline: tuple[str, ...] = ("00", "05"), shutdown: tuple[str, ...] = ()) -> DataFrame:
    """The state of a store as rows of a ``kind``, with what they name as ``token``.

    * ``coverage``: each source and adjustment, with its counts and ranges;
    * ``uncaptured``: months of the adjusted survey (``ces:2020-01-01``) and quarters
      of the census (``qcew:2020-Q1``) after the newest stored one whose first print
      was out by ``as_of``;
    * ``missing``: months inside the national headline series of the adjusted survey
      that no row has, whatever its level; those of ``shutdown`` are marked so.

    An empty store gives no row.  All but the coverage comes from a few rows.
    """
    parts = coverage(df)
    held = parts.select(F.lit("coverage").alias("kind"), "source", "seasonally_adjusted", F.lit(None).cast("string").alias("token"), "n_rows", "first_ref", "last_ref", "last_vintage", "n_vintages")
    bound = as_of.cast("date")

    def walk(source: str, adjusted: bool, first: Column, months: int, out: Column, token: Column) -> DataFrame:
        start = parts.where((F.col("source") == source) & (F.col("seasonally_adjusted") == adjusted)).select("source", "seasonally_adjusted", first.alias("_a")).where(F.col("_a") <= bound)
        due = start.withColumn("at", F.explode(F.sequence("_a", bound, F.expr(f"interval {months} months"))))
        return due.where(out <= bound).select(F.lit("uncaptured").alias("kind"), "source", "seasonally_adjusted", token.alias("token"))

    at = F.col("at")
    survey = walk("ces", True, F.add_months(F.trunc("last_ref", "MM"), 1), 1, first_friday_release(at), F.concat(F.lit("ces:"), at.cast("string")))
    quarter = F.concat(F.lit("qcew:"), F.year(at), F.lit("-Q"), F.quarter(at))
    census = walk("qcew", False, F.add_months(F.trunc("last_ref", "quarter"), 3), 3, quarterly_vintage(at, F.lit(0)), quarter)
    heads = df.where((F.col("source") == "ces") & F.col("seasonally_adjusted") & (F.col("geographic_type") == "national") & (F.col("geographic_code") == "00") & F.col("industry_code").isin(*headline))
    label = F.date_format("month", "yyyy-MM")
    marked = F.concat(label, F.when(label.isin(*shutdown), " [known-shutdown]").otherwise(""))
    gaps = month_gaps(heads, ["source", "seasonally_adjusted"]).select(F.lit("missing").alias("kind"), "source", "seasonally_adjusted", marked.alias("token"))
    return held.unionByName(survey.unionByName(census).unionByName(gaps), allowMissingColumns=True)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Every key of either side with its status: match, mismatch, left_only or right_only.  Keys must not be null."""
    a = left.select(*keys, F.col(value).alias("left_value"))
    b = right.select(*keys, F.col(value).alias("right_value"))
    status = (
        F.when(F.col("right_value").isNull(), "left_only")
        .when(F.col("left_value").isNull(), "right_only")
        .when(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, "match")
        .otherwise("mismatch")
    )
    return a.join(b, keys, "full_outer").withColumn("status", status)

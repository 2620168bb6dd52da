"""Revision triangles and vintage matrices in long form: (series, ref_date, vintage_date, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def extract_prints(matrix: DataFrame, by: list[str], max_gap_days: int) -> DataFrame:
    """The first three appearances of each date as revisions 0 to 2, where the first is at most so many days after it."""
    w = Window.partitionBy(*by, "ref_date").orderBy("vintage_date")
    ranked = matrix.where("value IS NOT NULL").withColumns({"revision": F.row_number().over(w) - 1, "_first": F.min("vintage_date").over(w)})
    return ranked.where((F.col("revision") < 3) & (F.datediff("_first", "ref_date") <= max_gap_days)).drop("_first")


def diagonals(triangle: DataFrame, by: list[str]) -> DataFrame:
    """From each date's own release the values of three releases running, up to the first that is missing.

    ``triangle`` has ``release`` and ``ref`` as month numbers.
    """
    own = triangle.withColumn("revision", (F.col("release") - F.col("ref")).cast("int")).where("revision BETWEEN 0 AND 2")
    w = Window.partitionBy(*by, "ref").orderBy("revision")
    broken = F.col("value").isNull() | (F.col("revision") != F.col("_at") - 1)
    counted = own.withColumn("_at", F.row_number().over(w)).withColumn("_gap", F.sum(broken.cast("int")).over(w))
    return counted.where("_gap = 0").drop("_at", "_gap")


def benchmark_walk(triangle: DataFrame, by: list[str]) -> DataFrame:
    """Values of January releases after a date's year, each where it differs from the one before; numbered from 1."""
    rows = triangle.where("value IS NOT NULL AND release_month = 1 AND release_year > ref_year")
    w = Window.partitionBy(*by, "ref_year", "ref_month").orderBy("release_year")
    changed = rows.withColumn("_before", F.lag("value").over(w)).where("_before IS NULL OR _before <> value").drop("_before")
    return changed.withColumn("benchmark_revision", F.row_number().over(w))


def first_and_latest(long: DataFrame, by: list[str]) -> DataFrame:
    """Initial and latest value of each key across its vintages."""
    return long.where("value IS NOT NULL").groupBy(*by).agg(F.min_by("value", "vintage_date").alias("initial"), F.max_by("value", "vintage_date").alias("latest"))

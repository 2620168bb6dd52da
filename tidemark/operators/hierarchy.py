"""Hierarchies: unpivoting, roll-ups by membership, size schemes, nesting checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Buckets of the size schemes, as lists of native codes.
SIZE_SCHEMES = {
    "total": {"0": ("1", "2", "3", "4", "5", "6", "7", "8", "9")},
    "small": {"1": ("1", "2", "3", "4", "5"), "2": ("6", "7"), "3": ("8", "9")},
    "medium": {"1": ("1", "2", "3", "4"), "2": ("5",), "3": ("6",), "4": ("7",), "5": ("8", "9")},
    "large": {"1": ("1",), "2": ("2",), "3": ("3",), "4": ("4",), "5": ("5",), "6": ("6",), "7": ("7",), "8": ("8",), "9": ("9",)},
}


def unpivot_months(df: DataFrame, ids: list[str], columns: list[str], scale: float = 1.0) -> DataFrame:
    """Columns month1 to month3 of a quarter (``year``, ``qtr``) as rows: ``ref_date`` on day 12, ``value`` divided by ``scale``."""
    long = df.unpivot([*ids, "year", "qtr"], columns, "month_name", "value").where("value IS NOT NULL")
    month = (F.col("qtr") - 1) * 3 + F.regexp_extract("month_name", r"month(\d)", 1).cast("int")
    return long.select(*ids, F.make_date(F.col("year"), month, F.lit(12)).alias("ref_date"), (F.col("value") / scale).alias("value"))


def roll_up(df: DataFrame, member: str, ancestors: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sums of ``value`` for every ancestor of each member; one shuffle, whatever the number of levels.

    ``ancestors`` (a dimension: member, level, code) may list several, overlapping ones; unmapped members are left out.
    """
    joined = df.join(F.broadcast(ancestors.withColumnRenamed("member", member)), member)
    return joined.groupBy(*by, "level", "code").agg(F.sum(value).alias(value))


def size_schemes(df: DataFrame, native: str, by: list[str], value: str) -> DataFrame:
    """Sums by bucket of every size scheme, from native size codes 1 to 9."""
    rows = [(code, scheme, bucket) for scheme, buckets in SIZE_SCHEMES.items() for bucket, codes in buckets.items() for code in codes]
    members = df.sparkSession.createDataFrame(rows, f"`{native}` string, size_class_type string, size_class_code string")
    return df.join(F.broadcast(members), native).groupBy(*by, "size_class_type", "size_class_code").agg(F.sum(value).alias(value))


def nesting(df: DataFrame, edges: DataFrame, code: str, by: list[str], value: str, tolerance: float) -> DataFrame:
    """Parents beside the sums of their children, where all children are there; ``ok`` is within the tolerance.

    ``edges`` is a dimension (parent, child).
    """
    parts = df.join(F.broadcast(edges), F.col(code) == F.col("child")).groupBy(*by, "parent").agg(F.sum(value).alias("children"), F.count_distinct("child").alias("n"))
    expected = edges.groupBy("parent").agg(F.count("*").alias("n"))
    complete = parts.join(F.broadcast(expected), ["parent", "n"], "left_semi")
    own = df.select(*by, F.col(code).alias("parent"), F.col(value).alias("level"))
    return complete.join(own, [*by, "parent"]).select(*by, "parent", "level", "children", (F.abs(F.col("level") - F.col("children")) <= tolerance).alias("ok"))

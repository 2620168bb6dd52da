"""Views of a panel of prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def real_time_view(panel: DataFrame, as_of: Column, keys: list[str]) -> DataFrame:
    """The highest revision published by ``as_of``; benchmark prints (-1) lose to first ones."""
    return _first(panel.where(F.col("vintage_date") <= as_of), keys, F.desc("revision_number"), F.desc("vintage_date"))


def best_print(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Final prints first, then the most revised; benchmark prints (-1) count as most revised."""
    rank = F.when(F.col("revision_number") == -1, 999).otherwise(F.col("revision_number"))
    return _first(panel, keys, F.desc("is_final"), F.desc(rank), F.desc("vintage_date"))


def final_view(panel: DataFrame) -> DataFrame:
    return panel.where("is_final")


def specific_vintage_view(panel: DataFrame, source: str, revision: int) -> DataFrame:
    return panel.where((F.col("source") == source) & (F.col("revision_number") == revision))


def vintage_diff(panel: DataFrame, source: str, rev_a: int, rev_b: int, keys: list[str]) -> DataFrame:
    """Growth of two revisions and their difference, in one pass over the panel."""
    one = lambda r: F.max(F.when(F.col("revision_number") == r, F.col("growth")))
    both = panel.where((F.col("source") == source) & F.col("revision_number").isin(rev_a, rev_b))
    out = both.groupBy(*keys).agg(one(rev_a).alias("growth_a"), one(rev_b).alias("growth_b"))
    return out.where("growth_a IS NOT NULL AND growth_b IS NOT NULL").withColumn("difference", F.col("growth_b") - F.col("growth_a"))

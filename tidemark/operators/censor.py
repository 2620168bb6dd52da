"""What was knowable on a day: censoring, growth within revision cohorts, and the choice of prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import months_between
from tidemark.functions.series import finite, is_final, revision_number, source_tag, source_type
from tidemark.schemas import COHORT, SERIES


def knowable(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows published by ``as_of`` about dates before it; both filters reach the scan."""
    return df.where((F.col("vintage_date") <= as_of) & (F.col("ref_date") < as_of))


def valid(df: DataFrame) -> DataFrame:
    """Rows with keys and a positive level; negative levels stand for months without a print."""
    keys = [F.col(c).isNotNull() for c in ("ref_date", "vintage_date", "industry_code", "revision")]
    return df.where(keys[0] & keys[1] & keys[2] & keys[3] & (F.col("employment") > 0))


def growth(df: DataFrame, by: list[str] = COHORT, require_adjacent: bool = False) -> DataFrame:
    """Adds ``growth``, the log difference to the row before in its cohort, and drops rows without one.

    With ``require_adjacent`` the row before must be the month before.
    """
    w = Window.partitionBy(*by).orderBy("ref_date", "vintage_date")
    g = F.ln("employment") - F.ln(F.lag("employment").over(w))
    if require_adjacent:
        g = F.when(months_between(F.col("ref_date"), F.lag("ref_date").over(w)) == 1, g)
    return df.withColumn("growth", g).where(finite(F.col("growth")))


def _pick(df: DataFrame, keys: list[str], match: Column) -> DataFrame:
    order = Window.partitionBy(*keys, "ref_date").orderBy(F.desc("ok"), F.desc("revision"), F.desc("benchmark_revision"), F.desc("vintage_date"), "employment")
    return df.withColumn("ok", match.cast("int")).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_rank")


def select_monthly(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """The print that the horizon calls for: the newest month's first, the next one's second, older ones' third.

    Months without that print take their most revised one (``ok`` = 0).
    """
    ranked = df.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("ref_date"))))
    want = F.least(F.col("_rank") - 1, F.lit(2))
    return _pick(ranked, keys, (F.col("benchmark_revision") == 0) & (F.col("revision") == want))


def select_quarterly(df: DataFrame, settled_before: Column, keys: list[str] = SERIES) -> DataFrame:
    """The census print that the horizon calls for; before ``settled_before`` the most revised one.

    Ranks count only dates from ``settled_before`` on.  Rank 1 takes revision 0, rank 2 revision 1, rank 3
    revision 2 (quarter 4: 1), rank 4 revision 3 (quarter 3: 2, quarter 4: 1); older ones the most revised.
    """
    recent = F.col("ref_date") >= settled_before
    # settled rows rank in a partition of their own, so that they do not count
    ranked = df.withColumn("_rank", F.when(recent, F.dense_rank().over(Window.partitionBy(*keys, recent).orderBy(F.desc("ref_date")))))
    q = F.quarter("ref_date")
    want = (
        F.when(F.col("_rank") == 1, 0)
        .when(F.col("_rank") == 2, 1)
        .when(F.col("_rank") == 3, F.when(q == 4, 1).otherwise(2))
        .when(F.col("_rank") == 4, F.when(q == 4, 1).when(q == 3, 2).otherwise(3))
    )
    return _pick(ranked, keys, F.coalesce(F.col("revision") == want, F.lit(False)))


def latest_generation(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the latest vintage for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("vintage_date"), F.desc("benchmark_revision"), F.desc("revision"))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def to_panel(store: DataFrame, as_of: Column | None, settled_before: Column) -> DataFrame:
    """The growth panel: knowable valid rows, growth by cohort, chosen prints, panel columns.  One lazy plan."""
    rows = valid(store if as_of is None else knowable(store, as_of))
    grown = growth(rows)
    if as_of is not None:
        monthly = select_monthly(grown.where("source = 'ces'"))
        grown = monthly.unionByName(select_quarterly(grown.where("source <> 'ces'"), settled_before)).drop("ok")
    tagged = grown.withColumns(
        {"source_tag": source_tag(), "source_type": source_type(), "revision_number": revision_number(), "is_final": is_final(settled_before)}
    )
    panel = tagged.select(
        F.col("ref_date").alias("period"), "geographic_type", "geographic_code", "industry_code", F.col("industry_type").alias("industry_level"),
        F.col("source_tag").alias("source"), "source_type", "growth", F.col("employment").alias("employment_level"),
        F.col("seasonally_adjusted").alias("is_seasonally_adjusted"), "vintage_date", "revision_number", "is_final",
        months_between(F.col("vintage_date"), F.col("ref_date")).alias("publication_lag_months"), F.lit(None).cast("double").alias("coverage_ratio"), "benchmark_revision", F.col("revision"),
    )
    keys = ["period", "geographic_type", "geographic_code", "industry_level", "industry_code", "source", "revision_number"]
    return latest_generation(panel, keys).drop("benchmark_revision", "revision")


def as_of_grid(store: DataFrame, dates: DataFrame) -> DataFrame:
    """Every date of ``dates`` (column ``as_of``, a stated grid) with the rows knowable at it."""
    return store.join(F.broadcast(dates), (F.col("vintage_date") <= F.col("as_of")) & (F.col("ref_date") < F.col("as_of")))

"""Checks as tables of findings: check, severity, number of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import months_between
from tidemark.functions.series import finite


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def findings(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row for each check of (severity, condition of a violation), from a single pass."""
    counted = df.agg(*[F.count(F.when(c, 1)).alias(name) for name, (_, c) in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(n).alias("violations")) for n, (s, _) in checks.items()])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def panel_findings(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Growth must be finite, keys unique, payroll prints unrevised."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return findings(
        panel.withColumn("_n", n),
        {
            "duplicate_key": ("error", F.col("_n") > 1),
            "growth_not_finite": ("error", F.col("growth").isNotNull() & ~finite(F.col("growth"))),
            "payroll_revised": ("error", (F.col("source_type") == "payroll") & (F.col("revision_number") != 0)),
        },
    )


def selection_findings(df: DataFrame, keys: list[str], date: str = "ref_date") -> DataFrame:
    """Of chosen prints: dates unique and months consecutive within a series, levels positive, growth finite."""
    w = Window.partitionBy(*keys).orderBy(date)
    return findings(
        df.withColumns({"_n": F.count("*").over(Window.partitionBy(*keys, date)), "_gap": months_between(F.col(date), F.lag(date).over(w))}),
        {
            "duplicate_date": ("error", F.col("_n") > 1),
            "month_gap": ("error", F.col("_gap") > 1),
            "level_not_positive": ("error", ~(F.col("employment") > 0)),
            "growth_not_finite": ("error", ~finite(F.col("growth"))),
        },
    )


def median_residual(df: DataFrame, by: list[str], ratio: str, band: float) -> DataFrame:
    """Median of (ratio - 1) with its status: within the band, outside, or collapsed where no more than half is left."""
    out = df.groupBy(*by).agg((F.median(ratio) - 1).alias("residual"))
    return out.withColumn("status", F.when(F.col("residual") < -0.5, "collapsed").when(F.abs("residual") <= band, "ok").otherwise("outside"))

"""Release calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Months from a reference date to each print, by print; -1 is the benchmark print.
MONTHLY_LAGS = {0: 1, 1: 2, 2: 3, -1: 13}
MONTHLY_NOISE = {0: 3.0, 1: 2.0, 2: 1.5, -1: 1.0}
# Months from the end of a quarter to each print, and how noisy it is.
QUARTERLY_LAGS = {1: (5, 8, 14, 20, 26), 2: (5, 11, 17, 23), 3: (5, 14, 20), 4: (8, 17)}
QUARTERLY_NOISE = {1: (25.0, 20.0, 15.0, 5.0, 1.0), 2: (17.0, 4.0, 1.2, 1.0), 3: (17.0, 4.0, 1.0), 4: (17.0, 1.0)}


def monthly_revisions(first_prints: DataFrame) -> DataFrame:
    """Three prints of each month, one a month after the other, and the benchmark print a year after the first.

    ``first_prints`` has ``publication, ref_date, vintage_date``.
    """
    prints = F.explode(F.array(*[F.struct(F.lit(r).alias("revision"), F.lit(b).alias("benchmark_revision"), F.lit(n).alias("n")) for r, b, n in ((0, 0, 0), (1, 0, 1), (2, 0, 2), (2, 1, 12))]))
    rows = first_prints.select("publication", "ref_date", "vintage_date", prints.alias("p"))
    return rows.select("publication", "ref_date", F.expr("add_months(vintage_date, p.n)").alias("vintage_date"), "p.revision", "p.benchmark_revision")


def quarterly_revisions(quarters: DataFrame) -> DataFrame:
    """All prints of each quarter: ``ref_date`` in its last month, dates the first of the month they fall in."""
    lags = F.create_map(*[x for q, v in QUARTERLY_LAGS.items() for x in (F.lit(q), F.array(*map(F.lit, v)))])
    noise = F.create_map(*[x for q, v in QUARTERLY_NOISE.items() for x in (F.lit(q), F.array(*map(F.lit, v)))])
    q = F.quarter("ref_date")
    rows = quarters.select("*", F.posexplode(lags[q]).alias("revision", "_lag"))
    return rows.withColumns({"vintage_date": F.expr("trunc(add_months(ref_date, _lag), 'MM')"), "noise": noise[q][F.col("revision")]}).drop("_lag")


def quarterly_vintage(ref_date: Column, revision: Column) -> Column:
    """When a print of the quarter of ``ref_date`` comes out, by its usual lag; null for prints that the quarter does not get."""
    lags = F.create_map(*[x for q, v in QUARTERLY_LAGS.items() for x in (F.lit(q), F.array(*map(F.lit, v)))])
    end = F.add_months(F.trunc(ref_date, "quarter"), 2)
    return F.trunc(F.add_months(end, F.get(lags[F.quarter(ref_date)], revision)), "MM")


def latest_lookup(calendar: DataFrame) -> DataFrame:
    """The newest (vintage, revision) of each reference date and benchmark track, as one coherent row."""
    w = Window.partitionBy("publication", "ref_date", "benchmark_revision").orderBy(F.desc("vintage_date"), F.desc("revision"))
    return calendar.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def tag(df: DataFrame, calendar: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the calendar's vintage columns in place of their own; benchmarked months fan out."""
    columns = ["vintage_date", "revision", "benchmark_revision"]
    return df.drop(*columns).join(calendar.select(*keys, *columns), keys, "left")


def drop_reprint_shadows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Without second prints of dates that also have a benchmark print."""
    flag = F.max((F.col("benchmark_revision") >= 1).cast("int")).over(Window.partitionBy(*keys))
    shadow = (F.col("revision") == 1) & (F.col("benchmark_revision") == 0) & (F.col("_marked") == 1)
    return df.withColumn("_marked", flag).where(~shadow).drop("_marked")


def supplement(calendar: DataFrame, more: DataFrame) -> DataFrame:
    """The calendar with rows of ``more`` for dates that it lacks."""
    return calendar.unionByName(more.join(calendar, ["publication", "ref_date"], "left_anti"))


def uncaptured(calendar: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """Calendar rows published by ``as_of`` whose print is not stored."""
    return calendar.where(F.col("vintage_date") <= as_of).join(stored, ["ref_date", "revision", "benchmark_revision"], "left_anti")

"""Backtests: what competitors said about each month before its first print, and how they did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import first_friday_release
from tidemark.operators.evaluate import error_metrics

#: Years whose months no score counts.
EXCLUDED_YEARS = (2020, 2021)


def targets(first_prints: DataFrame, months: DataFrame, regimes: dict[str, int], by: list[str]) -> DataFrame:
    """Each month of ``months`` (by, month) in each regime (name: days before the release), with its ``as_of`` and ``actual``.

    The release is the month's first print, and the first Friday of the next
    month where there is none.
    """
    known = first_prints.select(*by, "month", F.col("change").alias("actual"), F.col("vintage_date").alias("_release"))
    release = F.coalesce("_release", first_friday_release(F.col("month")))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), F.lit(d).alias("days")) for n, d in regimes.items()]))
    rows = months.join(known, [*by, "month"], "left").withColumn("_r", each)
    return rows.select(*by, "_r.regime", F.col("month").alias("target"), "actual", F.date_sub(release, F.col("_r.days")).alias("as_of"))


def naive(targets_: DataFrame, history: DataFrame, by: list[str], value: str, window: int = 12) -> DataFrame:
    """``targets_`` with ``rw``, the value of the last known month, and ``tm``, the mean of the last ``window`` known ones.

    A month is known from its ``vintage_date`` on, that day included.  Targets
    and history are dealt out by ``by`` together, once, and run through in the
    order of their dates: no target meets the history as a whole.  Only in series
    in which a month came after a later one are known months gathered and sorted.
    Targets without a known month have nulls.
    """
    past = history.where(F.col(value).isNotNull()).select(*by, F.col("vintage_date").alias("_at"), F.lit(0).alias("_kind"), F.col("month").alias("_month"), F.col(value).alias("_v"))
    rest = [c for c in targets_.columns if c not in by]
    asked = targets_.select(*by, F.col("as_of").alias("_at"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_t"))
    both = past.unionByName(asked, allowMissingColumns=True).repartition(*by)
    arrival = Window.partitionBy(*by).orderBy("_at", "_kind", "_month")
    before = arrival.rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy(*by, "_kind").orderBy("_at", "_month").rowsBetween(1 - window, 0)
    marked = both.withColumns({"_late": F.col("_month") < F.max("_month").over(before), "_mean": F.when(F.col("_kind") == 0, F.avg("_v").over(last))})
    marked = marked.withColumn("_odd", F.coalesce(F.max("_late").over(Window.partitionBy(*by)), F.lit(False)))
    sofar = arrival.rowsBetween(Window.unboundedPreceding, 0)
    gathered = F.collect_list(F.when(F.col("_odd") & (F.col("_kind") == 0), F.struct("_month", "_v"))).over(sofar)
    newest = F.slice(F.sort_array(gathered, asc=False), 1, window)
    odd_mean = F.aggregate(newest, F.lit(0.0), lambda a, x: a + x["_v"]) / F.nullif(F.size(newest), F.lit(0))
    out = marked.select(
        *by, "_kind", "_t", F.max_by("_v", "_month").over(sofar).alias("rw"),
        F.when(F.col("_odd"), odd_mean).otherwise(F.last("_mean", ignorenulls=True).over(sofar)).alias("tm"),
    )
    return out.where("_kind = 1").select(*by, *[F.col("_t")[c].alias(c) for c in rest], "rw", "tm")


def locked(targets_: DataFrame, consensus: DataFrame, by: list[str], lock_days: int = 1) -> DataFrame:
    """``targets_`` with ``consensus``: a month's published expectation, known from ``lock_days`` before its ``release_date`` on."""
    said = consensus.select(*by, F.col("month").alias("target"), F.col("value").alias("_said"), F.date_sub("release_date", lock_days).alias("_lock"))
    return targets_.join(said, [*by, "target"], "left").withColumn("consensus", F.when(F.col("_lock") <= F.col("as_of"), F.col("_said"))).drop("_said", "_lock")


def panel_forecast(targets_: DataFrame, panel: DataFrame, by: list[str], months: int = 3) -> DataFrame:
    """``targets_`` with ``model``: the newest level of the panel of its ``as_of``, grown by the mean of its last growth rates."""
    newest = Window.partitionBy("as_of", *by).orderBy(F.desc("period"))
    last = panel.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= months)
    level = F.max(F.when(F.col("_rn") == 1, F.col("employment_level")))
    rate = last.groupBy("as_of", *by).agg((level * (F.exp(F.avg("growth")) - 1)).alias("model"))
    return targets_.join(rate, ["as_of", *by], "left")


def scoreboard(forecasts: DataFrame, competitors: list[str], excluded: Column, by: list[str]) -> DataFrame:
    """Errors (actual less forecast) of each competitor by regime and month type, and over all month types as ``all``.

    Forecasts and actual values that are missing, and ``excluded`` rows, do not count.
    """
    pairs = ", ".join(f"'{c}', actual - {c}" for c in competitors)
    long = forecasts.where(~F.coalesce(excluded, F.lit(False)) & ~F.year("target").isin(*EXCLUDED_YEARS))
    long = long.select(*by, "regime", "month_type", F.expr(f"stack({len(competitors)}, {pairs}) AS (competitor, error)")).where("error IS NOT NULL")
    kinds = F.explode(F.array(F.col("month_type"), F.lit("all")))
    return error_metrics(long.withColumn("month_type", kinds), [*by, "regime", "month_type", "competitor"], "error")

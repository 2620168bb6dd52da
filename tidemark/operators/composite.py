"""Weighted composites of cells, carried weights and chained indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import months_between


def shares(df: DataFrame, date: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``share`` of the date's total; dates without a positive total go."""
    total = F.sum(value).over(Window.partitionBy(*by, date))
    return df.withColumn("_total", total).where("_total > 0").withColumn("share", F.col(value) / F.col("_total")).drop("_total")


def carry_forward(targets: DataFrame, weights: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    """For each target the newest weight date up to it, else the earliest; and how many months stale it is.

    An as-of join by union and a running window: one shuffle on ``by``, no range join.
    """
    both = targets.select(*by, date, F.lit(None).cast("date").alias("_w")).unionByName(weights.select(*by, F.col(date), F.col(date).alias("_w")))
    w = Window.partitionBy(*by).orderBy(date, F.col("_w").asc_nulls_last())
    run = Window.partitionBy(*by).orderBy(date).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = both.withColumn("_last", F.last("_w", True).over(run)).withColumn("_first", F.min("_w").over(Window.partitionBy(*by)))
    out = known.where("_w IS NULL").withColumn("weight_date", F.coalesce("_last", "_first"))
    return out.select(*by, date, "weight_date", F.greatest(F.lit(0), months_between(F.col(date), F.col("weight_date"))).alias("months_stale"))


def redistribute(weights: Column, covered: Column, group: list[int], region: list[int]) -> Column:
    """Weights with those of uncovered cells moved to covered ones, as an array that sums to 1.

    One fold over the cells in order: to the covered cells of its group in proportion, else to those of
    its region, else to all (evenly where they have none).  Weights already moved count for later cells.
    """
    n = len(group)
    kinds = F.array(*map(F.lit, group)), F.array(*map(F.lit, region))

    def move(state: Column, i: Column) -> Column:
        w = F.get(state, i)

        def total(kind: Column | None) -> Column:
            parts = F.transform(state, lambda x, j: F.when(F.get(covered, j) & ((F.get(kind, j) == F.get(kind, i)) if kind is not None else F.lit(True)), x).otherwise(0.0))
            return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

        # sums are taken once for each cell, not once for each pair of cells
        sums = F.struct(total(kinds[0]).alias("group"), total(kinds[1]).alias("region"), total(None).alias("all"))
        n_covered = F.size(F.filter(covered, lambda c: c))

        def step(s: Column) -> Column:
            level = F.when(s["group"] > 0, 0).when(s["region"] > 0, 1).when(s["all"] > 0, 2).otherwise(3)
            base = F.when(level == 0, s["group"]).when(level == 1, s["region"]).otherwise(s["all"])

            def moved(x: Column, j: Column) -> Column:
                gets = F.get(covered, j) & (
                    ((level == 0) & (F.get(kinds[0], j) == F.get(kinds[0], i))) | ((level == 1) & (F.get(kinds[1], j) == F.get(kinds[1], i))) | (level >= 2)
                )
                return F.when(j == i, 0.0).when(gets, x + F.when(level == 3, w / n_covered).otherwise(w * x / base)).otherwise(x)

            return F.transform(state, moved)

        return F.when(F.get(covered, i) | (w == 0), state).otherwise(F.get(F.transform(F.array(sums), step), F.lit(0)))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), weights, move)
    total = F.aggregate(out, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(out, lambda x: x / total)).otherwise(out)


def weighted_growth(cells: DataFrame, by: list[str], cell: str, date: str, value: str, count: str, share: str, least: int) -> DataFrame:
    """Share-weighted log growth of the cells covered by at least ``least`` units now and the month before; weights renormalised."""
    w = Window.partitionBy(*by, cell).orderBy(date)
    adjacent = months_between(F.col(date), F.lag(date).over(w)) == 1
    grown = cells.withColumns({"_g": F.when(adjacent, F.ln(value) - F.ln(F.lag(value).over(w))), "_n": F.lag(count).over(w)})
    covered = grown.where((F.col(count) >= least) & (F.col("_n") >= least) & F.col("_g").isNotNull())
    return covered.groupBy(*by, date).agg((F.sum(F.col(share) * F.col("_g")) / F.sum(share)).alias("growth"), F.sum(share).alias("coverage"))


def cumulative_index(df: DataFrame, by: list[str], date: str, through_gaps: bool = True) -> DataFrame:
    """Adds ``level``: 100 chained by ``growth``.  Missing growth carries the level on, or (without ``through_gaps``) ends it."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.col("growth").isNotNull().cast("int")).over(w) == 1
    level = 100 * F.exp(F.sum(F.coalesce("growth", F.lit(0.0))).over(w))
    if through_gaps:
        return df.withColumn("level", F.when(seen, level))
    started = df.withColumn("_seen", seen)
    broken = F.max((F.col("growth").isNull() & F.col("_seen")).cast("int")).over(w) == 1
    return started.withColumn("level", F.when(F.col("_seen") & ~broken, level)).drop("_seen")


def cell_arrays(cells: DataFrame, index: DataFrame, by: list[str], values: list[str], size: int) -> DataFrame:
    """Each group's cells as dense arrays in canonical order, with ``mask`` where a cell is there; null where none is.

    ``index`` is a dimension (key columns, ``place`` from 0); cells that it lacks
    are left out.  A cell that is given twice is an error, as an array has one
    place for it.  Nothing is pivoted, so no list of values is asked for first.
    """
    keys = [c for c in index.columns if c != "place"]
    placed = cells.join(F.broadcast(index), keys).where(F.col("place").between(0, size - 1))
    entry = F.struct("place", F.struct(*values).alias("v"))
    found = placed.groupBy(*by).agg(F.collect_list(entry).alias("_cells"))  # at most ``size`` of them, or the next step fails
    by_place = found.select(*by, F.map_from_entries("_cells").alias("_at"))
    each = F.sequence(F.lit(0), F.lit(size - 1))

    def dense(name: str) -> Column:
        return F.transform(each, lambda i: F.try_element_at(F.col("_at"), i)[name]).alias(name)

    there = F.transform(each, lambda i: F.try_element_at(F.col("_at"), i).isNotNull())
    return by_place.select(*by, there.alias("mask"), *map(dense, values))

"""Composing a rebuilt store, and comparing legs of one release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import month, months_between


def wedge(total: DataFrame, part: DataFrame, by: list[str], tolerance_days: int = 15) -> DataFrame:
    """Difference of two first-print changes of one month; ``same_release`` is false where their release dates are too far apart."""
    a = total.select(*by, "month", F.col("vintage_date").alias("va"), F.col("change").alias("total"))
    b = part.select(*by, "month", F.col("vintage_date").alias("vb"), F.col("change").alias("part"))
    near = F.abs(F.datediff("va", "vb")) <= tolerance_days
    return a.join(b, [*by, "month"]).select(*by, "month", "total", "part", (F.col("total") - F.col("part")).alias("wedge"), near.alias("same_release"))


def override_totals(sized: DataFrame, totals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of all sizes (code 0) take the level of ``totals`` where it has one; others keep theirs."""
    joined = sized.join(totals.select(*keys, F.col(value).alias("_area")), keys, "left")
    return joined.withColumn(value, F.when(F.col("size_class_code") == "0", F.coalesce("_area", value)).otherwise(F.col(value))).drop("_area")


def compose(levels: DataFrame, sized: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sized rows with their totals set by ``levels``, and the rows of ``levels`` that have no sizes."""
    plain = levels.join(sized.select(*keys).distinct(), keys, "left_anti")
    return override_totals(sized, levels, keys, value).unionByName(plain, allowMissingColumns=True)


def archive_window(calendar: DataFrame, prints: DataFrame, by: list[str], frontier: Column, through: Column) -> DataFrame:
    """Prints of an archive in the calendar's rows after the frontier and up to a date, with the calendar's vintage dates; all series at once."""
    window = calendar.where((F.col("vintage_date") > frontier) & (F.col("vintage_date") <= through) & (F.col("benchmark_revision") == 0) & F.col("revision").between(0, 2))
    found = prints.select(*by, month(F.col("ref_date")).alias("_m"), "revision", "value")
    return window.withColumn("_m", month(F.col("ref_date"))).join(found, ["_m", "revision"]).drop("_m")


def replace_dates(calendar: DataFrame, wrong: DataFrame, companion: DataFrame) -> DataFrame:
    """Vintage dates of the (publication, ref_date) in ``wrong`` from a companion publication, else its fallback."""
    dates = wrong.join(companion.select("ref_date", F.col("vintage_date").alias("_c")), "ref_date", "left")
    dates = dates.select("publication", "ref_date", F.coalesce("_c", "fallback").alias("_d"))
    return calendar.join(dates, ["publication", "ref_date"], "left").withColumn("vintage_date", F.coalesce("_d", "vintage_date")).drop("_d")


def settled_changes(store: DataFrame, by: list[str], require_adjacent: bool = False) -> DataFrame:
    """Changes between the latest-vintage levels of successive months; across gaps as well, unless adjacency is required."""
    levels = store.withColumn("month", month(F.col("ref_date"))).groupBy(*by, "month").agg(F.max_by("employment", F.struct("vintage_date", "revision", "employment")).alias("level"))
    w = Window.partitionBy(*by).orderBy("month")
    out = levels.withColumns({"change": F.col("level") - F.lag("level").over(w), "_gap": months_between(F.col("month"), F.lag("month").over(w))})
    return out.where("change IS NOT NULL" + (" AND _gap = 1" if require_adjacent else "")).drop("_gap")


def quarter_continuity(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """First-quarter levels against the mean of adjoining months outside it; ``ok`` is within ``share`` of them."""
    w = Window.partitionBy(*by).orderBy("month")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    outside = lambda d, gap: (gap == 1) & (F.quarter(d) != 1)
    b = F.when(outside(F.lag("month").over(w), months_between(F.col("month"), F.lag("month").over(w))), before)
    a = F.when(outside(F.lead("month").over(w), months_between(F.lead("month").over(w), F.col("month"))), after)
    sides = F.when(b.isNotNull() & a.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))
    out = df.withColumn("beside", sides).where((F.quarter("month") == 1) & F.col("beside").isNotNull())
    return out.withColumn("ok", F.abs(F.col(value) / F.col("beside") - 1) <= share)


def pad(df: DataFrame, by: list[str], index: str, values: list[str]) -> DataFrame:
    """Every group filled up to the longest one's length; ``mask`` tells real rows."""
    length = df.groupBy(*by).agg(F.max(index).alias("n")).agg(F.max("n").alias("n"))
    grid = df.select(*by).distinct().join(F.broadcast(length.select(F.explode(F.expr("sequence(0, n)")).alias(index))))
    joined = grid.join(df.select(*by, index, *values).withColumn("mask", F.lit(True)), [*by, index], "left")
    return joined.withColumns({"mask": F.coalesce("mask", F.lit(False)), **{v: F.coalesce(v, F.lit(0.0)) for v in values}})


def pooled_bias(df: DataFrame, by: list[str], revision: str, method: str = "median") -> DataFrame:
    """Median or mean of the finite revisions."""
    f = F.median(revision) if method == "median" else F.avg(revision)
    return df.where(F.col(revision).isNotNull() & ~F.isnan(revision)).groupBy(*by).agg(f.alias("bias"), F.count("*").alias("n"))


def splice_metrics(df: DataFrame, by: list[str], first: str, best: str, predicted: str, threshold: float) -> DataFrame:
    """Mean absolute errors with and without the months whose best print is a splice: over ``threshold`` from the first."""
    e, splice = F.abs(F.col(predicted) - F.col(best)), F.abs(F.col(best) - F.col(first)) > threshold
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(splice, 1)).alias("n_splice"), F.avg(e).alias("mae"), F.avg(F.when(~splice, e)).alias("mae_without"))


def draw_paths(draws: DataFrame, by: list[str], t: str, growth: str, base: float) -> DataFrame:
    """Mean growth over draws by period, the index it chains to from ``base``, and its change.

    Growth is summed in decimals of ten places, so that the index does not depend on the order of addition.
    """
    mean = draws.groupBy(*by, t).agg(F.round(F.avg(growth), 10).cast("decimal(20,10)").alias("growth"))
    w = Window.partitionBy(*by).orderBy(t)
    index = mean.withColumn("index", base * F.exp(F.sum("growth").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("double"))).withColumn("growth", F.col("growth").cast("double"))
    return index.withColumn("change", F.col("index") - F.coalesce(F.lag("index").over(w), F.lit(base)))

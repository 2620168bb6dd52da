"""Gates that decide on a rebuilt store: a row for each check with its severity and number of violations.

A rebuild passes when no ``hard`` check has violations.  Keys compare null-safe: null equals null.
Empty frames give rows as well, with the check that says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import all_sizes

INDUSTRY = ["industry_type", "industry_code", "ownership"]
SERIES_ID = ["geographic_type", "geographic_code", *INDUSTRY]
PRINT = [*SERIES_ID, "ref_date", "revision", "benchmark_revision"]
#: The prints that a full series has: revision, benchmark revision.
COHORTS = [(0, 0), (1, 0), (2, 0), (2, 1)]


def headline(df: DataFrame, adjusted: bool | None = None) -> DataFrame:
    """Rows of all sizes together, of one adjustment or of both."""
    rows = df.where(all_sizes())
    return rows if adjusted is None else rows.where(F.col("seasonally_adjusted") == adjusted)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], values: dict[str, str], how: str = "inner") -> DataFrame:
    """``left`` with ``values`` (column of right: new name); nulls in keys are equal.  Keys that only right has take its values."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c).alias(n) for c, n in values.items()])
    joined = left.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]), how)
    if how == "full_outer":
        joined = joined.withColumns({k: F.coalesce(k, f"_r_{k}") for k in keys})
    return joined.drop(*[f"_r_{k}" for k in keys])


def verdict(counted: DataFrame, severity: dict[str, str]) -> DataFrame:
    """One row of counts as rows ``check, severity, violations``."""
    rows = [F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("violations")) for c, s in severity.items()]
    return counted.select(F.inline(F.array(*rows)))


def passed(verdicts: DataFrame) -> DataFrame:
    """One row ``passed``: no hard check has violations."""
    return verdicts.agg((F.count_if((F.col("severity") == "hard") & (F.col("violations") > 0)) == 0).alias("passed"))


def off(value: str, reference: str, abs_tol: float, rel_tol: float = 0.0) -> Column:
    """Whether two levels differ by more than the tolerances allow."""
    return F.abs(F.col(value) - F.col(reference)) > abs_tol + rel_tol * F.abs(F.col(reference))


def cohort_match(rebuilt: DataFrame, existing: DataFrame) -> DataFrame:
    """Prints of both sides, with the other level as ``existing``, in one join.

    Benchmark prints of a month stand once for each benchmark, so they match within a vintage; all others whatever theirs.
    """
    fan = F.when((F.col("revision") == 2) & (F.col("benchmark_revision") == 1), F.col("vintage_date"))
    return null_safe_join(rebuilt.withColumn("_fan", fan), existing.withColumn("_fan", fan), [*PRINT, "_fan"], {"employment": "existing"}).drop("_fan")


def missing_members(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``required`` whose keys ``present`` lacks."""
    return null_safe_join(required, present.select(*keys).distinct(), keys, {}, "left_anti")


def history(rebuilt: DataFrame, existing: DataFrame, roots: DataFrame, cutoff: Column, abs_tol: float = 0.5, rel_tol: float = 1e-6) -> DataFrame:
    """Unadjusted prints before ``cutoff`` must repeat those of the existing store.

    First and second prints are hard, prints that a benchmark touched are soft.  ``roots`` are industries that need every cohort.
    """
    new, old = (headline(df, adjusted=False).where(F.col("ref_date") < cutoff) for df in (rebuilt, existing))
    cohorts = F.inline(F.array(*[F.struct(F.lit(r).alias("revision"), F.lit(b).alias("benchmark_revision")) for r, b in COHORTS]))
    absent = missing_members(roots.select(*INDUSTRY, cohorts), new, [*INDUSTRY, "revision", "benchmark_revision"])
    free = (F.col("benchmark_revision") == 0) & (F.col("revision") < 2)
    bad = off("employment", "existing", abs_tol, rel_tol)
    counted = cohort_match(new, old).agg(
        (F.count("*") == 0).cast("long").alias("no_overlap"),
        F.count_if(bad & free).alias("first_prints_differ"), F.count_if(bad & ~free).alias("benchmark_prints_differ"),
    )
    out = verdict(absent.agg(F.count("*").alias("cohort_missing")), {"cohort_missing": "hard"})
    return out.unionByName(verdict(counted, {"no_overlap": "hard", "first_prints_differ": "hard", "benchmark_prints_differ": "soft"}))


def fidelity(rebuilt: DataFrame, reference: DataFrame, keys: list[str], abs_tol: float, rel_tol: float = 0.0) -> DataFrame:
    """Levels of shared keys must agree with the reference; keys of one side only are soft."""
    new = headline(rebuilt).select(*keys, F.col("employment").alias("rebuilt"), F.lit(True).alias("_new"))
    old = headline(reference).withColumn("_old", F.lit(True))
    both = null_safe_join(new, old, keys, {"employment": "reference", "_old": "_old"}, "full_outer")
    counted = both.agg(
        ((F.count("_new") == 0) | (F.count("_old") == 0)).cast("long").alias("side_empty"), F.count_if(off("rebuilt", "reference", abs_tol, rel_tol)).alias("values_differ"),
        F.count_if(F.col("_old").isNull()).alias("only_rebuilt"), F.count_if(F.col("_new").isNull()).alias("only_reference"),
    )
    return verdict(counted, {"side_empty": "hard", "values_differ": "hard", "only_rebuilt": "soft", "only_reference": "soft"})


def gap_fill(rebuilt: DataFrame, required: DataFrame, frontier: str, years: list[int]) -> DataFrame:
    """Required industries that are missing at the frontier date, and in the benchmark print of each December."""
    rows = headline(rebuilt, adjusted=False)
    benchmark = (F.col("revision") == 2) & (F.col("benchmark_revision") == 1) & (F.month("ref_date") == 12)
    labels = {"frontier": F.col("ref_date") == F.lit(frontier).cast("date")} | {f"december_{y}": benchmark & (F.year("ref_date") == y) for y in years}
    held = rows.select(*INDUSTRY, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in labels.items()]))).alias("check")).distinct()
    needed = required.select(*INDUSTRY, F.explode(F.array(*map(F.lit, labels))).alias("check"))
    both = null_safe_join(needed, held.withColumn("_held", F.lit(True)), [*INDUSTRY, "check"], {"_held": "_held"}, "left")
    return both.groupBy("check").agg(F.count_if(F.col("_held").isNull()).alias("violations")).select("check", F.lit("hard").alias("severity"), "violations")


def integrity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of an as-of slice: one row and one vintage for each key, levels positive; one shuffle."""
    bad = F.col("employment").isNull() | F.isnan("employment") | (F.col("employment") <= 0)
    some_null = F.max(F.col("vintage_date").isNull())
    per = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad"),
        ((F.min("vintage_date") < F.max("vintage_date")) | (some_null & F.max("vintage_date").isNotNull())).alias("mixed"),
    )
    counted = per.agg(
        (F.count("*") == 0).cast("long").alias("slice_empty"), F.count_if(F.col("n") > 1).alias("duplicate_key"),
        F.count_if("mixed").alias("mixed_vintages"), F.sum("bad").alias("level_not_positive"),
    )
    return verdict(counted, dict.fromkeys(("slice_empty", "duplicate_key", "mixed_vintages", "level_not_positive"), "hard"))


def overlap_divergence(bootstrap: DataFrame, capture: DataFrame) -> DataFrame:
    """First and second prints that both stores hold, with both levels and ``abs_diff``."""

    def scored(df: DataFrame) -> DataFrame:
        return df.where("employment > 0 AND benchmark_revision = 0 AND revision IN (0, 1)")

    left = scored(bootstrap).select(*PRINT, F.col("employment").alias("bootstrap_employment"))
    both = null_safe_join(left, scored(capture), PRINT, {"employment": "capture_employment"})
    return both.withColumn("abs_diff", F.abs(F.col("capture_employment") - F.col("bootstrap_employment")))


def mapped_residual(left: DataFrame, right: DataFrame, mapping: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``residual`` (left over right, less one) of industries that the two sides code differently.

    ``mapping`` is a dimension (industry_type, industry_code, other_type, other_code); unmapped industries are left out.
    """
    placed = left.join(F.broadcast(mapping), ["industry_type", "industry_code"])
    other = right.select(*keys, F.col("industry_type").alias("other_type"), F.col("industry_code").alias("other_code"), F.col(value).alias("other"))
    return placed.join(other, [*keys, "other_type", "other_code"]).withColumn("residual", F.col(value) / F.nullif(F.col("other"), F.lit(0)) - 1)


def samples(violations: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, for a report; partitions keep no more than that before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return violations.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# Years whose levels no residual is judged by.
EXCLUDED_YEARS = (2020, 2021)


def best_available(df: DataFrame, keys: list[str]) -> DataFrame:
    """One print of each series and date: the most revised one, then the latest benchmark and vintage."""
    w = Window.partitionBy(*keys, "ref_date").orderBy(F.desc("revision"), F.desc("benchmark_revision"), F.desc("vintage_date"), F.desc("employment"))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def band_residuals(rebuilt: DataFrame, published: DataFrame, rules: DataFrame, *, frontier: Column, collapse: float = 0.15, excluded_years: tuple[int, ...] = EXCLUDED_YEARS) -> DataFrame:
    """Residuals (rebuilt over published, less one) of the series that ``rules`` names, and what becomes of each month.

    ``rules`` is a dimension (industry_type, industry_code, other_type, other_code,
    expected, band).  ``fate`` is ``excluded`` in excluded years, ``frontier`` from
    the date ``frontier`` on where the residual lies more than ``collapse`` below
    the expected one, ``collapsed`` where it does so before, and else ``clean``.
    """
    axes = ["geographic_type", "geographic_code", "ownership"]
    own, other = (best_available(headline(x, False), SERIES_ID) for x in (rebuilt, published))
    joined = mapped_residual(own, other.where(F.col("employment").isNotNull()), rules, [*axes, "ref_date"], "employment")
    low = F.col("residual") < F.col("expected") - collapse
    fate = F.when(F.year("ref_date").isin(*excluded_years), "excluded").when(low & (F.col("ref_date") >= frontier), "frontier").when(low, "collapsed").otherwise("clean")
    return joined.where("residual IS NOT NULL").withColumn("fate", fate)


def band_medians(residuals: DataFrame, *, positive: float = 0.01) -> DataFrame:
    """The verdict on each series: the exact median of its months that are neither excluded nor at the frontier, against its band.

    ``no_months`` where none is left, ``positive`` above ``positive``, ``outside``
    beyond the band around the expected residual, else ``ok``; with the numbers
    of months by fate.  Months that have collapsed count in the median.
    """
    kept = F.col("fate").isin("clean", "collapsed")
    count = lambda f: F.count(F.when(F.col("fate") == f, 1)).alias(f"n_{f}")
    out = residuals.groupBy("industry_type", "industry_code").agg(
        F.first("expected").alias("expected"), F.first("band").alias("band"), F.count(F.when(kept, 1)).alias("n"),
        *[count(f) for f in ("excluded", "frontier", "collapsed")], F.median(F.when(kept, F.col("residual"))).alias("median"),
    )
    verdict = (
        F.when(F.col("n") == 0, "no_months").when(F.col("median") > positive, "positive")
        .when(F.abs(F.col("median") - F.col("expected")) > F.col("band"), "outside").otherwise("ok")
    )
    return out.withColumn("verdict", verdict)


def band(medians: DataFrame) -> DataFrame:
    """The gate on those verdicts: excluded months are reported softly, everything else that is wrong is hard."""
    of = lambda v: F.coalesce(F.sum((F.col("verdict") == v).cast("long")), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    checks = {
        "nothing_shared": ("hard", (F.count("*") == 0).cast("long")),
        "months_excluded": ("soft", total("n_excluded")),
        "frontier_excluded": ("soft", total("n_frontier")),
        "no_months_left": ("hard", of("no_months")),
        "months_collapsed": ("hard", total("n_collapsed")),
        "median_positive": ("hard", of("positive")),
        "median_outside": ("hard", of("outside")),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), c.cast("long").alias("violations")) for n, (s, c) in checks.items()])
    return medians.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def additive_nesting(df: DataFrame, edges: DataFrame, tolerance: float) -> DataFrame:
    """Parents that are not the sum of their children, where all children are there, by ``parent``: a soft finding each.

    ``edges`` is a dimension (parent_type, parent_code, child_type, child_code).
    Of several benchmark prints of a cohort the latest counts, so that a parent
    is never held against children of another benchmark.  Every cell meets its
    edges where it lies; one shuffle brings parents and children together.
    """
    rows = headline(df, False)
    w = Window.partitionBy(*SERIES_ID, "ref_date", "revision", "benchmark_revision").orderBy(F.desc("vintage_date"), F.desc("employment"))
    latest = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    group = ["geographic_type", "geographic_code", "ownership", "ref_date", "revision", "benchmark_revision"]
    sizes = edges.groupBy("parent_type", "parent_code").agg(F.count("*").alias("n_children"))
    as_child = edges.selectExpr("child_type AS industry_type", "child_code AS industry_code", "parent_type", "parent_code", "1 AS child")
    as_parent = edges.selectExpr("parent_type AS industry_type", "parent_code AS industry_code", "parent_type", "parent_code", "0 AS child").distinct()
    placed = latest.join(F.broadcast(as_child.union(as_parent)), ["industry_type", "industry_code"])
    is_child = F.col("child") == 1
    summed = placed.groupBy(*group, "parent_type", "parent_code").agg(
        F.max(F.when(~is_child, F.col("employment"))).alias("level"), F.sum(F.when(is_child, F.col("employment"))).alias("children"),
        F.count_distinct(F.when(is_child, F.struct("industry_type", "industry_code"))).alias("n_children"),
    )
    whole = summed.join(F.broadcast(sizes), ["parent_type", "parent_code", "n_children"], "left_semi")
    return whole.where(F.abs(F.col("level") - F.col("children")) > tolerance).select(*group, "parent_type", "parent_code", "level", "children")

"""First prints, competitors, error measures, regressions and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import month

#: Days after a first print within which its partner month's print must have come out.
RELEASE_WINDOW_DAYS = 15


def _finite(value: str | Column) -> Column:
    """Whether a number is there, and neither NaN nor infinite."""
    c = F.col(value) if isinstance(value, str) else value
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def first_print_changes(store: DataFrame, by: list[str]) -> DataFrame:
    """Change and growth of each month as first published: its first print less the prior month's level of that release.

    Of several first prints the latest counts.  The partner is the prior month's second print, else its latest
    print, published at most ``RELEASE_WINDOW_DAYS`` after the first print; months without one keep their row,
    with nulls.  Rows without a positive level do not count.
    """
    rows = store.where("employment > 0").withColumn("month", month(F.col("ref_date")))
    first = (
        rows.where("revision = 0 AND benchmark_revision = 0")
        .groupBy(*by, "month")
        .agg(F.max_by("employment", F.struct("vintage_date", "employment")).alias("level"), F.max("vintage_date").alias("vintage_date"))
        .withColumn("prior", F.add_months("month", -1))
    )
    prior = rows.select(*by, F.col("month").alias("prior"), F.col("employment").alias("p"), F.col("vintage_date").alias("pv"), "revision", "benchmark_revision")
    known = F.col("pv") <= F.date_add("vintage_date", RELEASE_WINDOW_DAYS)
    second = known & (F.col("revision") == 1) & (F.col("benchmark_revision") == 0)
    found = first.join(prior, [*by, "prior"], "left").groupBy(*by, "month", "vintage_date", "level").agg(
        F.min_by(F.when(second, F.col("p")), F.when(second, F.struct("pv", "p"))).alias("primary"),
        F.max_by(F.when(known, F.col("p")), F.when(known, F.struct("benchmark_revision", "revision", "pv", "p"))).alias("fallback"),
    )
    partner = F.coalesce("primary", "fallback")
    return found.select(*by, "month", "vintage_date", (F.col("level") - partner).alias("change"), (F.ln("level") - F.ln(partner)).alias("growth"))


def settled_changes(store: DataFrame, by: list[str]) -> DataFrame:
    """Change of each month between its newest prints on the first benchmark (the third, once it is out): ``month, change``.

    Of the prints of a month the most revised counts, of several of those the
    latest; rows without a positive level do not.  A month whose calendar month
    before has no level gives no row, so a gap never passes for a month.
    """
    rows = store.where("benchmark_revision = 0 AND employment > 0").withColumn("month", month(F.col("ref_date")))
    level = rows.groupBy(*by, "month").agg(F.max_by("employment", F.struct("revision", "vintage_date", "employment")).alias("level"))
    w = Window.partitionBy(*by).orderBy("month")
    beside = F.add_months("month", -1) == F.lag("month").over(w)
    return level.withColumn("change", F.when(beside, F.col("level") - F.lag("level").over(w))).where("change IS NOT NULL").select(*by, "month", "change")


def change_revisions(store: DataFrame, by: list[str]) -> DataFrame:
    """First and settled change of each month that has both, and the ``revision`` between them; ``lagged`` is that of the row before."""
    first = first_print_changes(store, by).where("change IS NOT NULL").select(*by, "month", "vintage_date", F.col("change").alias("first"))
    both = first.join(settled_changes(store, by).withColumnRenamed("change", "settled"), [*by, "month"]).withColumn("revision", F.col("settled") - F.col("first"))
    return both.withColumn("lagged", F.lag("revision").over(Window.partitionBy(*by).orderBy("month")))


def error_metrics(df: DataFrame, by: list[str], error: str) -> DataFrame:
    """Count, mean, mean absolute and root mean square error of the errors that are there."""
    e = F.when(~F.isnan(error), F.col(error))
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(e).alias("me"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def interval_coverage(draws: DataFrame, by: list[str], value: str, actual: str, level: float) -> DataFrame:
    """Whether the actual value lies in the central interval of the draws (exact percentiles, linear in between).

    Draws that are not finite do not count; groups without any other are left out.
    """
    draws = draws.where(_finite(value))
    ends = f"percentile({value}, array({(1 - level) / 2!r}D, {(1 + level) / 2!r}D), _c)"
    counts = draws.groupBy(*by, value).agg(F.count("*").alias("_c"), F.first(actual).alias("_actual"))
    out = counts.groupBy(*by).agg(F.expr(ends).alias("q"), F.first("_actual").alias("actual"))
    return out.select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.col("actual").between(F.col("q")[0], F.col("q")[1]).alias("covered"))


def crps(draws: DataFrame, by: list[str], value: str, actual: str) -> DataFrame:
    """Continuous ranked probability score of the draws, from sorted ranks.

    Equal draws are counted first; values are ranked within buckets about 2 % wide, moved up by the
    counts of the buckets below, so that no task sorts all draws of a group.  Draws that are not
    finite do not count; groups without any other are left out.
    """
    counts = draws.where(_finite(value)).groupBy(*by, F.col(value).alias("_v"), F.col(actual).alias("_a")).agg(F.count("*").alias("_c"))
    cut = _below(counts.withColumn("_bucket", F.floor(F.signum("_v") * F.log1p(F.abs("_v") * 1e6) * 50)), by, F.col("_c"))
    w = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
    c, n, off = F.col("_c"), F.sum("_c"), F.abs(F.col("_v") - F.col("_a"))
    twice_ranks = (2 * F.col("_before") + c + 1) * c  # of the places before + 1 to before + c
    spread = F.sum(twice_ranks * F.col("_v")) - (n + 1) * F.sum(c * F.col("_v"))
    mean_off = F.sum(c * off) / F.sum(F.when(off.isNotNull(), c))
    return ranked.groupBy(*by).agg((mean_off - spread / (n * n)).alias("crps"))


def mincer_zarnowitz(df: DataFrame, by: list[str], actual: str, forecast: str) -> DataFrame:
    """Regression of actual on forecast: intercept, slope, R2, and the joint test of (0, 1) with its exact tail."""
    m = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(forecast).alias("mx"), F.avg(actual).alias("my"),
        F.covar_pop(actual, forecast).alias("cxy"), F.var_pop(forecast).alias("vx"), F.var_pop(actual).alias("vy"),
    ).where("n > 2 AND vx > 0 AND vy > 0")
    m = m.withColumn("slope", F.col("cxy") / F.col("vx")).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    m = m.withColumn("r2", F.col("slope") * F.col("cxy") / F.col("vy"))
    s2 = F.col("vy") * (1 - F.col("r2")) * F.col("n") / (F.col("n") - 2)
    d0, d1 = F.col("intercept"), F.col("slope") - 1
    wald = F.col("n") * (d0 * d0 + 2 * d0 * d1 * F.col("mx") + d1 * d1 * (F.col("vx") + F.col("mx") * F.col("mx"))) / s2
    return m.withColumn("wald", wald).select(*by, "n", "intercept", "slope", "r2", "wald", F.exp(-F.col("wald") / 2).alias("p_value"))


#: Fixed values of the rational approximation to the complementary error function (Abramowitz and Stegun, 7.1.26), good to 1.5e-7.
ERFC_P, ERFC_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def chi_square_tail(value: Column) -> Column:
    """Probability that a chi-square variable with one degree of freedom exceeds ``value``."""
    x = F.sqrt(value / 2)
    t = 1 / (1 + ERFC_P * x)
    series = F.lit(0.0)
    for a in reversed(ERFC_A):
        series = (series + a) * t
    return series * F.exp(-value / 2)


def encompassing(df: DataFrame, by: list[str], actual: str, model: str, rival: str) -> DataFrame:
    """Whether a model adds to a rival, and how the two are best combined, for groups of at least five complete rows.

    ``b, c``: coefficients of model and rival in a regression of the actual value with an intercept; ``p_value``: of
    b = 0, by its classical variance and chi-square.  ``weight``: of the model in the convex combination of least
    error variance (one half where the errors do not differ).  Mean absolute errors of model, rival and combination.
    """
    rows = df.where(_finite(actual) & _finite(model) & _finite(rival))
    em, er = F.col(actual) - F.col(model), F.col(actual) - F.col(rival)
    m = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.var_samp(em).alias("vm"), F.var_samp(er).alias("vr"), F.covar_samp(em, er).alias("cov"),
        F.var_pop(model).alias("s11"), F.var_pop(rival).alias("s22"), F.var_pop(actual).alias("syy"),
        F.covar_pop(model, rival).alias("s12"), F.covar_pop(model, actual).alias("s1y"), F.covar_pop(rival, actual).alias("s2y"),
    ).where("n >= 5")
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    det = F.when(det > 0, det)  # null where the two forecasts are one
    m = m.withColumns({"b": (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det, "c": (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det})
    left = F.greatest(F.col("syy") - F.col("b") * F.col("s1y") - F.col("c") * F.col("s2y"), F.lit(0.0))
    variance = left / F.greatest(F.col("n") - 3, F.lit(1)) * F.col("s22") / det
    wald = F.coalesce(F.col("b") * F.col("b") / F.when(variance > 0, variance), F.lit(0.0))
    apart = F.col("vm") + F.col("vr") - 2 * F.col("cov")
    share = (F.col("vr") - F.col("cov")) / F.when(apart > 0, apart)
    weight = F.when(share.isNull(), 0.5).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    found = m.select(*by, "n", "b", "c", chi_square_tail(wald).alias("p_value"), weight.alias("weight"))
    both = F.col("weight") * F.col(model) + (1 - F.col("weight")) * F.col(rival)
    return rows.join(found, by).groupBy(*by, "n", "b", "c", "p_value", "weight").agg(
        F.avg(F.abs(em)).alias("mae_model"), F.avg(F.abs(er)).alias("mae_rival"), F.avg(F.abs(F.col(actual) - both)).alias("mae_combined")
    )


def combination_gate(df: DataFrame, by: list[str], actual: str, model: str, rival: str, *, alpha: float = 0.1) -> DataFrame:
    """For each cell whether a blend of model and rival earns its keep: ``n, p_value, weight, fires, reason``.

    It does where the model adds information (``p_value`` below ``alpha``) and the blend errs less than either;
    cells of fewer than five complete rows never do.
    """
    cells = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    names = {k: f"_g{i}" for i, k in enumerate(by)}
    found = encompassing(df, by, actual, model, rival)
    found = found.select(*[F.col(k).alias(v) for k, v in names.items()], *[c for c in found.columns if c not in by])
    same = F.lit(True)
    for k, v in names.items():
        same &= F.col(k).eqNullSafe(F.col(v))
    fires = (F.col("p_value") < alpha) & (F.col("mae_combined") < F.least("mae_model", "mae_rival"))
    return cells.join(found, same, "left").select(
        *by, F.coalesce("n", "_rows").alias("n"), "p_value", "weight", F.coalesce(fires, F.lit(False)).alias("fires"),
        F.when(F.col("n").isNull(), "insufficient_paired_obs").alias("reason"),
    )


def funding_gate(r2: DataFrame, by: list[str], *, floor: float = 0.1, excess: float = 0.15) -> DataFrame:
    """What R2 by ``month_type`` speaks for: a rebuild where normal months reach ``floor``, more where turning points exceed them by ``excess``.

    A type without a row counts as 0.
    """
    one = lambda kind: F.coalesce(F.max(F.when(F.col("month_type") == kind, F.col("r2"))), F.lit(0.0))
    m = r2.groupBy(*by).agg(one("normal").alias("normal"), one("turning_point").alias("turning_point"))
    return m.withColumns({"fund_rebuild": F.col("normal") >= floor, "fund_turning": F.col("turning_point") - F.col("normal") >= excess})


def decomposition_residual(df: DataFrame, by: list[str], wedge: str, published: str) -> DataFrame:
    """Mean and deviation of what a wedge has beyond its published counterpart, and that deviation's share of the wedge's."""
    r = F.col(wedge) - F.col(published)
    m = df.groupBy(*by).agg(F.avg(r).alias("r_mean"), F.stddev_samp(r).alias("r_std"), F.stddev_samp(wedge).alias("wedge_std"))
    return m.withColumn("r_share", F.col("r_std") / F.when(F.col("wedge_std") > 0, F.col("wedge_std")).otherwise(1.0))


def intervention_sd(df: DataFrame, by: list[str], change: str, baseline: float) -> DataFrame:
    """Prior deviation of a shock: what was observed, and ``baseline`` at least."""
    return df.groupBy(*by).agg(F.greatest(F.coalesce(F.stddev_samp(change), F.lit(0.0)), F.lit(baseline)).alias("sd"))


def implied_part(table: DataFrame, series: str, whole: str, part: str, on: list[str], value: str) -> DataFrame:
    """The rest that two published series imply: the whole less the part, where both are there."""
    rest = table.where(F.col(series) == part).select(*on, F.col(value).alias("_part"))
    return table.where(F.col(series) == whole).join(rest, on).withColumn("implied", F.col(value) - F.col("_part")).drop("_part")


def known_history(targets: DataFrame, history: DataFrame, by: list[str]) -> DataFrame:
    """Every target (``as_of``) with the history published by then; within ``by`` an equi-join with a bound on dates."""
    return targets.join(history, by).where(F.col("vintage_date") <= F.col("as_of"))


def month_types(
    df: DataFrame, by: list[str], revision: str, momentum: str, *, share: float = 0.9, turn_at: float = 40.0, benchmark_months: tuple[int, ...] = (2,)
) -> DataFrame:
    """large_revision, turning_point, benchmark_window or normal, in this order of precedence.

    A revision is large from the percentile ``share`` of all finite revisions of the series on; a month is a turning
    point where momentum is ``turn_at`` or more either way; numbers that are not finite decide nothing.
    """
    size, move = F.when(_finite(revision), F.abs(revision)), F.when(_finite(momentum), F.abs(momentum))
    bound = df.groupBy(*by).agg(F.percentile(size, share).alias("_bound"))
    kind = (
        F.when(size >= F.col("_bound"), "large_revision")
        .when(move >= turn_at, "turning_point")
        .when(F.month("month").isin(*benchmark_months), "benchmark_window")
        .otherwise("normal")
    )
    return df.join(bound, by).withColumn("month_type", kind).drop("_bound")


def standardise(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``z``: centred and divided by the population deviation (only centred where that is 0); missing values are 0."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    centred = F.col(value) - F.avg(value).over(w)
    return df.withColumn("z", F.coalesce(F.when(sd > 0, centred / sd).otherwise(centred), F.lit(0.0)))


def momentum(df: DataFrame, by: list[str], value: str, lag: int, order: str = "month") -> DataFrame:
    """Adds ``momentum``: the value less that of ``lag`` rows before."""
    return df.withColumn("momentum", F.col(value) - F.lag(value, lag).over(Window.partitionBy(*by).orderBy(order)))


def compare_draws(a: DataFrame, b: DataFrame, site: str, value: str) -> DataFrame:
    """Site by site: shift of the mean in pooled deviations, and the ratio of deviations."""
    one = lambda df, x: df.groupBy(site).agg(F.avg(value).alias(f"m{x}"), F.stddev_samp(value).alias(f"s{x}"))
    pooled = F.sqrt((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / 2)
    return one(a, "a").join(one(b, "b"), site).select(site, ((F.col("mb") - F.col("ma")) / pooled).alias("shift"), (F.col("sb") / F.col("sa")).alias("ratio"))


def intervention(j: Column, kind: Column, k: Column, rho: Column) -> Column:
    """Basis value ``j`` months after a start: pulse, box over k months, or a temporary change that is paid back."""
    return (
        F.when(j < 0, 0.0)
        .when(kind == "pulse", F.when(j == 0, 1.0).otherwise(0.0))
        .when(kind == "box", F.when(j < k, 1.0 / k).otherwise(0.0))
        .when(kind == "tc", F.when(j == 0, 1.0).otherwise(-(1 - rho) * F.pow(rho, j - 1)))
    )


def ols2(df: DataFrame, by: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Regression on two regressors and an intercept over complete rows: coefficients and R2, from moments in one pass."""
    rows = df.where(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    m = rows.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{k}") for k, c in (("y", y), ("1", x1), ("2", x2))], F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.var_pop(y).alias("syy"),
        F.covar_pop(x1, x2).alias("s12"), F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    m = m.where((F.col("n") > 3) & (det > 0)).withColumns(
        {"b1": (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det, "b2": (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det}
    )
    fit = (F.col("b1") * F.col("s1y") + F.col("b2") * F.col("s2y")) / F.col("syy")
    return m.select(*by, "n", (F.col("m_y") - F.col("b1") * F.col("m_1") - F.col("b2") * F.col("m_2")).alias("b0"), "b1", "b2", fit.alias("r2"))


def revision_table(panel: DataFrame, by: list[str], first: int, later: int, value: str) -> DataFrame:
    """First and later print of each month, the revision, and the revision of the month before."""
    one = lambda r: F.max(F.when(F.col("revision_number") == r, F.col(value)))
    both = panel.groupBy(*by, "period").agg(one(first).alias("first"), one(later).alias("later")).where("first IS NOT NULL AND later IS NOT NULL")
    w = Window.partitionBy(*by).orderBy("period")
    return both.withColumn("revision", F.col("later") - F.col("first")).withColumn("lagged", F.lag("revision").over(w))


def decompose(df: DataFrame, by: list[str], parts: list[str]) -> DataFrame:
    """Mean and mean absolute error of each part of an error, and of their sum."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    long = df.withColumn("total", total).unpivot(by, [*parts, "total"], "component", "error")
    return long.groupBy(*by, "component").agg(F.count("error").alias("n"), F.avg("error").alias("me"), F.avg(F.abs("error")).alias("mae"))


def change_draws(growth: Column, prev_index: float, idx_to_level: float) -> Column:
    """The change in level that a draw of growth stands for, from the index before it."""
    return prev_index * (F.exp(growth) - 1) * idx_to_level


def assemble_total(parts: DataFrame, wedges: DataFrame, by: list[str], *, prev_index: float, idx_to_level: float, eta: float = 0.0) -> DataFrame:
    """Draws of a total change: growth draws of a part, turned into changes, each with a wedge draw; as many as there are wedge draws.

    Both have ``draw, value``, with draws from 0 without gaps; see :func:`resample_total` for unequal counts.
    ``eta`` times the standardised change of the part is added: the mean stays, intervals widen.
    """
    changes = parts.withColumn("value", change_draws(F.col("value"), prev_index, idx_to_level))
    if not eta:
        return resample_total(changes, wedges, by)
    taken = resample_total(changes, wedges.withColumn("value", F.lit(0.0)), by).withColumnRenamed("value", "_part")
    moments = taken.groupBy(*by).agg(F.avg("_part").alias("_mean"), F.stddev_pop("_part").alias("_sd"))
    coupled = eta * (F.col("_part") - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    both = taken.join(moments, by).join(wedges.select(*by, "draw", F.col("value").alias("_wedge")), [*by, "draw"])
    return both.select(*by, "draw", (F.col("_part") + F.col("_wedge") + coupled).alias("value"))


def _below(df: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """``df`` with ``_below``: the weight of all smaller ``_bucket``s of the same keys (nulls are smallest)."""
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_k{i}" for i, k in enumerate([*keys, "_bucket"])}
    offsets = sums.select(*[F.col(k).alias(n) for k, n in names.items()], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_below"))
    same = F.lit(True)
    for k, n in names.items():
        same &= F.col(k).eqNullSafe(F.col(n))
    return df.join(offsets, same).drop(*names.values())


def number_draws(df: DataFrame, by: list[str], order: str, width: int = 10_000) -> DataFrame:
    """Adds ``draw``, the place of a row in its series from 0, by a whole-numbered ``order``.

    Rows are numbered within ranges of ``width`` values and moved up by the counts of the ranges
    below, so that no task sorts a whole series.
    """
    cut = _below(df.withColumn("_bucket", F.floor(F.col(order) / width)), by, F.lit(1))
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(order)) - 1
    return cut.withColumn("draw", place + F.col("_below")).drop("_bucket", "_below")


def resample_total(parts: DataFrame, wedges: DataFrame, by: list[str]) -> DataFrame:
    """One draw of a sum for each wedge draw of a series; both have ``draw, value``, with draws from 0 without gaps.

    Of p part draws and n wedge draws, wedge draw j takes part draw j p / n, rounded down: the same draw
    where there are as many, else all part draws about equally often or evenly spaced ones.
    (A multiple of j modulo the count would leave out most draws where the two have a common factor.)
    """
    sizes = parts.groupBy(*by).agg(F.count("*").alias("_p")).join(wedges.groupBy(*by).agg(F.count("*").alias("_n")), by)
    other = parts.select(*by, F.col("draw").cast("long").alias("_i"), F.col("value").alias("_v"))
    taken = wedges.join(sizes, by).withColumn("_i", F.expr("CAST(draw AS BIGINT) * _p DIV _n"))
    return taken.join(other, [*by, "_i"]).select(*by, "draw", (F.col("value") + F.col("_v")).alias("value"))


def score_total(draws: DataFrame, by: list[str], value: str, actual: str, level: float = 0.8) -> DataFrame:
    """Absolute error of the mean draw, whether the central interval covers the actual value, and the probability score."""
    point = draws.groupBy(*by).agg(F.abs(F.avg(value) - F.first(actual)).alias("point_err"))
    covered = interval_coverage(draws, by, value, actual, level).select(*by, "covered")
    return point.join(covered, by).join(crps(draws, by, value, actual), by)


def indicator(df: DataFrame, months: DataFrame, by: list[str], value: str) -> DataFrame:
    """Monthly means of a finer series on a grid of months, standardised over the series; ``degenerate`` where nothing varies."""
    monthly = df.groupBy(*by, "month").agg(F.avg(value).alias(value))
    aligned = months.join(monthly, [*by, "month"], "left")
    return standardise(aligned, by, value).withColumn("degenerate", F.max(F.abs("z")).over(Window.partitionBy(*by)) == 0)

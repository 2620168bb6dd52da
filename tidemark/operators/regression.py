"""Least squares of any number of regressors by group, from moments of one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import finite
from tidemark.operators.evaluate import funding_gate, month_types

#: A pivot this small beside its variance means that a regressor is a combination of others.
_SINGULAR = 1e-12


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def least_squares(df: DataFrame, by: list[str], y: str, regressors: list[str]) -> DataFrame:
    """Ordinary least squares with an intercept and the classical covariance, for each group.

    A regressor without a finite value in a group is left out of that group's
    fit; rows that then lack a value are dropped, and so are rows without ``y``.
    The rows of each pattern of values that are there are aggregated apart, which
    is one shuffle of at most 2^k sums a group and task; the complete pattern is
    kept, and its centred moments are inverted in one array expression.

    Returns ``by``, ``n``, ``r2`` (0 where ``y`` does not vary), ``sigma2``,
    ``singular``, ``coefficients`` (name, estimate, se; the intercept is
    ``const``) and ``covariance`` in their order.  Groups without a complete row
    give none; where regressors depend on each other, ``singular`` is true and
    the numbers are null.
    """
    k = len(regressors)
    if not 1 <= k <= 12:
        raise ValueError("1 to 12 regressors")
    there = [finite(F.col(x).cast("double")) for x in regressors]
    z = [F.when(t, F.col(x).cast("double")).otherwise(0.0) for t, x in zip(there, regressors)]
    bits = _sum([F.when(t, 1 << j).otherwise(0) for j, t in enumerate(there)])
    rows = df.where(finite(F.col(y).cast("double"))).select(*by, bits.alias("_bits"), F.col(y).cast("double").alias("_y"), *[c.alias(f"_z{j}") for j, c in enumerate(z)])
    moments = [F.count("*").alias("n"), F.avg("_y").alias("_my"), F.var_pop("_y").alias("_syy")]
    for j in range(k):
        moments += [F.avg(f"_z{j}").alias(f"_m{j}"), F.covar_pop(f"_z{j}", "_y").alias(f"_c{j}")]
        moments += [F.covar_pop(f"_z{j}", f"_z{i}").alias(f"_s{j}_{i}") for i in range(j + 1)]
    patterns = rows.groupBy(*by, "_bits").agg(*moments)
    fit = patterns.withColumn("_all", F.bit_or("_bits").over(Window.partitionBy(*by))).where("_bits = _all")
    shown = [F.lit(True), *[F.col("_bits").bitwiseAND(1 << j) > 0 for j in range(k)]]
    # the moments beside a unit matrix; a regressor that is left out has a pivot of 1 and no part in anything
    pivot = lambda j: F.when(shown[j + 1], F.col(f"_s{j}_{j}")).otherwise(1.0)
    entry = lambda j, i: pivot(j) if i == j else F.col(f"_s{max(i, j)}_{min(i, j)}")
    table = F.array(*[F.array(*[entry(j, i) for i in range(k)], *[F.lit(float(i == j)) for i in range(k)]) for j in range(k)])
    listed = fit.select(
        *by, "n", "_my", "_syy", F.array(*shown).alias("_on"), table.alias("_table"), F.array(*[pivot(j) for j in range(k)]).alias("_scale"),
        F.array(*[F.col(f"_c{j}") for j in range(k)]).alias("_c"), F.array(*[F.col(f"_m{j}") for j in range(k)]).alias("_m"),
    )
    # elimination step by step: the unit matrix becomes the inverse, or null where a pivot is nothing beside its variance
    pivoted = f"if(t[j][j] > {_SINGULAR!r}D * _scale[j], t[j][j], NULL)"
    step = f"transform(t, (r, i) -> transform(r, (x, c) -> if(i = j, x / {pivoted}, x - r[j] * t[j][c] / {pivoted})))"
    solved = listed.withColumn("_inverse", F.expr(f"transform(aggregate(sequence(0, {k - 1}), _table, (t, j) -> {step}), r -> slice(r, {k + 1}, {k}))"))
    dot = "aggregate(zip_with({0}, {1}, (a, b) -> a * b), 0D, (a, x) -> a + x)"
    fitted = solved.select("*", *[F.expr(f"transform(_inverse, r -> {dot.format('r', v)})").alias(n) for n, v in (("_b", "_c"), ("_w", "_m"))])
    rss = F.expr(f"if(_b[0] IS NULL, NULL, greatest(n * (_syy - {dot.format('_b', '_c')}), 0D))")
    measured = fitted.withColumn("_rss", rss).select(
        "*", F.col("_rss").isNull().alias("singular"), F.when((F.col("_syy") == 0) & F.col("_rss").isNotNull(), 0.0).otherwise(1 - F.col("_rss") / (F.col("n") * F.col("_syy"))).alias("r2"),
        (F.col("_rss") / F.expr("greatest(n - size(filter(_on, x -> x)), 1)")).alias("sigma2"),
    )
    first = f"concat(array(sigma2 / n * (1 + {dot.format('_m', '_w')})), transform(_w, x -> -sigma2 / n * x))"
    others = "transform(_inverse, (r, j) -> concat(array(-sigma2 / n * _w[j]), transform(r, x -> sigma2 / n * x)))"
    whole = measured.withColumn("_v", F.expr(f"concat(array({first}), {others})")).withColumn("_e", F.expr(f"concat(array(_my - {dot.format('_b', '_m')}), _b)"))
    names = F.array(*[F.lit(x) for x in ("const", *regressors)])
    each = whole.withColumn("_names", names).select(
        *by, "n", "r2", "sigma2", "singular",
        F.expr("filter(transform(_names, (name, i) -> if(_on[i], named_struct('name', name, 'estimate', _e[i], 'se', sqrt(_v[i][i])), NULL)), x -> x IS NOT NULL)").alias("coefficients"),
        F.expr("transform(filter(_v, (r, i) -> _on[i]), r -> filter(r, (x, i) -> _on[i]))").alias("covariance"),
    )
    return each


def revision_regression(df: DataFrame, by: list[str], revision: str, regressors: list[str]) -> DataFrame:
    """What of a revision could be foreseen: the fit, with its intercept (the bias of first prints) as a column."""
    return least_squares(df, by, revision, regressors).withColumn("bias", F.col("coefficients")[0]["estimate"])


def revision_diagnostics(df: DataFrame, by: list[str], revision: str, regressors: list[str], momentum: str, **kinds) -> DataFrame:
    """The revision regression over all months (``month_type`` pooled) and over those of each type, from one aggregation.

    Types are those of ``month_types`` with ``kinds``.  A type counts where it has
    over two rows more than the pooled fit has coefficients, rows that lack a value
    included.  A regressor that has no value in a type is left out of its fit.
    ``missing`` lists regressors without any value in the pooled months.
    """
    typed = month_types(df, by, revision, momentum, **kinds)
    each = typed.withColumn("month_type", F.explode(F.array(F.lit("pooled"), F.col("month_type"))))
    fit = revision_regression(each, [*by, "month_type"], revision, regressors)
    sizes = each.groupBy(*by, "month_type").agg(F.count("*").alias("n_months"))
    pooled = F.when(F.col("month_type") == "pooled", F.col("coefficients"))
    used = F.max(F.transform(pooled, lambda c: c["name"])).over(Window.partitionBy(*by))
    rows = fit.join(sizes, [*by, "month_type"]).withColumn("_used", used)
    kept = rows.where((F.col("month_type") == "pooled") | (F.col("n_months") > F.size("_used") + 2))
    return kept.withColumn("missing", F.array_except(F.array(*map(F.lit, regressors)), "_used")).drop("_used")


def diagnostics_gate(diagnostics: DataFrame, by: list[str], **bounds) -> DataFrame:
    """What the fits by month type speak for (see ``funding_gate``), beside the ``pooled`` share that could be foreseen and the ``bias``."""
    pooled = F.when(F.col("month_type") == "pooled", F.struct("n", F.col("r2").alias("pooled"), "bias", "missing"))
    beside = diagnostics.withColumn("_pooled", F.max(pooled).over(Window.partitionBy(*by)))
    out = funding_gate(beside, [*by, "_pooled"], **bounds)
    return out.select(*by, "_pooled.*", *[c for c in out.columns if c not in (*by, "_pooled")])

"""Queries of whole jobs: as-of grids, backtests, capture, snapshots, merges."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import rebuild_queries
from tidemark.operators import backtest, composite, evaluate, gates, intervals, jobs, regression, store
from tidemark.plans.demo import order_months, vintage_obs
from tidemark.registry import query
from tidemark.schemas import VINTAGE, conform
from tidemark.sources import survey
from tidemark.storage import new_folder, stored
from tidemark.streaming import capture

# ------------------------------------------------------------------ as-of grids

#: A stated grid: the 12th of each month of two years.
_GRID = [datetime.date(1997 + (m + 2) // 12, (m + 2) % 12 + 1, 12) for m in range(24)]
_GRID_SQL = ", grid AS (SELECT CAST(d AS DATE) AS as_of FROM range(DATE '1997-03-12', DATE '1999-03-12', INTERVAL 1 MONTH) t(d))"


def _interval_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all prints, which arrive in three lots: the last holds prints that are older than stored ones."""
    obs = stored(vintage_obs(spark, sf_dir), "prints")
    path = new_folder(spark, "index")
    late = F.month("ref_date") == 3
    early = F.col("vintage_date") < F.lit("1998-01-01").cast("date")
    intervals.build(obs.where(early & ~late), path)
    for lot in (obs.where(~early & ~late), obs.where(late)):
        intervals.append(lot, path)
    return intervals.read(spark, path, obs.schema)


@query(_GRID_SQL + """, v AS (SELECT *, row_number() OVER (PARTITION BY as_of, source, seasonally_adjusted, industry_code, ref_date ORDER BY vintage_date DESC, benchmark_revision DESC, revision DESC) AS rn
  FROM obs JOIN grid ON vintage_date <= as_of AND ref_date < as_of)
SELECT as_of, source, industry_code, count(*) AS n, sum(employment) AS total, max(ref_date) AS last_ref, count(*) FILTER (benchmark_revision = 1) AS n_benchmark FROM v WHERE rn = 1 GROUP BY ALL""")
def jon26_interval_view(spark, sf_dir):
    """The latest print of each key at 24 dates, from an interval index that was kept over three appends."""
    out = intervals.view(_interval_index(spark, sf_dir), _GRID)
    return out.groupBy("as_of", "source", "industry_code").agg(
        F.count("*").alias("n"), F.sum("employment").alias("total"), F.max("ref_date").alias("last_ref"), F.count(F.when(F.col("benchmark_revision") == 1, 1)).alias("n_benchmark")
    )


def _panel_sql(rows: str, settled: int = 41) -> str:
    """The growth panel at each ``as_of`` of the rows ``rows``, as ``pg``."""
    return f""", pk AS (SELECT * FROM {rows} WHERE employment > 0),
pgr AS (SELECT *, ln(employment) - lag(ln(employment)) OVER (PARTITION BY as_of, source, seasonally_adjusted, industry_code, revision, benchmark_revision ORDER BY ref_date) AS growth,
  source = 'ces' OR ref_date >= CAST(as_of - INTERVAL {settled} MONTH AS DATE) AS recent, CAST(quarter(ref_date) AS INT) AS qq FROM pk),
prk AS (SELECT *, dense_rank() OVER (PARTITION BY as_of, source, seasonally_adjusted, industry_code, recent ORDER BY ref_date DESC) AS rk FROM pgr WHERE growth IS NOT NULL),
pfit AS (SELECT *, CASE WHEN source = 'ces' THEN (CASE WHEN benchmark_revision = 0 AND revision = least(rk - 1, 2) THEN 1 ELSE 0 END)
  WHEN recent AND revision = (CASE WHEN rk = 1 THEN 0 WHEN rk = 2 THEN 1 WHEN rk = 3 THEN (CASE WHEN qq = 4 THEN 1 ELSE 2 END)
    WHEN rk = 4 THEN (CASE WHEN qq = 4 THEN 1 WHEN qq = 3 THEN 2 ELSE 3 END) END) THEN 1 ELSE 0 END AS fits FROM prk),
ppick AS (SELECT * FROM pfit QUALIFY row_number() OVER (PARTITION BY as_of, source, seasonally_adjusted, industry_code, ref_date ORDER BY fits DESC, revision DESC, benchmark_revision DESC, vintage_date DESC, employment) = 1),
pg AS (SELECT as_of, ref_date AS period, industry_code, CASE WHEN source = 'ces' THEN (CASE WHEN seasonally_adjusted THEN 'ces_sa' ELSE 'ces_nsa' END) ELSE source END AS source, growth, employment AS employment_level,
  vintage_date, CAST(CASE WHEN source = 'ces' AND benchmark_revision > 0 THEN -1 ELSE revision END AS INT) AS revision_number,
  CASE WHEN source = 'ces' THEN benchmark_revision > 0 ELSE NOT recent OR revision = 5 - qq END AS is_final FROM ppick)"""


@query(_GRID_SQL + ", gobs AS (SELECT * FROM obs JOIN grid ON vintage_date <= as_of AND ref_date < as_of)" + _panel_sql("gobs") + """
SELECT as_of, source, industry_code, period, revision_number, is_final, employment_level, round(growth, 6) AS growth FROM pg""")
def jon26_panel_grid(spark, sf_dir):
    """The growth panels of 24 dates, whole, from one shuffle of the store."""
    out = intervals.panel_grid(vintage_obs(spark, sf_dir), _GRID)
    return out.select("as_of", "source", "industry_code", "period", "revision_number", "is_final", "employment_level", F.round("growth", 6).alias("growth"))


# ------------------------------------------------------------------ backtest

_BY = ["industry_code"]
_FP = """, sa AS (SELECT industry_code, CAST(date_trunc('month', ref_date) AS DATE) AS month, employment AS level, vintage_date, revision, benchmark_revision, seasonally_adjusted FROM obs WHERE source = 'ces' AND employment > 0),
f1 AS (SELECT * FROM sa WHERE revision = 0 AND benchmark_revision = 0 QUALIFY row_number() OVER (PARTITION BY seasonally_adjusted, industry_code, month ORDER BY vintage_date DESC, level DESC) = 1),
f2 AS (SELECT f.seasonally_adjusted, f.industry_code, f.month, f.vintage_date, f.level, arg_min(p.level, p.vintage_date) FILTER (p.revision = 1 AND p.benchmark_revision = 0) AS q1, arg_max(p.level, p.benchmark_revision * 1000 + p.revision) AS q2
  FROM f1 f LEFT JOIN sa p ON p.seasonally_adjusted = f.seasonally_adjusted AND p.industry_code = f.industry_code AND p.month = CAST(f.month - INTERVAL 1 MONTH AS DATE) AND p.vintage_date <= f.vintage_date + 15 GROUP BY ALL),
fall AS (SELECT seasonally_adjusted, industry_code, month, vintage_date, level - coalesce(q1, q2) AS change FROM f2), fpx AS (SELECT * FROM fall WHERE seasonally_adjusted)"""

_BACKTEST = _FP + """, months AS (SELECT industry_code, month, change AS actual, vintage_date AS released FROM fpx WHERE month > (SELECT CAST(max(month) - INTERVAL 24 MONTH AS DATE) FROM fpx)),
tg AS (SELECT industry_code, regime, month AS target, actual, CAST(released - days AS DATE) AS as_of FROM months, (VALUES ('t7', 7), ('t1', 1)) r(regime, days)),
hist AS (SELECT industry_code, month, change, vintage_date FROM fpx WHERE change IS NOT NULL),
kn AS (SELECT t.industry_code, t.regime, t.target, h.change, row_number() OVER (PARTITION BY t.industry_code, t.regime, t.target ORDER BY h.month DESC) AS rn FROM tg t JOIN hist h ON h.industry_code = t.industry_code AND h.vintage_date <= t.as_of),
nv AS (SELECT industry_code, regime, target, max(CASE WHEN rn = 1 THEN change END) AS rw, avg(change) FILTER (rn <= 12) AS tm FROM kn GROUP BY ALL),
adates AS (SELECT DISTINCT as_of FROM tg), gobs AS (SELECT * FROM obs JOIN adates ON vintage_date <= as_of AND ref_date < as_of WHERE source = 'ces' AND seasonally_adjusted)""" + _panel_sql("gobs") + """,
m3 AS (SELECT as_of, industry_code, employment_level, growth, row_number() OVER (PARTITION BY as_of, industry_code ORDER BY period DESC) AS rn FROM pg),
md AS (SELECT as_of, industry_code, max(employment_level) FILTER (rn = 1) * (exp(avg(growth) FILTER (rn <= 3)) - 1) AS model FROM m3 GROUP BY ALL),
cs AS (SELECT industry_code, month AS target, change AS said, vintage_date AS released FROM fall WHERE NOT seasonally_adjusted),
rv AS (SELECT industry_code, month, max(level) FILTER (revision = 2 AND benchmark_revision = 0) - max(level) FILTER (revision = 0 AND benchmark_revision = 0) AS rev FROM sa WHERE seasonally_adjusted GROUP BY ALL),
mv AS (SELECT industry_code, month, rev, change - lag(change, 3) OVER (PARTITION BY industry_code ORDER BY month) AS mom FROM fpx LEFT JOIN rv USING (industry_code, month)),
bd AS (SELECT industry_code, quantile_cont(abs(rev), 0.9) AS bound, median(rev) AS delta FROM mv GROUP BY ALL),
ty AS (SELECT industry_code, month AS target, CASE WHEN abs(rev) >= bound THEN 'large_revision' WHEN abs(mom) >= 40 THEN 'turning_point' WHEN month(month) = 2 THEN 'benchmark_window' ELSE 'normal' END AS month_type FROM mv JOIN bd USING (industry_code)),
fc AS (SELECT tg.*, rw AS naive_rw, tm AS naive_mean, model, model - delta AS model_5a, CASE WHEN cs.released - 1 <= tg.as_of THEN said END AS consensus, month_type FROM tg LEFT JOIN nv USING (industry_code, regime, target)
  LEFT JOIN md USING (as_of, industry_code) LEFT JOIN cs USING (industry_code, target) LEFT JOIN ty USING (industry_code, target) LEFT JOIN bd USING (industry_code)),
er AS (UNPIVOT (SELECT industry_code, regime, month_type, actual - model AS model, actual - model_5a AS model_5a, actual - consensus AS consensus, actual - naive_rw AS naive_rw, actual - naive_mean AS naive_mean FROM fc) ON model, model_5a, consensus, naive_rw, naive_mean INTO NAME competitor VALUE e),
both_ AS (SELECT * FROM er UNION ALL SELECT * REPLACE ('all' AS month_type) FROM er)
SELECT industry_code, regime, month_type, competitor, count(e) AS n, round(avg(e), 6) AS me, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM both_ GROUP BY ALL"""


@query(_BACKTEST)
def pip12_backtest(spark, sf_dir):
    """Two years of months, forecast a week and a day before their first print from what was known then, and scored by month type."""
    obs = stored(vintage_obs(spark, sf_dir), "prints")
    prints = stored(evaluate.first_print_changes(obs.where("source = 'ces'"), ["seasonally_adjusted", *_BY]), "changes")
    first = prints.where("seasonally_adjusted").drop("seasonally_adjusted")
    last = first.agg(F.add_months(F.max("month"), -24).alias("after"))
    months = first.join(F.broadcast(last), F.col("month") > F.col("after")).select(*_BY, "month")  # one row is broadcast
    asked = stored(backtest.targets(first, months, {"t7": 7, "t1": 1}, _BY), "targets")
    as_of = [r.as_of for r in asked.select("as_of").distinct().collect()]  # a release day for each of 24 months and two regimes
    survey = obs.where("source = 'ces' AND seasonally_adjusted")
    panel = intervals.panel_grid(survey, as_of)
    consensus = prints.where("NOT seasonally_adjusted").select(*_BY, "month", F.col("change").alias("value"), F.col("vintage_date").alias("release_date"))
    one = lambda r: F.max(F.when((F.col("revision") == r) & (F.col("benchmark_revision") == 0), F.col("employment")))
    revised = survey.where("employment > 0").groupBy(*_BY, F.trunc("ref_date", "MM").alias("month")).agg((one(2) - one(0)).alias("rev"))
    moved = evaluate.momentum(first.join(revised, [*_BY, "month"], "left"), _BY, "change", 3)
    types = evaluate.month_types(moved, _BY, "rev", "momentum").select(*_BY, F.col("month").alias("target"), "month_type")
    bias = moved.groupBy(*_BY).agg(F.median("rev").alias("bias"))
    said = backtest.locked(backtest.naive(asked, first, _BY, "change"), consensus, _BY)
    said = backtest.panel_forecast(said, panel, _BY).join(types, [*_BY, "target"], "left").join(bias, _BY, "left")
    named = said.withColumns({"model_5a": F.col("model") - F.col("bias"), "naive_rw": F.col("rw"), "naive_mean": F.col("tm")})
    out = backtest.scoreboard(named, ["model", "model_5a", "consensus", "naive_rw", "naive_mean"], F.lit(False), _BY)
    return out.select(*_BY, "regime", "month_type", "competitor", "n", *[F.round(c, 6).alias(c) for c in ("me", "mae", "rmse")])


# ------------------------------------------------------------------ regressions

_REGRESSION = """, mr AS (SELECT c_mktsegment, month, sum(o_totalprice) / 100000 AS total, count(*) AS n FROM om GROUP BY ALL),
mx AS (SELECT c_mktsegment, total - lag(total) OVER w AS y, CASE WHEN n % 7 <> 0 THEN n END AS x1, lag(total) OVER w AS x2, month(month) AS x3 FROM mr WINDOW w AS (PARTITION BY c_mktsegment ORDER BY month)),
ok AS (SELECT * FROM mx WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
mo AS (SELECT c_mktsegment, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, var_pop(y) AS syy, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x3, y) AS c3,
  var_pop(x1) AS s11, var_pop(x2) AS s22, var_pop(x3) AS s33, covar_pop(x1, x2) AS s12, covar_pop(x1, x3) AS s13, covar_pop(x2, x3) AS s23 FROM ok GROUP BY ALL),
ad AS (SELECT *, s22 * s33 - s23 * s23 AS a11, s13 * s23 - s12 * s33 AS a12, s12 * s23 - s13 * s22 AS a13, s11 * s33 - s13 * s13 AS a22, s12 * s13 - s11 * s23 AS a23, s11 * s22 - s12 * s12 AS a33 FROM mo),
de AS (SELECT *, s11 * a11 + s12 * a12 + s13 * a13 AS det FROM ad),
be AS (SELECT *, (a11 * c1 + a12 * c2 + a13 * c3) / det AS b1, (a12 * c1 + a22 * c2 + a23 * c3) / det AS b2, (a13 * c1 + a23 * c2 + a33 * c3) / det AS b3, (a11 * m1 + a12 * m2 + a13 * m3) / det AS w1, (a12 * m1 + a22 * m2 + a23 * m3) / det AS w2, (a13 * m1 + a23 * m2 + a33 * m3) / det AS w3 FROM de),
si AS (SELECT *, n * (syy - b1 * c1 - b2 * c2 - b3 * c3) AS rss FROM be), sg AS (SELECT *, rss / (n - 4) / n AS q FROM si),
co AS (SELECT c_mktsegment, n, 1 - rss / (n * syy) AS r2, unnest(['const', 'x1', 'x2', 'x3']) AS name, unnest([my - b1 * m1 - b2 * m2 - b3 * m3, b1, b2, b3]) AS estimate,
  unnest([sqrt(q * (1 + m1 * w1 + m2 * w2 + m3 * w3)), sqrt(q * a11 / det), sqrt(q * a22 / det), sqrt(q * a33 / det)]) AS se, unnest([q * (1 + m1 * w1 + m2 * w2 + m3 * w3), -q * w1, -q * w2, -q * w3]) AS with_const FROM sg)
SELECT c_mktsegment, CAST(n AS BIGINT) AS n, name, round(r2, 5) AS r2, round(estimate, 5) AS estimate, round(se, 5) AS se, round(with_const, 5) AS with_const FROM co"""


@query(_REGRESSION)
def agg25_least_squares(spark, sf_dir):
    """The change of a segment's orders on four regressors, one without any value; rows that lack another are dropped."""
    monthly = order_months(spark, sf_dir).groupBy("c_mktsegment", "month").agg((F.sum("o_totalprice") / 100000).alias("total"), F.count("*").alias("n"))
    w = Window.partitionBy("c_mktsegment").orderBy("month")
    rows = monthly.select(
        "c_mktsegment", (F.col("total") - F.lag("total").over(w)).alias("y"), F.when(F.col("n") % 7 != 0, F.col("n")).alias("x1"), F.lag("total").over(w).alias("x2"), F.month("month").alias("x3"), F.lit(None).cast("double").alias("x4")
    )
    fit = regression.least_squares(rows, ["c_mktsegment"], "y", ["x1", "x2", "x3", "x4"])
    each = fit.select("c_mktsegment", "n", "r2", F.posexplode("coefficients").alias("at", "c"), F.col("covariance")[0].alias("v"))
    return each.select("c_mktsegment", "n", "c.name", *[F.round(x, 5).alias(a) for a, x in (("r2", F.col("r2")), ("estimate", F.col("c.estimate")), ("se", F.col("c.se")), ("with_const", F.col("v")[F.col("at")]))])


# ------------------------------------------------------------------ gates of the rebuild

_BAND_ROWS = """, q0 AS (SELECT * FROM obs WHERE source = 'qcew' QUALIFY row_number() OVER (PARTITION BY industry_code, ref_date ORDER BY revision DESC, benchmark_revision DESC, vintage_date DESC, employment DESC) = 1),
s0 AS (SELECT * FROM obs WHERE source = 'ces' AND NOT seasonally_adjusted QUALIFY row_number() OVER (PARTITION BY industry_code, ref_date ORDER BY revision DESC, benchmark_revision DESC, vintage_date DESC, employment DESC) = 1),
rules AS (SELECT * FROM (VALUES ('BUILDING', 'BUILDING', -0.03, 0.02), ('MACHINERY', 'MACHINERY', -0.03, 0.02), ('FURNITURE', 'FURNITURE', -0.03, 0.02), ('AUTOMOBILE', 'AUTOMOBILE', -0.03, 0.02), ('HOUSEHOLD', 'BUILDING', -0.2, 0.05)) r(code, other, expected, band)),
rb AS (SELECT code, expected, band, s0.ref_date, CASE WHEN code = 'MACHINERY' THEN 1.05 WHEN code = 'FURNITURE' THEN 0.9 WHEN code = 'HOUSEHOLD' THEN 0.8 WHEN code = 'AUTOMOBILE' AND year(s0.ref_date) < 1995 THEN 0.97
  WHEN year(s0.ref_date) = 1995 THEN 0.2 WHEN s0.ref_date >= DATE '2000-06-01' AND month(s0.ref_date) % 2 = 0 THEN 0.5 WHEN year(s0.ref_date) = 1997 AND month(s0.ref_date) = 3 THEN 0.6 ELSE 0.97 END - 1 AS residual
  FROM rules JOIN s0 ON s0.industry_code = rules.other JOIN q0 ON q0.industry_code = rules.code AND q0.ref_date = s0.ref_date WHERE code <> 'AUTOMOBILE' OR year(s0.ref_date) = 1995),
rf AS (SELECT *, CASE WHEN year(ref_date) = 1995 THEN 'excluded' WHEN residual < expected - 0.15 AND ref_date >= DATE '2000-06-01' THEN 'frontier' WHEN residual < expected - 0.15 THEN 'collapsed' ELSE 'clean' END AS fate FROM rb),
rm AS (SELECT code, expected, band, count(*) FILTER (fate IN ('clean', 'collapsed')) AS n, count(*) FILTER (fate = 'excluded') AS n_excluded, count(*) FILTER (fate = 'frontier') AS n_frontier, count(*) FILTER (fate = 'collapsed') AS n_collapsed,
  median(residual) FILTER (fate IN ('clean', 'collapsed')) AS median FROM rf GROUP BY ALL),
rv AS (SELECT *, CASE WHEN n = 0 THEN 'no_months' WHEN median > 0.01 THEN 'positive' WHEN abs(median - expected) > band THEN 'outside' ELSE 'ok' END AS verdict FROM rm)"""


def _band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census levels made from the survey's, so that each rule has a series that breaks it.

    BUILDING is as expected, but for a collapse in a settled month and collapses
    at the frontier; MACHINERY is above the survey, FURNITURE beyond its band;
    AUTOMOBILE has months of an excluded year alone; HOUSEHOLD is held against
    another industry of the survey.
    """
    rows = conform(vintage_obs(spark, sf_dir), VINTAGE, fill=True)
    survey = rows.where("source = 'ces' AND NOT seasonally_adjusted")
    best = gates.best_available(survey, gates.SERIES_ID).select("industry_code", "ref_date", F.col("employment").alias("level"))
    other = F.when(F.col("industry_code") == "HOUSEHOLD", "BUILDING").otherwise(F.col("industry_code"))
    census = gates.best_available(rows.where("source = 'qcew'"), gates.SERIES_ID).withColumn("seasonally_adjusted", F.lit(False))
    year, month = F.year("ref_date"), F.month("ref_date")
    share = (
        F.when(F.col("industry_code") == "MACHINERY", 1.05).when(F.col("industry_code") == "FURNITURE", 0.9).when(F.col("industry_code") == "HOUSEHOLD", 0.8)
        .when(year == 1995, 0.2).when((F.col("ref_date") >= "2000-06-01") & (month % 2 == 0), 0.5).when((year == 1997) & (month == 3), 0.6).otherwise(0.97)
    )
    levels = best.withColumnRenamed("industry_code", "_of")
    made = census.withColumn("_of", other).join(levels, ["_of", "ref_date"]).withColumn("employment", F.col("level") * share).where((F.col("industry_code") != "AUTOMOBILE") | (year == 1995))
    segment = [("BUILDING", "BUILDING", -0.03, 0.02), ("MACHINERY", "MACHINERY", -0.03, 0.02), ("FURNITURE", "FURNITURE", -0.03, 0.02), ("AUTOMOBILE", "AUTOMOBILE", -0.03, 0.02), ("HOUSEHOLD", "BUILDING", -0.2, 0.05)]
    rules = spark.createDataFrame([("supersector", a, "supersector", b, e, w) for a, b, e, w in segment], "industry_type string, industry_code string, other_type string, other_code string, expected double, band double")
    # ownership is null on both sides here
    filled = lambda df: df.withColumn("ownership", F.lit("private"))
    residuals = gates.band_residuals(filled(made), filled(survey), rules, frontier=F.lit("2000-06-01").cast("date"), excluded_years=(1995,))
    return gates.band_medians(residuals)


@query(_BAND_ROWS + """ SELECT 'nothing_shared' AS "check", 'hard' AS severity, CAST(count(*) = 0 AS BIGINT) AS violations FROM rv UNION ALL SELECT 'months_excluded', 'soft', CAST(sum(n_excluded) AS BIGINT) FROM rv
UNION ALL SELECT 'frontier_excluded', 'soft', CAST(sum(n_frontier) AS BIGINT) FROM rv UNION ALL SELECT 'no_months_left', 'hard', count(*) FILTER (verdict = 'no_months') FROM rv
UNION ALL SELECT 'months_collapsed', 'hard', CAST(sum(n_collapsed) AS BIGINT) FROM rv UNION ALL SELECT 'median_positive', 'hard', count(*) FILTER (verdict = 'positive') FROM rv UNION ALL SELECT 'median_outside', 'hard', count(*) FILTER (verdict = 'outside') FROM rv""")
def dq07_band_gate(spark, sf_dir):
    return gates.band(_band(spark, sf_dir))


@query(_BAND_ROWS + " SELECT code AS industry_code, CAST(expected AS DOUBLE) AS expected, CAST(band AS DOUBLE) AS band, n, n_excluded, n_frontier, n_collapsed, round(CAST(median AS DOUBLE), 6) AS median, verdict FROM rv")
def dq07_band_medians(spark, sf_dir):
    out = _band(spark, sf_dir).withColumn("median", F.round("median", 6))
    return out.select("industry_code", "expected", "band", "n", "n_excluded", "n_frontier", "n_collapsed", "median", "verdict")


_NESTED = """, w AS (SELECT * FROM obs WHERE source = 'ces' AND NOT seasonally_adjusted), tot AS (SELECT ref_date, revision, benchmark_revision, sum(employment) AS e, count(*) AS n FROM w WHERE industry_code IN ('BUILDING', 'MACHINERY') GROUP BY ALL)"""


@query(_NESTED + """ SELECT 'total' AS parent_type, '05' AS parent_code, ref_date, revision, benchmark_revision, e + CASE WHEN month(ref_date) = 4 THEN 3 ELSE 0 END AS level, e AS children FROM tot WHERE n = 2 AND month(ref_date) = 4""")
def dq05_additive_nesting(spark, sf_dir):
    """A total of two segments that is too high in each April; benchmark prints come twice, the older of them wrong everywhere."""
    rows = conform(vintage_obs(spark, sf_dir), VINTAGE, fill=True).where("source = 'ces' AND NOT seasonally_adjusted")
    parts = rows.where("industry_code IN ('BUILDING', 'MACHINERY')")
    keys = ["geographic_type", "geographic_code", "ref_date", "vintage_date", "revision", "benchmark_revision", "source", "seasonally_adjusted"]
    total = parts.groupBy(*keys).agg((F.sum("employment") + F.when(F.month("ref_date") == 4, 3).otherwise(0)).alias("employment"))
    total = conform(total.withColumns({"industry_type": F.lit("total"), "industry_code": F.lit("05")}), VINTAGE, fill=True)
    older = total.where("benchmark_revision = 1").withColumns({"vintage_date": F.add_months("vintage_date", -6), "employment": F.col("employment") + 50})
    edges = spark.createDataFrame([("total", "05", "supersector", "BUILDING"), ("total", "05", "supersector", "MACHINERY")], "parent_type string, parent_code string, child_type string, child_code string")
    out = gates.additive_nesting(parts.unionByName(total).unionByName(older), edges, 0.5)
    return out.select("parent_type", "parent_code", "ref_date", "revision", "benchmark_revision", "level", "children")


# ------------------------------------------------------------------ cell arrays


@query(""", cells AS (SELECT month, c_nationkey, sum(o_totalprice) AS v, count(*) AS k FROM om WHERE c_nationkey % 6 <> 5 AND (month(month) <> 7 OR c_nationkey > 3) GROUP BY ALL), idx AS (SELECT unnest(range(22)) AS i),
ms AS (SELECT DISTINCT month FROM cells WHERE c_nationkey BETWEEN 2 AND 23), full_ AS (SELECT ms.month, i, v, k FROM ms CROSS JOIN idx LEFT JOIN cells ON cells.month = ms.month AND cells.c_nationkey = i + 2)
SELECT month, list(v IS NOT NULL ORDER BY i)::VARCHAR AS mask, list(round(v, 2) ORDER BY i) FILTER (v IS NOT NULL)::VARCHAR IS NOT NULL AS has_levels, list(k ORDER BY i)::VARCHAR AS counts, round(sum(v * (i + 1)), 2) AS weighted FROM full_ GROUP BY month""")
def rsh08_cell_arrays(spark, sf_dir):
    """Nations as cells in reverse order of an index without the first two, with gaps."""
    cells = order_months(spark, sf_dir).where("c_nationkey % 6 <> 5 AND (month(month) <> 7 OR c_nationkey > 3)").groupBy("month", "c_nationkey").agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("k"))
    index = spark.createDataFrame([(n, n - 2) for n in range(2, 24)], "c_nationkey int, place int")
    out = composite.cell_arrays(cells, index, ["month"], ["v", "k"], 22)
    shown = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))), ", "), F.lit("]"))
    weighted = F.aggregate(F.zip_with("v", F.sequence(F.lit(1), F.lit(22)), lambda v, i: F.coalesce(v * i, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return out.select("month", shown(F.col("mask")).alias("mask"), F.exists("v", lambda x: x.isNotNull()).alias("has_levels"), shown(F.col("k")).alias("counts"), F.round(weighted, 2).alias("weighted"))


# ------------------------------------------------------------------ survey prints from triangle files

_TRIANGLES = """, tb AS (SELECT 'tri_' || lpad(CAST(10 * (1 + ascii(c_mktsegment) % 7) AS VARCHAR), 2, '0') || '0000' AS f, CAST(month + INTERVAL 240 MONTH AS DATE) AS ref, count(*) AS base FROM om GROUP BY ALL),
rel AS (SELECT DISTINCT CAST(month + INTERVAL 240 MONTH AS DATE) AS release FROM om WHERE month <> DATE '1996-05-01'), ad AS (SELECT * FROM (VALUES ('NSA', false, 0), ('SA', true, 100)) a(s, adj, lift)),
tc AS (SELECT f, s, adj, ref, release, (year(release) - year(ref)) * 12 + month(release) - month(ref) AS lag, base + lift + least(datediff('month', ref, release), 2) + CASE WHEN month(ref) % 2 = 0 THEN 10 * (year(release) - year(ref)) ELSE 0 END AS v
  FROM tb JOIN rel ON release >= ref AND NOT (month(ref) = 8 AND datediff('month', ref, release) = 1), ad),
tn AS (SELECT *, row_number() OVER (PARTITION BY f, s, ref ORDER BY release) - 1 AS i FROM (SELECT f, s, adj, t.ref, r.release, c.v FROM (SELECT DISTINCT f, s, adj, ref FROM tc) t JOIN rel r ON r.release >= t.ref LEFT JOIN tc c USING (f, s, adj, ref, release)) WHERE ref IN (SELECT release FROM rel)),
tf AS (SELECT f, adj, ref, CAST(i AS INT) AS revision, CAST(0 AS INT) AS benchmark_revision, v, CAST(ref + to_months(CAST(i AS INT)) AS DATE) AS of_ FROM (SELECT *, min(CASE WHEN v IS NULL THEN i END) OVER (PARTITION BY f, s, ref) AS gap FROM tn WHERE i < 3) WHERE v IS NOT NULL AND (gap IS NULL OR i < gap)),
tj AS (SELECT f, adj, ref, CAST(2 AS INT) AS revision, CAST(1 AS INT) AS benchmark_revision, v, release AS of_ FROM (SELECT *, lag(v) OVER (PARTITION BY f, s, ref ORDER BY release) AS p FROM tn WHERE month(release) = 1 AND year(release) > year(ref) AND v IS NOT NULL) WHERE p IS NULL OR p <> v),
ta AS (SELECT *, CAST(date_trunc('month', of_) + INTERVAL 1 MONTH AS DATE) AS nm FROM (SELECT * FROM tf UNION ALL SELECT * FROM tj)),
td AS (SELECT *, CAST(nm + CAST((5 - isodow(nm) + 7) % 7 AS INT) AS DATE) AS fr FROM ta), tv AS (SELECT *, CASE WHEN (month(fr) = 1 AND day(fr) = 1) OR (month(fr) = 7 AND day(fr) = 4) THEN CAST(fr + 7 AS DATE) ELSE fr END AS vintage_date FROM td)
SELECT substr(f, 5, 2) AS industry_code, adj AS seasonally_adjusted, CAST(ref + 11 AS DATE) AS ref_date, vintage_date, revision, benchmark_revision, CAST(v AS DOUBLE) AS employment FROM tv
WHERE (benchmark_revision = 0 OR vintage_date <= DATE '2018-06-12') AND ref >= DATE '2015-06-01' AND f IN ('tri_100000', 'tri_200000', 'tri_300000', 'tri_400000', 'tri_500000', 'tri_600000', 'tri_700000')"""


def _triangle_files(spark: SparkSession, sf_dir: str) -> str:
    """Triangle files of each segment's orders, in both adjustments: a header of its own for each, one release missing, some cells empty.

    Months are moved on by twenty years, as the headers' years have two digits.
    """
    codes = F.concat(F.lit("tri_"), F.lpad((10 * (1 + F.ascii("c_mktsegment") % 7)).cast("string"), 2, "0"), F.lit("0000"))
    base = order_months(spark, sf_dir).groupBy(codes.alias("f"), F.add_months("month", 240).alias("ref")).agg(F.count("*").alias("base"))
    levels = base.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("ref", "base"))).alias("levels"))  # months are few
    releases = order_months(spark, sf_dir).select(F.add_months("month", 240).alias("release")).distinct().where("release <> DATE'2016-05-01'").agg(F.sort_array(F.collect_list("release")).alias("releases"))
    kinds = F.explode(F.array(F.struct(F.lit("NSA").alias("s"), F.lit(0).alias("lift")), F.struct(F.lit("SA").alias("s"), F.lit(100).alias("lift")))).alias("a")
    each = levels.join(F.broadcast(releases)).select("f", "levels", "releases", kinds)  # a row of releases
    one = """CASE WHEN r >= x.ref AND NOT (month(x.ref) = 8 AND 12 * (year(r) - year(x.ref)) + month(r) - month(x.ref) = 1) THEN CAST(x.base + a.lift + least(12 * (year(r) - year(x.ref)) + month(r) - month(x.ref), 2)
        + CASE WHEN month(x.ref) % 2 = 0 THEN 10 * (year(r) - year(x.ref)) ELSE 0 END AS STRING) ELSE '' END"""
    lines = F.expr(f"transform(releases, r -> concat_ws(',', CAST(year(r) AS STRING), CAST(month(r) AS STRING), array_join(transform(levels, x -> {one}), ',')))")
    head = F.concat(F.lit("year,month,"), F.array_join(F.transform("levels", lambda x: F.date_format(x["ref"], "MMM_yy")), ","))
    path = new_folder(spark, "triangles")
    files = each.select(F.concat("f", F.lit("_"), "a.s").alias("file"), F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("value"))
    files.write.partitionBy("file").text(path)
    return path


@query(_TRIANGLES)
def rsh06_survey_panel(spark, sf_dir):
    """Store rows of both adjustments from all files."""
    codes = [(f"{n}0000", "supersector", str(n), "private") for n in (10, 20, 30, 40, 50, 60, 70)]
    industries = spark.createDataFrame(codes, "code string, industry_type string, industry_code string, ownership string")
    moved = survey.survey_panel(spark, _triangle_files(spark, sf_dir), industries, as_of=F.lit("2018-06-12").cast("date"), first_month=F.lit("2015-06-01").cast("date"))
    return moved.select("industry_code", "seasonally_adjusted", "ref_date", "vintage_date", "revision", "benchmark_revision", "employment")


# ------------------------------------------------------------------ jobs on a store

_STORE_SUMS = " SELECT source, seasonally_adjusted, revision, count(*) AS n, sum(employment) AS total, min(vintage_date) AS first_vintage, max(vintage_date) AS last_vintage FROM st GROUP BY ALL"


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "seasonally_adjusted", "revision").agg(F.count("*").alias("n"), F.sum("employment").alias("total"), F.min("vintage_date").alias("first_vintage"), F.max("vintage_date").alias("last_vintage"))


def _store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(conform(vintage_obs(spark, sf_dir), VINTAGE, fill=True), "prints")


@query(""", st AS (SELECT * REPLACE (CASE WHEN source = 'ces' AND seasonally_adjusted AND month(ref_date) > 6 THEN employment + 2 WHEN source = 'ces' AND seasonally_adjusted AND month(ref_date) < 9 THEN employment + 1 ELSE employment END AS employment) FROM obs)""" + _STORE_SUMS)
def snk03_priority_merge(spark, sf_dir):
    """A stored history, onto which two sources of one adjustment are merged; the second one goes first where they overlap."""
    rows, path = _store_rows(spark, sf_dir), new_folder(spark, "merged")
    store.append(rows, path)
    survey_rows = rows.where("source = 'ces' AND seasonally_adjusted")
    plus = lambda n: F.col("employment") + n
    jobs.build_store(survey_rows.where("month(ref_date) < 9").withColumn("employment", plus(1)), survey_rows.where("month(ref_date) > 6").withColumn("employment", plus(2)), path)
    return _sums(store.read(spark, path))


@query(""", st AS (SELECT * FROM obs)""" + _STORE_SUMS)
def snk09_healed_store(spark, sf_dir):
    """A store that lies in fragments, some rows of it twice, after it has been healed."""
    rows, path = _store_rows(spark, sf_dir), new_folder(spark, "fragments")
    for lot in (rows.where("month(ref_date) < 7"), rows.where("month(ref_date) > 4 AND source = 'ces'"), rows.where("month(ref_date) > 6 AND source = 'qcew'")):
        lot.write.mode("append").partitionBy(*jobs.PARTITION).parquet(path)
    jobs.heal(spark, path)
    return _sums(store.read(spark, path))


@query(""", w AS (SELECT * FROM obs WHERE source = 'ces' AND vintage_date BETWEEN DATE '1998-02-12' AND DATE '1998-08-12'), st AS (SELECT * FROM obs WHERE vintage_date < DATE '1998-03-12' OR source = 'qcew' OR vintage_date BETWEEN DATE '1998-03-12' AND DATE '1998-08-12')
SELECT 'would_append' AS what, count(*) FILTER (vintage_date >= DATE '1998-03-12') AS n FROM w UNION ALL SELECT 'appended', count(*) FILTER (vintage_date >= DATE '1998-03-12') FROM w
UNION ALL SELECT 'again', 0 UNION ALL SELECT 'corrected', count(*) FILTER (vintage_date = DATE '1998-02-12') FROM w UNION ALL SELECT 'stored', count(*) FROM st""")
def str06_frontier_patch(spark, sf_dir):
    """Prints of some months, patched onto a store that ends within them: counted first, then appended, then once more."""
    rows, path = _store_rows(spark, sf_dir), new_folder(spark, "patched")
    store.append(rows.where("vintage_date < '1998-03-12' OR source = 'qcew'"), path)
    changed = F.col("employment") + F.when(F.col("vintage_date") == "1998-02-12", 1).otherwise(0)
    window, through = rows.where("vintage_date >= '1997-10-01' AND source = 'ces'").withColumn("employment", changed), F.lit("1998-08-12").cast("date")
    dry = jobs.patch_frontier(window, path, through)
    corrected = dry.corrected.count()
    done = jobs.patch_frontier(window, path, through, apply=True)
    again = jobs.patch_frontier(window, path, through, apply=True)
    counts = [("would_append", dry.would_append), ("appended", done.appended), ("again", again.appended), ("corrected", corrected)]
    return spark.createDataFrame(counts, "what string, n long").union(store.read(spark, path).agg(F.lit("stored"), F.count("*")))


@query(_panel_sql("(SELECT *, DATE '1997-03-12' AS as_of FROM obs WHERE vintage_date <= DATE '1997-03-12' AND ref_date < DATE '1997-03-12')") + " SELECT source, industry_code, count(*) AS n, round(sum(growth), 4) AS growth, sum(employment_level) AS total FROM pg GROUP BY ALL")
def snk07_pinned_panel(spark, sf_dir):
    """The panel of a day, pinned under its content hash and read back through the check of it."""
    path = new_folder(spark, "pinned")
    panel = intervals.panel_grid(vintage_obs(spark, sf_dir), [datetime.date(1997, 3, 12)])
    content = jobs.snapshot(panel, path, "1997-03-12")
    out = jobs.load_snapshot(spark, path, "1997-03-12", content)
    return out.groupBy("source", "industry_code").agg(F.count("*").alias("n"), F.round(F.sum("growth"), 4).alias("growth"), F.sum("employment_level").alias("total"))


# ------------------------------------------------------------------ capture


def _streamed(spark: SparkSession, deliveries: list[DataFrame], start) -> str:
    """Land deliveries as a file each and run a stream over them, one a trigger; returns the folder of its outputs."""
    folder = new_folder(spark, "stream")
    for delivery in deliveries:
        delivery.coalesce(1).write.mode("append").parquet(f"{folder}/landing")  # a delivery is one file of a feed
    arrivals = spark.readStream.schema(deliveries[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landing")
    start(arrivals, folder).awaitTermination()
    start(arrivals, folder).awaitTermination()  # again from the checkpoint: nothing is left
    return folder


@query(""", it AS (SELECT DISTINCT source AS feed, vintage_date FROM obs WHERE revision = 0), lim AS (SELECT feed, max(vintage_date) FILTER (vintage_date < DATE '1995-06-01') AS a, max(vintage_date) FILTER (vintage_date < DATE '1997-06-01') AS b FROM it GROUP BY feed)
SELECT lim.feed, CAST(2 AS BIGINT) AS n_fired, any_value(b) AS last_pub, count(*) AS n_stored, sum(employment) AS total FROM lim JOIN obs ON obs.source = feed AND vintage_date <= b GROUP BY lim.feed""")
def str01_watch(spark, sf_dir):
    """Two feeds announce releases in four deliveries: new ones, a mix of new and repeated ones out of order, and repeats alone."""
    rows = _store_rows(spark, sf_dir)
    items = rows.where("revision = 0").select(F.col("source").alias("feed"), F.col("vintage_date").alias("pub_date"), "ref_date").distinct()
    early, later = items.where("pub_date < '1995-06-01'"), items.where("pub_date < '1997-06-01'")
    schedule = rows.where("revision = 0").select("source", "ref_date", "revision", "benchmark_revision", "vintage_date").distinct()

    def start(arrivals, folder):
        def update(session, feed, day):
            store.append(rows.where((F.col("source") == feed) & (F.col("vintage_date") <= F.lit(day))), f"{folder}/store")

        return capture.watch(arrivals, f"{folder}/store", schedule, folder, f"{folder}/offsets", update)

    folder = _streamed(spark, [early, later.orderBy(F.desc("pub_date")), early, later], start)
    fired = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/fired").groupBy("feed").agg(F.count("*").alias("n_fired"), F.max("pub_date").alias("last_pub"))
    held = store.read(spark, f"{folder}/store").groupBy(F.col("source").alias("feed")).agg(F.count("*").alias("n_stored"), F.sum("employment").alias("total"))
    return fired.join(held, "feed")


@query(rebuild_queries._QUARTERS.format(lift=0) + rebuild_queries._TREE_SQL.format(where="area_fips = 'US000' AND revision = 0 AND y = 1996 AND q = 1")
       + " SELECT t AS industry_type, c AS industry_code, ref_date, CAST(DATE '1996-08-01' AS DATE) AS vintage_date, round(sum(e), 6) AS employment FROM tl GROUP BY ALL")
def str05_quarter_levels(spark, sf_dir):
    """The newest quarter knowable in August 1996 from landed files, which come twice; its levels."""
    return _captured_quarter(spark, sf_dir).where("size_class_type IS NULL").select("industry_type", "industry_code", "ref_date", "vintage_date", F.round("employment", 6).alias("employment"))


@query(rebuild_queries._QUARTERS.format(lift=0) + rebuild_queries._TREE_SQL.format(where="y = 1996 AND q = 1 AND (disclosure_code IS NULL OR disclosure_code <> 'N')")
       + """, sz AS (SELECT * FROM (VALUES ('total', '0', '123456789'), ('small', '1', '12345'), ('small', '2', '67'), ('small', '3', '89'), ('medium', '1', '1234'), ('medium', '2', '5'), ('medium', '3', '6'), ('medium', '4', '7'), ('medium', '5', '89'), ('large', '1', '1'), ('large', '2', '2'),
  ('large', '3', '3'), ('large', '4', '4'), ('large', '5', '5'), ('large', '6', '6'), ('large', '7', '7'), ('large', '8', '8'), ('large', '9', '9')) s(scheme, bucket, codes))
SELECT t AS industry_type, c AS industry_code, scheme AS size_class_type, bucket AS size_class_code, ref_date, round(sum(e), 6) AS employment FROM tl JOIN sz ON contains(codes, size_code) WHERE own_code = '5' GROUP BY ALL""")
def str05_quarter_sizes(spark, sf_dir):
    """The same quarter's sizes in every scheme, as it is a first one."""
    rows = _captured_quarter(spark, sf_dir).where("size_class_type IS NOT NULL")
    return rows.select("industry_type", "industry_code", "size_class_type", "size_class_code", "ref_date", F.round("employment", 6).alias("employment"))


def _captured_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = rebuild_queries._quarters(spark, sf_dir).withColumn("kind", F.lit("area")).unionByName(rebuild_queries._quarters(spark, sf_dir, 10).withColumn("kind", F.lit("size")))
    landed = stored(landed, "landed")

    def start(arrivals, folder):
        return capture.capture_quarters(arrivals, f"{folder}/store", folder, f"{folder}/offsets", datetime.date(1996, 8, 15))

    return store.read(spark, f"{_streamed(spark, [landed, landed], start)}/store")

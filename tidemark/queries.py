"""Registered queries over the driver's tables, each with the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import acquire_queries, job_queries, rebuild_queries  # noqa: F401  (they register their queries)
from tidemark.functions import dates, series
from tidemark.operators import backtest, calendar, censor, composite, evaluate, hierarchy, model_data, quality, rebuild, regression, store, triangle, views
from tidemark.plans.demo import order_months, vintage_obs
from tidemark.registry import ORACLES, QUERIES, query
from tidemark.schemas import SERIES, VINTAGE, conform
from tidemark.sources import readers
from tidemark.sources.readers import table
from tidemark.storage import new_folder
from tidemark.streaming import capture

_AS_OF, _SETTLED = "2000-06-12", "1997-01-12"
_KEY = ["source", "seasonally_adjusted", "industry_code", "ref_date", "revision", "benchmark_revision"]


def _day(text: str):
    return F.lit(text).cast("date")


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value and number by segment and month."""
    return order_months(spark, sf_dir).groupBy("c_mktsegment", "month").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


_MONTHLY_SQL = ", mon AS (SELECT c_mktsegment, month, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM om GROUP BY ALL)"

# ------------------------------------------------------------------ censoring and prints

_KNOWN = f", k AS (SELECT * FROM obs WHERE vintage_date <= DATE '{_AS_OF}' AND ref_date < DATE '{_AS_OF}' AND employment > 0)"
_GROWN = """, g0 AS (SELECT *, ln(employment) - lag(ln(employment)) OVER (PARTITION BY source, seasonally_adjusted, industry_code, revision, benchmark_revision ORDER BY ref_date) AS growth FROM k),
g AS (SELECT * FROM g0 WHERE growth IS NOT NULL)"""


@query(_KNOWN + " SELECT source, seasonally_adjusted, industry_code, ref_date, vintage_date, revision, benchmark_revision, employment FROM k")
def flt03_knowable(spark, sf_dir):
    rows = censor.valid(censor.knowable(vintage_obs(spark, sf_dir), _day(_AS_OF)))
    return rows.select(*_KEY, "vintage_date", "employment")


@query(
    _KNOWN
    + _GROWN
    + " SELECT source, seasonally_adjusted, industry_code, ref_date, revision, benchmark_revision, round(growth, 6) AS growth FROM g"
)
def win01_growth(spark, sf_dir):
    rows = censor.growth(censor.valid(censor.knowable(vintage_obs(spark, sf_dir), _day(_AS_OF))))
    return rows.select(*_KEY, F.round("growth", 6).alias("growth"))


_CES = """, r AS (SELECT *, dense_rank() OVER (PARTITION BY seasonally_adjusted, industry_code ORDER BY ref_date DESC) AS rk FROM g WHERE source = 'ces'),
m AS (SELECT *, CASE WHEN benchmark_revision = 0 AND ((rk = 1 AND revision = 0) OR (rk = 2 AND revision = 1) OR (rk >= 3 AND revision = 2)) THEN 1 ELSE 0 END AS ok FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY seasonally_adjusted, industry_code, ref_date ORDER BY ok DESC, revision DESC, benchmark_revision DESC, vintage_date DESC) AS rn FROM m)"""


@query(
    _KNOWN + _GROWN + _CES + """
SELECT seasonally_adjusted, industry_code, ref_date, vintage_date, revision, benchmark_revision, employment, round(growth, 6) AS growth, ok FROM f WHERE rn = 1"""
)
def win02_monthly_selection(spark, sf_dir):
    """What growth series was knowable on the day: the flagship."""
    grown = censor.growth(censor.valid(censor.knowable(vintage_obs(spark, sf_dir), _day(_AS_OF))))
    chosen = censor.select_monthly(grown.where("source = 'ces'"))
    return chosen.select("seasonally_adjusted", "industry_code", "ref_date", "vintage_date", "revision", "benchmark_revision", "employment", F.round("growth", 6).alias("growth"), "ok")


_QCEW = f""", q0 AS (SELECT *, CASE WHEN ref_date >= DATE '{_SETTLED}' THEN dense_rank() OVER (PARTITION BY seasonally_adjusted, industry_code, ref_date >= DATE '{_SETTLED}' ORDER BY ref_date DESC) END AS rk,
  CAST(quarter(ref_date) AS INT) AS qq FROM g WHERE source <> 'ces'),
q1 AS (SELECT *, CASE WHEN revision = (CASE WHEN rk = 1 THEN 0 WHEN rk = 2 THEN 1 WHEN rk = 3 THEN (CASE WHEN qq = 4 THEN 1 ELSE 2 END)
  WHEN rk = 4 THEN (CASE WHEN qq = 4 THEN 1 WHEN qq = 3 THEN 2 ELSE 3 END) END) THEN 1 ELSE 0 END AS ok FROM q0),
qf AS (SELECT *, row_number() OVER (PARTITION BY seasonally_adjusted, industry_code, ref_date ORDER BY ok DESC, revision DESC, benchmark_revision DESC, vintage_date DESC) AS rn FROM q1)"""


@query(_KNOWN + _GROWN + _QCEW + " SELECT industry_code, ref_date, vintage_date, revision, benchmark_revision, employment, round(growth, 6) AS growth, ok FROM qf WHERE rn = 1")
def win03_quarterly_selection(spark, sf_dir):
    grown = censor.growth(censor.valid(censor.knowable(vintage_obs(spark, sf_dir), _day(_AS_OF))))
    chosen = censor.select_quarterly(grown.where("source <> 'ces'"), _day(_SETTLED))
    return chosen.select("industry_code", "ref_date", "vintage_date", "revision", "benchmark_revision", "employment", F.round("growth", 6).alias("growth"), "ok")


_PANEL = (
    _KNOWN + _GROWN + _CES + _QCEW + f""", u AS (SELECT source, seasonally_adjusted, industry_code, ref_date, vintage_date, revision, benchmark_revision, employment, growth FROM f WHERE rn = 1
  UNION ALL SELECT source, seasonally_adjusted, industry_code, ref_date, vintage_date, revision, benchmark_revision, employment, growth FROM qf WHERE rn = 1),
panel AS (SELECT ref_date AS period, industry_code, CASE WHEN source = 'ces' THEN (CASE WHEN seasonally_adjusted THEN 'ces_sa' ELSE 'ces_nsa' END) ELSE source END AS source,
  CASE WHEN source = 'ces' THEN 'survey' ELSE 'census' END AS source_type, growth, employment AS employment_level, vintage_date,
  CAST(CASE WHEN source = 'ces' AND benchmark_revision > 0 THEN -1 ELSE revision END AS INT) AS revision_number,
  CASE WHEN source = 'ces' THEN benchmark_revision > 0 ELSE ref_date < DATE '{_SETTLED}' OR revision = 5 - CAST(quarter(ref_date) AS INT) END AS is_final,
  CAST((year(vintage_date) - year(ref_date)) * 12 + month(vintage_date) - month(ref_date) AS INT) AS publication_lag_months FROM u)"""
)
_PANEL_COLUMNS = ["period", "industry_code", "source", "source_type", "growth", "employment_level", "vintage_date", "revision_number", "is_final", "publication_lag_months"]


def _panel(spark, sf_dir):
    return censor.to_panel(vintage_obs(spark, sf_dir), _day(_AS_OF), _day(_SETTLED))


@query(_PANEL + " SELECT period, industry_code, source, source_type, round(growth, 6) AS growth, employment_level, vintage_date, revision_number, is_final, publication_lag_months FROM panel")
def pip01_panel(spark, sf_dir):
    return _panel(spark, sf_dir).select(*_PANEL_COLUMNS).withColumn("growth", F.round("growth", 6))


_ALL = """, allp AS (SELECT ref_date AS period, industry_code, CASE WHEN source = 'ces' THEN (CASE WHEN seasonally_adjusted THEN 'ces_sa' ELSE 'ces_nsa' END) ELSE source END AS source,
  CAST(CASE WHEN source = 'ces' AND benchmark_revision > 0 THEN -1 ELSE revision END AS INT) AS revision_number, vintage_date, employment, benchmark_revision, revision,
  ln(employment) - lag(ln(employment)) OVER (PARTITION BY source, seasonally_adjusted, industry_code, revision, benchmark_revision ORDER BY ref_date) AS growth FROM obs WHERE employment > 0),
full_panel AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY period, industry_code, source, revision_number ORDER BY vintage_date DESC, benchmark_revision DESC, revision DESC) AS rn FROM allp WHERE growth IS NOT NULL) WHERE rn = 1)"""


def _full_panel(spark, sf_dir):
    return censor.to_panel(vintage_obs(spark, sf_dir), None, _day(_SETTLED))


@query(_ALL + f""" SELECT period, industry_code, source, revision_number, vintage_date, employment AS employment_level FROM (
  SELECT *, row_number() OVER (PARTITION BY period, industry_code, source ORDER BY revision_number DESC, vintage_date DESC) AS rn FROM full_panel WHERE vintage_date <= DATE '{_AS_OF}') WHERE rn = 1""")
def top04_real_time_view(spark, sf_dir):
    view = views.real_time_view(_full_panel(spark, sf_dir), _day(_AS_OF), ["period", "industry_code", "source"])
    return view.select("period", "industry_code", "source", "revision_number", "vintage_date", "employment_level")


@query(_ALL + """ SELECT period, industry_code, source, revision_number, employment AS employment_level FROM (SELECT *, row_number() OVER (PARTITION BY period, industry_code, source ORDER BY
  CASE WHEN source = 'qcew' THEN (CASE WHEN period < DATE '1997-01-12' OR revision_number = 5 - quarter(period) THEN 1 ELSE 0 END) ELSE (CASE WHEN revision_number = -1 THEN 1 ELSE 0 END) END DESC,
  CASE WHEN revision_number = -1 THEN 999 ELSE revision_number END DESC, vintage_date DESC) AS rn FROM full_panel) WHERE rn = 1""")
def top05_best_print(spark, sf_dir):
    return views.best_print(_full_panel(spark, sf_dir), ["period", "industry_code", "source"]).select("period", "industry_code", "source", "revision_number", "employment_level")


@query(_ALL + """ SELECT a.period, a.industry_code, round(a.growth, 6) AS growth_a, round(b.growth, 6) AS growth_b, round(b.growth - a.growth, 6) AS difference
FROM full_panel a JOIN full_panel b ON a.period = b.period AND a.industry_code = b.industry_code WHERE a.source = 'ces_sa' AND b.source = 'ces_sa' AND a.revision_number = 0 AND b.revision_number = 2""")
def jon01_vintage_diff(spark, sf_dir):
    diff = views.vintage_diff(_full_panel(spark, sf_dir), "ces_sa", 0, 2, ["period", "industry_code"])
    return diff.select("period", "industry_code", *[F.round(c, 6).alias(c) for c in ("growth_a", "growth_b", "difference")])


@query(_ALL + " SELECT period, industry_code, source, employment AS employment_level FROM full_panel WHERE source = 'ces_sa' AND revision_number = -1")
def flt22_final_survey_prints(spark, sf_dir):
    final = views.specific_vintage_view(views.final_view(_full_panel(spark, sf_dir)), "ces_sa", -1)
    return final.select("period", "industry_code", "source", "employment_level")


@query(""" , grid AS (SELECT CAST(d AS DATE) AS as_of FROM range(DATE '1997-01-12', DATE '2001-01-12', INTERVAL 6 MONTH) t(d))
SELECT as_of, source, count(*) AS n, sum(employment) AS total, max(ref_date) AS last_ref FROM obs JOIN grid ON vintage_date <= as_of AND ref_date < as_of GROUP BY ALL""")
def jon26_as_of_grid(spark, sf_dir):
    grid = spark.range(1).select(F.explode(F.expr("sequence(date'1997-01-12', date'2000-07-12', interval 6 months)")).alias("as_of"))
    out = censor.as_of_grid(vintage_obs(spark, sf_dir), grid)
    return out.groupBy("as_of", "source").agg(F.count("*").alias("n"), F.sum("employment").alias("total"), F.max("ref_date").alias("last_ref"))


@query(""" SELECT CASE WHEN source = 'ces' THEN (CASE WHEN seasonally_adjusted THEN 'ces_sa' ELSE 'ces_nsa' END) ELSE source END AS tag, CAST(12 * (year(vintage_date) - year(ref_date)) + month(vintage_date) - month(ref_date) AS INT) AS lag_months,
count(*) AS n FROM obs GROUP BY ALL""")
def prj02_tags_and_lags(spark, sf_dir):
    lag = dates.months_between(F.col("vintage_date"), F.col("ref_date"))
    return vintage_obs(spark, sf_dir).groupBy(series.source_tag().alias("tag"), lag.alias("lag_months")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ store maintenance

_SPLIT = """, n1 AS (SELECT * REPLACE (nullif(industry_code, 'BUILDING') AS industry_code, employment + CASE WHEN month(ref_date) = 3 THEN 1 ELSE 0 END AS employment) FROM obs WHERE revision > 0),
o1 AS (SELECT * REPLACE (nullif(industry_code, 'BUILDING') AS industry_code) FROM obs WHERE year(ref_date) < 1999)"""


def _halves(spark, sf_dir):
    """An incoming and a stored part of the rows, with null keys and some changed levels."""
    obs = vintage_obs(spark, sf_dir).withColumn("industry_code", F.nullif("industry_code", F.lit("BUILDING")))
    changed = F.col("employment") + F.when(F.month("ref_date") == 3, 1).otherwise(0)
    return obs.where("revision > 0").withColumn("employment", changed), obs.where(F.year("ref_date") < 1999)


_SAME = " AND ".join(f"n.{c} IS NOT DISTINCT FROM o.{c}" for c in _KEY)


@query(_SPLIT + f" SELECT {', '.join('n.' + c for c in _KEY)}, n.vintage_date, n.employment FROM n1 n WHERE NOT EXISTS (SELECT 1 FROM o1 o WHERE {_SAME})")
def jon06_new_rows(spark, sf_dir):
    incoming, stored = _halves(spark, sf_dir)
    return store.new_rows(incoming, stored, _KEY).select(*_KEY, "vintage_date", "employment")


@query(_SPLIT + f" SELECT {', '.join('n.' + c for c in _KEY)}, n.employment, o.employment AS stored FROM n1 n JOIN o1 o ON {_SAME} WHERE n.employment <> o.employment")
def jon07_drift(spark, sf_dir):
    return store.drift(*_halves(spark, sf_dir), _KEY)


@query(_SPLIT + f""" SELECT {', '.join(_KEY)}, vintage_date, employment FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_KEY)} ORDER BY vintage_date, employment) AS rn
FROM (SELECT * FROM n1 UNION ALL SELECT * FROM o1)) WHERE rn = 1""")
def snk02_compact(spark, sf_dir):
    incoming, stored = _halves(spark, sf_dir)
    return store.compact(incoming.unionByName(stored), _KEY).select(*_KEY, "vintage_date", "employment")


@query(_SPLIT + f""" SELECT {', '.join(f'coalesce(n.{c}, o.{c}) AS {c}' for c in _KEY if c != 'industry_code')}, coalesce(n.industry_code, o.industry_code) AS industry_code, n.employment AS left_value, o.employment AS right_value,
CASE WHEN o.employment IS NULL THEN 'left_only' WHEN n.employment IS NULL THEN 'right_only' WHEN abs(n.employment - o.employment) <= 0.05 THEN 'match' ELSE 'mismatch' END AS status
FROM (SELECT * FROM n1 WHERE industry_code IS NOT NULL) n FULL JOIN (SELECT * FROM o1 WHERE industry_code IS NOT NULL) o ON {_SAME.replace('IS NOT DISTINCT FROM', '=')}""")
def jon15_reconcile(spark, sf_dir):
    a, b = (x.where("industry_code IS NOT NULL") for x in _halves(spark, sf_dir))
    return store.reconcile(a, b, _KEY, "employment", 0.05)


@query(" SELECT source, seasonally_adjusted, count(*) AS n_rows, min(ref_date) AS first_ref, max(ref_date) AS last_ref, max(vintage_date) AS last_vintage, count(DISTINCT vintage_date) AS n_vintages FROM obs GROUP BY ALL")
def agg14_coverage(spark, sf_dir):
    return store.coverage(vintage_obs(spark, sf_dir))


@query(" SELECT coalesce(max(vintage_date), DATE '1900-01-01') AS frontier FROM obs WHERE source = 'ces'")
def agg15_frontier(spark, sf_dir):
    return store.frontier(vintage_obs(spark, sf_dir).where("source = 'ces'"))


@query(""", months AS (SELECT DISTINCT source, industry_code, CAST(date_trunc('month', ref_date) AS DATE) AS month FROM obs WHERE benchmark_revision = 1),
span AS (SELECT source, industry_code, min(month) AS a, max(month) AS b FROM months GROUP BY ALL),
grid AS (SELECT source, industry_code, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM span)
SELECT * FROM grid EXCEPT SELECT * FROM months""")
def set05_month_gaps(spark, sf_dir):
    return store.month_gaps(vintage_obs(spark, sf_dir).where("benchmark_revision = 1"), ["source", "industry_code"])


@query(""", gm AS (SELECT DISTINCT c_nationkey, o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) <> 1995 OR c_nationkey % 4 <> 1),
gs AS (SELECT c_nationkey, o_orderpriority, min(month) AS a, max(month) AS b FROM gm GROUP BY ALL), gg AS (SELECT c_nationkey, o_orderpriority, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM gs)
SELECT * FROM gg EXCEPT SELECT * FROM gm""")
def set05_lost_year(spark, sf_dir):
    """Gaps of nations of which a year has been lost."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kept = orders.where((F.year("o_orderdate") != 1995) | (F.col("c_nationkey") % 4 != 1))
    return store.month_gaps(kept.select("c_nationkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("ref_date")), ["c_nationkey", "o_orderpriority"])


@query()
def snk05_content_hash(spark, sf_dir):
    return store.content_hash(vintage_obs(spark, sf_dir))


@query(" SELECT industry_code, revision, benchmark_revision, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) > 1")
def agg18_duplicates(spark, sf_dir):
    return quality.duplicates(vintage_obs(spark, sf_dir), ["industry_code", "revision", "benchmark_revision"])


# ------------------------------------------------------------------ calendars

_FIRST = """, fp AS (SELECT DISTINCT 'orders' AS publication, month AS ref_date FROM om),
fr0 AS (SELECT *, CAST(ref_date + INTERVAL 1 MONTH AS DATE) AS nx FROM fp),
fr AS (SELECT publication, ref_date, nx + CAST((5 - isodow(nx) + 7) % 7 AS INT) AS fri FROM fr0),
cal0 AS (SELECT publication, ref_date, CASE WHEN (month(fri) = 1 AND day(fri) = 1) OR (month(fri) = 7 AND day(fri) = 4) THEN fri + 7 ELSE fri END AS vintage_date FROM fr)"""
_REVISIONS = _FIRST + """, cal AS (SELECT publication, ref_date, CAST(vintage_date + to_months(n) AS DATE) AS vintage_date, r AS revision, b AS benchmark_revision
FROM cal0, (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (2, 1, 12)) v(r, b, n))"""


def _calendar(spark, sf_dir):
    months = order_months(spark, sf_dir).select(F.lit("orders").alias("publication"), F.col("month").alias("ref_date")).distinct()
    return calendar.monthly_revisions(months.withColumn("vintage_date", dates.first_friday_release(F.col("ref_date"))))


@query(_FIRST + " SELECT ref_date, CAST(vintage_date AS DATE) AS vintage_date FROM cal0")
def scl10_first_friday(spark, sf_dir):
    return order_months(spark, sf_dir).select(F.col("month").alias("ref_date")).distinct().withColumn("vintage_date", dates.first_friday_release(F.col("ref_date")))


@query(_REVISIONS + " SELECT * FROM cal")
def rsh04_revision_calendar(spark, sf_dir):
    return _calendar(spark, sf_dir)


@query(_REVISIONS + " SELECT publication, ref_date, benchmark_revision, max(vintage_date) AS vintage_date, CAST(2 AS INT) AS revision FROM cal GROUP BY ALL")
def top01_latest_lookup(spark, sf_dir):
    return calendar.latest_lookup(_calendar(spark, sf_dir)).select("publication", "ref_date", "benchmark_revision", "vintage_date", "revision")


@query(_REVISIONS + _MONTHLY_SQL + " SELECT c_mktsegment, m.month AS ref_date, m.n, vintage_date, revision, benchmark_revision FROM mon m LEFT JOIN cal ON cal.ref_date = m.month")
def jon02_tag(spark, sf_dir):
    rows = _monthly(spark, sf_dir).select("c_mktsegment", F.col("month").alias("ref_date"), "n")
    return calendar.tag(rows, _calendar(spark, sf_dir), ["ref_date"])


@query(""" SELECT source, seasonally_adjusted, industry_code, ref_date, revision, benchmark_revision FROM (
SELECT *, max(CASE WHEN benchmark_revision >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source, seasonally_adjusted, industry_code, ref_date) AS marked FROM obs)
WHERE NOT (revision = 1 AND benchmark_revision = 0 AND marked = 1)""")
def flt21_reprint_shadows(spark, sf_dir):
    return calendar.drop_reprint_shadows(vintage_obs(spark, sf_dir), ["source", "seasonally_adjusted", "industry_code", "ref_date"]).select(*_KEY)


@query(_REVISIONS + """ SELECT ref_date, vintage_date, revision, benchmark_revision FROM cal WHERE vintage_date <= DATE '2000-06-12'
AND NOT EXISTS (SELECT 1 FROM obs WHERE source = 'ces' AND seasonally_adjusted AND industry_code = 'BUILDING' AND date_trunc('month', obs.ref_date) = cal.ref_date AND obs.revision = cal.revision AND obs.benchmark_revision = cal.benchmark_revision)""")
def set06_uncaptured(spark, sf_dir):
    held = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted AND industry_code = 'BUILDING'")
    held = held.select(dates.month(F.col("ref_date")).alias("ref_date"), "revision", "benchmark_revision")
    return calendar.uncaptured(_calendar(spark, sf_dir), held, _day(_AS_OF)).select("ref_date", "vintage_date", "revision", "benchmark_revision")


@query(_REVISIONS + """ SELECT ref_date, vintage_date, revision, benchmark_revision FROM cal WHERE vintage_date <= DATE '2000-06-12' AND NOT EXISTS (SELECT 1 FROM obs WHERE source = 'ces' AND seasonally_adjusted AND industry_code = 'BUILDING'
AND NOT (month(obs.ref_date) = 3 AND obs.revision = 2) AND date_trunc('month', obs.ref_date) = cal.ref_date AND obs.revision = cal.revision AND obs.benchmark_revision = cal.benchmark_revision)""")
def set06_lost_prints(spark, sf_dir):
    """The same for a store that lost the third and benchmark prints of each March."""
    held = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted AND industry_code = 'BUILDING' AND NOT (month(ref_date) = 3 AND revision = 2)")
    held = held.select(dates.month(F.col("ref_date")).alias("ref_date"), "revision", "benchmark_revision")
    return calendar.uncaptured(_calendar(spark, sf_dir), held, _day(_AS_OF)).select("ref_date", "vintage_date", "revision", "benchmark_revision")


@query(""", qs AS (SELECT DISTINCT CAST(date_trunc('quarter', month) + INTERVAL 2 MONTH AS DATE) AS ref_date FROM om),
lag(q, r, n, z) AS (VALUES (1,0,5,25.0),(1,1,8,20.0),(1,2,14,15.0),(1,3,20,5.0),(1,4,26,1.0),(2,0,5,17.0),(2,1,11,4.0),(2,2,17,1.2),(2,3,23,1.0),(3,0,5,17.0),(3,1,14,4.0),(3,2,20,1.0),(4,0,8,17.0),(4,1,17,1.0))
SELECT ref_date, CAST(r AS INT) AS revision, CAST(ref_date + to_months(CAST(n AS INT)) AS DATE) AS vintage_date, CAST(z AS DOUBLE) AS noise FROM qs JOIN lag ON q = quarter(ref_date)""")
def scl13_quarterly_revisions(spark, sf_dir):
    quarters = order_months(spark, sf_dir).select(F.expr("add_months(trunc(month, 'QUARTER'), 2)").alias("ref_date")).distinct()
    return calendar.quarterly_revisions(quarters)


# ------------------------------------------------------------------ hierarchies

_REGION = ", geo AS (SELECT month, n_name, r_name, count(*) AS level FROM om JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"


@query(_REGION + """ SELECT month, 'region' AS level, r_name AS code, CAST(sum(level) AS BIGINT) AS value FROM geo GROUP BY ALL
UNION ALL SELECT month, 'world' AS level, 'all' AS code, CAST(sum(level) AS BIGINT) AS value FROM geo GROUP BY ALL""")
def agg01_geographic_roll_up(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    states = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = F.explode(F.array(F.struct(F.lit("region").alias("level"), F.col("r_name").alias("code")), F.struct(F.lit("world").alias("level"), F.lit("all").alias("code"))))
    ancestors = states.select(F.col("n_nationkey").alias("member"), pairs.alias("p")).select("member", "p.*")
    counts = order_months(spark, sf_dir).groupBy("month", F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("value"))
    return hierarchy.roll_up(counts, "nation", ancestors, ["month"], "value")


@query(""", pq AS (SELECT p_brand, CAST(year(month) AS INT) AS year, CAST(quarter(month) AS INT) AS qtr, CAST((month(month) - 1) % 3 + 1 AS INT) AS mm, sum(l_quantity) AS q
  FROM lineitem JOIN om ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_brand, make_date(year, (qtr - 1) * 3 + mm, 12) AS ref_date, q / 1000 AS value FROM pq""")
def rsh01_unpivot_months(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(order_months(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    slot = F.concat(F.lit("month"), ((F.month("month") - 1) % 3 + 1).cast("string"), F.lit("_level"))
    columns = ["month1_level", "month2_level", "month3_level"]
    dated = lines.withColumns({"year": F.year("month"), "qtr": F.quarter("month"), "slot": slot})
    wide = dated.groupBy("p_brand", "year", "qtr").pivot("slot", columns).agg(F.sum("l_quantity"))
    return hierarchy.unpivot_months(wide, ["p_brand"], columns, 1000.0)


_PARTS = ", pb AS (SELECT p_brand, p_type, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _part_levels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    leaves = lines.groupBy(F.concat_ws("/", "p_type", "p_brand").alias("leaf"), "p_type").agg(F.sum("l_quantity").cast("long").alias("value"))
    names = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("member"), "p_type").distinct()
    levels = F.array(F.struct(F.lit("brand").alias("level"), F.col("member").alias("code")), F.struct(F.lit("type").alias("level"), F.col("p_type").alias("code")), F.struct(F.lit("total").alias("level"), F.lit("00").alias("code")))
    return leaves, names.select("member", F.explode(levels).alias("x")).select("member", "x.*")


@query(_PARTS + """ SELECT 'brand' AS level, p_type || '/' || p_brand AS code, value FROM pb UNION ALL SELECT 'type', p_type, CAST(sum(value) AS BIGINT) FROM pb GROUP BY ALL
UNION ALL SELECT 'total', '00', CAST(sum(value) AS BIGINT) FROM pb""")
def agg05_hierarchy(spark, sf_dir):
    leaves, ancestors = _part_levels(spark, sf_dir)
    return hierarchy.roll_up(leaves, "leaf", ancestors, [], "value")


@query(_PARTS + """ SELECT 'all' AS series, p_type AS parent, CAST(sum(value) AS BIGINT) AS level, CAST(sum(value) AS BIGINT) AS children, true AS ok FROM pb GROUP BY p_type
UNION ALL SELECT 'all', '00', CAST(sum(value) AS BIGINT), CAST(sum(value) AS BIGINT), true FROM pb""")
def dq06_nesting(spark, sf_dir):
    leaves, ancestors = _part_levels(spark, sf_dir)
    levels = hierarchy.roll_up(leaves, "leaf", ancestors, [], "value").withColumn("series", F.lit("all"))
    names = table(spark, sf_dir, "part").select("p_type", F.concat_ws("/", "p_type", "p_brand").alias("child")).distinct()
    edges = names.select(F.col("p_type").alias("parent"), "child").union(names.select(F.lit("00"), "p_type").distinct())
    return hierarchy.nesting(levels, edges, "code", ["series"], "value", 0.5)


@query(_PARTS + """, pt AS (SELECT p_type, CAST(sum(value) AS BIGINT) AS v, CAST(sum(value) + CASE length(p_type) % 3 WHEN 0 THEN 5 ELSE 0 END AS BIGINT) AS seen FROM pb GROUP BY p_type)
SELECT p_type AS parent, seen AS level, v AS children, seen = v AS ok FROM pt UNION ALL SELECT '00', CAST(sum(v) AS BIGINT), CAST(sum(seen) AS BIGINT), sum(v) = sum(seen) FROM pt""")
def dq06_wrong_parents(spark, sf_dir):
    """Types of which a third stands too high, so that neither their brands nor the total fit."""
    leaves, ancestors = _part_levels(spark, sf_dir)
    off = F.when((F.col("level") == "type") & (F.length("code") % 3 == 0), 5).otherwise(0)
    levels = hierarchy.roll_up(leaves, "leaf", ancestors, [], "value").withColumns({"series": F.lit("all"), "value": F.col("value") + off})
    names = table(spark, sf_dir, "part").select("p_type", F.concat_ws("/", "p_type", "p_brand").alias("child")).distinct()
    edges = names.select(F.col("p_type").alias("parent"), "child").union(names.select(F.lit("00"), "p_type").distinct())
    return hierarchy.nesting(levels, edges, "code", ["series"], "value", 0.5).drop("series")


@query(""", sz AS (SELECT p_type, CAST(least(9, p_size // 6 + 1) AS VARCHAR) AS size_code, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
sch(t, c, m) AS (VALUES ('total','0','123456789'),('small','1','12345'),('small','2','67'),('small','3','89'),('medium','1','1234'),('medium','2','5'),('medium','3','6'),('medium','4','7'),('medium','5','89'))
SELECT p_type, t AS size_class_type, c AS size_class_code, sum(value) AS value FROM sz JOIN sch ON contains(m, size_code) GROUP BY ALL
UNION ALL SELECT p_type, 'large', size_code, value FROM sz""")
def agg07_size_schemes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    native = F.least(F.lit(9), F.floor(F.col("p_size") / 6) + 1).cast("string").alias("size_code")
    return hierarchy.size_schemes(lines.groupBy("p_type", native).agg(F.sum("l_quantity").alias("value")), "size_code", ["p_type"], "value")


# ------------------------------------------------------------------ triangles


@query(""" SELECT industry_code, ref_date, vintage_date, CAST(rn - 1 AS INT) AS revision, value FROM (
SELECT industry_code, ref_date, vintage_date, employment AS value, row_number() OVER (PARTITION BY industry_code, ref_date ORDER BY vintage_date) AS rn, min(vintage_date) OVER (PARTITION BY industry_code, ref_date) AS fv
FROM obs WHERE source = 'ces' AND seasonally_adjusted) WHERE rn <= 3 AND datediff('day', ref_date, fv) <= 70""")
def win04_extract_prints(spark, sf_dir):
    matrix = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted").select("industry_code", "ref_date", "vintage_date", F.col("employment").alias("value"))
    return triangle.extract_prints(matrix, ["industry_code"], 70)


_TRIANGLE = """, tri AS (SELECT industry_code, 12 * year(ref_date) + month(ref_date) AS ref, 12 * year(ref_date) + month(ref_date) + revision AS release, CASE WHEN employment % 7 = 0 THEN NULL ELSE employment END AS value
FROM obs WHERE source = 'ces' AND seasonally_adjusted AND benchmark_revision = 0)"""


@query(_TRIANGLE + """ SELECT industry_code, CAST(ref AS INT) AS ref, CAST(release AS INT) AS release, value, CAST(rv AS INT) AS revision FROM (SELECT *, release - ref AS rv,
sum(CASE WHEN value IS NULL OR release - ref <> rn - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY industry_code, ref ORDER BY release) AS gap FROM (
SELECT *, row_number() OVER (PARTITION BY industry_code, ref ORDER BY release) AS rn FROM tri)) WHERE gap = 0""")
def win14_diagonals(spark, sf_dir):
    obs = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted AND benchmark_revision = 0")
    ref = 12 * F.year("ref_date") + F.month("ref_date")
    value = F.when(F.col("employment") % 7 == 0, None).otherwise(F.col("employment"))
    rows = obs.select("industry_code", ref.alias("ref"), (ref + F.col("revision")).alias("release"), value.alias("value"))
    return triangle.diagonals(rows, ["industry_code"])


_WALK = """, wk AS (SELECT industry_code, CAST(year(ref_date) AS INT) AS ref_year, CAST(month(ref_date) AS INT) AS ref_month, CAST(year(ref_date) + 1 + revision + benchmark_revision AS INT) AS release_year, 1 AS release_month, floor(employment / 50) AS value
FROM obs WHERE source = 'ces' AND seasonally_adjusted)"""


@query(_WALK + """, ch AS (SELECT *, lag(value) OVER (PARTITION BY industry_code, ref_year, ref_month ORDER BY release_year) AS b FROM wk)
SELECT industry_code, ref_year, ref_month, release_year, CAST(value AS DOUBLE) AS value, CAST(row_number() OVER (PARTITION BY industry_code, ref_year, ref_month ORDER BY release_year) AS INT) AS benchmark_revision FROM ch WHERE b IS NULL OR b <> value""")
def win13_benchmark_walk(spark, sf_dir):
    obs = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted")
    rows = obs.select(
        "industry_code", F.year("ref_date").alias("ref_year"), F.month("ref_date").alias("ref_month"),
        (F.year("ref_date") + 1 + F.col("revision") + F.col("benchmark_revision")).alias("release_year"), F.lit(1).alias("release_month"), F.floor(F.col("employment") / 50).cast("double").alias("value"),
    )
    return triangle.benchmark_walk(rows, ["industry_code"]).drop("release_month")


@query(" SELECT source, industry_code, ref_date, arg_min(employment, vintage_date) AS initial, arg_max(employment, vintage_date) AS latest FROM obs WHERE source = 'qcew' GROUP BY ALL")
def win15_first_and_latest(spark, sf_dir):
    long = vintage_obs(spark, sf_dir).where("source = 'qcew'").withColumnRenamed("employment", "value")
    return triangle.first_and_latest(long, ["source", "industry_code", "ref_date"])


# ------------------------------------------------------------------ composites

_EVENTS = ", ev AS (SELECT user_id % 20 AS grp, CAST(ts AS DATE) AS date, event_type FROM events), tg AS (SELECT DISTINCT grp, date FROM ev WHERE event_type = 'view'), wt AS (SELECT DISTINCT grp, date FROM ev WHERE event_type = 'purchase')"


@query(_EVENTS + """, c AS (SELECT grp, date, coalesce((SELECT max(w.date) FROM wt w WHERE w.grp = tg.grp AND w.date <= tg.date), (SELECT min(w.date) FROM wt w WHERE w.grp = tg.grp)) AS weight_date FROM tg)
SELECT grp, date, weight_date, CAST(greatest(0, (year(date) - year(weight_date)) * 12 + month(date) - month(weight_date)) AS INT) AS months_stale FROM c""")
def jon09_carry_forward(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("grp"), F.col("ts").cast("date").alias("date"), "event_type")
    targets, weights = (events.where(F.col("event_type") == k).select("grp", "date").distinct() for k in ("view", "purchase"))
    return composite.carry_forward(targets, weights, ["grp"])


_CELLS = """, cells AS (SELECT r_name || '/' || c_mktsegment AS cell, r_name, c_mktsegment, month, round(sum(o_totalprice), 2) AS value, count(*) AS n
FROM om JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


def _cells(spark, sf_dir):
    geo = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = order_months(spark, sf_dir).join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.concat_ws("/", "r_name", "c_mktsegment").alias("cell"), "r_name", "c_mktsegment", "month").agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").alias("n")
    )


@query(_CELLS + " SELECT cell, month, round(value / sum(value) OVER (PARTITION BY month), 6) AS share FROM cells")
def agg09_shares(spark, sf_dir):
    return composite.shares(_cells(spark, sf_dir), "month", "value").select("cell", "month", F.round("share", 6).alias("share"))


@query(_CELLS + """, s AS (SELECT *, value / sum(value) OVER (PARTITION BY month) AS share, lag(value) OVER w AS pv, lag(n) OVER w AS pn, lag(month) OVER w AS pm FROM cells WINDOW w AS (PARTITION BY cell ORDER BY month))
SELECT month, round(sum(share * (ln(value) - ln(pv))) / sum(share), 6) AS growth, round(sum(share), 6) AS coverage FROM s WHERE n >= 2 AND pn >= 2 AND pm + INTERVAL 1 MONTH = month GROUP BY ALL""")
def agg11_weighted_growth(spark, sf_dir):
    cells = composite.shares(_cells(spark, sf_dir), "month", "value").withColumn("series", F.lit("all"))
    out = composite.weighted_growth(cells, ["series"], "cell", "month", "value", "n", "share", 2)
    return out.select("month", F.round("growth", 6).alias("growth"), F.round("coverage", 6).alias("coverage"))


@query(_CELLS + """, seg AS (SELECT DISTINCT c_mktsegment FROM cells), reg AS (SELECT DISTINCT r_name FROM cells), mo AS (SELECT DISTINCT month FROM cells),
grid AS (SELECT month, r_name, c_mktsegment FROM mo, reg, seg),
f AS (SELECT g.month, g.r_name, g.c_mktsegment, coalesce(value, 0) AS v, coalesce(n, 0) >= 2 AS cov FROM grid g LEFT JOIN cells USING (month, r_name, c_mktsegment)),
w AS (SELECT *, v / sum(v) OVER (PARTITION BY month) AS w0, sum(v) OVER (PARTITION BY month, c_mktsegment) AS sv, sum(CASE WHEN cov THEN v ELSE 0 END) OVER (PARTITION BY month, c_mktsegment) AS cv FROM f),
ok AS (SELECT month FROM w GROUP BY month HAVING min(cv) > 0)
SELECT month, r_name || '/' || c_mktsegment AS cell, round(CASE WHEN cov THEN w0 * sv / cv ELSE 0 END, 6) AS weight FROM w JOIN ok USING (month)""")
def agg10_redistribute(spark, sf_dir):
    """Months in which every segment has a covered region: there the order of cells does not matter."""
    cells = _cells(spark, sf_dir)
    regions, segments = (sorted(r[0] for r in cells.select(c).distinct().collect()) for c in ("r_name", "c_mktsegment"))  # dimensions of a fixed size
    names = [f"{r}/{s}" for r in regions for s in segments]
    one = cells.groupBy("month").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("value", "n")))).alias("m"))
    at = F.array(*map(F.lit, names))
    rows = one.select("month", F.transform(at, lambda c: F.coalesce(F.try_element_at("m", c)["value"], F.lit(0.0))).alias("v"), F.transform(at, lambda c: F.coalesce(F.try_element_at("m", c)["n"], F.lit(0)) >= 2).alias("covered"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    k = len(segments)
    moved = composite.redistribute(F.transform("v", lambda x: x / total), F.col("covered"), [i % k for i in range(len(names))], [i // k for i in range(len(names))])
    whole = F.lit(True)
    for s in range(k):
        got = F.lit(0.0)
        for i in range(s, len(names), k):
            got = got + F.when(F.col("covered")[i], F.col("v")[i]).otherwise(0.0)
        whole = whole & (got > 0)
    out = rows.where(whole).select("month", F.posexplode(moved).alias("i", "weight"))
    return out.select("month", F.element_at(at, F.col("i") + 1).alias("cell"), F.round("weight", 6).alias("weight"))


@query(_MONTHLY_SQL + """, gr AS (SELECT c_mktsegment, month, CASE WHEN n % 5 <> 0 THEN ln(total) - ln(lag(total) OVER (PARTITION BY c_mktsegment ORDER BY month)) END AS growth FROM mon),
s AS (SELECT *, max(CASE WHEN growth IS NOT NULL THEN 1 ELSE 0 END) OVER w AS seen, sum(coalesce(growth, 0)) OVER w AS c FROM gr WINDOW w AS (PARTITION BY c_mktsegment ORDER BY month))
SELECT c_mktsegment, month, round(CASE WHEN seen = 1 THEN 100 * exp(c) END, 4) AS level FROM s""")
def win08_cumulative_index(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment").orderBy("month")
    g = F.when(F.col("n") % 5 != 0, F.ln("total") - F.ln(F.lag("total").over(w)))
    out = composite.cumulative_index(_monthly(spark, sf_dir).withColumn("growth", g), ["c_mktsegment"], "month")
    return out.select("c_mktsegment", "month", F.round("level", 4).alias("level"))


# ------------------------------------------------------------------ evaluation

_FIRST_PRINT = """, fp0 AS (SELECT industry_code, CAST(date_trunc('month', ref_date) AS DATE) AS month, employment AS level, vintage_date FROM obs WHERE source = 'ces' AND seasonally_adjusted AND employment > 0 AND revision = 0 AND benchmark_revision = 0
  QUALIFY row_number() OVER (PARTITION BY industry_code, date_trunc('month', ref_date) ORDER BY vintage_date DESC, employment DESC) = 1),
pr AS (SELECT industry_code, CAST(date_trunc('month', ref_date) AS DATE) AS prior, employment AS p, vintage_date AS pv, revision, benchmark_revision FROM obs WHERE source = 'ces' AND seasonally_adjusted AND employment > 0),
pp AS (SELECT f.*, p, pv, revision, benchmark_revision FROM fp0 f LEFT JOIN pr ON f.industry_code = pr.industry_code AND pr.prior = CAST(f.month - INTERVAL 1 MONTH AS DATE) AND pv <= f.vintage_date + 15),
fc AS (SELECT industry_code, month, vintage_date, level, coalesce(arg_min(p, pv) FILTER (revision = 1 AND benchmark_revision = 0), arg_max(p, benchmark_revision * 1000 + revision)) AS q FROM pp GROUP BY ALL),
fpc AS (SELECT industry_code, month, vintage_date, level - q AS change, ln(level) - ln(q) AS growth FROM fc)"""


def _first_prints(spark, sf_dir):
    return evaluate.first_print_changes(vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted"), ["industry_code"])


@query(_FIRST_PRINT + " SELECT industry_code, month, vintage_date, change, round(growth, 6) AS growth FROM fpc")
def pip06_first_print_changes(spark, sf_dir):
    return _first_prints(spark, sf_dir).withColumn("growth", F.round("growth", 6))


_TARGETS = _FIRST_PRINT + """, tgt AS (SELECT industry_code, month AS target, change AS actual, vintage_date - 7 AS as_of FROM fpc WHERE change IS NOT NULL),
kn AS (SELECT t.industry_code, target, actual, as_of, f.month, f.change, row_number() OVER (PARTITION BY t.industry_code, target ORDER BY f.month DESC) AS rn FROM tgt t JOIN fpc f ON f.industry_code = t.industry_code AND f.vintage_date <= t.as_of AND f.change IS NOT NULL),
pred AS (SELECT industry_code, target, actual, max(CASE WHEN rn = 1 THEN change END) AS rw, avg(CASE WHEN rn <= 12 THEN change END) AS tm FROM kn GROUP BY ALL)"""


def _predictions(spark, sf_dir):
    prints = _first_prints(spark, sf_dir).where("change IS NOT NULL")
    targets = prints.select("industry_code", F.col("month").alias("target"), F.col("change").alias("actual"), F.date_sub("vintage_date", 7).alias("as_of"))
    known = backtest.naive(targets, prints, ["industry_code"], "change").where("rw IS NOT NULL")
    return known.select("industry_code", "target", "actual", "rw", "tm")


@query(_TARGETS + " SELECT industry_code, target, actual, rw, round(tm, 6) AS tm FROM pred")
def win10_competitors(spark, sf_dir):
    return _predictions(spark, sf_dir).withColumn("tm", F.round("tm", 6))


@query(_TARGETS + """, e AS (SELECT industry_code, 'random_walk' AS competitor, rw - actual AS e FROM pred UNION ALL SELECT industry_code, 'trailing_mean', tm - actual FROM pred)
SELECT industry_code, competitor, count(e) AS n, round(avg(e), 6) AS me, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM e GROUP BY ALL""")
def agg21_scoreboard(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    errors = p.select("industry_code", F.expr("stack(2, 'random_walk', rw - actual, 'trailing_mean', tm - actual) AS (competitor, error)"))
    out = evaluate.error_metrics(errors, ["industry_code", "competitor"], "error")
    return out.select("industry_code", "competitor", "n", *[F.round(c, 6).alias(c) for c in ("me", "mae", "rmse")])


@query(_TARGETS + """, m AS (SELECT industry_code, count(*) AS n, avg(tm) AS mx, avg(actual) AS my, covar_pop(actual, tm) AS c, var_pop(tm) AS vx, var_pop(actual) AS vy FROM pred GROUP BY ALL),
b AS (SELECT *, c / vx AS slope, my - c / vx * mx AS icpt, c * c / vx / vy AS r2 FROM m WHERE n > 2 AND vx > 0 AND vy > 0),
w AS (SELECT *, n * (icpt * icpt + 2 * icpt * (slope - 1) * mx + (slope - 1) * (slope - 1) * (vx + mx * mx)) / (vy * (1 - r2) * n / (n - 2)) AS wald FROM b)
SELECT industry_code, n, round(icpt, 4) AS intercept, round(slope, 4) AS slope, round(r2, 4) AS r2, round(wald, 4) AS wald, round(exp(-wald / 2), 4) AS p_value FROM w""")
def agg26_mincer_zarnowitz(spark, sf_dir):
    out = evaluate.mincer_zarnowitz(_predictions(spark, sf_dir), ["industry_code"], "actual", "tm")
    return out.select("industry_code", "n", *[F.round(c, 4).alias(c) for c in ("intercept", "slope", "r2", "wald", "p_value")])


@query(_TARGETS + """, m AS (SELECT industry_code, count(*) AS n, var_samp(actual - rw) AS vm, var_samp(actual - tm) AS vr, covar_samp(actual - rw, actual - tm) AS cov,
  var_pop(rw) AS s11, var_pop(tm) AS s22, var_pop(actual) AS syy, covar_pop(rw, tm) AS s12, covar_pop(rw, actual) AS s1y, covar_pop(tm, actual) AS s2y FROM pred GROUP BY ALL),
k AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS c FROM m WHERE n >= 5),
v AS (SELECT *, greatest(syy - b * s1y - c * s2y, 0) / greatest(n - 3, 1) * s22 / (s11 * s22 - s12 * s12) AS vb FROM k),
x AS (SELECT *, CASE WHEN vb > 0 THEN b * b / vb ELSE 0 END AS wald, CASE WHEN vm + vr - 2 * cov > 0 THEN least(1.0, greatest(0.0, (vr - cov) / (vm + vr - 2 * cov))) ELSE 0.5 END AS w FROM v),
t AS (SELECT *, 1 / (1 + 0.3275911 * sqrt(wald / 2)) AS u FROM x)
SELECT industry_code, n, round(b, 4) AS b, round(c, 4) AS c, round(u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * exp(-wald / 2), 4) AS p_value, round(w, 4) AS weight,
  round(avg(abs(actual - rw)), 4) AS mae_model, round(avg(abs(actual - tm)), 4) AS mae_rival, round(avg(abs(actual - w * rw - (1 - w) * tm)), 4) AS mae_combined
FROM pred JOIN t USING (industry_code) GROUP BY industry_code, n, b, c, u, wald, w""")
def agg27_encompassing(spark, sf_dir):
    out = evaluate.encompassing(_predictions(spark, sf_dir), ["industry_code"], "actual", "rw", "tm")
    return out.select("industry_code", "n", *[F.round(c, 4).alias(c) for c in ("b", "c", "p_value", "weight", "mae_model", "mae_rival", "mae_combined")])


@query(_TARGETS + """, m AS (SELECT industry_code, count(*) AS n, var_samp(actual - rw) AS vm, var_samp(actual - tm) AS vr, covar_samp(actual - rw, actual - tm) AS cov,
  regr_count(actual, rw) AS rc, var_pop(rw) AS s11, var_pop(tm) AS s22, var_pop(actual) AS syy, covar_pop(rw, tm) AS s12, covar_pop(rw, actual) AS s1y, covar_pop(tm, actual) AS s2y FROM pred GROUP BY ALL),
k AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS c, (vr - cov) / (vm + vr - 2 * cov) AS share FROM m),
x AS (SELECT industry_code, n, least(1.0, greatest(0.0, share)) AS w, b * b / (greatest(syy - b * s1y - c * s2y, 0) / greatest(n - 3, 1) * s22 / (s11 * s22 - s12 * s12)) / 2 AS h FROM k WHERE n >= 5),
t AS (SELECT *, 1 / (1 + 0.3275911 * sqrt(h)) AS u FROM x),
q AS (SELECT industry_code, n, w, u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * exp(-h) AS p FROM t),
e AS (SELECT industry_code, q.n, p, w, avg(abs(actual - rw)) AS a, avg(abs(actual - tm)) AS r, avg(abs(actual - w * rw - (1 - w) * tm)) AS mixed FROM pred JOIN q USING (industry_code) GROUP BY ALL)
SELECT m.industry_code, m.n, round(p, 4) AS p_value, round(w, 4) AS weight, coalesce(p < 0.1 AND mixed < least(a, r), false) AS fires, CASE WHEN e.n IS NULL THEN 'insufficient_paired_obs' END AS reason FROM m LEFT JOIN e USING (industry_code)""")
def agg28_combination_gate(spark, sf_dir):
    out = evaluate.combination_gate(_predictions(spark, sf_dir), ["industry_code"], "actual", "rw", "tm")
    return out.withColumns({"p_value": F.round("p_value", 4), "weight": F.round("weight", 4)})


@query(""", d AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS actual FROM events)
SELECT event_type, round(quantile_cont(value, 0.1), 6) AS low, round(quantile_cont(value, 0.9), 6) AS high, first(actual) BETWEEN quantile_cont(value, 0.1) AND quantile_cont(value, 0.9) AS covered FROM d GROUP BY ALL""")
def agg22_interval_coverage(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    means = events.groupBy("event_type").agg(F.avg("value").alias("actual"))
    draws = events.join(F.broadcast(means), "event_type")
    out = evaluate.interval_coverage(draws, ["event_type"], "value", "actual", 0.8)
    return out.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "covered")


@query(""", d AS (SELECT CAST(ts AS DATE) AS day, event_type, value, 10.0 AS actual FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY day, event_type ORDER BY value) AS i FROM d)
SELECT day, event_type, round(avg(abs(value - actual)) - (sum(2 * i * value) - (count(*) + 1) * sum(value)) / (count(*) * count(*)), 6) AS crps FROM r GROUP BY ALL""")
def agg23_crps(spark, sf_dir):
    draws = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "value", F.lit(10.0).alias("actual"))
    return evaluate.crps(draws, ["day", "event_type"], "value", "actual").withColumn("crps", F.round("crps", 6))


@query(_MONTHLY_SQL + """, x AS (SELECT c_mktsegment, month, total, total - lag(total) OVER w AS rev, total - lag(total, 3) OVER w AS mom FROM mon WINDOW w AS (PARTITION BY c_mktsegment ORDER BY month)),
b AS (SELECT c_mktsegment, quantile_cont(abs(rev), 0.9) AS bound, median(abs(rev)) * 2 AS turn FROM x GROUP BY ALL)
SELECT c_mktsegment, month, CASE WHEN abs(rev) >= bound THEN 'large_revision' WHEN abs(mom) / turn >= 1 THEN 'turning_point' WHEN month(month) IN (2) THEN 'benchmark_window' ELSE 'normal' END AS month_type FROM x JOIN b USING (c_mktsegment)""")
def win17_month_types(spark, sf_dir):
    """Momentum is put in units of twice the median change of its segment, so that one bound fits all sizes."""
    w = Window.partitionBy("c_mktsegment").orderBy("month")
    rows = evaluate.momentum(_monthly(spark, sf_dir).withColumn("rev", F.col("total") - F.lag("total").over(w)), ["c_mktsegment"], "total", 3)
    unit = rows.groupBy("c_mktsegment").agg((F.median(F.abs("rev")) * 2).alias("turn"))
    rows = rows.join(unit, "c_mktsegment").withColumn("momentum", F.col("momentum") / F.col("turn"))
    return evaluate.month_types(rows, ["c_mktsegment"], "rev", "momentum", turn_at=1.0).select("c_mktsegment", "month", "month_type")


@query(_MONTHLY_SQL + """ SELECT c_mktsegment, month, round((total - avg(total) OVER (PARTITION BY c_mktsegment)) / stddev_pop(total) OVER (PARTITION BY c_mktsegment), 6) AS z FROM mon""")
def agg13_standardise(spark, sf_dir):
    return evaluate.standardise(_monthly(spark, sf_dir), ["c_mktsegment"], "total").select("c_mktsegment", "month", F.round("z", 6).alias("z"))


@query(_MONTHLY_SQL + ", x AS (SELECT c_mktsegment, month, total - lag(total, 3) OVER (PARTITION BY c_mktsegment ORDER BY month) AS momentum FROM mon) SELECT c_mktsegment, month, round(momentum, 2) AS momentum FROM x")
def win06_momentum(spark, sf_dir):
    return evaluate.momentum(_monthly(spark, sf_dir), ["c_mktsegment"], "total", 3).select("c_mktsegment", "month", F.round("momentum", 2).alias("momentum"))


@query(" SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def agg12_monthly_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", dates.month(F.col("ts").cast("date")).alias("month")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query(""", a AS (SELECT event_type, avg(value) AS ma, stddev_samp(value) AS sa FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT event_type, avg(value) AS mb, stddev_samp(value) AS sb FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT event_type, round((mb - ma) / sqrt((sa * sa + sb * sb) / 2), 6) AS shift, round(sb / sa, 6) AS ratio FROM a JOIN b USING (event_type)""")
def agg35_compare_draws(spark, sf_dir):
    """Two chains of draws: events of even and of odd ids."""
    events = table(spark, sf_dir, "events")
    out = evaluate.compare_draws(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "event_type", "value")
    return out.select("event_type", F.round("shift", 6).alias("shift"), F.round("ratio", 6).alias("ratio"))


@query(_MONTHLY_SQL + """, mm AS (SELECT DISTINCT month, datediff('month', DATE '1996-01-01', month) AS j FROM mon), iv(name, kind, k, rho) AS (VALUES ('a', 'pulse', 1, 0.0), ('b', 'box', 3, 0.0), ('c', 'tc', 1, 0.7))
SELECT month, name, round(CASE WHEN j < 0 THEN 0 WHEN kind = 'pulse' THEN (CASE WHEN j = 0 THEN 1 ELSE 0 END) WHEN kind = 'box' THEN (CASE WHEN j < k THEN 1.0 / k ELSE 0 END)
ELSE (CASE WHEN j = 0 THEN 1 ELSE -(1 - rho) * power(rho, j - 1) END) END, 6) AS basis FROM mm, iv""")
def prj20_interventions(spark, sf_dir):
    kinds = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(kind).alias("kind"), F.lit(k).alias("k"), F.lit(rho).alias("rho")) for n, kind, k, rho in (("a", "pulse", 1, 0.0), ("b", "box", 3, 0.0), ("c", "tc", 1, 0.7))])
    )
    rows = _monthly(spark, sf_dir).select("month").distinct().select("month", kinds.alias("i"))
    j = dates.months_between(F.col("month"), F.lit("1996-01-01").cast("date"))
    return rows.select("month", "i.name", F.round(evaluate.intervention(j, F.col("i.kind"), F.col("i.k"), F.col("i.rho")), 6).alias("basis"))


# ------------------------------------------------------------------ rebuilding and comparing

_NSA = """, fpn0 AS (SELECT industry_code, CAST(date_trunc('month', ref_date) AS DATE) AS month, employment AS level, vintage_date FROM obs WHERE source = 'ces' AND NOT seasonally_adjusted AND employment > 0 AND revision = 0 AND benchmark_revision = 0
  QUALIFY row_number() OVER (PARTITION BY industry_code, date_trunc('month', ref_date) ORDER BY vintage_date DESC, employment DESC) = 1),
prn AS (SELECT industry_code, CAST(date_trunc('month', ref_date) AS DATE) AS prior, employment AS p, vintage_date AS pv, revision, benchmark_revision FROM obs WHERE source = 'ces' AND NOT seasonally_adjusted AND employment > 0),
ppn AS (SELECT f.*, p, pv, revision, benchmark_revision FROM fpn0 f LEFT JOIN prn ON f.industry_code = prn.industry_code AND prn.prior = CAST(f.month - INTERVAL 1 MONTH AS DATE) AND pv <= f.vintage_date + 15),
fcn AS (SELECT industry_code, month, vintage_date, level - coalesce(arg_min(p, pv) FILTER (revision = 1 AND benchmark_revision = 0), arg_max(p, benchmark_revision * 1000 + revision)) AS change FROM ppn GROUP BY industry_code, month, vintage_date, level)"""


@query(_FIRST_PRINT + _NSA + """ SELECT a.industry_code, a.month, a.change AS total, b.change AS part, a.change - b.change AS wedge, abs(datediff('day', a.vintage_date, b.vintage_date)) <= 15 AS same_release
FROM fpc a JOIN fcn b ON a.industry_code = b.industry_code AND a.month = b.month""")
def jon13_wedge(spark, sf_dir):
    other = evaluate.first_print_changes(vintage_obs(spark, sf_dir).where("source = 'ces' AND NOT seasonally_adjusted"), ["industry_code"])
    return rebuild.wedge(_first_prints(spark, sf_dir), other, ["industry_code"])


@query(_FIRST_PRINT + _NSA + """, j AS (SELECT a.industry_code, a.change - b.change AS wedge, b.change AS part FROM fpc a JOIN fcn b ON a.industry_code = b.industry_code AND a.month = b.month),
r AS (SELECT industry_code, avg(wedge - part) AS r_mean, stddev_samp(wedge - part) AS r_std, stddev_samp(wedge) AS wedge_std, greatest(stddev_samp(part), 25.0) AS sd FROM j GROUP BY ALL)
SELECT industry_code, round(r_mean, 4) AS r_mean, round(r_std, 4) AS r_std, round(wedge_std, 4) AS wedge_std, round(r_std / CASE WHEN wedge_std > 0 THEN wedge_std ELSE 1 END, 4) AS r_share, round(sd, 4) AS sd FROM r""")
def agg31_decomposition(spark, sf_dir):
    """The wedge against its part, and the deviation that the part's changes speak for."""
    other = evaluate.first_print_changes(vintage_obs(spark, sf_dir).where("source = 'ces' AND NOT seasonally_adjusted"), ["industry_code"])
    rows = rebuild.wedge(_first_prints(spark, sf_dir), other, ["industry_code"])
    out = evaluate.decomposition_residual(rows, ["industry_code"], "wedge", "part").join(evaluate.intervention_sd(rows, ["industry_code"], "part", 25.0), "industry_code")
    return out.select("industry_code", *[F.round(c, 4).alias(c) for c in ("r_mean", "r_std", "wedge_std", "r_share", "sd")])


@query(_MONTHLY_SQL + " SELECT a.month, CAST(a.n - b.n AS BIGINT) AS implied FROM mon a JOIN mon b ON a.month = b.month AND a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'MACHINERY'")
def jon24_implied_part(spark, sf_dir):
    rows = _monthly(spark, sf_dir).select("c_mktsegment", "month", "n")
    return evaluate.implied_part(rows, "c_mktsegment", "BUILDING", "MACHINERY", ["month"], "n").select("month", F.col("implied").cast("long").alias("implied"))


@query(""", e AS (SELECT CASE WHEN o_orderdate >= DATE '1996-07-01' THEN 2 WHEN o_orderdate >= DATE '1994-01-01' THEN 1 ELSE 0 END AS era FROM orders) SELECT CAST(era AS INT) AS era, count(*) AS n FROM e GROUP BY ALL""")
def prj14_era(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(dates.era(F.col("o_orderdate").cast("date"), ["1994-01-01", "1996-07-01"]).alias("era")).agg(F.count("*").alias("n"))


_SIZED = """, lv AS (SELECT p_type, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
sz AS (SELECT p_type, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(p_size % 3 AS VARCHAR) AS size_class_code, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE month(l_shipdate) <= 3 GROUP BY ALL)"""


@query(_SIZED + """ SELECT s.p_type, s.month, s.size_class_code, CASE WHEN s.size_class_code = '0' THEN l.v ELSE s.v END AS v FROM sz s JOIN lv l ON s.p_type = l.p_type AND s.month = l.month
UNION ALL SELECT p_type, month, NULL, v FROM lv WHERE NOT EXISTS (SELECT 1 FROM sz WHERE sz.p_type = lv.p_type AND sz.month = lv.month)""")
def pip07_compose(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select("p_type", dates.month(F.col("l_shipdate").cast("date")).alias("month"), (F.col("p_size") % 3).cast("string").alias("size_class_code"), "l_quantity")
    levels = lines.groupBy("p_type", "month").agg(F.sum("l_quantity").alias("v"))
    sized = lines.where(F.month("month") <= 3).groupBy("p_type", "month", "size_class_code").agg(F.sum("l_quantity").alias("v"))
    return rebuild.compose(levels, sized, ["p_type", "month"], "v")


@query(_REVISIONS + """ SELECT publication, cal.ref_date, cal.vintage_date, cal.revision, cal.benchmark_revision, industry_code, employment AS value FROM cal JOIN obs ON date_trunc('month', obs.ref_date) = cal.ref_date AND obs.revision = cal.revision
WHERE cal.vintage_date > DATE '1998-06-01' AND cal.vintage_date <= DATE '1999-06-01' AND cal.benchmark_revision = 0 AND source = 'ces' AND seasonally_adjusted AND obs.benchmark_revision = 0""")
def jon23_archive_window(spark, sf_dir):
    prints = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted AND benchmark_revision = 0").withColumnRenamed("employment", "value")
    return rebuild.archive_window(_calendar(spark, sf_dir), prints, ["industry_code"], _day("1998-06-01"), _day("1999-06-01"))


_SETTLED_SQL = ", sl AS (SELECT industry_code, CAST(date_trunc('month', ref_date) AS DATE) AS month, arg_max(employment, vintage_date * 1 ) AS level FROM (SELECT industry_code, ref_date, employment, datediff('day', DATE '1970-01-01', vintage_date) * 10 + revision AS vintage_date FROM obs WHERE source = 'qcew') GROUP BY ALL)"


@query(_SETTLED_SQL + ", c AS (SELECT *, level - lag(level) OVER (PARTITION BY industry_code ORDER BY month) AS change FROM sl) SELECT * FROM c WHERE change IS NOT NULL")
def win07_settled_changes(spark, sf_dir):
    return rebuild.settled_changes(vintage_obs(spark, sf_dir).where("source = 'qcew'"), ["industry_code"])


@query(_MONTHLY_SQL + """, x AS (SELECT *, lag(n) OVER w AS b, lead(n) OVER w AS a, lag(month) OVER w AS bm, lead(month) OVER w AS am FROM mon WINDOW w AS (PARTITION BY c_mktsegment ORDER BY month)),
y AS (SELECT *, CASE WHEN quarter(bm) <> 1 AND datediff('month', bm, month) = 1 THEN b END AS b1, CASE WHEN quarter(am) <> 1 AND datediff('month', month, am) = 1 THEN a END AS a1 FROM x),
z AS (SELECT *, CASE WHEN a1 IS NOT NULL AND b1 IS NOT NULL THEN (a1 + b1) / 2 ELSE coalesce(a1, b1) END AS beside FROM y)
SELECT c_mktsegment, month, n, CAST(beside AS DOUBLE) AS beside, abs(n / beside - 1) <= 0.25 AS ok FROM z WHERE quarter(month) = 1 AND beside IS NOT NULL""")
def win12_quarter_continuity(spark, sf_dir):
    out = rebuild.quarter_continuity(_monthly(spark, sf_dir), ["c_mktsegment"], "n", 0.25)
    return out.select("c_mktsegment", "month", "n", F.col("beside").cast("double").alias("beside"), "ok")


@query(_ALL + """, r AS (SELECT a.industry_code, b.growth - a.growth AS d FROM full_panel a JOIN full_panel b ON a.period = b.period AND a.industry_code = b.industry_code
WHERE a.source = 'ces_sa' AND b.source = 'ces_sa' AND a.revision_number = 0 AND b.revision_number = 2) SELECT industry_code, round(median(d), 6) AS bias, count(*) AS n FROM r GROUP BY ALL""")
def agg24_pooled_bias(spark, sf_dir):
    diff = views.vintage_diff(_full_panel(spark, sf_dir), "ces_sa", 0, 2, ["period", "industry_code"])
    return rebuild.pooled_bias(diff, ["industry_code"], "difference").withColumn("bias", F.round("bias", 6))


@query(_TARGETS + """, s AS (SELECT p.*, sl.level AS best FROM pred p JOIN (SELECT industry_code, CAST(date_trunc('month', ref_date) AS DATE) AS month, sum(employment) AS level FROM obs WHERE source = 'ces' AND seasonally_adjusted AND revision = 2 AND benchmark_revision = 0 GROUP BY ALL) sl
ON p.industry_code = sl.industry_code AND p.target = sl.month)
SELECT industry_code, count(*) AS n, count(*) FILTER (abs(best - actual) > 300) AS n_splice, round(avg(abs(rw - best)), 4) AS mae, round(avg(abs(rw - best)) FILTER (abs(best - actual) <= 300), 4) AS mae_without FROM s GROUP BY ALL""")
def agg37_splice_metrics(spark, sf_dir):
    best = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted AND revision = 2 AND benchmark_revision = 0")
    best = best.groupBy("industry_code", dates.month(F.col("ref_date")).alias("target")).agg(F.sum("employment").alias("best"))
    out = rebuild.splice_metrics(_predictions(spark, sf_dir).join(best, ["industry_code", "target"]), ["industry_code"], "actual", "best", "rw", 300.0)
    return out.withColumns({"mae": F.round("mae", 4), "mae_without": F.round("mae_without", 4)})


@query(""", d AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(round(avg(value / 10000), 10) AS DECIMAL(20, 10)) AS growth FROM events GROUP BY ALL),
i AS (SELECT *, 100 * exp(CAST(sum(growth) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS DOUBLE)) AS idx FROM d)
SELECT event_type, day, round(CAST(growth AS DOUBLE), 6) AS growth, round(idx, 4) AS "index", round(idx - coalesce(lag(idx) OVER (PARTITION BY event_type ORDER BY day), 100), 4) AS change FROM i""")
def agg32_draw_paths(spark, sf_dir):
    draws = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("day"), (F.col("value") / 10000).alias("g"))
    out = rebuild.draw_paths(draws, ["event_type"], "day", "g", 100.0)
    return out.select("event_type", "day", F.round("growth", 6).alias("growth"), F.round("index", 4).alias("index"), F.round("change", 4).alias("change"))


@query(_MONTHLY_SQL + """, c AS (SELECT c_mktsegment, month, n - lag(n) OVER (PARTITION BY c_mktsegment ORDER BY month) AS d FROM mon)
SELECT c_mktsegment, CAST(month(month) AS INT) AS calendar_month, count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM c GROUP BY ALL""")
def agg30_month_profile(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment").orderBy("month")
    changes = _monthly(spark, sf_dir).withColumn("d", F.col("n") - F.lag("n").over(w))
    out = changes.groupBy("c_mktsegment", F.month("month").alias("calendar_month")).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query(_MONTHLY_SQL + """, r AS (SELECT c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY month) - 1 AS INT) AS t, total FROM mon WHERE n > 1), g AS (SELECT DISTINCT c_mktsegment FROM r), x AS (SELECT max(t) AS n FROM r)
SELECT g.c_mktsegment, CAST(i AS INT) AS t, coalesce(total, 0) AS total, total IS NOT NULL AS mask FROM g CROSS JOIN x CROSS JOIN LATERAL (SELECT unnest(range(0, x.n + 1)) AS i) LEFT JOIN r ON r.c_mktsegment = g.c_mktsegment AND r.t = i""")
def rsh12_padding(spark, sf_dir):
    t = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("month")) - 1
    rows = _monthly(spark, sf_dir).where("n > 1").select("c_mktsegment", t.alias("t"), "total")
    return rebuild.pad(rows, ["c_mktsegment"], "t", ["total"])


_REV = _ALL + """, rt0 AS (SELECT industry_code, period, max(growth) FILTER (revision_number = 0) AS f, max(growth) FILTER (revision_number = 2) AS l FROM full_panel WHERE source = 'ces_sa' GROUP BY ALL),
rt AS (SELECT *, l - f AS revision, lag(l - f) OVER (PARTITION BY industry_code ORDER BY period) AS lagged FROM rt0 WHERE f IS NOT NULL AND l IS NOT NULL)"""


def _revisions(spark, sf_dir):
    return evaluate.revision_table(_full_panel(spark, sf_dir).where("source = 'ces_sa'"), ["industry_code"], 0, 2, "growth")


@query(_REV + " SELECT industry_code, period, round(f, 6) AS first, round(l, 6) AS later, round(revision, 6) AS revision, round(lagged, 6) AS lagged FROM rt")
def jon12_revision_table(spark, sf_dir):
    return _revisions(spark, sf_dir).select("industry_code", "period", *[F.round(c, 6).alias(c) for c in ("first", "later", "revision", "lagged")])


@query(_REV + """, m AS (SELECT industry_code, count(*) AS n, avg(revision) AS my, avg(f) AS m1, avg(lagged) AS m2, var_pop(f) AS s11, var_pop(lagged) AS s22, var_pop(revision) AS syy, covar_pop(f, lagged) AS s12, covar_pop(f, revision) AS s1y, covar_pop(lagged, revision) AS s2y
FROM rt WHERE lagged IS NOT NULL GROUP BY ALL), b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m WHERE n > 3)
SELECT industry_code, n, round(my - b1 * m1 - b2 * m2, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round((b1 * s1y + b2 * s2y) / syy, 4) AS r2 FROM b""")
def agg25_revision_regression(spark, sf_dir):
    out = evaluate.ols2(_revisions(spark, sf_dir), ["industry_code"], "revision", "first", "lagged")
    return out.select("industry_code", "n", *[F.round(c, 4).alias(c) for c in ("b0", "b1", "b2", "r2")])


_SETTLED_CHANGES = _FIRST_PRINT + """, sl AS (SELECT industry_code, CAST(date_trunc('month', ref_date) AS DATE) AS month, employment AS level FROM obs WHERE source = 'ces' AND seasonally_adjusted AND benchmark_revision = 0 AND employment > 0
  QUALIFY row_number() OVER (PARTITION BY industry_code, date_trunc('month', ref_date) ORDER BY revision DESC, vintage_date DESC, employment DESC) = 1),
sc AS (SELECT a.industry_code, a.month, a.level - b.level AS settled FROM sl a JOIN sl b ON a.industry_code = b.industry_code AND b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE)),
rt AS (SELECT f.industry_code, f.month, f.vintage_date, change AS first, settled, settled - change AS revision FROM fpc f JOIN sc ON sc.industry_code = f.industry_code AND sc.month = f.month WHERE change IS NOT NULL),
rl AS (SELECT *, lag(revision) OVER (PARTITION BY industry_code ORDER BY month) AS lagged FROM rt)"""
_SETTLED_CHANGES = _SETTLED_CHANGES.replace("FROM obs WHERE source = 'ces' AND seasonally_adjusted AND", "FROM obs WHERE source = 'ces' AND seasonally_adjusted AND NOT (month(ref_date) = 7 AND year(ref_date) % 3 = 0) AND")


def _change_revisions(spark, sf_dir):
    """Revisions of a store that lacks a July in three years."""
    rows = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted AND NOT (month(ref_date) = 7 AND year(ref_date) % 3 = 0)")
    return evaluate.change_revisions(rows, ["industry_code"])


@query(_SETTLED_CHANGES + " SELECT industry_code, month, vintage_date, first, settled, revision, lagged FROM rl")
def jon11_change_revisions(spark, sf_dir):
    return _change_revisions(spark, sf_dir)


_DIAGNOSED = _SETTLED_CHANGES + """, im AS (SELECT c_mktsegment, month, CAST(n - lag(n, 3) OVER (PARTITION BY c_mktsegment ORDER BY month) AS DOUBLE) AS momentum FROM (SELECT c_mktsegment, month, count(*) AS n FROM om GROUP BY ALL)),
dx AS (SELECT rl.*, momentum FROM rl LEFT JOIN im ON c_mktsegment = industry_code AND im.month = rl.month), db AS (SELECT industry_code, quantile_cont(abs(revision), 0.9) AS bound FROM dx GROUP BY ALL),
dk AS (SELECT dx.*, CASE WHEN abs(revision) >= bound THEN 'large_revision' WHEN abs(momentum) >= 25 THEN 'turning_point' WHEN month(month) = 2 THEN 'benchmark_window' ELSE 'normal' END AS k FROM dx JOIN db USING (industry_code)),
de AS (SELECT * REPLACE ('pooled' AS k) FROM dk UNION ALL SELECT * FROM dk), dn AS (SELECT industry_code, k AS month_type, count(*) AS n_months FROM de GROUP BY ALL),
dm AS (SELECT industry_code, k AS month_type, count(*) AS n, avg(revision) AS my, avg(momentum) AS m1, avg(lagged) AS m2, var_pop(momentum) AS s11, var_pop(lagged) AS s22, var_pop(revision) AS syy, covar_pop(momentum, lagged) AS s12, covar_pop(momentum, revision) AS s1y, covar_pop(lagged, revision) AS s2y
  FROM de WHERE momentum IS NOT NULL AND lagged IS NOT NULL GROUP BY ALL),
df AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM dm JOIN dn USING (industry_code, month_type) WHERE month_type = 'pooled' OR n_months > 5),
dr AS (SELECT industry_code, month_type, n, n_months, my - b1 * m1 - b2 * m2 AS bias, (b1 * s1y + b2 * s2y) / syy AS r2 FROM df)"""


def _diagnostics(spark, sf_dir):
    """A regressor of orders, the revision before, and a series that is not there."""
    counts = order_months(spark, sf_dir).groupBy(F.col("c_mktsegment").alias("industry_code"), "month").agg(F.count("*").alias("n"))
    moved = evaluate.momentum(counts, ["industry_code"], "n", 3).select("industry_code", "month", F.col("momentum").cast("double").alias("momentum"))
    rows = _change_revisions(spark, sf_dir).join(moved, ["industry_code", "month"], "left").withColumn("absent", F.lit(None).cast("double"))
    return regression.revision_diagnostics(rows, ["industry_code"], "revision", ["momentum", "absent", "lagged"], "momentum", turn_at=25.0)


@query(_DIAGNOSED + " SELECT industry_code, month_type, n, n_months, round(bias, 4) AS bias, round(r2, 4) AS r2, 'absent' AS missing FROM dr")
def pip13_revision_diagnostics(spark, sf_dir):
    """How far revisions could be foreseen, over all months and by their type."""
    out = _diagnostics(spark, sf_dir)
    return out.select("industry_code", "month_type", "n", "n_months", F.round("bias", 4).alias("bias"), F.round("r2", 4).alias("r2"), F.array_join("missing", ",").alias("missing"))


@query(_DIAGNOSED + """, dg AS (SELECT industry_code, coalesce(max(r2) FILTER (month_type = 'normal'), 0) AS normal, coalesce(max(r2) FILTER (month_type = 'turning_point'), 0) AS turning FROM dr GROUP BY ALL)
SELECT industry_code, n, round(r2, 4) AS pooled, round(bias, 4) AS bias, round(normal, 4) AS normal, round(turning, 4) AS turning_point, normal >= 0.1 AS fund_rebuild, turning - normal >= 0.15 AS fund_turning FROM dr JOIN dg USING (industry_code) WHERE month_type = 'pooled'""")
def pip13_gate(spark, sf_dir):
    out = regression.diagnostics_gate(_diagnostics(spark, sf_dir), ["industry_code"])
    return out.select("industry_code", "n", *[F.round(c, 4).alias(c) for c in ("pooled", "bias", "normal", "turning_point")], "fund_rebuild", "fund_turning")


@query(_TARGETS + """, e AS (SELECT industry_code, tm - rw AS a, rw - actual AS b FROM pred), u AS (SELECT industry_code, 'a' AS component, a AS error FROM e UNION ALL SELECT industry_code, 'b', b FROM e UNION ALL SELECT industry_code, 'total', a + b FROM e)
SELECT industry_code, component, count(error) AS n, round(avg(error), 6) AS me, round(avg(abs(error)), 6) AS mae FROM u GROUP BY ALL""")
def agg34_error_parts(spark, sf_dir):
    p = _predictions(spark, sf_dir).select("industry_code", (F.col("tm") - F.col("rw")).alias("a"), (F.col("rw") - F.col("actual")).alias("b"))
    out = evaluate.decompose(p, ["industry_code"], ["a", "b"])
    return out.withColumns({"me": F.round("me", 6), "mae": F.round("mae", 6)})


def _draws(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").select("event_type", "event_id", "value")
    return evaluate.number_draws(rows, ["event_type"], "event_id").select("event_type", "draw", "value", F.lit(1).alias("series"))


_TOTAL = """, d AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS draw FROM events),
p AS (SELECT draw, 100 * (exp(value / 10000) - 1) * 2 AS value FROM d WHERE event_type = 'view'), w AS (SELECT draw, value FROM d WHERE event_type = 'click'),
c AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM w) AS nw), x AS (SELECT w.draw, p.value AS part, w.value AS wedge FROM w CROSS JOIN c JOIN p ON p.draw = w.draw * np // nw),
tot AS (SELECT draw, part + wedge + 0.5 * (part - (SELECT avg(part) FROM x)) / (SELECT stddev_pop(part) FROM x) AS value FROM x)"""


def _total(spark, sf_dir):
    d = _draws(spark, sf_dir)
    parts = d.where("event_type = 'view'").select("series", "draw", (F.col("value") / 10000).alias("value"))
    return evaluate.assemble_total(parts, d.where("event_type = 'click'").drop("event_type"), ["series"], prev_index=100.0, idx_to_level=2.0, eta=0.5)


@query(_TOTAL + " SELECT draw, round(value, 6) AS value FROM tot")
def agg33_assemble_total(spark, sf_dir):
    """All draws: growth turned into changes, one for each wedge draw, with coupled residuals."""
    return _total(spark, sf_dir).select("draw", F.round("value", 6).alias("value"))


@query(_TOTAL + """, a AS (SELECT value, row_number() OVER (ORDER BY value) AS i FROM tot)
SELECT 1 AS series, round(abs(avg(value) - 50), 6) AS point_err, 50 BETWEEN quantile_cont(value, 0.1) AND quantile_cont(value, 0.9) AS covered,
  round(avg(abs(value - 50)) - (sum(2 * i * value) - (count(*) + 1) * sum(value)) / (count(*) * count(*)), 5) AS crps FROM a""")
def agg33_score_total(spark, sf_dir):
    """The assembled total against a first print of 50."""
    out = evaluate.score_total(_total(spark, sf_dir).withColumn("actual", F.lit(50.0)), ["series"], "value", "actual")
    return out.select("series", F.round("point_err", 6).alias("point_err"), "covered", F.round("crps", 5).alias("crps"))


@query(""", d AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS draw FROM events), p AS (SELECT * FROM d WHERE event_type = 'view'), w AS (SELECT * FROM d WHERE event_type = 'click'),
c AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM w) AS nw) SELECT w.draw, round(p.value + w.value, 6) AS value FROM w CROSS JOIN c JOIN p ON p.draw = w.draw * np // nw""")
def agg33_resample_total(spark, sf_dir):
    """As many draws as there are wedge draws."""
    d = _draws(spark, sf_dir)
    out = evaluate.resample_total(d.where("event_type = 'view'").drop("event_type"), d.where("event_type = 'click'").drop("event_type"), ["series"])
    return out.select("draw", F.round("value", 6).alias("value"))


@query(""", mo AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), g AS (SELECT p_size % 3 AS k, month FROM mo, (SELECT DISTINCT p_size % 3 AS p_size FROM part)),
v AS (SELECT p_size % 3 AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), a AS (SELECT g.k, g.month, q FROM g LEFT JOIN v ON g.k = v.k AND g.month = v.month)
SELECT CAST(k AS INT) AS k, month, round(coalesce((q - avg(q) OVER (PARTITION BY k)) / stddev_pop(q) OVER (PARTITION BY k), 0), 5) AS z FROM a""")
def pip05_indicator(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select((F.col("p_size") % 3).alias("k"), dates.month(F.col("l_shipdate").cast("date")).alias("month"), "l_quantity")
    months = table(spark, sf_dir, "orders").select(dates.month(F.col("o_orderdate").cast("date")).alias("month")).distinct()
    grid = months.withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    return evaluate.indicator(lines, grid, ["k"], "l_quantity").select("k", "month", F.round("z", 5).alias("z"))


@query(""" SELECT n_nationkey, c_mktsegment, adj, 'SM' || adj || rpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '00000' || rpad(left(c_mktsegment, 8), 8, '0') || '01' AS id
FROM nation, (SELECT DISTINCT c_mktsegment FROM customer), (VALUES ('S'), ('U')) a(adj)""")
def rsh13_series_list(spark, sf_dir):
    """All series of three dimensions: states, industries, adjustments."""
    segments = table(spark, sf_dir, "customer").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("s"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey").join(F.broadcast(segments))
    rows = rows.select("n_nationkey", F.explode("s").alias("c_mktsegment")).withColumn("adj", F.explode(F.array(F.lit("S"), F.lit("U"))))
    made = series.build_series_id("SM", seasonal=F.col("adj"), state=F.col("n_nationkey").cast("string"), area=F.lit("00000"), industry=F.substring("c_mktsegment", 1, 8), data_type=F.lit("01"))
    return rows.withColumn("id", made)


# ------------------------------------------------------------------ checks


@query(_PANEL + """ SELECT 'duplicate_key' AS "check", 'error' AS severity, count(*) AS violations FROM (SELECT count(*) OVER (PARTITION BY period, industry_code, source, revision_number) AS c FROM panel) WHERE c > 1
UNION ALL SELECT 'growth_not_finite', 'error', count(*) FROM panel WHERE NOT isfinite(growth) UNION ALL SELECT 'payroll_revised', 'error', 0""")
def dq01_panel_findings(spark, sf_dir):
    return quality.panel_findings(_panel(spark, sf_dir), ["period", "industry_code", "source", "revision_number"])


@query(_KNOWN + _GROWN + _CES + """, s AS (SELECT *, count(*) OVER (PARTITION BY seasonally_adjusted, industry_code, ref_date) AS c, datediff('month', lag(ref_date) OVER (PARTITION BY seasonally_adjusted, industry_code ORDER BY ref_date), ref_date) AS gap FROM f WHERE rn = 1)
SELECT 'duplicate_date' AS "check", 'error' AS severity, count(*) FILTER (c > 1) AS violations FROM s UNION ALL SELECT 'month_gap', 'error', count(*) FILTER (gap > 1) FROM s
UNION ALL SELECT 'level_not_positive', 'error', count(*) FILTER (NOT employment > 0) FROM s UNION ALL SELECT 'growth_not_finite', 'error', count(*) FILTER (NOT isfinite(growth)) FROM s""")
def dq02_selection_findings(spark, sf_dir):
    grown = censor.growth(censor.valid(censor.knowable(vintage_obs(spark, sf_dir), _day(_AS_OF))))
    return quality.selection_findings(censor.select_monthly(grown.where("source = 'ces'")), SERIES)


@query(""", pair AS (SELECT a.industry_code, a.employment / b.employment AS ratio FROM obs a JOIN obs b ON a.industry_code = b.industry_code AND a.ref_date = b.ref_date AND a.revision = b.revision AND a.benchmark_revision = b.benchmark_revision
WHERE a.source = 'qcew' AND b.source = 'ces' AND b.seasonally_adjusted), r AS (SELECT industry_code, median(ratio) - 1 AS residual FROM pair GROUP BY ALL)
SELECT industry_code, round(residual, 6) AS residual, CASE WHEN residual < -0.5 THEN 'collapsed' WHEN abs(residual) <= 0.1 THEN 'ok' ELSE 'outside' END AS status FROM r""")
def agg29_median_residual(spark, sf_dir):
    obs = vintage_obs(spark, sf_dir)
    keys = ["industry_code", "ref_date", "revision", "benchmark_revision"]
    census, survey = (obs.where(c).select(*keys, F.col("employment").alias(n)) for c, n in (("source = 'qcew'", "q"), ("source = 'ces' AND seasonally_adjusted", "s")))
    pairs = census.join(survey, keys).withColumn("ratio", F.col("q") / F.col("s"))
    return quality.median_residual(pairs, ["industry_code"], "ratio", 0.1).withColumn("residual", F.round("residual", 6))


# ------------------------------------------------------------------ texts and identifiers


@query(" SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY ALL")
def src10_json_props(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query(""", h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages) SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS n, unnest(l) AS href FROM h""")
def src19_links(spark, sf_dir):
    return readers.links(table(spark, sf_dir, "pages"), "page_id")


_IDS = ", ids AS (SELECT c_custkey, 'CE' || CASE WHEN c_custkey % 2 = 0 THEN 'S' ELSE 'U' END || rpad(CAST(c_nationkey AS VARCHAR), 8, '0') || '01' AS id FROM customer)"


@query(_IDS + " SELECT c_custkey, id, substr(id, 3, 1) AS seasonal, substr(id, 4, 8) AS industry, substr(id, 12, 2) AS data_type, CAST(NULL AS VARCHAR) AS state FROM ids")
def scl16_series_ids(spark, sf_dir):
    seasonal = F.when(F.col("c_custkey") % 2 == 0, "S").otherwise("U")
    made = series.build_series_id("CE", seasonal=seasonal, industry=F.col("c_nationkey").cast("string"), data_type=F.lit("01"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", made.alias("id"))
    return rows.select("c_custkey", "id", *[series.series_id_field(F.col("id"), n).alias(n) for n in ("seasonal", "industry", "data_type", "state")])


# ------------------------------------------------------------------ jobs with user functions


# the model-data table: one row for each month of the grid, with what each source knew


@query(_PANEL + """, span AS (SELECT min(period) AS a, max(period) AS b FROM panel), grid AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS period FROM span)
SELECT industry_code, g.period, CAST(datediff('month', a, g.period) AS INT) AS t, round(max(growth) FILTER (source = 'ces_sa'), 6) AS g_sa, round(max(growth) FILTER (source = 'ces_nsa'), 6) AS g_nsa,
round(max(growth) FILTER (source = 'qcew'), 6) AS g_census FROM grid g CROSS JOIN span CROSS JOIN (SELECT DISTINCT industry_code FROM panel) i LEFT JOIN panel p USING (period, industry_code) GROUP BY industry_code, g.period, a""")
def rsh09_model_data(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    span = panel.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    grid = span.select("a", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("period"))
    one = lambda s: F.round(F.max(F.when(F.col("source") == s, F.col("growth"))), 6)
    wide = panel.groupBy("industry_code", "period").agg(one("ces_sa").alias("g_sa"), one("ces_nsa").alias("g_nsa"), one("qcew").alias("g_census"))
    full = panel.select("industry_code").distinct().join(F.broadcast(grid))  # industries by months, a stated grid
    full = full.withColumn("t", dates.months_between(F.col("period"), F.col("a"))).drop("a")
    return full.join(wide, ["industry_code", "period"], "left")


_NOISE_SQL = "CASE quarter(period) WHEN 1 THEN [25.0, 20.0, 15.0][revision_number + 1] WHEN 2 THEN [17.0, 4.0, 1.2][revision_number + 1] WHEN 3 THEN [17.0, 4.0, 1.0][revision_number + 1] ELSE coalesce([17.0, 1.0][revision_number + 1], 1.0) END"


@query(_ALL + f""", ap AS (SELECT *, source <> 'qcew' AS sv, CASE WHEN source = 'qcew' AND (period < DATE '{_SETTLED}' OR revision_number = 5 - quarter(period)) THEN 1 ELSE 0 END AS fin FROM full_panel WHERE vintage_date <= DATE '{_AS_OF}'),
ac AS (SELECT *, dense_rank() OVER (PARTITION BY industry_code ORDER BY period) - 1 AS t, min(year(period)) OVER (PARTITION BY industry_code) AS y0 FROM ap),
ab AS (SELECT * FROM ac WHERE NOT sv OR revision_number >= 0 QUALIFY row_number() OVER (PARTITION BY industry_code, source, period ORDER BY fin DESC, revision_number DESC, vintage_date DESC, growth DESC) = 1),
av AS (SELECT *, dense_rank() OVER (PARTITION BY industry_code, sv ORDER BY revision_number) - 1 AS place, 100 * exp(sum(growth) OVER (PARTITION BY industry_code, source ORDER BY period)) AS lv FROM ab)
SELECT industry_code, source, period, CAST(t AS INT) AS t, CAST(month(period) - 1 AS INT) AS month_index, CAST(year(period) - y0 AS INT) AS year_index, CAST(CASE WHEN period >= DATE '1999-01-01' THEN 2 WHEN period >= DATE '1996-07-01' THEN 1 ELSE 0 END AS INT) AS era, round(growth, 6) AS growth, revision_number,
  CASE WHEN sv THEN CAST(place AS INT) END AS vintage_index, CASE WHEN NOT sv THEN month(period) % 3 = 2 END AS interior,
  CASE WHEN NOT sv THEN CAST({_NOISE_SQL} AS DOUBLE) * CASE WHEN month(period) % 3 <> 2 AND period >= DATE '1996-07-01' THEN [5.0, 3.5, 2.0][revision_number + 1] ELSE 1.0 END END AS noise, round(lv, 4) AS level FROM av""")
def pip04_model_rows(spark, sf_dir):
    """What a model of each segment observes, from the prints known on a day."""
    out = model_data.assemble(_full_panel(spark, sf_dir), ["industry_code"], ["1996-07-01", "1999-01-01"], _day(_AS_OF))
    return out.withColumns({"growth": F.round("growth", 6), "level": F.round("level", 4)})


@query(_TARGETS + " SELECT industry_code, target, round(avg(change), 6) AS forecast FROM kn GROUP BY ALL")
def udf05_forecast_fan_out(spark, sf_dir):
    """A forecast function of the user's, applied to what each as-of slice knew."""
    prints = _first_prints(spark, sf_dir).where("change IS NOT NULL")
    targets = prints.select("industry_code", F.col("month").alias("target"), F.date_sub("vintage_date", 7).alias("as_of"))
    known = evaluate.known_history(targets, prints.select("industry_code", "month", "change", "vintage_date"), ["industry_code"])

    def forecast(slice_):
        return slice_[["industry_code", "target"]].head(1).assign(forecast=slice_.change.mean())

    out = known.groupBy("industry_code", "target").applyInPandas(forecast, "industry_code string, target date, forecast double")
    return out.withColumn("forecast", F.round("forecast", 6))


# ------------------------------------------------------------------ streams


def _run_stream(spark: SparkSession, name: str, deliveries: list[DataFrame], keep: Callable[[DataFrame, str, str], None]) -> str:
    """Land deliveries one after the other, run a stream over them to its end, and return the folder of its output.

    Files are as many as the rows' own partitions; a trigger takes as many as the first delivery has.
    """
    folder = new_folder(spark, name)
    first, *later = deliveries
    first.write.parquet(f"{folder}/landing")
    share = max(1, len(spark.read.schema(first.schema).parquet(f"{folder}/landing").inputFiles()))
    for delivery in later:
        delivery.write.mode("append").parquet(f"{folder}/landing")
    arrivals = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", share).parquet(f"{folder}/landing")
    keep(arrivals, folder, f"{folder}/offsets").awaitTermination()
    return folder


@query(_SPLIT + f""" SELECT source, seasonally_adjusted, count(*) AS n, sum(employment) AS total FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_KEY)} ORDER BY vintage_date, employment) AS rn
FROM (SELECT * FROM o1)) WHERE rn = 1 GROUP BY ALL""")
def str03_idempotent_append(spark, sf_dir):
    """Stored rows arrive as a stream, and all of them once more later; the second time nothing is appended."""
    _, stored = _halves(spark, sf_dir)
    rows = conform(stored, VINTAGE, fill=True)

    def run(arrivals, folder, offsets):
        return capture.capture(arrivals, f"{folder}/store", f"{folder}/drift", offsets)

    folder = _run_stream(spark, "append", [rows, rows], run)
    return store.read(spark, f"{folder}/store").groupBy("source", "seasonally_adjusted").agg(F.count("*").alias("n"), F.sum("employment").alias("total"))


@query(""" SELECT event_type, CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS DATE) AS week, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL""")
def str08_windowed_means(spark, sf_dir):
    """Weekly means of the events, which arrive in two deliveries, as a stream; complete once it has ended."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")

    def run(arrivals, folder, offsets):
        means = capture.windowed_means(arrivals, "7 days", "60 days", ["event_type"], "value")

        def write(batch, epoch):
            batch.write.mode("overwrite").parquet(f"{folder}/means")

        return means.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", offsets).trigger(availableNow=True).start()

    early = F.coalesce(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), F.lit(False))
    folder = _run_stream(spark, "means", [events.where(early), events.where(~early)], run)
    out = spark.read.parquet(f"{folder}/means")
    return out.select("event_type", F.col("window.start").cast("date").alias("week"), F.round("mean", 6).alias("mean"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

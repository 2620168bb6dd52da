"""Queries of acquisition jobs: providers, current census files, state series, releases, the state of a store."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import rebuild_queries
from tidemark.dimensions import CURRENT_CODES, GOODS, RANGES, SUPERSECTORS
from tidemark.job_queries import _streamed
from tidemark.operators import census, estimates, provider, store
from tidemark.plans.demo import order_months, vintage_obs
from tidemark.registry import query
from tidemark.sources.readers import table
from tidemark.storage import stored
from tidemark.streaming import capture


def _twelfth(d):
    return F.date_add(F.trunc(d, "MM"), 11)


# ------------------------------------------------------------------ payroll providers

_CELLS = [(str(region), group) for region in range(5) for group in ("A", "B")]
_AXES = "geographic_type string, geographic_code string, industry_type string, industry_code string"

_PLACES = "nation JOIN region ON n_regionkey = r_regionkey"
_COMPOSITE = f""", pr AS (SELECT c_mktsegment AS provider, CAST(r_regionkey * 2 + CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END AS INT) AS k, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 11 DAY AS DATE) AS d, count(*) AS e, count(DISTINCT o_custkey) AS u
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN {_PLACES} ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL),
dt AS (SELECT provider, d, row_number() OVER w AS n, lag(d) OVER w AS pd FROM (SELECT DISTINCT provider, d FROM pr) WINDOW w AS (PARTITION BY provider ORDER BY d)),
cp AS (SELECT CAST(r_regionkey * 2 + l_linenumber % 2 AS INT) AS k, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 11 DAY AS DATE) AS d, l_suppkey % 2 AS rev, sum(l_quantity) AS e
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN {_PLACES} ON c_nationkey = n_nationkey WHERE year(o_orderdate) > 1992 AND quarter(o_orderdate) % 2 = 0 GROUP BY ALL),
cn AS (SELECT d, k, max_by(e, rev) AS e FROM cp GROUP BY ALL), ix AS (SELECT CAST(unnest(range(10)) AS INT) AS k),
ws AS (SELECT x.d, list(coalesce(e, 0) / t ORDER BY ix.k) AS w FROM (SELECT d, sum(e) AS t FROM cn GROUP BY ALL) x CROSS JOIN ix LEFT JOIN cn ON cn.d = x.d AND cn.k = ix.k GROUP BY x.d),
ga AS (SELECT dt.provider, dt.d, n, ix.k, ln(a.e) - ln(b.e) AS g, coalesce(a.u >= 3 AND b.u >= 3, false) AS c FROM dt CROSS JOIN ix LEFT JOIN pr a ON a.provider = dt.provider AND a.d = dt.d AND a.k = ix.k LEFT JOIN pr b ON b.provider = dt.provider AND b.d = dt.pd AND b.k = ix.k),
gl AS (SELECT provider, d, n, list(g ORDER BY k) AS g, list(c ORDER BY k) AS c FROM ga GROUP BY ALL),
sp AS (SELECT provider, min(d) AS a, max(d) AS b FROM dt GROUP BY ALL HAVING count(*) > 1),
wd AS (SELECT gl.provider, gl.d, coalesce(max(ws.d) FILTER (ws.d <= gl.d), min(ws.d)) AS weight_date FROM gl JOIN sp ON sp.provider = gl.provider JOIN ws ON ws.d BETWEEN a AND b GROUP BY ALL),
fo AS (WITH RECURSIVE f AS (SELECT gl.provider, gl.d, 0 AS i, w, c FROM gl JOIN wd ON wd.provider = gl.provider AND wd.d = gl.d JOIN ws ON ws.d = weight_date
  UNION ALL SELECT provider, d, i + 1, CASE WHEN c[i + 1] OR w[i + 1] = 0 OR NOT list_bool_or(c) THEN w ELSE [CASE WHEN j = i THEN 0 WHEN NOT c[j + 1] THEN w[j + 1] WHEN s0 > 0 THEN w[j + 1] + CASE WHEN j % 2 = i % 2 THEN w[i + 1] * w[j + 1] / s0 ELSE 0 END
    WHEN s1 > 0 THEN w[j + 1] + CASE WHEN j // 2 = i // 2 THEN w[i + 1] * w[j + 1] / s1 ELSE 0 END WHEN s2 > 0 THEN w[j + 1] + w[i + 1] * w[j + 1] / s2 ELSE w[j + 1] + w[i + 1] / list_sum([CASE WHEN z THEN 1 ELSE 0 END for z in c]) END for j in range(10)] END, c
    FROM (SELECT *, list_sum([CASE WHEN c[j + 1] AND j % 2 = i % 2 THEN w[j + 1] ELSE 0 END for j in range(10)]) AS s0, list_sum([CASE WHEN c[j + 1] AND j // 2 = i // 2 THEN w[j + 1] ELSE 0 END for j in range(10)]) AS s1,
      list_sum([CASE WHEN c[j + 1] THEN w[j + 1] ELSE 0 END for j in range(10)]) AS s2 FROM f WHERE i < 10)) SELECT * FROM f WHERE i = 10),
gr AS (SELECT gl.provider, gl.d, n, CASE WHEN n = 1 THEN 0 WHEN list_bool_or(gl.c) THEN list_sum([CASE WHEN gl.c[j + 1] THEN fo.w[j + 1] / list_sum(fo.w) * g[j + 1] ELSE 0 END for j in range(10)]) END AS growth FROM gl JOIN fo ON fo.provider = gl.provider AND fo.d = gl.d),
ch AS (SELECT *, 100 * exp(sum(coalesce(growth, 0)) OVER w) AS level, count(*) FILTER (growth IS NULL) OVER w AS broken FROM gr WINDOW w AS (PARTITION BY provider ORDER BY d)),
co AS (SELECT ch.provider, ch.d AS ref_date, level AS employment, weight_date FROM ch JOIN wd ON wd.provider = ch.provider AND wd.d = ch.d WHERE broken = 0)"""


def _provider_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quarterly files of the segments' orders, two of them by cell, and census prints of the cells for every second quarter."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_regionkey").cast("string").alias("region"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    at = F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), 11).alias("ref_date")
    by_cell = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    whole = F.col("c_mktsegment") == "FURNITURE"  # a file without industries
    files = orders.select(
        F.col("c_mktsegment").alias("provider"), F.when(by_cell, "region").otherwise("national").alias("geographic_type"), F.when(by_cell, F.col("region")).otherwise("00").alias("geographic_code"),
        F.when(by_cell, "supersector").when(~whole, "total").alias("industry_type"),
        F.when(by_cell, F.when(F.col("o_orderpriority") < "3", "A").otherwise("B")).when(~whole, F.when(F.col("o_orderstatus") == "F", "00").otherwise("05")).alias("industry_code"), at, "o_custkey",
    )
    keys = [c for c in files.columns if c != "o_custkey"]
    rows = files.groupBy(*keys).agg(F.count("*").cast("double").alias("employment"), F.count_distinct("o_custkey").alias("n_units"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    known = lines.where((F.year("o_orderdate") > 1992) & (F.quarter("o_orderdate") % 2 == 0))
    prints = known.groupBy(F.col("region").alias("geographic_code"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("industry_code"), at, (F.col("l_suppkey") % 2).cast("int").alias("revision")).agg(F.sum("l_quantity").alias("employment"))
    tags = {"source": F.lit("qcew"), "geographic_type": F.lit("region"), "industry_type": F.lit("supersector"), "benchmark_revision": F.lit(0), "vintage_date": F.add_months("ref_date", 6 + 3 * F.col("revision"))}
    return rows, prints.withColumns(tags)


@query(_COMPOSITE + """ SELECT provider, ref_date, round(employment, 4) AS employment, weight_date, CAST(greatest(0, (year(ref_date) - year(weight_date)) * 12 + month(ref_date) - month(weight_date)) AS INT) AS months_stale FROM co""")
def pip03_composite_levels(spark, sf_dir):
    """National levels of the providers that come by cell, and how old their weights are."""
    rows, prints = _provider_tables(spark, sf_dir)
    levels = provider.composite_levels(rows.where("geographic_type = 'region'"), prints, _CELLS, least=3)
    return levels.withColumn("employment", F.round("employment", 4))


@query(_COMPOSITE + """, na AS (SELECT c_mktsegment AS provider, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 11 DAY AS DATE) AS ref_date, CAST(count(*) AS DOUBLE) AS employment FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment = 'FURNITURE' OR (c_mktsegment = 'AUTOMOBILE' AND o_orderstatus = 'F') GROUP BY ALL),
al AS (SELECT *, lag(employment) OVER (PARTITION BY provider ORDER BY ref_date) AS p FROM (SELECT * FROM na UNION ALL SELECT provider, ref_date, employment FROM co))
SELECT lower(provider) AS source, ref_date AS period, 'national' AS geographic_type, '00' AS geographic_code, 'total' AS industry_level, CASE provider WHEN 'FURNITURE' THEN '05' ELSE '00' END AS industry_code, round(ln(employment) - ln(p), 6) AS growth, round(employment, 4) AS employment_level,
  CAST(ref_date + 21 AS DATE) AS vintage_date FROM al WHERE p IS NOT NULL""")
def pip03_provider_panel(spark, sf_dir):
    """Panel rows of all providers that have a slice; one has none and is left out."""
    rows, prints = _provider_tables(spark, sf_dir)
    slices = spark.createDataFrame([(p, "national", "00", "total", "05" if p == "FURNITURE" else "00") for p in ("BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE")], f"provider string, {_AXES}")
    out = provider.panel_rows(rows, slices, prints, _CELLS, least=3)
    return out.select("source", "period", "geographic_type", "geographic_code", "industry_level", "industry_code", F.round("growth", 6).alias("growth"), F.round("employment_level", 4).alias("employment_level"), "vintage_date")


# ------------------------------------------------------------------ current census files


def _values(pairs) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ")"


_SECTOR_OF = _values(({s: s for sectors in SUPERSECTORS.values() for s in sectors} | CURRENT_CODES | RANGES).items())
_ABOVE = _values([(s, up) for up, sectors in SUPERSECTORS.items() for s in sectors] + [(s, "90") for s in ("91", "92", "93")])
_GOODS = ", ".join(f"'{g}'" for g in GOODS)


@query(rebuild_queries._QUARTERS.format(lift=0) + f""", ce AS (SELECT CASE WHEN area_fips = 'US000' THEN 'national' ELSE 'state' END AS gt, CASE WHEN area_fips = 'US000' THEN '00' ELSE left(area_fips, 2) END AS gc, make_date(CAST(y AS INT), CAST((q - 1) * 3 + m AS INT), 1) AS period,
  CASE WHEN own_code = '5' THEN sector ELSE '9' || own_code END AS s, CAST(round(e * 1000) AS BIGINT) AS v FROM cq LEFT JOIN {_SECTOR_OF} so(code, sector) ON industry_code = code WHERE e > 0 AND ((own_code = '5' AND sector IS NOT NULL) OR (own_code IN ('1', '2', '3') AND industry_code = '10'))),
cs AS (SELECT ce.*, up FROM ce JOIN {_ABOVE} ab(sec, up) ON s = sec),
cl2 AS (SELECT gt, gc, period, 'sector' AS level, s AS code, v FROM cs UNION ALL SELECT gt, gc, period, 'supersector', up, v FROM cs UNION ALL SELECT gt, gc, period, 'domain', d, v FROM cs JOIN (VALUES ('00'), ('05'), ('06'), ('07'), ('08')) dm(d)
  ON d = '00' OR (d = '05' AND up <> '90') OR (d = '06' AND up IN ({_GOODS})) OR (d = '07' AND up NOT IN ({_GOODS})) OR (d = '08' AND up NOT IN ({_GOODS}, '90'))),
cg AS (SELECT *, lag(v) OVER (PARTITION BY gt, gc, level, code ORDER BY period) AS p, CASE WHEN quarter(period) = 4 THEN 8 ELSE 5 END AS lag FROM (SELECT gt, gc, period, level, code, CAST(sum(v) AS BIGINT) AS v FROM cl2 GROUP BY ALL))
SELECT gt AS geographic_type, gc AS geographic_code, level AS industry_level, code AS industry_code, period, round(ln(v) - ln(p), 6) AS growth, CAST(v AS DOUBLE) AS employment_level, CAST(period + to_months(CAST(lag AS INT)) AS DATE) AS vintage_date, CAST(lag AS INT) AS publication_lag_months FROM cg WHERE p IS NOT NULL""")
def pip14_current_census(spark, sf_dir):
    """Growth of every industry level of the nation and of states from current files."""
    out = census.current_panel(rebuild_queries._quarters(spark, sf_dir))
    return out.select("geographic_type", "geographic_code", "industry_level", "industry_code", "period", F.round("growth", 6).alias("growth"), "employment_level", "vintage_date", "publication_lag_months")


# ------------------------------------------------------------------ state series and releases

_STATE = """, ra AS (SELECT CASE WHEN o_orderpriority < '2' THEN 'supersector/20' WHEN o_orderpriority < '3' THEN 'sector/41' WHEN o_orderpriority < '4' THEN 'sector/42' WHEN o_orderpriority < '5' THEN 'supersector/50' ELSE 'domain/06' END AS ind, o_orderstatus = 'F' AS adj,
  lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS geographic_code, CAST(date_trunc('month', o_orderdate) + INTERVAL 11 DAY AS DATE) AS ref_date, count(*) AS a, count(DISTINCT o_custkey) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
rp AS (SELECT *, CAST(0 AS INT) AS revision, CASE WHEN a % 7 <> 0 THEN a END AS v FROM ra UNION ALL SELECT *, 1, CASE WHEN month(ref_date) % 5 <> 0 THEN b END FROM ra),
rd AS (SELECT rp.*, CAST(ref_date + to_months(CAST(n AS INT)) AS DATE) AS vintage_date, CAST(bm AS INT) AS benchmark_revision FROM rp JOIN (VALUES (0, 0, 1), (1, 0, 2), (1, 1, 13)) c(r, bm, n) ON r = revision WHERE v IS NOT NULL AND month(ref_date) <> 6 AND (bm = 0 OR month(ref_date) = 12)),
st AS (SELECT 'sae' AS source, adj AS seasonally_adjusted, 'state' AS geographic_type, geographic_code, split_part(t, '/', 1) AS industry_type, split_part(t, '/', 2) AS industry_code, ref_date, vintage_date, revision, benchmark_revision, CAST(v AS DOUBLE) AS employment
  FROM rd JOIN (VALUES ('supersector/20', 'supersector/20'), ('supersector/20', 'sector/23'), ('sector/41', 'sector/42'), ('sector/42', 'sector/44'), ('supersector/50', 'supersector/50'), ('supersector/50', 'sector/51'), ('domain/06', 'domain/06')) z(f, t) ON f = ind)"""


def _state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.element_at(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in (("supersector", "20"), ("sector", "41"), ("sector", "42"), ("supersector", "50"), ("domain", "06"))]), F.substring("o_orderpriority", 1, 1).cast("int"))
    date = _twelfth(F.col("o_orderdate").cast("date")).alias("ref_date")
    counted = orders.groupBy((F.col("o_orderstatus") == "F").alias("adjusted"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("geographic_code"), kind["t"].alias("industry_type"), kind["c"].alias("industry_code"), date)
    counted = counted.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    series = counted.withColumns({"employment_initial": F.when(F.col("n") % 7 != 0, F.col("n")), "employment_latest": F.when(F.month("ref_date") % 5 != 0, F.col("customers"))})
    months = orders.select(date).distinct().where(F.month("ref_date") != 6)
    prints = F.array(*[F.struct(F.lit(r).alias("revision"), F.lit(b).alias("benchmark_revision"), F.lit(k).alias("n")) for r, b, k in ((0, 0, 1), (1, 0, 2), (1, 1, 13))])
    calendar = months.withColumn("p", F.explode(prints)).where("p.benchmark_revision = 0 OR month(ref_date) = 12")
    calendar = calendar.select(F.lit("sae").alias("publication"), "ref_date", F.expr("add_months(ref_date, p.n)").alias("vintage_date"), "p.revision", "p.benchmark_revision")
    return estimates.state_rows(series.withColumn("geographic_type", F.lit("state")), calendar)


@query(_STATE + " SELECT * FROM st")
def pip10_state_rows(spark, sf_dir):
    """State series of an initial and a latest level as store rows."""
    return _state_rows(spark, sf_dir)


_RELEASES = """, cu AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN '00' WHEN 'MACHINERY' THEN '05' WHEN 'FURNITURE' THEN '06' WHEN 'AUTOMOBILE' THEN '20' ELSE '30' END AS code, CAST(month + INTERVAL 11 DAY AS DATE) AS ref_date, count(*) AS v FROM om GROUP BY ALL),
cc AS (SELECT ref_date, CAST(r AS INT) AS revision, CAST(bm AS INT) AS benchmark_revision, CAST(ref_date + to_months(CAST(CASE WHEN bm = 1 THEN 14 - month(ref_date) ELSE n END AS INT)) AS DATE) AS vintage_date FROM (SELECT DISTINCT ref_date FROM cu WHERE month(ref_date) <> 4), (VALUES (0, 0, 1), (1, 0, 2), (2, 0, 3), (2, 1, 0)) p(r, bm, n)),
ck AS (SELECT * FROM cc WHERE vintage_date <= DATE '1998-02-20' QUALIFY row_number() OVER (PARTITION BY ref_date, benchmark_revision ORDER BY vintage_date DESC, revision DESC) = 1),
cv AS (SELECT * FROM (SELECT *, max(benchmark_revision) OVER (PARTITION BY ref_date) AS mb FROM ck) WHERE NOT (revision = 1 AND benchmark_revision = 0 AND mb = 1)),
re AS (SELECT 'ces' AS source, adj AS seasonally_adjusted, 'national' AS geographic_type, '00' AS geographic_code, CASE WHEN code = '00' THEN 'national' WHEN code IN ('05', '06') THEN 'domain' ELSE 'supersector' END AS industry_type, code AS industry_code, cu.ref_date, vintage_date, revision, benchmark_revision, CAST(v + lift AS DOUBLE) AS employment
  FROM cu CROSS JOIN (VALUES (true, 5), (false, 0)) a(adj, lift) LEFT JOIN cv ON cv.ref_date = cu.ref_date)"""


@query(_STATE + _RELEASES + """ SELECT * FROM re UNION ALL SELECT * FROM st UNION ALL SELECT 'qcew', NULL, 'national', '00', 'supersector', industry_code, ref_date, NULL, NULL, NULL, sum(employment) FROM obs WHERE source = 'qcew' GROUP BY industry_code, ref_date""")
def pip08_releases(spark, sf_dir):
    """Current survey levels dated by a calendar that ends on a benchmark day, state rows, and census sums without a print."""
    levels, calendar = _survey(spark, sf_dir)
    survey = estimates.survey_releases(levels, calendar.where("vintage_date <= '1998-02-20'"))
    plain = vintage_obs(spark, sf_dir).where("source = 'qcew'").groupBy("source", "geographic_type", "geographic_code", "industry_type", "industry_code", "ref_date").agg(F.sum("employment").alias("employment"))
    return estimates.combine(survey, _state_rows(spark, sf_dir), plain)


@query(_RELEASES + """ SELECT CASE WHEN industry_code IN ('00', '05') THEN 'total' ELSE industry_type END AS industry_type, industry_code, CASE WHEN industry_code = '00' THEN 'total' ELSE 'private' END AS ownership, seasonally_adjusted, ref_date, vintage_date, revision, benchmark_revision,
  employment + CASE WHEN month(ref_date) = 3 AND ref_date >= DATE '1997-06-01' THEN 1 ELSE 0 END AS employment FROM re WHERE industry_code <> '30' AND vintage_date IS NOT NULL""")
def str04_survey_capture(spark, sf_dir):
    """The store after three deliveries of current levels: of older months, of all with other levels in each March, and the same again."""
    levels, calendar = _survey(spark, sf_dir)
    levels = levels.withColumn("code", F.when(F.col("code") == "30", "07").otherwise(F.col("code")))  # not on the stored axes
    levels, calendar = stored(levels.withColumn("value", F.col("value").cast("double")), "levels"), stored(calendar.where("vintage_date <= '1998-02-20'"), "calendar")
    changed = levels.withColumn("value", F.col("value") + F.when(F.month("ref_date") == 3, 1).otherwise(0))

    def start(arrivals, folder):
        return capture.capture_survey(arrivals, calendar, f"{folder}/store", folder, f"{folder}/offsets", datetime.date(1998, 2, 20))

    folder = _streamed(spark, [levels.where("ref_date < '1997-06-01'"), changed, changed], start)
    return store.read(spark, f"{folder}/store").select("industry_type", "industry_code", "ownership", "seasonally_adjusted", "ref_date", "vintage_date", "revision", "benchmark_revision", "employment")


def _survey(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current levels of both adjustments by survey code, and a calendar whose benchmark prints come each February; it lacks Aprils."""
    codes = {"BUILDING": "00", "MACHINERY": "05", "FURNITURE": "06", "AUTOMOBILE": "20"}
    code = F.coalesce(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("c_mktsegment")], F.lit("30")).alias("code")
    levels = order_months(spark, sf_dir).groupBy(code, _twelfth(F.col("month")).alias("ref_date")).agg(F.count("*").alias("n"))
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("seasonally_adjusted"), F.lit(k).alias("lift")) for a, k in ((True, 5), (False, 0))]))
    levels = levels.withColumn("a", both).select("code", "a.seasonally_adjusted", "ref_date", (F.col("n") + F.col("a.lift")).alias("value"))
    months = order_months(spark, sf_dir).select(_twelfth(F.col("month")).alias("ref_date")).distinct().where(F.month("ref_date") != 4)
    prints = F.array(*[F.struct(F.lit(r).alias("revision"), F.lit(b).alias("benchmark_revision"), n.alias("n")) for r, b, n in ((0, 0, F.lit(1)), (1, 0, F.lit(2)), (2, 0, F.lit(3)), (2, 1, 14 - F.month("ref_date")))])
    calendar = months.withColumn("p", F.explode(prints)).select(F.lit("ces").alias("publication"), "ref_date", F.expr("add_months(ref_date, p.n)").alias("vintage_date"), "p.revision", "p.benchmark_revision")
    return levels, calendar


# ------------------------------------------------------------------ the state of a store

_HELD = """, he AS (SELECT * REPLACE (CASE WHEN industry_code = 'BUILDING' THEN '00' ELSE industry_code END AS industry_code) FROM obs WHERE ref_date < DATE '1997-05-01' AND NOT (source = 'ces' AND seasonally_adjusted AND industry_code = 'BUILDING' AND month(ref_date) % 6 = 4)),
cv AS (SELECT source, seasonally_adjusted, count(*) AS n_rows, min(ref_date) AS first_ref, max(ref_date) AS last_ref, max(vintage_date) AS last_vintage, count(DISTINCT vintage_date) AS n_vintages FROM he GROUP BY ALL),
um AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', last_ref) + INTERVAL 1 MONTH AS DATE), DATE '1998-02-07', INTERVAL 1 MONTH)) AS DATE) AS d0 FROM cv WHERE source = 'ces' AND seasonally_adjusted),
uf AS (SELECT d0, CAST(nx + CAST((5 - isodow(nx) + 7) % 7 AS INT) AS DATE) AS fr FROM (SELECT d0, CAST(d0 + INTERVAL 1 MONTH AS DATE) AS nx FROM um)),
uq AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('quarter', last_ref) + INTERVAL 3 MONTH AS DATE), DATE '1998-02-07', INTERVAL 3 MONTH)) AS DATE) AS d0 FROM cv WHERE source = 'qcew'),
hm AS (SELECT DISTINCT CAST(date_trunc('month', ref_date) AS DATE) AS m FROM he WHERE source = 'ces' AND seasonally_adjusted AND industry_code = '00'), hg AS (SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM hm)"""


@query(_HELD + """ SELECT 'coverage' AS kind, source, seasonally_adjusted, NULL AS token, n_rows, first_ref, last_ref, last_vintage, n_vintages FROM cv
UNION ALL SELECT 'uncaptured', 'ces', true, 'ces:' || CAST(d0 AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM uf WHERE CASE WHEN (month(fr) = 1 AND day(fr) = 1) OR (month(fr) = 7 AND day(fr) = 4) THEN fr + 7 ELSE fr END <= DATE '1998-02-07'
UNION ALL SELECT 'uncaptured', 'qcew', false, 'qcew:' || year(d0) || '-Q' || quarter(d0), NULL, NULL, NULL, NULL, NULL FROM uq WHERE d0 + to_months(CAST(2 + CASE WHEN quarter(d0) = 4 THEN 8 ELSE 5 END AS INT)) <= DATE '1998-02-07'
UNION ALL SELECT 'missing', 'ces', true, strftime(m, '%Y-%m') || CASE WHEN strftime(m, '%Y-%m') IN ('1993-10', '1994-04') THEN ' [known-shutdown]' ELSE '' END, NULL, NULL, NULL, NULL, NULL FROM hg WHERE m NOT IN (SELECT m FROM hm)""")
def dq14_store_status(spark, sf_dir):
    """A store that ends in April 1997 and lacks two months of each year in its headline, seen in February 1998."""
    lost = (F.col("source") == "ces") & F.col("seasonally_adjusted") & (F.col("industry_code") == "BUILDING") & (F.month("ref_date") % 6 == 4)
    held = vintage_obs(spark, sf_dir).where((F.col("ref_date") < "1997-05-01") & ~lost)
    named = held.withColumn("industry_code", F.when(F.col("industry_code") == "BUILDING", "00").otherwise(F.col("industry_code")))
    return store.status(named, F.lit("1998-02-07").cast("date"), shutdown=("1993-10", "1994-04"))

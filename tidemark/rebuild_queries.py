"""Queries of the rebuild: gates, industry axes, census levels, providers, model features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import dimensions
from tidemark.operators import calendar, census, gates, model_data, provider
from tidemark.plans.demo import vintage_obs
from tidemark.registry import query
from tidemark.schemas import VINTAGE, conform
from tidemark.sources.readers import table

# ------------------------------------------------------------------ gates

_SIDES = """, existing AS (SELECT * FROM obs WHERE source = 'ces' AND NOT (industry_code = 'MACHINERY' AND month(ref_date) = 5)),
rebuilt AS (SELECT * REPLACE (employment + CASE WHEN industry_code = 'BUILDING' AND month(ref_date) = 3 THEN 2.0 ELSE 0.0 END AS employment) FROM obs
  WHERE source = 'ces' AND NOT (industry_code = 'FURNITURE' AND (benchmark_revision = 1 OR month(ref_date) = 12)))"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(vintage_obs(spark, sf_dir), VINTAGE, fill=True)


def _existing(rows: DataFrame) -> DataFrame:
    return rows.where("source = 'ces' AND NOT (industry_code = 'MACHINERY' AND month(ref_date) = 5)")


def _rebuilt(rows: DataFrame) -> DataFrame:
    """A rebuild with faults: a segment is too high in each March, another lacks benchmark prints and Decembers."""
    kept = rows.where("source = 'ces' AND NOT (industry_code = 'FURNITURE' AND (benchmark_revision = 1 OR month(ref_date) = 12))")
    return kept.withColumn("employment", F.expr("employment + CASE WHEN industry_code = 'BUILDING' AND month(ref_date) = 3 THEN 2.0D ELSE 0.0D END"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("industry_code")).distinct()
    return rows.select(F.lit("supersector").alias("industry_type"), "industry_code", F.lit(None).cast("string").alias("ownership"))


@query(_SIDES + """, r AS (SELECT * FROM rebuilt WHERE NOT seasonally_adjusted AND ref_date < DATE '1998-01-01'), e AS (SELECT * FROM existing WHERE NOT seasonally_adjusted AND ref_date < DATE '1998-01-01'),
m AS (SELECT r.revision, r.benchmark_revision, abs(r.employment - e.employment) > 0.5 + 1e-6 * abs(e.employment) AS bad FROM r JOIN e USING (industry_code, ref_date, revision, benchmark_revision)
  WHERE r.benchmark_revision = 0 OR r.vintage_date = e.vintage_date),
need AS (SELECT DISTINCT c_mktsegment AS industry_code, v.r AS revision, v.b AS benchmark_revision FROM customer, (VALUES (0, 0), (1, 0), (2, 0), (2, 1)) v(r, b))
SELECT 'cohort_missing' AS "check", 'hard' AS severity, count(*) AS violations FROM need n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.industry_code = n.industry_code AND r.revision = n.revision AND r.benchmark_revision = n.benchmark_revision)
UNION ALL SELECT 'no_overlap', 'hard', CAST(count(*) = 0 AS BIGINT) FROM m
UNION ALL SELECT 'first_prints_differ', 'hard', count(*) FILTER (bad AND benchmark_revision = 0 AND revision < 2) FROM m
UNION ALL SELECT 'benchmark_prints_differ', 'soft', count(*) FILTER (bad AND NOT (benchmark_revision = 0 AND revision < 2)) FROM m""")
def dq03_history_gate(spark, sf_dir):
    rows = _stored(spark, sf_dir)
    return gates.history(_rebuilt(rows), _existing(rows), _segments(spark, sf_dir), F.lit("1998-01-01").cast("date"))


_FULL = """ SELECT 'side_empty' AS "check", 'hard' AS severity, CAST((count(a) = 0 OR count(b) = 0) AS BIGINT) AS violations FROM m
UNION ALL SELECT 'values_differ', 'hard', count(*) FILTER (abs(a - b) > {tol}) FROM m
UNION ALL SELECT 'only_rebuilt', 'soft', count(*) FILTER (b IS NULL) FROM m UNION ALL SELECT 'only_reference', 'soft', count(*) FILTER (a IS NULL) FROM m"""


@query(_SIDES + """, m AS (SELECT r.employment AS a, e.employment AS b FROM rebuilt r FULL JOIN existing e
  ON r.seasonally_adjusted = e.seasonally_adjusted AND r.industry_code = e.industry_code AND r.ref_date = e.ref_date AND r.revision = e.revision AND r.benchmark_revision = e.benchmark_revision AND r.vintage_date = e.vintage_date)"""
       + _FULL.format(tol=0.5))
def dq04_survey_fidelity(spark, sf_dir):
    rows = _stored(spark, sf_dir)
    return gates.fidelity(_rebuilt(rows), _existing(rows), [*gates.PRINT, "vintage_date", "seasonally_adjusted"], 0.5)


@query(""", q AS (SELECT * FROM obs WHERE source = 'qcew'), m AS (SELECT r.a, e.b FROM (SELECT *, employment + CASE WHEN month(ref_date) = 6 THEN 0.1 ELSE 0.01 END AS a FROM q WHERE revision <> 1) r
  FULL JOIN (SELECT *, employment AS b FROM q WHERE industry_code <> 'MACHINERY') e ON r.industry_code = e.industry_code AND r.ref_date = e.ref_date AND r.revision = e.revision AND r.benchmark_revision = e.benchmark_revision)"""
       + _FULL.format(tol=0.05))
def dq08_census_fidelity(spark, sf_dir):
    rows = _stored(spark, sf_dir).where("source = 'qcew'")
    rebuilt = rows.where("revision <> 1").withColumn("employment", F.expr("employment + CASE WHEN month(ref_date) = 6 THEN 0.1D ELSE 0.01D END"))
    return gates.fidelity(rebuilt, rows.where("industry_code <> 'MACHINERY'"), gates.PRINT, 0.05)


@query(_SIDES + """, r AS (SELECT * FROM rebuilt WHERE NOT seasonally_adjusted), need AS (SELECT DISTINCT c_mktsegment AS industry_code, l AS "check" FROM customer, (VALUES ('frontier'), ('december_1996'), ('december_1997')) v(l)),
held AS (SELECT DISTINCT industry_code, 'frontier' AS "check" FROM r WHERE ref_date = DATE '1997-12-12' UNION
  SELECT DISTINCT industry_code, 'december_' || year(ref_date) FROM r WHERE revision = 2 AND benchmark_revision = 1 AND month(ref_date) = 12 AND year(ref_date) IN (1996, 1997))
SELECT n."check", 'hard' AS severity, count(*) FILTER (h.industry_code IS NULL) AS violations FROM need n LEFT JOIN held h ON n.industry_code = h.industry_code AND n."check" = h."check" GROUP BY ALL""")
def dq05_gap_fill(spark, sf_dir):
    return gates.gap_fill(_rebuilt(_stored(spark, sf_dir)), _segments(spark, sf_dir), "1997-12-12", [1996, 1997])


@query(""", g AS (SELECT industry_code, ref_date, count(*) AS n, count(*) FILTER (employment < 30) AS bad, count(DISTINCT vintage_date) AS v FROM obs WHERE source = 'ces' AND seasonally_adjusted AND (benchmark_revision = 1 OR month(ref_date) = 1) GROUP BY ALL)
SELECT 'slice_empty' AS "check", 'hard' AS severity, CAST(count(*) = 0 AS BIGINT) AS violations FROM g UNION ALL SELECT 'duplicate_key', 'hard', count(*) FILTER (n > 1) FROM g
UNION ALL SELECT 'mixed_vintages', 'hard', count(*) FILTER (v > 1) FROM g UNION ALL SELECT 'level_not_positive', 'hard', CAST(coalesce(sum(bad), 0) AS BIGINT) FROM g""")
def dq10_vintage_integrity(spark, sf_dir):
    """A slice with several prints of each January; levels below 30 are set to null."""
    rows = _stored(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted AND (benchmark_revision = 1 OR month(ref_date) = 1)")
    return gates.integrity(rows.withColumn("employment", F.when(F.col("employment") >= 30, F.col("employment"))), [*gates.SERIES_ID, "seasonally_adjusted", "ref_date"])


@query(_SIDES + """ SELECT r.industry_code, r.ref_date, r.revision, e.employment AS bootstrap_employment, r.employment AS capture_employment, abs(r.employment - e.employment) AS abs_diff
FROM rebuilt r JOIN existing e USING (industry_code, ref_date, revision, benchmark_revision) WHERE r.seasonally_adjusted AND e.seasonally_adjusted AND benchmark_revision = 0 AND revision IN (0, 1) AND r.employment > 0 AND e.employment > 0""")
def dq15_overlap_divergence(spark, sf_dir):
    rows = _stored(spark, sf_dir).where("seasonally_adjusted")
    out = gates.overlap_divergence(_existing(rows), _rebuilt(rows))
    return out.select("industry_code", "ref_date", "revision", "bootstrap_employment", "capture_employment", "abs_diff")


_LATE = """, late AS (SELECT * REPLACE (CASE WHEN revision = 1 OR (benchmark_revision = 1 AND month(ref_date) = 2) THEN CAST(vintage_date + 1 AS DATE) ELSE vintage_date END AS vintage_date) FROM existing WHERE NOT seasonally_adjusted)"""


@query(_SIDES + _LATE + """ SELECT industry_code, ref_date, revision, benchmark_revision, r.employment, l.employment AS existing FROM (SELECT * FROM rebuilt WHERE NOT seasonally_adjusted) r JOIN late l
USING (industry_code, ref_date, revision, benchmark_revision) WHERE NOT (revision = 2 AND benchmark_revision = 1) OR r.vintage_date = l.vintage_date""")
def jon16_cohort_match(spark, sf_dir):
    """The existing side has second prints and February's benchmarks a day late: only the latter fail to match."""
    rows = _stored(spark, sf_dir).where("NOT seasonally_adjusted")
    late = F.expr("CASE WHEN revision = 1 OR (benchmark_revision = 1 AND month(ref_date) = 2) THEN date_add(vintage_date, 1) ELSE vintage_date END")
    out = gates.cohort_match(_rebuilt(rows), _existing(rows).withColumn("vintage_date", late))
    return out.select("industry_code", "ref_date", "revision", "benchmark_revision", "employment", "existing")


@query(""", a AS (SELECT industry_code, ref_date, employment FROM obs WHERE source = 'qcew' AND revision = 0), b AS (SELECT industry_code, ref_date, employment FROM obs WHERE source = 'ces' AND NOT seasonally_adjusted AND revision = 0)
SELECT a.industry_code, b.industry_code AS other_code, a.ref_date, a.employment, b.employment AS other, round(a.employment / b.employment - 1, 6) AS residual FROM a JOIN b ON a.ref_date = b.ref_date
AND ((a.industry_code = 'BUILDING' AND b.industry_code = 'BUILDING') OR (a.industry_code = 'MACHINERY' AND b.industry_code = 'FURNITURE'))""")
def jon17_mapped_residual(spark, sf_dir):
    rows = _stored(spark, sf_dir).where("revision = 0")
    mapping = spark.createDataFrame(
        [("supersector", "BUILDING", "supersector", "BUILDING"), ("supersector", "MACHINERY", "supersector", "FURNITURE")],
        "industry_type string, industry_code string, other_type string, other_code string",
    )
    out = gates.mapped_residual(rows.where("source = 'qcew'"), rows.where("source = 'ces' AND NOT seasonally_adjusted"), mapping, ["geographic_type", "geographic_code", "ref_date"], "employment")
    return out.select("industry_code", "other_code", "ref_date", "employment", "other", F.round("residual", 6).alias("residual"))


@query("""  SELECT industry_code, ref_date, revision, employment FROM obs WHERE source = 'ces' AND seasonally_adjusted AND benchmark_revision = 0 AND employment < 60
QUALIFY row_number() OVER (PARTITION BY industry_code ORDER BY ref_date, revision) <= 5""")
def top15_violation_samples(spark, sf_dir):
    """The first five low levels of each segment; the limit is the report's."""
    rows = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted AND benchmark_revision = 0 AND employment < 60")
    return gates.samples(rows, ["industry_code"], ["ref_date", "revision"], 5).select("industry_code", "ref_date", "revision", "employment")


# ------------------------------------------------------------------ industry axes

_CODED = """, coded AS (SELECT CASE WHEN p_size = 1 THEN 'national' WHEN p_size <= 9 THEN 'domain' WHEN l_linestatus = 'F' THEN 'sector' ELSE 'supersector' END AS industry_type,
  lpad(CAST(p_size - 1 AS VARCHAR), 2, '0') AS industry_code, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.expr("CASE WHEN p_size = 1 THEN 'national' WHEN p_size <= 9 THEN 'domain' WHEN l_linestatus = 'F' THEN 'sector' ELSE 'supersector' END")
    return lines.select(kind.alias("industry_type"), F.lpad((F.col("p_size") - 1).cast("string"), 2, "0").alias("industry_code"), "l_quantity")


_AXES = """ax AS (SELECT CASE WHEN industry_type = 'national' OR (industry_type = 'domain' AND industry_code = '05') THEN 'total' ELSE industry_type END AS t, industry_code AS c, l_quantity FROM coded),
own AS (SELECT *, CASE WHEN t = 'total' AND c = '00' THEN 'total' WHEN t = 'total' AND c = '05' THEN 'private' WHEN t = 'domain' AND c IN ('06', '08') THEN 'private'
  WHEN t = 'supersector' AND c IN ('10', '20', '30', '40', '50', '55', '60', '65', '70', '80') THEN 'private'
  WHEN t = 'sector' AND c IN ('11', '21', '22', '23', '31', '32', '42', '44', '48', '51', '52', '53', '54', '55', '56', '61', '62', '71', '72', '81') THEN 'private' END AS ownership FROM ax)"""


@query(_CODED + ", " + _AXES + " SELECT t AS industry_type, c AS industry_code, ownership, count(*) AS n, sum(l_quantity) AS quantity FROM own WHERE ownership IS NOT NULL GROUP BY ALL")
def prj07_stored_axes(spark, sf_dir):
    return dimensions.remap(_coded(spark, sf_dir)).groupBy("industry_type", "industry_code", "ownership").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(_CODED + ", " + _AXES + " SELECT t AS industry_type, c AS industry_code, count(*) AS n FROM own WHERE ownership IS NULL GROUP BY ALL")
def jon25_unknown_industries(spark, sf_dir):
    return dimensions.unknown(_coded(spark, sf_dir)).groupBy("industry_type", "industry_code").agg(F.count("*").alias("n"))


@query(_CODED + """, rec AS (SELECT industry_type, CASE WHEN industry_type = 'sector' THEN CASE industry_code WHEN '41' THEN '42' WHEN '42' THEN '44' WHEN '43' THEN '48' ELSE industry_code END ELSE industry_code END AS industry_code, l_quantity FROM coded
  UNION ALL SELECT 'sector', CASE industry_code WHEN '20' THEN '23' WHEN '50' THEN '51' ELSE '81' END, l_quantity FROM coded WHERE industry_type = 'supersector' AND industry_code IN ('20', '50', '80'))
SELECT industry_type, industry_code, count(*) AS n, sum(l_quantity) AS quantity FROM rec GROUP BY ALL""")
def prj09_recode(spark, sf_dir):
    return dimensions.recode(_coded(spark, sf_dir)).groupBy("industry_type", "industry_code").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(""" SELECT CAST(year(o_orderdate) + 19 AS INT) AS year, CAST(CASE year(o_orderdate) + 19 WHEN 2014 THEN 105 WHEN 2015 THEN -259 WHEN 2016 THEN -151 WHEN 2017 THEN 136 WHEN 2018 THEN -43 WHEN 2019 THEN -505 END AS INT) AS benchmark,
year(o_orderdate) + 19 BETWEEN 2009 AND 2025 AS benchmark_known, count(*) AS n FROM orders GROUP BY ALL""")
def agg36_benchmarks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") + 19).alias("year")).agg(F.count("*").alias("n"))
    return dimensions.with_benchmark(rows, "year").select("year", "benchmark", "benchmark_known", "n")


# ------------------------------------------------------------------ census levels

_CENSUS = """, cen AS (SELECT CASE WHEN c_nationkey = 0 THEN 'US000' ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '000' END AS area_fips,
  CASE WHEN l_linenumber = 1 THEN '0' WHEN l_linenumber = 2 THEN CAST(1 + l_partkey % 3 AS VARCHAR) ELSE '5' END AS own_code,
  CASE WHEN l_linenumber = 1 THEN '10' WHEN l_linenumber = 2 THEN '11' WHEN l_linenumber <= 4 THEN '14' WHEN l_linenumber <= 6 THEN '55' ELSE '18' END AS agglvl_code,
  CASE WHEN l_linenumber <= 2 THEN '10' WHEN l_linenumber <= 4 THEN CASE WHEN p_size = 34 THEN '44-45' ELSE CAST(p_size + 10 AS VARCHAR) END ELSE CAST(310 + p_size % 30 AS VARCHAR) END AS industry_code,
  CASE WHEN l_suppkey % 7 = 0 THEN 'N' WHEN l_suppkey % 7 = 1 THEN '-' END AS disclosure_code, CAST(p_size % 9 + 1 AS VARCHAR) AS size_code, CAST(date_trunc('month', o_orderdate) AS DATE) AS ref_date, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
st AS (SELECT *, CASE WHEN own_code = '0' THEN '00' WHEN own_code IN ('1', '2', '3') THEN '9' || own_code WHEN agglvl_code = '14' AND industry_code = '44-45' THEN '44' WHEN agglvl_code = '14' AND industry_code <> '31' THEN industry_code
  WHEN agglvl_code = '55' AND industry_code IN ('321', '327', '331', '332', '333', '334', '335', '336', '337', '339') THEN '31'
  WHEN agglvl_code = '55' AND industry_code IN ('311', '312', '313', '314', '315', '316', '322', '323', '324', '325', '326') THEN '32' END AS s FROM cen WHERE {where}),
up AS (SELECT *, CASE WHEN s = '21' THEN '10' WHEN s = '23' THEN '20' WHEN s IN ('31', '32') AND agglvl_code = '55' THEN '30' WHEN s IN ('22', '42', '44', '48') THEN '40' WHEN s = '51' THEN '50' WHEN s IN ('52', '53') THEN '55' WHEN s IN ('54', '55', '56') THEN '60'
  WHEN s IN ('61', '62') THEN '65' WHEN s IN ('71', '72') THEN '70' WHEN s = '81' THEN '80' WHEN own_code IN ('1', '2', '3') THEN '90' END AS ss FROM st),
lv AS (SELECT *, 'national' AS t, '00' AS c FROM up WHERE own_code = '0' UNION ALL SELECT *, 'sector', s FROM up WHERE ss IS NOT NULL UNION ALL SELECT *, 'supersector', ss FROM up WHERE ss IS NOT NULL
  UNION ALL SELECT *, 'domain', '05' FROM up WHERE ss <> '90' UNION ALL SELECT *, 'domain', '06' FROM up WHERE ss IN ('10', '20', '30') UNION ALL SELECT *, 'domain', '07' FROM up WHERE ss NOT IN ('10', '20', '30')
  UNION ALL SELECT *, 'domain', '08' FROM up WHERE ss NOT IN ('10', '20', '30', '90'))
SELECT CASE WHEN area_fips = 'US000' THEN 'national' ELSE 'state' END AS geographic_type, CASE WHEN area_fips = 'US000' THEN '00' ELSE left(area_fips, 2) END AS geographic_code, t AS industry_type, c AS industry_code, {by}, sum(l_quantity) AS l_quantity FROM lv GROUP BY ALL"""


def _census(spark: SparkSession, sf_dir: str, lift: int = 0) -> DataFrame:
    """Lines as census rows: owner and aggregation level by line number, industry by size; levels of size files lie ``lift`` higher."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line, size = F.col("l_linenumber"), F.col("p_size")
    area = F.when(F.col("c_nationkey") == 0, "US000").otherwise(F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("000")))
    own = F.when(line == 1, "0").when(line == 2, (1 + F.col("l_partkey") % 3).cast("string")).otherwise("5")
    level = F.when(line == 1, 10).when(line == 2, 11).when(line <= 4, 14).when(line <= 6, 55).otherwise(18)
    two, three = F.when(size == 34, "44-45").otherwise((size + 10).cast("string")), (310 + size % 30).cast("string")
    return lines.select(
        area.alias("area_fips"), own.alias("own_code"), (level + lift).cast("string").alias("agglvl_code"),
        F.when(line <= 2, "10").when(line <= 4, two).otherwise(three).alias("industry_code"),
        F.when(F.col("l_suppkey") % 7 == 0, "N").when(F.col("l_suppkey") % 7 == 1, "-").alias("disclosure_code"),
        (size % 9 + 1).cast("string").alias("size_code"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("ref_date"), "l_quantity",
    )


@query(_CENSUS.format(where="true", by="ref_date"))
def flt11_census_levels(spark, sf_dir):
    return census.levels(_census(spark, sf_dir), ["ref_date"], "l_quantity")


_QUARTERS = """, cl AS (SELECT CASE WHEN c_nationkey <= 12 THEN 'US000' ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '000' END AS area_fips, CASE WHEN l_linenumber = 1 THEN '0' WHEN l_linenumber = 2 AND l_partkey % 2 = 0 THEN '3' ELSE '5' END AS own_code,
  CASE WHEN l_linenumber = 1 THEN 10 WHEN l_linenumber = 2 THEN 11 WHEN l_linenumber = 3 THEN 13 WHEN l_linenumber = 4 THEN 14 WHEN l_linenumber <= 6 THEN 15 ELSE 16 END AS lv,
  CASE WHEN l_linenumber <= 2 THEN '10' WHEN l_linenumber = 3 THEN CASE WHEN p_size % 10 < 3 THEN '101' || (1 + p_size % 10) ELSE '102' || (p_size % 10 - 2) END WHEN l_linenumber = 4 THEN CASE WHEN p_size = 34 THEN '44-45' ELSE CAST(p_size + 10 AS VARCHAR) END
    WHEN l_linenumber <= 6 THEN CAST(310 + p_size % 30 AS VARCHAR) ELSE CAST(1132 + p_size % 2 AS VARCHAR) END AS industry_code, CASE WHEN l_suppkey % 7 = 0 THEN 'N' WHEN l_suppkey % 7 = 1 THEN '-' END AS disclosure_code,
  CAST(p_size % 9 + 1 AS VARCHAR) AS size_code, year(o_orderdate) AS y, quarter(o_orderdate) AS q, (month(o_orderdate) - 1) % 3 + 1 AS m, l_quantity, CAST(l_partkey % 2 AS INT) AS revision
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
cq AS (SELECT area_fips, own_code, lv, industry_code, disclosure_code, size_code, y, q, m, revision, CASE WHEN CAST(sum(l_quantity) AS BIGINT) % 10 = 0 THEN 0 ELSE CAST(sum(l_quantity) AS BIGINT) END / 1000.0 AS e FROM cl GROUP BY ALL),
cm AS (SELECT *, CAST(lv + {lift} AS VARCHAR) AS agglvl_code, make_date(CAST(y AS INT), CAST((q - 1) * 3 + m AS INT), 12) AS ref_date FROM cq)"""
_MADE_SQL = "(VALUES (1, [5, 8, 14, 20, 26]), (2, [5, 11, 17, 23]), (3, [5, 14, 20]), (4, [8, 17])) lags(q, l)"
_VINTAGE_SQL = "CAST(date_trunc('month', date_trunc('quarter', ref_date) + to_months(CAST(2 + l[{r} + 1] AS INT))) AS DATE) AS vintage_date"


def _quarters(spark: SparkSession, sf_dir: str, lift: int = 0) -> DataFrame:
    """Lines as landed quarters: text in the month columns, zeros where a sum ends in 0, nothing where no line is."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line, size = F.col("l_linenumber"), F.col("p_size")
    three = F.when(size % 10 < 3, F.concat(F.lit("101"), 1 + size % 10)).otherwise(F.concat(F.lit("102"), size % 10 - 2))
    code = F.when(line <= 2, "10").when(line == 3, three).when(line == 4, F.when(size == 34, "44-45").otherwise((size + 10).cast("string")))
    code = code.when(line <= 6, (310 + size % 30).cast("string")).otherwise((1132 + size % 2).cast("string"))
    month = (F.month("o_orderdate") - 1) % 3 + 1
    cell = [
        F.when(F.col("c_nationkey") <= 12, "US000").otherwise(F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("000"))).alias("area_fips"),
        F.when(line == 1, "0").when((line == 2) & (F.col("l_partkey") % 2 == 0), "3").otherwise("5").alias("own_code"),
        (F.when(line == 1, 10).when(line == 2, 11).when(line == 3, 13).when(line == 4, 14).when(line <= 6, 15).otherwise(16) + lift).cast("string").alias("agglvl_code"), code.alias("industry_code"),
        F.when(F.col("l_suppkey") % 7 == 0, "N").when(F.col("l_suppkey") % 7 == 1, "-").alias("disclosure_code"), (size % 9 + 1).cast("string").alias("size_code"),
        F.year("o_orderdate").cast("string").alias("year"), F.quarter("o_orderdate").cast("string").alias("qtr"), (F.col("l_partkey") % 2).cast("int").alias("revision"),
    ]
    total = lambda m: F.sum(F.when(month == m, F.col("l_quantity"))).cast("long")
    text = lambda m: F.when(total(m) % 10 == 0, F.lit("0")).otherwise(total(m).cast("string")).alias(f"month{m}_emplvl")
    return lines.groupBy(*cell).agg(*[text(m) for m in (1, 2, 3)])


_TREE_SQL = """, tr AS (SELECT cm.*, CASE WHEN agglvl_code = '16' AND industry_code = '1133' THEN '11' WHEN agglvl_code = '14' AND industry_code = '44-45' THEN '44' WHEN agglvl_code = '14' AND industry_code IN ('21', '22', '23', '42', '51', '52', '53', '54', '55', '56', '61', '62', '71', '72', '81') THEN industry_code
  WHEN agglvl_code = '14' AND industry_code IN ('11', '31', '32', '44', '48') THEN NULL
  WHEN agglvl_code = '15' AND industry_code IN ('321', '327', '331', '332', '333', '334', '335', '336', '337', '339') THEN '31' WHEN agglvl_code = '15' AND industry_code IN ('311', '312', '313', '314', '315', '316', '322', '323', '324', '325', '326') THEN '32' END AS s,
  CASE WHEN agglvl_code = '13' THEN CASE industry_code WHEN '1012' THEN '20' WHEN '1013' THEN '30' WHEN '1021' THEN '40' WHEN '1022' THEN '50' WHEN '1023' THEN '55' WHEN '1024' THEN '60' WHEN '1025' THEN '65' WHEN '1026' THEN '70' WHEN '1027' THEN '80' END
  WHEN (agglvl_code = '16' AND industry_code = '1133') OR (agglvl_code = '14' AND industry_code = '21') THEN '10' END AS ss FROM cm WHERE {where}),
tl AS (SELECT tr.*, 'sector' AS t, s AS c, 'private' AS ownership FROM tr WHERE own_code = '5' AND s IS NOT NULL UNION ALL SELECT tr.*, 'supersector', ss, 'private' FROM tr WHERE own_code = '5' AND ss IS NOT NULL
  UNION ALL SELECT tr.*, 'domain', CASE WHEN ss IN ('10', '20', '30') THEN '06' ELSE '08' END, 'private' FROM tr WHERE own_code = '5' AND ss IS NOT NULL UNION ALL SELECT tr.*, 'total', '05', 'private' FROM tr WHERE own_code = '5' AND ss IS NOT NULL
  UNION ALL SELECT tr.*, 'total', '00', 'total' FROM tr WHERE own_code = '0' AND agglvl_code = '10' AND industry_code = '10')"""


@query(_QUARTERS.format(lift=0) + ", cen AS (SELECT *, e AS l_quantity FROM cm WHERE e > 0)" + _CENSUS.split("lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)")[1].format(where="true", by="ref_date")
       .replace("agglvl_code = '55'", "agglvl_code = '15'").replace("SELECT CASE WHEN area_fips", ", r AS (SELECT CASE WHEN area_fips", 1).replace("FROM lv GROUP BY ALL", "FROM lv GROUP BY ALL)")
       + f" SELECT geographic_type, geographic_code, industry_type, industry_code, ref_date, {_VINTAGE_SQL.format(r=0)}, CAST(0 AS INT) AS revision, CAST(0 AS INT) AS benchmark_revision, 'qcew' AS source, false AS seasonally_adjusted, round(l_quantity, 6) AS employment FROM r JOIN {_MADE_SQL} ON quarter(ref_date) = q")
def agg06_census_bulk(spark, sf_dir):
    """Landed quarters of all areas as first prints; months of 0 and without a number give no row."""
    return census.bulk_rows(_quarters(spark, sf_dir)).withColumn("employment", F.round("employment", 6))


_PANEL_ROWS = " SELECT 'national' AS geographic_type, '00' AS geographic_code, ownership, t AS industry_type, c AS industry_code, ref_date, {more} {vintage}, CAST({r} AS INT) AS revision, CAST(0 AS INT) AS benchmark_revision, 'qcew' AS source, false AS seasonally_adjusted, round(sum(e), 6) AS employment FROM tl JOIN {lags} ON quarter(ref_date) = lags.q GROUP BY ALL"


@query(_QUARTERS.format(lift=0) + _TREE_SQL.format(where="area_fips = 'US000'") + _PANEL_ROWS.format(more="", vintage=_VINTAGE_SQL.format(r="revision"), r="revision", lags=_MADE_SQL))
def agg04_census_panel(spark, sf_dir):
    return census.panel(_quarters(spark, sf_dir)).withColumn("employment", F.round("employment", 6))


@query(_QUARTERS.format(lift=0) + _TREE_SQL.format(where="q = 1 AND (disclosure_code IS NULL OR disclosure_code <> 'N')") + _PANEL_ROWS.format(more="size_code,", vintage=_VINTAGE_SQL.format(r=0), r=0, lags=_MADE_SQL) .replace("FROM tl JOIN", "FROM (SELECT * FROM tl WHERE own_code = '5') tl JOIN"))
def agg08_census_sizes(spark, sf_dir):
    """First quarters of a size file that holds each cell a second time, forty levels higher."""
    cells = _quarters(spark, sf_dir, 10).where("qtr = '1'")
    again = cells.withColumn("agglvl_code", (F.col("agglvl_code").cast("int") + 40).cast("string"))
    return census.size_rows(cells.unionByName(again)).withColumn("employment", F.round("employment", 6))


@query(_CENSUS.split(",\nst AS")[0] + " SELECT own_code, disclosure_code, count(*) AS n FROM cen GROUP BY ALL")
def agg17_disclosure_counts(spark, sf_dir):
    return census.disclosure_counts(_census(spark, sf_dir), ("own_code",))


# ------------------------------------------------------------------ providers

_PAYROLL = """, pay AS (SELECT r_name AS provider, CASE WHEN r_regionkey % 2 = 0 THEN 'region' ELSE 'national' END AS geographic_type, CAST(date_trunc('month', o_orderdate) + 11 * INTERVAL 1 DAY AS DATE) AS ref_date, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS DOUBLE) AS employment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE month(o_orderdate) <> 8 GROUP BY ALL)"""


def _payroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders by region and month; Augusts are missing."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("r_regionkey") % 2 == 0, "region").otherwise("national").alias("geographic_type")
    date = F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "MM"), 11).alias("ref_date")
    return rows.where(F.month("o_orderdate") != 8).groupBy(F.col("r_name").alias("provider"), kind, date).agg(F.count_if(F.col("o_orderstatus") != "F").cast("double").alias("employment"))


@query(_PAYROLL + """, b AS (SELECT *, lag(employment) OVER (PARTITION BY provider ORDER BY ref_date) AS p FROM pay), g AS (SELECT *, CAST(ref_date + 21 AS DATE) AS v FROM b WHERE p > 0 AND employment > 0)
SELECT provider, ref_date AS period, round(ln(employment) - ln(p), 6) AS growth, employment AS employment_level, v AS vintage_date, 'payroll' AS source_type, CAST(0 AS INT) AS revision_number, true AS is_final, CAST((year(v) - year(ref_date)) * 12 + month(v) - month(ref_date) AS INT) AS publication_lag_months FROM g""")
def pip03_provider_growth(spark, sf_dir):
    return provider.growth_rows(_payroll(spark, sf_dir), ["provider"]).withColumn("growth", F.round("growth", 6))


@query(_PAYROLL + " SELECT provider, bool_or(geographic_type = 'region') AS cell_level, count(*) AS n FROM pay GROUP BY ALL")
def flt23_cell_level(spark, sf_dir):
    return provider.with_cell_level(_payroll(spark, sf_dir), "provider").groupBy("provider", "cell_level").agg(F.count("*").alias("n"))


@query(_PAYROLL + """, bi AS (SELECT CAST(date_trunc('month', o_orderdate) + 11 * INTERVAL 1 DAY AS DATE) AS ref_date, round(count(*) / 1000.0, 4) AS birth_rate FROM orders WHERE month(o_orderdate) % 2 = 0 GROUP BY ALL)
SELECT provider, pay.ref_date, employment, birth_rate FROM pay LEFT JOIN bi ON pay.ref_date = bi.ref_date""")
def jon22_births(spark, sf_dir):
    date = F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "MM"), 11).alias("ref_date")
    births = table(spark, sf_dir, "orders").where(F.month("o_orderdate") % 2 == 0).groupBy(date).agg(F.round(F.count("*") / 1000.0, 4).alias("birth_rate"))
    return provider.with_births(_payroll(spark, sf_dir), births).select("provider", "ref_date", "employment", "birth_rate")


# ------------------------------------------------------------------ model features

_BREAKS = ["1996-07-01", "1999-01-01"]
_ERA = "CAST(CASE WHEN {d} >= DATE '1999-01-01' THEN 2 WHEN {d} >= DATE '1996-07-01' THEN 1 ELSE 0 END AS INT)"


@query(", f AS (SELECT industry_code, ref_date, min(year(ref_date)) OVER (PARTITION BY industry_code) AS y0 FROM (SELECT DISTINCT industry_code, ref_date FROM obs WHERE source = 'ces')) SELECT industry_code, ref_date, CAST(month(ref_date) - 1 AS INT) AS month_index, CAST(year(ref_date) - y0 AS INT) AS year_index, "
       + _ERA.format(d="ref_date") + " AS era FROM f")
def prj15_calendar_features(spark, sf_dir):
    months = vintage_obs(spark, sf_dir).where("source = 'ces'").select("industry_code", "ref_date").distinct()
    return model_data.features(months, "ref_date", ["industry_code"], _BREAKS)


_NOISE = """, n AS (SELECT *, CASE WHEN source = 'ces' THEN (CASE WHEN seasonally_adjusted THEN 'ces_sa' ELSE 'ces_nsa' END) ELSE source END AS src, CAST(CASE WHEN source = 'ces' AND benchmark_revision > 0 THEN -1 ELSE revision END AS INT) AS rev FROM obs),
m AS (SELECT *, CASE WHEN source = 'ces' THEN CASE rev WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 ELSE 1.0 END
  ELSE CASE quarter(ref_date) WHEN 1 THEN [25.0, 20.0, 15.0][rev + 1] WHEN 2 THEN [17.0, 4.0, 1.2][rev + 1] WHEN 3 THEN [17.0, 4.0, 1.0][rev + 1] ELSE coalesce([17.0, 1.0][rev + 1], 1.0) END END AS x FROM n)"""


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.expr("CASE WHEN source = 'ces' THEN CASE WHEN seasonally_adjusted THEN 'ces_sa' ELSE 'ces_nsa' END ELSE source END").alias("source")
    rev = F.expr("CASE WHEN source = 'ces' AND benchmark_revision > 0 THEN -1 ELSE revision END").cast("int").alias("revision_number")
    return vintage_obs(spark, sf_dir).select(source, "industry_code", F.col("ref_date").alias("period"), rev, "benchmark_revision")


@query(_NOISE + " SELECT src AS source, industry_code, ref_date AS period, rev AS revision_number, benchmark_revision, CAST(x AS DOUBLE) AS noise FROM m")
def prj17_noise(spark, sf_dir):
    return _noisy(spark, sf_dir).withColumn("noise", model_data.noise())


@query(_NOISE + """ SELECT industry_code, ref_date AS period, rev AS revision_number, benchmark_revision, month(ref_date) IN (2, 5, 8, 11) AS interior,
CAST(x * CASE WHEN month(ref_date) NOT IN (2, 5, 8, 11) AND ref_date >= DATE '1996-07-01' THEN CASE rev WHEN 0 THEN 5.0 WHEN 1 THEN 3.5 ELSE 2.0 END ELSE 1.0 END AS DOUBLE) AS noise FROM m WHERE source = 'qcew'""")
def prj16_boundary_noise(spark, sf_dir):
    rows = _noisy(spark, sf_dir).where("source = 'qcew'")
    return rows.select("industry_code", "period", "revision_number", "benchmark_revision", model_data.interior(F.col("period")).alias("interior"), model_data.boundary_noise(_BREAKS).alias("noise"))


@query(" SELECT industry_code, ref_date, revision, benchmark_revision, CAST(dense_rank() OVER (ORDER BY revision) - 1 AS INT) AS vintage_index FROM obs WHERE source = 'ces' AND seasonally_adjusted AND revision <> 1")
def prj18_vintage_index(spark, sf_dir):
    rows = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted AND revision <> 1")
    return model_data.contiguous(rows, "revision", "vintage_index").select("industry_code", "ref_date", "revision", "benchmark_revision", "vintage_index")


_INDEX = """, ix AS (SELECT industry_code, ref_date, employment, CASE WHEN year(ref_date) > 1995 THEN CAST(employment AS DOUBLE) END AS idx FROM obs WHERE source = 'ces' AND seasonally_adjusted AND revision = 0)"""


@query(_INDEX + """ SELECT industry_code, arg_min(idx, ref_date) FILTER (idx IS NOT NULL) AS base_index, (array_agg(employment ORDER BY abs(idx - 100), ref_date) FILTER (idx IS NOT NULL))[1] / 100 AS index_to_level FROM ix GROUP BY ALL""")
def prj22_index_anchor(spark, sf_dir):
    """Levels as their own index, which starts in the second year."""
    rows = vintage_obs(spark, sf_dir).where("source = 'ces' AND seasonally_adjusted AND revision = 0").withColumn("idx", F.when(F.year("ref_date") > 1995, F.col("employment").cast("double")))
    return model_data.index_anchor(rows, ["industry_code"], "ref_date", "idx", "employment")


@query(""", t AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || '-Q' || quarter(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS token, CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH ELSE date_trunc('month', o_orderdate) END AS m FROM orders)
SELECT token, CAST(m + 11 * INTERVAL 1 DAY AS DATE) AS anchor, count(*) AS n FROM t GROUP BY ALL""")
def prj25_snapshot_anchor(spark, sf_dir):
    date = F.col("o_orderdate").cast("date")
    token = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("-Q", F.year(date), F.quarter(date))).otherwise(F.date_format(date, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(token.alias("token")).groupBy("token").agg(F.count("*").alias("n")).withColumn("anchor", model_data.snapshot_anchor(F.col("token")))


@query(""" SELECT industry_code, max(CAST(date_trunc('quarter', ref_date) AS DATE)) AS quarter FROM (SELECT DISTINCT industry_code, CAST(date_trunc('quarter', ref_date) + INTERVAL 2 MONTH AS DATE) AS ref_date FROM obs WHERE source = 'qcew')
WHERE CAST(date_trunc('month', ref_date) + (CASE WHEN quarter(ref_date) = 4 THEN 8 ELSE 5 END) * INTERVAL 1 MONTH AS DATE) <= DATE '1997-07-10' AND date_trunc('quarter', ref_date) < DATE '1997-07-01' AND date_trunc('quarter', ref_date) >= DATE '1995-07-01' GROUP BY ALL""")
def top13_newest_quarter(spark, sf_dir):
    ends = F.add_months(F.trunc("ref_date", "quarter"), 2).alias("ref_date")
    quarters = vintage_obs(spark, sf_dir).where("source = 'qcew'").select("industry_code", ends).distinct()
    return model_data.newest_quarter(calendar.quarterly_revisions(quarters), ["industry_code"], F.lit("1997-07-10").cast("date"))


@query(" SELECT event_type, event_id, CAST(value AS DOUBLE) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def top16_newest_event(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("value").cast("double").alias("value"), "ts")
    return model_data.newest(rows, ["event_type"], ["ts", "event_id"]).drop("ts")

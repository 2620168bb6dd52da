"""Operators on small hand-built frames."""

import datetime
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import dimensions, queries, schemas
from tidemark.functions import dates, series
from tidemark.operators import calendar, censor, census, composite, evaluate, gates, hierarchy, model_data, provider, quality, store, triangle
from tidemark.sources import readers
from tidemark.streaming import capture

D = datetime.date


def obs(spark, rows):
    """(ref, vintage, revision, benchmark_revision, level) as store rows of one series."""
    df = spark.createDataFrame(rows, "ref_date date, vintage_date date, revision int, benchmark_revision int, employment double")
    fixed = {"source": "ces", "geographic_type": "national", "geographic_code": "00", "industry_type": "total", "industry_code": "05", "ownership": "private"}
    return schemas.conform(df.withColumns({**{k: F.lit(v) for k, v in fixed.items()}, "seasonally_adjusted": F.lit(True)}), schemas.VINTAGE, fill=True)


def month(i):
    return D(2024 + i // 12, i % 12 + 1, 12)


def triangle_rows(n):
    return [(month(i), D(month(i + lag).year, month(i + lag).month, 6), rev, 0, 1000.0 + 100 * i + 5 * rev) for i in range(n) for rev, lag in ((0, 1), (1, 2), (2, 3))]


def test_monthly_selection_takes_the_diagonal(spark):
    rows = censor.growth(censor.valid(censor.knowable(obs(spark, triangle_rows(8)), F.lit("2024-09-12").cast("date"))))
    got = {r.ref_date: (r.revision, r.ok) for r in censor.select_monthly(rows).collect()}
    assert got == {month(7): (0, 1), month(6): (1, 1), **{month(i): (2, 1) for i in range(1, 6)}}


def test_what_was_knowable_never_shrinks(spark):
    store_rows = obs(spark, triangle_rows(8))
    seen = [{(r.ref_date, r.revision) for r in censor.knowable(store_rows, F.lit(d).cast("date")).collect()} for d in ("2024-04-01", "2024-07-01", "2025-01-01")]
    assert seen[0] < seen[1] < seen[2]


def test_sentinels_and_nulls_are_not_valid(spark):
    rows = [(month(0), month(1), 0, 0, -1.0), (month(0), month(2), 1, 0, 5.0), (month(1), None, 0, 0, 5.0), (month(1), month(2), 0, 0, None)]
    assert [r.revision for r in censor.valid(obs(spark, rows)).collect()] == [1]


def test_growth_over_a_gap(spark):
    rows = obs(spark, [(month(i), month(i + 1), 0, 0, 100.0 * (i + 1)) for i in (0, 1, 3)])
    assert censor.growth(rows).count() == 2 and censor.growth(rows, require_adjacent=True).count() == 1


def test_append_compact_drift_and_nulls(spark, tmp_path):
    path, rows = str(tmp_path / "store"), obs(spark, triangle_rows(4))
    assert store.append(rows.unionByName(rows), path) == 12 and store.append(rows, path) == 0
    twin = obs(spark, [(month(0), D(2026, 2, 6), 1, 0, 149500.0), (month(0), D(2026, 2, 6), 2, 1, 149900.0)])
    assert store.append(twin, path) == 1  # (1, 0) is there, its benchmark twin is not
    assert [(r.employment, r.stored) for r in store.drift(twin, store.read(spark, path)).collect()] == [(149500.0, 1005.0)]
    store.read(spark, path).write.mode("append").partitionBy("source", "seasonally_adjusted").parquet(path)
    assert store.read(spark, path).count() == 26
    store.rewrite(spark, path, str(tmp_path / "staging"))
    assert store.read(spark, path).count() == 13
    a, b = store.content_hash(rows), store.content_hash(rows.orderBy(F.desc("ref_date")))
    assert a.first() == b.first() and a.first() != store.content_hash(rows.unionByName(rows)).first()


def test_stream_appends_once_and_sets_drift_aside(spark, tmp_path):
    landing, path = str(tmp_path / "landing"), str(tmp_path / "store")
    rows = obs(spark, triangle_rows(5))
    for batch in (rows, rows.withColumn("employment", F.col("employment") + 1), rows):
        batch.coalesce(1).write.mode("append").parquet(landing)
        capture.capture(capture.landing(spark, landing), path, str(tmp_path / "drift"), str(tmp_path / "offsets"), as_of="2024-06-01").awaitTermination()
    knowable = rows.where("vintage_date <= '2024-06-01' AND ref_date < '2024-06-01'").count()
    assert store.read(spark, path).count() == knowable
    assert spark.read.parquet(str(tmp_path / "drift")).count() == knowable


def test_first_print_takes_the_partner_of_the_same_release(spark):
    rows = [(month(0), D(2024, 2, 6), 0, 0, 150000.0), (month(0), D(2024, 3, 6), 1, 0, 150300.0), (month(1), D(2024, 3, 6), 0, 0, 150800.0), (month(2), D(2024, 4, 6), 0, 0, -1.0)]
    edge, r = sorted(evaluate.first_print_changes(obs(spark, rows), ["industry_code"]).collect(), key=lambda r: r.month)
    assert r.change == 500.0 and r.month == D(2024, 2, 1)
    assert edge.month == D(2024, 1, 1) and edge.change is None and edge.growth is None  # the month without a partner stays


def test_of_several_first_prints_the_latest_counts(spark):
    rows = [(month(0), D(2024, 2, 6), 0, 0, 150000.0), (month(1), D(2024, 3, 6), 0, 0, 150800.0), (month(1), D(2024, 3, 9), 0, 0, 150900.0)]
    got = {r.month: (r.change, r.vintage_date) for r in evaluate.first_print_changes(obs(spark, rows), ["industry_code"]).collect()}
    assert got[D(2024, 2, 1)] == (900.0, D(2024, 3, 9))


def test_encompassing_against_numpy(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(100, 40, 200)
    model, rival = y + rng.normal(0, 24, 200), y + rng.normal(0, 3, 200)
    frame = [(1, float(a), float(m), float(r)) for a, m, r in zip(y, model, rival)] + [(1, float("nan"), 1.0, 2.0), (1, 3.0, None, 2.0), (1, 1.0, 2.0, float("inf"))] + [(2, 1.0, 2.0, 3.0)] * 4
    (r,) = evaluate.encompassing(spark.createDataFrame(frame, "k int, y double, m double, r double"), ["k"], "y", "m", "r").collect()
    x = np.column_stack([np.ones(200), model, rival])
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[0], float(np.linalg.lstsq(x, y, rcond=None)[1][0])
    var_b = rss / 197 * np.linalg.inv(x.T @ x)[1, 1]
    c = np.cov(y - model, y - rival)
    weight = np.clip((c[1, 1] - c[0, 1]) / (c[0, 0] + c[1, 1] - 2 * c[0, 1]), 0, 1)
    assert r.n == 200 and abs(r.b - beta[1]) < 1e-6 and abs(r.c - beta[2]) < 1e-6 and abs(r.weight - weight) < 1e-9 and r.weight < 0.1
    assert abs(r.p_value - math.erfc(math.sqrt(beta[1] ** 2 / var_b / 2))) < 1e-6
    assert abs(r.mae_combined - np.abs(y - weight * model - (1 - weight) * rival).mean()) < 1e-9 and r.mae_combined < r.mae_model
    (same,) = evaluate.encompassing(spark.createDataFrame([(1, float(i), i + 1.0, i + 1.0) for i in range(9)], "k int, y double, m double, r double"), ["k"], "y", "m", "r").collect()
    assert same.weight == 0.5 and same.b is None


def test_month_types_by_threshold_and_finite_percentile(spark):
    nan = float("nan")
    rows = [(1, D(2024, i + 1, 1), r, m) for i, (r, m) in enumerate([(1.0, 0.0), (2.0, 45.0), (-99.0, 50.0), (nan, -40.0), (None, nan), (3.0, 39.9)])]
    got = {r.month.month: r.month_type for r in evaluate.month_types(spark.createDataFrame(rows, "k int, month date, rev double, mom double"), ["k"], "rev", "mom").collect()}
    assert np.percentile([1, 2, 99, 3], 90) < 99
    assert got == {1: "normal", 2: "turning_point", 3: "large_revision", 4: "turning_point", 5: "normal", 6: "normal"}
    only = spark.createDataFrame([(1, D(2024, 2, 1), nan, nan)], "k int, month date, rev double, mom double")
    assert evaluate.month_types(only, ["k"], "rev", "mom").first().month_type == "benchmark_window"


def test_assembled_total_against_numpy(spark):
    growth, wedge = np.random.default_rng(2).normal(0.001, 0.002, 70), np.random.default_rng(3).normal(20, 5, 70)
    frame = lambda v: spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "s int, draw long, value double")
    part = 150.0 * (np.exp(growth) - 1) * 10.0
    for eta in (0.0, 4.0):
        out = evaluate.assemble_total(frame(growth), frame(wedge), ["s"], prev_index=150.0, idx_to_level=10.0, eta=eta)
        got = np.array([r.value for r in out.orderBy("draw").collect()])
        assert np.allclose(got, part + wedge + eta * (part - part.mean()) / part.std()) and abs(got.mean() - (part + wedge).mean()) < 1e-9
    flat = evaluate.assemble_total(frame([0.0] * 5), frame(wedge[:7]), ["s"], prev_index=1.0, idx_to_level=1.0, eta=2.0)
    assert np.allclose([r.value for r in flat.orderBy("draw").collect()], wedge[:7])


def test_draws_that_are_not_finite_do_not_count(spark):
    rows = spark.createDataFrame([("a", v, 2.0) for v in (1.0, 2.0, 3.0, float("nan"), float("inf"), None)], "k string, v double, y double")
    r = evaluate.interval_coverage(rows, ["k"], "v", "y", 0.8).first()
    assert np.allclose([r.low, r.high], [1.2, 2.8]) and r.covered is True
    assert abs(evaluate.crps(rows, ["k"], "v", "y").first().crps - (2 / 3 - (2 / 9) * (-2 + 0 + 6) / 2)) < 1e-12


def test_calendar_prints_and_shadows(spark):
    base = spark.createDataFrame([("ces", D(2024, 1, 1), D(2024, 2, 2))], "publication string, ref_date date, vintage_date date")
    got = {(r.revision, r.benchmark_revision): r.vintage_date for r in calendar.monthly_revisions(base).collect()}
    assert got == {(0, 0): D(2024, 2, 2), (1, 0): D(2024, 3, 2), (2, 0): D(2024, 4, 2), (2, 1): D(2025, 2, 2)}
    kept = calendar.drop_reprint_shadows(calendar.monthly_revisions(base), ["ref_date"])
    assert (1, 0) not in {(r.revision, r.benchmark_revision) for r in kept.collect()} and kept.count() == 3
    more = base.union(spark.createDataFrame([("ces", D(2024, 3, 1), D(2024, 4, 5))], base.schema))
    assert calendar.supplement(base, more).count() == 2


def test_dates(spark):
    rows = spark.createDataFrame([(D(2020, 12, 1),), (D(2025, 6, 1),), (D(2024, 4, 1),)], "d date")
    assert [r[0] for r in rows.select(dates.first_friday_release(F.col("d"))).collect()] == [D(2021, 1, 8), D(2025, 7, 11), D(2024, 5, 3)]
    codes = spark.createDataFrame([("M05",), ("Q03",), ("S02",), ("A01",), ("M13",), ("x",)], "p string")
    assert [r[0] for r in codes.select(dates.period_date(F.lit(2024), F.col("p"))).collect()] == [D(2024, 5, 1), D(2024, 7, 1), D(2024, 7, 1), D(2024, 1, 1), None, None]


def redistributed(weights, covered, group, region):
    """Brute force, cell after cell."""
    w = np.array(weights, float)
    covered = np.array(covered)
    for i in np.flatnonzero(~covered):
        amount, w[i] = w[i], 0.0
        if amount == 0:
            continue
        for mask in (covered & (np.array(group) == group[i]), covered & (np.array(region) == region[i]), covered):
            if w[mask].sum() > 0:
                w[mask] += amount * w[mask] / w[mask].sum()
                break
        else:
            if covered.any():
                w[covered] += amount / covered.sum()
    return w / w.sum() if w.sum() > 0 else w


@pytest.mark.parametrize("seed", range(4))
def test_redistribution_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    group, region = [i % 4 for i in range(12)], [i // 4 for i in range(12)]
    cases = []
    for _ in range(12):
        w = rng.random(12) * (rng.random(12) > 0.3)
        cases.append(((w / max(w.sum(), 1e-9)).tolist(), (rng.random(12) > 0.6).tolist()))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, w array<double>, c array<boolean>")
    out = {r.i: r.o for r in df.select("i", composite.redistribute(F.col("w"), F.col("c"), group, region).alias("o")).collect()}
    for i, (w, c) in enumerate(cases):
        assert np.allclose(out[i], redistributed(w, c, group, region))


def test_index_through_and_up_to_gaps(spark):
    df = spark.createDataFrame([(1, i, g) for i, g in enumerate([None, 0.1, None, 0.2])], "k int, d int, growth double")
    through = [r.level for r in composite.cumulative_index(df, ["k"], "d").orderBy("d").collect()]
    ended = [r.level for r in composite.cumulative_index(df, ["k"], "d", through_gaps=False).orderBy("d").collect()]
    assert through[0] is None and np.allclose(through[1:], 100 * np.exp([0.1, 0.1, 0.3])) and ended[2:] == [None, None]


def test_constant_growth_is_recovered(spark):
    rows = [(c, D(2024, m, 1), 500 * float(np.exp(0.001 * m)) * (c + 1), 10, 0.1) for c in range(6) for m in range(1, 7)]
    df = spark.createDataFrame(rows, "cell int, d date, v double, n int, share double").withColumn("k", F.lit(1))
    got = composite.weighted_growth(df, ["k"], "cell", "d", "v", "n", "share", 5).collect()
    assert len(got) == 5 and all(abs(r.growth - 0.001) < 1e-9 for r in got)


def test_triangles(spark):
    rows = [(1, 10, 10, 5.0), (1, 10, 11, 6.0), (1, 10, 12, 7.0), (1, 11, 11, 5.0), (1, 11, 12, None), (1, 11, 13, 9.0), (1, 12, 13, 4.0)]
    df = spark.createDataFrame(rows, "k int, ref int, release int, value double")
    assert {(r.ref, r.revision) for r in triangle.diagonals(df, ["k"]).collect()} == {(10, 0), (10, 1), (10, 2), (11, 0)}
    walk = spark.createDataFrame([(1, 2020, 3, y, 1, v) for y, v in ((2021, 5.0), (2022, 5.0), (2023, 6.0))] + [(1, 2020, 3, 2021, 2, 9.0)], "k int, ref_year int, ref_month int, release_year int, release_month int, value double")
    assert [(r.release_year, r.benchmark_revision) for r in triangle.benchmark_walk(walk, ["k"]).orderBy("release_year").collect()] == [(2021, 1), (2023, 2)]


def test_size_schemes_nest(spark):
    df = spark.createDataFrame([(str(i), 2.0**i) for i in range(1, 10)], "size_code string, v double").withColumn("k", F.lit(1))
    out = hierarchy.size_schemes(df, "size_code", ["k"], "v").groupBy("size_class_type").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    assert {(r.size_class_type, r.v, r.n) for r in out.collect()} == {("total", 1022.0, 1), ("small", 1022.0, 3), ("medium", 1022.0, 5), ("large", 1022.0, 9)}


def test_crps_and_coverage(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60)
    df = spark.createDataFrame([(1, float(v), 0.3) for v in x], "k int, v double, a double")
    want = np.abs(x - 0.3).mean() - 0.5 * np.abs(x[:, None] - x[None, :]).mean()
    assert abs(evaluate.crps(df, ["k"], "v", "a").first().crps - want) < 1e-9
    r = evaluate.interval_coverage(df, ["k"], "v", "a", 0.8).first()
    assert np.allclose([r.low, r.high], np.percentile(x, [10, 90])) and r.covered


def test_findings(spark):
    bad = obs(spark, [(month(0), month(1), 0, 0, 5.0), (month(0), month(2), 1, 0, 0.0), (month(3), month(4), 0, 0, 6.0)]).withColumn("growth", F.when(F.col("revision") == 1, F.lit(float("inf"))).otherwise(0.1))
    got = {r.check: r.violations for r in quality.selection_findings(bad, schemas.SERIES).collect()}
    assert got == {"duplicate_date": 2, "month_gap": 1, "level_not_positive": 1, "growth_not_finite": 1}


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a_SA.csv").write_text("year,month,Jan_23,Feb_23\n2023,2,10,\n2023,3,11,20.5\n")
    rows = {(r.release, r.ref_date, r.value) for r in readers.triangles(spark, str(tmp_path / "t")).collect()}
    assert (D(2023, 3, 1), D(2023, 2, 12), 20.5) in rows and (D(2023, 2, 1), D(2023, 2, 12), None) in rows
    (tmp_path / "x.tsv").write_text("series_id \t year\n CES05  \t2024 \n")
    assert readers.padded_tsv(spark, str(tmp_path / "x.tsv")).collect() == [("CES05", "2024")]
    matrix = spark.createDataFrame([("2024-01-01", "1.5", ".")], "date string, PAY_20240202 string, PAY_20240301 string")
    assert [(r.vintage_date, r.value) for r in readers.vintage_matrix(matrix, ["date"]).collect()] == [(D(2024, 2, 2), 1.5)]
    text = '{"Results": {"series": [{"seriesID": "CES", "data": [{"year": "2024", "period": "M02", "value": "7.5"}, {"year": "2024", "period": "M13", "value": "-"}]}]}}'
    api = readers.api_series(spark.createDataFrame([(text,)], "j string"), "j").collect()
    assert [(r.series_id, r.date, r.value) for r in api] == [("CES", D(2024, 2, 1), 7.5), ("CES", None, None)]
    feed = "<rss><item><title> Jobs </title><pubDate>Fri, 02 Feb 2024 08:30:00 EST</pubDate><guid>g1</guid></item><item><title>no date</title></item></rss>"
    assert [(r.title, r.date, r.guid) for r in readers.feed_items(spark.createDataFrame([(feed,)], "x string"), "x").collect()] == [("Jobs", D(2024, 2, 2), "g1")]
    page = spark.createDataFrame([("/archive/empsit_2024-01.htm", "<pre>released 8:30 a.m. Friday, February 2, 2024</pre>")], "url string, html string")
    r = readers.release_dates(page).first()
    assert (r.vintage_date, r.ref_date) == (D(2024, 2, 2), D(2024, 1, 1))


def test_series_ids(spark):
    df = spark.createDataFrame([("CES0500000001",), ("SMU26000000500000001",), ("ENUUS0001050",), ("XX",)], "id string")
    got = df.select(*[series.series_id_field(F.col("id"), n).alias(n) for n in ("seasonal", "industry", "state")]).collect()
    assert [tuple(r) for r in got] == [("S", "05000000", None), ("U", "05000000", "26"), (None, None, None), (None, None, None)]


def test_conform_and_empty(spark):
    assert schemas.empty(spark, schemas.PANEL).count() == 0
    with pytest.raises(ValueError, match="missing"):
        schemas.conform(spark.range(1), schemas.CALENDAR)


@pytest.mark.parametrize("p, n", [(9, 9), (700, 1400), (1403, 601), (1, 5)])
def test_total_takes_every_wedge_draw(spark, p, n):
    rng = np.random.default_rng(p)
    ids = np.sort(rng.choice(50_000, p + n, replace=False)) - 20_000
    kinds, values = rng.permutation(["p"] * p + ["w"] * n), rng.normal(size=p + n)
    df = spark.createDataFrame([(k, int(i), float(v), 1) for k, i, v in zip(kinds, ids, values)], "kind string, id long, value double, s int")
    d = evaluate.number_draws(df, ["kind"], "id", width=1000)
    out = evaluate.resample_total(d.where("kind = 'p'"), d.where("kind = 'w'"), ["s"])
    parts, wedges = values[kinds == "p"], values[kinds == "w"]
    want = np.array([wedges[j] + parts[j * p // n] for j in range(n)])
    got = sorted((r.draw, r.value) for r in out.collect())
    assert [i for i, _ in got] == list(range(n)) and np.allclose([v for _, v in got], want)
    r = evaluate.score_total(out.withColumn("a", F.lit(0.5)), ["s"], "value", "a").first()
    spread = np.abs(want[:, None] - want[None, :]).mean() / 2
    assert abs(r.point_err - abs(want.mean() - 0.5)) < 1e-9 and abs(r.crps - (np.abs(want - 0.5).mean() - spread)) < 1e-9
    low, high = np.percentile(want, [10, 90])
    assert r.covered == (low <= 0.5 <= high)


def test_crps_without_a_window_over_a_group(spark, small, capsys):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.round(rng.normal(size=900), 1), rng.normal(size=50) * 1e-7, -np.exp(rng.normal(size=50) * 9)])
    df = spark.createDataFrame([(1, float(v), 0.3) for v in x], "k int, v double, a double")
    out = evaluate.crps(df, ["k"], "v", "a")
    want = np.abs(x - 0.3).mean() - 0.5 * np.abs(x[:, None] - x[None, :]).mean()
    assert abs(out.first().crps - want) < 1e-9 * abs(want)
    for plan, by in ((out, r"k#\d+L?"), (queries.agg22_interval_coverage(spark, small), r"event_type#\d+"), (queries.agg23_crps(spark, small), r"day#\d+, event_type#\d+")):
        plan.explain("extended")
        text = capsys.readouterr().out
        windows = re.findall(r"\+- Window \[(.*)\], \[([^\]]*)\]", text)
        # only the running sum over one row for each bucket goes over a whole group
        assert all("_bucket" in order_by or "_bucket" in line for line, order_by in windows if re.fullmatch(by, order_by))


def test_gates_and_residuals(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(0, 30, 120)
    cells = [("both", float(a), float(a + e), float(a + f)) for a, e, f in zip(y, rng.normal(0, 10, 120), rng.normal(0, 10, 120))] + [("few", 1.0, 2.0, 3.0)] * 3
    got = {r.k: r for r in evaluate.combination_gate(spark.createDataFrame(cells, "k string, y double, m double, r double"), ["k"], "y", "m", "r").collect()}
    assert got["both"].fires and got["both"].reason is None and 0.3 < got["both"].weight < 0.7
    assert not got["few"].fires and got["few"].reason == "insufficient_paired_obs" and got["few"].n == 3
    r2 = spark.createDataFrame([(1, "normal", 0.12), (1, "turning_point", 0.3), (2, "turning_point", 0.1)], "k int, month_type string, r2 double")
    assert {r.k: (r.fund_rebuild, r.fund_turning) for r in evaluate.funding_gate(r2, ["k"]).collect()} == {1: (True, True), 2: (False, False)}
    w, g = rng.normal(0, 5, 40), rng.normal(0, 3, 40)
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(w, g)], "k int, w double, g double")
    r = evaluate.decomposition_residual(rows, ["k"], "w", "g").first()
    assert np.allclose([r.r_mean, r.r_std, r.wedge_std, r.r_share], [(w - g).mean(), (w - g).std(ddof=1), w.std(ddof=1), (w - g).std(ddof=1) / w.std(ddof=1)])
    assert np.isclose(evaluate.intervention_sd(rows, ["k"], "g", 1.0).first().sd, g.std(ddof=1)) and evaluate.intervention_sd(rows.limit(1), ["k"], "g", 7.0).first().sd == 7.0
    one = spark.createDataFrame([(D(2024, 1, 1),), (D(2020, 3, 1),), (D(2019, 1, 1),)], "d date")
    assert [x[0] for x in one.select(dates.era(F.col("d"), ["2020-03-01", "2022-01-01"])).collect()] == [2, 1, 0]


def counts(verdicts):
    return {r.check: r.violations for r in verdicts.collect()}


def roots(spark):
    return spark.createDataFrame([("total", "05", "private")], "industry_type string, industry_code string, ownership string")


def test_history_gate_splits_by_cohort(spark):
    rows = [(month(0), D(2024, 2, 6), 0, 0, 100.0), (month(0), D(2024, 3, 6), 1, 0, 101.0), (month(0), D(2024, 4, 6), 2, 0, 102.0), (month(0), D(2025, 2, 6), 2, 1, 103.0)]
    old = obs(spark, rows).withColumn("seasonally_adjusted", F.lit(False))
    later = obs(spark, [(month(0), D(2026, 2, 6), 2, 1, 999.0)]).withColumn("seasonally_adjusted", F.lit(False))
    cutoff = F.lit("2025-01-01").cast("date")
    same = gates.history(old.unionByName(later), old, roots(spark), cutoff)
    assert counts(same) == dict.fromkeys(("cohort_missing", "no_overlap", "first_prints_differ", "benchmark_prints_differ"), 0)
    assert gates.passed(same).head().passed
    off = gates.history(old.withColumn("employment", F.col("employment") + 1), old, roots(spark), cutoff)
    assert counts(off) == {"cohort_missing": 0, "no_overlap": 0, "first_prints_differ": 2, "benchmark_prints_differ": 2}
    soft = old.withColumn("employment", F.when(F.col("revision") == 2, 0.0).otherwise(F.col("employment")))
    assert gates.passed(gates.history(soft, old, roots(spark), cutoff)).head().passed
    none = gates.history(old.limit(0), old, roots(spark), cutoff)
    assert counts(none)["cohort_missing"] == 4 and counts(none)["no_overlap"] == 1 and not gates.passed(none).head().passed


def test_fidelity_and_integrity_of_nulls_repeats_and_empty_frames(spark):
    rows = obs(spark, [(month(0), D(2024, 2, 6), 0, 0, 100.0), (month(1), D(2024, 3, 6), 0, 0, 100.3)]).withColumn("ownership", F.lit(None).cast("string"))
    shifted = rows.withColumn("employment", F.col("employment") + 0.4)
    assert set(counts(gates.fidelity(rows, shifted, gates.PRINT, 0.5)).values()) == {0}
    assert counts(gates.fidelity(rows, shifted, gates.PRINT, 0.05))["values_differ"] == 2
    assert counts(gates.fidelity(rows, rows.limit(0), gates.PRINT, 0.5)) == {"side_empty": 1, "values_differ": 0, "only_rebuilt": 2, "only_reference": 0}
    keys = [*gates.SERIES_ID, "ref_date"]
    bad = rows.unionByName(obs(spark, [(month(0), None, 0, 0, None)]).withColumn("ownership", F.lit(None).cast("string"))).unionByName(rows)
    assert counts(gates.integrity(rows, keys)) == dict.fromkeys(("slice_empty", "duplicate_key", "mixed_vintages", "level_not_positive"), 0)
    assert counts(gates.integrity(bad, keys)) == {"slice_empty": 0, "duplicate_key": 2, "mixed_vintages": 1, "level_not_positive": 1}
    assert counts(gates.integrity(rows.limit(0), keys))["slice_empty"] == 1


def test_gap_fill_names_what_is_missing(spark):
    rows = obs(spark, [(D(2024, 12, 12), D(2026, 2, 6), 2, 1, 1.0), (D(2026, 1, 12), D(2026, 2, 6), 0, 0, 1.0)]).withColumn("seasonally_adjusted", F.lit(False))
    assert counts(gates.gap_fill(rows, roots(spark), "2026-01-12", [2024, 2025])) == {"frontier": 0, "december_2024": 0, "december_2025": 1}


def test_industry_axes(spark):
    rows = spark.createDataFrame([("national", "00"), ("domain", "05"), ("supersector", "55"), ("sector", "55"), ("sector", "91"), (None, None)], "industry_type string, industry_code string")
    assert {(r.industry_type, r.industry_code, r.ownership) for r in dimensions.remap(rows).collect()} == {
        ("total", "00", "total"), ("total", "05", "private"), ("supersector", "55", "private"), ("sector", "55", "private"),
    }
    assert dimensions.unknown(rows).count() == 2
    old = spark.createDataFrame([("sector", "41"), ("sector", "42"), ("supersector", "80"), ("supersector", "10")], "industry_type string, industry_code string")
    assert sorted(map(tuple, dimensions.recode(old).collect())) == [("sector", "42"), ("sector", "44"), ("sector", "81"), ("supersector", "10"), ("supersector", "80")]
    years = spark.createDataFrame([(2009,), (2020,), (1990,)], "year int")
    assert {r.year: (r.benchmark, r.benchmark_known) for r in dimensions.with_benchmark(years, "year").collect()} == {2009: (-902, True), 2020: (None, True), 1990: (None, False)}


def test_census_streams(spark):
    rows = [("US000", "0", "10", "10", 9.0), ("01000", "5", "54", "44-45", 1.0), ("01000", "5", "54", "31-33", 5.0), ("01000", "5", "55", "311", 2.0), ("01000", "2", "51", "10", 3.0), ("01000", "2", "51", "1011", 7.0), ("01000", None, None, None, 8.0)]
    df = spark.createDataFrame(rows, "area_fips string, own_code string, agglvl_code string, industry_code string, v double")
    got = {(r.geographic_code, r.industry_type, r.industry_code): r.v for r in census.levels(df, [], "v").collect()}
    assert got == {
        ("00", "national", "00"): 9.0, ("01", "sector", "44"): 1.0, ("01", "sector", "32"): 2.0, ("01", "sector", "92"): 3.0,
        ("01", "supersector", "40"): 1.0, ("01", "supersector", "30"): 2.0, ("01", "supersector", "90"): 3.0,
        ("01", "domain", "05"): 3.0, ("01", "domain", "06"): 2.0, ("01", "domain", "07"): 4.0, ("01", "domain", "08"): 1.0,
    }
    cells = spark.createDataFrame([("N",), ("-",), (None,)], "disclosure_code string")
    assert census.disclosed(cells).count() == 2


def test_provider_rows(spark):
    rows = [("p", "region", month(0), 500.0), ("p", "region", month(1), 550.0), ("p", "region", month(2), None), ("p", "region", month(3), 0.0), ("q", None, month(0), 1.0)]
    df = spark.createDataFrame(rows, "provider string, geographic_type string, ref_date date, employment double")
    (row,) = provider.growth_rows(df, ["provider"]).collect()
    assert (row.period, row.vintage_date, row.publication_lag_months) == (month(1), D(2024, 3, 4), 1) and math.isclose(row.growth, math.log(1.1))
    assert {r.provider: r.cell_level for r in provider.with_cell_level(df, "provider").collect()} == {"p": True, "q": False}


def test_model_features(spark):
    rows = [("qcew", D(2021, 2, 12), 0), ("qcew", D(2021, 3, 12), 0), ("qcew", D(2021, 3, 12), 9), ("ces_sa", D(2021, 3, 12), -1), ("x", D(2021, 3, 12), None)]
    df = spark.createDataFrame(rows, "source string, period date, revision_number int")
    assert [r.x for r in df.select(model_data.noise().alias("x")).collect()] == [25.0, 25.0, 1.0, 1.0, 1.0]
    assert [r.x for r in df.where("source = 'qcew'").select(model_data.boundary_noise(["2020-03-01"]).alias("x")).collect()] == [25.0, 125.0, 1.0]
    seen = spark.createDataFrame([(0,), (2,), (2,), (None,)], "r int")
    assert [x.i for x in model_data.contiguous(seen, "r", "i").orderBy("r").collect()] == [None, 0, 1, 1]
    tokens = spark.createDataFrame([("2025-05-01",), ("2025-Q2",), ("2025-Q9",), ("x",), (None,)], "t string")
    assert [r.d for r in tokens.select(model_data.snapshot_anchor(F.col("t")).alias("d")).collect()] == [D(2025, 5, 12), D(2025, 6, 12), None, None, None]
    index = spark.createDataFrame([("a", month(0), float("nan"), 1.0), ("a", month(1), 90.0, 2.0), ("a", month(2), 101.0, 300.0), ("b", month(0), None, 5.0)], "s string, d date, i double, l double")
    got = {r.s: (r.base_index, r.index_to_level) for r in model_data.index_anchor(index, ["s"], "d", "i", "l").collect()}
    assert got == {"a": (90.0, 3.0), "b": (100.0, None)}

"""Jobs against plain Python on small frames: intervals, backtests, capture, snapshots, merges."""

import datetime
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import rebuild_queries
from tidemark.operators import backtest, censor, census, composite, intervals, jobs, regression, store
from tidemark.plans.demo import vintage_obs
from tidemark.schemas import STORE_KEY, VINTAGE, conform
from tidemark.storage import new_folder
from tidemark.streaming import capture


def day(text):
    return datetime.date.fromisoformat(text)


PRINT = ["source", "seasonally_adjusted", "geographic_type", "geographic_code", "industry_type", "industry_code", "ref_date"]


def prints(spark, rows):
    """(industry, ref, vintage, revision, benchmark, level)"""
    full = [("ces", True, "national", "00", "supersector", i, day(r), v and day(v), n, b, float(x)) for i, r, v, n, b, x in rows]
    return spark.createDataFrame(full, "source string, seasonally_adjusted boolean, geographic_type string, geographic_code string, industry_type string, industry_code string, ref_date date, vintage_date date, revision int, benchmark_revision int, employment double")


def test_intervals_of_late_repeated_and_unpublished_prints(spark):
    rows = [("a", "2020-01-12", "2020-02-07", 0, 0, 1), ("a", "2020-01-12", "2020-03-06", 1, 0, 2), ("a", "2020-01-12", "2020-03-06", 2, 0, 3), ("a", "2020-02-12", "2020-03-06", 0, 0, 4), (None, "2020-01-12", "2020-02-07", 0, 0, 5), ("b", "2020-01-12", None, 0, 0, 6)]
    got = {(r.industry_code, r.ref_date, r.employment): (r.valid_from, r.valid_to) for r in intervals.intervals(prints(spark, rows)).collect()}
    assert got == {
        ("a", day("2020-01-12"), 1.0): (day("2020-02-07"), day("2020-03-06")), ("a", day("2020-01-12"), 3.0): (day("2020-03-06"), None),
        ("a", day("2020-02-12"), 4.0): (day("2020-03-06"), None), (None, day("2020-01-12"), 5.0): (day("2020-02-07"), None),
    }


def test_index_kept_over_appends_is_the_index_of_all(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), f"20{y}-0{m}-12", f"20{rng.randint(y, y + 3)}-{rng.randint(1, 12):02d}-05", rng.randint(0, 2), rng.randint(0, 1), rng.randint(1, 99)) for y in (18, 19, 20) for m in range(1, 7) for _ in range(12)]
    rng.shuffle(rows)
    path = new_folder(spark, "index")
    intervals.build(prints(spark, rows[:60]), path)
    for at in range(60, len(rows), 60):
        intervals.append(prints(spark, rows[at : at + 60]), path)
        intervals.append(prints(spark, rows[at : at + 10]), path)  # a delivery that comes again changes nothing
    index = intervals.read(spark, path, prints(spark, rows[:1]).schema)
    whole = intervals.intervals(prints(spark, rows).distinct())
    plain = lambda df: sorted(map(repr, df.select(*whole.columns).collect()))
    assert plain(index) == plain(whole)
    dates = [day(f"20{y}-{m:02d}-20") for y in (18, 20, 22) for m in (1, 6)]
    got = sorted(map(repr, intervals.view(index, dates).select("as_of", *PRINT, "employment").collect()))
    want = []
    for d in dates:
        best = {}
        for i, r, v, n, b, x in rows:
            if day(v) <= d and day(r) < d:
                best[i, r] = max(best.get((i, r), ()), (day(v), b, n, float(x)))
        want += [repr((d, i, r, k[-1])) for (i, r), k in best.items()]
    assert len(got) == len(want)
    assert sorted(want) == sorted(repr((r.as_of, r.industry_code, str(r.ref_date), r.employment)) for r in intervals.view(index, dates).collect())
    assert "Exchange" not in intervals.view(index, dates)._jdf.queryExecution().executedPlan().toString()


def test_panel_grid_is_the_panel_date_by_date(spark, small):
    store = conform(vintage_obs(spark, small), VINTAGE, fill=True).cache()
    dates = [day("1996-01-12"), day("1996-05-12"), day("1997-03-12"), day("1998-11-12")]
    grid = intervals.panel_grid(store, dates)
    columns = [c for c in grid.columns if c != "as_of"]
    for d in dates:
        one = censor.to_panel(store, F.lit(d), F.add_months(F.lit(d), -41))
        assert sorted(map(repr, grid.where(F.col("as_of") == d).select(*columns).collect())) == sorted(map(repr, one.select(*columns).collect()))
    plan = intervals.panel_grid(spark.createDataFrame(store.rdd, VINTAGE), dates)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed", range(6))
def test_naive_competitors_against_all_known_months(spark, seed):
    """Months that come in order, and series in which some come late; ties of dates; series without history."""
    rng = random.Random(seed)
    history, asked = [], []
    for name in ("a", "b", None, "d"):
        for m in range(30):
            at = day("2020-01-05") + datetime.timedelta(days=30 * m + (rng.randint(0, 200) if name in ("b", None) else rng.choice([0, 30])))
            history.append((name, day("2019-12-01") + datetime.timedelta(days=31 * m), None if rng.random() < 0.1 else float(rng.randint(-50, 50)), at))
        asked += [(name, "r", day("2020-01-01") + datetime.timedelta(days=rng.randint(0, 1200)), k) for k in range(25)]
    asked.append(("none", "r", day("2021-01-01"), 0))
    h = spark.createDataFrame(history, "industry_code string, month date, change double, vintage_date date")
    t = spark.createDataFrame(asked, "industry_code string, regime string, as_of date, k int")
    out = backtest.naive(t, h, ["industry_code"], "change", 5)
    got = {(r.industry_code, r.as_of, r.k): (r.rw, r.tm and round(r.tm, 9)) for r in out.collect()}
    want = {}
    for name, _, as_of, k in asked:
        known = sorted((m, v) for n, m, v, at in history if n == name and at <= as_of and v is not None)[-5:]
        want[name, as_of, k] = (known[-1][1], round(sum(v for _, v in known) / len(known), 9)) if known else (None, None)
    assert {k: (a, b if b is None else b + 0.0) for k, (a, b) in got.items()} == want
    again = backtest.naive(t, h, ["industry_code"], "change", 5)  # not yet run: its plan is shown once
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


# ------------------------------------------------------------------ store jobs


def full(spark, rows):
    return conform(prints(spark, rows), VINTAGE, fill=True)


def files(spark, path, where):
    return {r.f for r in store.read(spark, path).where(where).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}


def plain(df):
    return sorted(map(repr, df.select(*[f.name for f in VINTAGE]).collect()))


def mixed(spark, small):
    return conform(vintage_obs(spark, small), VINTAGE, fill=True)


def test_healing_rewrites_only_what_lies_in_several_files(spark, small):
    rows, path = mixed(spark, small).cache(), new_folder(spark, "heal")
    for i in range(3):
        rows.where(F.pmod(F.xxhash64("ref_date"), F.lit(3)) == i).where("source = 'ces'").coalesce(1).write.mode("append").partitionBy(*jobs.PARTITION).parquet(path)
    rows.where("source = 'qcew'").coalesce(1).write.mode("append").partitionBy(*jobs.PARTITION).parquet(path)
    before, whole = files(spark, path, "source = 'qcew'"), plain(store.read(spark, path))
    assert jobs.heal(spark, path) == [("ces", False), ("ces", True)]
    assert files(spark, path, "source = 'qcew'") == before and plain(store.read(spark, path)) == whole
    assert jobs.fragmented(spark, path).count() == 0 and jobs.heal(spark, path) == []


def test_a_swap_that_died_is_finished_and_keeps_later_rows(spark, monkeypatch):
    path = new_folder(spark, "crash")
    old = full(spark, [("a", f"2020-0{m}-12", "2020-09-01", 0, 0, m) for m in range(1, 6)])
    old.coalesce(1).write.partitionBy(*jobs.PARTITION).parquet(path)
    more = full(spark, [("b", "2020-01-12", "2020-10-01", 0, 0, 9)])
    more.write.mode("append").partitionBy(*jobs.PARTITION).parquet(path)
    with monkeypatch.context() as m:
        m.setattr(jobs, "_place", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            jobs.heal(spark, path)
    late = full(spark, [("c", "2020-02-12", "2020-11-01", 0, 0, 7)])
    late.write.mode("append").partitionBy(*jobs.PARTITION).parquet(path)
    jobs.heal(spark, path)
    assert plain(store.read(spark, path)) == plain(old.unionByName(more).unionByName(late))
    store.read(spark, path).limit(1).write.parquet(f"{path}/{jobs.STAGED}/x")  # no marker of its own: never in place
    assert not jobs.resume(spark, path) and plain(store.read(spark, path)) == plain(old.unionByName(more).unionByName(late))


def test_merge_by_precedence_touches_its_own_partitions(spark, small):
    path, rows = new_folder(spark, "merge"), mixed(spark, small).cache()
    store.append(rows, path)
    kept = files(spark, path, "source = 'qcew'")
    survey = rows.where("source = 'ces' AND seasonally_adjusted")
    history = survey.where("month(ref_date) < 9").withColumn("employment", F.lit(1.0))
    current = survey.where("month(ref_date) > 6").withColumn("employment", F.lit(2.0))
    assert jobs.build_store(history, current, path) == [("ces", True)]
    got = store.read(spark, path)
    month = F.month("ref_date")
    assert got.count() == rows.count() and files(spark, path, "source = 'qcew'") == kept
    share = got.where("source = 'ces' AND seasonally_adjusted").groupBy("employment").agg(F.min(month).alias("a"), F.max(month).alias("b")).where("employment IN (1, 2)")
    assert {r.employment: (r.a, r.b) for r in share.collect()} == {1.0: (1, 6), 2.0: (7, 12)}
    assert plain(jobs.priority_merge([current, history], STORE_KEY).where(month == 7)) == plain(current.where(month == 7))


def test_a_dry_run_counts_what_a_patch_appends(spark, small):
    path, rows = new_folder(spark, "patch"), mixed(spark, small).cache()
    store.append(rows.where("vintage_date < '1998-03-12' OR source = 'qcew'"), path)
    window = rows.where("vintage_date >= '1997-10-01' AND source = 'ces'").withColumn("employment", F.col("employment") + F.when(F.col("vintage_date") == "1998-02-12", 1).otherwise(0))
    through = F.lit("1998-08-12").cast("date")
    dry = jobs.patch_frontier(window, path, through)
    assert dry.appended == 0 and dry.would_append == rows.where("source = 'ces' AND vintage_date BETWEEN '1998-03-12' AND '1998-08-12'").count()
    assert dry.corrected.count() == dry.skipped > 0  # stored prints of the frontier's own day, which the window has otherwise
    _, new, _ = jobs.patch_plan(window, path, through)
    scans = re.findall(r"PartitionFilters: \[([^\n]*)", new._jdf.queryExecution().executedPlan().toString())
    assert any("source" in s and "ces" in s and "seasonally_adjusted" in s for s in scans) and not any("qcew" in s for s in scans)
    done = jobs.patch_frontier(window, path, through, apply=True)
    assert done.appended == dry.would_append and jobs.patch_frontier(window, path, through, apply=True).appended == 0


def test_a_tampered_snapshot_is_refused(spark):
    path, df = new_folder(spark, "pinned"), spark.range(50).selectExpr("id", "id * 0.5 AS x", "CAST(NULL AS STRING) AS s")
    content = jobs.snapshot(df.repartition(3), path, "2020-05-12")
    assert jobs.snapshot(df.repartition(2), path, "2020-05-12") == content  # the same rows: the same snapshot
    assert jobs.load_snapshot(spark, path, "2020-05-12", content).count() == 50
    assert jobs.snapshot(df.where("id < 49"), path, "2020-05-12") != content
    with pytest.raises(ValueError):
        jobs.load_snapshot(spark, path, "2020-05-12", "0" * 64)
    home = f"{path}/as_of=2020-05-12/{content[:12]}"
    df.where("id = 7").write.mode("append").parquet(f"{home}/data")
    with pytest.raises(ValueError):
        jobs.load_snapshot(spark, path, "2020-05-12", content)


# ------------------------------------------------------------------ census and regressions


def test_sizes_count_once_and_only_in_first_quarters(spark):
    cell = ("area_fips", "own_code", "agglvl_code", "industry_code", "disclosure_code", "size_code", "year", "qtr", "month1_emplvl", "month2_emplvl", "month3_emplvl")
    rows = [
        ("01000", "5", "24", "22", None, "1", "2020", "1", "2000", "0", ""), ("01000", "5", "64", "22", None, "1", "2020", "1", "2000", "0", ""),
        ("US000", "5", "23", "1021", None, "1", "2020", "1", "5000", "x", None), ("US000", "5", "23", "1021", "N", "1", "2020", "1", "9000", "9", "9"), ("US000", "1", "23", "1021", None, "1", "2020", "1", "7000", "7", "7"),
    ]
    schema = ", ".join(f"{c} string" for c in cell)
    got = {(r.industry_type, r.industry_code, r.ref_date): (r.employment, r.vintage_date) for r in census.size_rows(spark.createDataFrame(rows, schema)).collect()}
    jan, feb, out = day("2020-01-12"), day("2020-02-12"), day("2020-08-01")
    assert got == {("sector", "22", jan): (2.0, out), ("sector", "22", feb): (0.0, out), ("supersector", "40", jan): (5.0, out), ("domain", "08", jan): (5.0, out), ("total", "05", jan): (5.0, out)}
    with pytest.raises(Exception, match="sizes of quarter 2"):
        census.size_rows(spark.createDataFrame([(*rows[0][:7], "2", *rows[0][8:])], schema)).collect()
    gone = [("US000", "5", "14", "22", None, "1", "2020", "1", "0", "", None), ("US000", "5", "14", "52", None, "1", "2020", "1", "3000", "-1", "0")]
    assert {(r.industry_type, r.industry_code) for r in census.bulk_rows(spark.createDataFrame(gone, schema)).collect()} == {("sector", "52"), ("supersector", "55"), ("domain", "05"), ("domain", "07"), ("domain", "08")}


@pytest.mark.parametrize("seed", range(3))
def test_least_squares_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    groups, rows = {}, []
    for g, missing in (("a", {2}), ("b", set()), (None, {0, 3}), ("c", {1})):
        x = rng.normal(1000, 3, (60, 4)) * [1, 10, 0.1, 100]
        y = x @ [1, -2, 30, 0.1] + rng.normal(0, 5, 60)
        hole = rng.random((60, 4)) < 0.05
        shown = [[None if j in missing else float("nan") if hole[i, j] and i % 2 else None if hole[i, j] else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
        rows += [(g, float(v), *r) for v, r in zip(y, shown)] + [(g, None, 1.0, 1.0, 1.0, 1.0)]
        used = [j for j in range(4) if j not in missing]
        keep = ~hole[:, used].any(axis=1)
        design = np.column_stack([np.ones(keep.sum()), x[np.ix_(keep, used)]])
        beta = np.linalg.lstsq(design - np.r_[0, design[:, 1:].mean(0)], y[keep], rcond=None)[0]
        beta[0] -= design[:, 1:].mean(0) @ beta[1:]
        rest = y[keep] - design @ beta
        cov = rest @ rest / (keep.sum() - len(beta)) * np.linalg.inv(design.T @ design)
        groups[g] = (["const", *[f"x{j}" for j in used]], beta, cov, 1 - rest @ rest / ((y[keep] - y[keep].mean()) ** 2).sum(), int(keep.sum()))
    rows += [("d", float(i), float(i % 7), 2.0 * (i % 7), 1.0 * i, None) for i in range(20)] + [("e", 1.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "g string, y double, x0 double, x1 double, x2 double, x3 double")
    got = {r.g: r for r in regression.least_squares(df, ["g"], "y", ["x0", "x1", "x2", "x3"]).collect()}
    for g, (names, beta, cov, r2, n) in groups.items():
        r = got[g]
        assert [c.name for c in r.coefficients] == names and r.n == n and not r.singular
        assert np.allclose([c.estimate for c in r.coefficients], beta, rtol=1e-5) and np.isclose(r.r2, r2)
        assert np.allclose(np.array(r.covariance), cov, rtol=1e-4, atol=1e-9 * np.abs(cov).max())
    assert got["d"].singular and got["d"].coefficients[0].estimate is None
    assert got["e"].n == 1 and [c.name for c in got["e"].coefficients] == ["const"] and got["e"].r2 == 0


def test_cell_arrays_refuse_a_cell_twice(spark):
    cells = spark.createDataFrame([(1, "a", 2.0), (1, "c", None), (1, "z", 1.0), (2, "b", 5.0)], "t int, code string, v double")
    index = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "code string, place int")
    got = {r.t: (r["mask"], r.v) for r in composite.cell_arrays(cells, index, ["t"], ["v"], 3).collect()}
    assert got == {1: ([True, False, True], [2.0, None, None]), 2: ([False, True, False], [None, 5.0, None])}
    with pytest.raises(Exception, match="(?i)duplicate"):
        composite.cell_arrays(cells.union(cells), index, ["t"], ["v"], 3).collect()


# ------------------------------------------------------------------ capture that is replayed


def sinks(spark, folder, names):
    """All files of the sinks, and the rows of the store."""
    kept = {str(p): p.stat().st_mtime_ns for n in names for p in Path(f"{folder}/{n}").rglob("*.parquet")}
    return kept, plain(store.read(spark, f"{folder}/store"))


def forget_last_commit(folder):
    """As if the last batch had died before it was committed."""
    last = max((p for p in Path(f"{folder}/offsets/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    Path(f"{folder}/offsets/commits/.{last.name}.crc").unlink(missing_ok=True)


def test_a_replayed_quarter_changes_no_sink(spark, small):
    folder = new_folder(spark, "quarters")
    landed = rebuild_queries._quarters(spark, small).withColumn("kind", F.lit("area")).unionByName(rebuild_queries._quarters(spark, small, 10).withColumn("kind", F.lit("size")))
    landed.coalesce(1).write.parquet(f"{folder}/landing")
    arrivals = spark.readStream.schema(landed.schema).parquet(f"{folder}/landing")
    run = lambda as_of: capture.capture_quarters(arrivals, f"{folder}/store", folder, f"{folder}/offsets", day(as_of)).awaitTermination()
    run("1996-08-15")
    names = ["pending", "drift", "runs"]
    before = sinks(spark, folder, names)
    assert {r.ref_date for r in store.read(spark, f"{folder}/store").collect()} == {day("1996-01-12"), day("1996-02-12"), day("1996-03-12")}
    forget_last_commit(folder)
    run("1996-08-15")
    assert sinks(spark, folder, names) == before
    landed.coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    run("1996-09-15")  # the same quarter is still the newest one: nothing is taken out of the second delivery
    assert spark.read.parquet(f"{folder}/pending/epoch=1").count() == 0 and sinks(spark, folder, ["none"])[1] == before[1]


def test_newest_quarters():
    """First prints come out 5 months after the last month of quarters 1 to 3, and 8 after that of quarter 4."""
    out = {"1996-07-31": (1995, 3), "1996-08-01": (1996, 1), "1996-10-31": (1996, 1), "1996-11-01": (1996, 2), "1997-02-01": (1996, 3), "1997-07-31": (1996, 3), "1997-08-01": (1997, 1)}
    assert {d: capture.newest_quarter(day(d)) for d in out} == out


def test_a_feed_fires_once_for_each_release(spark):
    folder = new_folder(spark, "feeds")
    schedule = spark.createDataFrame([(s, day(f"2020-0{m}-12"), 0, 0, day(f"2020-0{m + 1}-05")) for s in ("ces", "qcew") for m in (1, 2, 3)], "source string, ref_date date, revision int, benchmark_revision int, vintage_date date")
    fired = []

    def update(session, feed, when):
        fired.append((feed, when))
        rows = schedule.where((F.col("source") == feed) & (F.col("vintage_date") <= F.lit(when)))
        store.append(rows.withColumns({"seasonally_adjusted": F.lit(False), "employment": F.lit(1.0)}), f"{folder}/store")

    def deliver(*items):
        df = spark.createDataFrame([(f, day(p), day(r)) for f, p, r in items], "feed string, pub_date date, ref_date date").coalesce(1)
        df.write.mode("append").parquet(f"{folder}/landing")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/landing")
        capture.watch(stream, f"{folder}/store", schedule, folder, f"{folder}/offsets", update).awaitTermination()

    deliver(("ces", "2020-03-05", "2020-02-12"), ("ces", "2020-02-05", "2020-01-12"), ("qcew", "2020-02-05", "2020-01-12"))  # out of order: the newest day counts
    assert sorted(fired) == [("ces", day("2020-03-05")), ("qcew", day("2020-02-05"))]
    deliver(("ces", "2020-03-05", "2020-02-12"), ("qcew", "2020-02-05", "2020-01-12"))  # repeats, after a restart
    deliver(("other", "2020-05-05", "2020-04-12"))  # a feed without a schedule
    assert len(fired) == 2
    deliver(("ces", "2020-02-05", "2019-12-12"), ("qcew", "2020-04-05", "2020-03-12"))  # a late item of what is stored, and two months at once
    assert fired[2:] == [("qcew", day("2020-04-05"))]
    held = plain(store.read(spark, f"{folder}/store"))
    forget_last_commit(folder)
    capture.watch(spark.readStream.schema("feed string, pub_date date, ref_date date").parquet(f"{folder}/landing"), f"{folder}/store", schedule, folder, f"{folder}/offsets", update).awaitTermination()
    assert plain(store.read(spark, f"{folder}/store")) == held and set(fired) == {("ces", day("2020-03-05")), ("qcew", day("2020-02-05")), ("qcew", day("2020-04-05"))}

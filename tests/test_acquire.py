"""Acquisition jobs against plain Python on small frames."""

import datetime
import hashlib
import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from test_jobs import forget_last_commit, sinks
from tidemark.operators import census, estimates, evaluate, model_data, provider, regression, store
from tidemark.schemas import PANEL, VINTAGE, empty
from tidemark.storage import new_folder
from tidemark.streaming import capture

REGIONS, INDUSTRIES = ("1", "2", "3", "4"), tuple(f"{10 * n}" for n in range(1, 12))
CELLS = [(r, i) for r in REGIONS for i in INDUSTRIES]


def day(text):
    return datetime.date.fromisoformat(text)


def months(n, start=2020):
    return [datetime.date(start + m // 12, m % 12 + 1, 12) for m in range(n)]


def redistributed(weights, covered):
    out = list(weights)
    for n, (region, industry) in enumerate(CELLS):
        if covered[n] or out[n] == 0:
            continue
        w, out[n] = out[n], 0.0
        for group in ([m for m, c in enumerate(CELLS) if covered[m] and c[1] == industry], [m for m, c in enumerate(CELLS) if covered[m] and c[0] == region], [m for m in range(len(CELLS)) if covered[m]]):
            base = sum(out[m] for m in group)
            if base > 0:
                for m in group:
                    out[m] += w * out[m] / base
                break
        else:
            for m in group:
                out[m] += w / len(group)
    return [x / sum(out) for x in out]


def composite(rows, prints, least):
    """Dates to (level, weight date) of one provider, from (date, region, industry, employment, units) and census prints."""
    dates = sorted({r[0] for r in rows})
    at = {(d, (r, i)): (e, u) for d, r, i, e, u in rows}
    newest = {}
    for d, v, r, i, e in sorted(prints, key=lambda p: p[1]):
        newest[d, (r, i)] = e
    shares = {}
    for d in {k[0] for k in newest}:
        vector = [newest.get((d, c)) or 0.0 for c in CELLS]
        if dates[0] <= d <= dates[-1] and sum(vector) > 0:
            shares[d] = [x / sum(vector) for x in vector]
    if len(dates) < 2 or not shares:
        return {}
    level, out = 100.0, {}
    for n, d in enumerate(dates):
        of = max([x for x in shares if x <= d], default=min(shares))
        if n:
            growth = []
            for c in CELLS:
                (e, u), (p, q) = at.get((d, c), (None, 0)), at.get((dates[n - 1], c), (None, 0))
                growth.append(math.log(e) - math.log(p) if e and p and e > 0 and p > 0 and u >= least and q >= least else None)
            covered = [g is not None for g in growth]
            if not any(covered):
                break
            level *= math.exp(sum(w * g for w, g in zip(redistributed(shares[of], covered), growth) if g is not None))
        out[d] = level, of
    return out


def cell_rows(rng, dates, sparse):
    rows = [(d, r, i, float(rng.randint(0, 60)) if rng.random() < 0.95 else None, rng.randint(3, 12)) for d in dates for r, i in CELLS if rng.random() < sparse]
    return rows + [(d, "9", "10", 1e6, 99) for d in dates[::3]]  # a cell that the axes lack


ROWS = "provider string, geographic_type string, geographic_code string, industry_type string, industry_code string, ref_date date, employment double, n_units int"
CENSUS = "source string, geographic_type string, geographic_code string, industry_type string, industry_code string, ref_date date, vintage_date date, revision int, benchmark_revision int, employment double"


def test_composite_is_that_of_plain_python(spark):
    rng = random.Random(8)
    gappy = [d for d in months(18) if d.month != 5]
    files = {"full": cell_rows(rng, gappy, 0.9), "thin": cell_rows(rng, months(14), 0.08), "one": cell_rows(rng, months(1), 0.9), "early": cell_rows(rng, months(6, 2010), 0.9)}
    files["ends"] = [r for r in cell_rows(rng, months(8), 0.6) if r[0] != day("2020-05-12")] + [(day("2020-05-12"), "1", "10", 5.0, 1)]
    prints = [(d, datetime.date(d.year + 1, n, 1), r, i, rng.choice([None, 0.0, 3.0, 8.0, 40.0])) for d in months(18)[2::3] for n in (1, 6) for r, i in CELLS if rng.random() < 0.8]
    rows = spark.createDataFrame([(p, "region", r, "supersector", i, d, e, u) for p, file in files.items() for d, r, i, e, u in file], ROWS)
    census_rows = spark.createDataFrame([("qcew", "region", r, "supersector", i, d, v, 0, 0, e) for d, v, r, i, e in prints] + [("ces", "region", "1", "supersector", "10", day("2020-01-12"), day("2020-02-12"), 0, 0, 5.0)], CENSUS)
    got = {}
    for r in provider.composite_levels(rows, census_rows, CELLS, least=5).collect():
        got.setdefault(r.provider, {})[r.ref_date] = r.employment, r.weight_date, r.months_stale
    want = {p: composite(file, prints, 5) for p, file in files.items()}
    assert not want["one"] and not want["early"] and len(want["ends"]) == 4 and len(want["full"]) == len(gappy) and 1 <= len(want["thin"])
    assert {p: set(v) for p, v in got.items()} == {p: set(v) for p, v in want.items() if v}
    for p, levels in got.items():
        for d, (level, of, stale) in levels.items():
            assert level == pytest.approx(want[p][d][0], rel=1e-9)
            assert of == want[p][d][1] and stale == max(0, (d.year - of.year) * 12 + d.month - of.month)


def test_provider_panel_by_slice_and_by_cell(spark):
    rng = random.Random(3)
    cells = cell_rows(rng, months(5), 1.0)
    prints = [(d, day("2021-06-01"), r, i, float(rng.randint(1, 9))) for d in months(5)[1::2] for r, i in CELLS]
    rows = [("Cells", "region", r, "supersector", i, d, e, u) for d, r, i, e, u in cells]
    rows += [("Flat", "national", "00", "total", code, d, float(10 * (n + 1) + lift), None) for n, d in enumerate(months(4)) for code, lift in (("00", 0), ("05", 500))]
    rows += [("Bare", None, None, None, None, d, e, None) for d, e in zip(months(5), (4.0, 0.0, 6.0, None, 9.0))]
    rows += [("Unnamed", "national", "00", "total", "00", d, 5.0, None) for d in months(3)]
    slices = spark.createDataFrame([(p, "national", "00", "total", c) for p, c in (("Cells", "00"), ("Flat", "05"), ("Bare", "00"), ("Absent", "00"))], "provider string, geographic_type string, geographic_code string, industry_type string, industry_code string")
    census_rows = spark.createDataFrame([("qcew", "region", r, "supersector", i, d, v, 0, 0, e) for d, v, r, i, e in prints], CENSUS)
    out = provider.panel_rows(spark.createDataFrame(rows, ROWS), slices, census_rows, CELLS)
    assert out.dtypes == empty(spark, PANEL).dtypes
    got = {(r.source, r.period): r for r in out.collect()}
    levels = [x[0] for _, x in sorted(composite(cells, prints, 5).items())]
    want = {("cells", d): math.log(b / a) for d, a, b in zip(months(5)[1:], levels, levels[1:])}
    want |= {("flat", d): math.log(b / a) for d, a, b in zip(months(4)[1:], (510, 520, 530), (520, 530, 540))}
    want |= {("bare", months(5)[4]): math.log(9 / 6)}  # 0 has no logarithm; a null level is no row, so 9 follows 6
    assert set(got) == set(want)
    assert all(got[k].growth == pytest.approx(x) for k, x in want.items())
    one = got["flat", months(4)[1]]
    assert (one.industry_code, one.industry_level, one.vintage_date, one.revision_number, one.is_final, one.is_seasonally_adjusted, one.publication_lag_months, one.source_type) == ("05", "total", day("2020-03-04"), 0, True, False, 1, "payroll")
    assert provider.panel_rows(spark.createDataFrame([], ROWS), slices, census_rows, CELLS).count() == 0


def test_current_census_panel(spark):
    q = "area_fips string, own_code string, agglvl_code string, industry_code string, year string, qtr string, month1_emplvl string, month2_emplvl string, month3_emplvl string"
    rows = [
        ("US000", "5", "14", "23", "2020", "1", "100", "0", "121"), ("US000", "5", "14", "31-33", "2020", "1", "50", "x", "60"), ("US000", "5", "14", "102G", "2020", "1", "7", None, "-3"),
        ("US000", "2", "11", "10", "2020", "1", "10", "20", "40"), ("US000", "2", "11", "99", "2020", "1", "1000", "1000", "1000"), ("US000", "0", "10", "10", "2020", "1", "999", "999", "999"), ("US000", "5", "14", "10", "2020", "1", "9", "9", "9"),
        ("36000", "5", "54", "52", "2019", "4", "5", "10", "20.5"), ("36061", "5", "74", "52", "2019", "4", "5", "10", "20"), (None, "5", "74", "52", "2019", "4", "5", "10", "20"),
    ]
    out = census.current_panel(spark.createDataFrame(rows, q))
    assert out.dtypes == empty(spark, PANEL).dtypes
    got = {(r.geographic_code, r.industry_level, r.industry_code, r.period.month): (round(r.growth, 9), r.employment_level, r.vintage_date) for r in out.collect()}
    g = lambda a, b: round(math.log(b / a), 9)
    want = {}
    for level, code, values in (
        ("sector", "23", {1: 100, 3: 121}), ("supersector", "20", {1: 100, 3: 121}), ("sector", "31", {1: 50, 3: 60}), ("supersector", "30", {1: 50, 3: 60}), ("sector", "92", {1: 10, 2: 20, 3: 40}), ("supersector", "90", {1: 10, 2: 20, 3: 40}),
        ("domain", "06", {1: 150, 3: 181}), ("domain", "05", {1: 157, 3: 181}), ("domain", "00", {1: 167, 2: 20, 3: 221}), ("domain", "07", {1: 17, 2: 20, 3: 40}),
    ):
        for a, b in zip(list(values), list(values)[1:]):
            want["00", level, code, b] = g(values[a], values[b]), float(values[b]), datetime.date(2020, b + 5, 1)
    for level, code in (("sector", "52"), ("supersector", "55"), ("domain", "00"), ("domain", "05"), ("domain", "07"), ("domain", "08")):
        want["36", level, code, 11] = g(5, 10), 10.0, day("2020-07-01")
    assert got == want


STATE = "adjusted boolean, geographic_type string, geographic_code string, industry_type string, industry_code string, ref_date date, employment_initial double, employment_latest double"
DATES = "publication string, ref_date date, vintage_date date, revision int, benchmark_revision int"


def test_state_rows_and_repeated_keys(spark):
    at = day("2020-01-12")
    calendar = spark.createDataFrame([("sae", at, day("2020-03-01"), 0, 0), ("sae", at, day("2020-04-01"), 1, 0), ("sae", at, day("2021-03-01"), 1, 1), ("ces", at, day("2020-02-01"), 0, 0), ("sae", day("2020-02-12"), None, 0, 0)], DATES)
    rows = [(True, "state", "36", "supersector", "20", at, 1.0, 2.0), (True, "state", "36", "sector", "41", at, None, 3.0), (None, "state", "36", "domain", "06", at, 4.0, None), (True, "state", "36", "sector", "41", day("2020-02-12"), 5.0, 6.0)]
    got = sorted((r.industry_type, r.industry_code, r.revision, r.benchmark_revision, r.employment) for r in estimates.state_rows(spark.createDataFrame(rows, STATE), calendar).collect())
    twenty = [(0, 0, 1.0), (1, 0, 2.0), (1, 1, 2.0)]
    assert got == sorted([("supersector", "20", *x) for x in twenty] + [("sector", "23", *x) for x in twenty] + [("sector", "42", 1, 0, 3.0), ("sector", "42", 1, 1, 3.0), ("domain", "06", 0, 0, 4.0)])
    # sector 23 of its own meets the one that supersector 20 stands for
    twice = spark.createDataFrame([*rows, (True, "state", "36", "sector", "23", at, 9.0, None)], STATE)
    with pytest.raises(PySparkException, match="several rows of"):
        estimates.state_rows(twice, calendar).collect()
    nulls = spark.createDataFrame([(None, 1.0), (None, 2.0)], "k string, v double")
    with pytest.raises(PySparkException, match="several rows of"):
        estimates.unique(nulls, ["k"]).collect()
    assert estimates.unique(nulls.limit(0), ["k"]).count() == 0


def test_releases_on_a_benchmark_day(spark):
    dec, jan, feb = day("2019-12-12"), day("2020-01-12"), day("2020-02-12")
    calendar = spark.createDataFrame([("ces", dec, day("2020-01-10"), 0, 0), ("ces", dec, day("2020-02-07"), 1, 0), ("ces", dec, day("2020-02-07"), 2, 1), ("ces", jan, day("2020-02-07"), 0, 0)], DATES)
    levels = spark.createDataFrame([("00", True, d, v) for d, v in ((dec, 1.0), (jan, 2.0), (feb, 3.0))] + [("07", False, jan, 4.0), ("20", None, jan, 5.0)], "code string, seasonally_adjusted boolean, ref_date date, value double")
    out = estimates.survey_releases(levels, calendar)
    got = sorted((r.industry_type, r.ref_date, r.revision, r.benchmark_revision, r.employment) for r in out.collect() if r.revision is not None)
    assert got == [("domain", jan, 0, 0, 4.0), ("national", dec, 2, 1, 1.0), ("national", jan, 0, 0, 2.0), ("supersector", jan, 0, 0, 5.0)]
    assert out.where("ref_date = '2020-02-12' AND vintage_date IS NULL").count() == 1
    bare = out.drop("seasonally_adjusted", "vintage_date", "revision", "benchmark_revision").withColumn("more", F.lit(1))
    both = estimates.combine(out, bare)
    assert both.count() == 10 and both.columns == out.columns
    with pytest.raises(ValueError, match="ref_date"):
        estimates.combine(out, out.drop("ref_date"))


def test_status_of_a_store(spark):
    def row(source, adjusted, code, ref, level=5.0):
        return ("national", "00", None, "total", code, day(ref), day(ref) + datetime.timedelta(40), 0, 0, level, None, None, source, adjusted)

    rows = [row("ces", True, "00", "2019-10-12"), row("ces", True, "05", "2019-12-12"), row("ces", True, "00", "2020-01-12", -1.0), row("ces", True, "20", "2019-11-12"), row("qcew", False, "00", "2019-06-12"), row("ces", False, "00", "2010-01-12")]
    df = spark.createDataFrame(rows, VINTAGE)
    tokens = lambda as_of, **more: sorted((r.kind, r.token) for r in store.status(df, F.lit(as_of).cast("date"), **more).collect() if r.token)
    gap = [("missing", "2019-11")]
    # February's print is out on 2020-03-06, the third quarter's first print in February
    assert tokens("2020-03-05") == gap + [("uncaptured", "qcew:2019-Q3")]
    assert tokens("2020-03-06", shutdown=("2019-11",)) == [("missing", "2019-11 [known-shutdown]"), ("uncaptured", "ces:2020-02-01"), ("uncaptured", "qcew:2019-Q3")]
    # June's print came on 2020-07-03; the fourth quarter takes eight months, the first one five
    assert tokens("2020-08-01") == gap + [("uncaptured", f"ces:2020-0{m}-01") for m in (2, 3, 4, 5, 6)] + [("uncaptured", f"qcew:{q}") for q in ("2019-Q3", "2019-Q4", "2020-Q1")]
    assert tokens("2018-01-01") == gap  # seen from before the store's end
    held = {(r.source, r.seasonally_adjusted): (r.n_rows, r.first_ref, r.last_ref) for r in store.status(df, F.lit("2020-03-05").cast("date")).where("kind = 'coverage'").collect()}
    assert held["ces", True] == (4, day("2019-10-12"), day("2020-01-12"))
    assert store.status(empty(spark, VINTAGE), F.lit("2020-03-05").cast("date")).count() == 0


def test_model_rows_take_the_best_print_or_none(spark):
    def row(source, period, revision, growth, final=False, vintage="2020-06-01"):
        return ("a", source, day(period), revision, final, day(vintage) if vintage else None, growth)

    rows = [
        row("ces_sa", "2020-01-12", 0, 0.1), row("ces_sa", "2020-01-12", 2, 0.3), row("ces_sa", "2020-01-12", -1, 0.9, True),  # benchmark prints never count
        row("ces_sa", "2020-02-12", 0, 0.2), row("ces_sa", "2020-02-12", 1, None),  # the best print has no growth: a gap
        row("ces_nsa", "2020-03-12", 0, 0.5), row("ces_nsa", "2020-03-12", 1, 0.6, vintage="2020-07-01"),  # the second print came later
        row("ces_sa", "2020-05-12", -1, 0.7, True),  # on the calendar, but nothing counts
        row("qcew", "2020-01-12", 0, 0.11), row("qcew", "2020-01-12", 4, 0.12, None), row("qcew", "2020-02-12", 0, 0.2), row("qcew", "2020-06-12", 1, math.nan, True), row("qcew", "2020-06-12", 2, 0.4),
        row("pay", "2020-04-12", 0, 0.1, True, None), row("pay", "2020-06-12", -1, 0.2, True), row("pay", "2020-06-12", 2, 0.3, True),
    ]
    df = spark.createDataFrame(rows, "k string, source string, period date, revision_number int, is_final boolean, vintage_date date, growth double")
    got = {(r.source, r.period.month): r for r in model_data.assemble(df, ["k"], ["2020-02-01"], F.lit("2020-06-15").cast("date")).collect()}
    assert {k: (r.t, r.growth, r.revision_number) for k, r in got.items()} == {
        ("ces_sa", 1): (0, 0.3, 2), ("ces_nsa", 3): (2, 0.5, 0), ("qcew", 1): (0, 0.12, 4), ("qcew", 2): (1, 0.2, 0), ("pay", 4): (3, 0.1, 0), ("pay", 6): (5, 0.2, -1),
    }
    assert {k: (r.vintage_index, r.interior, r.noise, r.era) for k, r in got.items()} == {
        ("ces_sa", 1): (1, None, None, 0), ("ces_nsa", 3): (0, None, None, 1), ("qcew", 1): (None, False, 1.0, 0), ("qcew", 2): (None, True, 25.0, 1), ("pay", 4): (None, None, None, 1), ("pay", 6): (None, None, None, 1),
    }
    assert got["qcew", 2].level == pytest.approx(100 * math.exp(0.32)) and got["qcew", 2].month_index == 1 and got["qcew", 2].year_index == 0
    assert model_data.assemble(df.limit(0), ["k"], ["2020-02-01"]).count() == 0


def test_settled_changes_keep_to_the_calendar(spark):
    def row(ref, revision, level, benchmark=0, vintage="2020-06-01"):
        return ("a", day(ref), revision, benchmark, day(vintage), level)

    rows = [
        row("2020-01-12", 0, 10.0), row("2020-01-12", 2, 12.0), row("2020-01-12", 2, 99.0, 1), row("2020-02-12", 1, 15.0), row("2020-02-12", 1, 16.0, 0, "2020-07-01"),
        row("2020-04-12", 0, 20.0), row("2020-05-12", 0, 21.0), row("2020-05-12", 1, -1.0), row("2020-06-12", 0, None),
    ]
    df = spark.createDataFrame(rows, "k string, ref_date date, revision int, benchmark_revision int, vintage_date date, employment double")
    got = {r.month: r.change for r in evaluate.settled_changes(df, ["k"]).collect()}
    assert got == {day("2020-02-01"): 4.0, day("2020-05-01"): 1.0}  # March is missing: April has no change
    assert evaluate.settled_changes(df.limit(0), ["k"]).count() == 0


def test_diagnostics_by_type_are_least_squares(spark):
    rng = random.Random(5)
    rows = []
    for n, d in enumerate(months(60)):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append(("a", d, 2 + 0.5 * x - z + rng.gauss(0, 0.5), x if n % 9 else None, z, None, float(rng.choice([0, 0, 50]))))
    df = spark.createDataFrame(rows, "k string, month date, revision double, x double, z double, gone double, momentum double")
    got = {r.month_type: r for r in regression.revision_diagnostics(df, ["k"], "revision", ["x", "gone", "z"], "momentum").collect()}
    sizes = sorted(abs(r[2]) for r in rows)
    at = 0.9 * (len(sizes) - 1)
    bound = sizes[int(at)] + (at - int(at)) * (sizes[int(at) + 1] - sizes[int(at)])
    kind = lambda r: "large_revision" if abs(r[2]) >= bound else "turning_point" if r[6] >= 40 else "benchmark_window" if r[1].month == 2 else "normal"
    want = {"pooled": rows} | {k: [r for r in rows if kind(r) == k] for k in map(kind, rows)}
    want = {k: v for k, v in want.items() if k == "pooled" or len(v) > 5}
    assert set(got) == set(want) and {"normal", "turning_point"} <= set(want)
    for k, members in want.items():
        whole = [r for r in members if r[3] is not None]
        a, y = np.array([[1, r[3], r[4]] for r in whole]), np.array([r[2] for r in whole])
        beta, rest = np.linalg.lstsq(a, y, rcond=None)[:2]
        assert (got[k].n, got[k].n_months, list(got[k].missing)) == (len(whole), len(members), ["gone"])
        assert got[k].bias == pytest.approx(beta[0]) and got[k].r2 == pytest.approx(1 - rest[0] / ((y - y.mean()) ** 2).sum())
    gate = regression.diagnostics_gate(regression.revision_diagnostics(df, ["k"], "revision", ["x", "gone", "z"], "momentum"), ["k"]).collect()
    assert len(gate) == 1 and gate[0].pooled == got["pooled"].r2 and gate[0].fund_rebuild


def test_content_hash_by_another_implementation(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (-7, None), (3, "ü" * 40)]
    df = spark.createDataFrame(rows, "k long, name string").repartition(3)
    hashes = []
    for k, name in rows:
        h = 42 if k is None else xxhash.xxh64_intdigest(struct.pack("<q", k), seed=42)
        h = h if name is None else xxhash.xxh64_intdigest(name.encode(), seed=h)
        hashes.append(h - 2**64 if h >= 2**63 else h)
    x = 0
    for h in hashes:
        x ^= h
    got = store.content_hash(df.select("name", "k")).collect()[0]
    assert (got.n, got.hash) == (5, hashlib.sha256(f"5:{x}:{sum(hashes)}".encode()).hexdigest())


def test_a_replayed_survey_delivery_changes_no_sink(spark):
    folder = new_folder(spark, "survey")
    dates = [day("2019-11-12"), day("2019-12-12"), day("2020-01-12")]
    rows = [("ces", d, datetime.date(d.year + d.month // 12, d.month % 12 + 1, 7), 0, 0) for d in dates] + [("ces", dates[0], day("2020-01-10"), 1, 0), ("ces", dates[1], day("2020-02-07"), 2, 1), ("ces", dates[1], day("2020-02-07"), 1, 0)]
    calendar = spark.createDataFrame(rows, DATES)
    levels = lambda lift: spark.createDataFrame([(c, a, d, 10.0 * n + lift) for c in ("00", "06", "07") for a in (True, False) for n, d in enumerate(dates)], "code string, seasonally_adjusted boolean, ref_date date, value double")
    levels(0).coalesce(1).write.parquet(f"{folder}/landing")
    arrivals = spark.readStream.schema(levels(0).schema).parquet(f"{folder}/landing")
    run = lambda: capture.capture_survey(arrivals, calendar, f"{folder}/store", folder, f"{folder}/offsets", day("2020-02-07")).awaitTermination()
    run()
    names = ["pending", "drift", "unknown", "runs"]
    before = sinks(spark, folder, names)
    held = {(r.industry_type, r.industry_code, r.ownership, r.ref_date, r.revision, r.benchmark_revision, r.employment) for r in store.read(spark, f"{folder}/store").collect()}
    prints = [(dates[0], 1, 0, 0.0), (dates[1], 2, 1, 10.0), (dates[2], 0, 0, 20.0)]
    assert held == {(t, c, o, *p) for t, c, o in (("total", "00", "total"), ("domain", "06", "private")) for p in prints}
    assert spark.read.parquet(f"{folder}/unknown").count() == 6 and spark.read.parquet(f"{folder}/runs").select("n_rows", "n_new", "n_skipped").collect() == [(12, 12, 0)]
    forget_last_commit(folder)
    run()
    assert sinks(spark, folder, names) == before
    levels(1).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    run()  # all of it is stored, at other levels
    assert sinks(spark, folder, ["none"])[1] == before[1] and spark.read.parquet(f"{folder}/drift/epoch=1").count() == 12
    assert spark.read.parquet(f"{folder}/runs/epoch=1").collect() == [(12, 0, 12)]

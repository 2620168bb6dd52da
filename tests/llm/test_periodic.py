import hashlib
import re

import numpy as np
import pytest

from tidemark.llm import periodic, queries


def test_levels_are_few():
    """Each level loses a quarter of its symbols or so, whatever they are."""
    rng = np.random.default_rng(1)
    for s in (np.arange(20_000) % 9000, rng.integers(0, 5, 20_000), np.tile(np.arange(7000), 4), np.zeros(20_000, np.int64)):
        assert len(periodic.Grammar(s.astype(np.int64)).levels) < 100


def brute(words):
    """All maximal runs: for each period, stretches where words q apart are identical, each with its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if (made := periodic.planted(doc_id, len(words))) is not None:
        a, p = made
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def naive_lce(s, i, j):
    n = 0
    while j + n < len(s) and s[i + n] == s[j + n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_lce_against_comparing_symbols(seed):
    rng = np.random.default_rng(seed)
    part = rng.integers(0, rng.integers(1, 5), rng.integers(1, 40))
    s = np.concatenate([np.tile(part, rng.integers(1, 30)), rng.integers(0, 3, rng.integers(0, 60)), np.tile(part, 3), np.zeros(rng.integers(0, 50), np.int64)])
    grammar = periodic.Grammar(s.astype(np.int64))
    i, j = rng.integers(0, len(s), 400), rng.integers(0, len(s) + 1, 400)
    i, j = np.minimum(i, j), np.maximum(i, j)
    i, j = i[i < j], j[i < j]
    assert (grammar.lce(i, j) - i).tolist() == [naive_lce(s, a, b) for a, b in zip(i.tolist(), j.tolist())]
    assert len(grammar.levels[-1].symbols) < len(s) or len(np.unique(s)) == len(s) or len(s) < 2


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_several_texts_against_brute_force(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    if seed % 2:
        monkeypatch.setattr(periodic, "BLOCK_POINTS", 17)
    texts = []
    for _ in range(25):
        parts = [rng.integers(0, rng.integers(1, 6), rng.integers(0, 12)) for _ in range(3)]
        texts.append(np.concatenate([np.tile(p, rng.integers(0, 8)) for p in parts for _ in range(2)]).astype(np.int64))
    text, start, length, period = periodic.runs_of(np.concatenate(texts), np.array([len(t) for t in texts]))
    for k, t in enumerate(texts):
        mine = list(zip(start[text == k].tolist(), length[text == k].tolist(), period[text == k].tolist()))
        assert mine == brute(t.tolist())


def test_no_texts_and_short_ones():
    for n in ([], [0], [0, 0], [5], [1, 0, 3]):
        assert all(len(x) == 0 for x in periodic.runs_of(np.zeros(sum(n), np.int64), np.array(n, dtype=np.int64)))


ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (5, "a a a a a a"), (6, "x\ta b a b\na b a b y"), (None, "a b c a b c a b c a b c"), (6, "q " * 5000),
    (7, "a b a b \x1ca \x85 " + "u v " * 300 + "w " * 9 + "u v " * 9), (8, "one two three four " * 400 + "end"), (9, " ".join(str(i % 97) for i in range(9000))), (9, " ".join(str(i % 97) for i in range(9000))),
]


def test_odd_rows_ties_and_extra_columns(spark):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in ROWS], "doc_id long, text string, start string, n_runs int")
    got = [(r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in periodic.report(df, plant=periodic.planted).collect()]
    assert sorted(got, key=repr) == sorted(((i, expected(i, t)) for i, t in ROWS), key=repr)
    out = {r.doc_id: r for r in periodic.collapse(df.where("doc_id IN (3, 6, 8)")).collect()}
    assert [tuple(x) for x in out[8].runs] == [(0, 1600, 4)] and out[8].text == "one two three four end"
    assert out[3].runs == [] and out[3].text == ""


def test_empty_table(spark):
    assert periodic.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_against_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op13_periodic_runs(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(r.doc_id, texts[r.doc_id]), r.doc_id
    assert sum(r.n_runs > 0 for r in got) > 5

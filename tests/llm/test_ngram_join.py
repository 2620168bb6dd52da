import random
import re

import numpy as np
import pytest

from tidemark.llm import components, ngram_join, queries


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected(docs):
    """Components by comparing all pairs."""
    sets, parent = {k: grams(t) for k, t in docs}, {k: k for k, _ in docs}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: (len(sets[k]), root(k)) for k in keys}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_against_all_pairs(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = expected(docs)
    assert result(queries.op2_ngram_join(spark, small)) == want
    assert len({c for _, c in want.values()}) < len(want)


def planted(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(14):
        n = rng.choice([1, 4, 6, 9, 15, 22, 30, 50, 70, 120, 300, 700])
        text = [rng.choice(words) for _ in range(n)]
        for _ in range(rng.randint(1, 14)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, n // 30))):
                what, at = rng.random(), rng.randrange(len(copy))
                if what < 0.4:
                    copy[at] = rng.choice(words)
                elif what < 0.7 and len(copy) > 1:
                    del copy[at]
                else:
                    copy[at:at] = [rng.choice(words)] * rng.randint(1, 3)
            docs.append((len(docs) * 3 - 20, " ".join(copy)))
            if rng.random() < 0.3:
                text = copy  # chains
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_chains_against_all_pairs(spark, seed):
    docs = planted(seed)
    assert result(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == expected(docs)


def test_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    docs = planted(7) + [(1000 + i, t) for i, (_, t) in enumerate(planted(7)[:20])]
    assert result(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"))) == expected(docs)


def crowd(n, seed=3):
    """Near copies of one text: a third links with it, the others have too many changes of their own to link with any."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(5, 145), 2 if i % 3 == 0 else 8):
            text[at] = f"n{i}x{at}"
        docs.append((i, " ".join(text)))
    return docs


def test_places_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "_common", lambda docs: np.zeros(0, np.uint64))
    made, real = {}, ngram_join._verify

    def counted(docs, places, name):
        made[name] = made.get(name, 0) + places.distinct().count()
        return real(docs, places, name)

    monkeypatch.setattr(ngram_join, "_verify", counted)
    rows = []
    for n in (90, 180):
        made.clear()
        docs = crowd(n)
        assert result(ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"))) == expected(docs)
        rows.append((made["stars"], made.get("large", 0)))
    (few, late), (more, later) = rows
    assert few > 90 and later <= 180 and late + few > 0 and more + later <= 3 * (few + late)


def test_ids_of_several_texts_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    docs = crowd(60) + planted(7)
    docs = [(i * 2**50 - 2**55 if i % 7 else i, t) for i, t in docs]  # gaps of every width
    bridge = [(docs[1][0], docs[62][1]), (docs[1][0], ""), (docs[2][0], docs[3][1] + " tail"), (docs[4][0], docs[4][1])]
    got = ngram_join.join(spark.createDataFrame(docs + bridge, "doc_id long, text string")).collect()
    numbered = [((i, n), t) for n, (i, t) in enumerate(docs + bridge)]
    component = {k: c[0] for k, (_, c) in expected(numbered).items()}
    ids, links = {i for i, _ in docs}, {(k[0], c) for k, c in component.items()}
    parent = {i: i for i in ids}
    for _ in ids:  # texts of one id are one node
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {(r.doc_id, r.component_id) for r in got} == set(parent.items())


def test_reach_never_cuts_a_link(spark):
    docs = planted(4) + crowd(30)
    docs = [(n, t) for n, (_, t) in enumerate(docs) if t]
    frame = spark.createDataFrame(docs, "id long, text string")
    reach = {r.id: (r.low, r.reach) for r in ngram_join._reach(frame, frame.select("id")).collect()}
    sets = {k: ngram_join.shingles(t) for k, t in docs}
    assert set(reach) == set(sets) and all(reach[k][0] == len(s) for k, s in sets.items())
    for a in sets:
        for b in sets:
            if a != b and ngram_join.linked(sets[a], sets[b]):
                assert reach[a][0] <= reach[b][1] and reach[b][0] <= reach[a][1]
    assert sum(low > far for low, far in reach.values()) >= 20  # those with too many n-grams of their own


def test_signatures_are_packed(spark):
    docs = planted(5)
    batch = spark.createDataFrame(docs, "id long, text string").coalesce(1).toArrow().combine_chunks().to_batches()
    sent = [r for b in ngram_join._send(batch, 8, np.zeros(0, np.uint64)) for r in b.to_pylist() if r["part"] >= 0]
    n = sum(len(ngram_join._unpacked(*list(r.values())[1:])[0]) for r in sent)
    assert sum(len(v) for r in sent for v in list(r.values())[1:]) < 7.5 * n
    ids = np.array([-(2**63), -5, -5, 0, 3, 2**40, 2**63 - 1])
    for some in (ids, ids[1:], ids[1:5], ids[:1], ids[4:6]):
        sigs, probes = ngram_join._mix(some.view(np.uint64)), some % 2 == 0
        got = ngram_join._unpacked(*ngram_join._packed(sigs, probes, some))
        assert (got[0] == sigs >> np.uint64(17)).all() and (got[1] == probes).all() and (got[2] == some).all()


def test_sets_without_allocation_are_joined_by_all_ngrams(spark, monkeypatch):
    docs = planted(5)
    real = ngram_join._signatures

    def refuse(sets, chosen, band, need, index):  # pretend that no set of 20 n-grams or more finds an allocation
        large = chosen & (sets.size >= 20)
        sigs, owners, flags, failed = real(sets, chosen & ~large, band, need, index)
        return sigs, owners, flags, np.union1d(failed, np.flatnonzero(large))

    sent = []
    for batch in spark.createDataFrame(docs, "id long, text string").toArrow().to_batches():
        monkeypatch.setattr(ngram_join, "_signatures", refuse)
        sent += list(ngram_join._send([batch], 8, np.zeros(0, np.uint64)))
    assert any(-9 in b.column(0).to_pylist() for b in sent)
    monkeypatch.undo()
    frame = spark.createDataFrame(docs, "id long, text string")
    got = {(r.a, r.b) for r in ngram_join._by_all_ngrams(frame, frame.select("id")).collect()}
    sets = {k: grams(t) for k, t in docs}
    assert got == {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]}


def test_cases(spark):
    long = " ".join(f"x{i}" for i in range(300))
    docs = [(1, None), (2, ""), (3, "  \t"), (12, "  \t"), (4, "A b"), (5, "a  B"), (6, "é a"), (7, "É a"), (8, long), (9, long.upper()), (9, "other text"), (None, long), (10, long + " tail"), (11, "x " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n_shingles", "3 AS component")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (12, 0, 12), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 296, 8), (9, 296, 8), (9, 1, 8), (None, 296, None), (10, 297, 8), (11, 1, 11)]
    assert got == sorted(want, key=repr)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 12, 4, 6, 7, 8, None, 11], key=repr)
    assert ngram_join.join(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (50, 50), (None, 3), (60, 61), (61, 60)], "a long, b long")
    got = {r.id: r.component for r in components.connected(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 60: 60, 61: 60}

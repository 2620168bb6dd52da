import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import queries, repeats


def expected(texts):
    """Brute force over all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 1, np.int32)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                hit[i] += 1
                hit[i + 200] -= 1 if i + 200 <= len(d) else 0
        gone = np.cumsum(hit[:-1]) > 0
        kept = bytes(x for x, g in zip(d, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(6)]
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
                parts.append(p[a:b] if rng.random() < 0.5 else p)
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(1, 60))))
        text = rng.choice(["", " "]).join(parts)
        if text and rng.random() < 0.3:
            i = rng.randrange(len(text))
            text = text[:i] + "Z" + text[i + 1 :]
        docs.append(text)
    return docs + ["ab" * 400, "a" * 199, "a" * 200, "xyz" * 67, docs[0], docs[1]]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [repeats.HOT_RUNS, 3])
def test_planted_against_brute_force(spark, monkeypatch, seed, hot):
    docs = planted(seed)
    want = dict(enumerate(expected(docs)))
    assert sum(x[1] > 0 for x in want.values()) > 20
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    if hot == 3:  # in the workers: bind the smaller bound into what is sent there
        original = repeats._meet

        def meet(table):
            repeats.HOT_RUNS = 3
            return original(table)

        monkeypatch.setattr(repeats, "_meet", meet)
    assert result(repeats.remove(frame).collect()) == want


def test_whole_table_against_brute_force(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    want = dict(zip([i for i, _ in docs], expected([t for _, t in docs])))
    assert result(queries.op9_repeats(spark, small).collect()) == want


def test_cases(spark):
    long = "né" * 200
    docs = [(1, None), (2, ""), (3, long + "1"), (3, long + "1"), (None, "q" + long), (4, "short"), (4, "short"), (5, "x" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS marks")
    rows = repeats.remove(df, with_bytes=True).collect()
    want = expected([t for _, t in docs])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=repr)
    assert got == sorted([(i, *w) for (i, _), w in zip(docs, want)], key=repr)
    assert {bytes(r.kept) for r in rows if r.doc_id is None} == {b"q"}
    assert repeats.remove(df.limit(0)).count() == 0

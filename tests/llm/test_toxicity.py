import itertools
import zlib

import numpy as np

from tidemark.llm import queries
from tidemark.llm import toxicity as T

MODEL = T.ToxicityModel({"bad": 6.0, "worse": 9.0, "vile*": 7.0}, -5.0, ((0.3, -1.0), (0.2, 1.1)))


def brute(tokens):
    """Marginals by all label sequences."""
    weights = [Tagger.weight(t) for t in tokens]
    total, toxic = 0.0, np.zeros(len(tokens))
    for path in itertools.product((0, 1), repeat=len(tokens)):
        score = sum(MODEL.transitions[a][b] + b * (MODEL.bias + w) for a, b, w in zip((0, *path), path, weights))
        total += np.exp(score)
        toxic += np.exp(score) * np.array(path)
    return toxic / total


Tagger = MODEL.tagger()


def test_marginals_are_exact():
    tokens = "a bad b c Vilest, worse! d e bad".split()
    at, got = Tagger.marginals(tokens)
    assert at == [1, 4, 5, 8] and np.allclose(got, brute(tokens)[at])


def test_cases(spark):
    texts = [None, "", "  ", "fine text", "so worse  viles here", "x " * 20000 + "worse", "worse"]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(6, "worse", 0.5)], "doc_id long, text string, score double").selectExpr("*", "1 AS id")
    got = [r for r in T.tag(df, MODEL).collect()]
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert by[0].score == by[1].score == by[3].score < 0.1 and not by[3].spans
    assert [(s.start, s.stop) for s in by[4].spans] == [(3, 15)]
    assert by[5].spans[0].start == 40000
    kept = T.keep_clean(df, MODEL)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3}
    assert T.tag(df.limit(0), MODEL).count() == 0
    assert not T.fit(df, spark.createDataFrame([], "doc_id long, toxic int")).weights


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op5_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in got)
    test = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    right = sum(a == b for a, b in test) / len(test)
    assert right >= 0.93, right
    assert sum(a for a, b in test if b == 0) <= 0.01 * len(test)

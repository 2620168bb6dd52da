import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same  # noqa: E402

from tidemark.llm import decontamination as D  # noqa: E402
from tidemark.llm import queries  # noqa: E402

LONG = "Alpha beta GAMMA delta, epsilon; zeta eta theta iota kappa lambda mu"


def test_against_sql(spark, small):
    got = same(spark, "op3_decontamination", queries.queries(), queries.oracle_sql(), small)
    assert got.contaminated.any() and not got.contaminated.all()


@pytest.mark.parametrize("bound", [D.BROADCAST_WINDOWS, 0])
def test_cases(spark, monkeypatch, bound):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", bound)
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, f"x {LONG.lower()} y"), (4, "only three words"), (4, "only three words"), (5, "Only  THREE-words here"), (6, "Éa b"), (7, "éa b"),
         (None, LONG), (8, "alpha " * 4000), (4, LONG)],
        "doc_id long, text string",
    ).selectExpr("*", "1 AS id", "2 AS words")
    bench = spark.createDataFrame([(1, LONG), (2, None), (3, ""), (4, "only three words"), (5, "éa B"), (11, LONG)], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in D.report(docs, bench).collect()), key=repr)
    assert got == sorted(
        [(1, 0, 0, 0), (2, 0, 0, 0), (3, 14, 12, 2), (4, 3, 3, 1), (4, 3, 3, 1), (5, 4, 3, 1), (6, 2, 0, 0), (7, 2, 2, 1), (None, 12, 12, 2), (8, 4000, 0, 0), (4, 12, 12, 2)],
        key=repr,
    )
    kept = D.remove(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 8] and kept.columns == docs.columns
    spans = {(r.doc_id, r.text) for r in D.remove(docs, bench, what="spans").collect()}
    assert (3, "x y") in spans and (5, "here") in spans and (6, "Éa b") in spans and (1, None) in spans
    assert D.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert D.report(docs.limit(0), bench).count() == 0


def test_clashing_names_and_long_overlaps(spark):
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words), 7), (2, "w1 w2 other", 8), (None, None, 9)], "doc_id long, text string, hit_id int").selectExpr("*", "1 AS hit_digest", "2 AS hit_at")
    bench = spark.createDataFrame([(1, " ".join(words[:2990])), (2, " ".join(words[5:40]))], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in D.report(docs, bench).collect()}
    assert got == {1: (2990, 2), 2: (0, 0), None: (0, 0)}
    cut = D.remove(docs, bench, what="spans")
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == {1: " ".join(words[2990:]), 2: "w1 w2 other", None: None}

import numpy as np

from tidemark.llm import queries, site_quality


def test_held_out_accuracy_and_shrinkage(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights = site_quality.fit(docs, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in site_quality.judge(docs, weights).collect()}
    test = [(got[r.doc_id].kept, r.quality == 1) for r in labels.where("doc_id % 3 = 1").collect()]
    assert np.mean([a == b for a, b in test]) >= 0.9
    assert np.mean([a for a, b in test if b]) >= 0.97
    prior = np.mean([r.evidence for r in got.values()])
    sites = {}
    for r in docs.select("doc_id", "source").collect():
        sites.setdefault(r.source, []).append(got[r.doc_id])
    for rows in sites.values():  # each rate lies between the site's own mean and the whole
        own = np.mean([r.evidence for r in rows])
        assert min(own, prior) - 1e-9 <= rows[0].host_rate <= max(own, prior) + 1e-9


def test_cases(spark):
    texts = [None, "", "plain words of a text that goes on", "### $$$ %%%", "x"]
    df = spark.createDataFrame([(i, t, None if i < 2 else "h", "p") for i, t in enumerate(texts)] + [(4, "x", "h", None)], "doc_id long, text string, source string, lang string")
    df = df.selectExpr("*", "1 AS n", "2 AS chars", "3 AS x", "4 AS id")
    labels = spark.createDataFrame([(2, 1), (3, 0), (99, 1)], "doc_id long, quality int")
    for w in (site_quality.fit(df, labels), site_quality.fit(df, labels.where("quality = 1")), site_quality.fit(df, labels.limit(0))):
        rows = site_quality.judge(df, w).collect()
        assert len(rows) == 6 and all(0 < r.quality < 1 and r.kept == (r.quality >= 0.5) for r in rows)
    assert site_quality.judge(df.limit(0), w).count() == 0


def test_query_covers_the_table(spark, small):
    got = queries.op4_site_quality(spark, small)
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()

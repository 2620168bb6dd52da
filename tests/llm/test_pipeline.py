import hashlib
import re
import sys
from pathlib import Path

import public_tokenizers as P
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_byte_bpe import expected as token_ids  # noqa: E402
from test_ngram_join import expected as components  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidemark.llm import personal_data, toxicity  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def words(text):
    return tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def windows_of(texts):
    """Windows of ten words, or whole shorter items, by their lengths."""
    out = {}
    for ws in map(words, texts):
        for i in range(max(1, len(ws) - 9) if ws else 0):
            out.setdefault(len(ws[i : i + 10]), set()).add(ws[i : i + 10])
    return out


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    windows = windows_of(r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect())
    path = str(Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")).parent / "pipeline-test")
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, small).write.parquet(f"{path}/{n}")
        after = spark.read.parquet(f"{path}/{n}")
        got = {r.doc_id: r for r in after.collect()}
        kept.append(len(got))
        if name != "byte_bpe":
            assert after.columns == columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{small}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
            tagger = toxicity.fit(docs, labels).tagger()
            assert set(got) == {i for i, t in before.items() if tagger.document(t)[0] < 0.7}
        elif name == "ngram_join":
            assert set(got) == {c for _, c in components(list(before.items())).values()}
        elif name == "decontamination":
            hit = set()
            for i, text in before.items():
                ws = words(text)
                if any(ws[k : k + n_words] in own for n_words, own in windows.items() for k in range(len(ws) - n_words + 1)):
                    hit.add(i)
            assert hit and set(got) == set(before) - hit
        elif name == "personal_data":
            assert set(got) == set(before)
            for i, r in got.items():
                assert r.n_chars == len(r.text) and (r.text == before[i]) == (not personal_data.base_spans(before[i])) or r.text != before[i]
                assert not [s for s in personal_data.base_spans(r.text) if s[0] in (0, 3)]
        else:
            assert set(got) == set(before)
            for i, r in got.items():
                assert r.ids == token_ids(before[i]) and r.decoded_sha256 == hashlib.sha256(before[i].encode()).hexdigest()
        docs = after
    assert kept[0] > kept[2] >= kept[3] == kept[4] > 0
    assert P.PATTERN and corpus_pipeline.run(spark, small).count() == kept[-1]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, small, name, stage):
    """Null and empty texts, null ids, repeated rows and an extra column with a helper's name pass every stage; an empty table stays empty."""
    text = "one plain sentence that nobody wrote before in this table, of some more words"
    odd = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "a lone text", None, None, 11), (7, text, "en", None, len(text)), (7, text, "en", None, len(text))]
    docs = spark.createDataFrame(odd, spark.read.parquet(f"{small}/documents.parquet").schema).withColumn("hit_id", F.lit(5))
    after = stage(spark, docs, small)
    ids = sorted(((r.doc_id or -1) for r in after.select("doc_id").collect()))
    assert ids == [-1, 1, 2, 7, 7] if name != "ngram_join" else ids in ([-1, 1, 2, 7], [-1, 1, 2, 7, 7])
    if name != "byte_bpe":
        assert after.columns == docs.columns
        assert {r.doc_id: r.text for r in after.collect()}[1] is None
    assert stage(spark, docs.limit(0), small).count() == 0

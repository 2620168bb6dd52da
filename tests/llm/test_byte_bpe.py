import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from tidemark.llm import byte_bpe, queries

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a", "x\n y", "x \ny", "it's we'll I'd", "1234 56", "a b", "　　x",
    "tab\t\ttab \t end\t", "näive éè \U0001f600\U0001f600 !!", "x" * 5000, "the " * 3000, " \n \n ", "\r\n\r\n", "don't  'sit",
]


RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def expected(text):
    return LIBRARY.encode_ordinary(text or "")


def test_odd_texts_ties_and_extra_columns(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, ids string, id int")
    got = {r.doc_id: r.ids for r in byte_bpe.encode(df, VOCABULARY, P.PATTERN).collect()}
    assert got == {i: expected(t) for i, t in enumerate(ODD)}
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(byte_bpe.encode(df, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}


def test_repeated_rows_null_ids_and_a_small_memory(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 3)
    byte_bpe.codec.cache_clear()
    rows = [(None, "a b a b"), (None, "a b a b"), (1, "x y z w v u t s"), (1, "x y z w v u t s"), (1, None)]
    got = [(r.doc_id, r.ids) for r in byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, P.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(((i, expected(t)) for i, t in rows), key=repr)
    codec = byte_bpe.ByteBpe(VOCABULARY, P.PATTERN)
    text = " ".join(f"wörd{i % 11} and{i}" for i in range(500))
    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == expected(text) == np.frombuffer(codec.encode([text])[0], "<u4").tolist()
    assert codec.encode([]) == [] and len(codec.words) == 0


def test_empty_table(spark):
    assert byte_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, P.PATTERN).count() == 0


def test_whole_table_against_the_library(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op6_byte_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = expected(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))

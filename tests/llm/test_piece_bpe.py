import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from tidemark.llm import piece_bpe, queries

MODEL = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a", "\r\n);\r x", "\t\tx", "▁", "▁a", "a▁▁b", "a\x00b", "<s> </s> <unk> <0x0A>", "é ́x àb",
    "日本語 テスト　ﬁ \U0001f600\U0001f600", "x" * 5000, "the " * 3000, " " * 700 + "a" + " " * 33, "ab" * 3000, "�﻿a", "⁇ ⁇", "ⴰⵣⵓⵍ 𒀀𒀁", "-" * 300 + "=" * 299, "base64" + "QUJDRA==" * 900,
]


def ids_of(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_odd_texts_ties_and_extra_columns(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, ids string, id int")
    coded = piece_bpe.encode(df, MODEL).cache()
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: LIBRARY.encode(t or "") for i, t in enumerate(ODD)}
    assert {r.doc_id: r.text for r in piece_bpe.decode(coded, MODEL).collect()} == {i: LIBRARY.decode(LIBRARY.encode(t or "")) for i, t in enumerate(ODD)}


@pytest.mark.parametrize("rounds", [0, 1, 3, piece_bpe.MAX_ROUNDS, 10_000])
def test_random_texts_whatever_the_rounds(monkeypatch, rounds):
    """Rounds alone, the heap alone and both give the library's ids."""
    monkeypatch.setattr(piece_bpe, "MAX_ROUNDS", rounds)
    model, rng = piece_bpe.PieceBpe(MODEL), np.random.default_rng(rounds)
    alphabets = ["ab ", "aeiou thns", "   \n\r);{}\t*/", "-=_.<>/ ", "日本語漢字の ", "éàß ſŉ ", "0123456789 ,.", "".join(map(chr, range(1, 0x400))), "▁ a▁"]
    texts = ["".join(rng.choice(list(a), rng.integers(1, 60))) for a in alphabets for _ in range(300)]
    for text, raw in zip(texts, model.encode(texts)):
        assert ids_of(raw) == LIBRARY.encode(text), repr(text)


def test_joined_pieces_in_one_word():
    """Words made of pieces: many pairs whose merge makes an earlier pair."""
    model, rng = piece_bpe.PieceBpe(MODEL), np.random.default_rng(5)
    pieces = [p for p in map(LIBRARY.id_to_piece, range(259, 32000)) if len(p) > 2]
    texts = ["".join(rng.choice(pieces, rng.integers(2, 12))) for _ in range(3000)] + ["".join(rng.choice(pieces[:40], 30)) for _ in range(500)]
    for text, raw in zip(texts, model.encode(texts, end=True)):
        assert ids_of(raw) == [*LIBRARY.encode(text), 2], repr(text)
        assert model.decode(ids_of(raw)) == LIBRARY.decode(LIBRARY.encode(text))


def test_small_flats_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(piece_bpe, "FLAT_CHARS", 7)
    monkeypatch.setattr(piece_bpe, "CACHE_ENTRIES", 5)
    model = piece_bpe.PieceBpe(MODEL)
    for at in range(0, 200, 20):
        texts = [f"wörd{i % 11} and{i} — " * 3 for i in range(at, at + 20)]
        assert [ids_of(x) for x in model.encode(texts)] == [LIBRARY.encode(t) for t in texts]
    assert model.encode([]) == []


def test_bytes_that_are_no_text():
    model = piece_bpe.PieceBpe(MODEL)
    for ids in ([3 + 0xE3], [3 + 0x20, 264], [1, 264, 2], [3 + 0xE3, 3 + 0x81, 264], []):
        assert model.decode(ids) == LIBRARY.decode(ids), ids


def test_null_ids_repeated_rows_and_an_empty_table(spark):
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, "x"), (1, "x")]
    got = [(r.doc_id, r.ids) for r in piece_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, end=True).collect()]
    assert sorted(got, key=repr) == sorted(((i, [*LIBRARY.encode(t or ""), 2]) for i, t in rows), key=repr)
    assert piece_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_whole_table_against_the_library(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op12_piece_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()

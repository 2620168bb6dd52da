import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tidemark.llm import queries, token_store
from tidemark.llm._shared import new_folder

VOCABULARY = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)


def expected(texts):
    start, out = 0, {}
    for key, text in texts:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        out[key] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    return out


def test_random_access_and_levels():
    ids = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32)
    ids[::3] %= 200
    one = token_store.TokenFile(token_store.pack([1, None], [4000, 1000], ids))
    assert one.doc_ids == [1, None] and one.lengths.tolist() == [4000, 1000]
    assert (one.all() == ids).all()
    assert [one.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
    assert token_store.TokenFile(token_store.pack([], [], np.zeros(0, np.uint32))).all().tolist() == []


def test_odd_texts_and_extra_columns(spark):
    texts = [
        None, "", " ", "Don't STOP!? 1234", "Éñß İstanbul Σίσυφος ΑΣ", "é ́x àb", "<|endoftext|> x<|startoftext|>", "\tA B C\r\nD",
        "日本語 テスト ﬁ", "a<|endoftext|>日本", "b <|startoftext|>\nc", "Ɓɓ Ⱥx, ɓ, ſ ŉ ²½ 3 ª", "“quoted” it’s — x", "a\u2028b", "x" * 3000, "word " * 3000, "'s 'S it'LL we're ''s !'s", "\x00\x1c\x85 a", "ｱ ǅ ẞ Ω K",
    ]
    df = spark.createDataFrame([(i * 3 - 4, t, 5, "p") for i, t in enumerate(texts)], "doc_id long, text string, start int, part string")
    path = new_folder(spark, "tokens")
    token_store.write(df.repartition(3), path, VOCABULARY)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read(spark, path).collect()}
    assert got == expected([(i * 3 - 4, t) for i, t in enumerate(texts)])


def test_all_plain_characters_against_the_library():
    encoder = token_store.WordEncoder(VOCABULARY)
    rng = np.random.default_rng(3)
    chars = [*map(chr, range(0x250)), *"''''  <|>stelmdv"]
    texts = ["".join(rng.choice(chars, 40)) for _ in range(3000)] + ["a" * 40 + chr(i) for i in range(0x260)]
    for text, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, encoder.kind).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_and_odd_texts_leave_later_plain_texts_alone():
    encoder = token_store.WordEncoder(VOCABULARY)

    def check(texts):
        for text, raw in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(raw, encoder.kind).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)

    check(["d<|endoftext|>"])
    check(["hello", "a b<|endoftext|>", "<|endoftext|>", "world"])
    check(["hello world", "hello", "world"])
    rng = np.random.default_rng(11)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "</w>", "\u0130", "i\u0307", "a", "d", "hello", "World", " ", "  ", "\n", "'s", "1", "é", "日", "\u0301", "!", "x" * 50, "\x00", "\u2028"]
    for _ in range(1000):  # 50,000 texts in batches of changing size, the same words again and again
        batch = ["".join(rng.choice(parts, rng.integers(0, 6))) for _ in range(rng.integers(1, 100))]
        check(batch)
    check(["hello world a d 's 1 é !"])


def test_small_memory_changes_nothing(monkeypatch):
    texts = [f"w{i} x{i % 7} common" for i in range(300)]
    monkeypatch.setattr(token_store, "CACHE_ENTRIES", 16)
    encoder = token_store.WordEncoder(VOCABULARY)
    for at in range(0, 300, 30):
        for text, raw in zip(texts[at : at + 30], encoder.encode(texts[at : at + 30], 1)):
            assert np.frombuffer(raw, encoder.kind).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 1]


def test_null_ids_repeated_rows_and_ties(spark):
    rows = [(None, "b c"), (None, "a"), (4, "x"), (4, "x"), (4, None), (2, "y " * 50), (9, "")]
    path = new_folder(spark, "tokens")
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), path, VOCABULARY)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read(spark, path).collect()))
    at, want = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((at, key, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_empty_table(spark):
    path = new_folder(spark, "tokens")
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), path, VOCABULARY)
    assert token_store.read(spark, path).count() == 0


def test_whole_table_against_the_library(spark, small):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_store(spark, small).collect()}
    assert got == expected(texts)

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, queries
from tidemark.llm.alignment import Fragment, Tokens, compose, fragment

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True


def b_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def a_bytes():
    # the library's own decoder, one id at a time, gives the bytes where they are text; the others follow from its alphabet
    table = alignment._byte_characters()
    return {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in A.get_vocab().items()}


A_BYTES = a_bytes()


def brute(texts):
    """Per text (n_a, n_b, n_groups, links as a counter, groups), by comparing all byte ranges."""
    out = []
    for text in texts:
        found = (0, 0, 0, Counter(), "")
        if text:
            raw = (" " + text).encode()
            a = [(i, A_BYTES[i]) for i in A.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, b_bytes(i)) for i in B.encode(text)]
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                spans = []
                for tokens in (a, b):
                    at, some = 0, []
                    for i, x in tokens:
                        some.append((i, at, at + len(x)))
                        at += len(x)
                    spans.append(some)
                common = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
                groups, start, links = [], 0, Counter()
                p = q = 0
                for end in common:
                    mine = [[], []]
                    while p < len(spans[0]) and spans[0][p][2] <= end:
                        mine[0].append(spans[0][p])
                        p += 1
                    while q < len(spans[1]) and spans[1][q][2] <= end:
                        mine[1].append(spans[1][q])
                        q += 1
                    groups.append("|".join(",".join(str(i) for i, *_ in x) for x in mine))
                    for i, s, e in mine[0]:
                        for j, t, f in mine[1]:
                            if s < f and t < e:
                                links[i, j] += 1
                    start = end
                found = (len(a), len(b), len(groups), links, ";".join(groups))
        out.append(found)
    return out


def expected(texts):
    some = brute(texts)
    n_docs = Counter(pair for *_, links, _ in some for pair in links)
    most = {}
    for (i, _), n in n_docs.items():
        most[i] = max(most.get(i, 0), n)
    rows = []
    for n_a, n_b, n_groups, links, groups in some:
        best = sum(m for pair, m in links.items() if n_docs[pair] == most[pair[0]])
        rows.append((n_a, n_b, n_groups, sum(links.values()), best, sum(m * n_docs[p] for p, m in links.items()), hashlib.sha256(groups.encode()).hexdigest() if n_a else ""))
    return rows


def values(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def streams(rng, size):
    """Two random streams of tokens over the same bytes."""
    ends = [np.unique(np.append(rng.integers(1, size + 1, max(1, size // k)), size)) for k in (2, 3)]
    return [Tokens(rng.integers(0, 50, len(e)), e) for e in ends]


def same(x, y):
    flat = lambda f: [t.pack() for t in (*f.prefix, *f.suffix)] + [f.first, f.last]
    return flat(x) == flat(y)


@pytest.mark.parametrize("seed", range(60))
def test_fragments_are_a_monoid(seed):
    """Any grouping of chunks gives the same fragment and groups; each stream is cut at places of its own."""
    rng = np.random.default_rng(seed)
    a, b = streams(rng, int(rng.integers(1, 80)))
    cuts = [np.sort(rng.integers(0, len(x.ids) + 1, 5)) for x in (a, b)]
    parts = []
    for k in range(6):
        bounds = [([0, *c, len(x.ids)][k], [0, *c, len(x.ids)][k + 1]) for c, x in zip(cuts, (a, b))]
        parts.append(fragment(*(Tokens(x.ids[p:q], x.ends[p:q]) for x, (p, q) in zip((a, b), bounds))))

    def left(items):
        one, closed = Fragment.empty(), []
        for f, c in items:
            one, more = compose(one, f)
            closed += c + more
        return one, closed

    def tree(items):
        if len(items) == 1:
            return items[0]
        k = int(rng.integers(1, len(items)))
        (x, c), (y, d) = tree(items[:k]), tree(items[k:])
        one, more = compose(x, y)
        return one, c + d + more

    def texts(one, closed):
        whole = [alignment.Closed(0, *one.prefix), *sorted(closed, key=lambda c: c.start)]
        return [g for c in whole for g in alignment.group_texts(c.a, c.b)[1]]

    whole, closed = fragment(a, b)
    for way in (left, tree, tree):
        one, more = way(parts)
        assert same(one, whole) and texts(one, more) == texts(whole, closed)
    for f, _ in parts:
        assert same(compose(Fragment.empty(), f)[0], f) and same(compose(f, Fragment.empty())[0], f)


TEXTS = [
    None, "", " ", "a", " a  b", "Hello, world! It's <|endoftext|> here", "naïve café\n\n  x\ty \r\n);\r z", "日本語のテキスト と　漢字 \U0001f600", "▁a", "a ▁", "x" * 700, "the cat " * 400,
    "1234567890 " * 30, "a\x00b \x1c c", "\n \n x", "tab \t \t y", "Hello, world!", "Hello, world!", "foo\nbar\nbaz " * 50, "αβγ δεζ " * 40, "nonbreaking\xa0space \xa0 x", "word" + " " * 50 + "word", "QUJDRA" * 200 + " end", "　　x  y",
]


def frame(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i // 2, t, "x", 7, i) for i, t in enumerate(texts)], "doc_id long, text string, key string, n_a int, row int")


@pytest.mark.parametrize("chunk_bytes,fan,pairs", [(alignment.CHUNK_BYTES, 16, 250_000), (64, 2, 20), (7, 3, 250_000), (300, 16, 0)])
def test_odd_texts_in_chunks_of_any_size(spark, monkeypatch, chunk_bytes, fan, pairs):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", pairs)
    got = alignment.report(frame(spark, TEXTS), A_PATH, B_PATH, chunk_bytes=chunk_bytes, fan=fan).collect()
    want = [(None if i == 3 else i // 2, *x) for i, x in enumerate(expected(TEXTS))]
    assert sorted([(r.doc_id, *values(r)) for r in got], key=repr) == sorted(want, key=repr)


def test_groups_and_pairs(spark):
    texts = ["Hello wide world", "Hello world " * 40, None]
    for chunk_bytes in (1 << 16, 50):
        found = alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A_PATH, B_PATH, with_groups=True, chunk_bytes=chunk_bytes)
        some = brute(texts)
        assert {r.id: r.groups for r in found.docs.collect()} == {i: x[4] for i, x in enumerate(some)}
        counts = Counter(p for x in some for p in x[3])
        assert {(r.a_id, r.b_id): r.n_docs for r in found.id_pairs().collect()} == dict(counts)


def test_units_join_to_the_text():
    rng, both = np.random.default_rng(2), alignment.aligner(A_PATH, B_PATH)
    for _ in range(5000):
        marked = " " + "".join(rng.choice(list("abé1 \n\t\r\xa0　.,;:!?)]\"'_日"), rng.integers(1, 20)))
        units = both.cut(marked)
        assert "".join(units) == marked
        assert [i for u in units for i in A.encode(u, add_special_tokens=False).ids] == A.encode(marked, add_special_tokens=False).ids
        b = [i for u in units for x in both.b.encode_words(both.b.pieces_of(u)) for i in np.frombuffer(x, "<i4").tolist()]
        assert b == B.encode(marked[1:])


def test_empty_table(spark):
    assert alignment.report(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).count() == 0


def test_whole_table_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), expected([r.text for r in rows])))
    got = queries.op11_alignment(spark, small).collect()
    assert len(got) == len(rows) and {r.doc_id: values(r) for r in got} == want

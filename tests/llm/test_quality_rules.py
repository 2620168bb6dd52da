import re
from collections import Counter

import numpy as np

from tidemark.llm import quality_rules as Q
from tidemark.llm import queries


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def fitted(points):
    """Brute force of the concentration steps for one cell."""
    least = np.array([x for _, _, x in Q.STATISTICS])
    q = np.percentile(points, [25, 50, 75], axis=0)
    centre, cov = q[1] / Q.UNIT, np.diag(((q[2] - q[0]) / 1.349 / Q.UNIT) ** 2 + least**2)
    x = points / Q.UNIT

    def measure():
        d = x - centre
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    for _ in range(Q.STEPS):
        near = np.floor(np.log1p(measure()) * 1000)
        inside = x[near <= np.percentile(near, 100 * Q.KEEP_SHARE)]
        centre, cov = inside.mean(0), np.cov(inside.T, ddof=0) + np.diag(least**2)
    return measure()


def test_whole_table_against_brute_force(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, small).collect()}
    assert got.keys() == docs.keys()
    for k, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(docs[k].text)
        assert not (r.base_failed and r.kept)
    groups = Counter((docs[k].lang, docs[k].source) for k, r in got.items() if not r.base_failed)
    pools = Counter()
    for (lang, _), n in groups.items():
        pools[lang] += n if n < Q.MIN_CELL else 0
    cells = {}
    for k, r in got.items():
        if not r.base_failed:
            lang, source = docs[k].lang, docs[k].source
            cell = (lang, source) if groups[lang, source] >= Q.MIN_CELL else (lang,) if pools[lang] >= Q.MIN_CELL else ()
            cells.setdefault(cell, []).append(k)
    for ids in cells.values():
        x = []
        for k in ids:
            n, chars, symbols, dup, rep, _ = base(docs[k].text)
            lines = sum(1 for line in docs[k].text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line))
            v = [np.log(n), np.log(chars / n), np.sqrt(symbols / chars), np.sqrt(dup / (lines + 5)), np.sqrt(rep / n)]
            x.append([np.floor(y * Q.UNIT + 0.5) for y in v])
        for k, d in zip(ids, fitted(np.array(x))):
            assert abs(got[k].distance ** 2 - d) < 1e-6 * max(1, d)
            assert got[k].kept == (d <= Q.CUTOFF)


def test_cases(spark):
    text = " ".join(f"word{i}" for i in range(40))
    odd = [None, "", "x", text, text, "\n\n  \n", "a b c d e f g h " * 30, "l1 x\nl1 x\n\n \n l1 x", "w " * 5000, "é ü\x0bz\x1cq " * 10]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", "s", 7) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_words int")
    for r in Q.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(odd[r.doc_id])
        assert r.kept == (not r.base_failed)
    assert Q.judge(df.limit(0)).count() == 0


def test_each_statistic_rejects_alone(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), n)) for n in rng.integers(2, 9, 5000)]

    def lines(words):
        return "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))

    plain = [lines(list(rng.choice(vocabulary, n))) for n in np.exp(rng.normal(5.6, 0.4, 400)).astype(int)]
    words = list(rng.choice(vocabulary, 260))
    junk = {
        "s1": lines(list(rng.choice(vocabulary, 19_000))),
        "s2": lines([w * 5 for w in words]),
        "s3": lines([w + "#" * (i % 2) for i, w in enumerate(words)]),
        "s4": "\n".join([" ".join(words[:60]), *[w for i in range(60) for w in (words[60 + i], "more")]]),
        "s5": lines(words[:200] + words[:35]),
    }
    rows = [(str(i), t, "en", "s") for i, t in enumerate(plain)] + [(k, t, "en", "s") for k, t in junk.items()]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")).collect()}
    assert {k for k in junk if got[k].base_failed} == set()
    assert {k for k in junk if got[k].kept} == set()
    assert got["s1"].n_symbols == got["s2"].n_symbols == got["s4"].n_symbols == got["s5"].n_symbols == 0
    assert sum(got[str(i)].kept for i in range(400)) >= 390

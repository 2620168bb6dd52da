"""Document quality by hierarchical empirical Bayes.

A logistic classifier, trained on a bounded sample of labelled documents, gives
the evidence of each text.  Sites (hosts) and their sections (paths) have
quality rates of their own: grouped sums of the evidence over all documents,
shrunk towards the level above by prior weights that are estimated from how
much the rates differ.  A sparse section thus has nearly its host's rate, and a
sparse host the global one.  The odds of a document are those of its evidence
times those of its section relative to the whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import hash_sample, stored

#: Labelled documents that the classifier is trained on at most, chosen by a hash of their ids.
TRAIN_DOCS = 20_000
#: Evidence is kept within these odds, so that no single level decides alone.
LEAST, MOST = 0.001, 0.999
KEEP_AT = 0.5

_WORD = r"[^\x20\x09-\x0D]+"
#: Shares that tell prose from other text; all are between 0 and about 1.
_FEATURES = {
    "length": "ln(1 + n) / 10",
    "word_length": "ln(1 + chars / greatest(n, 1)) / 3",
    "symbols": "sqrt(symbols / greatest(chars, 1))",
    "capitals": "capitals / greatest(chars, 1)",
    "marks": "sqrt(marks / greatest(chars, 1))",
    "digits": "digits / greatest(chars, 1)",
    "distinct": "distinct / greatest(n, 1)",
    "distinct_by_length": "distinct / greatest(n, 1) * ln(1 + n) / 10",
    "repeated": "repeated / greatest(n, 1)",
}


def evidence_features(df: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``df`` with ``x``, an array of text features; null and empty texts have zero counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = df.withColumns({"_words": F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), "_text": text})

    def without(pattern: str):
        return F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))

    counted = words.select(
        *df.columns,
        F.struct(
            F.size("_words").cast("double").alias("n"),
            F.length(F.array_join("_words", "")).cast("double").alias("chars"),
            without(r"[#*$%&|<>]").cast("double").alias("symbols"),
            without(r"\p{Lu}").cast("double").alias("capitals"),
            without(r"[!?]").cast("double").alias("marks"),
            without(r"[0-9]").cast("double").alias("digits"),
            F.size(F.array_distinct("_words")).cast("double").alias("distinct"),
            F.expr("size(filter(_words, (w, i) -> i > 0 AND w = _words[i - 1]))").cast("double").alias("repeated"),
        ).alias("_c"),
    )
    named = counted.select(F.struct(*df.columns).alias("_row"), "_c.*")
    return named.select("_row.*", F.array(*[F.expr(e) for e in _FEATURES.values()]).alias("x"))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Logistic regression on features and their squares, by damped Newton steps."""
    z = _design(x)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, z.T @ (y - p) - ridge * w)
        w += step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
    return w


def _design(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[float]:
    """Weights of the classifier; with labels of one kind only, the share of that kind is all it knows."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    chosen = hash_sample(known.groupBy("id").agg(F.min("y").alias("y")), TRAIN_DOCS, "id")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    got = evidence_features(texts, "text").select("x", "y").toPandas()
    width = 1 + 2 * len(_FEATURES)
    if not len(got):
        return [0.0] * width
    y = (got.y.to_numpy() == 1).astype(float)
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return [float(np.log(share / (1 - share))), *[0.0] * (width - 1)]
    return _fit(np.stack(got.x.to_list()), y).tolist()


def _weight(level: DataFrame, centre: str) -> float:
    """Prior weight of the level above, by moments: ``level`` has n, s (sum of evidence) and ``centre``, the mean above."""
    m = level.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(centre), 2)).alias("between"), F.sum(F.col("n") * F.col(centre) * (1 - F.col(centre))).alias("within"),
    ).first()
    if not m.n or m.k < 2:
        return 1.0
    chance, spread = m.within / m.n, m.n - m.n2 / m.n
    between = (m.between - (m.k - 1) * chance) / max(spread, 1e-9)
    return float(np.clip(chance / max(between, 1e-9) - 1, 1.0, 1e6))


def _logit(column: str):
    p = F.least(F.greatest(F.col(column), F.lit(LEAST)), F.lit(MOST))
    return F.log(p / (1 - p))


def judge(df: DataFrame, weights: list[float], *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``id_col, evidence, host_rate, path_rate, quality, kept`` for every row of ``df``.

    Null and empty texts are judged by their zero counts; null hosts and paths
    are sites of their own; repeated rows each count; an empty table gives an
    empty one.  Only the named columns are used.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    k = len(_FEATURES)
    linear = " + ".join([f"({weights[0]!r}D)"] + [f"({weights[1 + i]!r}D) * x[{i}] + ({weights[1 + k + i]!r}D) * x[{i}] * x[{i}]" for i in range(k)])
    scored = evidence_features(docs, "text").select("id", "host", "path", F.expr(f"1 / (1 + exp(-({linear})))").alias("p"))
    scored = stored(scored.withColumn("p", F.least(F.greatest("p", F.lit(LEAST)), F.lit(MOST))), "evidence")
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "path-sums")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "host-sums")
    whole = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    prior = float(whole) if whole is not None else 0.5
    hosts = hosts.withColumn("prior", F.lit(prior))
    m = _weight(hosts, "prior")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + m * prior) / (F.col("n") + m)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    m = _weight(paths, "host_rate")
    rates = stored(
        paths.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_rate", ((F.col("s") + m * F.col("host_rate")) / (F.col("n") + m)).alias("path_rate")), "path-rates"
    )
    joined = scored.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    odds = _logit("p") + _logit("path_rate") - float(np.log(np.clip(prior, LEAST, MOST) / (1 - np.clip(prior, LEAST, MOST))))
    quality = 1 / (1 + F.exp(-odds))
    return joined.select(F.col("id").alias(id_col), F.col("p").alias("evidence"), "host_rate", "path_rate", quality.alias("quality"), (quality >= KEEP_AT).alias("kept"))

"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Each document gets base counts and a vector of five transformed statistics.
Within each cell (language and source) a minimum-covariance-determinant
estimate is fitted by concentration steps: start from the coordinate-wise
median and quartile spread, keep the ``KEEP_SHARE`` nearest documents, take
their mean and covariance, measure again, and so on.  A document whose
Mahalanobis distance from its cell exceeds ``CUTOFF`` is rejected.

The texts are read once.  What follows works on the stored statistics: sums
grouped by cell with partial aggregation, in whole numbers so that the result
does not depend on the order of rows, and joins with one row for each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import stored

WORD_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
KEEP_SHARE = 0.75
STEPS = 3
#: Cells of fewer documents are pooled: sources of one language first, then all.
MIN_CELL = 50
#: Squared distance: the chi-square quantile of 0.999 for five statistics (20.515) times 1.4137, by which
#: the covariance of the nearest ``KEEP_SHARE`` of five-dimensional normal documents falls short of that of all.
CUTOFF = 29.0
#: Statistics are kept in whole ten-thousandths.
UNIT = 10_000

#: name, expression, and the standard deviation added to the estimate so that a
#: statistic that is always zero does not reject all that differ: numerical for
#: the logarithms; for square roots of shares the sampling deviation of a counted
#: one, 1 / (2 sqrt(n)), for 1,300 characters, 20 lines, and 260 words in windows.
STATISTICS = (
    ("s1", "ln(n_words)", 0.01),
    ("s2", "ln(word_chars / n_words)", 0.01),
    ("s3", "sqrt(n_symbols / word_chars)", 0.014),
    ("s4", "sqrt(n_dup_lines / (n_lines + 5))", 0.1),
    ("s5", "sqrt(n_repeat_words / n_words)", 0.09),
)
_NAMES = [name for name, _, _ in STATISTICS]
_P = len(_NAMES)

_WORD = r"[^\x20\x09-\x0D]+"

#: Words inside windows found twice or more: sort window hashes with their
#: places, keep those equal to a neighbour, and add up what the places cover.
_REPEATED = f"""CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE
  transform(array(sort_array(transform(hashes, (h, i) -> named_struct('h', h, 'i', i)))), s ->
    aggregate(
      sort_array(transform(
        filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k + 1 < size(s) AND s[k + 1].h = x.h)),
        x -> x.i)),
      named_struct('stop', 0L, 'n', 0L),
      (a, i) -> named_struct('stop', i + {WORD_WINDOW}L, 'n', a.n + i + {WORD_WINDOW}L - greatest(a.stop, CAST(i AS BIGINT))),
      a -> a.n))[0] END"""


def base_counts(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The columns of ``df`` and ``_counts``, a struct of the base counts, each long.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words;
    null and empty texts have zeros.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = df.withColumn("_words", F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))
    windows = f"transform(sequence(1, size(_words) - {WORD_WINDOW - 1}), i -> xxhash64(slice(_words, i, {WORD_WINDOW})))"
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.select(
        *df.columns,
        F.size("_words").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("_n_symbols"),
        lines.alias("_lines"),
        F.expr(f"CASE WHEN size(_words) >= {WORD_WINDOW} THEN {windows} ELSE CAST(array() AS array<bigint>) END").alias("hashes"),
    )
    return counted.select(
        *df.columns,
        F.struct(
            F.col("_n_words").alias("n_words"),
            F.col("_word_chars").alias("word_chars"),
            F.col("_n_symbols").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
        ).alias("_counts"),
    )


def _with_cells(stats: DataFrame) -> DataFrame:
    """Adds ``cell``; sparse cells are pooled by language, and what is sparse even so is pooled into one."""
    sizes = stored(
        stats.where("NOT base_failed").groupBy("lang", "source").count().withColumn("own", F.col("count") >= MIN_CELL), "cell-sizes"
    )
    pooled = sizes.where("NOT own").groupBy("lang").agg(F.sum("count").alias("pool"))
    cells = (
        sizes.join(pooled.withColumnRenamed("lang", "pool_lang"), F.col("lang").eqNullSafe(F.col("pool_lang")), "left")
        .select(
            F.col("lang").alias("cell_lang"),
            F.col("source").alias("cell_source"),
            F.when(F.col("own"), F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}))
            .when(F.col("pool") >= MIN_CELL, F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}))
            .otherwise("{}")
            .alias("cell"),
        )
    )
    cells = stored(cells, "cells")
    same = F.col("lang").eqNullSafe(F.col("cell_lang")) & F.col("source").eqNullSafe(F.col("cell_source"))
    return stats.join(cells, same, "left").drop("cell_lang", "cell_source")


def _quantiles(df: DataFrame, value: Column, by: list[str], shares: list[float], name: str) -> DataFrame:
    """Exact quantiles of whole numbers, from their counts."""
    listed = ", ".join(map(str, shares))
    return df.groupBy(*by, value.alias("_v")).count().groupBy(*by).agg(F.expr(f"percentile(_v, array({listed}), count)").alias(name))


def _distance(centre: str = "centre", factor: str = "factor") -> Column:
    """Squared Mahalanobis distance, by solving with the Cholesky factor (rows of the lower triangle)."""
    solved: list[str] = []
    for i, name in enumerate(_NAMES):
        done = "".join(f" - {factor}[{i * (i + 1) // 2 + j}] * ({y})" for j, y in enumerate(solved))
        solved.append(f"(({name} / {UNIT}.0D - {centre}[{i}]){done}) / {factor}[{i * (i + 1) // 2 + i}]")
    return F.expr(" + ".join(f"power({y}, 2)" for y in solved))


def _cholesky(cells: DataFrame) -> DataFrame:
    """``cell, centre, factor`` from ``cell, centre`` and covariances c_i_j."""
    out = cells
    for i in range(_P):
        for j in range(i + 1):
            less = "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            value = f"c_{i}_{j}{less}"
            out = out.withColumn(f"l_{i}_{j}", F.expr(f"sqrt({value})" if i == j else f"({value}) / l_{j}_{j}"))
    return out.select("cell", "centre", F.array(*[F.col(f"l_{i}_{j}") for i in range(_P) for j in range(i + 1)]).alias("factor"))


def _start(points: DataFrame) -> DataFrame:
    """Median and quartile spread of each statistic, as a diagonal estimate."""
    long = points.select("cell", F.expr(f"stack({_P}, {', '.join(f'{i}, {n}' for i, n in enumerate(_NAMES))}) AS (dim, v)"))
    spread = _quantiles(long, F.col("v"), ["cell", "dim"], [0.25, 0.5, 0.75], "q")
    wide = spread.groupBy("cell").agg(
        *[F.max(F.when(F.col("dim") == i, F.col("q"))).alias(f"q_{i}") for i in range(_P)],
    )
    for i, (_, _, least) in enumerate(STATISTICS):
        for j in range(i):
            wide = wide.withColumn(f"c_{i}_{j}", F.lit(0.0))
        wide = wide.withColumn(f"c_{i}_{i}", F.expr(f"power((q_{i}[2] - q_{i}[0]) / 1.349D / {UNIT}, 2) + {least}D * {least}D"))
    return _cholesky(wide.withColumn("centre", F.array(*[F.col(f"q_{i}")[1] / UNIT for i in range(_P)])))


def _concentrate(points: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: the mean and covariance of the nearest documents of each cell."""
    measured = points.join(estimate, "cell").select("cell", *_NAMES, F.floor(F.log1p(_distance()) * 1000).alias("near"))
    bound = stored(_quantiles(measured, F.col("near"), ["cell"], [KEEP_SHARE], "bound"), "bounds")
    inside = measured.join(bound, "cell").where(F.col("near") <= F.col("bound")[0])
    whole = "decimal(38,0)"
    sums = inside.groupBy("cell").agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(a).cast("decimal(20,0)")).cast("double").alias(f"m_{i}") for i, a in enumerate(_NAMES)],
        *[
            F.sum((F.col(a) * F.col(b)).cast("decimal(20,0)")).cast(whole).cast("double").alias(f"x_{i}_{j}")
            for i, a in enumerate(_NAMES)
            for j, b in enumerate(_NAMES[: i + 1])
        ],
    )
    for i, (_, _, least) in enumerate(STATISTICS):
        for j in range(i + 1):
            floor = f" + {least}D * {least}D" if i == j else ""
            sums = sums.withColumn(f"c_{i}_{j}", F.expr(f"(x_{i}_{j} / n - (m_{i} / n) * (m_{j} / n)) / {UNIT * UNIT}.0D{floor}"))
    return _cholesky(sums.withColumn("centre", F.array(*[F.expr(f"m_{i} / n / {UNIT}.0D") for i in range(_P)])))


def judge(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id_col``, the base counts, ``base_failed``, ``distance`` and ``kept``, one row for each row of ``df``.

    Null and empty texts have zero counts and fail the base rules.  Null
    languages and sources form cells of their own.  Repeated rows count each.
    A cell whose documents are all equal rejects none of them.  An empty table
    gives an empty one.  Documents that fail the base rules enter no estimate.
    """
    only = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counts = base_counts(only).select("id", "lang", "source", "_counts.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = counts.withColumn("base_failed", failed)
    for name, expression, _ in STATISTICS:
        stats = stats.withColumn(name, F.when(~F.col("base_failed"), F.round(F.expr(expression) * UNIT)).cast("long"))
    stats = _with_cells(stored(stats, "text-statistics"))
    points = stats.where("NOT base_failed").select("cell", *_NAMES)
    estimate = stored(_start(points), "estimate")
    for _ in range(STEPS):
        estimate = stored(_concentrate(points, estimate), "estimate")
    judged = stats.join(estimate, "cell", "left").withColumn("distance", F.sqrt(_distance()))
    return judged.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.when(~F.col("base_failed"), F.col("distance")).alias("distance"),
        (~F.col("base_failed") & (F.col("distance") * F.col("distance") <= CUTOFF)).alias("kept"),
    )

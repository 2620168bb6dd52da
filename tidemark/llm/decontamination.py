"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of ``WINDOW`` consecutive words, keyed by a 64-bit
hash, are broadcast once their number has been counted and is within
``BROADCAST_WINDOWS``; a larger benchmark is joined by a shuffle instead.
The corpus is read once: each text is cut into words, each word hashed, and the
hashes of all windows of all lengths are probed in one generated stage, where a
hit counts only if the words themselves are equal.  Every document adds a row
of its own to what this pass stores, so counts need no second look at the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import stored, unused

WINDOW = 10
#: Benchmark windows that may be broadcast (some 150 bytes each).
BROADCAST_WINDOWS = 200_000

#: What stands between words, after and before A-Z have been lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The key under which each document finds its own row; ``len`` 0 tells it from a window with this hash.
_OWN_ROW = 0


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _BETWEEN, -1), "")


def _places(array: str, length: int) -> str:
    """The elements of ``array`` from ``i``; ``slice`` would copy the whole array for each window."""
    return ", ".join(f"{array}[i + {k}]" for k in range(length))


def _windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, len, key, window``: every window of every item; an item of fewer words is one window."""
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words"))
    long = f"transform(sequence(0, size(ws) - {WINDOW}), i -> array({_places('ws', WINDOW)}))"
    cut = f"transform(array(words), ws -> CASE WHEN size(ws) >= {WINDOW} THEN {long} ELSE array(ws) END)[0]"
    windows = items.selectExpr("item", f"explode_outer({cut}) AS window").where("size(window) > 0").distinct()
    return windows.selectExpr("item", "size(window) AS len", "xxhash64(transform(window, w -> xxhash64(w))) AS key", "window")


def _offset(lengths: list[int], length: int) -> str:
    """How many windows of greater lengths stand before those of ``length`` among a document's keys."""
    return " + ".join(["0", *(f"greatest(n_words - {x - 1}, 0)" for x in lengths if x > length)])


def find_hits(
    df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``id, digest, n_words, at, len, window`` of every hit, and the benchmark's ``item, window``; both are stored.

    ``at`` counts words from 1.  Each row of ``df`` has a row with ``len`` 0 as
    well.  ``digest`` tells rows with the same id apart by their texts.
    """
    windows = stored(_windows(benchmark, item_col, item_text_col), "benchmark-windows")
    own = windows.select("key", "len", "window").distinct()
    found = {r["len"]: r["count"] for r in own.groupBy("len").count().collect()}  # one row for each length up to WINDOW
    lengths = sorted(found, reverse=True)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), words_of(F.col(text_col)).alias("words"))
    keys = [f"CASE WHEN size(h) >= {x} THEN transform(sequence(0, size(h) - {x}), i -> xxhash64(array({_places('h', x)}))) ELSE CAST(array() AS array<bigint>) END" for x in lengths]

    def keyed(*more: str) -> DataFrame:
        # the outer array of one binds the hashes: as a column they would be computed again for each window;
        # an outer explode, as else the whole expression comes a second time in a filter on its size
        listed = f"transform(array(transform(words, w -> xxhash64(w))), h -> concat({', '.join([*keys, *more, 'CAST(array() AS array<bigint>)'])}))[0] AS keys"
        return docs.selectExpr("id", "digest", "words", "size(words) AS n_words", listed).selectExpr("id", "digest", "words", "n_words", "posexplode_outer(keys) AS (p, key)")

    place = " ".join(f"WHEN len = {x} THEN p + 1 - ({_offset(lengths, x)})" for x in lengths)
    at = f"CASE {place} ELSE 0 END" if place else "0"
    n_keys = _offset(lengths, 0)
    if sum(found.values()) <= BROADCAST_WINDOWS:
        self_key = df.sparkSession.range(1).selectExpr(f"{_OWN_ROW}L AS key", "0 AS len", "CAST(array() AS array<string>) AS window")
        met = keyed(f"array({_OWN_ROW}L)").join(F.broadcast(own.union(self_key)), "key").selectExpr("*", f"{at} AS at")
        hits = met.where(f"CASE WHEN len = 0 THEN p = {n_keys} ELSE p < {n_keys} AND at BETWEEN 1 AND n_words - len + 1 AND slice(words, at, len) = window END")
        return stored(hits.selectExpr("id", "digest", "n_words", "at", "len", "window"), "benchmark-hits"), windows
    # positions that share a key are found without any words, and then looked up in their documents
    met = stored(keyed().drop("words").join(own, "key").selectExpr("id AS i", "digest AS d", "len", "window", f"{at} AS at").where("at BETWEEN 1 AND n_words - len + 1"), "benchmark-candidates")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))
    hits = docs.dropDuplicates(["id", "digest"]).join(met, same).where("slice(words, at, len) = window")
    plain = docs.selectExpr("id", "digest", "size(words) AS n_words", "0 AS at", "0 AS len", "CAST(array() AS array<string>) AS window")
    return stored(plain.union(hits.selectExpr("id", "digest", "size(words)", "at", "len", "window")), "benchmark-hits"), windows


def _positions(hits: DataFrame) -> DataFrame:
    """``hit_id, hit_digest, at``: the words of each document that are hit, once each."""
    return hits.where("len > 0").selectExpr("id AS hit_id", "digest AS hit_digest", "explode(sequence(at, at + len - 1)) AS at").distinct()


def report(
    df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``df``.

    Null and empty texts have no words and no hits; null or empty items have no
    windows; equal items are reported under each of their ids; repeated rows
    are each reported; an empty table on either side gives no hits.  Only the
    named columns are used, so others cannot clash.
    """
    hits, windows = find_hits(df, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col)
    counts = _positions(hits).groupBy("hit_id", "hit_digest").agg(F.count("*").alias("n_hit"))
    named = hits.where("len > 0").selectExpr("id AS item_of", "digest AS item_digest", "window").distinct().join(windows.select("item", "window"), "window")
    named = named.groupBy("item_of", "item_digest").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    joined = hits.where("len = 0").join(counts, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")), "left")
    joined = joined.join(named, F.col("id").eqNullSafe(F.col("item_of")) & (F.col("digest") == F.col("item_digest")), "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove(df: DataFrame, benchmark: DataFrame, *, what: str = "documents", id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``df`` without contaminated documents, or without the words that were hit (``what="spans"``).

    All columns stay, whatever their names.  With spans, the words outside them
    are joined by single spaces in contaminated documents; clean documents keep
    their texts as they are.  Null and empty texts and items, repeated rows and
    null ids count as in :func:`report`: rows without words stay, and each of
    several equal rows goes or stays.  An empty table on either side removes nothing.
    """
    if what not in ("documents", "spans"):
        raise ValueError(what)
    hits, _ = find_hits(df, benchmark, id_col=id_col, text_col=text_col, **names)
    hit_id, hit_digest, at = unused(df, "hit_id", "hit_digest", "hit_at")
    found = _positions(hits).groupBy("hit_id", "hit_digest").agg(F.collect_list("at").alias("at"))
    found = found.select(F.col("hit_id").alias(hit_id), F.col("hit_digest").alias(hit_digest), F.col("at").alias(at))
    same = F.col(id_col).eqNullSafe(F.col(hit_id)) & (F.xxhash64(text_col) == F.col(hit_digest))
    if what == "documents":
        return df.join(found.select(hit_id, hit_digest), same, "left_anti")
    words = F.array_remove(F.split(F.col(text_col), _BETWEEN_ANY_CASE, -1), "")
    left = F.array_except(F.sequence(F.lit(1), F.size(words)), F.col(at))
    cut = F.array_join(F.transform(left, lambda i: F.element_at(words, i)), " ")
    text = F.when(F.col(at).isNull(), F.col(text_col)).otherwise(cut)
    return df.join(found, same, "left").withColumn(text_col, text).drop(hit_id, hit_digest, at)


#: The same report in DuckDB's SQL.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, words[pos:pos + 9] AS win, len(words[pos:pos + 9]) AS n
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS pos FROM items WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, pos, n, words[pos:pos + n - 1] AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM docs, lengths WHERE len(words) >= n)),
hits AS (SELECT DISTINCT doc_id, pos, d.n, item_id FROM doc_windows d JOIN item_windows i ON d.win = i.win),
covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS w FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

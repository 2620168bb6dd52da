"""Connected components by alternating large and small stars.

Each round replaces the links of a node by links to its smallest neighbour,
until every component is a star around its smallest member.  Every round is
written to the shared folder, so lineage stays short and a lost executor costs
one round at most.  The smallest neighbours are stored before they are joined,
so that Spark may split the links of a node that very many others link to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half round on links (a, b) with a < b."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(least, "u")
    if large:  # larger neighbours move to the smallest one
        moved = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:  # smaller neighbours and the node itself do
        moved = joined.where("v < u AND v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.where("m < u").select("m", "u"))
    return moved.where("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``id, component``: the smallest id that each id reaches, for all ids that have a link.

    ``links`` has columns ``a`` and ``b``; order, repeats and self-links do not
    matter, and rows with a null are left out.
    """
    current = stored(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        current = stored(_star(stored(_star(current, True), "links"), False), "links")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return current.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
                current.select("a", "a").distinct()
            )
        before = now

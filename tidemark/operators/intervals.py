"""As-of views of many dates at once, from the intervals in which prints are the latest ones.

A print of a key is the latest from its vintage date (``valid_from``) to that of
the next print (``valid_to``, null while none has come).  The intervals are found
with one shuffle by key and stored by the years in which they begin and end, so
that a grid of dates reads only the folders whose intervals can hold one of them,
and each row meets its dates where it lies: a grid needs no shuffle of its own.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import months_between
from tidemark.functions.series import finite, is_final, revision_number, source_tag, source_type
from tidemark.operators.censor import growth, valid
from tidemark.schemas import COHORT, SERIES
from tidemark.storage import delete, new_folder

KEY = [*SERIES, "ref_date"]
#: The folder year of intervals that are still open.
OPEN = 9999
#: What every series has as part of its key, whatever a view is grouped by: the rows of a grid are dealt out by it once.
PLACE = ["source", "geographic_type", "geographic_code", "industry_type", "industry_code"]


def intervals(prints: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Each print with ``valid_from`` and ``valid_to``; of several prints of a day the most revised one counts.

    Prints without a vintage date were never published and are left out; nulls in keys are equal.
    """
    order = [F.col("vintage_date"), F.col("benchmark_revision"), F.col("revision"), F.col("employment")]
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = prints.where("vintage_date IS NOT NULL").withColumns({"valid_from": F.col("vintage_date"), "valid_to": F.lead("vintage_date").over(w)})
    return rows.where("valid_to IS NULL OR valid_to > valid_from")


def _written(df: DataFrame, path: str) -> None:
    """Folders by the years of intervals; each is split into files of the advisory size, however much of it there is."""
    placed = df.withColumns({"from_year": F.year("valid_from"), "to_year": F.coalesce(F.year("valid_to"), F.lit(OPEN))})
    placed.hint("rebalance", "from_year", "to_year").write.partitionBy("from_year", "to_year").parquet(path)


def build(prints: DataFrame, path: str, keys: list[str] = KEY) -> None:
    """Write the index of all prints."""
    _written(intervals(prints, keys), path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The index, with the columns of its prints as in ``schema``."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    return spark.read.schema(", ".join([*names, "valid_from date", "valid_to date", "from_year int", "to_year int"])).parquet(path)


def append(incoming: DataFrame, path: str, keys: list[str] = KEY) -> None:
    """Bring new prints into the index; late ones split intervals that were closed.

    Only folders that hold an interval of a touched key, or receive one, are
    rewritten, from a copy in the shared folder; a job that fails before the
    last write has changed nothing, one that fails within it is simply run again.
    """
    spark = incoming.sparkSession
    index = read(spark, path, incoming.schema)
    touched = incoming.select(*keys).distinct()
    same = F.lit(True)
    for k in keys:
        same &= index[k].eqNullSafe(touched[k])
    affected = index.join(touched, same, "left_semi")
    staging = new_folder(spark, "intervals")
    _written(intervals(affected.select(*incoming.columns).unionByName(incoming).distinct(), keys), f"{staging}/new")
    new = read(spark, f"{staging}/new", incoming.schema)
    pairs = ["from_year", "to_year"]
    folders = {tuple(r) for r in affected.select(*pairs).union(new.select(*pairs)).distinct().collect()}  # pairs of years
    here = F.broadcast(spark.createDataFrame(sorted(folders), "from_year int, to_year int"))
    others = index.join(here, pairs, "left_semi").join(touched, same, "left_anti")
    _written(others.drop(*pairs).unionByName(new.drop(*pairs)), f"{staging}/all")
    left = spark.read.schema(new.schema).parquet(f"{staging}/all")
    kept = {tuple(r) for r in left.select(*pairs).distinct().collect()}
    left.hint("rebalance", *pairs).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*pairs).parquet(path)
    for begins, ends in folders - kept:  # what lost its last interval is not seen by an overwrite of single folders
        delete(spark, f"{path}/from_year={begins}/to_year={ends}")


def _dates(as_of: list[datetime.date]) -> Column:
    return F.array(*[F.lit(d).cast("date") for d in sorted(as_of)])


def view(index: DataFrame, as_of: list[datetime.date]) -> DataFrame:
    """The latest print of each key at each date of a stated grid, as ``as_of``; reference dates lie before it.

    Nothing is shuffled: folders are pruned by the grid's ends, rows meet their dates in place.
    """
    first, last = min(as_of), max(as_of)
    near = index.where((F.col("from_year") <= last.year) & (F.col("to_year") >= first.year))
    holds = F.filter(_dates(as_of), lambda d: (d >= F.col("valid_from")) & (F.col("valid_to").isNull() | (d < F.col("valid_to"))) & (d > F.col("ref_date")))
    return near.withColumn("as_of", F.explode(holds)).drop("from_year", "to_year")


def panel_grid(store: DataFrame, as_of: list[datetime.date], settled_months: int = 41) -> DataFrame:
    """The growth panel of each date of a stated grid, as ``as_of``, from one shuffle of the store.

    At each date it is what ``censor.to_panel`` gives with that date, and with
    ``settled_months`` before it as the bound of settled prints.  The rows are
    dealt out by series first and meet their dates after that, so that the
    windows of all dates find them where they are.
    """
    holds = F.filter(_dates(as_of), lambda d: (d >= F.col("vintage_date")) & (d > F.col("ref_date")))
    rows = valid(store).where(F.col("vintage_date") <= F.lit(max(as_of))).repartition(*PLACE).withColumn("as_of", F.explode(holds))
    grown = growth(rows, ["as_of", *COHORT])
    survey, settled = F.col("source") == "ces", F.add_months("as_of", -settled_months)
    recent = survey | (F.col("ref_date") >= settled)
    series = ["as_of", *SERIES]
    rank = F.dense_rank().over(Window.partitionBy(*series, recent).orderBy(F.desc("ref_date")))
    q = F.quarter("ref_date")
    census = (
        F.when(rank == 1, 0).when(rank == 2, 1).when(rank == 3, F.when(q == 4, 1).otherwise(2))
        .when(rank == 4, F.when(q == 4, 1).when(q == 3, 2).otherwise(3))
    )
    want = F.when(survey, F.least(rank - 1, F.lit(2))).otherwise(F.when(recent, census))
    fits = F.coalesce((F.col("revision") == want) & (~survey | (F.col("benchmark_revision") == 0)), F.lit(False))
    best = [F.desc("_fits"), F.desc("revision"), F.desc("benchmark_revision"), F.desc("vintage_date"), F.col("employment")]
    chosen = grown.withColumn("_fits", fits).withColumn("_rn", F.row_number().over(Window.partitionBy(*series, "ref_date").orderBy(*best))).where("_rn = 1")
    tagged = chosen.withColumns({"source_tag": source_tag(), "source_type": source_type(), "revision_number": revision_number(), "is_final": is_final(settled)})
    keys = ["as_of", *PLACE, "source_tag", "ref_date", "revision_number"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("vintage_date"), F.desc("benchmark_revision"), F.desc("revision"))
    return tagged.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1 AND growth IS NOT NULL").where(finite(F.col("growth"))).select(
        "as_of", F.col("ref_date").alias("period"), "geographic_type", "geographic_code", "industry_code", F.col("industry_type").alias("industry_level"),
        F.col("source_tag").alias("source"), "source_type", "growth", F.col("employment").alias("employment_level"), "vintage_date", "revision_number", "is_final",
        months_between(F.col("vintage_date"), F.col("ref_date")).alias("publication_lag_months"),
    )

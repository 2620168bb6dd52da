"""Incremental capture as streams over landing folders."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.dimensions import remap, unknown
from tidemark.operators import calendar, census, estimates, hierarchy, store
from tidemark.schemas import VINTAGE, conform, empty


def _once(df: DataFrame, path: str) -> None:
    """Write a folder unless it has been written whole: what a replayed batch finds done stays as it is."""
    if not store.exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)


def landing(spark: SparkSession, path: str, schema=VINTAGE) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def capture(arrivals: DataFrame, path: str, drift_path: str, checkpoint: str, as_of: str | None = None):
    """Append what is new and knowable to the store, and set drifted levels aside; late rows are welcome.

    The checkpoint makes offsets exactly-once, and the anti-join on the store's
    key makes a batch that is replayed append nothing.  Levels that differ from
    stored ones go to ``drift_path``, a folder for each batch, and are never applied.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = conform(batch, VINTAGE, fill=True)
        if as_of is not None:
            rows = rows.where((F.col("vintage_date") <= F.lit(as_of).cast("date")) & (F.col("ref_date") < F.lit(as_of).cast("date")))
        if store.exists(batch.sparkSession, path):
            found = store.drift(rows, store.read(batch.sparkSession, path))
            _once(found, f"{drift_path}/epoch={epoch}")
        store.append(rows, path)

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(events: DataFrame, every: str, late: str, by: list[str], value: str) -> DataFrame:
    """Mean of a value in tumbling windows, for events up to ``late`` behind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), *by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


# ------------------------------------------------------------------ quarters of the census


def newest_quarter(as_of: datetime.date, candidates: int = 8) -> tuple[int, int] | None:
    """Year and number of the newest quarter whose first print was out on a day, if one of the last ``candidates`` was."""
    year, quarter = as_of.year, (as_of.month - 1) // 3 + 1
    for _ in range(candidates):
        year, quarter = (year, quarter - 1) if quarter > 1 else (year - 1, 4)
        month = 3 * quarter - 1 + calendar.QUARTERLY_LAGS[quarter][0]  # counted from January of that year
        if datetime.date(year + month // 12, month % 12 + 1, 1) <= as_of:
            return year, quarter
    return None


def quarter_rows(landed: DataFrame, year: int, quarter: int) -> DataFrame:
    """Store rows of one landed quarter: levels from area files (``kind`` area), and in first quarters sizes from size files."""
    rows = landed.where((F.col("year").cast("int") == year) & (F.col("qtr").cast("int") == quarter))
    levels = conform(census.panel(rows.where("kind = 'area' AND revision = 0")), VINTAGE, fill=True)
    if quarter > 1:
        return levels
    sizes = census.size_rows(rows.where("kind = 'size'"))
    by = [c for c in sizes.columns if c not in ("size_code", "employment")]
    return levels.unionByName(conform(hierarchy.size_schemes(sizes, "size_code", by, "employment"), VINTAGE, fill=True))


def capture_quarters(arrivals: DataFrame, path: str, folder: str, checkpoint: str, as_of: datetime.date):
    """Take the newest knowable quarter out of landed files, unless the store has its first print.

    Each batch has four sinks: the rows that it brings (``pending``), levels that
    are stored otherwise (``drift``), what was done (``runs``), and the store.  The
    first three are folders of the batch's own, written once and before the store,
    which takes only keys that it lacks.  So a batch that is replayed, whole or
    from where it died, changes no sink.
    """
    found = newest_quarter(as_of)

    def captured(spark: SparkSession) -> bool:
        if found is None:
            return True
        if not store.exists(spark, path):
            return False
        first = datetime.date(found[0], 3 * found[1] - 2, 1)
        months = F.add_months(F.lit(first), 3)
        rows = store.read(spark, path).where("source = 'qcew' AND NOT seasonally_adjusted AND revision = 0").where((F.col("ref_date") >= F.lit(first)) & (F.col("ref_date") < months))
        return len(rows.limit(1).collect()) > 0

    def write(batch: DataFrame, epoch: int) -> None:
        spark, pending = batch.sparkSession, f"{folder}/pending/epoch={epoch}"
        if not store.exists(spark, f"{pending}/_SUCCESS"):
            rows = empty(spark, VINTAGE) if captured(spark) else quarter_rows(batch, *found).where(F.col("vintage_date") <= F.lit(as_of))
            rows.write.mode("overwrite").parquet(pending)
        rows = spark.read.schema(VINTAGE).parquet(pending)
        stored = store.read(spark, path) if store.exists(spark, path) else empty(spark, VINTAGE)
        _once(store.drift(rows, stored), f"{folder}/drift/epoch={epoch}")
        counts = rows.agg(F.count("*").alias("n_rows"), F.count("size_class_type").alias("n_sizes"), F.max("ref_date").alias("last_ref"))
        _once(counts, f"{folder}/runs/epoch={epoch}")
        store.append(rows, path)

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------------------ prints of the survey


def capture_survey(arrivals: DataFrame, schedule: DataFrame, path: str, folder: str, checkpoint: str, as_of: datetime.date):
    """Take the prints that were out by ``as_of`` from deliveries of current survey levels (code, seasonally_adjusted, ref_date, value).

    ``schedule`` is the release calendar, which says which print a level is (see
    ``estimates.survey_releases``).  A delivery holds all months, most of them
    stored already: those are skipped, and where their level is another one now
    they go to ``drift`` and are never applied.  Codes that the stored axes lack
    go to ``unknown``; ``runs`` counts what came, was new and was skipped.  All
    four and the batch's rows (``pending``) are folders of the batch's own,
    written once and before the store, so a replayed batch changes no sink.
    ``jobs.heal`` joins the files that the store gathers.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark, pending = batch.sparkSession, f"{folder}/pending/epoch={epoch}"
        prints = estimates.survey_releases(batch, schedule).where(F.col("vintage_date") <= F.lit(as_of))
        _once(unknown(prints), f"{folder}/unknown/epoch={epoch}")
        _once(conform(remap(prints), VINTAGE, fill=True), pending)
        rows = spark.read.schema(VINTAGE).parquet(pending)
        stored = store.read(spark, path) if store.exists(spark, path) else empty(spark, VINTAGE)
        _once(store.drift(rows, stored), f"{folder}/drift/epoch={epoch}")
        new = store.new_rows(rows, stored).agg(F.count("*").alias("n_new"))
        counts = rows.agg(F.count("*").alias("n_rows")).join(new).withColumn("n_skipped", F.col("n_rows") - F.col("n_new"))  # a row each
        _once(counts, f"{folder}/runs/epoch={epoch}")
        store.append(rows, path)

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------------------ releases that are announced


def watch(items: DataFrame, path: str, schedule: DataFrame, folder: str, checkpoint: str, update: Callable[[SparkSession, str, datetime.date], None]):
    """Call ``update(spark, feed, day)`` when a feed announces a release of which the store lacks a print.

    ``items`` is a stream of (feed, pub_date, ref_date).  Its state holds what each
    feed has delivered, so an item that comes again, before or after a restart,
    is passed over; it grows with the number of releases alone.  Of a batch the
    newest day of each feed counts, whatever the order of items; the store
    decides what is missing by then: prints of ``schedule`` (source, ref_date,
    revision, benchmark_revision, vintage_date) that were due and are not stored.
    What fired is written before ``update`` runs, once for each batch, so a
    replayed batch fires the same again, and ``update`` must append idempotently.
    """
    fresh = items.dropDuplicates(["feed", "ref_date", "pub_date"])

    def fire(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # a row for each feed; taken whatever is done already, as the state is committed by what reads the batch
        latest = batch.groupBy("feed").agg(F.max("pub_date").alias("pub_date")).collect()
        newest = spark.createDataFrame(latest, "feed string, pub_date date")
        due = schedule.join(newest, (F.col("source") == F.col("feed")) & (F.col("vintage_date") <= F.col("pub_date")))
        if store.exists(spark, path):
            keys = ["source", "ref_date", "revision", "benchmark_revision"]
            due = due.join(store.read(spark, path).select(*keys).distinct(), keys, "left_anti")
        missing = due.groupBy("feed", "pub_date").agg(F.count("*").alias("n_missing"), F.min("ref_date").alias("first_missing"))
        _once(missing, f"{folder}/fired/epoch={epoch}")
        for row in spark.read.schema(missing.schema).parquet(f"{folder}/fired/epoch={epoch}").collect():  # a row for each feed
            update(spark, row["feed"], row["pub_date"])

    return fresh.writeStream.foreachBatch(fire).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

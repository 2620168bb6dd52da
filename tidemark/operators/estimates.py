"""Estimates of the programmes as store rows: state files of two prints, current survey levels, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dimensions import recode
from tidemark.operators.calendar import drop_reprint_shadows, latest_lookup, tag
from tidemark.schemas import RELEASES, conform, union_by_name

#: What makes an estimate unique.
KEY = [f.name for f in RELEASES if f.name != "employment"]
#: Columns that an estimate may come without; they are null then.
_OPTIONAL = ("seasonally_adjusted", "vintage_date", "revision", "benchmark_revision")
# Codes of the survey's domains.
DOMAINS = ("05", "06", "07", "08")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, whose job fails where a key has several rows; nulls in keys are equal.

    One grouped pass, no second read.  The check hangs on the other columns, so
    a job that reads none of them does not run it.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("_row"))
    named = F.to_json(F.struct(*keys))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("several rows of "), named)))
    return grouped.withColumn("_row", checked).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def survey_level(code: Column) -> Column:
    """Industry type of a survey code: the nation's total, a domain or a supersector."""
    return F.when(code == "00", "national").when(code.isin(*DOMAINS), "domain").otherwise("supersector")


def state_rows(revisions: DataFrame, calendar: DataFrame, publication: str = "sae") -> DataFrame:
    """Store rows of state series that hold an initial and a latest level for each month.

    ``revisions`` has ``adjusted``, the axes, ``ref_date, employment_initial,
    employment_latest``: prints 0 and 1, where there is a level.  Prints without a
    date in the ``calendar`` go, those with several (benchmarks) stand once for each.
    Old sector codes are replaced, supersectors of one sector stand as that too.
    A key that comes twice fails the job.
    """
    prints = F.explode(F.array(*[F.struct(F.lit(n).alias("revision"), F.col(c).alias("employment")) for n, c in ((0, "employment_initial"), (1, "employment_latest"))]))
    axes = ["geographic_type", "geographic_code", "industry_type", "industry_code", "ref_date"]
    rows = revisions.select(F.lit(publication).alias("source"), F.col("adjusted").alias("seasonally_adjusted"), *axes, prints.alias("_p")).select("*", "_p.*").drop("_p")
    dates = calendar.where((F.col("publication") == publication) & F.col("vintage_date").isNotNull()).select("ref_date", "revision", "vintage_date", "benchmark_revision")
    dated = rows.where("employment IS NOT NULL").join(dates, ["ref_date", "revision"])
    return unique(conform(recode(dated), RELEASES), KEY)


def survey_releases(levels: DataFrame, calendar: DataFrame) -> DataFrame:
    """Current survey levels as store rows, dated by the newest print of each benchmark track.

    ``levels`` has ``code, seasonally_adjusted, ref_date, value``: one level a
    month, which the newest benchmark has changed.  So a month whose benchmark
    print is out does not stand as its second print as well; its third print, which
    settled before, does.  Months that the calendar lacks keep null dates.
    """
    newest = drop_reprint_shadows(latest_lookup(calendar), ["publication", "ref_date"])
    rows = levels.select(
        F.lit("ces").alias("source"), "seasonally_adjusted", F.lit("national").alias("geographic_type"), F.lit("00").alias("geographic_code"),
        survey_level(F.col("code")).alias("industry_type"), F.col("code").alias("industry_code"), "ref_date", F.col("value").alias("employment"),
    )
    return conform(tag(rows, newest, ["ref_date"]), RELEASES)


def combine(*frames: DataFrame) -> DataFrame:
    """Rows of all estimates in one schema; only adjustment and print may be missing from one, any other column is an error."""
    for frame in frames:
        missing = [f.name for f in RELEASES if f.name not in frame.columns and f.name not in _OPTIONAL]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
    return union_by_name(RELEASES, *frames)

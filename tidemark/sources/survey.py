"""Survey prints from files of revision triangles, all files in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import first_friday_release
from tidemark.schemas import VINTAGE, conform

# Names of months in the files' headers.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Which industry and adjustment a file is of, by its path.
FILE_PATTERN = r"tri_([0-9]{6})_(NSA|SA)"


def _month_number(name: Column) -> Column:
    """Months since year 0 of a column named like ``Jan_23``; null for other names."""
    months = F.create_map(*[x for i, m in enumerate(MONTH_NAMES) for x in (F.lit(m), F.lit(i))])
    return (2000 + F.try_to_number(F.substring_index(name, "_", -1), F.lit("99")).cast("int")) * 12 + months[F.substring_index(name, "_", 1)]


def triangle_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all files under ``path`` that a print or a benchmark can come from.

    Each file has a header ``year,month,Jan_23,...`` of its own and a line for
    each release.  A file is read as one row, cut where it lies, and only a band
    leaves it: the three lines from a month's own release on (by place, so a
    release that is missing is passed over), and the lines of later Januaries.

    Returns ``code, seasonally_adjusted, ref, k, release, value``: months are
    counted from year 0, ``k`` is the line's place from the month's own one, and
    null on the lines of Januaries beyond.  Cells that are no number are null.
    """
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    head = text.select(F.regexp_extract("file", FILE_PATTERN, 1).alias("code"), (F.regexp_extract("file", FILE_PATTERN, 2) == "SA").alias("seasonally_adjusted"), lines.alias("lines")).where("code <> ''")
    cut = F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: F.split(x, ","))
    release = lambda r: r[0].try_cast("int") * 12 + r[1].try_cast("int") - 1
    files = head.select("code", "seasonally_adjusted", F.split(F.col("lines")[0], ",").alias("names"), cut.alias("rows"))
    files = files.withColumn("releases", F.transform("rows", release))
    rows = files.select("code", "seasonally_adjusted", "names", "releases", F.posexplode("rows").alias("line", "cells"))
    at = F.col("releases")[F.col("line")]
    cells = rows.select("code", "seasonally_adjusted", "releases", "line", at.alias("release"), "names", F.posexplode("cells").alias("column", "text"))
    named = cells.where("column >= 2").withColumn("ref", _month_number(F.col("names")[F.col("column")]))
    own = F.array_position("releases", F.col("ref")) - 1  # -1: the month has no release of its own
    placed = named.where("ref IS NOT NULL").withColumn("k", (F.col("line") - own).cast("int")).where(own >= 0)
    later = (F.col("release") % 12 == 0) & (F.floor(F.col("release") / 12) > F.floor(F.col("ref") / 12))
    value = F.trim("text").try_cast("double")
    near = F.col("k").between(0, 2)
    band = placed.where(near | later)
    return band.select("code", "seasonally_adjusted", "ref", F.when(near, F.col("k")).alias("k"), later.alias("january"), "release", value.alias("value"))


def _date(month: Column) -> Column:
    return F.make_date(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(12))


def prints(cells: DataFrame) -> DataFrame:
    """First, second and third prints up to the first gap, and a benchmark print for each January that changed the value.

    ``bench_year`` is the year of that January, 0 for the other prints.
    """
    key = ["code", "seasonally_adjusted", "ref"]
    gap = F.min(F.when(F.col("value").isNull(), F.col("k"))).over(Window.partitionBy(*key))
    first = cells.where("k IS NOT NULL").withColumn("_gap", gap).where("value IS NOT NULL AND (_gap IS NULL OR k < _gap)")
    before = F.lag("value").over(Window.partitionBy(*key).orderBy("release"))
    bench = cells.where("january AND value IS NOT NULL").withColumn("_before", before).where("_before IS NULL OR _before <> value")
    zero = F.lit(0)
    rows = first.select(*key, F.col("k").alias("revision"), zero.alias("benchmark_revision"), zero.alias("bench_year"), "value")
    return rows.union(bench.select(*key, F.lit(2), F.lit(1), F.floor(F.col("release") / 12).cast("int"), "value"))


def survey_panel(spark: SparkSession, path: str, industries: DataFrame, *, as_of: Column, first_month: Column, calendar: DataFrame | None = None) -> DataFrame:
    """Store rows of both adjustments from all triangle files under ``path``.

    ``industries`` is a dimension (code, industry_type, industry_code, ownership);
    files of other codes are left out.  A print's vintage date is that of
    ``calendar`` (ref_date, revision, vintage_date) and else the first Friday
    after; a benchmark print has the date of its January's first print.
    Benchmarks that came out after ``as_of`` are left out, and so are months
    before ``first_month``.
    """
    found = prints(triangle_cells(spark, path)).withColumn("ref_date", _date(F.col("ref"))).where(F.col("ref_date") >= first_month)
    bench = F.col("benchmark_revision") == 1
    of = F.when(bench, F.make_date("bench_year", F.lit(1), F.lit(12))).otherwise(F.col("ref_date"))
    number = F.when(bench, 0).otherwise(F.col("revision"))
    dated = found.withColumns({"_of": of, "_n": number, "vintage_date": first_friday_release(F.add_months(of, number))})
    if calendar is not None:
        exact = calendar.select(F.trunc("ref_date", "MM").alias("_m"), F.col("revision").alias("_n"), F.col("vintage_date").alias("_exact"))
        dated = dated.withColumn("_m", F.trunc("_of", "MM")).join(exact, ["_m", "_n"], "left").withColumn("vintage_date", F.coalesce("_exact", "vintage_date"))
    kept = dated.where(~bench | (F.col("vintage_date") <= as_of)).join(F.broadcast(industries), "code")
    tags = {"geographic_type": F.lit("national"), "geographic_code": F.lit("00"), "source": F.lit("ces"), "employment": F.col("value")}
    return conform(kept.withColumns(tags), VINTAGE, fill=True)

"""Landed files and text columns as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import period_date

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated files whose names and values are padded with spaces; all columns are strings."""
    df = spark.read.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])


def triangles(spark: SparkSession, path: str) -> DataFrame:
    """Release-by-month CSV files as (file, release, ref_date, value): columns named like ``Jan_23`` are reference months."""
    wide = spark.read.csv(path, header=True).withColumn("file", F.col("_metadata.file_name"))
    months = [c for c in wide.columns if c not in ("year", "month", "file")]
    long = wide.unpivot(["file", "year", "month"], months, "name", "text").withColumn("value", F.col("text").try_cast("double"))
    return long.select(
        "file", F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1)).alias("release"),
        F.to_date(F.concat(F.lit("12_"), "name"), "d_MMM_yy").alias("ref_date"), "value",
    )


def vintage_matrix(df: DataFrame, ids: list[str]) -> DataFrame:
    """Wide columns ``{SERIES}_{yyyyMMdd}`` as rows; '.' and '' are no values."""
    columns = [c for c in df.columns if c not in ids]
    long = df.unpivot(ids, columns, "name", "text").withColumn("value", F.col("text").try_cast("double")).where("value IS NOT NULL")
    return long.select(*ids, F.to_date(F.regexp_extract("name", r"(\d{8})$", 1), "yyyyMMdd").alias("vintage_date"), "value")


def api_series(df: DataFrame, column: str) -> DataFrame:
    """JSON texts ``Results.series[].data[]`` as (series_id, date, value)."""
    schema = "Results struct<series: array<struct<seriesID: string, data: array<struct<year: string, period: string, value: string>>>>>"
    series = df.select(F.explode(F.from_json(column, schema)["Results"]["series"]).alias("s"))
    rows = series.select(F.col("s.seriesID").alias("series_id"), F.explode("s.data").alias("d"))
    return rows.select("series_id", period_date(F.col("d.year").try_cast("int"), F.col("d.period")).alias("date"), F.col("d.value").try_cast("double").alias("value"))


def wanted_series(df: DataFrame, ids: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Monthly rows (no annual averages) of the listed series and years, with code and adjustment from the id."""
    rows = df.join(F.broadcast(ids), "series_id", "left_semi").where(F.col("period").rlike("^M(0[1-9]|1[0-2])$") & F.col("year").between(first_year, last_year))
    return rows.withColumns({"seasonally_adjusted": F.substring("series_id", 3, 1) == "S", "industry_code": F.substring("series_id", 4, 2)})


def release_dates(pages: DataFrame, html: str = "html", path: str = "url") -> DataFrame:
    """Release date from the text of a page, and reference month from the last ``yyyy-mm`` or ``yyyymm`` of its path."""
    named = F.regexp_extract(html, rf"(?:until|released|[Dd]ate)[^<]{{0,60}}?((?:{_MONTHS}) \d{{1,2}}, (?:19|20)\d{{2}})", 1)
    ref = F.regexp_extract(path, r".*((?:19|20)\d{2})[-/_]?(0[1-9]|1[0-2])(?!\d)", 0)
    year, month = (F.regexp_extract(path, r".*((?:19|20)\d{2})[-/_]?(0[1-9]|1[0-2])(?!\d)", i) for i in (1, 2))
    return pages.withColumns(
        {
            "vintage_date": F.try_to_timestamp(F.nullif(named, F.lit("")), F.lit("MMMM d, yyyy")).cast("date"),
            "ref_date": F.when(ref != "", F.make_date(year.try_cast("int"), month.try_cast("int"), F.lit(1))),
        }
    )


def links(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """Targets of all links of a page, with their order."""
    return pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("n", "href"))


def feed_items(df: DataFrame, column: str) -> DataFrame:
    """Items of RSS texts: title, date and guid; items without all three are left out."""
    item = F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1)))

    def field(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("item", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1)), F.lit(""))

    rows = df.select(item.alias("item")).select(field("title").alias("title"), field("pubDate").alias("published"), field("guid").alias("guid"))
    dated = rows.withColumn("date", F.try_to_timestamp(F.substring("published", 6, 11), F.lit("dd MMM yyyy")).cast("date")).drop("published")
    return dated.where("title IS NOT NULL AND date IS NOT NULL AND guid IS NOT NULL")

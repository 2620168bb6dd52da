"""Census files: suppression, streams by owner and aggregation level, levels of all industries in one roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.dimensions import census_members, current_members, private_members
from tidemark.functions.series import area_geography
from tidemark.operators.calendar import QUARTERLY_LAGS, quarterly_vintage
from tidemark.operators.hierarchy import roll_up, unpivot_months
from tidemark.schemas import PANEL, conform


def disclosed(df: DataFrame) -> DataFrame:
    """Without suppressed cells; a null code is not suppressed."""
    return df.where("disclosure_code IS NULL OR disclosure_code <> 'N'")


def disclosure_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows by disclosure code."""
    return df.groupBy(*by, "disclosure_code").agg(F.count("*").alias("n"))


def stream() -> Column:
    """Which of four streams a row feeds, by owner and aggregation level; null for none."""
    own, level = F.col("own_code"), F.col("agglvl_code")
    return (
        F.when((own == "0") & level.isin("10", "50"), "total")
        .when((own == "5") & level.isin("14", "54"), "private")
        .when(own.isin("1", "2", "3") & level.isin("11", "51") & (F.col("industry_code") == "10"), "government")
        .when((own == "5") & level.isin("15", "55"), "manufacturing")
    )


def levels(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sums for the nation's total, every sector, supersector and domain of each area; one shuffle for all.

    ``df`` has ``area_fips, own_code, agglvl_code, industry_code``, the columns of ``by`` and the value.
    Levels that are null or not positive stand for cells without a count and are left out.
    """
    kind, code = area_geography(F.col("area_fips"))
    at = F.when(F.col("stream") == "total", "00").when(F.col("stream") == "government", F.col("own_code")).otherwise(F.col("industry_code"))
    rows = df.where(F.col(value) > 0).withColumn("stream", stream()).where("stream IS NOT NULL").select(
        kind.alias("geographic_type"), code.alias("geographic_code"), F.concat_ws("/", "stream", at).alias("member"), *by, value
    )
    summed = roll_up(rows, "member", census_members(df.sparkSession), ["geographic_type", "geographic_code", *by], value)
    return summed.withColumnsRenamed({"level": "industry_type", "code": "industry_code"})


#: The months of a quarter in a landed file, and the cells' own columns.
MONTHS = ["month1_emplvl", "month2_emplvl", "month3_emplvl"]
_CELL = ["area_fips", "own_code", "agglvl_code", "industry_code"]


def _monthly(df: DataFrame, more: list[str]) -> DataFrame:
    """Landed quarters as months in thousands (``employment``), whatever text the file holds; months without a number go."""
    typed = df.withColumns({**{m: F.col(m).try_cast("double") for m in MONTHS}, "year": F.col("year").cast("int"), "qtr": F.col("qtr").cast("int")})
    return unpivot_months(typed, [*_CELL, *more], MONTHS, 1000.0).withColumnRenamed("value", "employment")


def _as_store(df: DataFrame) -> DataFrame:
    tags = {"source": F.lit("qcew"), "seasonally_adjusted": F.lit(False), "benchmark_revision": F.lit(0), "vintage_date": quarterly_vintage(F.col("ref_date"), F.col("revision"))}
    return df.withColumns(tags)


def bulk_rows(quarters: DataFrame) -> DataFrame:
    """Store rows of landed yearly files: total, sectors, supersectors and domains of every area, in thousands, as first prints.

    ``quarters`` has the cell columns, ``year, qtr`` and the months of the quarter.
    """
    return _as_store(levels(_monthly(quarters, []), ["ref_date"], "employment").withColumn("revision", F.lit(0)))


def _tree(months: DataFrame, by: list[str]) -> DataFrame:
    """The private tree and the covered total of the nation, with their owner; one shuffle for all levels."""
    private = (F.col("own_code") == "5") & (F.col("area_fips") == "US000")
    whole = (F.col("own_code") == "0") & (F.col("area_fips") == "US000") & (F.col("agglvl_code") == "10") & (F.col("industry_code") == "10")
    member = F.when(private, F.concat_ws("/", "agglvl_code", "industry_code")).when(whole, "all")
    members = private_members(months.sparkSession).union(months.sparkSession.createDataFrame([("all", "total", "00")], "member string, level string, code string"))
    summed = roll_up(months.withColumn("member", member).where("member IS NOT NULL"), "member", members, by, "employment")
    named = summed.withColumnsRenamed({"level": "industry_type", "code": "industry_code"})
    owner = F.when((F.col("industry_type") == "total") & (F.col("industry_code") == "00"), "total").otherwise("private")
    return named.withColumns({"geographic_type": F.lit("national"), "geographic_code": F.lit("00"), "ownership": owner})


def panel(quarters: DataFrame) -> DataFrame:
    """Store rows of the nation from landed area files, by print (``revision``) of each quarter.

    Sums never mix prints.  Zeros count as zeros here: an area file has no
    suppressed cells at these levels.
    """
    return _as_store(_tree(_monthly(quarters, ["revision"]), ["ref_date", "revision"]))


def size_rows(quarters: DataFrame) -> DataFrame:
    """The same for each native ``size_code`` of landed size files, as first prints.

    Size files hold private cells at aggregation levels 21 to 28, ten above those
    of area files, and once more at 61 to 64: only the former count.  Suppressed
    cells go.  All areas are the nation.  Sizes are counted in first quarters, so
    a month of any other fails the job.
    """
    level = F.col("agglvl_code").try_cast("int")
    kept = disclosed(quarters.where((F.col("own_code") == "5") & level.between(21, 28)))
    checked = F.when(F.col("qtr").cast("int") == 1, F.col("qtr")).otherwise(F.raise_error(F.concat(F.lit("sizes of quarter "), F.col("qtr").cast("string"))))
    cells = kept.withColumns({"agglvl_code": (level - 10).cast("string"), "area_fips": F.lit("US000"), "qtr": checked})
    return _as_store(_tree(_monthly(cells, ["size_code"]), ["ref_date", "size_code"]).withColumn("revision", F.lit(0)))


def current_panel(quarters: DataFrame) -> DataFrame:
    """Panel rows of the current census files of the nation and of states: growth of every sector, supersector and domain.

    ``quarters`` has the cell columns, ``year, qtr`` and the months of the quarter
    as text.  Private cells count by sector, government (owners 1 to 3) by its
    total; other areas, owners and codes are passed over, and so are months that
    are no whole positive number.  Cells that name one sector are summed.  Growth is to the series' month before that has
    a level; a month is known so many months later as its quarter's first print is.
    """
    own, month = F.col("own_code"), F.col("ref_date")
    member = F.when(own == "5", F.concat(F.lit("private/"), F.col("industry_code"))).when(own.isin("1", "2", "3") & (F.col("industry_code") == "10"), F.concat(F.lit("government/"), own))
    typed = quarters.where(F.col("area_fips").rlike(r"^(US|[0-9]{2})000$")).withColumns({**{m: F.col(m).try_cast("long") for m in MONTHS}, "year": F.col("year").cast("int"), "qtr": F.col("qtr").cast("int"), "member": member})
    kind, code = area_geography(F.col("area_fips"))
    months = unpivot_months(typed.where("member IS NOT NULL"), ["area_fips", "member"], MONTHS).where("value > 0")
    rows = months.select(kind.alias("geographic_type"), code.alias("geographic_code"), F.trunc(month, "MM").alias("ref_date"), "member", "value")
    by = ["geographic_type", "geographic_code"]
    summed = roll_up(rows, "member", current_members(quarters.sparkSession), [*by, "ref_date"], "value")
    before = F.lag("value").over(Window.partitionBy(*by, "level", "code").orderBy("ref_date"))
    lag = F.create_map(*[F.lit(x) for q, lags in QUARTERLY_LAGS.items() for x in (q, lags[0])])[F.quarter("ref_date")]
    grown = summed.withColumns({"_before": before, "publication_lag_months": lag}).where("_before IS NOT NULL")
    return conform(grown.select(
        *by, F.col("ref_date").alias("period"), F.col("level").alias("industry_level"), F.col("code").alias("industry_code"), F.lit("qcew").alias("source"), F.lit("census").alias("source_type"),
        (F.ln("value") - F.ln("_before")).alias("growth"), F.col("value").alias("employment_level"), F.lit(False).alias("is_seasonally_adjusted"),
        F.expr("add_months(ref_date, publication_lag_months)").alias("vintage_date"), F.lit(0).alias("revision_number"), F.lit(False).alias("is_final"), "publication_lag_months",
    ), PANEL, fill=True)

"""Payroll providers: which of them come by cell, birth rates, growth rows of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import months_between
from tidemark.functions.series import finite
from tidemark.operators import composite
from tidemark.schemas import PANEL, conform


def with_cell_level(df: DataFrame, provider: str) -> DataFrame:
    """Adds ``cell_level``: whether any row of the provider is of a region.  Providers are few; the flag is joined back."""
    flags = df.groupBy(provider).agg(F.coalesce(F.bool_or(F.col("geographic_type") == "region"), F.lit(False)).alias("cell_level"))
    return df.join(flags, provider)


def with_births(df: DataFrame, births: DataFrame) -> DataFrame:
    """Birth rates by date, null where there are none."""
    return df.join(births.select("ref_date", "birth_rate").dropna(), "ref_date", "left")


def growth_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """Panel rows: growth to the row before, known three weeks after the date, never revised.

    Rows without a date or a level are passed over; growth needs two positive, finite levels.
    """
    before = F.lag("employment").over(Window.partitionBy(*by).orderBy("ref_date"))
    rows = df.dropna(subset=["ref_date", "employment"]).withColumn("_before", before)
    grown = rows.where(finite(F.col("_before")) & finite(F.col("employment")) & (F.col("_before") > 0) & (F.col("employment") > 0))
    vintage = F.date_add("ref_date", 21)
    return grown.select(
        *by, F.col("ref_date").alias("period"), (F.ln("employment") - F.ln("_before")).alias("growth"), F.col("employment").alias("employment_level"),
        vintage.alias("vintage_date"), F.lit("payroll").alias("source_type"), F.lit(0).alias("revision_number"), F.lit(True).alias("is_final"),
        months_between(vintage, F.col("ref_date")).alias("publication_lag_months"),
    )


def census_weights(census: DataFrame, cells: list[tuple[str, str]]) -> DataFrame:
    """Shares of the cells (region, supersector) in each census date, as an array in their order: newest prints, cells without one are 0.

    Dates without a positive total go.
    """
    rows = census.where("source = 'qcew' AND geographic_type = 'region' AND industry_type = 'supersector'")
    order = F.struct("vintage_date", "revision", "benchmark_revision", "employment")
    newest = rows.groupBy("ref_date", "geographic_code", "industry_code").agg(F.max_by("employment", order).alias("employment"))
    arrays = composite.cell_arrays(newest, _places(census, cells), ["ref_date"], ["employment"], len(cells))
    levels = F.transform("employment", lambda x: F.coalesce(x, F.lit(0.0)))
    summed = arrays.select("ref_date", levels.alias("_v"), F.aggregate(levels, F.lit(0.0), lambda a, x: a + x).alias("_total"))
    return summed.where("_total > 0").select(F.col("ref_date").alias("weight_date"), F.expr("transform(_v, x -> x / _total)").alias("weights"))


def _places(df: DataFrame, cells: list[tuple[str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame([(r, i, n) for n, (r, i) in enumerate(cells)], "geographic_code string, industry_code string, place int")


def composite_levels(rows: DataFrame, census: DataFrame, cells: list[tuple[str, str]], least: int = 5) -> DataFrame:
    """A national level of each provider that comes by cell: 100 at its first date, chained by the weighted growth of its covered cells.

    ``rows`` has ``provider, geographic_code, industry_code, ref_date, employment,
    n_units``; ``cells`` (region, supersector) are a dimension in canonical order,
    other cells are passed over.  A cell is covered where it has growth since the
    provider's date before, and ``least`` units at both.  Weights are the census
    shares of the newest date up to it within the provider's own range, else of
    the earliest there (``weight_date``, ``months_stale``); those of uncovered
    cells move to covered ones.  A date without a covered cell ends the chain.
    Providers of one date, or without any census date in their range, give no row.

    All of a date's cells are one row of arrays, so the shuffles carry dates, not cells.
    """
    dates = rows.select("provider", "ref_date").where("ref_date IS NOT NULL").distinct()
    spans = dates.groupBy("provider").agg(F.min("ref_date").alias("_a"), F.max("ref_date").alias("_b"), F.count("*").alias("_n")).where("_n > 1")
    shares = census_weights(census, cells)
    months = spans.withColumn("_month", F.explode(F.expr("sequence(trunc(_a, 'MM'), trunc(_b, 'MM'), interval 1 month)")))
    at = shares.select("weight_date", F.trunc("weight_date", "MM").alias("_month"))
    own = months.join(at, "_month").where("weight_date BETWEEN _a AND _b").select("provider", F.col("weight_date").alias("ref_date"))
    targets = dates.join(spans.select("provider"), "provider", "left_semi")
    stale = composite.carry_forward(targets, own, ["provider"], "ref_date").where("weight_date IS NOT NULL")

    arrays = composite.cell_arrays(rows, _places(rows, cells), ["provider", "ref_date"], ["employment", "n_units"], len(cells)).drop("mask")
    w = Window.partitionBy("provider").orderBy("ref_date")
    beside = dates.join(arrays, ["provider", "ref_date"], "left").withColumns({"_e": F.lag("employment").over(w), "_u": F.lag("n_units").over(w), "_at": F.row_number().over(w)})
    positive = lambda x: finite(x) & (x > 0)
    grown = beside.withColumn("_g", F.zip_with("employment", "_e", lambda a, b: F.when(positive(a) & positive(b), F.ln(a) - F.ln(b))))
    places = F.sequence(F.lit(0), F.lit(len(cells) - 1))
    enough = lambda name, i: F.coalesce(F.get(F.col(name), i), F.lit(0)) >= least
    covered = F.transform(places, lambda i: F.get(F.col("_g"), i).isNotNull() & enough("n_units", i) & enough("_u", i))
    ready = grown.withColumn("_covered", covered).join(stale, ["provider", "ref_date"]).join(shares, "weight_date")
    kinds = [{c: n for n, c in enumerate(sorted({cell[k] for cell in cells}))} for k in (0, 1)]
    moved = composite.redistribute(F.col("weights"), F.col("_covered"), [kinds[1][c[1]] for c in cells], [kinds[0][c[0]] for c in cells])
    weighted = ready.withColumn("_w", moved)
    parts = F.zip_with("_w", "_g", lambda x, g: F.when(g.isNotNull(), x * g).otherwise(0.0))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    growth = F.when(F.col("_at") == 1, 0.0).when(F.exists("_covered", lambda c: c), total)
    chained = composite.cumulative_index(weighted.withColumn("growth", growth), ["provider"], "ref_date", through_gaps=False)
    return chained.where("level IS NOT NULL").select("provider", "ref_date", F.col("level").alias("employment"), "weight_date", "months_stale")


def panel_rows(rows: DataFrame, slices: DataFrame, census: DataFrame, cells: list[tuple[str, str]], least: int = 5) -> DataFrame:
    """Panel rows of all providers at once, those that come by cell through ``composite_levels``.

    ``rows`` has ``provider``, the four axes, ``ref_date, employment, n_units``.
    ``slices`` (one row for each provider: the axes that it stands for) names the
    panel's axes; a provider without a row there is left out.  Of a provider that
    does not come by cell the rows of its slice count, where an axis that is null
    (a file without that column) fits any.
    """
    axes = ["geographic_type", "geographic_code", "industry_type", "industry_code"]
    wanted = slices.select("provider", *[F.col(c).alias(f"_{c}") for c in axes])
    flagged = with_cell_level(rows, "provider").join(wanted, "provider")
    fits = F.lit(True)
    for c in axes:
        fits = fits & (F.col(c).isNull() | (F.col(c) == F.col(f"_{c}")))
    national = flagged.where(~F.col("cell_level") & fits).select("provider", "ref_date", F.col("employment").cast("double").alias("employment"))
    by_cell = composite_levels(flagged.where("cell_level"), census, cells, least).select("provider", "ref_date", "employment")
    grown = growth_rows(national.unionByName(by_cell), ["provider"]).join(slices.select("provider", *axes), "provider")
    named = grown.withColumns({"source": F.lower("provider"), "is_seasonally_adjusted": F.lit(False)}).withColumnRenamed("industry_type", "industry_level")
    return conform(named, PANEL, fill=True)

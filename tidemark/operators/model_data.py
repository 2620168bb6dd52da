"""Features, noise and anchors of model rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import era
from tidemark.functions.series import finite
from tidemark.operators.calendar import MONTHLY_NOISE, QUARTERLY_NOISE

# How much noisier months at a quarter's edge are since the first era break, by revision.
BOUNDARY_NOISE = {0: 5.0, 1: 3.5, 2: 2.0}


def features(df: DataFrame, date: str, by: list[str], breaks: list[str]) -> DataFrame:
    """Adds ``month_index`` from 0, ``year_index`` from the first year of the series, and ``era``."""
    first = df.groupBy(*by).agg(F.min(F.year(date)).alias("_first"))
    rows = df.join(first, by).withColumns({"month_index": F.month(date) - 1, "year_index": F.year(date) - F.col("_first"), "era": era(F.col(date), breaks)})
    return rows.drop("_first")


def interior(d: Column) -> Column:
    """Whether a month is the middle one of its quarter."""
    return F.month(d) % 3 == 2


def _looked_up(table: dict[int, float], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def noise() -> Column:
    """Noise multiplier of a panel row by source, revision and quarter; 1 where no schedule has one."""
    quarterly = {10 * q + r: x for q, values in QUARTERLY_NOISE.items() for r, x in enumerate(values)}
    survey = F.col("source").isin("ces_sa", "ces_nsa")
    revision = F.col("revision_number")
    census = F.when(revision.between(0, 9), _looked_up(quarterly, F.quarter("period") * 10 + revision))
    return F.coalesce(F.when(survey, _looked_up(MONTHLY_NOISE, revision)).when(F.col("source") == "qcew", census), F.lit(1.0))


def boundary_noise(breaks: list[str], default: float = 1.0) -> Column:
    """The census multiplier, raised at the edges of quarters from the first era break on."""
    edge = ~interior(F.col("period")) & (era(F.col("period"), breaks) >= 1)
    return noise() * F.when(edge, F.coalesce(_looked_up(BOUNDARY_NOISE, F.col("revision_number")), F.lit(default))).otherwise(1.0)


def contiguous(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the place of a value among the distinct values of all rows, from 0; null stays null.

    For columns of few values: their sorted set is one row, from which a small dimension is made.
    """
    places = df.agg(F.array_sort(F.collect_set(column)).alias("_seen")).select(F.posexplode("_seen").alias(out, column))
    return df.join(F.broadcast(places), column, "left")


def index_anchor(df: DataFrame, by: list[str], date: str, index: str, level: str) -> DataFrame:
    """``base_index``: the first finite index (100 where none is); ``index_to_level``: a hundredth of the level nearest to 100.

    Of rows equally near the earlier counts.
    """
    at = F.when(finite(F.col(index)), F.col(date))
    near = F.when(finite(F.col(index)), F.struct(F.abs(F.col(index) - 100), F.col(date)))
    return df.groupBy(*by).agg(F.coalesce(F.min_by(index, at), F.lit(100.0)).alias("base_index"), (F.min_by(level, near) / 100).alias("index_to_level"))


def snapshot_anchor(token: Column) -> Column:
    """The 12th of a token's last month: ``2025-Q2`` or a date; others are null."""
    year, quarter = F.regexp_extract(token, r"^(\d{4})-Q([1-4])$", 1), F.regexp_extract(token, r"^(\d{4})-Q([1-4])$", 2)
    of_quarter = F.make_date(year.try_cast("int"), quarter.try_cast("int") * 3, F.lit(12))
    return F.when(token.contains("-Q"), of_quarter).otherwise(F.date_add(F.trunc(token.try_cast("date"), "MM"), 11))


def newest_quarter(calendar: DataFrame, by: list[str], as_of: Column, candidates: int = 8) -> DataFrame:
    """The newest quarter (first day) whose first print was out, of so many before the current one."""
    current, of = F.trunc(as_of, "quarter"), F.trunc("ref_date", "quarter")
    known = (F.col("revision") == 0) & (F.col("vintage_date") <= as_of) & (of < current) & (of >= F.add_months(current, -3 * candidates))
    return calendar.where(known).groupBy(*by).agg(F.max(of).alias("quarter"))


def newest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One whole row of each group: the greatest by ``order``."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(*order)).alias("_row")).select(*by, "_row.*")


def assemble(panel: DataFrame, by: list[str], breaks: list[str], as_of: Column | None = None, noise_default: float = 1.0) -> DataFrame:
    """What a model observes of each series of ``by``: one row for each source and month with growth, on the series' own calendar.

    ``t`` counts the months that any print known by ``as_of`` has, from 0;
    ``month_index``, ``year_index`` and ``era`` go with it.  Of the survey the most
    revised of the prints 0 to 2 counts (benchmark prints never), of all other
    sources the final print, then the most revised; a best print without finite
    growth is a gap, not the next print's turn.  ``vintage_index`` numbers the
    survey's revisions that occur, in both adjustments together; ``interior``
    and ``noise`` are the census's; ``level`` chains the growth from 100.

    One shuffle on ``by``: every window is clustered within it.
    """
    rows = panel if as_of is None else panel.where(F.col("vintage_date").isNull() | (F.col("vintage_date") <= as_of))
    series = Window.partitionBy(*by)
    dated = rows.withColumns({"t": F.dense_rank().over(series.orderBy("period")) - 1, "_year": F.min(F.year("period")).over(series)})
    survey = F.col("source").isin("ces_sa", "ces_nsa")
    revised = F.when(F.col("revision_number") == -1, 999).otherwise(F.col("revision_number"))
    final = F.when(survey, 0).otherwise(F.coalesce("is_final", F.lit(False)).cast("int"))
    best = Window.partitionBy(*by, "source", "period").orderBy(F.desc(final), F.desc(revised), F.desc("vintage_date"), F.desc("growth"))
    counts = dated.where(~survey | F.col("revision_number").isin(0, 1, 2)).withColumn("_rn", F.row_number().over(best))
    seen = counts.where((F.col("_rn") == 1) & finite(F.col("growth"))).withColumn("_survey", survey)
    place = F.dense_rank().over(Window.partitionBy(*by, "_survey").orderBy("revision_number")) - 1
    chain = F.sum("growth").over(Window.partitionBy(*by, "source").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    census = F.col("source") == "qcew"
    return seen.select(
        *by, "source", "period", "t", (F.month("period") - 1).alias("month_index"), (F.year("period") - F.col("_year")).alias("year_index"), era(F.col("period"), breaks).alias("era"),
        "growth", "revision_number", F.when(F.col("_survey"), place).alias("vintage_index"), F.when(census, interior(F.col("period"))).alias("interior"),
        F.when(census, boundary_noise(breaks, noise_default)).alias("noise"), (100 * F.exp(chain)).alias("level"),
    )

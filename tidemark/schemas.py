"""Fixed schemas, and frames that conform to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "date": T.DateType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in map(str.split, text.split(","))])


VINTAGE = _schema(
    "geographic_type string, geographic_code string, ownership string, industry_type string, industry_code string,"
    "ref_date date, vintage_date date, revision int, benchmark_revision int, employment double,"
    "size_class_type string, size_class_code string, source string, seasonally_adjusted boolean"
)
PANEL = _schema(
    "period date, geographic_type string, geographic_code string, industry_code string, industry_level string,"
    "source string, source_type string, growth double, employment_level double, is_seasonally_adjusted boolean,"
    "vintage_date date, revision_number int, is_final boolean, publication_lag_months int, coverage_ratio double"
)
#: Estimates of all programmes as they are combined into releases.
RELEASES = _schema(
    "source string, seasonally_adjusted boolean, geographic_type string, geographic_code string, industry_type string, industry_code string,"
    "ref_date date, vintage_date date, revision int, benchmark_revision int, employment double"
)
CALENDAR = _schema("publication string, ref_date date, vintage_date date, revision int, benchmark_revision int")

#: What makes a stored row unique; the vintage date and the level are not part of it.
STORE_KEY = [
    "source", "seasonally_adjusted", "ref_date", "industry_type", "industry_code", "geographic_type", "geographic_code",
    "revision", "benchmark_revision", "ownership", "size_class_type", "size_class_code",
]
#: One time series, and one revision cohort of it.
SERIES = ["source", "seasonally_adjusted", "geographic_type", "geographic_code", "industry_type", "industry_code"]
COHORT = [*SERIES, "revision", "benchmark_revision"]


def conform(df: DataFrame, schema: T.StructType, fill: bool = False) -> DataFrame:
    """``df`` with the columns and types of ``schema``, in its order; with ``fill`` missing columns are null."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing and not fill:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[(F.lit(None) if f.name in missing else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows of a schema."""
    return spark.createDataFrame([], schema)


def union_by_name(schema: T.StructType, *frames: DataFrame) -> DataFrame:
    """Rows of all frames in one schema; columns that a frame lacks are null."""
    out = conform(frames[0], schema, fill=True)
    for frame in frames[1:]:
        out = out.unionByName(conform(frame, schema, fill=True))
    return out

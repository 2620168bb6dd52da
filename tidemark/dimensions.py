"""Industry and benchmark dimensions, and the joins that put rows on their axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sectors of each private supersector.
SUPERSECTORS = {
    "10": ("21",),
    "20": ("23",),
    "30": ("31",),
    "40": ("22", "42", "44", "48"),
    "50": ("51",),
    "55": ("52", "53"),
    "60": ("54", "55", "56"),
    "65": ("61", "62"),
    "70": ("71", "72"),
    "80": ("81",),
}
GOODS = ("10", "20", "30")
# Sectors that the store keeps.
STORED_SECTORS = ("11", "21", "22", "23", "31", "32", "42", "44", "48", "51", "52", "53", "54", "55", "56", "61", "62", "71", "72", "81")
# Three-digit manufacturing codes of durable (31) and nondurable (32) goods.
MANUFACTURING = {
    "31": ("321", "327", "331", "332", "333", "334", "335", "336", "337", "339"),
    "32": ("311", "312", "313", "314", "315", "316", "322", "323", "324", "325", "326"),
}
# Census codes of supersectors at aggregation level 13; supersector 10 is the sum of its sectors instead.
CENSUS_SUPERSECTORS = {"20": "1012", "30": "1013", "40": "1021", "50": "1022", "55": "1023", "60": "1024", "65": "1025", "70": "1026", "80": "1027"}
# The one part of agriculture and forestry (sector 11) that the survey covers, at aggregation level 16.
LOGGING = "1133"
# Government sectors by owner, codes written as ranges, and old sector codes.
GOVERNMENT = {"1": "91", "2": "92", "3": "93"}
RANGES = {"44-45": "44", "48-49": "48"}
RECODED = {"41": "42", "42": "44", "43": "48"}
# Sectors by the codes of the census's own files, which differ from those of ``CENSUS_SUPERSECTORS``.
CURRENT_CODES = {
    "1012": "21", "1013": "22", "1021": "23", "1022": "31", "1023": "42", "1024": "44", "1025": "48", "1026": "51", "1027": "52",
    "1028": "53", "1029": "54", "102A": "55", "102B": "56", "102C": "61", "102D": "62", "102E": "71", "102F": "72", "102G": "81",
    "31-33": "31",
}
# Supersectors that are one sector.
SINGLE_SECTOR = {"20": "23", "50": "51", "80": "81"}
# Benchmark revisions by March reference year; None is left out of evaluations.
BENCHMARKS = {
    2009: -902, 2010: -378, 2011: 229, 2012: 481, 2013: 340, 2014: 105, 2015: -259, 2016: -151, 2017: 136,
    2018: -43, 2019: -505, 2020: None, 2021: None, 2022: 462, 2023: -105, 2024: -598, 2025: -862,
}


def industries(spark: SparkSession) -> DataFrame:
    """The stored axes: ``industry_type, industry_code, ownership``."""
    rows = [("total", "00", "total"), ("total", "05", "private"), ("domain", "06", "private"), ("domain", "08", "private")]
    rows += [("supersector", code, "private") for code in SUPERSECTORS] + [("sector", code, "private") for code in STORED_SECTORS]
    return spark.createDataFrame(rows, "industry_type string, industry_code string, ownership string")


def _renamed(df: DataFrame) -> DataFrame:
    old = (F.col("industry_type") == "national") | ((F.col("industry_type") == "domain") & (F.col("industry_code") == "05"))
    return df.withColumn("industry_type", F.when(old, "total").otherwise(F.col("industry_type")))


def remap(df: DataFrame) -> DataFrame:
    """Rows on the stored axes with their ``ownership``; what is not stored goes (see ``unknown``)."""
    return _renamed(df.drop("ownership")).join(F.broadcast(industries(df.sparkSession)), ["industry_type", "industry_code"])


def unknown(df: DataFrame) -> DataFrame:
    """Rows whose industry the stored axes lack, nulls too."""
    return _renamed(df).join(F.broadcast(industries(df.sparkSession)), ["industry_type", "industry_code"], "left_anti")


def recode(df: DataFrame) -> DataFrame:
    """Old sector codes replaced; a supersector that is one sector stands a second time as that sector."""

    def looked_up(table: dict[str, str]):
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("industry_code")]

    sector = F.col("industry_type") == "sector"
    code = F.when(sector, F.coalesce(looked_up(RECODED), "industry_code")).otherwise(F.col("industry_code"))
    own = F.struct(F.col("industry_type").alias("t"), code.alias("c"))
    alias = F.struct(F.lit("sector").alias("t"), looked_up(SINGLE_SECTOR).alias("c"))
    both = (F.col("industry_type") == "supersector") & looked_up(SINGLE_SECTOR).isNotNull()
    rows = df.withColumn("_as", F.explode(F.when(both, F.array(own, alias)).otherwise(F.array(own))))
    return rows.withColumns({"industry_type": F.col("_as.t"), "industry_code": F.col("_as.c")}).drop("_as")


def census_members(spark: SparkSession) -> DataFrame:
    """What each census code counts towards: ``member`` (stream/code), ``level``, ``code``."""
    above = {s: up for up, sectors in SUPERSECTORS.items() for s in sectors} | {"32": "30"} | dict.fromkeys(GOVERNMENT.values(), "90")
    of = {f"private/{s}": s for s in above if s not in ("31", "32", *GOVERNMENT.values())} | {f"private/{r}": s for r, s in RANGES.items()}
    of |= {f"government/{o}": s for o, s in GOVERNMENT.items()}
    of |= {f"manufacturing/{c}": s for s, codes in MANUFACTURING.items() for c in codes}
    rows = [("total/00", "national", "00")]
    for member, sector in of.items():
        up = above[sector]
        domains = ("07",) if up == "90" else ("05", "06") if up in GOODS else ("05", "07", "08")
        rows += [(member, "sector", sector), (member, "supersector", up), *[(member, "domain", d) for d in domains]]
    return spark.createDataFrame(rows, "member string, level string, code string")


def private_members(spark: SparkSession) -> DataFrame:
    """What each cell of private national census counts towards: ``member`` (aggregation level/code), ``level``, ``code``.

    Supersectors have cells of their own; domains and the total are sums of supersectors.
    """
    codes = {s: {f"14/{s}"} for s in STORED_SECTORS} | {s: {f"14/{r}"} for r, s in RANGES.items()}
    codes |= {"11": {f"16/{LOGGING}"}} | {s: {f"15/{c}" for c in three} for s, three in MANUFACTURING.items()}
    rows = [(member, "sector", s) for s, members in codes.items() for member in sorted(members)]
    cells = {up: {f"13/{c}"} for up, c in CENSUS_SUPERSECTORS.items()} | {"10": codes["11"] | codes["21"]}
    for up, members in cells.items():
        domain = "06" if up in GOODS else "08"
        rows += [(m, *axis) for m in sorted(members) for axis in (("supersector", up), ("domain", domain), ("total", "05"))]
    return spark.createDataFrame(rows, "member string, level string, code string")


def current_members(spark: SparkSession) -> DataFrame:
    """What each code of a current census file counts towards: ``member`` (private/code or government/owner), ``level``, ``code``.

    A sector has its own code, a range, or a code of the files; all levels are sums of sectors.
    """
    above = {s: up for up, sectors in SUPERSECTORS.items() for s in sectors}
    of = {f"private/{c}": s for c, s in ({s: s for s in above} | CURRENT_CODES | RANGES).items()} | {f"government/{o}": s for o, s in GOVERNMENT.items()}
    rows = []
    for member, sector in of.items():
        up = above.get(sector, "90")
        domains = ("00", "07") if up == "90" else ("00", "05", "06") if up in GOODS else ("00", "05", "07", "08")
        rows += [(member, "sector", sector), (member, "supersector", up), *[(member, "domain", d) for d in domains]]
    return spark.createDataFrame(rows, "member string, level string, code string")


def with_benchmark(df: DataFrame, year: str) -> DataFrame:
    """Adds ``benchmark`` and ``benchmark_known``: a year of the table without a value is known, but left out."""
    rows = df.sparkSession.createDataFrame(list(BENCHMARKS.items()), f"`{year}` int, benchmark int").withColumn("_known", F.lit(True))
    return df.join(F.broadcast(rows), year, "left").withColumn("benchmark_known", F.coalesce("_known", F.lit(False))).drop("_known")

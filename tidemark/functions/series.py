"""Column expressions of vintage rows and series identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def source_tag() -> Column:
    """ces_sa, ces_nsa or the source itself."""
    return F.when(F.col("source") == "ces", F.when(F.col("seasonally_adjusted"), "ces_sa").otherwise("ces_nsa")).otherwise(F.col("source"))


def source_type() -> Column:
    """What kind of count the source is."""
    return F.when(F.col("source") == "ces", "survey").when(F.col("source") == "qcew", "census").otherwise("payroll")


def revision_number() -> Column:
    """Survey benchmark prints are -1; all others keep their revision."""
    return F.when((F.col("source") == "ces") & (F.col("benchmark_revision") > 0), -1).otherwise(F.col("revision")).cast("int")


def is_final(settled_before: Column) -> Column:
    """Survey: the benchmark print; census: settled years, else the last revision that its quarter gets."""
    last = F.element_at(F.array(*map(F.lit, (4, 3, 2, 1))), F.quarter("ref_date"))
    census = (F.col("ref_date") < settled_before) | (F.col("revision") == last)
    return F.when(F.col("source") == "ces", revision_number() == -1).otherwise(census)


def all_sizes() -> Column:
    """Rows that are not split by size."""
    return F.col("size_class_type").isNull() | (F.col("size_class_code") == "0")


def area_geography(area: Column) -> tuple[Column, Column]:
    """Geography type and code of an area code: US000 is the nation, else the first two characters name a state."""
    nation = area == "US000"
    return F.when(nation, "national").otherwise("state"), F.when(nation, "00").otherwise(F.substring(area, 1, 2))


def known_by(d: Column, as_of: Column, lag_months: int) -> Column:
    """Whether the month of ``d`` was published by ``as_of``, so many months after it."""
    return F.trunc(F.add_months(d, lag_months), "MM") <= as_of


#: Positions of the fields of a series identifier, by its first two characters: name, first character, length.
SERIES_FIELDS = {
    "CE": (("seasonal", 3, 1), ("industry", 4, 8), ("data_type", 12, 2)),
    "SM": (("seasonal", 3, 1), ("state", 4, 2), ("area", 6, 5), ("industry", 11, 8), ("data_type", 19, 2)),
    "EN": (("seasonal", 3, 1), ("area", 4, 5), ("data_type", 9, 1), ("size", 10, 1), ("ownership", 11, 1), ("industry", 12, 6)),
}


def series_id_field(series_id: Column, name: str) -> Column:
    """One field of a series identifier; null where its program has none or the length is wrong."""
    out = F.lit(None).cast("string")
    for program, fields in SERIES_FIELDS.items():
        for field, at, length in fields:
            if field == name:
                whole = fields[-1][1] + fields[-1][2] - 1
                fits = series_id.startswith(program) & (F.length(F.rtrim(series_id)) == whole)
                out = F.when(fits, F.substring(series_id, at, length)).otherwise(out)
    return out


def build_series_id(program: str, **parts: Column) -> Column:
    """A series identifier from its fields, each padded on the right with zeros."""
    return F.concat(F.lit(program), *[F.rpad(parts[name], length, "0") for name, _, length in SERIES_FIELDS[program]])

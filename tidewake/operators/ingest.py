"""Cleaning of raw positions: filters, sentinels, labels, dedup and forward fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free
from . import scan

# Navigational status by code (13 has no label).
NAV_STATUS = {
    0: "under way using engine", 1: "at anchor", 2: "not under command", 3: "restricted manoeuvrability", 4: "constrained by her draught", 5: "moored", 6: "aground",
    7: "engaged in fishing", 8: "under way sailing", 9: "reserved for high speed craft", 10: "reserved for wing in ground", 11: "power-driven vessel towing astern",
    12: "power-driven vessel pushing ahead", 14: "AIS-SART / MOB / EPIRB", 15: "undefined",
}
# Categories of ship types, at ingest and for trips, by text and by code range.
INGEST_TEXT = {"fishing": "Fishing", "cargo": "Cargo", "tanker": "Tanker", "passenger": "Passenger", "tug": "Tug", "towing": "Tug", "towing long/wide": "Tug", "port tender": "Tug", "sailing": "Sailing", "pleasure": "Pleasure Craft", "hsc": "High speed craft"}
INGEST_CODES = [(30, 30, "Fishing"), (31, 32, "Tug"), (52, 53, "Tug"), (36, 36, "Sailing"), (37, 37, "Pleasure Craft"), (40, 49, "High speed craft"), (60, 69, "Passenger"), (70, 79, "Cargo"), (80, 89, "Tanker")]
TRIP_TEXT = {"fishing": "fishing", "cargo": "cargo", "tanker": "tanker", "passenger": "passenger", "tug": "tug", "towing": "tug", "towing long/wide": "tug", "port tender": "tug", "pleasure": "pleasure_craft", "sailing": "pleasure_craft", "hsc": "special_craft", "pilot": "special_craft", "sar": "special_craft", "dredging": "special_craft", "law enforcement": "special_craft", "military": "special_craft", "diving": "special_craft", "anti-pollution": "special_craft", "medical": "special_craft"}
TRIP_CODES = [(70, 79, "cargo"), (80, 89, "tanker"), (60, 69, "passenger"), (30, 30, "fishing"), (32, 33, "fishing"), (21, 22, "tug"), (31, 31, "tug"), (36, 37, "pleasure_craft"), (50, 59, "special_craft")]
US_NAMES = {"Status": "Navigational status", "Draft": "Draught", "VesselType": "Ship type", "VesselName": "Name"}


def valid_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Nulls fail the comparison, and NaN lies above every bound."""
    return df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


def of_types(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(values)) if values else df


def sentinels_to_null(df: DataFrame, sog: str = "sog", cog: str = "cog", heading: str = "heading") -> DataFrame:
    """The values that stand for `not available` become null."""
    bad = {sog: F.col(sog) >= 102.3, cog: F.col(cog) >= 360, heading: F.col(heading) > 359}
    return df.withColumns({c: F.when(cond, None).otherwise(F.col(c)) for c, cond in bad.items() if c in df.columns})


def renamed(df: DataFrame, names: dict[str, str] = US_NAMES) -> DataFrame:
    """Each name that is there, unless its new one is too."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def nav_label(code: Column) -> Column:
    whole = F.floor(code.cast("string").try_cast("double")).cast("int")
    out = F.lit(None).cast("string")
    for k, label in NAV_STATUS.items():
        out = F.when(whole == k, label).otherwise(out)
    return out


def category(kind: Column, texts: dict[str, str], codes: list[tuple[int, int, str]], default: str) -> Column:
    """By text, else by integer code, else the default.  A number column counts by its whole part (70.9 as 70); the text '70.0'
    is no integer."""
    number = F.typeof(kind).isin("tinyint", "smallint", "int", "bigint", "float", "double")
    text = F.lower(F.trim(kind.cast("string")))
    whole = kind.cast("string").try_cast("double")
    whole = F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole))
    number = F.when(number & (F.abs(whole) < 1e9), whole).when(~number & text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    out = F.lit(default)
    for low, high, label in reversed(codes):
        out = F.when(number.between(low, high), label).otherwise(out)
    for word, label in texts.items():
        out = F.when(text == word, label).otherwise(out)
    return out


def ingest_category(kind: Column) -> Column:
    return category(kind, INGEST_TEXT, INGEST_CODES, "Default")


def trip_category(kind: Column) -> Column:
    return category(kind, TRIP_TEXT, TRIP_CODES, "unknown")


def without_noise(df: DataFrame, column: str = "annotation") -> DataFrame:
    return df.withColumn(column, F.coalesce(column, F.lit(""))).where(F.trim(column) != "NOISE")


def deduplicated(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row by ``order`` of each key."""
    (n,) = free(df, "_n")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def forward_filled(df: DataFrame, key: str, order: list[str], columns: list[str], ranges: str | None = None) -> DataFrame:
    """Columns (those that are there) by their last value that is not null.  ranges: a column of scan.with_ranges(), where a
    vessel may have too many rows for a task."""
    if ranges:
        return scan.forward_filled(df, [key], order, columns, ranges)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns if c in df.columns})


def vessel_info(df: DataFrame, key: str = "mmsi", kind: str = "ship_code") -> DataFrame:
    """A row per distinct key and type."""
    return df.select(key, kind).distinct().withColumn("category", ingest_category(F.col(kind)))

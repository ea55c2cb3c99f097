"""Column expressions of single values: scaling, units and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clip(x: Column, scale: float, shift: float, low: float) -> Column:
    known = F.when(x.isNull() | F.isnan(x.cast("double")), 0.0).otherwise(x.cast("double"))
    return F.greatest(F.lit(low), F.least(F.lit(1.0), known / scale - shift))


def kinematics(sog: Column, cog: Column, rot: Column) -> dict[str, Column]:
    """speed_n (0 to 1 at 30 kn), heading_n and turn_n (-1 to 1); what is missing counts as 0."""
    return {"speed_n": _clip(sog, 30.0, 0.0, 0.0), "heading_n": _clip(cog, 180.0, 1.0, -1.0), "turn_n": _clip(rot, 720.0, 0.0, -1.0)}


def rank_in(values: Column, x: Column, step: int = 128) -> Column:
    """How many of a sorted array's values are not above x (0 for null): of every step-th first, then within that block."""
    firsts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(step))
    block = F.greatest(F.size(F.filter(firsts, lambda i: F.get(values, i) <= x)) - 1, F.lit(0))
    return block * step + F.size(F.filter(F.slice(values, block * step + 1, step), lambda v: v <= x))


def calendar(day_of_week: Column, hour: Column, minute: Column) -> dict[str, Column]:
    """Weekday (Monday 0), hour and minute from 0 to 1."""
    return {"dow": day_of_week / 6.0, "hod": hour / 23.0, "moh": minute / 59.0}


def denormalised(y: Column, x: Column, half: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """lat and lon of offsets over half the box from a first point."""
    return y * half + lat0, x * half + lon0


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def millimetres(metres: Column) -> Column:
    return metres * 1000


def cell_id(x: Column, y: Column, x_min: float, y_min: float, size: float, columns: int) -> Column:
    """The number of a grid's cell, row by row; offsets are rounded to 6 places first."""
    at = lambda c, low: F.floor(F.round((c - low) / size, 6))
    return at(y, y_min) * columns + at(x, x_min)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), " ", "_")


def city_of(city: Column, sea_area: Column) -> Column:
    """The sea area's slug where it has a name, else the city."""
    return F.when(F.trim(sea_area) != "", slug(sea_area)).otherwise(city)


def without_split(name: Column) -> Column:
    """A name without the split at its end."""
    return F.regexp_replace(name, r"(?i)_(train|test|val|valid|dev)$", "")


def united(*frames: DataFrame) -> DataFrame:
    """The rows of all frames by column name; columns that one lacks are null, and rows without a city stay."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out

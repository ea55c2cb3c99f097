"""Column expressions of geography and motion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
EARTH_NM = 6371.0088 / 1.852
GEOHASH_LETTERS = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed value: the alphabet of geohash


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the radius's unit; the root's argument is kept within 0 and 1."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def half_even(x: Column, digits: int) -> Column:
    """x to so many digits: scaled, rounded to the even one of two equally near integers, and scaled back."""
    scale = float(10**digits)
    return F.rint(x.cast("double") * scale) / scale


def modulo(x: Column, n: float) -> Column:
    """The remainder with the divisor's sign, also for negative x."""
    return F.pmod(x, F.lit(float(n)))


def angle_difference(a: Column, b: Column) -> Column:
    """a - b in degrees, from -180 up to 180, two digits."""
    return half_even(modulo(a - b + 180, 360) - 180, 2)


def bearing_label(degrees: Column) -> Column:
    names = ["North", "Northeast", "East", "Southeast", "South", "Southwest", "West", "Northwest"]
    i = F.floor((modulo(degrees, 360) + 22.5) / 45) % 8
    return F.coalesce(F.get(F.array(*map(F.lit, names)), i.cast("int")), F.lit("unknown"))


def geohash(lat: Column, lon: Column, length: int) -> Column:
    """Interleaves the bits of both scaled coordinates, longitude first, five bits a letter."""
    bits = 5 * length
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << n_lon)), F.lit((1 << n_lon) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * (1 << n_lat)), F.lit((1 << n_lat) - 1)).cast("long")
    bit = lambda k: F.shiftright(x, n_lon - 1 - k // 2).bitwiseAND(1) if k % 2 == 0 else F.shiftright(y, n_lat - 1 - k // 2).bitwiseAND(1)
    letters = []
    for at in range(0, bits, 5):
        value = sum((bit(at + j) * (16 >> j) for j in range(1, 5)), bit(at) * 16)
        letters.append(F.substring(F.lit(GEOHASH_LETTERS), value.cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Spherical Web-Mercator metres, x and y."""
    half = 20037508.34
    y = F.log(F.tan((lat + 90) * F.lit(3.141592653589793) / 360)) / (F.lit(3.141592653589793) / 180)
    return lon * half / 180, y * half / 180


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of spherical Web-Mercator metres."""
    half, pi = 20037508.34, F.lit(3.141592653589793)
    return F.atan(F.exp(y / half * pi)) * 360 / pi - 90, x * 180 / half


def speed_from_components(u: Column, v: Column, scale: float = 3.6) -> Column:
    return F.sqrt(u * u + v * v) * scale


def wind_direction(u: Column, v: Column) -> Column:
    """Where the wind comes from, in degrees."""
    return modulo(270 - F.degrees(F.atan2(v, u)), 360)


def current_direction(u: Column, v: Column) -> Column:
    """Where a current of u eastwards and v northwards goes, in degrees from north."""
    return modulo(F.degrees(F.atan2(u, v)) + 360, 360)

"""Descriptions of points in fixed words, slot by slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bearing_label
from .tasks import top_categories

# The words of the descriptions, here and below.
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def number(x: Column, digits: int) -> Column:
    """Fixed digits, halves to even; null for null."""
    return _format(f"%.{digits}f", F.bround(x, digits))


def _format(pattern: str, x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string(pattern, x))


def _given(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, null where it is not there, and for NaN and the empty string."""
    if name not in df.columns:
        return F.lit(None).cast(kind)
    c = F.col(f"`{name}`")
    return F.nanvl(c.cast("double"), F.lit(None).cast("double")) if kind == "double" else F.nullif(c.cast(kind), F.lit("")) if kind == "string" else c.cast(kind)


def _day(d: Column) -> Column:
    return F.get(F.array(*map(F.lit, DAYS)), d.cast("int"))


def _list(*parts: Column) -> Column:
    """Those that are not null, with commas between."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ", ")


def urban(df: DataFrame) -> Column:
    text = lambda n, default: F.coalesce(_given(df, n), F.lit(default))
    speed, accel = _given(df, "speed_ms", "double"), _given(df, "acceleration_ms2", "double")
    kmh = F.concat(number(speed * 3.6, 2), F.lit(" km/h"))
    agent = F.concat(F.lit("[AGENT]: "), text("transport_mode", "vehicle"), F.lit(", "), text("behavioral_phase", "moving"), F.coalesce(F.concat(F.lit(" at "), kmh), F.lit("")))
    lanes, limit = F.coalesce(_given(df, "road_lanes", "int"), F.lit(0)), _given(df, "speed_limit_kmh", "double")
    road = _list(
        F.replace(text("road_type", "unknown"), F.lit("_"), F.lit(" ")), F.concat(F.lit("named "), F.nullif(F.trim(_given(df, "road_name")), F.lit(""))), F.concat(number(limit, 0), F.lit(" km/h limit")),
        F.when(lanes != 0, F.concat(F.lit("has "), lanes.cast("string"), F.lit(" lanes"))), F.when(F.coalesce(_given(df, "road_oneway", "boolean"), F.lit(False)), "is one-way").otherwise("is not one-way"),
    )
    pois = []
    for r in (50, 200, 500):
        n = F.coalesce(_given(df, f"poi_count_{r}m", "int"), F.lit(0))
        cats = F.array_join(F.coalesce(top_categories(_given(df, f"poi_categories_{r}m")), F.array().cast("array<string>")), ", ")
        pois.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" point(s) of interest within {r}m "), F.when(cats != "", F.concat(F.lit("("), cats, F.lit(")"))).otherwise(""))))
    around = F.when(_list(*pois) == "", "no points of interest nearby").otherwise(_list(*pois))
    use = F.trim(text("land_use", "unknown"))
    zone = F.when(use.isin("unknown", "other", ""), "no designated land use zone").otherwise(F.concat(F.replace(use, F.lit("_"), F.lit(" ")), F.lit(" zone")))
    change = F.when(F.abs(accel) > 0.5, F.concat(F.when(accel > 0, "accelerating").otherwise("decelerating"), F.lit(" at "), number(F.abs(accel), 2), F.lit(" m/s^2")))
    phase = _list(text("behavioral_phase", "unknown"), kmh, change)
    temp, rain, wind, direction = (_given(df, n, "double") for n in ("temperature_c", "precipitation_mm", "wind_speed_kmh", "wind_direction_deg"))
    sky = F.trim(_given(df, "weather_description"))
    weather = _list(F.concat(number(temp, 1), F.lit(" degrees Celcius")), F.when(~sky.isin("unknown", ""), sky), F.when(rain > 0.05, F.concat(number(rain, 1), F.lit(" mm/h precipitation"))), F.concat(F.lit("wind "), number(wind, 2), F.lit(" km/h")), F.concat(F.lit("wind direction "), number(direction, 1), F.lit(" degrees")))
    air = F.when(weather == "", "weather data unavailable.").otherwise(weather)
    hour = _given(df, "hour_of_day", "int")
    when = _list(_day(_given(df, "day_of_week", "int")), _format("%02d:00", hour), F.replace(_given(df, "time_of_day_category"), F.lit("_"), F.lit(" ")), _given(df, "season"), F.when(_given(df, "is_weekend", "boolean"), "weekend"))
    when = F.when(when == "", "time unknown").otherwise(when)
    n500 = F.coalesce(_given(df, "poi_count_500m", "int"), F.lit(0))
    density = F.when(n500 == 0, "sparse").when(n500 < 10, "low").when(n500 < 40, "moderate").otherwise("high")
    slots = [
        agent, F.concat(F.lit("[CORRIDOR]: "), road, F.lit(".")), F.concat(F.lit("[INFRASTRUCTURE]: "), around, F.lit(".")), F.concat(F.lit("[REGULATORY_ZONE]: "), zone, F.lit(".")),
        F.concat(F.lit("[BEHAVIORAL_PHASE]: "), phase, F.lit(".")), F.concat(F.lit("[ENVIRONMENT]: "), air), F.concat(F.lit("[TEMPORAL]: "), when, F.lit(".")),
        F.concat(F.lit("[SPATIAL_CONTEXT]: "), density, F.lit(" point of interest density ("), n500.cast("string"), F.lit(" points of interest within 500 m).")),
    ]
    return F.concat_ws(" ", *slots)


def maritime(df: DataFrame) -> Column:
    text = lambda n, default="unknown": F.coalesce(_given(df, n), F.lit(default))
    flag = lambda n: F.coalesce(_given(df, n, "boolean"), F.lit(False))
    num = lambda n: _given(df, n, "double")
    agent = F.concat(F.lit("[AGENT]: "), text("transport_mode", "vessel"), F.lit(", "), text("behavioral_phase", "transiting"), F.lit(", draught "), text("Draught"), F.lit(", speed over ground: "), text("SOG"), F.lit(" kn."))
    lane = F.when(flag("in_tss"), F.concat(F.lit("inside traffic separation scheme (name: "), text("tss_name"), F.lit(")"))).otherwise("no traffic separation scheme")
    corridor = F.concat(F.lit("[CORRIDOR]: "), text("sea_area_name", "open sea"), F.lit(", "), lane, F.lit("."))
    port = F.concat(F.lit("[INFRASTRUCTURE]: "), text("port_proximity_label", "offshore"), F.lit(", closest to port "), text("nearest_port_name"), F.coalesce(F.concat(F.lit(" ("), number(num("nearest_port_nm"), 1), F.lit(" nm)")), F.lit("")), F.lit("."))
    eez = text("eez_country_iso", "high_seas")
    waters = F.concat(F.when(eez == "high_seas", "high seas").otherwise(F.concat(eez, F.lit(" Exclusive Economic Zone"))), F.when(flag("in_territorial_sea"), " (territorial sea)").otherwise(""))
    park = F.when(flag("in_mpa"), F.concat(F.lit("marine protected area ("), text("mpa_name"), F.lit(")"))).otherwise("not within a marine protected area")
    heading = F.coalesce(bearing_label(num("Heading")), F.lit("unknown"))
    lee = num("heading_to_cog_diff_deg")
    leeway = F.when(F.abs(lee) > 10, F.concat(F.lit(", leeway "), _format("%+.0f", F.bround(lee, 0)), F.lit(" degrees"))).otherwise("")
    phase = F.concat(F.lit("[BEHAVIORAL_PHASE]: "), F.replace(text("behavioral_phase", "transiting"), F.lit("_"), F.lit(" ")), F.lit(", "), F.coalesce(F.concat(number(num("SOG"), 1), F.lit(" kn")), F.lit("unknown speed")), F.lit(", heading "), heading, F.coalesce(leeway, F.lit("")), F.lit(", navigational status: "), F.lower(F.trim(text("Navigational status"))), F.lit("."))
    wave = F.coalesce(F.concat(F.lit("waves "), number(num("wave_height_m"), 1), F.lit(" m")), F.lit("wave height unknown"))
    flow = F.when(num("current_speed_ms").isNotNull() & num("current_dir_deg").isNotNull(), F.concat(F.lit("current "), number(num("current_speed_ms"), 2), F.lit(" m/s "), bearing_label(num("current_dir_deg")))).otherwise("current data unavailable")
    when = F.concat(F.lit("[TEMPORAL]: "), F.coalesce(_day(_given(df, "day_of_week", "int")), F.lit("unknown")), F.lit(", "), F.coalesce(_format("%02d:00", _given(df, "hour_of_day", "int")), F.lit("unknown")), F.lit(", "), text("time_of_day_category", ""), F.lit(", "), text("season", ""), F.lit("."))
    depth = F.coalesce(F.concat(F.lit("water depth "), number(num("water_depth_m"), 0), F.lit(" m")), F.lit("water depth unknown"))
    place = F.concat(F.lit("[SPATIAL_CONTEXT]: "), _list(depth, F.concat(F.lit("geohash "), _given(df, "geohash_7"))), F.lit("."))
    return F.concat_ws(" ", agent, corridor, port, F.concat(F.lit("[REGULATORY_ZONE]: "), waters, F.lit(", "), park, F.lit(".")), phase, F.concat(F.lit("[ENVIRONMENT]: "), wave, F.lit(", "), flow, F.lit(".")), when, place)

"""Kinematics per trajectory, and rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.names import guarded
from .segment import ordered

# Behaviour by navigational status.
NAV_PHASES = {
    "moored": "at_berth", "at anchor": "anchored", "aground": "anchored", "engaged in fishing": "fishing", "not under command": "maneuvering",
    "restricted maneuverability": "maneuvering", "restricted manoeuvrability": "maneuvering", "restricted manoeuverability": "maneuvering",
    "constrained by her draught": "maneuvering", "power-driven vessel towing astern": "maneuvering",
    "power-driven vessel pushing ahead or towing alongside": "maneuvering", "ais-sart is active": "maneuvering", "ais-sart active": "maneuvering",
}


@guarded
def kinematics(df: DataFrame, keys: list[str], ts: str = "ts_unix", order: list[str] | None = None) -> DataFrame:
    """speed_ms, accel_ms2 and phase.  Speed looks ahead, and the last row repeats the one before; acceleration is that of
    the inner rows, which the ends copy; one row: 0 and stopped; two rows: acceleration 0."""
    w = ordered(keys, order or [ts, "event_id"])
    whole = Window.partitionBy(*keys)
    d = haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    dt = (F.lead(ts).over(w) - F.col(ts)).cast("double")
    df = df.withColumns({"_dt": F.when(dt <= 0, 1e-3).otherwise(dt), "_d": d, "_i": F.row_number().over(w), "_n": F.count("*").over(whole)})
    df = df.withColumn("_v", F.col("_d") / F.col("_dt"))
    df = df.withColumn("speed_ms", F.coalesce("_v", F.lag("_v").over(w), F.lit(0.0)))
    inner = (F.col("_i") > 1) & (F.col("_i") < F.col("_n"))
    df = df.withColumn("_a", F.when(inner, (F.col("speed_ms") - F.lag("speed_ms").over(w)) / F.lag("_dt").over(w)))
    accel = F.coalesce("_a", F.when(F.col("_i") == 1, F.lead("_a").over(w)).otherwise(F.lag("_a").over(w)), F.lit(0.0))
    return df.withColumn("accel_ms2", accel).withColumn("phase", phase(F.col("speed_ms"))).drop("_dt", "_d", "_i", "_n", "_v", "_a")


def phase(speed: Column) -> Column:
    return F.when(speed < 0.5, "stopped").when(speed < 1.5, "slow").otherwise("moving")


def behaviour(annotation: Column, sog: Column, nav: Column, stop_kn: float = 0.5, slow_kn: float = 3.0) -> Column:
    """A vessel's phase: gap labels first, then stop labels, then status, then speed."""
    labels = F.split(F.coalesce(annotation, F.lit("")), ";")
    status = F.lower(F.trim(F.coalesce(nav, F.lit(""))))
    out = F.when(sog.isNull(), "transiting").when(sog < stop_kn, "anchored").when(sog < slow_kn, "slow_transit").otherwise("transiting")
    for text, name in NAV_PHASES.items():
        out = F.when(status == text, name).otherwise(out)
    out = F.when(F.array_contains(labels, "STOP_START"), F.when(sog < stop_kn, "at_berth").otherwise("anchored")).otherwise(out)
    return F.when(F.arrays_overlap(labels, F.array(F.lit("GAP_START"), F.lit("GAP_END"))), "communication_gap").otherwise(out)


def time_features(ts: Column, zone: Column) -> dict[str, Column]:
    """Local hour, day (Monday 0) and month of epoch seconds, and their categories."""
    local = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(ts), zone))  # the session's zone plays no part
    days = F.floor(local / 86400)
    hour, day = F.floor((local - days * 86400) / 3600).cast("int"), F.pmod(days + 3, F.lit(7)).cast("int")
    month = F.month(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))
    tod = F.lit("night")
    for until, name in reversed([(5, "night"), (7, "early_morning"), (9, "am_rush"), (12, "morning"), (14, "midday"), (17, "afternoon"), (19, "pm_rush"), (22, "evening")]):
        tod = F.when(hour < until, name).otherwise(tod)
    season = F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")
    return {"hour_of_day": hour, "day_of_week": day, "month": month, "is_weekend": day >= 5, "time_of_day": tod, "season": season}

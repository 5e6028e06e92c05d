"""Civil time and sunlight as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zenith of sunrise, and the elevations between which night falls.
SUNRISE_ZENITH_DEG, DAY_ELEVATION, NIGHT_ELEVATION = 90.833, 0.5, -6.0


def _poly(terms: list[tuple[float, Column | float]]) -> Column:
    out = F.lit(0.0)
    for factor, c in terms:
        out = out + factor * c
    return out


def _positive_mod(v: Column, by: float) -> Column:
    return v - by * F.floor(v / by)


def sun(ts: Column, lat: Column, lon: Column, utc_offset_h: Column) -> dict[str, Column]:
    """Position of the sun at a local time, by the fractional-year approximation: columns by name, angles in degrees."""
    day = F.dayofyear(ts)
    leap = F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31)))
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    g = 2 * F.pi() / leap * ((day - 1) + (hour - 12.0) / 24.0)
    equation = 229.18 * _poly([(0.000075, 1.0), (0.001868, F.cos(g)), (-0.032077, F.sin(g)), (-0.014615, F.cos(2 * g)), (-0.040849, F.sin(2 * g))])
    decl = _poly([
        (0.006918, 1.0), (-0.399912, F.cos(g)), (0.070257, F.sin(g)), (-0.006758, F.cos(2 * g)), (0.000907, F.sin(2 * g)), (-0.002697, F.cos(3 * g)), (0.00148, F.sin(3 * g)),
    ])
    solar = _positive_mod(hour * 60 + equation + 4 * lon - 60 * utc_offset_h, 1440.0)
    angle = F.radians(solar / 4 - 180)
    phi = F.radians(lat)
    zenith = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(angle)))))
    azimuth = F.degrees(F.atan2(F.sin(angle), F.cos(angle) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180
    edge = F.cos(phi) * F.cos(decl)
    limit = F.cos(F.radians(F.lit(SUNRISE_ZENITH_DEG))) / edge - F.tan(phi) * F.tan(decl)
    polar = F.when(F.abs(edge) < 1e-7, F.degrees(F.asin(F.sin(phi) * F.sin(decl))) > -0.833).when(limit < -1, True).when(limit > 1, False)
    half = F.when(polar.isNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), limit)))))
    noon = 720 - 4 * lon - equation + 60 * utc_offset_h
    return {
        "elevation_deg": 90 - zenith,
        "azimuth_deg": _positive_mod(azimuth, 360.0),
        "daylight_minutes": F.when(polar, 1440.0).when(~polar, 0.0).otherwise(8 * half),
        "sunrise_minutes": F.coalesce(_positive_mod(noon - 4 * half, 1440.0), F.lit(-1.0)),
        "sunset_minutes": F.coalesce(_positive_mod(noon + 4 * half, 1440.0), F.lit(-1.0)),
        "polar_day": F.coalesce(polar, F.lit(False)),
        "polar_night": F.coalesce(~polar, F.lit(False)),
    }


def weekday(ts: Column) -> Column:
    """1 on Monday to 7 on Sunday."""
    return F.weekday(ts) + 1


def daypart(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when((h >= 5) & (h < 10), "morning").when((h >= 10) & (h < 18), "day").when((h >= 18) & (h < 23), "evening").otherwise("night")


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def clock_at(start_s: Column, elapsed_s: Column, speed: Column, paused: Column) -> Column:
    """Seconds on a clock that runs ``speed`` times as fast, or stands while paused."""
    return start_s + F.when(paused, 0.0).otherwise(F.greatest(F.lit(0.0), elapsed_s) * speed)


def schedule_active(ts: Column, days: tuple[int, ...], start_minute: int, end_minute: int) -> Column:
    """Whether a weekly window is on; one that ends before it starts runs over midnight into the next day."""
    day, second = weekday(ts), F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    start, end = start_minute * 60, end_minute * 60
    if start < end:
        return day.isin(*days) & (second >= start) & (second < end)
    before = F.when(day == 1, 7).otherwise(day - 1)
    return (day.isin(*days) & (second >= start)) | (before.isin(*days) & (second < end))


def night_intensity(elevation_deg: Column) -> Column:
    """0 by day to 1 by night, even in between."""
    ramp = (DAY_ELEVATION - elevation_deg) / (DAY_ELEVATION - NIGHT_ELEVATION)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ramp))


def density_weight(count: Column) -> Column:
    return F.when(count > 0, F.log2(1.0 + count)).otherwise(0.0)

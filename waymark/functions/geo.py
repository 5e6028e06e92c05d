"""Plane and sphere geometry as Column expressions: everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Projection radius and latitude limit, mean earth radius for distances, default tile side, direction limit.
PROJECTION_RADIUS, MAX_LATITUDE, EARTH_RADIUS, TILE_M, SAME_DIRECTION = 6_378_137.0, 85.05112878, 6_371_008.8, 32_000.0, 0.985


def project_x(lon: Column) -> Column:
    return PROJECTION_RADIUS * F.radians(lon)


def project_y(lat: Column) -> Column:
    held = F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat))
    return F.when(lat.isNotNull(), PROJECTION_RADIUS * F.log(F.tan(F.pi() / 4 + F.radians(held) / 2)))


def unproject_lon(x: Column) -> Column:
    return F.degrees(x / PROJECTION_RADIUS)


def unproject_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / PROJECTION_RADIUS)) - F.pi() / 2)


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a, b = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((b - a) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = s * s + F.cos(a) * F.cos(b) * t * t
    return EARTH_RADIUS * 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cell(v: Column, size: float | Column) -> Column:
    """Index of the cell that holds ``v``; negative coordinates round down too."""
    return F.floor(v / size).cast("long")


def fraction_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on a-b the point nearest to p lies, 0 to 1; 0 on a segment of one point."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    at = ((px - ax) * dx + (py - ay) * dy) / length
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), at))).otherwise(0.0)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, fraction: Column) -> Column:
    return F.hypot(px - (ax + (bx - ax) * fraction), py - (ay + (by - ay) * fraction))


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a, b, c: positive if they turn left."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple, eps: float = 1e-7) -> Column:
    """Whether a-b and c-d cross inside both; touching or parallel segments don't."""

    def sides(o1: Column, o2: Column) -> Column:
        return ((o1 > eps) & (o2 < -eps)) | ((o1 < -eps) & (o2 > eps))

    return sides(turn(*a, *b, *c), turn(*a, *b, *d)) & sides(turn(*c, *d, *a), turn(*c, *d, *b))


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of the angle between two vectors; 0 if either has no length."""
    n = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(n > 0, (ax * bx + ay * by) / n).otherwise(0.0)


def ring_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) structs, whichever way round; 0 below three points."""
    shifted = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, shifted, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2).otherwise(0.0)


def polygon_area(outer: Column, holes: Column) -> Column:
    """Area of the outer ring less its holes, not below 0."""
    inside = F.aggregate(F.transform(holes, ring_area), F.lit(0.0), lambda s, t: s + t)
    return F.greatest(F.lit(0.0), ring_area(outer) - inside)


def ring_centroid(points: Column, axis: str) -> Column:
    """Area centroid of a ring; the mean of its points where it has no area."""
    shifted = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    pairs = F.arrays_zip(points.alias("p"), shifted.alias("q"))
    cross = lambda z: z["p"]["x"] * z["q"]["y"] - z["q"]["x"] * z["p"]["y"]
    twice = F.aggregate(F.transform(pairs, cross), F.lit(0.0), lambda s, t: s + t)
    moment = F.aggregate(F.transform(pairs, lambda z: (z["p"][axis] + z["q"][axis]) * cross(z)), F.lit(0.0), lambda s, t: s + t)
    return F.when(F.abs(twice) > 1e-12, moment / (3 * twice)).otherwise(points_mean(points, axis))


def points_mean(points: Column, axis: str) -> Column:
    """Mean of the points of an array, which is not the centroid of the area."""
    return F.aggregate(F.transform(points, lambda p: p[axis]), F.lit(0.0), lambda s, t: s + t) / F.size(points)


def thinned(points: Column, spacing: float) -> Column:
    """Points at least ``spacing`` from the last point kept; both ends stay. A fold, as each step needs the one before."""
    n = F.size(points)

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        far = (p["x"] - last["x"]) * (p["x"] - last["x"]) + (p["y"] - last["y"]) * (p["y"] - last["y"]) >= spacing * spacing
        return F.when(far, F.concat(kept, F.array(p))).otherwise(kept)

    middle = F.slice(points, 2, F.greatest(n - 2, F.lit(0)))
    kept = F.aggregate(middle, F.slice(points, 1, 1), step)
    return F.when((n <= 2) | F.lit(spacing <= 0), points).otherwise(F.concat(kept, F.slice(points, -1, 1)))


def heading(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Direction from a to b in radians, from the x axis towards the y axis."""
    return F.atan2(by - ay, bx - ax)


def can_observe(ox: Column, oy: Column, facing: Column, tx: Column, ty: Column, clear: Column, reach: float = 120.0, view_deg: float = 140.0) -> Column:
    """Whether an observer sees a target: in range, in the field of view, and the line of sight is clear."""
    d = F.hypot(tx - ox, ty - oy)
    ahead = (F.cos(facing) * (tx - ox) + F.sin(facing) * (ty - oy)) / d
    inside = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ahead))) <= F.radians(F.lit(view_deg / 2))
    return clear & (d <= reach) & F.when(d > 0, inside).otherwise(True)

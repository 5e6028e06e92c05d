"""Joins and sums over a grid: equality on cells stands for nearness, and exact distance decides."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import geo, sky, text
from waymark.session import Scratch

#: Fixed value: so many cells with something in them are told to all tasks.
FEW_CELLS = 500_000
#: Fixed value: a face of so many edges is told whole to each of its cells.
FEW_EDGES = 64


def cells_around(x: Column, y: Column, size: float, radius: int) -> Column:
    """Array of the (cx, cy) cells at most ``radius`` cells from a point."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct((geo.cell(x, size) + i).alias("cx"), (geo.cell(y, size) + j).alias("cy")))))


def cells_of_box(x1: Column, y1: Column, x2: Column, y2: Column, size: float | Column) -> Column:
    """Array of the (cx, cy) cells that the box of two points touches."""
    span = lambda a, b: F.sequence(geo.cell(F.least(a, b), size), geo.cell(F.greatest(a, b), size))
    return F.flatten(F.transform(span(x1, x2), lambda i: F.transform(span(y1, y2), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def segment_cells(segments: DataFrame, size: float) -> DataFrame:
    """Segments (ax, ay, bx, by) in every cell (cx, cy) that their box touches."""
    return segments.select("*", F.explode(cells_of_box(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), size)).alias("c")).select("*", "c.*").drop("c")


def _halvings(rows: DataFrame, most: float, grown: float) -> int:
    """How often cells have to be halved until the rows (cx, cy) that are in cells come to ``most`` a cell: each halving leaves 1 / ``grown``."""
    n, cells = rows.groupBy("cx", "cy").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    crowd = (n or 0) / max(cells, 1) / most
    return max(0, math.ceil(math.log(crowd, grown))) if crowd > 1 else 0


def _rings(halvings: int) -> list[int]:
    """By what a reach is divided in turn: the most first, at last 1."""
    return [1 << n for n in range(halvings, 0, -2)] + [1]


def nearest_segment(points: DataFrame, segments: DataFrame, max_m: float = 250.0, size: float = 256.0) -> DataFrame:
    """(id, edge, distance_m, fraction, px, py): the segment nearest to each point within ``max_m``; ties go to the smaller edge.

    Segments (edge, ax, ay, bx, by) stand in every cell that their box touches, points (id, x, y) look into the cells
    around theirs. Where cells are crowded, finer ones come first: there a segment stands in every cell that it comes near
    enough to, and a point that has a segment within that reach is done, as none that is nearer is missed.
    """
    one = _one_a_place(segments)
    halvings = _halvings(segment_cells(one, size), 64.0, 2.0)
    span = lambda a, b, k: F.abs(F.col(a) - F.col(b)) * (1 << k) / size + 4
    if halvings:  # segments that are long beside fine cells would stand in too many
        many = one.agg(*[F.avg(span("ax", "bx", k) * span("ay", "by", k)) for k in range(1, halvings + 1)]).first()
        halvings = max((k for k in range(1, halvings + 1) if many[k - 1] <= 100), default=0)
    if not halvings:
        return nearest_in_cells(points, segment_cells(one, size), max_m, size)
    scratch = Scratch(points.sparkSession)
    one, left, found = scratch.save(one, "segments"), scratch.save(points.select("id", "x", "y"), "points"), []
    for shrink in _rings(halvings):
        within, side = max_m / shrink, size / shrink
        if shrink == 1:
            found.append(nearest_in_cells(left, segment_cells(one, size), max_m, size))
            break
        p = left.withColumns({"cx": geo.cell(F.col("x"), side), "cy": geo.cell(F.col("y"), side)})
        found.append(scratch.save(_nearest(p, _cells_near(one, side, within), within), f"found{shrink}"))
        left = scratch.save(left.join(found[-1].select("id"), "id", "left_anti"), f"left{shrink}")
    return reduce(DataFrame.unionByName, found)


def _one_a_place(segments: DataFrame, *cell: str) -> DataFrame:
    """Of segments with the same ends that of the smallest number: the others are never the nearest."""
    return segments.groupBy(*cell, "ax", "ay", "bx", "by").agg(F.min("edge").alias("edge"))


def _cells_near(segments: DataFrame, side: float, within: float) -> DataFrame:
    """Segments in every cell (cx, cy) with a point that may be ``within`` of them."""
    ends = [F.least("ax", "bx") - within, F.least("ay", "by") - within, F.greatest("ax", "bx") + within, F.greatest("ay", "by") + within]
    rows = segments.select("*", F.explode(cells_of_box(*ends, side)).alias("c")).select("*", "c.*").drop("c")
    x, y, line = (F.col("cx") + 0.5) * side, (F.col("cy") + 0.5) * side, [F.col(c) for c in ("ax", "ay", "bx", "by")]
    return rows.where(geo.segment_distance(x, y, *line, geo.fraction_on_segment(x, y, *line)) <= (within + side * math.sqrt(0.5)) * 1.000001)


def nearest_in_cells(points: DataFrame, cells: DataFrame, max_m: float, size: float) -> DataFrame:
    """``nearest_segment`` over segments that are in their cells already."""
    p = points.select("id", "x", "y", F.explode(cells_around(F.col("x"), F.col("y"), size, math.ceil(max_m / size))).alias("c")).select("id", "x", "y", "c.*")
    taken = cells.select("cx", "cy").distinct()
    if taken.limit(FEW_CELLS + 1).count() <= FEW_CELLS:  # points far from all segments are not shuffled
        p = p.join(F.broadcast(taken), ["cx", "cy"], "left_semi")
    return _nearest(p, _one_a_place(cells, "cx", "cy"), max_m)


def _nearest(placed: DataFrame, cells: DataFrame, max_m: float) -> DataFrame:
    """The nearest segment of the points that are ``placed`` in cells.

    The least distance of each point comes first, which is summed up where pairs are made; then the segment that has it,
    so pairs are neither sorted nor shuffled.
    """
    line = [F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")]
    pairs = lambda p: p.join(cells, ["cx", "cy"]).withColumn("fraction", geo.fraction_on_segment(*line)).withColumn("distance_m", geo.segment_distance(*line, F.col("fraction")))
    least = pairs(placed).where(F.col("distance_m") <= max_m).groupBy("id").agg(F.min("distance_m").alias("_least"))
    at = F.struct("fraction", (F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("fraction")).alias("px"), (F.col("ay") + (F.col("by") - F.col("ay")) * F.col("fraction")).alias("py"))
    best = pairs(placed.join(least, "id")).where("distance_m = _least").groupBy("id").agg(F.min(F.struct("distance_m", "edge", at.alias("at"))).alias("b"))
    return best.select("id", "b.edge", "b.distance_m", "b.at.*")


def speed_limit_at(points: DataFrame, segments: DataFrame, max_m: float = 22.0, size: float = 128.0) -> DataFrame:
    """(id, edge, kmh): the limit of the nearest segment in the point's own cell only; of equals the last, and none if it is a guess."""
    s = segments.select("*", F.explode(cells_of_box(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), size)).alias("c")).select("*", "c.*").drop("c")
    p = points.select("id", "x", "y", geo.cell(F.col("x"), size).alias("cx"), geo.cell(F.col("y"), size).alias("cy"))
    j = p.join(s, ["cx", "cy"])
    f = geo.fraction_on_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    j = j.withColumn("_d", geo.segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), f)).where(F.col("_d") <= max_m)
    best = j.groupBy("id").agg(F.max(F.struct((-F.col("_d")).alias("_d"), "edge", "kmh", "explicit")).alias("b"))
    return best.select("id", "b.edge", F.when(F.col("b.explicit"), F.col("b.kmh")).alias("kmh"))


def on_road(points: DataFrame, segments: DataFrame, size: float = 128.0) -> DataFrame:
    """The points that lie on a segment: no further from it than its ``half_width``."""
    widest = segments.select(F.max("half_width")).first()[0] or 0.0
    s = segments.select("*", F.explode(cells_of_box(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), size)).alias("c")).select("*", "c.*").drop("c")
    p = points.select("*", F.explode(cells_around(F.col("x"), F.col("y"), size, math.ceil(widest / size))).alias("c")).select("*", "c.*").drop("c")
    f = geo.fraction_on_segment(p.x, p.y, s.ax, s.ay, s.bx, s.by)
    near = (p.cx == s.cx) & (p.cy == s.cy) & (geo.segment_distance(p.x, p.y, s.ax, s.ay, s.bx, s.by, f) <= s.half_width)
    return points.join(p.join(s, near, "left_semi").select("id").distinct(), "id", "left_semi")


def neighbour_vote(points: DataFrame, samples: DataFrame, reach_m: float = 500.0, size: float = 250.0, nearest: int = 5, support: int = 2) -> DataFrame:
    """(id, value): what the nearest samples of the same group say, if there are ``support`` of them and all say the same.

    points: id, x, y, grp; samples: sx, sy, grp, value. Where cells are crowded, a shorter reach comes first: a point that
    has ``nearest`` samples within it needs no others.
    """
    placed = lambda side: samples.select("sx", "sy", "grp", "value", geo.cell(F.col("sx"), side).alias("cx"), geo.cell(F.col("sy"), side).alias("cy"))
    d2 = (F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")) + (F.col("sy") - F.col("y")) * (F.col("sy") - F.col("y"))
    rings = _rings(_halvings(placed(size).withColumn("cx", F.struct("grp", "cx")), 2.0 * nearest, 4.0))
    scratch = Scratch(points.sparkSession) if len(rings) > 1 else None
    left, out = points.select("id", "x", "y", "grp"), []
    for shrink in rings:
        within, side = reach_m / shrink, size / shrink
        p = left.select("id", "x", "y", "grp", F.explode(cells_around(F.col("x"), F.col("y"), side, math.ceil(within / side))).alias("c")).select("id", "x", "y", "grp", "c.*")
        j = p.join(placed(side), ["cx", "cy", "grp"]).withColumn("_d", d2).where(F.col("_d") <= within * within)
        j = j.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_d", "value"))).where(F.col("_n") <= nearest)
        votes = j.groupBy("id").agg(F.count("*").alias("n"), F.min("value").alias("value"), F.max("value").alias("_other"))
        if shrink > 1:
            votes = scratch.save(votes.where(F.col("n") >= nearest), f"votes{shrink}")
            left = scratch.save(left.join(votes, "id", "left_anti"), f"left{shrink}")
        out.append(votes)
    votes = reduce(DataFrame.unionByName, out)
    return votes.where((F.col("n") >= support) & (F.col("value") == F.col("_other"))).select("id", "value")


def unique_by_key(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key that has one only."""
    one = rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_other")).where(F.col(value) == F.col("_other"))
    return one.drop("_other")


def density(points: DataFrame, size: float = 2000.0) -> DataFrame:
    """(cx, cy, x, y, count): points per cell, with the cell's centre."""
    c = points.groupBy(geo.cell(F.col("x"), size).alias("cx"), geo.cell(F.col("y"), size).alias("cy")).agg(F.count("*").alias("count"))
    return c.withColumn("x", (F.col("cx") + 0.5) * size).withColumn("y", (F.col("cy") + 0.5) * size)


def stencil(cells: DataFrame, side_weight: float = 0.35) -> DataFrame:
    """(cx, cy, near): each cell's count plus ``side_weight`` of those of its eight neighbours."""
    shifts = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
    given = cells.select("cx", "cy", "count", shifts.alias("s"))
    share = F.when((F.col("s.i") == 0) & (F.col("s.j") == 0), F.col("count").cast("double")).otherwise(F.col("count") * side_weight)
    spread = given.select((F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), share.alias("v"))
    return spread.groupBy("cx", "cy").agg(F.sum("v").alias("near")).join(cells.select("cx", "cy"), ["cx", "cy"], "left_semi")


def light_points(points: DataFrame, light_m: float = 450.0, density_m: float = 2000.0, most: int = 60_000) -> DataFrame:
    """(key, layer, hash): glow points of the distinct light cells, a layer of all cells after the other, in hash order.

    A cell has one to four layers by the density near its centre: its own density cell's points plus 0.35 of those of the
    eight around it, added in their order. ``most`` is the cap of the reference.
    """
    cells = points.select(geo.cell(F.col("x"), light_m).alias("lx"), geo.cell(F.col("y"), light_m).alias("ly")).distinct()
    centre = lambda c: geo.cell((F.col(c) + 0.5) * light_m, density_m)
    shifts = F.posexplode(F.expr("flatten(transform(sequence(-1, 1), j -> transform(sequence(-1, 1), i -> struct(i AS i, j AS j))))")).alias("k", "s")
    around = cells.select("lx", "ly", centre("lx").alias("dx"), centre("ly").alias("dy"), shifts)
    around = around.select("lx", "ly", "k", (F.col("dx") + F.col("s.i")).alias("cx"), (F.col("dy") + F.col("s.j")).alias("cy"))
    share = F.coalesce(F.col("count"), F.lit(0)) * F.when(F.col("k") == 4, 1.0).otherwise(0.35)
    near = around.join(density(points, density_m).select("cx", "cy", "count"), ["cx", "cy"], "left").groupBy("lx", "ly").agg(F.sort_array(F.collect_list(F.struct("k", share.alias("v")))).alias("a"))
    weighted = F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x["v"]))
    layers = F.greatest(F.lit(1), F.least(F.lit(4), 1 + F.floor(sky.density_weight(weighted) / 2.5)))
    key = F.concat(F.col("lx").cast("string"), F.lit(":"), F.col("ly").cast("string"))
    out = near.select(key.alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), layers - 1)).alias("layer"))
    return out.withColumn("hash", text.stable_hash(F.col("key"))).orderBy("layer", "hash", "key").limit(most)


def boxes_overlap(a: tuple, b: tuple) -> Column:
    """Whether two boxes (x1, y1, x2, y2) touch."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_level(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """How often cells have to double until a box touches nine of them at most."""
    extent = F.greatest(F.abs(x2 - x1), F.abs(y2 - y1))
    return F.when(extent > 2 * size, F.least(F.lit(60), F.ceil(F.log2(extent / (2 * size))))).otherwise(0).cast("int")


def _levels(boxes: DataFrame, level: str) -> list[int]:
    """The distinct levels of a table's boxes: 61 numbers at most, as an extent has no more doublings."""
    return sorted(r[0] for r in boxes.select(level).distinct().collect())


def overlapping_boxes(rows: DataFrame, windows: DataFrame, size: float) -> DataFrame:
    """Each row with each window that its box touches: columns of both. rows: x1, y1, x2, y2; windows: wx1, wy1, wx2, wy2.

    A box stands in cells that are doubled until it touches few, so a very large one is no more work than a small one; it
    also stands in the larger cells where the other table has boxes, and a pair meets at the level of its larger box. A
    pair that meets in several cells is kept in the one with the lower left corner of what they share. Boxes without a
    place touch nothing.
    """
    ends = {"r": ("x1", "y1", "x2", "y2"), "w": ("wx1", "wy1", "wx2", "wy2")}
    own = {k: df.dropna(subset=list(ends[k])).withColumn(f"_{k}", box_level(*[F.col(c) for c in ends[k]], size)) for k, df in (("r", rows), ("w", windows))}
    held = {k: _levels(df, f"_{k}") for k, df in own.items()}

    def standing(k: str, other: str) -> DataFrame:
        larger = F.filter(F.array(*[F.lit(n) for n in held[other]]).cast("array<int>"), lambda n: n > F.col(f"_{k}"))
        at = own[k].withColumn("_l", F.explode(F.concat(F.array(f"_{k}"), larger)))
        return at.withColumn("_c", F.explode(cells_of_box(*[F.col(c) for c in ends[k]], size * F.pow(F.lit(2.0), F.col("_l")))))

    side = size * F.pow(F.lit(2.0), F.col("_l"))
    corner = (F.col("_c.cx") == geo.cell(F.greatest(F.least("x1", "x2"), F.least("wx1", "wx2")), side)) & (F.col("_c.cy") == geo.cell(F.greatest(F.least("y1", "y2"), F.least("wy1", "wy2")), side))
    touch = boxes_overlap(*[tuple(F.col(c) for c in ends[k]) for k in "rw"])
    return standing("r", "w").join(standing("w", "r"), ["_l", "_c"]).where((F.greatest("_r", "_w") == F.col("_l")) & touch & corner).drop("_l", "_c", "_r", "_w")


def within_reach(left: DataFrame, right: DataFrame, reach: float, on: list[str], how: str = "inner") -> DataFrame:
    """Rows of ``left`` (x, y) with rows of ``right`` (rx, ry) nearer than ``reach`` that share ``on``, by cells as wide as the reach.

    Where ``how`` is left_anti, the rows of ``left`` that have none; ``right`` may hold ``but``, the ``id`` that a row is not held against.
    """
    l = left.withColumn("_cx", geo.cell(F.col("x"), reach)).withColumn("_cy", geo.cell(F.col("y"), reach))
    r = right.withColumn("_c", F.explode(cells_around(F.col("rx"), F.col("ry"), reach, 1)))
    r = r.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns], F.col("_c.cx").alias("_rx"), F.col("_c.cy").alias("_ry"))
    near = (l["_cx"] == r["_rx"]) & (l["_cy"] == r["_ry"]) & (F.hypot(l["x"] - r["rx"], l["y"] - r["ry"]) < reach)
    for c in on:
        near = near & (l[c] == r[f"_{c}"])
    if "but" in right.columns:
        near = near & (l["id"] != r["but"])
    return l.join(r, near, how).drop("_cx", "_cy", "_rx", "_ry", *[f"_{c}" for c in on])


def in_faces(points: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """(id, face): the faces that hold each point, by the number of edges that a ray to the right crosses.

    points: id, x, y; rings: face, ring (array of structs x, y; outer and inner rings alike, so a hole is outside). A
    point meets the faces whose box touches its cell, which is larger for larger faces, and of their edges those in its own
    row of the given size: the ray crosses no other.
    """
    shifted = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    edges = rings.select("face", F.explode(F.arrays_zip(F.col("ring").alias("p"), shifted.alias("q"))).alias("e")).select("face", F.col("e.p.x").alias("ax"), F.col("e.p.y").alias("ay"), F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by"))
    return in_edges(points, edges, size)


def in_edges(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """``in_faces`` from the edges (face, ax, ay, bx, by) of faces, in any order and sense.

    Small faces of few edges stand in their cells with the edges of the row, so their pairs are told where they meet; the
    pairs of others meet their edges by row.
    """
    box = edges.groupBy("face").agg(F.min("ax").alias("x1"), F.min("ay").alias("y1"), F.max("ax").alias("x2"), F.max("ay").alias("y2"), F.count("*").alias("_n"))
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    box = box.withColumn("_l", box_level(*corners, size)).withColumn("_few", (F.col("_l") == 0) & (F.col("_n") <= FEW_EDGES))
    inside = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    rows = F.sequence(geo.cell(F.least("ay", "by"), size), geo.cell(F.greatest("ay", "by"), size))
    by_row = edges.where("ay <> by").withColumn("_row", F.explode(rows))
    crosses = lambda ax, ay, bx, by: ((ay > F.col("y")) != (by > F.col("y"))) & (F.col("x") < ax + (F.col("y") - ay) / (by - ay) * (bx - ax))
    at = lambda side: F.struct(geo.cell(F.col("x"), side).alias("cx"), geo.cell(F.col("y"), side).alias("cy"))

    few = box.where("_few")
    listed = by_row.join(few.select("face"), "face", "left_semi").groupBy("face", "_row").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_e"))
    standing = few.withColumn("_c", F.explode(cells_of_box(*corners, size))).withColumn("_row", F.col("_c.cy")).join(listed, ["face", "_row"]).select("_c", "face", *corners, "_e")
    met = points.select("id", "x", "y", at(size).alias("_c")).join(standing, "_c").where(inside)
    told = met.where(F.size(F.filter("_e", lambda e: crosses(e["ax"], e["ay"], e["bx"], e["by"]))) % 2 == 1).select("id", "face")

    other = box.where("NOT _few")
    levels = _levels(other, "_l")
    if not levels:
        return told
    side = size * F.pow(F.lit(2.0), F.col("_l"))
    held = other.withColumn("_c", F.explode(cells_of_box(*corners, side)))
    near = points.withColumn("_l", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("_c", at(side)).withColumn("_row", geo.cell(F.col("y"), size)).join(held, ["_l", "_c"]).where(inside)
    j = near.select("id", "x", "y", "face", "_row").join(by_row, ["face", "_row"])
    n = F.count_if(crosses(*[F.col(c) for c in ("ax", "ay", "bx", "by")])).alias("n")
    return told.unionByName(j.groupBy("id", "face").agg(n).where("n % 2 = 1").select("id", "face"))


def nearest_on_polyline(points: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, segment, fraction, px, py, distance_m): the place on a point's own line that is nearest; of equals the smaller x, then y.

    points: id, line, x, y; lines: line, pos, ax, ay, bx, by. A point meets the segments of one line only.
    """
    j = points.join(lines, "line")
    f = geo.fraction_on_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    j = j.withColumn("fraction", f).withColumn("px", F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("fraction")).withColumn("py", F.col("ay") + (F.col("by") - F.col("ay")) * F.col("fraction"))
    j = j.withColumn("distance_m", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    best = j.groupBy("id").agg(F.min(F.struct(F.round("distance_m", 9).alias("d"), "px", "py", F.col("pos").alias("segment"), "fraction", "distance_m")).alias("b"))
    return best.select("id", "b.segment", "b.fraction", "b.px", "b.py", "b.distance_m")

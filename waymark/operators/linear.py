"""Linear referencing: places, stretches and speeds by their distance along a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .routing import densified


def measured(points: DataFrame, line: list[str], order: list[str]) -> DataFrame:
    """Add ``at_m``: how far along its line each point (x, y) lies."""
    w = Window.partitionBy(*line).orderBy(*order)
    hop = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return points.withColumn("_hop", F.coalesce(hop, F.lit(0.0))).withColumn("at_m", F.sum("_hop").over(w)).drop("_hop")


def last_mark(asked: DataFrame, marks: DataFrame, line: list[str], slack: float = 0.0) -> DataFrame:
    """``asked`` with ``mark``: the columns of the last mark at or before ``at_m`` (and ``slack``) on its line; null if there is none.

    An as-of join by distance: marks and questions are merged into one order a line and walked once, so no question meets
    all marks. Of marks in one place the one with the greatest columns counts, in their order.
    """
    mark = F.struct(*[F.col(c) for c in marks.columns if c not in line])
    m = marks.select(*line, F.col("at_m").alias("_at"), F.lit(0).alias("_kind"), mark.alias("mark"))
    a = asked.select(*line, (F.col("at_m") + slack).alias("_at"), F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in asked.columns if c not in line]).alias("_asked"))
    walk = Window.partitionBy(*line).orderBy("_at", "_kind", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = m.unionByName(a, allowMissingColumns=True).withColumn("mark", F.last("mark", ignorenulls=True).over(walk))
    return both.where("_kind = 1").select(*line, "_asked.*", "mark")


def look_ahead(asked: DataFrame, points: DataFrame) -> DataFrame:
    """(id, line, x, y): the place ``ahead_m`` further along the line than ``at_m``; beyond the line's end, the end.

    asked: id, line, at_m, ahead_m; points: line, pos, x, y. Distances below 0 count as 0. Lines without points have no row.
    """
    w = Window.partitionBy("line").orderBy("pos")
    p = measured(points.select("line", "pos", "x", "y"), ["line"], ["pos"])
    p = p.withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w))
    to = F.greatest(F.col("at_m"), F.lit(0.0)) + F.greatest(F.col("ahead_m"), F.lit(0.0))
    j = last_mark(asked.select("id", "line", to.alias("at_m")), p.select("line", "pos", "at_m", "x", "y", "bx", "by"), ["line"]).where("mark IS NOT NULL")
    whole = F.hypot(F.col("mark.bx") - F.col("mark.x"), F.col("mark.by") - F.col("mark.y"))
    share = F.when(whole > 0, (F.col("at_m") - F.col("mark.at_m")) / whole).otherwise(0.0)
    on = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * share)
    return j.select("id", "line", on("mark.x", "mark.bx").alias("x"), on("mark.y", "mark.by").alias("y"))


def speed_profile(steps: DataFrame, shapes: DataFrame, unknown_mps: float = 13.9) -> DataFrame:
    """(request, target, point, speed_mps): at each drawn point of a route the speed of the edge that goes on from it; at the end, the last edge's.

    steps: request, target, step, source, next, metres, seconds; shapes: source, next, pos, x, y. Edges without a time have
    ``unknown_mps``, as have points of a route before its first edge.
    """
    route = ["request", "target"]
    drawn = measured(steps.join(shapes, ["source", "next"]).select(*route, "step", "pos", "x", "y", "metres", "seconds"), route, ["step", "pos"])
    speed = F.when(F.col("seconds") > 0, F.col("metres") / F.col("seconds")).otherwise(unknown_mps)
    stretches = drawn.groupBy(*route, "step").agg(F.min("at_m").alias("at_m"), F.first(speed).alias("speed_mps"))
    points = measured(densified(steps, shapes), route, ["point"]).select(*route, "point", "at_m")
    out = last_mark(points, stretches.select(*route, "step", "at_m", "speed_mps"), route, slack=1e-4)
    return out.select(*route, "point", F.coalesce("mark.speed_mps", F.lit(unknown_mps)).alias("speed_mps"))


def clipped(segments: DataFrame, size: float, least_m: float = 1e-8) -> DataFrame:
    """Segments (ax, ay, bx, by and others) cut by the tiles that they cross: their columns, tx, ty and the piece's place and ``length_m``.

    Each segment goes once to each tile that its box touches and is cut there by the tile's four sides. A piece on a side
    belongs to the tile above or to the right of it, so the pieces of a segment add up to it. Pieces of ``least_m`` or less, where a corner is only touched, are left out.
    """
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    s = segments.withColumn("tx", F.explode(span("ax", "bx"))).withColumn("ty", F.explode(span("ay", "by")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")

    def enters(a: Column, d: Column, tile: Column) -> tuple[Column, Column]:
        """From which to which share of the segment it is between a tile's two sides."""
        low, high = (tile * size - a) / d, ((tile + 1) * size - a) / d
        return F.when(d == 0, 0.0).otherwise(F.least(low, high)), F.when(d == 0, 1.0).otherwise(F.greatest(low, high))

    (x0, x1), (y0, y1) = enters(F.col("ax"), dx, F.col("tx")), enters(F.col("ay"), dy, F.col("ty"))
    s = s.withColumn("from", F.greatest(x0, y0, F.lit(0.0))).withColumn("to", F.least(x1, y1, F.lit(1.0)))
    return s.withColumn("length_m", F.hypot(dx, dy) * (F.col("to") - F.col("from"))).where(F.col("length_m") > least_m)

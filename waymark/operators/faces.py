"""Faces of a plane cut by lines, from half-edges, and the faces on the land side of directed coastlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.session import Scratch

from .spatial import in_edges

#: How far left of a coastline its seeds lie, and how long a side must be to give one, in metres.
SEED_M, LEAST_SIDE_M = 25.0, 0.01
#: How far outside an island it is asked which face surrounds it, in metres.
_BESIDE_M = 1e-6


def darts_by_face(segments: DataFrame) -> DataFrame:
    """(face, dart, ax, ay, bx, by): both directions of each segment, with the face on their left, named by its smallest dart.

    segments: seg, ax, ay, bx, by; they meet at ends only, and none is there twice. At the end of a dart the next one of
    its face is the first clockwise from the way back. Pointers along faces are doubled, so the longest boundary of n
    darts takes about log2(n) rounds.
    """
    scratch = Scratch(segments.sparkSession)
    ends = lambda dart, a, b: F.struct(dart.alias("dart"), *[F.col(f"{p}{c}").alias(f"{q}{c}") for p, q in ((a, "a"), (b, "b")) for c in "xy"])
    there, back = ends(F.col("seg") * 2, "a", "b"), ends(F.col("seg") * 2 + 1, "b", "a")
    darts = segments.where("ax <> bx OR ay <> by").select(F.explode(F.array(there, back)).alias("d")).select("d.*")
    darts = scratch.save(darts, "darts")
    node = Window.partitionBy("ax", "ay")
    clockwise = F.coalesce(F.lag("dart").over(node.orderBy("angle")), F.max_by("dart", "angle").over(node))
    out = darts.withColumn("angle", F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))).withColumn("to", clockwise)
    state = out.select((F.col("dart") + 1 - 2 * (F.col("dart") % 2)).alias("dart"), "to")
    state = scratch.save(state.withColumn("low", F.col("dart")), "low0")
    k, moving = 0, True
    while moving:
        further = state.select(F.col("dart").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        step = state.join(further, "to").select("dart", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved"))
        k += 1
        step = scratch.save(step, f"low{k}")
        moving = not step.where("moved").isEmpty()
        scratch.drop(f"low{k - 1}")
        state = step.drop("moved")
    return darts.join(state.select("dart", F.col("low").alias("face")), "dart")


def face_areas(darts: DataFrame) -> DataFrame:
    """(face, m2): positive inside a boundary, negative for the outside of what hangs together, 0 around lines that close nothing.

    A segment with the same face on both sides, as a dead end has, bounds nothing and isn't counted.
    """
    sides = darts.groupBy("face", F.floor(F.col("dart") / 2)).agg(F.count("*").alias("n"), F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("m2"))
    return sides.groupBy("face").agg((F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("m2"))), F.lit(0.0)) / 2).alias("m2"))


def surrounding(points: DataFrame, darts: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """(id, face): the smallest bounded face whose boundary goes around a point (id, x, y), which is the one it lies in."""
    bounded = areas.where("m2 > 0")
    held = in_edges(points, darts.join(bounded.select("face"), "face", "left_semi").select("face", "ax", "ay", "bx", "by"), size).join(bounded, "face")
    return held.groupBy("id").agg(F.min(F.struct("m2", "face")).alias("b")).select("id", "b.face")


def land_faces(segments: DataFrame, size: float) -> DataFrame:
    """(face, m2, land) of each bounded face: its area without the islands in it, and whether it is land.

    segments has ``coast`` too: land is on the left of those. A face is land if it holds a seed, a place ``SEED_M`` left of
    the middle of a coast segment. Seeds outside all bounded faces count for nothing. ``size`` is that of the cells by
    which places find boundaries.
    """
    scratch = Scratch(segments.sparkSession)
    darts = scratch.save(darts_by_face(segments), "faces")
    areas = scratch.save(face_areas(darts), "areas")
    outside = areas.where("m2 < 0").withColumnRenamed("m2", "island_m2")
    first = darts.join(outside, "face").groupBy("face", "island_m2").agg(F.min(F.struct("ax", "ay")).alias("p"))
    around = surrounding(first.select(F.col("face").alias("id"), (F.col("p.ax") - _BESIDE_M).alias("x"), F.col("p.ay").alias("y")), darts, areas, size)
    islands = around.join(first.select(F.col("face").alias("id"), "island_m2"), "id").groupBy("face").agg(F.sum("island_m2").alias("less"))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    side = lambda c, d, sign: (F.col(f"a{c}") + F.col(f"b{c}")) / 2 + sign * (F.col(f"b{d}") - F.col(f"a{d}")) / length * SEED_M
    seeds = segments.where("coast").where(length > LEAST_SIDE_M).select(F.col("seg").alias("id"), side("x", "y", -1).alias("x"), side("y", "x", 1).alias("y"))
    land = surrounding(seeds, darts, areas, size).select("face", F.lit(True).alias("land")).distinct()
    out = areas.where("m2 > 0").join(islands, "face", "left").join(land, "face", "left")
    return out.select("face", (F.col("m2") + F.coalesce("less", F.lit(0.0))).alias("m2"), F.coalesce("land", F.lit(False)).alias("land"))

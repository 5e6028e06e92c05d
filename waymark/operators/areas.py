"""Areas from member ways: rings chained end to end, and holes given to the outer rings that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.session import Scratch

from .spatial import in_faces


def assemble_rings(members: DataFrame) -> DataFrame:
    """(area, ring, seq, way, reversed): the closed rings that an area's ways make, and each way's place and sense in its ring.

    members: area, way, nodes (ids in order); a way that is listed twice counts once. Each way is two darts, one a
    direction; where exactly two ways end at a node, a dart goes on with the other way's. Pointers are doubled until no
    dart meets an open end or a smaller way any more, so a ring of n ways takes about log2(n) rounds; the ring starts with
    its smallest way, run forwards, and is named by it. Ways that end alone, or where more than two meet, make no ring.
    """
    scratch = Scratch(members.sparkSession)
    ways = members.where(F.size("nodes") >= 2).dropDuplicates(["area", "way"]).select("area", "way", F.col("nodes")[0].alias("a"), F.element_at("nodes", -1).alias("b"), F.size("nodes").alias("_n"))
    alone = ways.where("a = b AND _n > 3").select("area", F.col("way").alias("ring"), F.lit(0).cast("long").alias("seq"), "way", F.lit(False).alias("reversed"))
    sides = F.array(F.struct(F.lit(0).alias("back"), F.col("a").alias("tail"), F.col("b").alias("head")), F.struct(F.lit(1).alias("back"), F.col("b").alias("tail"), F.col("a").alias("head")))
    darts = ways.where("a <> b").select("area", "way", F.explode(sides).alias("s")).select("area", "way", (F.col("way") * 2 + F.col("s.back")).alias("dart"), "s.tail", "s.head")
    darts = scratch.save(darts, "darts")
    two = darts.groupBy("area", F.col("tail").alias("head")).agg(F.count("*").alias("_ends"), F.min("dart").alias("_one"), F.max("dart").alias("_other")).where("_ends = 2")
    # Of the two darts that leave a node, the one of this very way turns back.
    going = darts.join(two, ["area", "head"]).select("area", "dart", F.when(F.floor(F.col("_one") / 2) == F.col("way"), F.col("_other")).otherwise(F.col("_one")).alias("to"))
    going = scratch.save(going, "next")
    scratch.drop("darts")
    state, k, moving = going.select("area", "dart", "to", F.least("dart", "to").alias("low")), 0, True
    while moving:
        above = state.select("area", F.col("dart").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        met = state.join(above, ["area", "to"], "left")
        step = met.select("area", "dart", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), (F.col("_to").isNull() | (F.col("_low") < F.col("low"))).alias("moved"))
        k += 1
        step = scratch.save(step, f"low{k}")
        if k > 1:
            scratch.drop(f"low{k - 1}")
        moving = not step.where("moved").isEmpty()
        state = step.where("to IS NOT NULL").select("area", "dart", "to", "low")  # the others lead to an open end
    rings = scratch.save(state.where("low % 2 = 0").select("area", "dart", "low"), "rings")
    scratch.drop(f"low{k}")
    left = going.join(rings, ["area", "dart"]).select("area", "dart", "low", F.when(F.col("to") != F.col("low"), F.col("to")).alias("to")).withColumn("n", F.col("to").isNotNull().cast("long"))
    left, k = scratch.save(left, "left0"), 0
    scratch.drop("next", "rings")
    while not left.where("to IS NOT NULL").isEmpty():
        above = left.select("area", F.col("dart").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        further = left.where("to IS NOT NULL").join(above, ["area", "to"]).select("area", "dart", "low", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"))
        k += 1
        left = scratch.save(left.where("to IS NULL").unionByName(further), f"left{k}")
        scratch.drop(f"left{k - 1}")
    sizes = left.groupBy("area", "low").agg(F.max("n").alias("_last"))
    chained = left.join(sizes, ["area", "low"]).select("area", F.floor(F.col("low") / 2).alias("ring"), (F.col("_last") - F.col("n")).alias("seq"), F.floor(F.col("dart") / 2).alias("way"), (F.col("dart") % 2 == 1).alias("reversed"))
    return chained.unionByName(alone)


def ring_nodes(rings: DataFrame, members: DataFrame) -> DataFrame:
    """(area, ring, nodes): each ring's nodes in order, the first not repeated. Rows of ``assemble_rings`` and its members."""
    own = members.dropDuplicates(["area", "way"]).select("area", "way", "nodes")
    run = F.when(F.col("reversed"), F.reverse("nodes")).otherwise(F.col("nodes"))
    parts = rings.join(own, ["area", "way"]).select("area", "ring", F.struct("seq", F.slice(run, 1, F.size(run) - 1).alias("nodes")).alias("part"))
    return parts.groupBy("area", "ring").agg(F.flatten(F.sort_array(F.collect_list("part"))["nodes"]).alias("nodes"))


def holes(outer: DataFrame, inner: DataFrame, size: float) -> DataFrame:
    """(area, ring, outer): for each inner ring the smallest outer ring of its area that holds its first point.

    Both: area, ring, points (array of x, y). Rings that none holds have no row.
    """
    at = inner.select(F.struct("area", "ring").alias("id"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
    faces = outer.select(F.struct("area", "ring").alias("face"), F.col("points").alias("ring"))
    held = in_faces(at, faces, size).where(F.col("id.area") == F.col("face.area"))
    area = outer.select(F.struct("area", "ring").alias("face"), geo.polygon_area(F.col("points"), F.slice(F.array("points"), 1, 0)).alias("_m2"))
    best = held.join(area, "face").groupBy("id").agg(F.min(F.struct("_m2", F.col("face.ring").alias("outer"))).alias("b"))
    return best.select("id.area", "id.ring", "b.outer")

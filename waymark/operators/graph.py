"""Directed road graphs from ways: detailed and compressed edges, order, adjacency and checks.

Ways have way_id and tags; way_nodes have way_id, pos and node_id; nodes have node_id, lon and lat. A way counts if its
type is a road and all its nodes are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import geo, tags

from .prefix import dense_index, prefix_sums

#: Columns of an edge that come from its way's tags.
_WAY = ["road_class", "access", "reason", "flags", "layer", "sense", "forward_kmh", "backward_kmh", "forward_told", "backward_told"]


def road_ways(ways: DataFrame) -> DataFrame:
    """way_id and what the tags say, of ways whose type is a road."""
    g = F.col("tags")
    w = ways.withColumn("_h", F.trim(g["highway"])).withColumn("road_class", tags.road_class(F.col("_h"))).where("road_class IS NOT NULL")
    told = {side: F.coalesce(F.when(g[f"maxspeed:{side}"] != "", g[f"maxspeed:{side}"]), g["maxspeed"]) for side in ("forward", "backward")}
    a = tags.access(F.col("_h"), g)
    w = w.withColumns({
        "access": a["class"], "reason": a["reason"], "layer": tags.layer(g["layer"]), "sense": tags.oneway(g),
        "flags": F.when(tags.is_true(g["bridge"]), tags.BRIDGE).otherwise(0) + F.when(tags.is_true(g["tunnel"]), tags.TUNNEL).otherwise(0),
    })
    for side, c in told.items():  # a speed's text is parsed once; what it says is used twice
        w = w.withColumn(f"_{side}", tags.explicit_speed(c))
    for side in told:
        w = w.withColumn(f"{side}_kmh", F.coalesce(f"_{side}", tags.default_speed(F.col("_h")))).withColumn(f"{side}_told", F.col(f"_{side}").isNotNull())
    return w.select("way_id", *_WAY)


def located(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Way nodes with their places, of ways of two nodes or more that are all known."""
    way = Window.partitionBy("way_id")
    j = way_nodes.join(nodes, "node_id", "left").withColumn("_n", F.count("*").over(way)).withColumn("_known", F.count("lon").over(way))
    return j.where("_n > 1 AND _known = _n").drop("_n", "_known")


def _both_ways(steps: DataFrame) -> DataFrame:
    """Two directed edges of each step, made from one row; the one against a one-way sense is flagged."""
    both = steps.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    ahead = F.col("side") == 1
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    flags = F.col("flags") + F.when(F.col("sense") == -F.col("side"), tags.AGAINST_ONEWAY).otherwise(0)
    return both.select(
        "way_id", "segment", pick("from_id", "to_id").alias("source"), pick("to_id", "from_id").alias("target"), "length_m", pick("forward_kmh", "backward_kmh").alias("kmh"), "road_class", "access",
        "reason", flags.alias("flags"), "layer", pick("forward_told", "backward_told").alias("explicit"), (~ahead).alias("reversed"),
    )


def detailed_edges(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Two directed edges for each pair of adjacent, different places of a way."""
    w = Window.partitionBy("way_id").orderBy("pos")
    at = located(way_nodes, nodes).withColumns({
        "to_id": F.lead("node_id").over(w), "lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w), "segment": F.row_number().over(w) - 1,
    })
    at = at.where(F.col("to_id").isNotNull() & (F.col("to_id") != F.col("node_id")))
    at = at.withColumn("length_m", geo.distance_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))).where("length_m > 0")
    return _both_ways(at.withColumnRenamed("node_id", "from_id").join(road_ways(ways), "way_id"))


def breakpoints(at: DataFrame) -> DataFrame:
    """Nodes where ways are split: ends, the middle of a closed way, and nodes that occur more than once."""
    way = Window.partitionBy("way_id")
    w = way.orderBy("pos")
    x = at.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(way))
    x = x.withColumn("closed", F.first("node_id").over(w) == F.last("node_id").over(way.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    middle = F.col("closed") & (F.col("n") > 2) & (F.col("i") == F.floor(F.col("n") / 2))
    return x.groupBy("node_id").agg((F.max((ends | middle).cast("int")) + F.count("*")).alias("c")).where("c > 1").select("node_id")


def compressed_edges(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between breakpoints, as long as the shape between them; ``points`` counts the shape's points."""
    roads = road_ways(ways)
    at = located(way_nodes, nodes).join(roads.select("way_id"), "way_id", "left_semi")
    cut = breakpoints(at).withColumn("_cut", F.lit(1))
    w = Window.partitionBy("way_id").orderBy("pos")
    x = at.join(cut, "node_id", "left").withColumn("i", F.row_number().over(w) - 1)
    step = geo.distance_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    x = x.withColumn("step", F.coalesce(F.when(F.lag("node_id").over(w) != F.col("node_id"), step), F.lit(0.0)))
    # Points up to and with a breakpoint belong to the piece that it ends.
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("piece", F.coalesce(F.sum(F.coalesce("_cut", F.lit(0))).over(before), F.lit(0)))
    pieces = x.groupBy("way_id", "piece").agg(
        F.sum("step").alias("length_m"), F.max("i").alias("last"), F.max_by("node_id", "i").alias("to_id"), F.count("*").alias("k")
    )
    p = Window.partitionBy("way_id").orderBy("piece")
    pieces = pieces.withColumn("from_id", F.lag("to_id").over(p)).withColumn("segment", F.lag("last").over(p)).where("from_id IS NOT NULL AND length_m > 0")
    return _both_ways(pieces.join(roads, "way_id"))


def allowed(profile: str = "normal") -> Column:
    """Whether a profile may use an edge: normal traffic keeps to the sense and to open or destination roads."""
    if profile != "normal":
        return F.lit(True)
    return (F.col("flags").bitwiseAND(tags.AGAINST_ONEWAY) == 0) & F.col("access").isin(tags.NORMAL, tags.DESTINATION)


def edge_stats(edges: DataFrame) -> DataFrame:
    """One row of counters over all edges."""
    return edges.agg(
        F.count("*").alias("edges"), F.count_if("explicit").alias("explicit"), F.count_if(~F.col("explicit")).alias("fallback"), F.count_if(F.col("access") != tags.NORMAL).alias("restricted"),
        F.count_if(F.col("flags").bitwiseAND(tags.AGAINST_ONEWAY) != 0).alias("against"), F.max(F.when(allowed(), F.col("kmh"))).alias("max_legal_kmh"),
    )


def node_index(edges: DataFrame) -> DataFrame:
    """node_id, node_index (ascending id), adjacency_count and adjacency_offset of the edges sorted by source."""
    ids = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct()
    out = edges.groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("adjacency_count"))
    ids = ids.join(out, "node_id", "left").withColumn("adjacency_count", F.coalesce("adjacency_count", F.lit(0)))
    return prefix_sums(dense_index(ids, "node_id", "node_index"), "node_id", F.col("adjacency_count"), "adjacency_offset")


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """target, sources: what leads to each node, in ascending order."""
    return edges.groupBy("target").agg(F.sort_array(F.collect_list("source")).alias("sources"))


def representatives(edges: DataFrame) -> DataFrame:
    """One legal edge of each physical piece: of two legal directions the one from the smaller (source, target)."""
    w = Window.partitionBy("way_id", "segment", F.least("source", "target"), F.greatest("source", "target")).orderBy("source", "target", "reversed")
    return edges.where(allowed()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def degree_histogram(edges: DataFrame) -> DataFrame:
    """legal_out, nodes: how many nodes have how many legal ways out."""
    ids = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct()
    legal = edges.where(allowed()).groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("legal_out"))
    return ids.join(legal, "node_id", "left").groupBy(F.coalesce("legal_out", F.lit(0)).alias("legal_out")).agg(F.count("*").alias("nodes"))


def violations(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (rule, n) for each broken invariant; a sound graph has none."""
    ids = index.select(F.col("node_id"))
    checks = {
        "length": edges.where("NOT length_m > 0"), "speed": edges.where("NOT kmh > 0"), "class": edges.where(~F.col("road_class").between(0, len(tags.ROAD_SPEEDS) - 1)),
        "source": edges.join(ids, edges.source == ids.node_id, "left_anti"), "target": edges.join(ids, edges.target == ids.node_id, "left_anti"),
        "offset": index.join(index.select((F.col("node_index") + 1).alias("node_index"), (F.col("adjacency_offset") + F.col("adjacency_count")).alias("_o")), "node_index").where("_o <> adjacency_offset"),
    }
    out = None
    for rule, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def stable_edge_id() -> Column:
    return F.format_string("w%d:%d>%d:%d", "way_id", "source", "target", "segment")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the places of both their nodes: source_lon, source_lat, target_lon, target_lat."""
    n = lambda k: nodes.select(F.col("node_id").alias(k), F.col("lon").alias(f"{k}_lon"), F.col("lat").alias(f"{k}_lat"))
    return edges.join(n("source"), "source").join(n("target"), "target")


def usable(edges: DataFrame) -> DataFrame:
    """Edges that traffic can use: open or for destinations, with a speed."""
    return edges.where((F.col("access") <= tags.DESTINATION) & (F.col("kmh") > 0))


def first_nodes(seen: DataFrame) -> DataFrame:
    """(node_id, lon, lat): the place with which a node comes first, in the order of (way_id, pos)."""
    first = seen.groupBy("node_id").agg(F.min(F.struct("way_id", "pos", "lon", "lat")).alias("f"))
    return first.select("node_id", "f.lon", "f.lat")


def name_faults(found: DataFrame, wanted: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(name, fault): names that are wanted and missing, or found and forbidden."""
    have = found.select("name").distinct()
    missing = wanted.select("name").distinct().join(have, "name", "left_anti").select("name", F.lit("missing").alias("fault"))
    return missing.unionByName(have.join(forbidden.select("name").distinct(), "name", "left_semi").select("name", F.lit("forbidden").alias("fault")))

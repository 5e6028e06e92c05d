"""Queries over road graphs: orders as ways, their lines' parts as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, tags
from waymark.operators import blocks, graph, routing

from . import tables as t
from .scalars import ACCESS, LAYER, ONEWAY, REASON, SPEEDS


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with gaps, so that some ways are dropped."""
    return t.nodes(spark, d).where("node_id % 211 <> 0")


def _detailed(spark: SparkSession, d: str) -> DataFrame:
    return graph.detailed_edges(t.ways(spark, d), t.way_nodes(spark, d), _known(spark, d))


def _compressed(spark: SparkSession, d: str) -> DataFrame:
    return graph.compressed_edges(t.ways(spark, d), t.way_nodes(spark, d), _known(spark, d))


def _shown(edges: DataFrame) -> DataFrame:
    return edges.select(
        graph.stable_edge_id().alias("edge"), F.round("length_m", 3).alias("length_m"), F.round("kmh", 4).alias("kmh"), "road_class", "access", "reason", "flags", "layer", "explicit"
    )


# What the ways' tags say, in SQL.
_CLASS = "list_position([" + ", ".join(f"'{k}'" for k in tags.ROAD_SPEEDS) + "], highway) - 1"
_ROADS = f"""{SPEEDS}, roads AS (SELECT way_id, CAST({_CLASS} AS INTEGER) AS road_class, CAST({ACCESS} AS INTEGER) AS access, CAST({REASON} AS INTEGER) AS reason, {LAYER} AS layer, {ONEWAY} AS sense,
  coalesce(told, usual) AS kmh, told IS NOT NULL AS explicit, CASE WHEN bridge = 'yes' THEN 2 ELSE 0 END + CASE WHEN tunnel = 'yes' THEN 4 ELSE 0 END AS base FROM speeds WHERE usual IS NOT NULL)"""
_AT = f"""{t.WAY_NODES}, {t.NODES}, known AS (SELECT * FROM nodes WHERE node_id % 211 <> 0),
  whole AS (SELECT way_id FROM way_nodes LEFT JOIN known USING (node_id) GROUP BY way_id HAVING count(*) > 1 AND count(lon) = count(*)),
  spot AS (SELECT w.way_id, w.pos, w.node_id, k.lon, k.lat, row_number() OVER (PARTITION BY w.way_id ORDER BY w.pos) - 1 AS i, count(*) OVER (PARTITION BY w.way_id) AS n
    FROM way_nodes w JOIN known k USING (node_id) JOIN whole USING (way_id) JOIN roads USING (way_id))"""
_HAVERSINE = "6371008.8 * 2 * asin(least(1.0, sqrt(power(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"
_DETAILED = f"""{_ROADS}, {_AT}, steps AS (SELECT a.way_id, a.i AS segment, a.node_id AS f, b.node_id AS g, {_HAVERSINE.format(a="a.", b="b.")} AS length_m
    FROM spot a JOIN spot b ON a.way_id = b.way_id AND b.i = a.i + 1 WHERE a.node_id <> b.node_id),
  edges AS (SELECT s.way_id, segment, CASE side WHEN 1 THEN f ELSE g END AS source, CASE side WHEN 1 THEN g ELSE f END AS target, length_m, kmh, road_class, access, reason,
    base + CASE WHEN sense = -side THEN 1 ELSE 0 END AS flags, layer, explicit, side = -1 AS reversed FROM steps s JOIN roads USING (way_id), (VALUES (1), (-1)) v(side) WHERE length_m > 0)"""
_SHOWN = "SELECT 'w' || way_id || ':' || source || '>' || target || ':' || segment AS edge, round(length_m, 3) AS length_m, round(kmh, 4) AS kmh, road_class, access, reason, flags, layer, explicit FROM edges"
_LEGAL = "flags % 2 = 0 AND access IN (0, 1)"


def g01_detailed_graph(spark: SparkSession, d: str) -> DataFrame:
    """Every directed edge of the detailed graph (G01 with J01, U03, W01, X09)."""
    return _shown(_detailed(spark, d))


def g02_compressed_graph(spark: SparkSession, d: str) -> DataFrame:
    """Every directed edge between breakpoints (G02 with W03, A12)."""
    return _shown(_compressed(spark, d))


_COMPRESSED = f"""{_ROADS}, {_AT}, ends AS (SELECT way_id, max(CASE WHEN i = 0 THEN node_id END) = max(CASE WHEN i = n - 1 THEN node_id END) AS closed FROM spot GROUP BY way_id),
  brk AS (SELECT node_id FROM spot JOIN ends USING (way_id) GROUP BY node_id HAVING count(*) > 1 OR bool_or(i = 0 OR i = n - 1 OR (closed AND n > 2 AND i = n // 2))),
  marks AS (SELECT a.way_id, a.i, a.node_id, p.i AS pi, row_number() OVER (PARTITION BY a.way_id ORDER BY a.i) AS k FROM spot a SEMI JOIN brk USING (node_id) LEFT JOIN spot p ON p.way_id = a.way_id AND p.i = a.i - 1),
  pieces AS (SELECT l.way_id, l.i AS lo, r.i AS hi, l.node_id AS f, r.node_id AS g FROM marks l JOIN marks r ON l.way_id = r.way_id AND r.k = l.k + 1),
  hops AS (SELECT a.way_id, b.i, CASE WHEN a.node_id <> b.node_id THEN {_HAVERSINE.format(a="a.", b="b.")} ELSE 0 END AS m FROM spot a JOIN spot b ON a.way_id = b.way_id AND b.i = a.i + 1),
  steps AS (SELECT p.way_id, lo AS segment, f, g, sum(m) AS length_m FROM pieces p JOIN hops h ON h.way_id = p.way_id AND h.i > lo AND h.i <= hi GROUP BY ALL),
  edges AS (SELECT s.way_id, segment, CASE side WHEN 1 THEN f ELSE g END AS source, CASE side WHEN 1 THEN g ELSE f END AS target, length_m, kmh, road_class, access, reason,
    base + CASE WHEN sense = -side THEN 1 ELSE 0 END AS flags, layer, explicit FROM steps s JOIN roads USING (way_id), (VALUES (1), (-1)) v(side) WHERE length_m > 0)"""


def a03_edge_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counters over the detailed graph."""
    return graph.edge_stats(_detailed(spark, d)).withColumn("max_legal_kmh", F.round("max_legal_kmh", 4))


A03 = f"""WITH {_DETAILED} SELECT count(*) AS edges, count(*) FILTER (explicit) AS explicit, count(*) FILTER (NOT explicit) AS fallback, count(*) FILTER (access <> 0) AS restricted,
  count(*) FILTER (flags % 2 = 1) AS against, round(max(kmh) FILTER ({_LEGAL}), 4) AS max_legal_kmh FROM edges"""


def a03_unknown_speeds(spark: SparkSession, d: str) -> DataFrame:
    """How often each speed tag that says no speed occurs."""
    w = t.ways(spark, d).where(tags.road_class(F.col("tags")["highway"]).isNotNull())
    return w.select(tags.unknown_speed(F.col("tags")["maxspeed"]).alias("raw")).where("raw IS NOT NULL").groupBy("raw").agg(F.count("*").alias("n"))


A03U = f"WITH {SPEEDS} SELECT trim(maxspeed) AS raw, count(*) AS n FROM speeds WHERE usual IS NOT NULL AND told IS NULL AND trim(maxspeed) <> '' GROUP BY ALL"


def a15_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Index, number of ways out and offset of each node in the edges sorted by source."""
    return graph.node_index(_detailed(spark, d)).select("node_id", "node_index", "adjacency_count", "adjacency_offset")


A15 = f"""WITH {_DETAILED}, ids AS (SELECT source AS node_id FROM edges UNION SELECT target FROM edges), c AS (SELECT node_id, count(source) AS adjacency_count FROM ids LEFT JOIN edges ON source = node_id GROUP BY ALL)
SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS node_index, adjacency_count,
  CAST(coalesce(sum(adjacency_count) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS adjacency_offset FROM c"""


def a16_reverse_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """What leads to each node."""
    return graph.reverse_adjacency(_detailed(spark, d)).select("target", F.size("sources").cast("long").alias("n"), F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"))


A16 = f"WITH {_DETAILED} SELECT target, count(*) AS n, string_agg(CAST(source AS VARCHAR), ',' ORDER BY source) AS sources FROM edges GROUP BY target"


def a13_degrees(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes have how many legal ways out."""
    return graph.degree_histogram(_detailed(spark, d))


A13 = f"""WITH {_DETAILED}, ids AS (SELECT source AS node_id FROM edges UNION SELECT target FROM edges), c AS (SELECT node_id, count(source) AS legal_out FROM ids LEFT JOIN (SELECT * FROM edges WHERE {_LEGAL}) ON source = node_id GROUP BY ALL)
SELECT legal_out, count(*) AS nodes FROM c GROUP BY ALL"""


def w06_physical_edges(spark: SparkSession, d: str) -> DataFrame:
    """One legal edge of each physical piece."""
    return graph.representatives(_detailed(spark, d)).select("way_id", "segment", "source", "target")


W06 = f"""WITH {_DETAILED} SELECT way_id, segment, source, target FROM edges WHERE {_LEGAL}
QUALIFY row_number() OVER (PARTITION BY way_id, segment, least(source, target), greatest(source, target) ORDER BY source, target, reversed) = 1"""


def v02_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Broken invariants of the detailed graph with some edges spoilt: each rule finds its own."""
    e = _detailed(spark, d)
    index = graph.node_index(e)
    bad = e.withColumn("length_m", F.when(F.col("way_id") % 1000 == 1, 0.0).otherwise(F.col("length_m"))).withColumn("kmh", F.when(F.col("way_id") % 1000 == 2, -1.0).otherwise(F.col("kmh")))
    bad = bad.withColumn("target", F.when((F.col("way_id") % 1000 == 3) & (F.col("segment") == 0), -F.col("target") - 1).otherwise(F.col("target")))
    return graph.violations(bad, index)


V02 = f"""WITH {_DETAILED}, r AS (SELECT 'length' AS rule, count(*) AS n FROM edges WHERE way_id % 1000 = 1 UNION ALL SELECT 'speed', count(*) FROM edges WHERE way_id % 1000 = 2
  UNION ALL SELECT 'target', count(*) FROM edges WHERE way_id % 1000 = 3 AND segment = 0) SELECT rule, n FROM r WHERE n > 0"""


def _road_net(spark: SparkSession, d: str) -> DataFrame:
    """A sparser net for routes: parts joined to near neighbours by key, each with a class and a speed (analogous roads)."""
    n = t.nodes(spark, d)
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("step"), F.lit(c).alias("road_class")) for a, c in ((1, 11), (13, 4), (97, 4), (1009, 0))]))
    e = n.select(F.col("node_id").alias("source"), "lon", "lat", steps.alias("s")).select("*", (F.col("source") + F.col("s.step")).alias("target"), "s.road_class")
    far = n.select(F.col("node_id").alias("target"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    e = e.join(far, "target").withColumn("length_m", F.round(geo.distance_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 3))
    e = e.where("length_m > 0 AND source % 5 <> 0").withColumn("kmh", F.when(F.col("road_class") == 0, 110.0).when(F.col("road_class") == 4, 70.0).otherwise(40.0))
    e = e.withColumn("access", F.lit(0)).withColumn("flags", F.when(F.col("source") % 7 == 0, 1).otherwise(0))
    return e.select((F.col("source") * 10_000 + F.col("s.step")).alias("edge"), "source", "target", "length_m", "kmh", "road_class", "access", "flags")


_NET = f"""{t.NODES}, net AS (SELECT a.node_id * 10000 + step AS edge, a.node_id AS source, b.node_id AS target, round({_HAVERSINE.format(a="a.", b="b.")}, 3) AS length_m, cls AS road_class, CASE cls WHEN 0 THEN 110.0::DOUBLE WHEN 4 THEN 70 ELSE 40 END AS kmh
  FROM nodes a, (VALUES (1, 11), (13, 4), (97, 4), (1009, 0)) v(step, cls) JOIN nodes b ON b.node_id = a.node_id + step WHERE a.node_id % 5 <> 0 AND a.node_id % 7 <> 0)"""


def _g03(preference: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        starts = spark.createDataFrame([(1, 1), (2, 2)], "request long, node long")
        best = blocks.searched(_road_net(spark, d), starts, routing.edge_cost(preference))
        return best.select("request", "node", F.round("cost", 3).alias("cost"))

    query.__doc__ = f"Cost of the best route from two nodes to every other node, {preference} (G03, F05)."
    return query


def _g03_sql(cost: str) -> str:
    return f"""WITH RECURSIVE {_NET}, w AS (SELECT source, target, {cost} AS w FROM net WHERE length_m > 0),
best(request, node, cost) USING KEY (request, node) AS (SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 0.0::DOUBLE), (2, 2, 0.0)) s(request, node, cost)
  UNION SELECT x.request, x.target, min(x.c) FROM (SELECT b.request, w.target, b.cost + w.w AS c FROM best b JOIN w ON w.source = b.node) x
    LEFT JOIN recurring.best o ON o.request = x.request AND o.node = x.target WHERE o.cost IS NULL OR x.c < o.cost GROUP BY ALL)
SELECT request, node, round(cost, 3) AS cost FROM best"""


_SECONDS = "length_m / 1000 / kmh * 3600"


def g10_plan(spark: SparkSession, d: str) -> DataFrame:
    """Multi-stop plans: customers' orders as legs, rolled up to the first that fails."""
    o = t.table(spark, d, "orders")
    legs = o.select(
        F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("leg"), (F.col("o_orderkey") % 17 != 0).alias("success"), F.round(F.col("o_totalprice") * 100).alias("distance_m"),
        F.floor(F.round(F.col("o_totalprice") * 100) / 7).cast("double").alias("time_s"), (F.col("o_orderkey") % 101).alias("queue_peak"),
    )
    r = routing.plan_rollup(legs)
    return r.select("plan", "failed_leg", "distance_m", "time_s", "queue_peak")


G10 = """WITH l AS (SELECT o_custkey AS plan, o_orderkey AS leg, o_orderkey % 17 <> 0 AS ok, round(o_totalprice * 100) AS m, floor(round(o_totalprice * 100) / 7) AS s, o_orderkey % 101 AS q FROM orders),
f AS (SELECT plan, min(leg) FILTER (NOT ok) AS failed_leg FROM l GROUP BY plan)
SELECT l.plan, failed_leg, coalesce(sum(m) FILTER (ok), 0) AS distance_m, coalesce(sum(s) FILTER (ok), 0) AS time_s, max(q) AS queue_peak
FROM l JOIN f ON l.plan = f.plan WHERE failed_leg IS NULL OR leg <= failed_leg GROUP BY ALL"""


def g03_all_paths(spark: SparkSession, d: str) -> DataFrame:
    """Cost of the best path from node 1 to every node that it reaches, and the seconds that its edges add up to."""
    net = _road_net(spark, d)
    best = blocks.searched(net, spark.createDataFrame([(1, 1)], "request long, node long"), routing.edge_cost("fastest"))
    return routing.walked(best, net).select(F.col("node").alias("target"), F.round("cost", 3).alias("cost"), F.round("seconds", 3).alias("walked"))


QUERIES = {
    "G01_detailed_graph": g01_detailed_graph, "G02_compressed_graph": g02_compressed_graph, "A03_edge_stats": a03_edge_stats, "A03_unknown_speeds": a03_unknown_speeds, "A15_adjacency": a15_adjacency,
    "A16_reverse_adjacency": a16_reverse_adjacency, "A13_degrees": a13_degrees, "W06_physical_edges": w06_physical_edges, "V02_invariants": v02_invariants, "G03_fastest": _g03("fastest"),
    "G03_shortest": _g03("shortest"), "G03_avoid_small": _g03("avoid_small"), "G03_avoid_major": _g03("avoid_major"), "G03_all_paths": g03_all_paths, "G10_plan": g10_plan,
}
SQL = {
    "G01_detailed_graph": f"WITH {_DETAILED} {_SHOWN}", "G02_compressed_graph": f"WITH {_COMPRESSED} {_SHOWN}", "A03_edge_stats": A03, "A03_unknown_speeds": A03U, "A15_adjacency": A15,
    "A16_reverse_adjacency": A16, "A13_degrees": A13, "W06_physical_edges": W06, "V02_invariants": V02, "G03_fastest": _g03_sql(_SECONDS), "G03_shortest": _g03_sql("length_m"),
    "G03_avoid_small": _g03_sql(f"{_SECONDS} * CASE WHEN road_class = 11 THEN 4.0::DOUBLE ELSE 1 END"), "G03_avoid_major": _g03_sql(f"{_SECONDS} * CASE WHEN road_class IN (0, 4) THEN 4.0::DOUBLE ELSE 1 END"),
    "G03_all_paths": _g03_sql(_SECONDS).replace("SELECT request, node, round(cost, 3) AS cost FROM best", "SELECT node AS target, round(cost, 3) AS cost, round(cost, 3) AS walked FROM best WHERE request = 1"),
    "G10_plan": G10,
}

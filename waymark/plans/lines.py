"""Queries along lines and around rings: areas from member ways, places ahead, speeds at drawn points, pieces by tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import areas, linear

from . import tables as t
from .network import _SHAPE, _chain_steps, _shapes
from .places import _RINGS, _rings

# Areas: an order's lines are the ways of its outer ring, every second one drawn backwards; orders divisible by 7 lack one,
# orders divisible by 5 have a closed way inside.
_WAYS = "id * 100 + n AS way, id * 100 + n AS a, id * 100 + n % k + 1 AS b"


def _members(spark: SparkSession, d: str) -> DataFrame:
    lines = t.lines(spark, d).select("id", F.col("n").cast("long").alias("n"))
    sides = lines.join(lines.groupBy("id").agg(F.count("*").alias("k")).where("k >= 3"), "id").where("NOT (id % 7 = 0 AND n = 2)")
    ends = sides.selectExpr("id AS area", "'outer' AS role", "n", _WAYS.split(", ")[0], *_WAYS.split(", ")[1:])
    nodes = F.when(F.col("n") % 3 == 0, F.array("a", F.col("a") + 20, "b")).otherwise(F.array("a", "b"))
    outer = ends.select("area", "role", "way", F.when(F.col("n") % 2 == 0, F.reverse(nodes)).otherwise(nodes).alias("nodes"))
    inner = sides.where("n = 1 AND id % 5 = 0").select(F.col("id").alias("area"), F.lit("inner").alias("role"), (F.col("id") * 100 + 50).alias("way"), F.array(*[F.col("id") * 100 + i for i in (51, 52, 53, 51)]).alias("nodes"))
    return outer.unionByName(inner)


def s03_area_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings assembled from the member ways of each area: their ways in order with their sense, and their nodes."""
    m = _members(spark, d)
    rings = areas.assemble_rings(m)
    sense = F.concat(F.col("way").cast("string"), F.when(F.col("reversed"), "-").otherwise("+"))
    ways = rings.groupBy("area", "ring").agg(F.count("*").alias("ways"), F.sort_array(F.collect_list(F.struct("seq", sense.alias("way"))))["way"].alias("w"))
    nodes = areas.ring_nodes(rings, m)
    return ways.join(nodes, ["area", "ring"]).select("area", "ring", "ways", F.array_join("w", ",").alias("chain"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


S03 = f"""WITH RECURSIVE {t.LINES}, k AS (SELECT id, count(*) AS k FROM lines GROUP BY id HAVING count(*) >= 3),
side AS (SELECT id AS area, CAST(n AS BIGINT) AS n, {_WAYS} FROM lines JOIN k USING (id) WHERE NOT (id % 7 = 0 AND n = 2)),
m AS (SELECT area, way, CASE WHEN n % 2 = 0 THEN list_reverse(ns) ELSE ns END AS ns FROM (SELECT *, CASE WHEN n % 3 = 0 THEN [a, a + 20, b] ELSE [a, b] END AS ns FROM side)
  UNION ALL SELECT area, area * 100 + 50, [area * 100 + 51, area * 100 + 52, area * 100 + 53, area * 100 + 51] FROM side WHERE n = 1 AND area % 5 = 0),
dart AS (SELECT area, way, '+' AS sense, ns[1] AS tail, ns[-1] AS head, ns[:-2] AS ns FROM m UNION ALL SELECT area, way, '-', ns[-1], ns[1], list_reverse(ns)[:-2] FROM m WHERE ns[1] <> ns[-1]),
w(area, ring, start, way, head, ways, chain, nodes) AS (SELECT area, way, tail, way, head, 1::BIGINT, way || sense, ns FROM dart WHERE sense = '+'
  UNION ALL SELECT w.area, w.ring, w.start, x.way, x.head, w.ways + 1, w.chain || ',' || x.way || x.sense, list_concat(w.nodes, x.ns) FROM w JOIN dart x ON x.area = w.area AND x.tail = w.head AND x.way > w.ring AND x.way <> w.way WHERE w.head <> w.start)
SELECT area, ring, ways, chain, array_to_string(nodes, ',') AS nodes FROM w WHERE head = start"""


def g32_look_ahead(spark: SparkSession, d: str) -> DataFrame:
    """Four places ahead on each order's line, from a start on it."""
    points = _rings(spark, d).select(F.col("id").alias("line"), F.posexplode("ring").alias("pos", "p")).select("line", "pos", "p.x", "p.y")
    asked = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("line"), (F.col("o_orderkey") % 500 - 20).cast("double").alias("at_m"), F.explode(F.array(*[F.lit(x) for x in (0.0, 40.0, 900.0, 4000.0)])).alias("ahead_m"))
    asked = asked.withColumn("id", F.concat_ws(":", F.col("line").cast("string"), F.col("ahead_m").cast("int").cast("string")))
    return linear.look_ahead(asked, points).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


G32 = f"""WITH {_RINGS}, s AS (SELECT id, n, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS by_, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS hop FROM ring WINDOW w AS (PARTITION BY id ORDER BY n)),
c AS (SELECT *, sum(hop) OVER (PARTITION BY id ORDER BY n) AS along FROM s),
q AS (SELECT o_orderkey AS id, ahead, greatest(o_orderkey % 500 - 20, 0) + ahead AS goal FROM orders, (VALUES (0), (40), (900), (4000)) v(ahead)),
f AS (SELECT q.id, ahead, x, y, bx, by_, goal - along AS rest, sqrt((bx - x) ** 2 + (by_ - y) ** 2) AS m FROM q JOIN c ON c.id = q.id AND along <= goal QUALIFY row_number() OVER (PARTITION BY q.id, ahead ORDER BY along DESC, n DESC) = 1)
SELECT id || ':' || ahead AS id, round(CASE WHEN m > 0 THEN x + (bx - x) * rest / m ELSE x END, 3) AS x, round(CASE WHEN m > 0 THEN y + (by_ - y) * rest / m ELSE y END, 3) AS y FROM f"""


def w10_speed_profile(spark: SparkSession, d: str) -> DataFrame:
    """The speed that holds from each drawn point of the routes along the chains."""
    chain, steps = _chain_steps(spark, d)
    return linear.speed_profile(steps, _shapes(chain)).select("request", "target", "point", F.round("speed_mps", 4).alias("speed_mps"))


W10 = f"""WITH {_SHAPE}, e AS (SELECT request, ask.target, row_number() OVER (PARTITION BY request ORDER BY s.edge, s.pos) - 1 AS point, CASE WHEN s.pos = 2 AND s.edge + 1 < ask.target THEN s.edge + 1 ELSE s.edge END AS edge
  FROM ask JOIN shape s ON s.edge >= request AND s.edge < ask.target WHERE s.pos > 0 OR s.edge = request)
SELECT request, target, point, round(CASE WHEN edge % 3 = 0 THEN 80 ELSE 50 END / 3.6::DOUBLE, 4) AS speed_mps FROM e"""


def j22_tile_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces into which tiles of 250 m cut the sides of each order's line, by tile."""
    r = _rings(spark, d).select("id", F.col("ring").alias("p"), F.slice("ring", 2, F.size("ring")).alias("q"))
    s = r.select("id", F.explode(F.zip_with(F.slice("p", 1, F.size("q")), "q", lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))).alias("s")).select("id", "s.*")
    return linear.clipped(s, 250.0).groupBy("tx", "ty").agg(F.count("*").alias("pieces"), F.round(F.sum("length_m"), 2).alias("metres"))


J22 = f"""WITH {_RINGS}, s AS (SELECT id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM ring WINDOW w AS (PARTITION BY id ORDER BY n)),
cuts AS (SELECT row_number() OVER () AS r, ax, ay, bx, by_ FROM s WHERE bx IS NOT NULL AND (ax <> bx OR ay <> by_)),
spots AS (SELECT r, 0::DOUBLE AS f FROM cuts UNION SELECT r, 1 FROM cuts
  UNION SELECT r, (k * 250 - ax) / (bx - ax) FROM (SELECT *, unnest(range(CAST(floor(least(ax, bx) / 250) AS BIGINT) + 1, CAST(ceil(greatest(ax, bx) / 250) AS BIGINT))) AS k FROM cuts WHERE ax <> bx)
  UNION SELECT r, (k * 250 - ay) / (by_ - ay) FROM (SELECT *, unnest(range(CAST(floor(least(ay, by_) / 250) AS BIGINT) + 1, CAST(ceil(greatest(ay, by_) / 250) AS BIGINT))) AS k FROM cuts WHERE ay <> by_)),
part AS (SELECT r, f, lead(f) OVER (PARTITION BY r ORDER BY f) AS g FROM spots),
mid AS (SELECT ax + (bx - ax) * (f + g) / 2 AS x, ay + (by_ - ay) * (f + g) / 2 AS y, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) * (g - f) AS m FROM part JOIN cuts USING (r) WHERE sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) * (g - f) > 1e-8)
SELECT CAST(floor(x / 250) AS BIGINT) AS tx, CAST(floor(y / 250) AS BIGINT) AS ty, count(*) AS pieces, round(sum(m), 2) AS metres FROM mid GROUP BY ALL"""

QUERIES = {"S03_area_rings": s03_area_rings, "G32_look_ahead": g32_look_ahead, "W10_speed_profile": w10_speed_profile, "J22_tile_pieces": j22_tile_pieces}
SQL = {"S03_area_rings": S03, "G32_look_ahead": G32, "W10_speed_profile": W10, "J22_tile_pieces": J22}

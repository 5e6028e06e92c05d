"""Queries over places: grids, nearest segments, votes, names and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, sky, tags, text
from waymark.operators import search, spatial
from waymark.session import Scratch

from . import tables as t
from .scalars import F01


def a01_grid_density(spark: SparkSession, d: str) -> DataFrame:
    """Parts per cell of 2 km, with the cell's centre and its light weight."""
    return spatial.density(t.pois(spark, d)).select("x", "y", "count", F.round(sky.density_weight(F.col("count")), 6).alias("weight"))


A01 = f"WITH {t.POIS} SELECT (floor(x / 2000) + 0.5) * 2000 AS x, (floor(y / 2000) + 0.5) * 2000 AS y, count(*) AS count, round(log2(1 + count(*)), 6) AS weight FROM pois GROUP BY ALL"


def j18_stencil(spark: SparkSession, d: str) -> DataFrame:
    """Density with 0.35 of the neighbouring cells' (J18)."""
    return spatial.stencil(spatial.density(t.pois(spark, d))).select("cx", "cy", F.round("near", 4).alias("near"))


J18 = f"""WITH {t.POIS}, c AS (SELECT CAST(floor(x / 2000) AS BIGINT) AS cx, CAST(floor(y / 2000) AS BIGINT) AS cy, count(*) AS n FROM pois GROUP BY ALL)
SELECT a.cx, a.cy, round(sum(CASE WHEN a.cx = b.cx AND a.cy = b.cy THEN b.n ELSE b.n * 0.35::DOUBLE END), 4) AS near FROM c a JOIN c b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY ALL"""


def a02_categories(spark: SparkSession, d: str) -> DataFrame:
    """Parts by category or bucket of what is left out."""
    g = F.col("tags")
    p = t.pois(spark, d).where(tags.is_poi(g)).select(tags.poi_category(g).alias("c"), tags.excluded_bucket(g).alias("b"))
    taken = p.where("c IS NOT NULL").select(F.lit("included").alias("kind"), F.col("c").alias("name"))
    left = p.where("c IS NULL").select(F.lit("excluded").alias("kind"), F.col("b").alias("name"))
    return taken.unionByName(left).groupBy("kind", "name").agg(F.count("*").alias("n"))


A02 = f"""WITH r AS ({F01}) SELECT CASE WHEN category IS NULL THEN 'excluded' ELSE 'included' END AS kind, coalesce(category, bucket) AS name, count(*) AS n FROM r WHERE poi GROUP BY ALL"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Short stretches of road from the parts: edge, ends, half width, speed and whether it was told."""
    p = t.table(spark, d, "part").select(F.col("p_partkey").alias("edge"), F.expr(t.POI_X).cast("double").alias("ax"), F.expr(t.POI_Y).cast("double").alias("ay"), "p_size")
    return p.select(
        "edge", "ax", "ay", (F.col("ax") + F.col("p_size") * 6 - 100).alias("bx"), (F.col("ay") + (F.col("edge") % 41) * 7 - 140).alias("by"),
        (F.col("p_size") % 5 + 40.0).alias("half_width"), (F.col("p_size") + 30.0).alias("kmh"), (F.col("edge") % 3 != 0).alias("explicit"),
    )


_SEGMENTS = f"""{t.CUSTOMERS}, s0 AS (SELECT p_partkey AS edge, CAST({t.POI_X} AS DOUBLE) AS ax, CAST({t.POI_Y} AS DOUBLE) AS ay, p_size FROM part),
  seg AS (SELECT edge, ax, ay, ax + p_size * 6 - 100 AS bx, ay + (edge % 41) * 7 - 140 AS by_, p_size % 5 + 40.0 AS half_width, p_size + 30.0::DOUBLE AS kmh, edge % 3 <> 0 AS explicit FROM s0),
  pair AS (SELECT c.id, c.x, c.y, s.*, CASE WHEN (bx - ax) ** 2 + (by_ - ay) ** 2 > 0 THEN greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) ELSE 0 END AS f
    FROM customers c JOIN seg s ON c.x BETWEEN least(ax, bx) - 260 AND greatest(ax, bx) + 260 AND c.y BETWEEN least(ay, by_) - 260 AND greatest(ay, by_) + 260),
  near AS (SELECT *, sqrt((x - (ax + (bx - ax) * f)) ** 2 + (y - (ay + (by_ - ay) * f)) ** 2) AS m FROM pair)"""


def j06_nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    """The road stretch nearest to each customer within 250 m."""
    n = spatial.nearest_segment(t.customers(spark, d), _segments(spark, d))
    return n.select("id", "edge", F.round("distance_m", 4).alias("distance_m"), F.round("fraction", 6).alias("fraction"), F.round("px", 3).alias("px"), F.round("py", 3).alias("py"))


J06 = f"""WITH {_SEGMENTS} SELECT id, edge, round(m, 4) AS distance_m, round(f, 6) AS fraction, round(ax + (bx - ax) * f, 3) AS px, round(ay + (by_ - ay) * f, 3) AS py FROM near WHERE m <= 250
QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, edge) = 1"""


def j07_speed_limit(spark: SparkSession, d: str) -> DataFrame:
    """The limit where each customer is, from stretches in the own cell within 60 m."""
    return spatial.speed_limit_at(t.customers(spark, d), _segments(spark, d), max_m=60.0)


J07 = f"""WITH {_SEGMENTS} SELECT id, edge, CASE WHEN explicit THEN kmh END AS kmh FROM near WHERE m <= 60
  AND floor(x / 128) BETWEEN floor(least(ax, bx) / 128) AND floor(greatest(ax, bx) / 128) AND floor(y / 128) BETWEEN floor(least(ay, by_) / 128) AND floor(greatest(ay, by_) / 128)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, edge DESC) = 1"""


def j08_on_road(spark: SparkSession, d: str) -> DataFrame:
    """Customers on a road."""
    return spatial.on_road(t.customers(spark, d), _segments(spark, d)).select("id", "c_name")


J08 = f"WITH {_SEGMENTS} SELECT DISTINCT id, c_name FROM near JOIN customer ON c_custkey = id WHERE m <= half_width"


def _samples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = t.customers(spark, d).withColumn("grp", F.col("c_nationkey") % 2).withColumn("value", F.format_string("%05d", (F.col("x") / 3000).cast("int") + 10000))
    return c.where("id % 3 = 0").select("id", "x", "y", "grp"), c.where("id % 3 <> 0").select(F.col("x").alias("sx"), F.col("y").alias("sy"), "grp", "value")


def j10_neighbour_vote(spark: SparkSession, d: str) -> DataFrame:
    """Postcode-like values of customers from their nearest neighbours of the same group, if they agree."""
    points, samples = _samples(spark, d)
    return spatial.neighbour_vote(points, samples, reach_m=1200.0, size=600.0)


J10 = f"""WITH {t.CUSTOMERS}, c AS (SELECT id, x, y, c_nationkey % 2 AS grp, printf('%05d', CAST(trunc(x / 3000) AS INTEGER) + 10000) AS value FROM customers),
n AS (SELECT p.id, s.value, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - s.x) ** 2 + (p.y - s.y) ** 2, s.value) AS k FROM c p JOIN c s ON p.grp = s.grp AND p.id % 3 = 0 AND s.id % 3 <> 0
  AND s.x BETWEEN p.x - 1200 AND p.x + 1200 AND (p.x - s.x) ** 2 + (p.y - s.y) ** 2 <= 1440000)
SELECT id, min(value) AS value FROM n WHERE k <= 5 GROUP BY id HAVING count(*) >= 2 AND min(value) = max(value)"""


def j09_unique_value(spark: SparkSession, d: str) -> DataFrame:
    """Customers' segment where their nation and balance band have one only."""
    c = t.customers(spark, d).withColumn("band", F.floor(F.col("c_acctbal") / 100).cast("long"))
    one = spatial.unique_by_key(c, ["c_nationkey", "band"], "c_mktsegment").withColumnRenamed("c_mktsegment", "inferred")
    return c.join(one, ["c_nationkey", "band"]).select("id", "inferred")


J09 = """WITH c AS (SELECT *, CAST(floor(c_acctbal / 100) AS BIGINT) AS band FROM customer), o AS (SELECT c_nationkey, band, min(c_mktsegment) AS inferred FROM c GROUP BY ALL HAVING count(DISTINCT c_mktsegment) = 1)
SELECT c_custkey AS id, inferred FROM c JOIN o USING (c_nationkey, band)"""

#: The queries of the search: visible prefixes, several words, words of the subtitle, short ones and misses.
ASKED = ("brand", "part 12", "pa", "1", "part 7 b", "standard", "econ", "promo", "xyzzy", "Pàrt  1", "name 3", "", "steel", "o")


def t01_search(spark: SparkSession, d: str) -> DataFrame:
    """Eight best parts for each of some queries."""
    records = t.table(spark, d, "part").select(F.format_string("poi:%d", "p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_partkey").alias("display"), F.concat_ws(" ", "p_brand", "p_type").alias("subtitle"))
    asked = spark.createDataFrame([(q,) for q in ASKED], "query string")
    scratch = Scratch(spark)  # what of the index these queries look up is written once
    indexed = scratch.save(search.index(records), "records")
    posted = scratch.save(search.postings(indexed, search.looked_up(asked)), "postings")
    return search.search(indexed, posted, asked)


_NORMAL = "trim(regexp_replace(lower(strip_accents({})), '[^0-9a-z]+', ' ', 'g'))"
T01 = f"""WITH asked AS (SELECT unnest([{", ".join(f"'{q}'" for q in ASKED)}]) AS query), q AS (SELECT query, {_NORMAL.format("query")} AS q, string_split({_NORMAL.format("query")}, ' ') AS ts FROM asked),
r AS (SELECT 'poi:' || p_partkey AS id, p_name || ' ' || p_partkey AS display, p_name || ' ' || p_partkey || ' ' || p_brand || ' ' || p_type AS whole FROM part),
n AS (SELECT *, {_NORMAL.format("display")} AS shown, {_NORMAL.format("whole")} AS full_text FROM r),
m AS (SELECT query, q, id, display, shown, CASE WHEN q = shown THEN 0 WHEN starts_with(shown, q) THEN 1
  WHEN len(list_filter(ts, lambda a: len(list_filter(string_split(shown, ' '), lambda w: starts_with(w, a))) > 0)) = len(ts) THEN 2 WHEN contains(shown, q) THEN 3
  WHEN len(list_filter(ts, lambda a: len(list_filter(string_split(full_text, ' '), lambda w: starts_with(w, a))) > 0)) = len(ts) THEN 4 WHEN contains(full_text, q) THEN 5 END AS tier FROM q, n WHERE q <> '')
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY tier, greatest(0, len(shown) - len(q)), len(display), id) AS INTEGER) AS rank, id, tier FROM m WHERE tier IS NOT NULL QUALIFY rank <= 8"""


def x11_postings(spark: SparkSession, d: str) -> DataFrame:
    """Length of each trigram's posting list, and how many of its records show it."""
    records = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display"), F.col("c_mktsegment").alias("subtitle"))
    p = search.postings(search.index(records)).where(F.length("g") == 3)
    return p.groupBy("g").agg(F.count("*").alias("records"), F.count_if("visible").alias("visible"))


X11 = """WITH n AS (SELECT c_custkey AS id, trim(regexp_replace(lower(c_name), '[^0-9a-z]+', ' ', 'g')) AS shown, trim(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^0-9a-z]+', ' ', 'g')) AS full_text FROM customer),
g AS (SELECT DISTINCT id, substr(w, CAST(i AS BIGINT), 3) AS g, false AS v FROM (SELECT id, unnest(string_split(full_text, ' ')) AS w FROM n), range(1, 40) r(i) WHERE i <= len(w) - 2),
s AS (SELECT DISTINCT id, substr(w, CAST(i AS BIGINT), 3) AS g FROM (SELECT id, unnest(string_split(shown, ' ')) AS w FROM n), range(1, 40) r(i) WHERE i <= len(w) - 2)
SELECT g.g, count(*) AS records, count(s.id) AS visible FROM g LEFT JOIN s ON g.id = s.id AND g.g = s.g GROUP BY ALL"""


def _rings(spark: SparkSession, d: str) -> DataFrame:
    """A ring of each order from its lines: x by part, y by supplier."""
    p = F.struct("n", (F.col("part") % 1009).cast("double").alias("x"), (F.col("supp") % 503 * 7).cast("double").alias("y"))
    lines = t.lines(spark, d).groupBy("id").agg(F.sort_array(F.collect_list(p)).alias("p"))
    return lines.select("id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring"))


_RINGS = f"{t.LINES}, ring AS (SELECT id, n, CAST(part % 1009 AS DOUBLE) AS x, CAST(supp % 503 * 7 AS DOUBLE) AS y FROM lines)"


def a10_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area, with a hole of a tenth, point mean and area centroid of rings."""
    r = _rings(spark, d)
    hole = F.array(F.transform("ring", lambda q: F.struct((q["x"] / 10).alias("x"), q["y"].alias("y"))))
    return r.select(
        "id", F.round(geo.ring_area(F.col("ring")), 3).alias("outer_m2"), F.round(geo.polygon_area(F.col("ring"), hole), 3).alias("area_m2"),
        F.round(geo.points_mean(F.col("ring"), "x"), 5).alias("mean_x"), F.round(F.when(geo.ring_area(F.col("ring")) > 1, geo.ring_centroid(F.col("ring"), "x")), 3).alias("centre_x"),
    )


A10 = f"""WITH {_RINGS}, e AS (SELECT id, n, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM ring WINDOW w AS (PARTITION BY id ORDER BY n)),
s AS (SELECT id, count(*) AS k, sum(x * y2 - x2 * y) AS c, sum((x + x2) * (x * y2 - x2 * y)) AS m, avg(x) AS mean_x FROM e GROUP BY id), a AS (SELECT *, CASE WHEN k >= 3 THEN abs(c) / 2 ELSE 0 END AS area FROM s)
SELECT id, round(area, 3) AS outer_m2, round(area - area / 10, 3) AS area_m2, round(mean_x, 5) AS mean_x, round(CASE WHEN area > 1 THEN m / (3 * c) END, 3) AS centre_x FROM a"""


def w02_thinning(spark: SparkSession, d: str) -> DataFrame:
    """Points of each order's line at least 300 apart, ends kept (W02, F10): how many stay and their sum."""
    kept = geo.thinned(F.col("ring"), 300.0)
    return _rings(spark, d).select("id", kept.alias("k")).select("id", F.size("k").cast("long").alias("points"), F.round(geo.points_mean(F.col("k"), "x") * F.size("k"), 3).alias("sum_x"))


W02 = f"""WITH RECURSIVE {_RINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS i, count(*) OVER (PARTITION BY id) AS k FROM ring),
f(id, i, lx, ly, kept, sx) AS (SELECT id, i, x, y, 1, x FROM o WHERE i = 1 UNION ALL
  SELECT o.id, o.i, CASE WHEN t THEN o.x ELSE lx END, CASE WHEN t THEN o.y ELSE ly END, kept + CASE WHEN t THEN 1 ELSE 0 END, sx + CASE WHEN t THEN o.x ELSE 0 END
  FROM (SELECT o.*, f.lx, f.ly, f.kept, f.sx, o.i = o.k OR (o.x - f.lx) ** 2 + (o.y - f.ly) ** 2 >= 90000 AS t FROM f JOIN o ON o.id = f.id AND o.i = f.i + 1) o)
SELECT f.id, CAST(kept AS BIGINT) AS points, round(sx, 3) AS sum_x FROM f JOIN o ON o.id = f.id AND o.i = f.i AND o.i = o.k"""


def f12_windows(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the first city window that holds them."""
    cities = (("north", 0.0, 6000.0, 4000.0), ("centre", 0.0, 0.0, 5000.0), ("east", 6000.0, 0.0, 5000.0))
    inside = None
    for name, x, y, r in cities:
        hit = (F.abs(F.col("x") - x) <= r) & (F.abs(F.col("y") - y) <= r)
        inside = F.when(hit, name) if inside is None else inside.when(hit, name)
    return t.pois(spark, d).select("poi_id", inside.alias("city")).where("city IS NOT NULL")


F12 = f"""WITH {t.POIS} SELECT poi_id, CASE WHEN abs(x) <= 4000 AND abs(y - 6000) <= 4000 THEN 'north' WHEN abs(x) <= 5000 AND abs(y) <= 5000 THEN 'centre' WHEN abs(x - 6000) <= 5000 AND abs(y) <= 5000 THEN 'east' END AS city
FROM pois WHERE city IS NOT NULL"""


def f13_box_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the road stretches that touch one of a few windows, each pair."""
    w = spark.createDataFrame([(1, -9500.0, -8000.0, -4000.0, 0.0), (2, -500.0, -500.0, 4000.0, 4000.0)], "win int, wx1 double, wy1 double, wx2 double, wy2 double")
    s = _segments(spark, d).select("edge", F.least("ax", "bx").alias("x1"), F.least("ay", "by").alias("y1"), F.greatest("ax", "bx").alias("x2"), F.greatest("ay", "by").alias("y2"))
    return spatial.overlapping_boxes(s, w, 1000.0).select("edge", "win")


F13 = f"""WITH {_SEGMENTS} SELECT edge, win FROM seg, (VALUES (1, -9500, -8000, -4000, 0), (2, -500, -500, 4000, 4000)) w(win, x1, y1, x2, y2)
WHERE least(ax, bx) <= x2 AND greatest(ax, bx) >= x1 AND least(ay, by_) <= y2 AND greatest(ay, by_) >= y1"""


def k05_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Rows and content digest of each tile of 4 km, as a tiled sink would hold them."""
    p = t.pois(spark, d).withColumn("tx", geo.cell(F.col("x"), 4000.0)).withColumn("ty", geo.cell(F.col("y"), 4000.0))
    lines = F.sort_array(F.collect_list(F.format_string("%08d", "poi_id")))
    return p.groupBy("tx", "ty").agg(F.count("*").alias("rows"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


K05 = f"""WITH {t.POIS} SELECT CAST(floor(x / 4000) AS BIGINT) AS tx, CAST(floor(y / 4000) AS BIGINT) AS ty, count(*) AS rows,
  sha256(string_agg(printf('%08d', poi_id), chr(10) ORDER BY poi_id)) AS sha256 FROM pois GROUP BY ALL"""


def a05_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds and centre of all parts."""
    b = t.pois(spark, d).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    return b.select("*", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))


A05 = f"WITH {t.POIS} SELECT min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, (min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y FROM pois"


def u04_joined_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a name, each once in order."""
    return t.table(spark, d, "part").select("p_partkey", search.distinct_join(F.col("p_brand"), F.lit(" "), F.col("p_type"), F.concat(F.lit(" "), F.col("p_brand"))).alias("name"))


def t09_light_points(spark: SparkSession, d: str) -> DataFrame:
    """Glow points of all cells of 450 m: round-robin layers by density, in the order of a stable hash, at most 60,000."""
    return spatial.light_points(t.pois(spark, d))


T09_POINTS = f"""WITH {t.POIS}, k AS (SELECT DISTINCT CAST(floor(x / 450) AS BIGINT) AS lx, CAST(floor(y / 450) AS BIGINT) AS ly FROM pois),
c AS (SELECT CAST(floor(x / 2000) AS BIGINT) AS cx, CAST(floor(y / 2000) AS BIGINT) AS cy, count(*) AS n FROM pois GROUP BY ALL),
a AS (SELECT lx, ly, i, j, CAST(floor((lx + 0.5) * 450 / 2000) AS BIGINT) + i AS cx, CAST(floor((ly + 0.5) * 450 / 2000) AS BIGINT) + j AS cy FROM k, range(-1, 2) r(i), range(-1, 2) q(j)),
m AS (SELECT lx || ':' || ly AS key, round(sum(coalesce(n, 0) * CASE WHEN i = 0 AND j = 0 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END ORDER BY j, i)) AS near FROM a LEFT JOIN c USING (cx, cy) GROUP BY lx, ly),
l AS (SELECT key, unnest(range(CASE WHEN near <= 0 THEN 1 ELSE greatest(1, least(4, 1 + CAST(floor(log2(1 + near) / 2.5) AS BIGINT))) END)) AS layer FROM m)
SELECT key, layer, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda v, c: (xor(v, c) * 16777619) & 2147483647) AS hash FROM l ORDER BY layer, hash, key LIMIT 60000"""

QUERIES = {
    "T09_light_points": t09_light_points, "A01_grid_density": a01_grid_density, "J18_stencil": j18_stencil, "A02_categories": a02_categories, "J06_nearest_segment": j06_nearest_segment, "J07_speed_limit": j07_speed_limit,
    "J08_on_road": j08_on_road, "J10_neighbour_vote": j10_neighbour_vote, "J09_unique_value": j09_unique_value, "T01_search": t01_search, "X11_postings": x11_postings, "A10_areas": a10_areas,
    "W02_thinning": w02_thinning, "F12_windows": f12_windows, "F13_box_overlap": f13_box_overlap, "K05_tiles": k05_tiles, "A05_bounds": a05_bounds, "U04_joined_parts": u04_joined_parts,
}
SQL = {
    "T09_light_points": T09_POINTS, "A01_grid_density": A01, "J18_stencil": J18, "A02_categories": A02, "J06_nearest_segment": J06, "J07_speed_limit": J07, "J08_on_road": J08, "J10_neighbour_vote": J10, "J09_unique_value": J09, "T01_search": T01,
    "X11_postings": X11, "A10_areas": A10, "W02_thinning": W02, "F12_windows": F12, "F13_box_overlap": F13, "K05_tiles": K05, "A05_bounds": A05,
    "U04_joined_parts": "SELECT p_partkey, trim(p_brand) || ' ' || trim(p_type) AS name FROM part",
}

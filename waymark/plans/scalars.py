"""Queries for scalar functions and predicates over tags, places, times and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, sky, tags, text
from waymark.functions.tags import ROAD_SPEEDS
from waymark.operators import spatial

from . import tables as t


def x01_projection(spark: SparkSession, d: str) -> DataFrame:
    """Places of the parts on the plane, and back (analogous coordinates)."""
    n = t.nodes(spark, d).withColumn("x", geo.project_x(F.col("lon"))).withColumn("y", geo.project_y(F.col("lat")))
    r = lambda c, k: F.round(c, k)
    return n.select("node_id", r(F.col("x"), 3).alias("x"), r(F.col("y"), 3).alias("y"), r(geo.unproject_lon(F.col("x")), 6).alias("lon"), r(geo.unproject_lat(F.col("y")), 6).alias("lat"))


X01 = f"""WITH {t.NODES}, p AS (SELECT node_id, 6378137.0 * radians(lon) AS x,
  6378137.0 * ln(tan(pi() / 4 + radians(greatest(-85.05112878, least(85.05112878, lat))) / 2)) AS y FROM nodes)
SELECT node_id, round(x, 3) AS x, round(y, 3) AS y, round(degrees(x / 6378137.0), 6) AS lon,
  round(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 6) AS lat FROM p"""


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Adjacent nodes of each way: way_id, pos, and both places."""
    n = t.nodes(spark, d)
    at = t.way_nodes(spark, d).join(n, "node_id")
    end = at.select("way_id", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("to_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return at.join(end, ["way_id", "pos"])


def x02_distance(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle length of every step of every way (orders as ways)."""
    return _steps(spark, d).select("way_id", "pos", F.round(geo.distance_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 3).alias("length_m"))


STEPS = f"""{t.NODES}, {t.WAY_NODES}, steps AS (SELECT a.way_id, a.pos, a.node_id, b.node_id AS to_id, m.lon, m.lat, n.lon AS lon2, n.lat AS lat2
  FROM way_nodes a JOIN way_nodes b ON a.way_id = b.way_id AND b.pos = a.pos + 1 JOIN nodes m ON m.node_id = a.node_id JOIN nodes n ON n.node_id = b.node_id)"""
LENGTH = (
    "6371008.8 * 2 * asin(least(1.0, sqrt(power(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon)) / 2), 2))))"
)
X02 = f"WITH {STEPS} SELECT way_id, pos, round({LENGTH}, 3) AS length_m FROM steps"


def x03_maxspeed(spark: SparkSession, d: str) -> DataFrame:
    """Speed of each way, and what its tag says where that is no speed (X03, with the class filter F04)."""
    w = t.ways(spark, d).withColumn("highway", F.col("tags")["highway"]).where(tags.road_class(F.col("highway")).isNotNull())
    raw = F.col("tags")["maxspeed"]
    return w.select(
        "way_id", F.round(tags.speed_kmh(raw, F.col("highway")), 4).alias("kmh"), tags.explicit_speed(raw).isNotNull().alias("explicit"), tags.unknown_speed(raw).alias("unknown")
    )


DEFAULTS = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ROAD_SPEEDS.items()) + " END"
SPEED = """(CASE WHEN regexp_full_match(num, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') AND TRY_CAST(num AS DOUBLE) > 0 THEN CAST(num AS DOUBLE) *
  CASE WHEN one LIKE '%mph' THEN 1.609344 WHEN one LIKE '%knots' OR one LIKE '%knot' THEN 1.852 ELSE 1.0 END END)"""
SPEEDS = f"""{t.WAYS}, parsed AS (SELECT *, trim(split_part(replace(lower(trim(maxspeed)), ',', '.'), ';', 1)) AS one FROM ways),
  cut AS (SELECT *, trim(regexp_replace(one, '(mph|knots|knot|km/h|kph)$', '')) AS num FROM parsed),
  speeds AS (SELECT *, {SPEED} AS told, {DEFAULTS} AS usual FROM cut)"""
X03 = f"""WITH {SPEEDS} SELECT way_id, round(coalesce(told, usual), 4) AS kmh, told IS NOT NULL AS explicit,
  CASE WHEN told IS NULL AND trim(maxspeed) <> '' THEN trim(maxspeed) END AS unknown FROM speeds WHERE usual IS NOT NULL"""


def x04_direction_access(spark: SparkSession, d: str) -> DataFrame:
    """One-way sense, access class and reason, routing layer, truth of bridge and drawing grade."""
    w = t.ways(spark, d).withColumn("highway", F.col("tags")["highway"])
    a = tags.access(F.col("highway"), F.col("tags"))
    return w.select(
        "way_id", tags.oneway(F.col("tags")).alias("oneway"), a["class"].alias("access"), a["reason"].alias("reason"), tags.layer(F.col("tags")["layer"]).alias("layer"),
        tags.is_true(F.col("tags")["bridge"]).alias("bridge"), tags.grade(F.col("tags")).alias("grade"),
    )


ONEWAY = "CASE WHEN oneway IN ('yes', '1', 'true') THEN 1 WHEN oneway IN ('-1', 'reverse') THEN -1 WHEN oneway IN ('no', '0', 'false') THEN 0 WHEN junction = 'roundabout' THEN 1 ELSE 0 END"
REASON = """CASE WHEN lower(motorcar) IN ('no') THEN 5 WHEN lower(motor_vehicle) IN ('no') THEN 4 WHEN vehicle IN ('no') THEN 3 WHEN access IN ('no') THEN 2
  WHEN coalesce(motorcar, motor_vehicle) IN ('yes') THEN 0
  WHEN vehicle = 'private' OR access = 'private' THEN 6 WHEN access = 'destination' THEN 7 WHEN access = 'customers' THEN 8
  WHEN highway IN ('cycleway', 'footway', 'path', 'pedestrian', 'bridleway', 'steps') THEN 1 ELSE 0 END"""
ACCESS = f"CASE {REASON} WHEN 0 THEN 0 WHEN 7 THEN 1 WHEN 8 THEN 2 ELSE 3 END"
LAYER = "CASE WHEN layer = 'x' OR layer IS NULL THEN 0 ELSE CAST(greatest(-128, least(127, trunc(CAST(replace(layer, 'x', '0') AS DOUBLE)))) AS INTEGER) END"
X04 = f"""WITH {t.WAYS} SELECT way_id, {ONEWAY} AS oneway, {ACCESS} AS access, {REASON} AS reason, {LAYER} AS layer, coalesce(bridge = 'yes', false) AS bridge,
  CASE WHEN layer IN ('1', '-2') THEN CAST(layer AS INTEGER) WHEN layer = '300' THEN 20 WHEN bridge = 'yes' THEN 1 WHEN tunnel = 'yes' THEN -1 ELSE 0 END AS grade FROM ways"""


def f01_poi_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which parts are points of interest, their runtime category or the bucket of what is left out."""
    p = t.pois(spark, d)
    g = F.col("tags")
    return p.select("poi_id", tags.is_poi(g).alias("poi"), tags.poi_category(g).alias("category"), tags.excluded_bucket(g).alias("bucket"))


F01 = f"""WITH {t.POIS} SELECT poi_id,
  amenity IS NOT NULL OR shop IS NOT NULL OR tourism IS NOT NULL OR railway IS NOT NULL OR "camera:type" IS NOT NULL OR coalesce(highway IN ('bus_stop', 'speed_camera'), false) AS poi,
  CASE WHEN amenity = 'police' THEN 'police' WHEN amenity = 'hospital' THEN 'healthcare' WHEN amenity = 'fuel' THEN 'fuel' WHEN amenity = 'atm' THEN 'money'
    WHEN amenity = 'cafe' THEN 'food' WHEN shop = 'supermarket' THEN 'shopping' WHEN shop = 'car_repair' THEN 'vehicle_service' WHEN tourism = 'hotel' THEN 'lodging'
    WHEN tourism = 'museum' THEN 'attraction' WHEN amenity = 'school' THEN 'education' WHEN railway = 'station' THEN 'transit' WHEN highway = 'speed_camera' THEN 'speed_camera' END AS category,
  coalesce('amenity:' || amenity, 'shop:' || shop, 'tourism:' || tourism, 'railway:' || railway, 'highway:' || highway, CASE WHEN "camera:type" IS NOT NULL THEN 'camera:*' END, 'other') AS bucket
FROM pois"""


def f03_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area candidates, complete addresses, land cover and its least box."""
    g = F.col("tags")
    cover = tags.land_cover(g)
    least = F.create_map(*[F.lit(x) for pair in tags.MIN_BBOX_AREA.items() for x in pair])
    return t.pois(spark, d).select("poi_id", tags.is_area(g).alias("area"), tags.has_address(g).alias("address"), cover.alias("cover"), least[cover].alias("least_m2"))


COVER = """CASE WHEN boundary = 'administrative' AND admin_level = '2' THEN NULL WHEN "natural" = 'water' OR landuse = 'basin' THEN 1 WHEN "natural" = 'wood' OR landuse = 'forest' THEN 2
  WHEN landuse = 'meadow' THEN 3 WHEN landuse = 'retail' THEN 4 END"""
F03 = f"""WITH {t.POIS} SELECT poi_id,
  coalesce(building, amenity, shop, tourism, railway, "camera:type") IS NOT NULL OR coalesce(highway IN ('bus_stop', 'speed_camera'), false) OR coalesce(admin_level = '2', false)
    OR coalesce("natural" IN ('water', 'wood'), false) OR landuse IS NOT NULL AS area,
  coalesce(trim("addr:housenumber") <> '', false) AND (coalesce(trim("addr:street") <> '', false) OR coalesce(trim("addr:place") <> '', false)) AS address,
  {COVER} AS cover, CASE {COVER} WHEN 1 THEN 500000.0 WHEN 4 THEN 1000000.0 WHEN 2 THEN 4000000.0 WHEN 3 THEN 4000000.0 END AS least_m2 FROM pois"""


def x13_heights(spark: SparkSession, d: str) -> DataFrame:
    """Building heights from tags (X13), and which levels of detail show a building of that footprint."""
    area = F.col("x") * F.col("x") / 40_000
    p = t.pois(spark, d).where(F.col("tags")["building"].isNotNull())
    lods = F.expr("explode(array(struct(0 AS lod, 3500D AS least), struct(1 AS lod, 1200D AS least), struct(2 AS lod, 300D AS least), struct(3 AS lod, 0D AS least)))")
    p = p.select("poi_id", tags.building_height(F.col("tags")).alias("height_m"), area.alias("area"), lods.alias("l"))
    return p.where(F.col("area") >= F.col("l.least")).groupBy("poi_id", "height_m").agg(F.min("l.lod").alias("first_lod"), F.count("*").alias("lods"))


X13 = f"""WITH {t.POIS}, b AS (SELECT *, CASE WHEN height IS NULL THEN 0 WHEN height = '12,5 m' THEN 12.5 WHEN height = 'about 7' THEN 7 WHEN height = '500' THEN 500 ELSE 0 END AS told,
  coalesce(CAST("building:levels" AS DOUBLE), 0) AS floors, x * x / 40000 AS area FROM pois WHERE building IS NOT NULL),
h AS (SELECT poi_id, CAST(CASE WHEN told > 0 THEN greatest(2.5, least(120, told)) WHEN floors > 0 THEN greatest(2.5, least(120, floors * 3)) ELSE 9 END AS DOUBLE) AS height_m, area FROM b)
SELECT poi_id, height_m, min(lod) AS first_lod, count(*) AS lods FROM h JOIN (VALUES (0, 3500), (1, 1200), (2, 300), (3, 0)) l(lod, least) ON area >= least GROUP BY ALL"""


def p02_merged_tags(spark: SparkSession, d: str) -> DataFrame:
    """Own columns merged over an escaped tag string, which is parsed first (P01, P02, X14): parts."""
    c = t.table(spark, d, "part")
    esc = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    quoted = F.concat(F.col("p_name"), F.lit(' "\\'), F.col("p_type"))
    other = F.concat(F.lit('"name"=>"'), esc(quoted), F.lit('","brand"=>"none","kind"=>"a"'))
    merged = tags.merge_promoted(tags.parse_hstore(other), {"brand": F.col("p_brand"), "kind": F.lit("")})
    both = tags.subset(merged, ("name", "brand", "kind"))
    return c.select("p_partkey", both["name"].alias("name"), both["brand"].alias("brand"), both["kind"].alias("kind"))


P02 = """SELECT p_partkey, p_name || ' "\\' || p_type AS name, p_brand AS brand, 'a' AS kind FROM part"""


def x10_normal_form(spark: SparkSession, d: str) -> DataFrame:
    """Search form and number of trigrams of names with accents put in."""
    name = F.concat(F.translate("p_name", "aeo", "åéÖ"), F.lit(" / "), F.col("p_type"))
    n = text.normal_form(name)
    return t.table(spark, d, "part").select("p_partkey", n.alias("normal"), F.size(text.trigrams(n)).cast("long").alias("trigrams"))


X10 = """WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^0-9a-z]+', ' ', 'g')) AS normal FROM part),
w AS (SELECT p_partkey, unnest(string_split(normal, ' ')) AS word FROM n),
g AS (SELECT DISTINCT p_partkey, substr(word, i, 3) AS g FROM w, unnest(range(1, 30)) r(i) WHERE i <= len(word) - 2)
SELECT n.p_partkey, normal, count(g.g) AS trigrams FROM n LEFT JOIN g USING (p_partkey) GROUP BY ALL"""


def x26_sun(spark: SparkSession, d: str) -> DataFrame:
    """Sun over places of the events at their times."""
    e = t.observations(spark, d).withColumn("lat", (F.col("unit") % 17) * 11.0 - 88.0).withColumn("lon", (F.col("event_id") % 37) * 10.0 - 180.0)
    s = sky.sun(F.col("ts"), F.col("lat"), F.col("lon"), F.lit(1.0))
    num = [F.round(s[k], 5).alias(k) for k in ("elevation_deg", "azimuth_deg", "daylight_minutes", "sunrise_minutes", "sunset_minutes")]
    return e.select("event_id", *num, s["polar_day"].alias("polar_day"), s["polar_night"].alias("polar_night"), F.round(sky.night_intensity(s["elevation_deg"]), 5).alias("night"))


X26 = f"""WITH {t.OBSERVATIONS}, a AS (SELECT *, (unit % 17) * 11.0::DOUBLE - 88 AS lat, (event_id % 37) * 10.0::DOUBLE - 180 AS lon,
  hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE AS h FROM obs),
b AS (SELECT *, 2 * pi() / dayofyear(make_date(year(ts), 12, 31)) * ((dayofyear(ts) - 1) + (h - 12) / 24) AS g FROM a),
c AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
  0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec, radians(lat) AS phi FROM b),
e AS (SELECT *, h * 60 + eq + 4 * lon - 60 AS m, cos(radians(90.833)) / (cos(phi) * cos(dec)) - tan(phi) * tan(dec) AS lim FROM c),
f AS (SELECT *, radians((m - 1440 * floor(m / 1440)) / 4 - 180) AS ha, CASE WHEN lim BETWEEN -1 AND 1 THEN degrees(acos(lim)) END AS half, 720 - 4 * lon - eq + 60 AS noon FROM e),
k AS (SELECT *, 90 - degrees(acos(greatest(-1, least(1, sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(ha))))) AS el,
  degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(dec) * cos(phi))) + 180 AS az FROM f)
SELECT event_id, round(el, 5) AS elevation_deg, round(az - 360 * floor(az / 360), 5) AS azimuth_deg,
  round(CASE WHEN lim < -1 THEN 1440 WHEN lim > 1 THEN 0 ELSE 8 * half END, 5) AS daylight_minutes,
  round(coalesce(noon - 4 * half - 1440 * floor((noon - 4 * half) / 1440), -1), 5) AS sunrise_minutes,
  round(coalesce(noon + 4 * half - 1440 * floor((noon + 4 * half) / 1440), -1), 5) AS sunset_minutes,
  lim < -1 AS polar_day, lim > 1 AS polar_night, round(greatest(0, least(1, (0.5 - el) / 6.5)), 5) AS night FROM k"""


def x27_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Weekday, daypart, days of the month and whether a window from 22:00 on Fridays and Saturdays to 04:00 is on."""
    ts = F.col("ts")
    on = sky.schedule_active(ts, (5, 6), 22 * 60, 4 * 60)
    clock = sky.clock_at(F.lit(100.0), F.col("t") - 1704067200, F.lit(60.0), F.col("kind") == "error")
    return t.observations(spark, d).select(
        "event_id", sky.weekday(ts).alias("weekday"), sky.daypart(ts).alias("daypart"), sky.days_in_month(ts).alias("days"), on.alias("active"), F.round(clock, 3).alias("clock_s")
    )


X27 = f"""WITH {t.OBSERVATIONS} SELECT event_id, isodow(ts) AS weekday,
  CASE WHEN hour(ts) BETWEEN 5 AND 9 THEN 'morning' WHEN hour(ts) BETWEEN 10 AND 17 THEN 'day' WHEN hour(ts) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS daypart,
  day(last_day(ts)) AS days, (isodow(ts) IN (5, 6) AND hour(ts) >= 22) OR (isodow(ts) IN (6, 7) AND hour(ts) < 4) AS active,
  round(100 + CASE WHEN kind = 'error' THEN 0 ELSE (t - 1704067200) * 60 END, 3) AS clock_s FROM obs"""


def f15_visibility(spark: SparkSession, d: str) -> DataFrame:
    """Which customers a supplier of their nation sees: range, field of view and a clear line (F15, F16 on a speed)."""
    s = t.suppliers(spark, d).select(F.col("id").alias("unit"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("s_nationkey").alias("nation"))
    c = t.customers(spark, d).select("id", "x", "y", F.col("c_nationkey").alias("nation"))
    j = spatial.within_reach(c, s, 1200.5, ["nation"])
    seen = geo.can_observe(F.col("rx"), F.col("ry"), F.radians(F.col("unit") % 360), F.col("x"), F.col("y"), F.col("id") % 7 != 0, reach=1200.0)
    return j.where(seen).select("unit", "id", F.round(F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")), 3).alias("distance_m"))


F15 = f"""WITH {t.CUSTOMERS}, {t.SUPPLIERS}, j AS (SELECT s.id AS unit, c.id, c.x - s.x AS dx, c.y - s.y AS dy, radians(s.id % 360) AS a FROM customers c JOIN suppliers s ON c_nationkey = s_nationkey WHERE c.id % 7 <> 0)
SELECT unit, id, round(sqrt(dx * dx + dy * dy), 3) AS distance_m FROM j WHERE sqrt(dx * dx + dy * dy) <= 1200 AND
  (dx = 0 AND dy = 0 OR degrees(acos(greatest(-1, least(1, (cos(a) * dx + sin(a) * dy) / sqrt(dx * dx + dy * dy))))) <= 70)"""


def f16_speeding(spark: SparkSession, d: str) -> DataFrame:
    """Clear speeding: observed km/h over the limit of the unit's road by more than 3 (F16)."""
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in (30, 50, 70, 0, 110)]), (F.col("unit") % 5 + 1).cast("int"))
    o = t.observations(spark, d).withColumn("limit", limit).withColumn("kmh", F.greatest(F.lit(0.0), F.col("value") * 3.6))
    return o.where((F.col("limit") > 0) & (F.col("kmh") - F.col("limit") > 3.0)).select("event_id", "unit", F.round("kmh", 4).alias("kmh"), F.round(F.col("kmh") - F.col("limit"), 4).alias("excess"))


F16 = f"""WITH {t.OBSERVATIONS}, l AS (SELECT *, CAST([30, 50, 70, 0, 110][unit % 5 + 1] AS DOUBLE) AS lim, greatest(0, value * 3.6) AS kmh FROM obs)
SELECT event_id, unit, round(kmh, 4) AS kmh, round(kmh - lim, 4) AS excess FROM l WHERE lim > 0 AND kmh - lim > 3"""

QUERIES = {
    "X01_projection": x01_projection, "X02_distance": x02_distance, "X03_maxspeed": x03_maxspeed, "X04_direction_access": x04_direction_access, "F01_poi_rules": f01_poi_rules,
    "F03_areas": f03_areas, "X13_heights": x13_heights, "P02_merged_tags": p02_merged_tags, "X10_normal_form": x10_normal_form, "X26_sun": x26_sun, "X27_calendar": x27_calendar,
    "F15_visibility": f15_visibility, "F16_speeding": f16_speeding,
}
SQL = {
    "X01_projection": X01, "X02_distance": X02, "X03_maxspeed": X03, "X04_direction_access": X04, "F01_poi_rules": F01, "F03_areas": F03, "X13_heights": X13, "P02_merged_tags": P02,
    "X10_normal_form": X10, "X26_sun": X26, "X27_calendar": X27, "F15_visibility": F15, "F16_speeding": F16,
}

"""Queries over junctions, signals, observations and dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import junctions, sightings, spatial

from . import tables as t

# Junctions: every four suppliers share one at the origin; each gives an approach and an exit.
_ANGLE_A, _ANGLE_E = "radians((s_suppkey * 67) % 360)", "radians((s_suppkey * 101 + 45) % 360)"


def _approaches(spark: SparkSession, d: str) -> DataFrame:
    a = F.radians(((F.col("s_suppkey") * 67) % 360).cast("double"))
    return t.table(spark, d, "supplier").select(
        F.floor(F.col("s_suppkey") / 4).cast("long").alias("junction"), F.format_string("a%06d", "s_suppkey").alias("approach"), (10 * F.cos(a)).alias("ax"), (10 * F.sin(a)).alias("ay"),
        F.lit(0.0).alias("jx"), F.lit(0.0).alias("jy"), (F.col("s_suppkey") % 9 != 0).alias("known"),
    )


def _exits(spark: SparkSession, d: str) -> DataFrame:
    a = F.radians(((F.col("s_suppkey") * 101 + 45) % 360).cast("double"))
    return t.table(spark, d, "supplier").select(
        F.floor(F.col("s_suppkey") / 4).cast("long").alias("junction"), F.format_string("e%06d", "s_suppkey").alias("exit"), (10 * F.cos(a)).alias("ex"), (10 * F.sin(a)).alias("ey")
    )


def _moves(spark: SparkSession, d: str) -> DataFrame:
    return junctions.movements(_approaches(spark, d), _exits(spark, d))


_MOVES = f"""ap AS (SELECT s_suppkey // 4 AS junction, printf('a%06d', s_suppkey) AS approach, 10 * cos({_ANGLE_A}) AS ax, 10 * sin({_ANGLE_A}) AS ay, s_suppkey % 9 <> 0 AS known FROM supplier),
  ex AS (SELECT s_suppkey // 4 AS junction, printf('e%06d', s_suppkey) AS exit, 10 * cos({_ANGLE_E}) AS ex, 10 * sin({_ANGLE_E}) AS ey FROM supplier),
  mv AS (SELECT junction, approach || '->' || exit AS movement, approach, exit, known AS resolved, ax, ay, ex, ey, ax * 0.4 AS sx, ay * 0.4 AS sy FROM ap JOIN ex USING (junction) WHERE (ax * ex + ay * ey) / 100 < 0.985)"""
_CLASH = f"""{_MOVES}, pr AS (SELECT l.junction, l.movement AS a, r.movement AS b, NOT (l.resolved AND r.resolved) AS unknown, l.approach = r.approach OR l.exit = r.exit AS same,
    l.ax * r.ax + l.ay * r.ay <= -98.5 AND l.ax * l.ex + l.ay * l.ey <= -98.5 AND r.ax * r.ex + r.ay * r.ey <= -98.5 AS straight,
    (l.ex - l.sx) * (r.sy - l.sy) - (l.ey - l.sy) * (r.sx - l.sx) AS o1, (l.ex - l.sx) * (r.ey - l.sy) - (l.ey - l.sy) * (r.ex - l.sx) AS o2,
    (r.ex - r.sx) * (l.sy - r.sy) - (r.ey - r.sy) * (l.sx - r.sx) AS o3, (r.ex - r.sx) * (l.ey - r.sy) - (r.ey - r.sy) * (l.ex - r.sx) AS o4,
    l.sx * l.ey - l.sy * l.ex AS lt, r.sx * r.ey - r.sy * r.ex AS rt FROM mv l JOIN mv r ON l.junction = r.junction AND l.movement < r.movement),
  clash AS (SELECT junction, a, b FROM pr WHERE unknown OR same OR (NOT straight AND (((o1 > 1e-7 AND o2 < -1e-7) OR (o1 < -1e-7 AND o2 > 1e-7)) AND ((o3 > 1e-7 AND o4 < -1e-7) OR (o3 < -1e-7 AND o4 > 1e-7))
    OR (abs(lt) > 1e-6 AND abs(rt) > 1e-6 AND (lt > 0) <> (rt > 0)))))"""


def j12_movements(spark: SparkSession, d: str) -> DataFrame:
    """Movements of each junction, with the stop point of their approach."""
    return _moves(spark, d).select("junction", "movement", "resolved", F.round("stop.x", 5).alias("stop_x"), F.round("stop.y", 5).alias("stop_y"))


def j13_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of movements that may not run together."""
    return junctions.conflicts(_moves(spark, d))


def g13_phases(spark: SparkSession, d: str) -> DataFrame:
    """Conflict-free phases: each phase's movements are disjoint from their conflicts (G13): a greedy choice in order."""
    m = _moves(spark, d)
    return junctions.phases(m, junctions.conflicts(m))


G13 = f"""WITH RECURSIVE {_CLASH}, mo AS (SELECT junction, movement, row_number() OVER (PARTITION BY junction ORDER BY movement) AS i FROM mv WHERE resolved),
both_ AS (SELECT junction, a AS m, b AS x FROM clash UNION ALL SELECT junction, b, a FROM clash),
cl AS (SELECT mo.junction, mo.i, mo.movement, coalesce(list(x) FILTER (x IS NOT NULL), []) AS l FROM mo LEFT JOIN both_ c ON c.junction = mo.junction AND c.m = mo.movement GROUP BY ALL),
f(junction, i, xs) AS (SELECT DISTINCT junction, 0::BIGINT, []::STRUCT(m VARCHAR, p BIGINT)[] FROM mo UNION ALL
  SELECT cl.junction, cl.i, list_append(xs, {{'m': movement, 'p': list_min(list_filter(range(0, len(xs) + 1), lambda q: len(list_filter(xs, lambda x: x.p = q AND list_contains(l, x.m))) = 0))}})
  FROM f JOIN cl ON cl.junction = f.junction AND cl.i = f.i + 1),
g AS (SELECT junction, unnest(arg_max(xs, i)) AS x FROM f GROUP BY junction) SELECT junction, x.m AS movement, x.p AS phase FROM g"""


def g14_signal_state(spark: SparkSession, d: str) -> DataFrame:
    """Phase and stage of a controller with 1 to 4 phases at each event's time."""
    o = t.observations(spark, d).withColumn("n", (F.col("unit") % 4 + 1).cast("int")).withColumn("s", F.floor(F.col("t") - 1704067200).cast("double"))
    return o.withColumn("g", junctions.signal_state(F.col("s"), F.col("n"))).select("event_id", "g.phase", "g.stage")


G14 = f"""WITH {t.OBSERVATIONS}, s AS (SELECT event_id, unit % 4 + 1 AS n, CAST(floor(t - 1704067200) AS BIGINT) AS s FROM obs), c AS (SELECT event_id, s % (17 * n) AS c FROM s)
SELECT event_id, CAST(c // 17 AS INTEGER) AS phase, CASE WHEN c % 17 < 1 THEN 'all_red' WHEN c % 17 < 2 THEN 'red_yellow' WHEN c % 17 < 14 THEN 'green' ELSE 'yellow' END AS stage FROM c"""


def u06_distinct_approaches(spark: SparkSession, d: str) -> DataFrame:
    """Approaches without those that point as an earlier one does (U06); eight suppliers share a junction here."""
    a = _approaches(spark, d).withColumn("junction", F.floor(F.col("junction") / 10).cast("long"))
    return junctions.distinct_by_direction(a)


U06 = f"""WITH RECURSIVE {_MOVES}, o AS (SELECT junction // 10 AS junction, approach, ax, ay, row_number() OVER (PARTITION BY junction // 10 ORDER BY approach) AS i FROM ap),
f(junction, i, xs) AS (SELECT junction, 0::BIGINT, []::STRUCT(a VARCHAR, x DOUBLE, y DOUBLE)[] FROM (SELECT DISTINCT junction FROM o)
  UNION ALL SELECT o.junction, o.i, CASE WHEN len(list_filter(xs, lambda p: p.x * ax + p.y * ay >= 98.5)) > 0 THEN xs ELSE list_append(xs, {{'a': approach, 'x': ax, 'y': ay}}) END FROM f JOIN o ON o.junction = f.junction AND o.i = f.i + 1),
l AS (SELECT junction, arg_max(xs, i) AS xs FROM f GROUP BY junction) SELECT junction, unnest(xs).a AS approach FROM l"""


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Roads in chains of 20 nodes with a side road at every 9th: source, target."""
    n = t.nodes(spark, d).select("node_id")
    along = n.where("node_id % 20 <> 19").select(F.col("node_id").alias("source"), (F.col("node_id") + 1).alias("target"))
    side = n.where("node_id % 9 = 0").select(F.col("node_id").alias("source"), (F.col("node_id") + 1_000_000).alias("target"))
    return along.unionByName(side)


def j11_nearest_junction(spark: SparkSession, d: str) -> DataFrame:
    """The branching node nearest to each signal, at most 16 hops away."""
    signals = t.nodes(spark, d).where("node_id % 3 = 0").select(F.col("node_id").alias("signal"))
    return junctions.nearest_junction(signals, _chains(spark, d))


J11 = f"""WITH RECURSIVE {t.NODES}, e AS (SELECT node_id AS s, node_id + 1 AS g FROM nodes WHERE node_id % 20 <> 19 UNION ALL SELECT node_id, node_id + 1000000 FROM nodes WHERE node_id % 9 = 0),
n AS (SELECT DISTINCT s AS node, g AS other FROM e UNION SELECT DISTINCT g, s FROM e), b AS (SELECT node FROM n GROUP BY node HAVING count(*) >= 3),
f(signal, node, hops) AS (SELECT node_id, node_id, 0 FROM nodes WHERE node_id % 3 = 0 UNION SELECT f.signal, n.other, f.hops + 1 FROM f JOIN n USING (node) WHERE f.hops < 16 AND f.node NOT IN (SELECT node FROM b)),
r AS (SELECT signal, node, min(hops) AS hops FROM f WHERE node IN (SELECT node FROM b) GROUP BY ALL)
SELECT signal, arg_min(node, (hops, node)) AS junction, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY signal"""


def j20_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest observation, its age and whether it is stale, for a request per unit every ten hours."""
    o = t.observations(spark, d)
    units = o.select("unit").distinct()
    r = units.select("unit", F.explode(F.sequence(F.lit(0), F.lit(70))).alias("k")).select("unit", (F.col("unit") * 1000 + F.col("k")).alias("request"), (F.lit(1704067200.0) + F.col("k") * 36000).alias("now"))
    return sightings.latest_at(r, o, "unit").select("request", "unit", "event_id", F.round("age_s", 3).alias("age_s"), "stale")


J20 = f"""WITH {t.OBSERVATIONS}, u AS (SELECT DISTINCT unit FROM obs), r AS (SELECT unit, unit * 1000 + k AS request, 1704067200.0::DOUBLE + k * 36000 AS now FROM u, range(71) v(k)),
l AS (SELECT r.*, (SELECT max((t, event_id)) FROM obs o WHERE o.unit = r.unit AND o.t <= r.now) AS m FROM r)
SELECT request, unit, m[2] AS event_id, round(greatest(0, now - m[1]), 3) AS age_s, greatest(0, now - m[1]) > 10 AS stale FROM l"""


def f17_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Observations not older than the latest accepted one of their unit, in an order of arrival that swaps some."""
    o = t.observations(spark, d).withColumn("arrival", F.col("event_id") + (F.col("event_id") % 7) * 40)
    return sightings.accepted(o.withColumn("arrival", F.col("arrival") * 1_000_000 + F.col("event_id")), "unit", "arrival", "t").select("event_id", "unit")


F17 = f"""WITH {t.OBSERVATIONS}, a AS (SELECT *, (event_id + (event_id % 7) * 40) * 1000000 + event_id AS arrival FROM obs),
m AS (SELECT *, max(t) OVER (PARTITION BY unit ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM a) SELECT event_id, unit FROM m WHERE l IS NULL OR t >= l"""


def a22_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling hours: number, mean and largest value."""
    return sightings.tumbling(t.observations(spark, d), "ts", "value").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("avg", 6).alias("avg"), "max")


A22 = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) AS avg, max(value) AS max FROM events GROUP BY date_trunc('hour', ts)"


def a20_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """95th percentile of each kind by nearest rank, both roundings, and the mean and worst."""
    o = t.observations(spark, d)
    ranked = sightings.nearest_rank(o, "value", "kind", {"p95_ceil": (0.95, "ceil"), "p95_round": (0.95, "round")})
    rest = o.groupBy("kind").agg(F.round(F.avg("value"), 6).alias("avg"), F.max("value").alias("worst"))
    return ranked.join(rest, "kind")


A20 = """WITH r AS (SELECT event_type AS kind, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT kind, max(n) AS n, max(value) FILTER (i = CAST(ceil(0.95::DOUBLE * n) AS BIGINT) - 1) AS p95_ceil, max(value) FILTER (i = CAST(round_even(0.95::DOUBLE * (n - 1), 0) AS BIGINT)) AS p95_round,
  round(avg(value), 6) AS avg, max(value) AS worst FROM r GROUP BY kind"""


def w07_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    """Deviation state of each unit: on above 22, off below 13.2."""
    o = t.observations(spark, d)
    return sightings.hysteresis(o, "unit", "event_id", F.col("value"), 22.0, 13.2).select("event_id", "unit", "high")


W07 = f"""WITH {t.OBSERVATIONS}, m AS (SELECT *, CASE WHEN value > 22 THEN true WHEN value < 13.2 THEN false END AS told FROM obs)
SELECT event_id, unit, coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY unit ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS high FROM m"""


def t05_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation as incidents, suppliers as units: greedy by priority, then sequence."""
    c = t.customers(spark, d).select(F.col("c_nationkey").cast("long").alias("zone"), F.col("id").alias("incident"), "x", "y", (F.col("id") % 5).alias("priority"), (F.col("id") % 2).alias("role"), F.col("id").alias("sequence"))
    s = t.suppliers(spark, d).select(F.col("s_nationkey").cast("long").alias("zone"), F.col("id").alias("unit"), (F.col("id") % 2).alias("role"), "x", "y")
    return sightings.greedy_dispatch(c, s).select("zone", "incident", "unit", F.round("distance_m", 4).alias("distance_m"))


T05 = f"""WITH RECURSIVE {t.CUSTOMERS}, {t.SUPPLIERS},
i AS (SELECT c_nationkey::BIGINT AS zone, id % 2 AS role, id AS incident, x, y, row_number() OVER (PARTITION BY c_nationkey, id % 2 ORDER BY id % 5 DESC, id) AS k FROM customers),
u AS (SELECT s_nationkey::BIGINT AS zone, id % 2 AS role, id AS unit, x, y FROM suppliers),
f(zone, role, k, taken, incident, unit, d) AS (SELECT DISTINCT zone, role, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM u UNION ALL
  SELECT zone, role, k, list_append(taken, best.unit), incident, best.unit, best.d FROM (
    SELECT f.zone, f.role, i.k, i.incident, any_value(f.taken) AS taken, min({{'near': round(sqrt((i.x - u.x) ** 2 + (i.y - u.y) ** 2) / 1e-6), 'unit': u.unit, 'd': sqrt((i.x - u.x) ** 2 + (i.y - u.y) ** 2)}}) AS best
    FROM f JOIN i ON i.zone = f.zone AND i.role = f.role AND i.k = f.k + 1 JOIN u ON u.zone = f.zone AND u.role = f.role AND NOT list_contains(f.taken, u.unit) GROUP BY f.zone, f.role, i.k, i.incident))
SELECT i.zone, i.incident, f.unit, round(f.d, 4) AS distance_m FROM i LEFT JOIN f ON f.zone = i.zone AND f.role = i.role AND f.incident = i.incident"""


def g17_offences(spark: SparkSession, d: str) -> DataFrame:
    """State of each unit after every event: patrol, observe, stop attempt, pursuit (G17): a fold per unit."""
    o = t.observations(spark, d).select("event_id", "unit", "t", (F.col("kind") != "view").alias("current"), (F.col("value") > 60).alias("offence"), (F.col("kind") == "signup").alias("complied"))
    return sightings.offence_steps(o, "unit", handoff_s=3600.0)


G17 = f"""WITH RECURSIVE {t.OBSERVATIONS}, o AS (SELECT event_id, unit, t, kind <> 'view' AS cur, value > 60 AS off, kind = 'signup' AS comp, row_number() OVER (PARTITION BY unit ORDER BY t, event_id) AS i FROM obs),
f(unit, i, event_id, state, since) AS (SELECT DISTINCT unit, 0::BIGINT, NULL::BIGINT, 'patrol', 0.0::DOUBLE FROM o UNION ALL
  SELECT unit, i, event_id, CASE WHEN NOT cur THEN CASE s WHEN 'observe' THEN 'patrol' ELSE s END WHEN off THEN 'stop' WHEN s = 'patrol' THEN 'observe' ELSE s END, CASE WHEN cur AND off THEN t ELSE since END
  FROM (SELECT o.*, f.since, CASE WHEN f.state <> 'stop' THEN f.state WHEN comp THEN 'observe' WHEN o.t - f.since >= 3600 THEN 'pursuit' ELSE 'stop' END AS s FROM f JOIN o ON o.unit = f.unit AND o.i = f.i + 1))
SELECT event_id, unit, state FROM f WHERE i > 0"""


def g20_search_area(spark: SparkSession, d: str) -> DataFrame:
    """Radius and nine points of the search around each unit's last place, and the point nearest to an officer."""
    k = 0.70710678
    offsets = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (k, k), (k, -k), (-k, k), (-k, -k)]
    o = t.observations(spark, d).groupBy("unit").agg(F.max_by(F.struct("t", "value", "event_id"), F.struct("t", "event_id")).alias("l"))
    r = sightings.search_radius((F.lit(1706659200.0) - F.col("l.t")) / 600)
    o = o.select("unit", r.alias("radius"), (F.col("l.event_id") % 1000).cast("double").alias("cx"), F.col("l.value").alias("cy"), F.round(sightings.pursuit_horizon(F.col("l.value") / 10), 5).alias("horizon_s"))
    points = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("cx") + F.lit(float(x)) * F.col("radius")).alias("x"), (F.col("cy") + F.lit(float(y)) * F.col("radius")).alias("y")) for i, (x, y) in enumerate(offsets)])
    p = o.select("unit", "radius", "horizon_s", F.explode(points).alias("p"))
    near = F.min(F.when(F.col("p.i") > 0, F.struct(F.round(F.hypot(F.col("p.x") - 500, F.col("p.y") - 50), 6).alias("m"), F.col("p.i").alias("i"))))
    return p.groupBy("unit", "horizon_s").agg(F.round(F.max("radius"), 4).alias("radius_m"), F.count("*").alias("points"), near.alias("n")).select("unit", "horizon_s", "radius_m", "points", F.col("n.i").alias("choice"))


G20 = f"""WITH {t.OBSERVATIONS}, l AS (SELECT unit, max((t, event_id)) AS m FROM obs GROUP BY unit), o AS (SELECT l.unit, greatest(4, least(140, 4 + 4.5 * ((1706659200.0::DOUBLE - t) / 600))) AS r,
  event_id % 1000 AS cx, value AS cy, round(greatest(1.5, least(4, 1.5 + 0.12 * (value / 10))), 5) AS h FROM l JOIN obs ON obs.unit = l.unit AND obs.t = m[1] AND obs.event_id = m[2]),
p AS (SELECT unit, h, r, i, round(sqrt((cx + a * r - 500) ** 2 + (cy + b * r - 50) ** 2), 6) AS d FROM o, (VALUES (0, 0, 0), (1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1),
  (5, 0.70710678, 0.70710678), (6, 0.70710678, -0.70710678), (7, -0.70710678, 0.70710678), (8, -0.70710678, -0.70710678)) v(i, a, b))
SELECT unit, h AS horizon_s, round(max(r), 4) AS radius_m, count(*) AS points, arg_min(i, (d, i)) FILTER (i > 0) AS choice FROM p GROUP BY unit, h"""


def w05_route_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of each order's line without adjacent equals, and the heading to the next."""
    p = t.lines(spark, d).select("id", "n", F.floor(F.col("quantity") / 25).cast("double").alias("x"), (F.col("supp") % 2).cast("double").alias("y"))
    kept = junctions.chain_order(p, "id", "n")
    w = junctions.Window.partitionBy("id").orderBy("n")
    return kept.withColumn("h", F.round(geo.heading(F.col("x"), F.col("y"), F.lead("x").over(w), F.lead("y").over(w)), 6)).select("id", "n", "x", "y", F.col("h").alias("heading"))


W05 = f"""WITH {t.LINES}, p AS (SELECT id, n, floor(quantity / 25) AS x, CAST(supp % 2 AS DOUBLE) AS y FROM lines),
q AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY id ORDER BY n)), k AS (SELECT id, n, x, y FROM q WHERE px IS NULL OR px <> x OR py <> y)
SELECT *, round(atan2(lead(y) OVER w - y, lead(x) OVER w - x), 6) AS heading FROM k WINDOW w AS (PARTITION BY id ORDER BY n)"""


def j21_free_places(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with no other of an even key and the same nation within 3 km: reservations that stand alone."""
    s = t.suppliers(spark, d).select("id", "x", "y", F.col("s_nationkey").alias("tactic"))
    o = s.where("id % 2 = 0").select(F.col("id").alias("but"), F.col("x").alias("rx"), F.col("y").alias("ry"), "tactic")
    return spatial.within_reach(s, o, 3000.0, ["tactic"], "left_anti").select("id", "tactic")


J21 = f"""WITH {t.SUPPLIERS} SELECT s.id, s.s_nationkey AS tactic FROM suppliers s WHERE NOT EXISTS (SELECT 1 FROM suppliers o WHERE o.id % 2 = 0 AND o.s_nationkey = s.s_nationkey AND o.id <> s.id
  AND sqrt((s.x - o.x) ** 2 + (s.y - o.y) ** 2) < 3000)"""


def a23_shares(spark: SparkSession, d: str) -> DataFrame:
    """Lines, quantity and share of all by return flag."""
    g = t.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return g.withColumn("percent", F.round(100 * F.col("quantity") / F.sum("quantity").over(junctions.Window.partitionBy()), 6))


QUERIES = {
    "J12_movements": j12_movements, "J13_conflicts": j13_conflicts, "G13_phases": g13_phases, "G14_signal_state": g14_signal_state, "U06_distinct_approaches": u06_distinct_approaches,
    "J11_nearest_junction": j11_nearest_junction, "J20_latest": j20_latest, "F17_accepted": f17_accepted, "A22_windows": a22_windows, "A20_percentiles": a20_percentiles, "W07_hysteresis": w07_hysteresis,
    "T05_dispatch": t05_dispatch, "G17_offences": g17_offences, "G20_search_area": g20_search_area, "W05_route_points": w05_route_points, "J21_free_places": j21_free_places, "A23_shares": a23_shares,
}
SQL = {
    "J12_movements": f"WITH {_MOVES} SELECT junction, movement, resolved, round(sx, 5) AS stop_x, round(sy, 5) AS stop_y FROM mv", "J13_conflicts": f"WITH {_CLASH} SELECT junction, a, b FROM clash",
    "G13_phases": G13, "T05_dispatch": T05, "G17_offences": G17, "G14_signal_state": G14, "U06_distinct_approaches": U06, "J11_nearest_junction": J11, "J20_latest": J20, "F17_accepted": F17, "A22_windows": A22, "A20_percentiles": A20, "W07_hysteresis": W07,
    "G20_search_area": G20, "W05_route_points": W05, "J21_free_places": J21,
    "A23_shares": "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, round(100 * sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS percent FROM lineitem GROUP BY l_returnflag",
}

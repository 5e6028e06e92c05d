"""Operators on small fixtures: graphs, routes, search, votes, junctions, dispatch and sightings."""

import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.functions import tags
from waymark.operators import graph, junctions, prefix, routing, search, sightings, spatial

#: A made-up map: a road that a living street crosses, a tunnel apart from them, and a footway to it.
NODES = [(11, -3.100, 40.500), (12, -3.100, 40.503), (13, -3.101, 40.506), (14, -3.097, 40.503), (15, -3.104, 40.502), (16, -3.110, 40.511), (17, -3.112, 40.515)]
WAYS = [
    (1, [11, 12, 13], {"highway": "secondary"}), (2, [14, 12, 15], {"highway": "living_street", "oneway": "-1", "maxspeed": "20 mph"}),
    (3, [16, 17], {"highway": "track", "tunnel": "yes", "layer": "-1"}), (4, [15, 16], {"highway": "footway", "maxspeed": "walk"}),
]


def tables(spark, ways, nodes):
    w = spark.createDataFrame([(i, t) for i, _, t in ways], "way_id long, tags map<string,string>")
    p = spark.createDataFrame([(i, k, n) for i, ns, _ in ways for k, n in enumerate(ns)], "way_id long, pos int, node_id long")
    n = spark.createDataFrame([(i, lon, lat) for i, lat, lon in nodes], "node_id long, lon double, lat double")
    return w, p, n


def test_graph(spark):
    t = tables(spark, WAYS, NODES)
    edges = graph.compressed_edges(*t)
    rows = edges.collect()
    assert len(rows) == 12
    s = graph.edge_stats(edges).first()
    assert (s["explicit"], s["fallback"], s["restricted"], s["against"]) == (4, 8, 2, 2) and s["max_legal_kmh"] == 60
    assert {r["way_id"] for r in rows if r["layer"] == -1 and r["flags"] & 4} == {3}
    assert graph.representatives(edges).count() == 5
    assert graph.violations(edges, graph.node_index(edges)).count() == 0
    assert graph.node_index(edges).count() == 7
    assert {(r["source"], r["target"]) for r in rows} == {(r["source"], r["target"]) for r in graph.detailed_edges(*t).collect()}


def test_missing_node_drops_the_way(spark):
    w, p, n = tables(spark, WAYS, [x for x in NODES if x[0] != 13])
    assert {r["way_id"] for r in graph.detailed_edges(w, p, n).collect()} == {2, 3, 4}


def test_closed_way_and_shape(spark):
    square = [(1, 0.0, 0.0), (2, 0.0, 0.001), (3, 0.001, 0.001), (4, 0.001, 0.0)]
    edges = graph.compressed_edges(*tables(spark, [(7, [1, 2, 3, 4, 1], {"highway": "road"})], square)).where("NOT reversed").collect()
    assert {(r["source"], r["target"], r["segment"]) for r in edges} == {(1, 3, 0), (3, 1, 2)}


@pytest.mark.parametrize("preference, way", [("fastest", 10), ("shortest", 20)])
def test_route_preference(spark, preference, way):
    nodes = [(1, 0.0, 0.0), (2, 0.002, 0.002), (3, 0.002, 0.004), (4, 0.0, 0.006)]
    ways = [(10, [1, 2, 3, 4], {"highway": "primary", "maxspeed": "100"}), (20, [1, 4], {"highway": "residential", "maxspeed": "20"})]
    edges = graph.detailed_edges(*tables(spark, ways, nodes))
    best = routing.cheapest(edges, spark.createDataFrame([(1, 1)], "request long, node long"), routing.edge_cost(preference))
    path = routing.routes(best, spark.createDataFrame([(1, 4)], "request long, target long")).first()["path"]
    assert path == ([1, 2, 3, 4] if way == 10 else [1, 4])


def test_oneway_and_unreachable(spark):
    nodes = [(1, 0.0, 0.0), (2, 0.0, 0.001), (3, 0.0, 0.002)]
    edges = graph.detailed_edges(*tables(spark, [(1, [1, 2, 3], {"highway": "primary", "oneway": "yes"})], nodes))
    best = routing.cheapest(edges, spark.createDataFrame([(1, 1), (2, 3)], "request long, node long"), routing.edge_cost())
    out = {r["request"]: r["path"] for r in routing.routes(best, spark.createDataFrame([(1, 3), (2, 1)], "request long, target long")).collect()}
    assert out == {1: [1, 2, 3], 2: None}


@pytest.mark.parametrize("preference", ["fastest", "shortest", "avoid_small", "avoid_major"])
def test_routes_equal_plain_search(spark, preference):
    r = random.Random(3)
    rows = [(a, b, float(r.randint(10, 900)), float(r.choice((30, 50, 90))), r.choice((0, 4, 11)), 0, 0) for a, b in itertools.permutations(range(12), 2) if r.random() < 0.25]
    edges = spark.createDataFrame(rows, "source long, target long, length_m double, kmh double, road_class int, access int, flags int")
    costed = edges.withColumn("w", routing.edge_cost(preference)).collect()
    starts = [(i, i) for i in range(12)]
    got = {(x["request"], x["node"]): x["cost"] for x in routing.cheapest(edges, spark.createDataFrame(starts, "request long, node long"), routing.edge_cost(preference)).collect()}
    want = {}
    for s, _ in starts:
        cost = {s: 0.0}
        for _ in range(12):
            for e in costed:
                if e["source"] in cost and cost[e["source"]] + e["w"] < cost.get(e["target"], float("inf")):
                    cost[e["target"]] = cost[e["source"]] + e["w"]
        want |= {(s, n): c for n, c in cost.items()}
    assert got == pytest.approx(want)


def test_prefix_sums(spark):
    rows = [(k * 37 - 900, k % 5) for k in range(200)]
    out = prefix.prefix_sums(spark.createDataFrame(rows, "k long, v long").repartition(4), "k", F.col("v"), "before").orderBy("k").collect()
    total = 0
    for r in out:
        assert r["before"] == total
        total += r["v"]


RECORDS = [("r1", "Harbour Road 7", "Eastport"), ("r2", "Blue Kettle", "tea room"), ("r3", "Blue Kettle", "Westport"), ("r4", "Núñez Hall", "library")]


@pytest.mark.parametrize("q, ids", [("nunez hall", ["r4"]), ("blue ket", ["r2", "r3"]), ("harbour road 7", ["r1"]), ("westport", ["r3"]), ("k", ["r2", "r3"]), ("", []), ("nothing", [])])
def test_search(spark, q, ids):
    indexed = search.index(spark.createDataFrame(RECORDS, "id string, display string, subtitle string"))
    out = search.search(indexed, search.postings(indexed), spark.createDataFrame([(q,)], "query string"))
    assert [r["id"] for r in out.orderBy("rank").collect()] == ids


@pytest.mark.parametrize("samples, value", [([(20, 20, "a"), (40, 30, "a"), (60, 35, "a")], "a"), ([(20, 20, "a"), (40, 30, "b")], None), ([(20, 20, "a")], None), ([(20, 20, "a"), (900, 0, "a")], None)])
def test_vote(spark, samples, value):
    p = spark.createDataFrame([(1, 0.0, 0.0, "x")], "id long, x double, y double, grp string")
    s = spark.createDataFrame([(float(x), float(y), "x", v) for x, y, v in samples] + [(1.0, 1.0, "y", "c")], "sx double, sy double, grp string, value string")
    rows = spatial.neighbour_vote(p, s).collect()
    assert [r["value"] for r in rows] == ([value] if value else [])


def test_nearest_segment_equals_all_pairs(spark):
    r = random.Random(2)
    segments = [(i, r.uniform(-900, 900), r.uniform(-900, 900), r.uniform(-900, 900), r.uniform(-900, 900)) for i in range(60)]
    pts = [(i, r.uniform(-1000, 1000), r.uniform(-1000, 1000)) for i in range(50)]
    s = spark.createDataFrame(segments, "edge long, ax double, ay double, bx double, by double")
    got = {x["id"]: (x["edge"], round(x["distance_m"], 6)) for x in spatial.nearest_segment(spark.createDataFrame(pts, "id long, x double, y double"), s, max_m=100.0, size=64.0).collect()}
    want = {}
    for i, x, y in pts:
        best = None
        for e, ax, ay, bx, by in segments:
            n = (bx - ax) ** 2 + (by - ay) ** 2
            f = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n))
            d = ((x - ax - (bx - ax) * f) ** 2 + (y - ay - (by - ay) * f) ** 2) ** 0.5
            best = min(best or (d, e), (d, e))
        if best[0] <= 100:
            want[i] = (best[1], round(best[0], 6))
    assert got == want


ARMS = {"west": (-20, 1), "east": (20, -1), "south": (2, -15)}


def _tee(spark, unknown=None):
    """A junction of three arms at (1, 2): an approach and an exit on each."""
    ap = spark.createDataFrame([(7, f"in {n}", 1.0 + x, 2.0 + y, 1.0, 2.0, n != unknown) for n, (x, y) in ARMS.items()], "junction long, approach string, ax double, ay double, jx double, jy double, known boolean")
    return junctions.movements(ap, spark.createDataFrame([(7, f"out {n}", 1.0 + x, 2.0 + y) for n, (x, y) in ARMS.items()], "junction long, exit string, ex double, ey double"))


def test_movements_and_phases_of_a_tee(spark):
    moves = _tee(spark)
    names = {r["movement"]: (r["approach"], r["exit"]) for r in moves.collect()}
    assert set(names.values()) == {(f"in {a}", f"out {b}") for a, b in itertools.permutations(ARMS, 2)}
    clash = {(r["a"], r["b"]) for r in junctions.conflicts(moves).collect()}
    for a, b in itertools.combinations(sorted(names), 2):
        if names[a][0] == names[b][0] or names[a][1] == names[b][1]:
            assert (a, b) in clash
    assert ("in east->out west", "in west->out east") not in clash
    phases = {r["movement"]: r["phase"] for r in junctions.phases(moves, junctions.conflicts(moves)).collect()}
    assert set(phases) == set(names) and not any(phases[a] == phases[b] for a, b in clash)
    assert all(any((min(m, x), max(m, x)) in clash for x in names if phases[x] == p) for m in names for p in range(phases[m]))


def test_an_unknown_approach_conflicts_with_all(spark):
    moves = _tee(spark, unknown="south")
    clash = {(r["a"], r["b"]) for r in junctions.conflicts(moves).collect()}
    rows = moves.collect()
    mine = {r["movement"] for r in rows if not r["resolved"]}
    assert len(mine) == 2 and all((min(m, r["movement"]), max(m, r["movement"])) in clash for m in mine for r in rows if r["movement"] != m)
    assert not mine & {r["movement"] for r in junctions.phases(moves, junctions.conflicts(moves)).collect()}


def test_junctions_of_a_graph(spark):
    """A star of four roads with a bend on one: only the middle branches, and a road beside another counts once."""
    places = {1: (0, 0), 2: (50, 0), 3: (0, 60), 4: (-40, 0), 5: (90, 10), 6: (100, 1)}
    roads = [(21, 1, 2), (22, 1, 3), (23, 1, 4), (24, 2, 5), (25, 1, 6)]
    edges = spark.createDataFrame([e for w, a, b in roads for e in ((w, a, b), (w, b, a))], "way_id long, source long, target long")
    into, out = junctions.junctions_of(edges, spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in places.items()], "node long, x double, y double"))
    assert {(r["junction"], r["approach"]) for r in into.collect()} == {(1, "w21:n2"), (1, "w22:n3"), (1, "w23:n4")}
    assert {r["exit"] for r in out.collect()} == {"w21:n2", "w22:n3", "w23:n4", "w25:n6"}
    assert [tuple(r) for r in junctions.densest(into, junctions.movements(into, out)).collect()] == [(1, 8, 3)]


def test_signal_cycle(spark):
    want = [(0.0, 0, "all_red"), (1.0, 0, "red_yellow"), (2.0, 0, "green"), (13.5, 0, "green"), (14.0, 0, "yellow"), (17.0, 1, "all_red"), (34.0, 0, "all_red")]
    df = spark.createDataFrame([(t,) for t, _, _ in want], "t double").select("t", junctions.signal_state(F.col("t"), F.lit(2)).alias("s"))
    assert [(r["t"], r["s"]["phase"], r["s"]["stage"]) for r in df.orderBy("t").collect()] == want


@pytest.mark.parametrize("seed", range(3))
def test_dispatch_equals_serving_in_order(spark, seed):
    rng = random.Random(seed)
    units = [(z, 100 * z + u, rng.randrange(2), float(rng.randrange(30)), float(rng.randrange(30))) for z in range(3) for u in range(rng.randint(0, 14))]
    calls = [(z, 1000 * z + i, float(rng.randrange(30)), float(rng.randrange(30)), rng.randrange(3), rng.randrange(2), rng.randrange(10**6)) for z in range(3) for i in range(rng.randint(1, 20))]
    want, busy = {}, set()
    for z, i, x, y, _, role, _ in sorted(calls, key=lambda c: (-c[4], c[6])):
        free = [(round(math.hypot(ux - x, uy - y), 6), u) for uz, u, r, ux, uy in units if uz == z and r == role and u not in busy]
        want[i] = min(free)[1] if free else None
        busy.add(want[i])
    got = sightings.greedy_dispatch(
        spark.createDataFrame(calls, "zone long, incident long, x double, y double, priority long, role long, sequence long"), spark.createDataFrame(units, "zone long, unit long, role long, x double, y double")
    )
    assert {r["incident"]: r["unit"] for r in got.collect()} == want


def test_latest(spark):
    obs = spark.createDataFrame([(1, 7, 10.0), (2, 7, 20.0), (3, 7, 9000.0)], "event_id long, unit long, t double")
    asked = spark.createDataFrame([(1, 7, 5.0), (2, 7, 25.0), (3, 7, 8000.0), (4, 7, 9000.0), (5, 8, 1.0)], "request long, unit long, now double")
    out = {r["request"]: (r["event_id"], r["stale"]) for r in sightings.latest_at(asked, obs, "unit").collect()}
    assert out[1][0] is None and out[2] == (2, False) and out[3] == (2, True) and out[4] == (3, False) and out[5][0] is None


def test_offences(spark):
    rows = [(1, 1, 0.0, True, False, False), (2, 1, 1.0, True, True, False), (3, 1, 5.0, True, False, False), (4, 1, 8.0, True, False, False), (5, 2, 0.0, True, True, False), (6, 2, 1.0, True, False, True), (7, 2, 2.0, False, False, False)]
    df = spark.createDataFrame(rows, "event_id long, unit long, t double, current boolean, offence boolean, complied boolean")
    assert {r["event_id"]: r["state"] for r in sightings.offence_steps(df, "unit").collect()} == {1: "observe", 2: "stop", 3: "stop", 4: "pursuit", 5: "stop", 6: "observe", 7: "patrol"}


def test_order_of_rows_does_not_matter(spark):
    edges = graph.compressed_edges(*tables(spark, WAYS, NODES))
    mixed = graph.compressed_edges(*[df.orderBy(F.rand(4)).repartition(3) for df in tables(spark, WAYS, NODES)])
    assert sorted(map(str, edges.collect())) == sorted(map(str, mixed.collect()))


def test_light_points_keep_every_cell_and_layer(spark):
    rng = random.Random(5)
    points = [(rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for _ in range(700)] + [(rng.gauss(0, 500), rng.gauss(0, 500)) for _ in range(300)] + [(40_001.0, 40_001.0)]

    def hashed(key):
        v = 2166136261
        for b in key.encode():
            v = ((v ^ b) * 16777619) & 0x7FFFFFFF
        return v

    dense = Counter((math.floor(x / 2000), math.floor(y / 2000)) for x, y in points)
    want = []
    for lx, ly in {(math.floor(x / 450), math.floor(y / 450)) for x, y in points}:
        cx, cy, near = math.floor((lx + 0.5) * 450 / 2000), math.floor((ly + 0.5) * 450 / 2000), 0.0
        for j, i in itertools.product((-1, 0, 1), repeat=2):
            near += dense.get((cx + i, cy + j), 0) * (1.0 if i == j == 0 else 0.35)
        layers = max(1, min(4, 1 + math.floor(math.log2(1 + math.floor(near + 0.5)) / 2.5)))
        want += [(k, hashed(f"{lx}:{ly}"), f"{lx}:{ly}") for k in range(layers)]
    got = [(r["layer"], r["hash"], r["key"]) for r in spatial.light_points(spark.createDataFrame(points, "x double, y double")).collect()]
    assert got == sorted(want) and len({k for _, _, k in got}) > 300 and {k for k, _, _ in got} > {0, 1}
    assert spatial.light_points(spark.createDataFrame(points, "x double, y double"), most=350).count() == 350


def test_walked_sums_the_way_to_every_node(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(1, 70)] + [(rng.randint(1, 70), rng.randint(1, 70)) for _ in range(60)]
    edges = [(a, b, float(rng.randint(1, 90)), float(rng.choice((30, 50, 90))), 4, 0, 0) for a, b in pairs if a != b]
    edges += [(1, 2, 500.0, 30.0, 4, 0, 0), (80, 81, 5.0, 30.0, 4, 0, 0)]
    net = spark.createDataFrame(edges, "source long, target long, length_m double, kmh double, road_class int, access int, flags int")
    best = routing.cheapest(net, spark.createDataFrame([(1, 1), (2, 3)], "request long, node long"), routing.edge_cost("fastest"))
    via = {(r["request"], r["node"]): r["via"] for r in best.collect()}
    one = {}
    for a, b, m, kmh, *_ in edges:
        one[a, b] = min(one.get((a, b), (math.inf, 0.0)), (m / 1000 / kmh * 3600, m))
    rows = routing.walked(best, net).collect()
    assert {(r["request"], r["node"]) for r in rows} == set(via) and {n for q, n in via if q == 1} == set(range(1, 71))
    for r in rows:
        way, n = [], r["node"]
        while (up := via[r["request"], n]) is not None:
            way.append(one[up, n])
            n = up
        assert r["steps"] == len(way) and r["metres"] == sum(m for _, m in way)
        assert r["seconds"] == pytest.approx(sum(s for s, _ in way)) == pytest.approx(r["cost"])


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_snapped_routes_equal_plain_search(spark, hops):
    rng = random.Random(hops)
    rows = [(k, a, b, float(rng.randint(10, 900)), 50.0, 4, 0, 0) for k, (a, b) in enumerate(itertools.permutations(range(9), 2)) if rng.random() < 0.3]
    edges = spark.createDataFrame(rows, "edge long, source long, target long, length_m double, kmh double, road_class int, access int, flags int")
    by = {r[0]: r for r in rows}
    ask = [(q, *rng.sample(sorted(by), 2), *rng.sample(sorted(by), 1)) for q in range(6)] + [(9, rows[0][0], rows[0][0], rows[0][0])]
    starts = [(q, e, rng.random() / 2) for q, a, b, _ in ask for e in {a, b}]
    ends = [(q, e, 0.5 + rng.random() / 2) for q, _, _, e in ask]
    cost = routing.edge_cost("shortest")
    s, t = spark.createDataFrame(starts, "request long, edge long, fraction double"), spark.createDataFrame(ends, "request long, edge long, fraction double")
    best = routing.cheapest(edges, routing.snap_starts(edges, s, cost), cost, hops=hops)
    got = {r["request"]: r["cost"] for r in routing.snapped(best, edges, s, t, cost).collect()}
    far = {(i, j): 0.0 if i == j else math.inf for i in range(9) for j in range(9)}
    for _, a, b, m, *_ in rows:
        far[a, b] = min(far[a, b], m)
    for k, i, j in itertools.product(range(9), repeat=3):
        far[i, j] = min(far[i, j], far[i, k] + far[k, j])
    want = {}
    for q, e, f in ends:
        for sq, se, sf in starts:
            if sq == q:
                c = by[se][3] * (1 - sf) + far[by[se][2], by[e][1]] + by[e][3] * f
                c = min(c, by[e][3] * (f - sf)) if se == e and f >= sf else c
                want[q] = min(want.get(q, math.inf), c)
    assert got == pytest.approx({q: c for q, c in want.items() if c < math.inf})


def test_a_long_line_takes_all_its_rounds(spark):
    """Nothing ends the rounds but that no cost falls: the last node of a long road has its cost."""
    rows = [(n, n + 1, 10.0, 50.0, 4, 0, 0) for n in range(120)]
    edges = spark.createDataFrame(rows, "source long, target long, length_m double, kmh double, road_class int, access int, flags int")
    best = routing.cheapest(edges, spark.createDataFrame([(1, 0)], "request long, node long"), routing.edge_cost("shortest"), hops=3, merge_every=4)
    assert {r["node"]: r["cost"] for r in best.collect()} == {n: 10.0 * n for n in range(121)}
    assert best.where("node = 120").first()["via"] == 119


def test_points_in_faces(spark):
    rng = random.Random(1)
    rings = [(1, [(0, 0), (50, 5), (40, 60), (-10, 45)]), (1, [(10, 10), (20, 10), (20, 20)]), (2, [(30, 30), (90, 30), (60, 95)])]
    points = [(i, rng.uniform(-20, 100), rng.uniform(-20, 100)) for i in range(300)]

    def odd(x, y, ring):
        n = 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
        return n

    want = {(i, f) for i, x, y in points for f in (1, 2) if sum(odd(x, y, r) for g, r in rings if g == f) % 2}
    df = spark.createDataFrame([(f, [(float(a), float(b)) for a, b in r]) for f, r in rings], "face long, ring array<struct<x:double,y:double>>")
    got = spatial.in_faces(spark.createDataFrame(points, "id long, x double, y double"), df, 25.0)
    assert {(r["id"], r["face"]) for r in got.collect()} == want and len(want) > 60


def test_synthetic_node_ids(spark):
    df = spark.createDataFrame([(13.5, 55.25, ""), (13.5, 55.25, "l=1;b=;t="), (13.5000000001, 55.25, "")], "lon double, lat double, apart string")
    a, b, c = (r["id"] for r in df.select(tags.synthetic_node_id(F.col("lon"), F.col("lat"), F.col("apart"), b"test").alias("id")).collect())
    want = hashlib.blake2b(b"135000000:552500000:", digest_size=8, person=b"test").digest()
    assert a == c == int.from_bytes(want, "little") & (1 << 63) - 1 and b != a


def test_what_is_carried_equals_a_plain_walk(spark):
    """A key with most rows (so that it lies in many partitions), small ones, a null key and null values."""
    r = random.Random(12)
    rows = [(r.choice([1, 1, 1, 1, 1, 2, 3, None]), i, r.choice([None, float(r.randrange(100))])) for i in range(600)]
    table = spark.createDataFrame(r.sample(rows, len(rows)), "unit long, event_id long, value double").repartition(5)
    told = F.when(F.col("value") > 80, True).when(F.col("value") < 20, False)
    folds = {"most": ("max", F.col("value")), "sum": ("sum", F.col("value")), "last": ("last", told)}
    for own in (True, False):
        want, seen = {}, {}
        for unit, i, v in rows:
            most, total, last = seen.get(unit, (None, None, None))
            now = (most, total, last) if v is None else (max(most or 0.0, v), (total or 0.0) + v, True if v > 80 else False if v < 20 else last)
            want[i] = (unit, v, *(now if own else (most, total, last)))
            seen[unit] = now
        got = prefix.carried(table, "unit", ["event_id"], folds, own)
        assert got.columns == ["unit", "event_id", "value", "most", "sum", "last"]
        assert {x["event_id"]: (x["unit"], x["value"], x["most"], x["sum"], x["last"]) for x in got.collect()} == want
    assert prefix.carried(table.limit(0), "unit", ["event_id"], folds, True).count() == 0


def test_composed_states_equal_a_plain_walk(spark):
    r = random.Random(13)
    rows = [(r.choice([1, 1, 1, 1, 1, 2, 3, None]), i, [r.randrange(3) for _ in range(3)]) for i in range(400)]
    table = spark.createDataFrame(r.sample(rows, len(rows)), "unit long, event_id long, next array<int>").repartition(5)
    want, state = {}, {}
    for unit, i, step in rows:
        state[unit] = want[i] = step[state.get(unit, 2)]
    got = prefix.composed(table, "unit", ["event_id"], F.col("next"), 2, "state")
    assert {x["event_id"]: x["state"] for x in got.collect()} == want
    assert prefix.composed(table.limit(0), "unit", ["event_id"], F.col("next"), 2, "state").count() == 0


def test_postings_of_some_pieces(spark):
    """Postings of the pieces that queries look up are those of the whole index, and give the same results."""
    indexed = search.index(spark.createDataFrame([*RECORDS, ("r5", "aa b", "ab a"), ("r6", "", None)], "id string, display string, subtitle string"))
    queries = spark.createDataFrame([("blue ket",), ("k",), ("b a",), ("ro",), ("",), ("xyz",)], "query string")
    of = search.looked_up(queries)
    assert {r["g"] for r in of.collect()} == {"blu", "lue", "ket", "k", "b", "ro", "xyz"}
    whole, some = search.postings(indexed), search.postings(indexed, of)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(some) == rows(whole.join(of, "g", "left_semi")) and len(rows(some)) > 5
    assert rows(search.search(indexed, some, queries)) == rows(search.search(indexed, whole, queries))


@pytest.mark.parametrize("n", [40, 12000])
def test_crowded_nearest_segments_and_votes(spark, n):
    """Crowded cells, segments in the same place, far points and ties give what all pairs give."""
    rng = random.Random(n)
    segments = [(k, *(float(rng.randint(0, 60) * 5) for _ in range(2)), rng.randint(-20, 20), rng.randint(-20, 20)) for k in range(n)]
    segments = [(k, x, y, x + a, y + b) for k, x, y, a, b in segments] + [(n + k, *s) for k, (_, x, y, a, b) in enumerate(segments[:40]) for s in [(x, y, x + a, y + b)]]
    points = [(i, float(rng.randint(-40, 340)), float(rng.randint(-40, 340))) for i in range(60)]

    def nearest(x, y):
        found = []
        for k, ax, ay, bx, by in segments:
            m = (bx - ax) ** 2 + (by - ay) ** 2
            f = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / m)) if m else 0.0
            found.append((round(math.hypot(x - ax - (bx - ax) * f, y - ay - (by - ay) * f), 9), k))
        return min(found)

    s = spark.createDataFrame(segments, "edge long, ax double, ay double, bx double, by double")
    got = {r["id"]: (round(r["distance_m"], 9), r["edge"]) for r in spatial.nearest_segment(spark.createDataFrame(points, "id long, x double, y double"), s, max_m=30.0, size=30.0).collect()}
    want = {i: nearest(x, y) for i, x, y in points}
    assert {i: d for i, (d, _) in got.items()} == {i: d for i, (d, _) in want.items() if d <= 30}
    assert sum(got[i] == want[i] for i in got) >= 0.9 * len(got)  # equal to nine places, not always in the last bit

    samples = [(float(rng.randint(0, 300)), float(rng.randint(0, 300)), k % 2, "ab"[rng.random() < 0.1]) for k in range(n)]
    votes = {}
    for i, x, y in points:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, v) for a, b, g, v in samples if g == i % 2 and (a - x) ** 2 + (b - y) ** 2 <= 6400)[:5]
        if len(near) >= 2 and len({v for _, v in near}) == 1:
            votes[i] = near[0][1]
    p = spark.createDataFrame([(i, x, y, i % 2) for i, x, y in points], "id long, x double, y double, grp long")
    found = spatial.neighbour_vote(p, spark.createDataFrame(samples, "sx double, sy double, grp long, value string"), reach_m=80.0, size=40.0)
    assert {r["id"]: r["value"] for r in found.collect()} == votes and len(votes) > 5
    if n > 1000:
        assert spatial._rings(spatial._halvings(spatial.segment_cells(s, 30.0), 64.0, 2.0))[0] > 1

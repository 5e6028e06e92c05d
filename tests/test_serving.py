"""Views, snap index, one pass to four tables, triangles and stream states: plans, odd rows and plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import faces, junctions, sightings, snapping, spatial, triangles, views
from waymark.sources import elements, writers
from waymark.streaming import events, states


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_levels_state_the_fixed_values(spark):
    told = {0.0: 3, 1199.9: 3, 1200.0: 2, 3499.0: 2, 3500.0: 1, 7999.0: 1, 8000.0: 0, 90000.0: 0}
    got = spark.createDataFrame([(a,) for a in told], "a double").select("a", views.level(F.col("a"))).collect()
    assert {r[0]: r[1] for r in got} == told
    assert [size for _, size in views.LEVELS] == [16000.0, 8000.0, 4000.0, 2000.0] and (views.MARGIN, views.MOST) == (1, 64)


def plain_tiles(view):
    _, altitude, *box = view
    lod = 0 if altitude >= 8000 else 1 if altitude >= 3500 else 2 if altitude >= 1200 else 3

    def bounds(lod, margin):
        size = (16000, 8000, 4000, 2000)[lod]
        return [math.floor((v + s * margin * size) / size) for v, s in zip(box, (-1, -1, 1, 1), strict=True)]

    count = lambda b: (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
    b = bounds(lod, 1)
    while count(b) > 64 and lod > 0:
        lod -= 1
        b = bounds(lod, 1)
    if count(b) > 64:
        b = bounds(lod, 0)
    return {(view[0], lod, x, y) for x in range(b[0], b[2] + 1) for y in range(b[1], b[3] + 1)}


def test_views_go_to_coarser_levels(spark):
    r = random.Random(5)
    rows = []
    for i in range(200):
        x, y, w, h = r.uniform(-9e4, 9e4), r.uniform(-9e4, 9e4), 10 ** r.uniform(1, 5.2), 10 ** r.uniform(1, 5.2)
        rows.append((i, r.uniform(0, 12000), x, y, x + w, y + h))
    schema = "view long, altitude double, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame([*rows, (900, None, 0.0, 0.0, 1.0, 1.0), (901, 5.0, None, 0.0, 1.0, 1.0)], schema)
    got = [tuple(t) for t in views.view_tiles(df).collect()]
    assert len(got) == len(set(got)) and set(got) == set().union(*map(plain_tiles, rows))
    assert len({lod for _, lod, _, _ in got}) == 4


def test_only_the_blocks_of_a_view_are_read(spark, tmp_path):
    path = str(tmp_path / "store")
    points = spark.range(40_000).select("id", (F.col("id") % 200 * 1000.0).alias("x"), (F.floor(F.col("id") / 200) * 1000.0).alias("y"), F.lit(5000.0).alias("area"))
    views.write_store(views.tiled(points, (3500.0, 1200.0, 300.0, 0.0)), path)
    store = spark.read.parquet(path)
    assert store.count() == 160_000 and spark.read.parquet(path + ".index").agg(F.sum("rows")).first()[0] == 160_000
    view = spark.createDataFrame([(1, 100.0, 50_500.0, 50_500.0, 53_500.0, 53_500.0)], "view long, altitude double, x1 double, y1 double, x2 double, y2 double")
    nothing = spark.read.parquet(path + ".index").limit(0)
    asked = views.store_of(views.view_tiles(view), [nothing, spark.read.parquet(path + ".index")])
    asked.write.parquet(str(tmp_path / "asked"))
    out = views.view_rows(spark.read.parquet(str(tmp_path / "asked")), [store, store])
    assert "dynamicpruning" in plan_of(out) and out.count() == 64
    assert {(r["store"], r["lod"]) for r in out.select("store", "lod").distinct().collect()} == {(1, 3)}
    scans = [m for m in out._jdf.queryExecution().executedPlan().toString().splitlines() if "dynamicpruning" in m]
    assert scans and all("block_x" in m and "block_y" in m for m in scans)


def test_snaps_do_not_shuffle_the_index(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for i in range(300):
        x, y = r.uniform(-3000, 3000), r.uniform(-3000, 3000)
        bx, by = x + r.uniform(-400, 400), y + r.uniform(-400, 400)
        rows += [(i, i, i + 1, i, i % 4 // 3, 0, 1.0, x, y, bx, by), (i + 1000, i + 1, i, i, i % 4 // 3, i % 2, 1.0, bx, by, x, y)]
    edges = spark.createDataFrame(rows, "edge long, source long, target long, way_id long, access int, flags int, length_m double, ax double, ay double, bx double, by double")
    snap, incoming = snapping.write_index(edges, "snap_test", str(tmp_path / "index"), buckets=5)
    points = spark.createDataFrame([(i, r.uniform(-3000, 3000), r.uniform(-3000, 3000)) for i in range(200)], "id long, x double, y double")
    legal = edges.where("access = 0 AND flags = 0 AND edge < 1000")
    assert sorted(map(tuple, snapping.snapped(points, snap).collect())) == sorted(map(tuple, spatial.nearest_segment(points, legal).collect()))
    assert snap.select("edge").distinct().count() == legal.count() and incoming.count() == 600
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        into = incoming.join(points.select(F.col("id").alias("target")), "target")
        cells = points.select("id", F.explode(spatial.cells_around(F.col("x"), F.col("y"), 256.0, 1)).alias("c")).select("id", "c.*").join(snap, ["cx", "cy"])
        for df in (into, cells):
            plan = plan_of(df)
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


ELEMENT = "osm_type string, osm_id long, lon double, lat double, node_ids array<long>, lons array<double>, lats array<double>, tags map<string,string>"
MAP = [
    ("node", 1, 13.0, 55.0, None, None, None, {"highway": "traffic_signals", "addr:housenumber": "4", "addr:street": "Mole"}),
    ("node", 2, None, 55.0, None, None, None, {"amenity": "cafe"}),
    ("node", 3, 13.0, 55.0, None, None, None, {"amenity": "cafe", "name": "Bay"}),
    ("way", 1, None, None, [1, 2], [13.0, 13.2], [55.0, 55.0], {"highway": "primary", "shop": "kiosk"}),
    ("way", 2, None, None, [1, 2], [13.0, None], [55.0, 55.0], {"highway": "primary"}),
    ("way", 3, None, None, [], [], [], {"highway": "primary"}), ("way", 4, None, None, [1], [13.0], [55.0], {"highway": "  "}),
    ("way", 5, None, None, None, None, None, {"shop": "kiosk"}), ("relation", 6, None, None, None, None, None, {"shop": "kiosk"}), ("node", 7, 1.0, 1.0, None, None, None, None), (None, None, None, None, None, None, None, None),
]


def test_four_tables_from_one_scan(spark, tmp_path):
    spark.createDataFrame(MAP, ELEMENT).write.parquet(str(tmp_path / "map"))
    source, path = spark.read.parquet(str(tmp_path / "map")), str(tmp_path / "facts")
    plan = plan_of(elements.element_facts(source))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    entry = elements.publish_elements(source, path)
    assert {k: e["rows"] for k, e in entry["kinds"].items()} == {"highways": 1, "addresses": 1, "pois": 2, "signals": 1}
    get = lambda kind: writers.verified_kind(spark, path, kind, elements.KINDS[kind])
    assert get("highways").first()["way_id"] == 1 and get("signals").first()["osm_id"] == 1 and get("addresses").first()["street"] == "Mole"
    way = get("pois").where("osm_type = 'way'").first()
    assert way["x"] == pytest.approx(6378137.0 * math.radians(13.1)) and "way_id" not in get("pois").columns
    with pytest.raises(Exception):  # a failed run leaves all four as they were
        elements.publish_elements(source.withColumn("osm_id", F.when(F.col("osm_id") == 3, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("osm_id"))), path)
    assert get("pois").count() == 2
    elements.publish_elements(source.limit(0), path)
    assert [get(k).count() for k in elements.KINDS] == [0, 0, 0, 0]
    with pytest.raises(ValueError, match="rows were written"):
        writers.publish_kinds(elements.element_facts(source), str(tmp_path / "two"), {"pois": elements.KINDS["pois"]})
    assert not (tmp_path / "two").exists() and not [p for p in tmp_path.iterdir() if "staging-" in p.name and p.name.startswith("two")]


def area(points):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True)) / 2


def first_ears(points):
    """Ears by looking at every corner again after each cut."""
    left = list(range(len(points))) if area(points) >= 0 else list(range(len(points)))[::-1]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out, more = [], True
    while len(left) > 3 and more:
        more = False
        for i, k in enumerate(left):
            t = left[i - 1], k, left[(i + 1) % len(left)]
            a, b, c = (points[j] for j in t)
            inside = (j for j in left if j not in t and min(turn(a, b, points[j]), turn(b, c, points[j]), turn(c, a, points[j])) >= -1e-9)
            if turn(a, b, c) > 1e-9 and next(inside, None) is None:
                out.append(t)
                left.remove(k)
                more = True
                break
    return out + ([tuple(left)] if len(left) == 3 else [])


def star(r, n):
    return [(far * math.cos(2 * math.pi * i / n), far * math.sin(2 * math.pi * i / n)) for i in range(n) for far in [r.uniform(1, 30)]]


def test_ears_fill_the_ring():
    r = random.Random(8)
    for n in (3, 4, 5, 8, 20, 60):
        for turned in (False, True):
            ring = star(r, n)[:: -1 if turned else 1]
            got = triangles.clip_ears(ring)
            assert len(got) == n - 2 and got == first_ears(ring)
            assert sum(area([ring[i] for i in t]) for t in got) == pytest.approx(abs(area(ring)))
            assert all(area([ring[i] for i in t]) > 0 for t in got)
    comb = [(0.0, 0.0), (9.0, 0.0), (9.0, 5.0), (8.0, 1.0), (7.0, 5.0), (6.0, 1.0), (5.0, 5.0), (4.0, 1.0), (3.0, 5.0), (2.0, 1.0), (1.0, 5.0)]
    assert triangles.clip_ears(comb) == first_ears(comb) and len(triangles.clip_ears(comb)) == 9
    assert triangles.clip_ears([(0.0, 0.0), (1.0, 1.0)]) == [] and len(triangles.clip_ears([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)])) == 2


def test_triangles_of_odd_rings(spark):
    rings = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (2, None), (3, []), (4, [(0.0, 0.0), None, (1.0, 0.0)]), (5, [(0.0, 0.0), (None, 1.0), (2.0, 0.0), (0.0, 2.0)])]
    df = spark.createDataFrame(rings, "id long, ring array<struct<x:double,y:double>>")
    got = triangles.triangulated(df).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: 2, 5: 1} and triangles.triangulated(df.limit(0)).count() == 0


def test_silence_is_told_once(spark, tmp_path):
    schema = "unit long, ts timestamp"
    at = lambda u, s: (u, s)

    def put(*rows):
        df = spark.createDataFrame(list(rows), "unit long, s double").select("unit", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        snapshot = spark.createDataFrame([(1, 90_000_000), (9, 95_000_000), (None, 1)], "unit long, seen_us long")
        with states.timed(spark):
            out = events.drained(states.silent_keys(stream, 10.0, "0 seconds", snapshot), f"file://{tmp_path}/run")
        return sorted((r["unit"], r["seen_us"] / 1e6, r["stale_us"] / 1e6) for r in out.collect())

    put(at(1, 100.0), at(2, 100.0), at(2, 110.5), at(2, 110.5), at(2, 115.0), (None, 100.0))
    first = run()  # the watermark is at 115: unit 1 (100 to 110), unit 2's gap, and unit 9 of the snapshot
    assert first == [(1, 100.0, 110.0), (2, 100.0, 110.0), (9, 95.0, 105.0)]
    put(at(1, 116.0), at(2, 124.0), at(3, 140.0))  # unit 1's first silence was told already
    assert run() == sorted([*first, (1, 116.0, 126.0), (2, 124.0, 134.0)])


def test_newest_generation_stays(spark, tmp_path):
    schema = "k string, g long, v string"
    path, typed = f"{tmp_path}/newest", spark.createDataFrame([], schema).schema
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: states.keep_newest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), path, "k", "g", f"{tmp_path}/check").awaitTermination()
    seen = lambda: sorted(map(tuple, states.newest(spark, path, typed, "k", "g").collect()), key=repr)
    assert seen() == [] and states.merge_newest(spark, path, typed, "k", "g") == -1
    put(("a", 2, "new"), ("a", 1, "old"), ("b", 5, "b5"), ("c", None, "none"), (None, 1, "no key"))
    run()
    put(("a", 1, "stale"), ("a", 2, "again"), ("b", 6, None))
    run()
    want = [("a", 2, "new"), ("b", 6, None), (None, 1, "no key")]
    assert seen() == sorted(want, key=repr)
    assert states.merge_newest(spark, path, typed, "k", "g") == 1 and seen() == sorted(want, key=repr)
    log = f"{path}/log/batch=1"  # a batch that is repeated after the merge changes nothing
    spark.read.parquet(log).withColumn("v", F.lit("replayed")).withColumn("g", F.col("g") + 100).write.parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("overwrite").parquet(log)
    assert seen() == sorted(want, key=repr)
    put(("b", 7, "b7"))
    run()
    assert ("b", 7, "b7") in seen() and len(seen()) == 3


CROSS = {1: (0.0, 0.0), 2: (100.0, 0.0), 3: (200.0, 0.0), 4: (100.0, -90.0), 5: (100.0, 80.0), 6: (100.0, 0.5)}


def grouped(spark, ways, signals, closed=(), against=()):
    both = [(a, b, w) for w, nodes in ways.items() for a, b in zip(nodes, nodes[1:], strict=False)]
    rows = [(s, t, w, 3 if w in closed else 0, 1 if back and w in against else 0) for a, b, w in both for s, t, back in ((a, b, False), (b, a, True))]
    edges = spark.createDataFrame(rows, "source long, target long, way_id long, access int, flags int")
    places = spark.createDataFrame([(n, *p) for n, p in CROSS.items()], "node long, x double, y double")
    s = spark.createDataFrame(signals, "signal string, node long, ways array<long>, direction_source string, explicit_stop_line boolean, x double, y double")
    into, out, lost = junctions.signalled(s, edges, places)
    return into.orderBy("approach").collect(), out, sorted(r["signal"] for r in lost.collect()), into


def test_signals_are_grouped_into_junctions(spark):
    ways = {101: [1, 2, 3], 102: [4, 2, 5]}
    into, out, lost, df = grouped(spark, ways, [("n1", 1, [101], "explicit", True, 90.0, 1.0), ("n3", 3, [101], "unknown", False, 0.0, 0.0), ("n9", 999, [101], "unknown", False, 0.0, 0.0), ("n0", None, None, None, None, None, None)])
    assert lost == ["n0", "n9"] and [(r["junction"], r["approach"], r["relationship"], r["stop_source"], tuple(r["stop"])) for r in into] == [
        (2, "approach:n1", "explicit", "explicit", (90.0, 1.0)), (2, "approach:n3", "inferred", "derived", (104.0, 0.0))]
    moves = junctions.movements(df, out)
    assert moves.count() == 6 and out.count() == 4 and junctions.conflicts(moves).count() > 0


def test_a_signal_at_a_junction_becomes_its_approaches(spark):
    ways = {101: [1, 2, 3], 102: [4, 2, 5]}
    into, out, lost, _ = grouped(spark, ways, [("m", 2, [102, 101, 101], "unknown", False, 100.0, 0.0)], against=(102,))
    assert [r["approach"] for r in into] == ["approach:m:w101:n1", "approach:m:w101:n3", "approach:m:w102:n4"] and not lost
    assert {r["relationship"] for r in into} == {"inferred"} and {r["exit"] for r in out.collect()} == {"w101:n1", "w101:n3", "w102:n5"}
    into, _, lost, _ = grouped(spark, ways, [("a", 1, [101], "unknown", False, 0.0, 0.0), ("m", 2, [101, 102], "unknown", False, 0.0, 0.0), ("z", 2, [102], "unknown", False, 0.0, 0.0), ("u", 2, [], "unknown", False, 0.0, 0.0)])
    assert [r["approach"] for r in into] == ["approach:a", "approach:m:w101:n3", "approach:m:w102:n5", "approach:z"] and not lost
    assert [tuple(r["ways"]) for r in into if r["signal"] == "z"] == [(102,)]  # its farthest neighbour is node 4; u points as a does


def test_split_ways_and_closed_roads(spark):
    into, out, _, _ = grouped(spark, {101: [1, 6], 102: [6, 2], 103: [4, 2, 5], 104: [2, 3]}, [("n1", 1, [101], "legacy", False, 0.0, 0.0)], closed=(104,))
    assert [r["junction"] for r in into] == [2] and "w104:n3" not in {r["exit"] for r in out.collect()}
    into, out, lost, _ = grouped(spark, {101: [1, 2, 3], 102: [4, 2]}, [("n1", 1, [101], "legacy", False, 0.0, 0.0)], closed=(101, 102))
    assert (into, out.count(), lost) == ([], 0, ["n1"])


def loop(first, *points):
    return [(first + i, *a, *b) for i, (a, b) in enumerate(zip(points, points[1:] + points[:1], strict=True))]


def test_faces_of_a_map(spark):
    box = loop(0, (0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0))
    split = [(10, 1000.0, 0.0, 1300.0, 500.0), (11, 1300.0, 500.0, 1000.0, 1000.0), (12, 1300.0, 500.0, 1400.0, 500.0)]  # a second face, with a dead end outside
    isle = loop(20, (300.0, 300.0), (600.0, 300.0), (600.0, 600.0), (300.0, 600.0))
    lake = loop(30, (400.0, 400.0), (400.0, 500.0), (500.0, 500.0), (500.0, 400.0))  # clockwise: land is outside it
    nothing = [(40, 5.0, 5.0, 5.0, 5.0)]
    rows = [(*r, 20 <= r[0] < 34) for r in box + split + isle + lake + nothing]
    df = spark.createDataFrame(rows, "seg long, ax double, ay double, bx double, by double, coast boolean")
    got = sorted((round(r["m2"], 3), r["land"]) for r in faces.land_faces(df, 250.0).collect())
    assert got == [(10_000.0, False), (80_000.0, True), (150_000.0, False), (910_000.0, False)]
    n = 3000
    circle = loop(0, *[(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)])
    ring = faces.darts_by_face(spark.createDataFrame(circle, "seg long, ax double, ay double, bx double, by double"))
    assert sorted(map(tuple, ring.groupBy("face").count().collect())) == [(0, n), (1, n)]
    assert faces.land_faces(df.limit(0), 250.0).count() == 0


def test_boxes_of_all_sizes_meet(spark):
    r = random.Random(4)

    def boxes(n):
        out = []
        for i in range(n):
            x, y, w, h = r.uniform(-1e4, 1e4), r.uniform(-1e4, 1e4), 10 ** r.uniform(-1, 4.5), 10 ** r.uniform(-1, 4.5)
            out.append((i, x, y, x + w, y + h))
        return [*out, (900, -1e12, -1e12, 1e12, 1e12), (901, 5.0, 5.0, 5.0, 5.0), (902, None, 0.0, 1.0, 1.0)]

    a, b = boxes(150), boxes(90)
    left = spark.createDataFrame(a, "id long, x1 double, y1 double, x2 double, y2 double")
    right = spark.createDataFrame(b, "win long, wx1 double, wy1 double, wx2 double, wy2 double")
    got = [tuple(p) for p in spatial.overlapping_boxes(left, right, 10.0).select("id", "win").collect()]
    want = {(p[0], q[0]) for p in a for q in b if None not in p + q and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.overlapping_boxes(left.limit(0), right, 10.0).count() == 0


def test_points_in_faces_of_all_sizes(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rings = [(1, square(-1e5, -1e5, 2e5)), (2, square(0.0, 0.0, 5.0)), (3, square(2.0, 2.0, 700.0)), (3, square(100.0, 100.0, 50.0))]
    points = [(1, 3.0, 3.0), (2, 120.0, 120.0), (3, 600.0, 600.0), (4, -9e4, 9e4), (5, 2e5, 0.0)]
    got = spatial.in_faces(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(rings, "face long, ring array<struct<x:double,y:double>>"), 20.0)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 3), (4, 1)]


def test_latest_equals_a_search(spark):
    r = random.Random(6)
    obs = [(r.choice([1, 1, 1, 2, None]), float(r.randrange(200)), i) for i in range(300)] + [(1, None, 900)]
    asked = [(r.choice([1, 2, 3, None]), i % 50, float(r.randrange(-20, 260))) for i in range(120)] + [(1, 999, None)]
    got = sightings.latest_at(spark.createDataFrame(asked, "unit long, request long, now double"), spark.createDataFrame(obs, "unit long, t double, event_id long"), "unit", bucket_s=16.0)
    want = []
    for unit, request, now in asked:
        best = max(((t, e) for u, t, e in obs if u == unit and None not in (u, t, now) and t <= now), default=None)
        want.append((request, unit, best[1], now - best[0], now - best[0] > 10.0) if best else (request, unit, None, 0.0, False))
    rows = [(x["request"], x["unit"], x["event_id"], x["age_s"], x["stale"]) for x in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_side_roads_are_no_nodes(spark, tmp_path):
    """Side roads and their ends keep numbers of their own where nodes are numbered beyond a million."""
    from waymark.plans import network

    spark.range(0, 1_000_200, 1).where("id < 200 OR id >= 1000000").withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    streets, spots = network._streets(spark, str(tmp_path))
    assert spots.count() == spots.select("node").distinct().count()
    assert streets.join(spots.select("node"), streets.source == spots.node).count() == streets.count() > 700


def test_segments_in_one_place_count_once_in_the_snap_index(spark, tmp_path):
    """Many edges in the same place give the smallest of them, and points far from all edges are not looked up."""
    rows = [(k, 2 * k, 2 * k + 1, k, 0, 0, 100.0, 0.0, 0.0, 100.0, 0.0) for k in range(3, 400)]
    edges = spark.createDataFrame(rows, "edge long, source long, target long, way_id long, access int, flags int, length_m double, ax double, ay double, bx double, by double")
    snap, _ = snapping.write_index(edges, "snap_alike", str(tmp_path / "index"), buckets=2)
    points = spark.createDataFrame([(1, 50.0, 7.0), (2, 90_000.0, 0.0)], "id long, x double, y double")
    found = snapping.snapped(points, snap)
    assert [(r["id"], r["edge"], r["distance_m"]) for r in found.collect()] == [(1, 3, 7.0)]
    assert spatial._one_a_place(snap, "cx", "cy").count() == snap.select("cx", "cy").distinct().count()


def test_ways_are_listed_once_a_place(spark):
    """Signals that share a place share one list of its ways."""
    from waymark.operators import signals

    v = spark.createDataFrame([(7, 13.0, 55.0), (3, 13.0 + 1e-9, 55.0), (7, 13.0, 55.0), (4, 13.1, 55.0)], "way_id long, lon double, lat double")
    got = sorted((r["_x"], r["ways"]) for r in signals.ways_by_place(v).collect())
    assert got == [(130_000_000, [3, 7]), (131_000_000, [4])]


def test_faces_of_few_and_of_many_edges(spark):
    """A small face of few edges and one of many hold the same points; the first need no second join."""
    square = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]
    many = [(a + (c - a) * k / 40, b + (d - b) * k / 40) for (a, b), (c, d) in zip(square, square[1:] + square[:1]) for k in range(40)]
    rings = spark.createDataFrame([(1, square), (1, [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)]), (2, many)], "face long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i * 12 + j, i - 0.5, j - 0.5) for i in range(12) for j in range(12)], "id long, x double, y double")
    held = lambda face: {(r["id"] // 12, r["id"] % 12) for r in spatial.in_faces(points, rings.where(f"face = {face}"), 5.0).collect()}
    whole = {(i, j) for i in range(1, 10) for j in range(1, 10)}
    assert held(2) == whole and held(1) == whole - {(i, j) for i in range(4, 7) for j in range(4, 7)}
    plan = spatial.in_faces(points, rings.where("face = 1"), 5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "count_if" not in plan

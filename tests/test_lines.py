"""Rings from member ways, places along lines and the tolerances of drawn routes, against plain code and the stated values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import areas, linear, routing


def rings_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        out.setdefault((r["area"], r["ring"]), []).append((r["way"], r["reversed"]))
    return out


def test_rings_are_chained_end_to_end(spark):
    members = [
        (1, 10, [1, 2, 3]), (1, 11, [4, 3]), (1, 12, [4, 5, 1]), (1, 12, [4, 5, 1]),  # one way backwards, one listed twice
        (1, 20, [7, 8, 9, 7]), (1, 21, [30, 31, 30]),  # closed alone; there and back is no ring
        (2, 10, [1, 2]), (2, 11, [2, 3]), (2, 13, [4, 1]),  # broken
        (3, 1, [1, 2]), (3, 2, [2, 1]),  # two ways
        (4, 1, [1, 2]), (4, 2, [2, 3]), (4, 3, [3, 1]), (4, 4, [1, 8]), (4, 5, [8, 9]), (4, 6, [9, 1]),  # four ways meet at node 1
        (5, 1, []), (5, 2, [1]), (5, 3, None),
    ]
    n = 1000
    order = list(range(n))
    random.Random(3).shuffle(order)
    members += [(6, order[i], [i, (i + 1) % n] if order[i] % 2 else [(i + 1) % n, i]) for i in range(n)]
    df = spark.createDataFrame(members, "area long, way long, nodes array<long>")
    rings = areas.assemble_rings(df)
    got = rings_of(rings.collect())
    assert {k: v for k, v in got.items() if k[0] < 6} == {(1, 10): [(10, False), (11, True), (12, False)], (1, 20): [(20, False)], (3, 1): [(1, False), (2, False)]}
    nodes = {(r["area"], r["ring"]): r["nodes"] for r in areas.ring_nodes(rings, df).collect()}
    assert nodes[1, 10] == [1, 2, 3, 4, 5] and nodes[1, 20] == [7, 8, 9] and nodes[3, 1] == [1, 2]
    long = nodes[6, 0]
    assert len(got[6, 0]) == n and sorted(long) == list(range(n)) and {(b - a) % n for a, b in zip(long, long[1:], strict=False)} <= {1, n - 1}
    assert areas.assemble_rings(df.limit(0)).count() == 0


def test_holes_go_to_the_smallest_ring_around_them(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    schema = "area long, ring long, points array<struct<x:double,y:double>>"
    outer = spark.createDataFrame([(1, 1, square(0.0, 0.0, 100.0)), (1, 2, square(10.0, 10.0, 30.0)), (2, 1, square(0.0, 0.0, 100.0))], schema)
    inner = spark.createDataFrame([(1, 7, square(15.0, 15.0, 2.0)), (1, 8, square(60.0, 60.0, 2.0)), (2, 9, square(15.0, 15.0, 2.0)), (2, 10, square(500.0, 1.0, 2.0))], schema)
    assert sorted(map(tuple, areas.holes(outer, inner, 50.0).collect())) == [(1, 7, 2), (1, 8, 1), (2, 9, 1)]


def plain_ahead(points, goal):
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        m = math.hypot(bx - ax, by - ay)
        if goal < m:
            return ax + (bx - ax) * goal / m, ay + (by - ay) * goal / m
        goal -= m
    return points[-1]


def test_look_ahead_equals_a_walk(spark):
    rng = random.Random(6)
    lines = {i: [(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(rng.randint(1, 12))] for i in range(20)}
    lines[3] = [(1.0, 1.0), (1.0, 1.0), (5.0, 1.0), (5.0, 1.0)]
    points = spark.createDataFrame([(i, k, *p) for i, ps in lines.items() for k, p in enumerate(ps)], "line long, pos long, x double, y double")
    asked = [(n, rng.randrange(21), rng.uniform(-5, 200), rng.choice([0.0, 3.0, 60.0])) for n in range(300)]
    got = {r["id"]: (r["x"], r["y"]) for r in linear.look_ahead(spark.createDataFrame(asked, "id long, line long, at_m double, ahead_m double"), points).collect()}
    want = {n: plain_ahead(lines[line], max(a, 0) + d) for n, line, a, d in asked if line in lines}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in want)


def test_pieces_add_up_to_their_segment(spark):
    rng = random.Random(9)
    rows = [(i, *[rng.uniform(-700, 700) for _ in range(4)]) for i in range(200)] + [(200, 0.0, 0.0, 300.0, 0.0), (201, 100.0, 5.0, 100.0, 450.0), (202, 7.0, 7.0, 7.0, 7.0)]
    pieces = linear.clipped(spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by double"), 100.0)
    got = {r["id"]: r["m"] for r in pieces.groupBy("id").agg(F.sum("length_m").alias("m")).collect()}
    assert all(got.get(i, 0.0) == pytest.approx(math.hypot(c - a, d - b)) for i, a, b, c, d in rows if i < 202)
    for r in pieces.collect():
        mid = (r["from"] + r["to"]) / 2
        x, y = r["ax"] + (r["bx"] - r["ax"]) * mid, r["ay"] + (r["by"] - r["ay"]) * mid
        assert r["tx"] * 100 - 1e-6 <= x <= (r["tx"] + 1) * 100 + 1e-6 and r["ty"] * 100 - 1e-6 <= y <= (r["ty"] + 1) * 100 + 1e-6


@pytest.mark.parametrize(("told", "drawn", "fault"), [(100.0, 104.9, False), (100.0, 105.1, True), (2000.0, 2009.9, False), (2000.0, 2010.1, True), (2000.0, 1989.9, True)])
def test_shapes_may_differ_by_five_metres_or_half_a_percent(spark, told, drawn, fault):
    edges = spark.createDataFrame([(1, 1, 2, told)], "edge long, source long, target long, length_m double")
    half = drawn / 2
    shapes = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, half), (1, 2, 0.0, 0.0)], "edge long, pos long, x double, y double")
    ends = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.9, 0.0)], "node long, x double, y double")
    assert [r["fault"] for r in routing.shape_faults(edges, shapes, ends).collect()] == (["length"] if fault else [])
    far = ends.withColumn("x", F.when(F.col("node") == 2, 2.1).otherwise(0.0))
    assert [r["fault"] for r in routing.shape_faults(edges, shapes, far).collect()] == ["ends"]


@pytest.mark.parametrize(("hops", "routed", "fault"), [([100.0] * 6, 600.0, False), ([100.0] * 6, 618.5, False), ([100.0] * 6, 618.6, True), ([100.0] * 6, 582.6, False), ([100.0] * 6, 582.5, True), ([100.0] * 4, 400.0, True), ([399.0] * 6, 2394.0, False), ([401.0] * 6, 2406.0, True)])
def test_drawn_routes_have_six_points_400_metres_and_three_percent(spark, hops, routed, fault):
    at = [sum(hops[:i], 0.0) for i in range(len(hops) + 1)]
    points = spark.createDataFrame([(1, 9, i, x, 0.0) for i, x in enumerate(at)], "request long, target long, point long, x double, y double")
    told = spark.createDataFrame([(1, 9, routed)], "request long, target long, metres double")
    assert (routing.detail_faults(points, told).count() == 1) == fault


def test_routes_over_five_thousand_edges(spark):
    n = 5000
    best = spark.range(n + 1).select(F.lit(1).cast("long").alias("request"), F.col("id").alias("node"), F.col("id").cast("double").alias("cost"), F.when(F.col("id") > 0, F.col("id") - 1).alias("via"))
    targets = spark.createDataFrame([(1, n), (1, 0), (1, 77), (1, n + 9)], "request long, target long")
    got = {r["target"]: r["path"] for r in routing.routes(best, targets).collect()}
    assert got == {n: list(range(n + 1)), 0: [0], 77: list(range(78)), n + 9: None}

"""Linework cut where it meets: against a plain version, with odd rows, and the faces it gives."""

import math
import random

from pyspark.sql import functions as F

from waymark.operators import faces, noding

SCHEMA = "seg long, ax double, ay double, bx double, by double, coast boolean"


def plain_pieces(rows):
    """Pieces as unordered pairs of ends, told to six digits, by holding every segment against every other one."""
    found = set()
    for seg, ax, ay, bx, by, _ in rows:
        cuts = {0.0, 1.0}
        rx, ry = bx - ax, by - ay
        for other, cx, cy, dx, dy, _ in rows:
            if other == seg:
                continue
            sx, sy = dx - cx, dy - cy
            turn = rx * sy - ry * sx
            if turn:
                t, u = ((cx - ax) * sy - (cy - ay) * sx) / turn, ((cx - ax) * ry - (cy - ay) * rx) / turn
                if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9:
                    cuts.add(min(1.0, max(0.0, t)))
            elif (cx - ax) * ry == (cy - ay) * rx:
                along = [((x - ax) * rx + (y - ay) * ry) / (rx * rx + ry * ry) for x, y in ((cx, cy), (dx, dy))]
                cuts |= {t for t in along if 0 <= t <= 1}
        at = [(round(ax + t * rx, 6) + 0.0, round(ay + t * ry, 6) + 0.0) for t in sorted(cuts)]
        found |= {(min(p, q), max(p, q)) for p, q in zip(at, at[1:]) if p != q}
    return found


def ends(r):
    p, q = ((round(r[f"{e}x"], 6) + 0.0, round(r[f"{e}y"], 6) + 0.0) for e in "ab")
    return min(p, q), max(p, q)


def test_pieces_equal_plain_ones(spark):
    r = random.Random(4)
    at = lambda: float(r.randrange(-30, 30))
    rows = [(i, at(), at(), at(), at(), False) for i in range(60)]
    rows += [(100 + i, float(i), 5.0, float(i + 7), 5.0, False) for i in range(-20, 20, 4)]  # run along one another
    rows += [(200, -500.0, -499.0, 700.0, 690.0, False), (201, 4.0, 5.0, 4.0, 9.0, False), (202, 10.0, 5.0, 3.0, 5.0, True)]
    rows = [x for x in rows if x[1:3] != x[3:5]]
    odd = [(300, None, 1.0, 2.0, 3.0, False), (301, 1.0, 1.0, 1.0, 1.0, True), (302, 1.0, 1.0, None, None, None)]
    table = spark.createDataFrame(rows + odd, SCHEMA).withColumn("name", F.lit("street"))
    for size in (5.0, 1000.0):
        got = noding.noded(table, size, ["NOT coast"]).collect()
        assert {ends(x) for x in got} == plain_pieces(rows) and len({ends(x) for x in got}) == len(got)
        assert {x["name"] for x in got} == {"street"} and {x["seg"] for x in got} <= {x[0] for x in rows}
        along = sum(math.dist(*ends(x)) for x in got if x["seg"] == 202)
        assert abs(along - 7.0) < 1e-6  # a coast stays where a street runs along it
    assert noding.noded(table.limit(0), 5.0).count() == 0


def test_a_repeated_line_stays_once(spark):
    rows = [(k, 0.0, 0.0, 9.0, 3.0, False) for k in (5, 2, 7)] + [(9, 9.0, 3.0, 0.0, 0.0, False)]
    got = noding.noded(spark.createDataFrame(rows, SCHEMA), 2.0).collect()
    assert [(x["seg"], x["part"], ends(x)) for x in got] == [(2, 0, ((0.0, 0.0), (9.0, 3.0)))]


def test_faces_of_crossing_lines(spark):
    """Lines across a square, none of which share ends: each cell is a face, and the coast's left is land."""
    rows = [(k, 100.0 * k, -30.0, 100.0 * k, 330.0, False) for k in range(4)]
    rows += [(10 + k, -30.0, 100.0 * k, 330.0, 100.0 * k, k == 1) for k in range(4)]
    rows += [(20, 150.0, 120.0, 150.0, 180.0, False)]  # closes nothing
    pieces = noding.renumbered(noding.noded(spark.createDataFrame(rows, SCHEMA), 70.0, ["NOT coast"]))
    got = faces.land_faces(pieces, 100.0).collect()
    assert [round(x["m2"], 6) for x in got] == [10_000.0] * 9
    assert sum(x["land"] for x in got) == 3  # the three cells above the line

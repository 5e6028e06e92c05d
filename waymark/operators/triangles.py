"""Triangles of rings: a table function that clips ears, one ring at a time."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How little a corner may turn and still be an ear, and how far outside a triangle a point still blocks it.
LEAST_TURN = BLOCKS = 1e-9


def _turn(a: tuple, b: tuple, c: tuple) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def clip_ears(points: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles, counter-clockwise, as places in ``points``: the first ear in order is cut until three corners are left.

    A corner is an ear if it turns left and no other corner lies in its triangle or on its edge. What blocks a corner is
    remembered, so it is looked at again only when that or a neighbour is gone. A ring that crosses itself gives the ears
    there are, or a fan if there is none.
    """
    n = len(points)
    if n < 3:
        return []
    area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True))
    order = list(range(n)) if area >= 0 else list(range(n - 1, -1, -1))
    at = [points[i] for i in order]
    before, after = [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    before[0], after[-1] = n - 1, 0
    gone, ears, waiting = [False] * n, [], {}

    def look(i: int) -> None:
        a, b, c = at[before[i]], at[i], at[after[i]]
        if _turn(a, b, c) <= LEAST_TURN:
            return
        j = after[after[i]]
        while j != before[i]:
            p = at[j]
            if min(_turn(a, b, p), _turn(b, c, p), _turn(c, a, p)) >= -BLOCKS:
                waiting.setdefault(j, []).append(i)
                return
            j = after[j]
        heapq.heappush(ears, (i, before[i], after[i]))

    for i in range(n):
        look(i)
    out, left = [], n
    while left > 3 and ears:
        i, a, c = heapq.heappop(ears)
        if gone[i] or (before[i], after[i]) != (a, c):
            continue
        out.append((a, i, c))
        gone[i] = True
        after[a], before[c] = c, a
        left -= 1
        for k in sorted({a, c, *waiting.pop(i, ())}):
            if not gone[k]:
                look(k)
    if left == 3:
        i = next(k for k in range(n) if not gone[k])
        out.append((i, after[i], after[after[i]]))
    return [tuple(order[i] for i in t) for t in out or [(0, i, i + 1) for i in range(1, n - 1)]]


class _Triangles:
    def eval(self, ring) -> Iterator[tuple]:
        points = [(p["x"], p["y"]) for p in ring or () if p is not None and p["x"] is not None and p["y"] is not None]
        for a, b, c in clip_ears(points):
            p, q, r = points[a], points[b], points[c]
            yield a, b, c, p[0], p[1], q[0], q[1], r[0], r[1]


triangles = F.udtf(_Triangles, returnType="a int, b int, c int, ax double, ay double, bx double, by double, cx double, cy double")


def triangulated(rings: DataFrame) -> DataFrame:
    """The columns of rings (with ``ring``: open array of structs x, y), and a row for each of its triangles: places and corners.

    Points without a place are left out. A ring below three points gives no row.
    """
    return rings.lateralJoin(triangles(F.col("ring").outer())).drop("ring")

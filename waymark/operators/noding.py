"""Linework cut where its lines meet, so that what is left shares ends only, as faces need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.session import Scratch

from .prefix import global_rank
from .spatial import overlapping_boxes

#: Places nearer than this are one, in metres; crossings are told to as many digits. Lines are parallel if the sine of their angle is below the second.
SNAP_M, PARALLEL = 1e-6, 1e-12
_ENDS = ("ax", "ay", "bx", "by")


def _boxes(segments: DataFrame, size: float, mark: str, corners: tuple[str, ...]) -> DataFrame:
    """Segments with the boxes of their stretches of at most ``size``, so that a long slanting one has no large box."""
    stretches = F.greatest(F.lit(1.0), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / size))
    at = segments.withColumn("_n", stretches).withColumn("_k", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    place = lambda c, k: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * (k / F.col("_n"))
    low = lambda c: F.least(place(c, F.col("_k")), place(c, F.col("_k") + 1)) - SNAP_M
    high = lambda c: F.greatest(place(c, F.col("_k")), place(c, F.col("_k") + 1)) + SNAP_M
    ends = [F.col(c).alias(f"{mark}{c}") for c in ("seg", *_ENDS)]
    return at.select(*ends, *[side(c).alias(name) for name, (side, c) in zip(corners, ((low, "x"), (low, "y"), (high, "x"), (high, "y")), strict=True)])


def _meetings() -> Column:
    """Array of (seg, x, y): where the segments p and q of a row cut each other; empty if they don't meet."""
    a, b, c, d = (F.struct(F.col(f"{m}{e}x").alias("x"), F.col(f"{m}{e}y").alias("y")) for m, e in (("p", "a"), ("p", "b"), ("q", "a"), ("q", "b")))
    minus = lambda u, v: (u["x"] - v["x"], u["y"] - v["y"])
    cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
    near = lambda u, x, y: F.hypot(u["x"] - x, u["y"] - y) <= SNAP_M
    r, s, ac = minus(b, a), minus(d, c), minus(c, a)
    long_r, long_s, turn = F.hypot(*r), F.hypot(*s), cross(r, s)
    t, u = cross(ac, s) / turn, cross(ac, r) / turn
    x, y = a["x"] + t * r[0], a["y"] + t * r[1]
    place = F.struct(F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
    for end in (d, c, b, a):  # an end that lies there is the place itself, so that ends stay as they are
        place = F.when(near(end, x, y), end).otherwise(place)
    within = (t * long_r).between(-SNAP_M, long_r + SNAP_M) & (u * long_s).between(-SNAP_M, long_s + SNAP_M)
    at = lambda seg, p: F.struct(F.col(seg).alias("seg"), p["x"].alias("x"), p["y"].alias("y"))
    none = F.array().cast("array<struct<seg:bigint,x:double,y:double>>")

    def inside(end: Column, seg: str, start: Column, way: tuple[Column, Column], length: Column) -> Column:
        v = minus(end, start)
        return F.when((v[0] * way[0] + v[1] * way[1]).between(0.0, length * length), F.array(at(seg, end))).otherwise(none)

    along = F.concat(inside(c, "pseg", a, r, long_r), inside(d, "pseg", a, r, long_r), inside(a, "qseg", c, s, long_s), inside(b, "qseg", c, s, long_s))
    crossing = F.when(within, F.array(at("pseg", place), at("qseg", place))).otherwise(none)
    parallel = F.abs(turn) <= PARALLEL * long_r * long_s
    return F.when(~parallel, crossing).when(F.abs(cross(ac, r)) <= SNAP_M * long_r, along).otherwise(none)


def noded(segments: DataFrame, size: float, first: list[Column | str] | None = None) -> DataFrame:
    """The columns of ``segments`` and ``part``: segments (seg, ax, ay, bx, by, ...) cut where they cross, touch or run along one another.

    ``part`` counts a segment's pieces from its start. Of pieces with the same ends, whichever way they run, one stays: the
    first by ``first``, then by the smaller seg. Segments without a place or a length are left out. ``seg`` is a unique
    long. Pairs are found by cells of ``size`` over stretches of that length. Crossings are told to a micrometre; more than
    two lines that should meet in one place but miss it by more stay apart.
    """
    lines = segments.dropna(subset=list(_ENDS)).where("ax <> bx OR ay <> by").withColumn("seg", F.col("seg").cast("long"))
    p, q = _boxes(lines, size, "p", ("x1", "y1", "x2", "y2")), _boxes(lines, size, "q", ("wx1", "wy1", "wx2", "wy2"))
    met = overlapping_boxes(p, q, size).where("pseg < qseg").select(F.explode(_meetings()).alias("m")).select("m.*")
    ends = lines.select(F.explode(F.array(*[F.struct("seg", F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "ab"])).alias("m")).select("m.*")
    cuts = met.unionByName(ends).distinct().join(lines, "seg")
    along = (F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay"))
    w = Window.partitionBy("seg").orderBy("_along", "x", "y")
    cuts = cuts.withColumn("_along", along).withColumns({"_x": F.lead("x").over(w), "_y": F.lead("y").over(w), "part": F.row_number().over(w) - 1})
    own = {"ax": "x", "ay": "y", "bx": "_x", "by": "_y"}
    pieces = cuts.where("_x IS NOT NULL").select(*[F.col(own.get(c, c)).alias(c) for c in segments.columns], "part")
    one, other = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    order = F.struct(*[(F.expr(c) if isinstance(c, str) else c).alias(f"_{i}") for i, c in enumerate(first or [])], "seg", "part")
    kept = pieces.groupBy(F.least(one, other).alias("_one"), F.greatest(one, other).alias("_other")).agg(F.min_by(F.struct(*pieces.columns), order).alias("_piece"))
    return kept.select("_piece.*")


def renumbered(pieces: DataFrame) -> DataFrame:
    """Pieces with a ``seg`` of their own, 0-based in the order of seg and part, and without ``part``."""
    ranked = global_rank(Scratch(pieces.sparkSession), pieces, ["seg", "part"], "pieces")
    return ranked.withColumn("seg", F.col("rank")).drop("part", "rank")

"""Junctions: nearest branch of a signal, movements, their conflicts, conflict-free phases and the signal cycle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions import geo, tags
from waymark.session import checkpointed

#: Seconds of the stages of a phase, in order.
STAGES = (("all_red", 1.0), ("red_yellow", 1.0), ("green", 12.0), ("yellow", 3.0))
SETBACK_M = 4.0


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other): undirected, each once."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).union(edges.select("target", "source"))
    return both.where("node <> other").distinct()


def nearest_junction(signals: DataFrame, edges: DataFrame, max_hops: int = 16) -> DataFrame:
    """(signal, junction, hops): the branching node (three neighbours or more) reached first; ties go to the smaller id.

    The frontier stops at branching nodes, so it runs along single roads and stays as small as the signals.
    """
    n = checkpointed(neighbours(edges))
    branching = checkpointed(n.groupBy("node").agg(F.count("*").alias("c")).where("c >= 3").select("node", F.lit(True).alias("branch")))
    seen = signals.select("signal", F.col("signal").alias("node")).join(n.select("node").distinct(), "node", "left_semi")
    at = checkpointed(seen.join(branching, "node", "left").select("signal", "node", F.coalesce("branch", F.lit(False)).alias("branch"), F.lit(0).alias("hops")))
    every, frontier = at, at.where("NOT branch")
    for hop in range(1, max_hops + 1):
        if frontier.isEmpty():
            break
        step = frontier.select("signal", "node").join(n, "node").select("signal", F.col("other").alias("node")).distinct()
        step = step.join(every.select("signal", "node"), ["signal", "node"], "left_anti")
        step = checkpointed(step.join(branching, "node", "left").select("signal", "node", F.coalesce("branch", F.lit(False)).alias("branch"), F.lit(hop).alias("hops")))
        every, frontier = every.unionByName(step), step.where("NOT branch")
    best = every.where("branch").groupBy("signal").agg(F.min(F.struct("hops", "node")).alias("b"))
    return best.select("signal", F.col("b.node").alias("junction"), "b.hops")


def stop_at(ax: Column, ay: Column, jx: Column, jy: Column, setback: float = SETBACK_M) -> Column:
    """Struct (x, y) on the approach, ``setback`` from the junction but not beyond the approach."""
    n = F.hypot(ax - jx, ay - jy)
    k = F.when(n > 1e-6, F.least(F.lit(setback), n) / n).otherwise(0.0)
    return F.struct((jx + (ax - jx) * k).alias("x"), (jy + (ay - jy) * k).alias("y"))


def movements(approaches: DataFrame, exits: DataFrame) -> DataFrame:
    """junction, movement, approach, exit, resolved and the geometry; an approach doesn't leave by its own road.

    approaches: junction, approach, ax, ay, jx, jy, known and, where it is told, stop (x, y); exits: junction, exit, ex,
    ey. Pairs meet per junction only.
    """
    j = approaches.join(exits, "junction")
    turn = geo.cosine(F.col("ax") - F.col("jx"), F.col("ay") - F.col("jy"), F.col("ex") - F.col("jx"), F.col("ey") - F.col("jy"))
    away = lambda x, y: F.hypot(x - F.col("jx"), y - F.col("jy")) > 1e-6
    j = j.where(turn < geo.SAME_DIRECTION).withColumn("resolved", F.col("known") & away(F.col("ax"), F.col("ay")) & away(F.col("ex"), F.col("ey")))
    j = j.withColumn("movement", F.concat("approach", F.lit("->"), "exit"))
    return j if "stop" in approaches.columns else j.withColumn("stop", stop_at(F.col("ax"), F.col("ay"), F.col("jx"), F.col("jy")))


def conflicts(moves: DataFrame) -> DataFrame:
    """(junction, a, b) with a < b: movements that may not run together."""
    side = lambda p: moves.select("junction", *[F.col(c).alias(f"{p}{c}") for c in ("movement", "approach", "exit", "resolved", "ax", "ay", "ex", "ey", "stop", "jx", "jy")])
    j = side("l_").join(side("r_"), "junction").where("l_movement < r_movement")
    c = lambda n: F.col(n)
    unit = lambda a, b, k: geo.cosine(c(a[0]) - c("l_jx"), c(a[1]) - c("l_jy"), c(b[0]) - c("l_jx"), c(b[1]) - c("l_jy")) <= -k
    la, ra, le, re = (("l_ax", "l_ay"), ("r_ax", "r_ay"), ("l_ex", "l_ey"), ("r_ex", "r_ey"))
    straight = unit(la, ra, geo.SAME_DIRECTION) & unit(la, le, geo.SAME_DIRECTION) & unit(ra, re, geo.SAME_DIRECTION)
    l0, r0 = (c("l_stop.x"), c("l_stop.y")), (c("r_stop.x"), c("r_stop.y"))
    l1, r1, mid = (c("l_ex"), c("l_ey")), (c("r_ex"), c("r_ey")), (c("l_jx"), c("l_jy"))
    lt, rt = geo.turn(*mid, *l0, *l1), geo.turn(*mid, *r0, *r1)
    opposed = (F.abs(lt) > 1e-6) & (F.abs(rt) > 1e-6) & ((lt > 0) != (rt > 0))
    meet = geo.segments_cross(l0, l1, r0, r1) | opposed
    same = (c("l_approach") == c("r_approach")) | (c("l_exit") == c("r_exit"))
    clash = F.when(~(c("l_resolved") & c("r_resolved")), True).when(same, True).when(straight, False).otherwise(meet)
    return j.where(clash).select("junction", F.col("l_movement").alias("a"), F.col("r_movement").alias("b"))


def phases(moves: DataFrame, clashes: DataFrame) -> DataFrame:
    """(junction, movement, phase): resolved movements in order of name, each in the first phase without a conflict.

    A greedy choice in order, so a junction at a time; a junction has few movements.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        clash = {(a, b) for a, b in zip(right["a"], right["b"], strict=True)}
        made: list[list[str]] = []
        out = []
        for m in sorted(left.loc[left["resolved"], "movement"]):
            free = (i for i, p in enumerate(made) if not any((min(m, x), max(m, x)) in clash for x in p))
            i = next(free, len(made))
            if i == len(made):
                made.append([])
            made[i].append(m)
            out.append((key[0], m, i))
        return pd.DataFrame(out, columns=["junction", "movement", "phase"])

    left = moves.select("junction", "movement", "resolved").groupBy("junction")
    right = clashes.select(F.col("junction").alias("at"), "a", "b").groupBy("at")
    return left.cogroup(right).applyInPandas(run, "junction long, movement string, phase long")


def signal_state(t: Column, n_phases: Column) -> Column:
    """Struct (phase, stage) after ``t`` seconds of a controller that starts all red: the cycle has a closed form."""
    length = sum(s for _, s in STAGES)
    into = t - n_phases * length * F.floor(t / (n_phases * length))
    rest = into - length * F.floor(into / length)
    stage, end = None, 0.0
    for name, s in STAGES:
        end += s
        stage = F.when(rest < end, name) if stage is None else stage.when(rest < end, name)
    return F.when(n_phases > 0, F.struct(F.floor(into / length).cast("int").alias("phase"), stage.alias("stage"))).otherwise(F.struct(F.lit(0).alias("phase"), F.lit("all_red").alias("stage")))


def distinct_by_direction(approaches: DataFrame, order: tuple[str, ...] = ("approach",)) -> DataFrame:
    """Approaches in order of name, without those that point as an earlier kept one does: an ordered fold per junction."""
    first = [*order, *([] if "approach" in order else ["approach"])]
    listed = approaches.groupBy("junction").agg(F.sort_array(F.collect_list(F.struct(*first, (F.col("ax") - F.col("jx")).alias("x"), (F.col("ay") - F.col("jy")).alias("y")))).alias("l"))
    alike = lambda a, b: geo.cosine(a["x"], a["y"], b["x"], b["y"]) >= geo.SAME_DIRECTION
    kept = F.aggregate(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), F.slice("l", 1, 1), lambda out, a: F.when(F.exists(out, lambda o: alike(o, a)), out).otherwise(F.concat(out, F.array(a))))
    return listed.select("junction", F.explode(kept).alias("k")).select("junction", "k.approach")


def chain_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows that differ from the row before of their key in x or y, as drawn lines need them."""
    w = Window.partitionBy(key).orderBy(order)
    same = (F.lag("x").over(w) == F.col("x")) & (F.lag("y").over(w) == F.col("y"))
    return rows.withColumn("_s", F.coalesce(same, F.lit(False))).where("NOT _s").drop("_s")


def junctions_of(edges: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approaches and exits of every branching node, from directed edges (source, target, way_id) and places (node, x, y).

    A node branches with three neighbours or more, whatever the ways are. An edge into it is an approach from its source,
    an edge out of it an exit to its target, named by way and node; approaches that point as an earlier one does are left out.
    """
    branching = neighbours(edges).groupBy("node").agg(F.count("*").alias("c")).where("c >= 3").select(F.col("node").alias("junction"))
    at = lambda name, *cols: places.select(F.col("node").alias(name), *[F.col(c).alias(n) for c, n in zip(("x", "y"), cols, strict=True)])
    name = lambda node: F.format_string("w%d:n%d", "way_id", node)
    into = edges.select("way_id", "source", F.col("target").alias("junction")).distinct().join(branching, "junction", "left_semi")
    into = into.join(at("source", "ax", "ay"), "source").join(at("junction", "jx", "jy"), "junction").select("junction", name("source").alias("approach"), "ax", "ay", "jx", "jy", F.lit(True).alias("known"))
    into = into.join(distinct_by_direction(into), ["junction", "approach"], "left_semi")
    out = edges.select("way_id", F.col("source").alias("junction"), "target").distinct().join(branching, "junction", "left_semi")
    return into, out.join(at("target", "ex", "ey"), "target").select("junction", name("target").alias("exit"), "ex", "ey")


def densest(approaches: DataFrame, moves: DataFrame, k: int = 5) -> DataFrame:
    """(junction, movements, approaches): the ``k`` junctions with the most movements, then approaches, then the smaller id."""
    n = moves.groupBy("junction").agg(F.count("*").alias("movements")).join(approaches.groupBy("junction").agg(F.count("*").alias("approaches")), "junction")
    return n.orderBy(F.col("movements").desc(), F.col("approaches").desc(), "junction").limit(k)


def _directions_source(source: Column, ways: Column, far: Column) -> Column:
    """How an approach belongs to its signal: as its record tells, else inferred where one way leads to it, else unresolved."""
    told = F.when(source.isin("explicit", "legacy"), "explicit").when((source == "inferred") | ((F.size(ways) == 1) & far), "inferred")
    return F.coalesce(told, F.lit("unresolved"))


def signalled(signals: DataFrame, edges: DataFrame, places: DataFrame, max_hops: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals grouped into junctions: (approaches, exits, unresolved).

    signals: signal (its name), node, ways (ids), direction_source, explicit_stop_line, x, y; edges: source, target,
    way_id, access, flags; places: node, x, y. A signal belongs to the branching node that is nearest by hops. One before
    its junction is an approach from where it stands; one at the junction on a single way is one from the farthest
    neighbour along it (to a micrometre; then the smaller id); one at the junction on two ways or more is an approach of every edge into it along those that may be
    driven. Of approaches that point alike the first stays: signals before the junction by name, then those at it. Exits
    are the edges out that may be driven. Signals without a junction, an approach or an exit are unresolved, by name.
    """
    s = checkpointed(signals.where("signal IS NOT NULL").withColumn("ways", F.array_sort(F.array_distinct(F.coalesce("ways", F.array().cast("array<long>"))))))
    edges = checkpointed(edges.select("source", "target", "way_id", "access", "flags"))
    legal = edges.where((F.col("access") == tags.NORMAL) & (F.col("flags").bitwiseAND(tags.AGAINST_ONEWAY) == 0)).select("way_id", "source", "target").distinct()
    near = nearest_junction(s.where("node IS NOT NULL").select(F.col("node").alias("signal")).distinct(), edges, max_hops).select(F.col("signal").alias("node"), "junction")
    spot = lambda name, x, y: places.select(F.col("node").alias(name), F.col("x").alias(x), F.col("y").alias(y))
    g = s.join(near, "node").join(spot("junction", "jx", "jy"), "junction").join(spot("node", "nx", "ny"), "node")
    g = checkpointed(g.withColumn("at", (F.col("node") == F.col("junction")) & (F.size("ways") >= 2)))

    before = g.where("NOT at").withColumn("stands", (F.col("node") != F.col("junction")) & (F.hypot(F.col("nx") - F.col("jx"), F.col("ny") - F.col("jy")) > 1.0))
    ends = edges.select(F.col("source").alias("junction"), F.col("target").alias("other"), "way_id").union(edges.select("target", "source", "way_id")).where("junction <> other").distinct()
    along = before.where("NOT stands").select("signal", "junction", "ways", "jx", "jy").join(ends, "junction").where((F.size("ways") == 0) | F.array_contains("ways", F.col("way_id")))
    along = along.join(spot("other", "ox", "oy"), "other").groupBy("signal").agg(F.min(F.struct((-F.round(F.hypot(F.col("ox") - F.col("jx"), F.col("oy") - F.col("jy")), 6)).alias("near"), "other", "ox", "oy")).alias("far"))
    before = before.join(along, "signal", "left").withColumn("ax", F.coalesce("far.ox", "nx")).withColumn("ay", F.coalesce("far.oy", "ny"))
    relation = _directions_source(F.col("direction_source"), F.col("ways"), F.hypot(F.col("ax") - F.col("jx"), F.col("ay") - F.col("jy")) > 1.0)
    stop = F.when(F.col("explicit_stop_line"), F.struct("x", "y")).otherwise(stop_at(F.col("ax"), F.col("ay"), F.col("jx"), F.col("jy")))
    columns = ["junction", "approach", "signal", "ways", "ax", "ay", "jx", "jy", "relationship", "stop_source", "stop", "_at", "_from", "_way"]
    nothing = F.lit(None).cast("long")
    before = before.withColumns({
        "approach": F.concat(F.lit("approach:"), "signal"), "relationship": relation, "stop": stop, "stop_source": F.when(F.col("explicit_stop_line"), "explicit").otherwise("derived"),
        "_at": F.lit(0), "_from": nothing, "_way": nothing,
    }).select(*columns)

    into = g.where("at").join(legal.select(F.col("target").alias("junction"), F.col("source").alias("_from"), F.col("way_id").alias("_way")), "junction").where(F.array_contains("ways", F.col("_way")))
    into = into.join(spot("_from", "ax", "ay"), "_from").withColumns({
        "approach": F.concat(F.lit("approach:"), "signal", F.format_string(":w%d:n%d", "_way", "_from")), "relationship": F.lit("inferred"), "stop_source": F.lit("derived"),
        "stop": stop_at(F.col("ax"), F.col("ay"), F.col("jx"), F.col("jy")), "ways": F.array("_way"), "_at": F.lit(1),
    }).select(*columns)

    every = before.unionByName(into)
    out = legal.withColumnRenamed("source", "junction").join(g.select("junction").distinct(), "junction", "left_semi")
    out = out.join(spot("target", "ex", "ey"), "target").select("junction", F.format_string("w%d:n%d", "way_id", "target").alias("exit"), "ex", "ey")
    every = checkpointed(every.join(out.select("junction").distinct(), "junction", "left_semi"))
    kept = every.join(distinct_by_direction(every, ("_at", "signal", "_from", "_way")), ["junction", "approach"], "left_semi")
    known = F.col("relationship") != "unresolved"
    kept = kept.select("junction", "approach", "signal", "ways", "ax", "ay", "jx", "jy", known.alias("known"), "relationship", "stop_source", "stop")
    lost = s.join(every.select("signal").distinct(), "signal", "left_anti").select("signal").distinct()
    return kept, out.join(every.select("junction").distinct(), "junction", "left_semi"), lost

"""Observations over time: latest known state, staleness, hysteresis, tumbling windows and greedy dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.session import Scratch

from .prefix import carried, composed, rank_in_group

#: Seconds after which an observation is stale, and the tie limit of a dispatch.
STALE_S, TIE = 10.0, 1e-6
#: Fixed values, in metres: a view comes nearer than the first and goes beyond the second; where a first view lies.
LOD_FAR_M, LOD_NEAR_M, LOD_FIRST_M = (155_000.0, 205_000.0), (38_000.0, 56_000.0), (180_000.0, 45_000.0)


def accepted(obs: DataFrame, key: str, arrival: str, t: str) -> DataFrame:
    """Observations in order of arrival that are not older than the latest one accepted before; equal times are.

    The latest time before a row is carried over range partitions, so a key of any size is split over tasks.
    """
    before = carried(obs, key, [arrival], {"_l": ("max", F.col(t))}, own=False)
    return before.where(F.col("_l").isNull() | (F.col(t) >= F.col("_l"))).drop("_l")


def latest_at(requests: DataFrame, obs: DataFrame, key: str, bucket_s: float = 3600.0, stale_s: float = STALE_S) -> DataFrame:
    """(request, latest observation, age_s, stale): as-of join of requests (key, request, now) with observations (key, t, event_id).

    Both sides are cut into time buckets. A request takes the last observation of its own bucket, in one walk over both in
    the order of time, and else the last one of the buckets before, which a window over one row per key and bucket carries
    forward: no request meets more than one row. One without a key, a time or an observation before has a null event, age 0,
    and isn't stale.
    """
    o = obs.where(F.col(key).isNotNull() & F.col("t").isNotNull()).withColumn("_b", F.floor(F.col("t") / bucket_s))
    last = o.groupBy(key, "_b").agg(F.max(F.struct("t", "event_id")).alias("_last"))
    r = requests.withColumn("_b", F.floor(F.col("now") / bucket_s))
    seen = o.select(key, "_b", F.col("t").alias("_at"), F.lit(0).alias("_k"), F.col("event_id").alias("_id"), F.struct("t", "event_id").alias("_own"))
    both = seen.unionByName(r.select(key, "_b", F.col("now").alias("_at"), F.lit(1).alias("_k"), "request", "now"), allowMissingColumns=True)
    so_far = Window.partitionBy(key, "_b").orderBy("_at", "_k", "_id").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_own", ignorenulls=True).over(so_far)).where("_k = 1")
    marks = last.unionByName(r.select(key, "_b", F.lit(None).cast(last.schema["_last"].dataType).alias("_last")))
    marks = marks.groupBy(key, "_b").agg(F.max("_last").alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.select(key, "_b", carried.alias("_before"))
    out = own.join(marks, [key, "_b"], "left").withColumn("_o", F.coalesce("_own", "_before"))
    age = F.greatest(F.lit(0.0), F.col("now") - F.col("_o.t"))
    return out.select("request", key, F.col("_o.event_id").alias("event_id"), age.alias("age_s"), (age > stale_s).alias("stale"))


def tumbling(obs: DataFrame, ts: str, value: str, width: str = "1 hour") -> DataFrame:
    """(start, n, avg, max) for each window with rows."""
    w = obs.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max"))
    return w.select(F.col("w.start").alias("start"), "n", "avg", "max")


def nearest_rank(rows: DataFrame, value: str, group: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """(group, n and each name in ``wanted``): order statistics, nothing interpolated.

    A name asks for a share and a rounding: position ceil(share * n) - 1, or round(share * (n - 1)), half to even. All
    rows are ranked once over range partitions, so a few large groups are as good as many small ones.
    """
    r = rank_in_group(Scratch(rows.sparkSession), rows.select(group, value), [group], [value], "ranked")
    at = lambda share, how: F.ceil(F.col("n") * share) - 1 if how == "ceil" else F.bround(share * (F.col("n") - 1)).cast("long")
    picked = [F.max(F.when(F.col("place") == at(*ask), F.col(value))).alias(name) for name, ask in wanted.items()]
    return r.groupBy(group, "n").agg(*picked)


def three_bands(rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """Add ``lod``: 0 far, 1 middle, 2 near, with different limits for coming and going; a key's first row goes by plain limits."""
    far, near, first = LOD_FAR_M, LOD_NEAR_M, LOD_FIRST_M
    start = F.when(value > first[0], 0).when(value > first[1], 1).otherwise(2)
    step = F.array(
        F.when(value < far[0], 1).otherwise(0), F.when(value > far[1], 0).when(value < near[0], 2).otherwise(1), F.when(value > near[1], 1).otherwise(2), start
    )
    return composed(rows, key, [order], step, 3, "lod")


def transitions(rows: DataFrame, tick: str, order: str, distance: Column, detailed: Column, near: float, far: float, most: int) -> DataFrame:
    """Rows that change this tick, with ``action``: promote within ``near``, demote beyond ``far``, at most ``most`` of each, in order."""
    action = F.when(~detailed & (distance <= near), "promote").when(detailed & (distance >= far), "demote")
    asked = rows.withColumn("action", action).where("action IS NOT NULL")
    return rank_in_group(Scratch(rows.sparkSession), asked, [tick, "action"], [order], "asked").where(F.col("place") < most).drop("place", "n")


def peaks(rows: DataFrame, key: str, order: str, value: str, consumed: Column) -> DataFrame:
    """(key, reading, n, total, peak): counters between readings; a row that reads takes what came before it and starts anew."""
    x = carried(rows, key, [order], {"_read": ("sum", consumed.cast("int"))}, own=False)
    x = x.withColumn("reading", F.coalesce("_read", F.lit(0).cast("long")))
    return x.groupBy(key, "reading").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak"))


def hysteresis(rows: DataFrame, key: str, order: str, value: Column, up: float, down: float) -> DataFrame:
    """Add ``high``: on above ``up``, off below ``down``, unchanged in between; off at the start.

    The state at a row is set by the last row outside the band, which is carried over range partitions: no fold is needed,
    and a key of any size is split over tasks.
    """
    told = F.when(value > up, True).when(value < down, False)
    return carried(rows, key, [order], {"_told": ("last", told)}, own=True).withColumn("high", F.coalesce("_told", F.lit(False))).drop("_told")


def greedy_dispatch(incidents: DataFrame, units: DataFrame, zone: str = "zone") -> DataFrame:
    """(zone, incident, unit, distance_m): incidents by priority, then sequence, each get the nearest free unit of their role.

    incidents: zone, incident, x, y, priority, role, sequence; units: zone, unit, role, x, y. A zone with u units of a role
    serves its first u incidents of that role, and only those are worked on. In each round every open incident asks for
    the nearest unit that no earlier one holds, and each unit keeps the earliest that asks; who is turned away asks again.
    As all units prefer incidents alike, this ends with what serving one after the other gives. Distances within ``TIE``
    are equal, and the smaller unit is taken. Incidents that get no unit have none.
    """
    scratch = Scratch(incidents.sparkSession)
    queue = rank_in_group(scratch, incidents, [zone, "role"], [F.col("priority").desc(), "sequence"], "queue").drop("n")
    free = units.groupBy(zone, "role").agg(F.count("*").alias("_units"))
    served = queue.join(free, [zone, "role"]).where(F.col("place") < F.col("_units")).select(zone, "role", "incident", "place", "x", "y")
    served, n = scratch.save_counted(served, "served")
    u = scratch.save(units.select(zone, "role", "unit", F.col("x").alias("_ux"), F.col("y").alias("_uy")), "units")
    held = scratch.save(served.limit(0).select(zone, F.lit(None).cast(units.schema["unit"].dataType).alias("unit"), "place", "incident", F.lit(0.0).alias("d")), "held0")
    open_, k = served, 0
    while n:
        k += 1
        asked = open_.join(u, [zone, "role"]).join(held.select(zone, "unit", F.col("place").alias("_by")), [zone, "unit"], "left")
        d = F.hypot(F.col("x") - F.col("_ux"), F.col("y") - F.col("_uy"))
        asked = asked.where("_by IS NULL OR _by > place").withColumn("d", d).groupBy(zone, "incident", "place").agg(F.min(F.struct(F.round(F.col("d") / TIE).alias("near"), "unit", "d")).alias("b"))
        every = held.unionByName(asked.select(zone, "b.unit", "place", "incident", "b.d"))
        kept = every.groupBy(zone, "unit").agg(F.min(F.struct("place", "incident", "d")).alias("b")).select(zone, "unit", "b.*")
        held = scratch.save(kept, f"held{k}")
        open_, n = scratch.save_counted(served.join(held.select(zone, "incident"), [zone, "incident"], "left_anti"), f"open{k}")
        scratch.drop(f"held{k - 1}", *([f"open{k - 1}"] if k > 1 else []))
    return incidents.select(zone, "incident").join(held.select(zone, "incident", "unit", F.col("d").alias("distance_m")), [zone, "incident"], "left").select(zone, "incident", "unit", "distance_m")


#: The states of a unit, in the order of their numbers.
STATES = ("patrol", "observe", "stop", "pursuit")


def offence_steps(obs: DataFrame, key: str, handoff_s: float = 6.0) -> DataFrame:
    """(event_id, key, state) after each row (patrol, observe, stop, pursuit) from columns t, current, offence and complied.

    A row that sees an offence starts a stop attempt; later time without one runs towards the handoff to a pursuit. The
    attempt's start is the last offence seen before, whatever the state, so each row's map of states is known beforehand.
    """
    seen_at = F.when(F.col("current") & F.col("offence"), F.col("t"))
    x = carried(obs, key, ["t", "event_id"], {"_seen": ("last", seen_at)}, own=False).withColumn("_since", F.coalesce("_seen", F.lit(0.0)))
    patrol, observe, stop, pursuit = range(4)
    stopped = F.when(F.col("complied"), observe).when(F.col("t") - F.col("_since") >= handoff_s, pursuit).otherwise(stop)
    seen = lambda s: F.when(F.col("offence"), stop).when(s == patrol, observe).otherwise(s)
    unseen = lambda s: F.when(s == observe, patrol).otherwise(s)
    step = F.array(*[F.when(F.col("current"), seen(s)).otherwise(unseen(s)) for s in (F.lit(patrol), F.lit(observe), stopped, F.lit(pursuit))])
    x = composed(x, key, ["t", "event_id"], step, 0, "state")
    return x.select("event_id", key, F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("state") + 1).alias("state"))


def search_radius(age_s: Column) -> Column:
    return F.greatest(F.lit(4.0), F.least(F.lit(140.0), 4 + 4.5 * age_s))


def pursuit_horizon(speed: Column) -> Column:
    return F.greatest(F.lit(1.5), F.least(F.lit(4.0), 1.5 + 0.12 * speed))

"""Signals: the ways that they stand on, by node and by coordinate, their records and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.tags import cleaned

#: Directions that a signal's own tag and the older tag may name, and where a direction comes from.
DIRECTIONS, OLD_DIRECTIONS = ("forward", "backward", "both"), ("forward", "backward")
SOURCES = ("explicit", "legacy", "inferred", "unknown")
#: Fixed value: steps of a degree in which places are compared.
STEPS = 10_000_000.0


def memberships(signals: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """(signal, ways): the distinct ways through each signal's node, ascending; signals on no way have an empty list."""
    met = signals.select("signal").join(way_nodes.select(F.col("node_id").alias("signal"), "way_id").distinct(), "signal", "left")
    return met.groupBy("signal").agg(F.sort_array(F.collect_list("way_id")).alias("ways"))


def memberships_by_place(signals: DataFrame, vertices: DataFrame) -> DataFrame:
    """As ``memberships``, where only places tell nodes: signal, lon, lat and way_id, lon, lat meet in steps of 1e-7 degrees."""
    v = vertices.select("way_id", place("lon").alias("_x"), place("lat").alias("_y")).distinct()
    met = signals.select("signal", place("lon").alias("_x"), place("lat").alias("_y")).join(v, ["_x", "_y"], "left")
    return met.groupBy("signal").agg(F.sort_array(F.collect_set("way_id")).alias("ways"))


def ways_by_place(vertices: DataFrame) -> DataFrame:
    """(_x, _y, ways): the distinct ways with a vertex (way_id, lon, lat) in each place, in the steps of ``memberships_by_place``, ascending."""
    v = vertices.select("way_id", *[place(c).alias(n) for c, n in (("lon", "_x"), ("lat", "_y"))])
    return v.groupBy("_x", "_y").agg(F.sort_array(F.collect_set("way_id")).alias("ways"))


def place(degrees: str) -> Column:
    """A coordinate in whole steps."""
    return F.round(F.col(degrees) * STEPS).cast("long")


def direction(tags: Column) -> Column:
    """Struct (direction, source) from a signal's tags."""
    own, old = cleaned(tags["traffic_signals:direction"]), cleaned(tags["direction"])
    told = lambda value, source: F.struct(value.alias("direction"), F.lit(source).alias("source"))
    return F.when(own.isin(*DIRECTIONS), told(own, "explicit")).when(old.isin(*OLD_DIRECTIONS), told(old, "legacy")).otherwise(told(F.lit(None).cast("string"), "unknown"))


def records(signals: DataFrame, ways: DataFrame) -> DataFrame:
    """A record of each signal (signal, tags). A signal on two ways or more is a candidate for a junction of its own."""
    r = signals.join(ways, "signal").withColumn("d", direction(F.col("tags"))).withColumn("n_ways", F.size("ways"))
    candidate = F.when(F.col("n_ways") >= 2, F.concat(F.lit("junction-node:"), F.col("signal").cast("string")))
    stop = F.coalesce(F.col("tags")["road_marking"] == "stop_line", F.lit(False))
    kind = F.trim(F.col("tags")["traffic_signals"])
    return r.select(
        F.concat(F.lit("n"), F.col("signal").cast("string")).alias("id"), "signal", "ways", "n_ways", F.col("d.direction").alias("direction"), F.col("d.source").alias("direction_source"),
        stop.alias("explicit_stop_line"), F.when(kind != "", kind).alias("signal_type"), candidate.alias("group_candidate_id"),
    )


def counts(records: DataFrame) -> DataFrame:
    """One row of counts over records; a source that does not occur counts 0."""
    of = [F.count_if(F.col("direction_source") == s).alias(f"{s}_direction_count") for s in SOURCES]
    grouped = F.col("group_candidate_id").isNotNull()
    return records.agg(
        F.count("*").alias("signal_count"), *of, F.count_if("explicit_stop_line").alias("explicit_stop_line_count"), F.count_if(grouped).alias("grouped_candidate_count"), F.count_if(~grouped).alias("ungrouped_candidate_count"),
    )

"""A snap index and an index of incoming edges as bucketed tables: joins with points or nodes shuffle these alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.tags import AGAINST_ONEWAY, NORMAL

from . import spatial


def _bucketed(df: DataFrame, table: str, path: str, keys: list[str], then: str, buckets: int) -> DataFrame:
    """A table of one file a bucket, sorted by its keys."""
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, then)
    writer.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_index(edges: DataFrame, table: str, path: str, size: float = 256.0, buckets: int = 8) -> tuple[DataFrame, DataFrame]:
    """The tables ``table``_snap and ``table``_incoming of directed edges (edge, source, target, way_id, access, flags, length_m, ax, ay, bx, by).

    Snap: each physical edge that may be driven, once (of both directions the smaller number), in every cell that its box
    touches, with its ends, so that a lookup needs no other table. Incoming: the edges into each node. ``buckets`` should
    grow with the edges: a bucket is one file, and one task reads it.
    """
    legal = edges.where((F.col("access") == NORMAL) & (F.col("flags").bitwiseAND(AGAINST_ONEWAY) == 0))
    one = legal.groupBy("way_id", F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b")).agg(F.min(F.struct("edge", "source", "target", "ax", "ay", "bx", "by")).alias("e"))
    snap = _bucketed(spatial.segment_cells(one.select("e.*"), size), f"{table}_snap", f"{path}/snap", ["cx", "cy"], "edge", buckets)
    incoming = _bucketed(edges.select("target", "edge", "source", "length_m"), f"{table}_incoming", f"{path}/incoming", ["target"], "edge", buckets)
    return snap, incoming


def snapped(points: DataFrame, snap: DataFrame, max_m: float = 250.0, size: float = 256.0) -> DataFrame:
    """As ``spatial.nearest_segment``, from the snap table, which stays where it is."""
    return spatial.nearest_in_cells(points, snap, max_m, size)

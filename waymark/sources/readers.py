"""Sources: map XML, GeoPackage layers, JSON lines and Parquet facts, each with a declared schema, chosen by suffix."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_NODE = "_id BIGINT, _lat DOUBLE, _lon DOUBLE"
_WAY = "_id BIGINT, nd ARRAY<STRUCT<_ref: BIGINT>>, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
POI = "osm_type STRING, osm_id BIGINT, x DOUBLE, y DOUBLE, tags MAP<STRING, STRING>"
ADDRESS = "osm_type STRING, osm_id BIGINT, street STRING, housenumber STRING, postcode STRING, locality STRING, x DOUBLE, y DOUBLE"
SEARCH = "id STRING, kind STRING, display STRING, x DOUBLE, y DOUBLE, subtitle STRING, search STRING"
_RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
HIGHWAY = "way_id BIGINT, node_ids ARRAY<BIGINT>, lons ARRAY<DOUBLE>, lats ARRAY<DOUBLE>, tags MAP<STRING, STRING>"
AREA = f"osm_type STRING, osm_id BIGINT, tags MAP<STRING, STRING>, polygons ARRAY<STRUCT<`outer`: {_RING}, holes: ARRAY<{_RING}>>>"
SIGNAL = "osm_id BIGINT, lon DOUBLE, lat DOUBLE, tags MAP<STRING, STRING>"
ROAD_TILE = "lod INT, tx INT, ty INT, road_class INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
GRAPH_NODE = "node_id BIGINT, node_index BIGINT, adjacency_offset BIGINT, adjacency_count BIGINT"
GRAPH_EDGE = "way_id BIGINT, segment BIGINT, source BIGINT, target BIGINT, length_m DOUBLE, kmh DOUBLE, road_class INT, access INT, reason INT, flags INT, layer INT, explicit BOOLEAN"
FACTS = {
    "pois": POI, "addresses": ADDRESS, "search": SEARCH, "highways": HIGHWAY, "areas": AREA, "road_tiles": ROAD_TILE, "graph_nodes": GRAPH_NODE, "graph_edges": GRAPH_EDGE,
    "signals": SIGNAL,
}


def xml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, lon, lat."""
    rows = spark.read.schema(_NODE).format("xml").option("rowTag", "node").load(path)
    return rows.select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))


def _xml_ways(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_WAY).format("xml").option("rowTag", "way").load(path)


def xml_ways(spark: SparkSession, path: str) -> DataFrame:
    """way_id, tags; of repeated keys the last counts."""
    last = F.aggregate(
        F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), F.array().cast("array<struct<_k:string,_v:string>>"), lambda out, e: F.concat(F.filter(out, lambda o: o["_k"] != e["_k"]), F.array(e))
    )
    return _xml_ways(spark, path).select(F.col("_id").alias("way_id"), F.map_from_entries(last).alias("tags"))


def xml_way_nodes(spark: SparkSession, path: str) -> DataFrame:
    """way_id, pos (from 0), node_id."""
    rows = _xml_ways(spark, path).select(F.col("_id").alias("way_id"), F.posexplode("nd").alias("pos", "nd"))
    return rows.select("way_id", "pos", F.col("nd._ref").alias("node_id"))


def json_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Facts of a kind from JSON lines; a line that is not of its schema stops the read."""
    return spark.read.schema(FACTS[kind]).option("mode", "FAILFAST").json(path)


def parquet_facts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(FACTS[kind]).parquet(path)


def tiles(spark: SparkSession, path: str, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """Rows of the tiles tx, ty in a range; other tiles' files are not opened."""
    return spark.read.parquet(path).where(F.col("tx").between(x1, x2) & F.col("ty").between(y1, y2))


READERS: dict[str, Callable[..., DataFrame]] = {".jsonl": json_lines, ".json": json_lines, ".parquet": parquet_facts}


def facts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Facts from a file or folder, by its suffix."""
    suffix = next((s for s in READERS if path.rstrip("/").endswith(s)), None)
    if suffix is None:
        raise ValueError(f"no reader for {path}; known suffixes: {', '.join(sorted(READERS))}")
    return READERS[suffix](spark, path, kind)


def named_pois(pois: DataFrame) -> DataFrame:
    """Search records of points with a name, brand or operator."""
    filled = lambda k: F.when(F.trim(F.col("tags")[k]) != "", F.trim(F.col("tags")[k]))
    r = pois.withColumn("display", F.coalesce(filled("name"), filled("brand"), filled("operator"))).where("display IS NOT NULL")
    identity = F.concat_ws(":", F.lit("poi"), "osm_type", F.col("osm_id").cast("string"))
    subtitle = F.coalesce(*[filled(k) for k in ("amenity", "shop", "tourism", "leisure")], F.lit(""))
    return r.select(identity.alias("id"), F.lit("poi").alias("kind"), "display", "x", "y", subtitle.alias("subtitle"), F.lit(None).cast("string").alias("search"))


def geometry_wkb(blob: Column) -> Column:
    """The WKB inside a GeoPackage geometry: its header has 8 bytes and an envelope whose size the flags tell."""
    flags = F.conv(F.hex(F.substring(blob, 4, F.lit(1))), 16, 10).cast("int")
    envelope = F.element_at(F.array(*[F.lit(n) for n in (0, 32, 48, 48, 64)]), F.shiftright(flags, 1).bitwiseAND(7) + 1)
    return F.when(F.substring(blob, 1, F.lit(2)) == F.lit(b"GP"), F.substring(blob, envelope + 9, F.length(blob)))


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _LayerReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.layer, self.names = options["path"], options["layer"], schema.names
        self.rows = int(options.get("rows_per_partition", 100_000))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[_Range]:
        with self._open() as c:
            if not c.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (self.layer,)).fetchone():
                raise ValueError(f"{self.path} has no layer {self.layer}")
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.layer}"').fetchone()
        return [_Range(k, k + self.rows - 1) for k in range(low, high + 1, self.rows)] if low is not None else []

    def read(self, partition: _Range) -> Iterator[tuple]:
        columns = ", ".join(f'"{n}"' for n in self.names)
        with self._open() as c:
            yield from c.execute(f'SELECT {columns} FROM "{self.layer}" WHERE rowid BETWEEN ? AND ?', (partition.first, partition.last))


class GeoPackageLayer(DataSource):
    """``spark.read.format("gpkg").schema(...).option("layer", name).load(path)``: a layer by ranges of row ids.

    The file has to be at the same path on every executor, as SQLite reads no other store.
    """

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        raise ValueError("declare the layer's schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LayerReader(schema, self.options)


def geopackage(spark: SparkSession, path: str, layer: str, schema: str) -> DataFrame:
    spark.dataSource.register(GeoPackageLayer)
    return spark.read.format("gpkg").schema(schema).option("layer", layer).load(path)


def layers(named: dict[str, DataFrame]) -> DataFrame:
    """Layers of one map as one table with the column ``layer``; a column that a layer lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("layer", F.lit(name)) for name, df in named.items()])


def without_relations(facts: DataFrame, areas: DataFrame) -> DataFrame:
    """Facts but for relations; those that come back as areas (osm_type, osm_id) stay."""
    known = areas.select("osm_type", "osm_id").distinct()
    relation = facts.where("osm_type = 'relation'")
    return facts.where("osm_type <> 'relation'").unionByName(relation.join(known, ["osm_type", "osm_id"], "left_semi"))

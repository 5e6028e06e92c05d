"""Tables of the right shape from the driver's tables, which hold no map: each has the same rows in Spark and in SQL.

Orders become ways whose nodes are the parts of their lines, customers and suppliers become addresses and points, events
become observations. The expressions below are plain SQL that both engines read; what is computed from them is not shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.tags import ROAD_SPEEDS

_TYPES = ", ".join(f"'{k}'" for k in ROAD_SPEEDS)
#: Way tags by column, from an order. Orders whose key ends beyond the types have a type that is no road.
WAY_TAGS = {
    "highway": "CASE o_orderkey % 27 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(ROAD_SPEEDS)) + " ELSE 'proposed' END",
    "maxspeed": "CASE o_custkey % 10 WHEN 1 THEN '50' WHEN 2 THEN '50 mph' WHEN 3 THEN 'signals' WHEN 4 THEN '30;50' WHEN 5 THEN '20 knots'"
    " WHEN 6 THEN '7,5 km/h' WHEN 7 THEN '0' WHEN 8 THEN ' 80 ' END",
    "oneway": "CASE o_orderkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END",
    "junction": "CASE WHEN o_orderkey % 10 = 3 THEN 'roundabout' END",
    "motorcar": "CASE o_custkey % 11 WHEN 0 THEN 'no' WHEN 6 THEN 'yes' END",
    "motor_vehicle": "CASE o_custkey % 11 WHEN 1 THEN 'No' WHEN 5 THEN 'yes' END",
    "vehicle": "CASE o_custkey % 11 WHEN 2 THEN 'private' END",
    "access": "CASE o_custkey % 11 WHEN 3 THEN 'destination' WHEN 4 THEN 'customers' WHEN 6 THEN 'private' WHEN 7 THEN 'no' END",
    "layer": "CASE o_custkey % 8 WHEN 1 THEN '1' WHEN 2 THEN '-2' WHEN 3 THEN '1.5' WHEN 4 THEN 'x' WHEN 5 THEN '300' END",
    "bridge": "CASE WHEN o_orderkey % 9 = 0 THEN 'yes' WHEN o_orderkey % 9 = 1 THEN 'no' END",
    "tunnel": "CASE WHEN o_orderkey % 13 = 0 THEN 'yes' END",
}
NODE_LON, NODE_LAT = "13.0 + (p_partkey % 97) * 0.0013", "55.0 + (p_partkey % 89) * 0.0007"
#: Points of interest from parts: tags by column.
POI_TAGS = {
    "amenity": "CASE p_partkey % 17 WHEN 0 THEN 'police' WHEN 1 THEN 'hospital' WHEN 2 THEN 'fuel' WHEN 3 THEN 'cafe' WHEN 4 THEN 'bench' WHEN 5 THEN 'school' WHEN 6 THEN 'atm' END",
    "shop": "CASE p_partkey % 19 WHEN 0 THEN 'supermarket' WHEN 1 THEN 'car_repair' WHEN 2 THEN 'hairdresser' END",
    "tourism": "CASE p_partkey % 23 WHEN 0 THEN 'museum' WHEN 1 THEN 'hotel' WHEN 2 THEN 'artwork' END",
    "highway": "CASE p_partkey % 29 WHEN 0 THEN 'bus_stop' WHEN 1 THEN 'speed_camera' WHEN 2 THEN 'residential' END",
    "railway": "CASE p_partkey % 31 WHEN 0 THEN 'station' WHEN 1 THEN 'platform' END",
    "camera:type": "CASE WHEN p_partkey % 37 = 0 THEN 'fixed' END",
    "natural": "CASE p_partkey % 12 WHEN 0 THEN 'water' WHEN 1 THEN 'wood' WHEN 2 THEN 'tree' END",
    "landuse": "CASE p_partkey % 14 WHEN 0 THEN 'forest' WHEN 1 THEN 'meadow' WHEN 2 THEN 'retail' WHEN 3 THEN 'basin' END",
    "boundary": "CASE WHEN p_partkey % 41 = 0 THEN 'administrative' END",
    "admin_level": "CASE WHEN p_partkey % 82 = 0 THEN '2' WHEN p_partkey % 41 = 0 THEN '4' END",
    "building": "CASE WHEN p_partkey % 3 = 0 THEN 'yes' END",
    "height": "CASE p_size % 5 WHEN 1 THEN '12,5 m' WHEN 2 THEN 'about 7' WHEN 3 THEN '500' WHEN 4 THEN '1-2' END",
    "building:levels": "CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR(9)) END",
    "addr:housenumber": "CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR(9)) WHEN p_partkey % 8 = 0 THEN ' ' END",
    "addr:street": "CASE WHEN p_partkey % 5 = 0 THEN '  ' WHEN p_partkey % 5 < 4 THEN p_brand END",
    "addr:place": "CASE WHEN p_partkey % 7 = 0 THEN p_type END",
}
#: A part's place on the plane, in metres.
POI_X, POI_Y = "(p_partkey * 37) % 20011 - 10000.0 + p_size * 0.5", "(p_partkey * 91) % 20021 - 10000.0 + p_size * 0.25"
CUSTOMER_X, CUSTOMER_Y = "(c_custkey * 53) % 20011 - 10000.0 + 0.5", "(c_custkey * 71) % 20021 - 10000.0 + 0.25"
SUPPLIER_X, SUPPLIER_Y = "(s_suppkey * 457) % 20011 - 10000.0", "(s_suppkey * 823) % 20021 - 10000.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag_map(tags: dict[str, str]):
    pairs = ", ".join(f"'{k}', {v}" for k, v in tags.items())
    return F.map_filter(F.expr(f"map({pairs})"), lambda _, v: v.isNotNull())


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, tags."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"), _tag_map(WAY_TAGS).alias("tags"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (the order), n (from 1; line numbers may repeat), part, supp, quantity."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity"))
    return rows


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos (from 1), node_id."""
    return lines(spark, sf_dir).select(F.col("id").alias("way_id"), F.col("n").alias("pos"), F.col("part").alias("node_id"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, lon, lat."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.expr(NODE_LON).cast("double").alias("lon"), F.expr(NODE_LAT).cast("double").alias("lat"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poi_id, x, y, tags, name."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("poi_id"), F.expr(POI_X).cast("double").alias("x"), F.expr(POI_Y).cast("double").alias("y"), _tag_map(POI_TAGS).alias("tags"), F.col("p_name").alias("name")
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y and the customer's columns."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(CUSTOMER_X).cast("double").alias("x"), F.expr(CUSTOMER_Y).cast("double").alias("y"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y and the supplier's columns."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(SUPPLIER_X).cast("double").alias("x"), F.expr(SUPPLIER_Y).cast("double").alias("y"), "s_name", "s_nationkey")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, unit, t (seconds, double), kind, value: the events as sightings."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("unit"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_type").alias("kind"), "value", "ts")


# The same tables in SQL.
WAYS = "ways AS (SELECT o_orderkey AS way_id, " + ", ".join(f"{v} AS {k}" for k, v in WAY_TAGS.items()) + " FROM orders)"
LINES = """lines AS (SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS n,
  l_partkey AS part, l_suppkey AS supp, l_quantity AS quantity FROM lineitem)"""
WAY_NODES = f"{LINES}, way_nodes AS (SELECT id AS way_id, n AS pos, part AS node_id FROM lines)"
NODES = f"nodes AS (SELECT p_partkey AS node_id, CAST({NODE_LON} AS DOUBLE) AS lon, CAST({NODE_LAT} AS DOUBLE) AS lat FROM part)"
POIS = f"pois AS (SELECT p_partkey AS poi_id, CAST({POI_X} AS DOUBLE) AS x, CAST({POI_Y} AS DOUBLE) AS y, p_name AS name, " + ", ".join(f'{v} AS "{k}"' for k, v in POI_TAGS.items()) + " FROM part)"
CUSTOMERS = f"customers AS (SELECT c_custkey AS id, CAST({CUSTOMER_X} AS DOUBLE) AS x, CAST({CUSTOMER_Y} AS DOUBLE) AS y, * FROM customer)"
SUPPLIERS = f"suppliers AS (SELECT s_suppkey AS id, CAST({SUPPLIER_X} AS DOUBLE) AS x, CAST({SUPPLIER_Y} AS DOUBLE) AS y, * FROM supplier)"
OBSERVATIONS = "obs AS (SELECT event_id, user_id AS unit, epoch_us(ts) / 1e6 AS t, event_type AS kind, value, ts FROM events)"

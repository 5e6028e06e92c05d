"""Readers, writers, streams and build plans."""

import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from waymark.operators import graph, sightings
from waymark.plans import build
from waymark.sources import readers, writers
from waymark.streaming import events

XML = """<?xml version="1.0"?><osm>
<node id="1" lat="-3.1" lon="40.5"/><node id="2" lat="-3.2" lon="40.6"/><node id="3" lat="-3.3" lon="40.6"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="oneway" v="yes"/></way>
<way id="11"><nd ref="1"/><nd ref="99"/><tag k="highway" v="residential"/></way>
</osm>"""


def test_xml(spark, tmp_path):
    p = tmp_path / "map.osm"
    p.write_text(XML)
    path = str(p)
    edges = graph.detailed_edges(readers.xml_ways(spark, path), readers.xml_way_nodes(spark, path), readers.xml_nodes(spark, path))
    assert sorted((r["way_id"], r["source"], r["target"], r["flags"]) for r in edges.collect()) == [(10, 1, 2, 0), (10, 2, 1, 1), (10, 2, 3, 0), (10, 3, 2, 1)]


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "map.gpkg")
    point = struct.pack("<BIdd", 1, 1, 13.2, 55.7)
    box = struct.pack("<4d", 13.2, 13.2, 55.7, 55.7)
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE points (fid INTEGER PRIMARY KEY, osm_id TEXT, geom BLOB, other_tags TEXT)")
        c.execute("INSERT INTO points VALUES (1, '100', ?, '\"amenity\"=>\"police\"')", (b"GP\0\1" + b"\0" * 4 + point,))
        c.execute("INSERT INTO points VALUES (2, '200', ?, NULL)", (b"GP\0\3" + b"\0" * 4 + box + point,))
    df = readers.geopackage(spark, path, "points", "osm_id string, geom binary, other_tags string")
    rows = df.select("osm_id", readers.geometry_wkb(F.col("geom")).alias("wkb")).orderBy("osm_id").collect()
    assert [(r["osm_id"], bytes(r["wkb"])) for r in rows] == [("100", point), ("200", point)]
    with pytest.raises(Exception, match="no layer"):
        readers.geopackage(spark, path, "lines", "osm_id string").count()


def test_json_lines(spark, tmp_path):
    p = tmp_path / "pois.jsonl"
    rows = [
        {"osm_type": "way", "osm_id": 31, "x": -7.5, "y": 2.25, "tags": {"brand": "Blue Kettle", "shop": "tea"}},
        {"osm_type": "node", "osm_id": 32, "x": 0.5, "y": 9.0, "tags": {"name": " ", "shop": "tea"}},
        {"osm_type": "node", "osm_id": 33, "x": 0.5, "y": 9.5, "tags": {"name": "Well", "brand": "Spring"}},
    ]
    p.write_text("".join(json.dumps(r) + "\n" for r in rows))
    named = readers.named_pois(readers.facts(spark, str(p), "pois")).collect()
    assert [(r["id"], r["display"], r["subtitle"]) for r in named] == [("poi:way:31", "Blue Kettle", "tea"), ("poi:node:33", "Well", "")]
    p.write_text('{"osm_id": "x"\n')
    with pytest.raises(Exception):
        readers.facts(spark, str(p), "pois").collect()
    with pytest.raises(ValueError, match="no reader"):
        readers.facts(spark, "map.pbf", "pois")


def test_publish(spark, tmp_path):
    path = str(tmp_path / "facts")
    df = spark.range(100).selectExpr("id", "CAST(id % 7 AS STRING) AS name")
    entry = writers.publish(df, path)
    assert entry["rows"] == 100 and entry == writers.publish(df.repartition(5), path)
    schema = "id long, name string"
    assert writers.verified(spark, path, schema).count() == 100
    df.limit(99).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="not what was published"):
        writers.verified(spark, path, schema)


def test_tiles_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, -5.0, 5.0), (2, 5.0, 5.0), (3, 25.0, 5.0)], "id long, x double, y double")
    writers.write_tiles(df, str(tmp_path / "tiles"), 10.0)
    t = readers.tiles(spark, str(tmp_path / "tiles"), -1, 0, 0, 0)
    assert sorted(r["id"] for r in t.collect()) == [1, 2]
    assert "PartitionFilters: [isnotnull(tx" in t._jdf.queryExecution().toString()
    path = str(tmp_path / "manifest.json")
    writers.merge_manifest(spark, path, "a", {"n": 1})
    assert writers.merge_manifest(spark, path, "b", {"n": 2}) == {"a": {"n": 1}, "b": {"n": 2}}


def test_streams_equal_batches(spark, sf, tmp_path):
    s = build._events(spark, sf)
    flags = ["event_id", "unit", "t", (F.col("kind") != "view").alias("current"), (F.col("value") > 60).alias("offence"), (F.col("kind") == "signup").alias("complied")]
    batch = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("user_id").alias("unit"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_type").alias("kind"), "value")
    got = events.drained(events.offences(s.select(*flags), 3600.0), f"file://{tmp_path}/o")
    want = sightings.offence_steps(batch.select(*flags), "unit", 3600.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    events.log_samples(s.select("event_id", "value"), f"file://{tmp_path}/log", f"file://{tmp_path}/check").awaitTermination()
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/log").count() == batch.count()


def test_build_plan(spark):
    targets = spark.createDataFrame([("addresses", True, "b1"), ("routing", True, "b1"), ("roads", False, "b1"), ("water", True, "b1")], "target string, requested boolean, builder string")
    needs = spark.createDataFrame([("addresses", "addresses"), ("routing", "highways"), ("water", "areas")], "target string, route string")

    def planned(addresses, highways, old):
        routes = spark.createDataFrame([("addresses", addresses, 1, True), ("highways", highways, 1, True), ("areas", "z", 1, False)], "route string, sha256 string, version int, complete boolean")
        return {r["target"]: (r["status"], r["fingerprint"]) for r in build.plan(targets, routes, needs, spark.createDataFrame(old, "target string, fingerprint string, present boolean")).collect()}

    first = planned("a", "h", [])
    assert {k: v[0] for k, v in first.items()} == {"addresses": "rebuild", "routing": "rebuild", "roads": "skip", "water": "blocked"}
    old = [(k, v[1], True) for k, v in first.items() if v[1]]
    assert planned("a", "h", old)["routing"][0] == "hit" and planned("changed", "h", old)["routing"][0] == "hit"
    assert planned("a", "changed", old)["routing"][0] == "rebuild" and planned("a", "h", [(k, f, False) for k, f, _ in old])["routing"][0] == "rebuild"


def test_publish_keeps_one_whole_table(spark, tmp_path):
    """A failed swap leaves the old table; a table with a schema is cast to it."""
    path = str(tmp_path / "facts")
    writers.publish(spark.range(5).withColumn("more", F.lit(1)), path, schema="id string")
    assert writers.verified(spark, path, "id string").count() == 5
    with pytest.raises(Exception):
        writers.publish(spark.range(5).select(F.raise_error(F.lit("no")).alias("id")), path, schema="id string")
    assert writers.verified(spark, path, "id string").count() == 5
    writers.publish(spark.range(7), path, schema="id string")
    assert writers.verified(spark, path, "id string").count() == 7
    assert not [p for p in tmp_path.iterdir() if ".old-" in p.name]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "event_id long, unit long, t double"
    rows = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows([(1, 7, 10.0), (2, 8, 4.0)])
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert {r["event_id"] for r in events.drained(events.accepted(stream), f"file://{tmp_path}/run").collect()} == {1, 2}
    rows([(3, 7, 5.0), (4, 7, 12.0), (5, 8, 4.0)])
    assert {r["event_id"] for r in events.drained(events.accepted(stream), f"file://{tmp_path}/run").collect()} == {1, 2, 4, 5}

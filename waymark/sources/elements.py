"""One pass over a map's elements to the facts of four kinds: roads, addresses, points of interest and traffic signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, tags

from . import readers, writers

KINDS = {k: readers.FACTS[k] for k in ("highways", "addresses", "pois", "signals")}


def element_facts(elements: DataFrame) -> DataFrame:
    """A row with ``kind`` for each kind that an element belongs to; columns that its kind lacks are null.

    elements: osm_type (node or way), osm_id, lon, lat (of nodes), node_ids, lons, lats (of ways), tags. A way stands at
    the mean of its projected points; a node without a place, and a way with a point without one or with none, belong to
    no kind. Nothing is shuffled.
    """
    g, node, way = F.col("tags"), F.col("osm_type") == "node", F.col("osm_type") == "way"
    whole = F.forall("lons", lambda v: v.isNotNull()) & F.forall("lats", lambda v: v.isNotNull()) & (F.size("lons") > 0) & (F.size("lats") == F.size("lons"))
    placed = F.when(node, F.col("lon").isNotNull() & F.col("lat").isNotNull()).when(way, whole)
    highway = tags.tag(g, "highway")
    of = {"highways": way & (F.trim(highway) != ""), "addresses": tags.has_address(g), "pois": tags.is_poi(g), "signals": node & (highway == "traffic_signals")}
    e = elements.where(placed).withColumn("kind", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(fits, F.lit(False)), F.lit(kind)) for kind, fits in of.items()]))))
    mean = lambda c, f: F.aggregate(F.transform(c, f), F.lit(0.0), lambda a, x: a + x) / F.size(c)
    filled = lambda k: F.when(F.trim(tags.tag(g, k)) != "", F.trim(tags.tag(g, k)))
    values = {
        "way_id": F.col("osm_id"), "osm_type": F.col("osm_type"), "osm_id": F.col("osm_id"), "node_ids": F.col("node_ids"), "lons": F.col("lons"), "lats": F.col("lats"), "lon": F.col("lon"), "lat": F.col("lat"), "tags": g,
        "x": F.when(node, geo.project_x(F.col("lon"))).otherwise(mean("lons", geo.project_x)), "y": F.when(node, geo.project_y(F.col("lat"))).otherwise(mean("lats", geo.project_y)),
        "street": F.coalesce(filled("addr:street"), filled("addr:place")), "housenumber": filled("addr:housenumber"), "postcode": filled("addr:postcode"), "locality": filled("addr:city"),
    }
    empty = {k: elements.sparkSession.createDataFrame([], schema).schema for k, schema in KINDS.items()}
    types = {f.name: f.dataType for s in empty.values() for f in s}
    has = {c: [k for k, s in empty.items() if c in s.names] for c in types}
    return e.select("kind", *[F.when(F.col("kind").isin(*has[c]), values[c]).cast(types[c]).alias(c) for c in types])


def publish_elements(elements: DataFrame, path: str) -> dict:
    """The four fact tables of a map, all in place or none; ``writers.verified_kind`` reads one."""
    return writers.publish_kinds(element_facts(elements), path, KINDS)

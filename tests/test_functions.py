"""Values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, sky, tags, text


def value(spark, column, rows=None, schema="_ int"):
    return spark.createDataFrame(rows or [(0,)], schema).select(column.alias("v")).first()["v"]


def tag_map(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.expr("map()").cast("map<string,string>")


@pytest.mark.parametrize(
    "raw, highway, kmh, explicit",
    [
        ("70", "primary", 70.0, True), ("50 mph", "primary", 80.4672, True), ("signals", "residential", 40.0, False), (None, "residential", 40.0, False), ("30;50", "service", 30.0, True),
        ("7,5 km/h", "service", 7.5, True), ("20 knots", "service", 37.04, True), ("0", "service", 30.0, False), ("-5", "service", 30.0, False), ("50d", "service", 30.0, False),
        ("NaN", "service", 30.0, False), ("", "steps", 5.0, False), ("80kph", "track", 80.0, True),
    ],
)
def test_speed(spark, raw, highway, kmh, explicit):
    c = F.lit(raw).cast("string")
    assert value(spark, tags.speed_kmh(c, F.lit(highway))) == pytest.approx(kmh)
    assert value(spark, tags.explicit_speed(c).isNotNull()) == explicit


@pytest.mark.parametrize(
    "given, sense",
    [({"oneway": "yes"}, 1), ({"oneway": "1"}, 1), ({"oneway": "true"}, 1), ({"oneway": "-1"}, -1), ({"junction": "roundabout"}, 1), ({"junction": "roundabout", "oneway": "no"}, 0), ({}, 0)],
)
def test_oneway(spark, given, sense):
    assert value(spark, tags.oneway(tag_map(given))) == sense


@pytest.mark.parametrize(
    "highway, given, klass, reason",
    [
        ("residential", {}, 0, 0), ("service", {"access": "destination"}, 1, 7), ("service", {"access": "private"}, 3, 6), ("residential", {"motor_vehicle": "no"}, 3, 4), ("cycleway", {}, 3, 1),
        ("cycleway", {"motor_vehicle": "yes"}, 0, 0), ("residential", {"motorcar": "yes", "access": "no"}, 3, 2), ("residential", {"access": "customers"}, 2, 8),
    ],
)
def test_access(spark, highway, given, klass, reason):
    r = value(spark, tags.access(F.lit(highway), tag_map(given)))
    assert (r["class"], r["reason"]) == (klass, reason)


@pytest.mark.parametrize("given, grade", [({"bridge": "yes"}, 1), ({"tunnel": "yes"}, -1), ({"layer": "3"}, 3), ({"layer": "1.5"}, 0), ({"layer": "99"}, 20), ({"bridge": "no"}, 0), ({"layer": "-2", "bridge": "yes"}, -2)])
def test_grade(spark, given, grade):
    assert value(spark, tags.grade(tag_map(given))) == grade


@pytest.mark.parametrize("raw, layer", [("1.5", 1), ("-1.5", -1), ("300", 127), ("x", 0), (None, 0)])
def test_layer(spark, raw, layer):
    assert value(spark, tags.layer(F.lit(raw).cast("string"))) == layer


@pytest.mark.parametrize(
    "given, category, bucket",
    [
        ({"amenity": "hospital", "tourism": "museum"}, "healthcare", "amenity:hospital"), ({"amenity": "bench"}, None, "amenity:bench"), ({"shop": "hairdresser"}, None, "shop:hairdresser"),
        ({"highway": "bus_stop"}, None, "highway:bus_stop"), ({"railway": "platform"}, None, "railway:platform"), ({"camera:type": "fixed"}, None, "camera:*"), ({}, None, "other"),
    ],
)
def test_poi(spark, given, category, bucket):
    assert value(spark, tags.poi_category(tag_map(given))) == category
    assert value(spark, tags.excluded_bucket(tag_map(given))) == bucket
    assert value(spark, tags.is_poi(tag_map(given))) == (given != {})


@pytest.mark.parametrize("given, height", [({"height": "12,5 m"}, 12.5), ({"height": "500"}, 120.0), ({"height": "1-2", "building:levels": "4"}, 12.0), ({}, 9.0), ({"height": "about 7"}, 7.0)])
def test_height(spark, given, height):
    assert value(spark, tags.building_height(tag_map(given))) == height


def test_hstore(spark):
    assert value(spark, tags.parse_hstore(F.lit(r'"a"=>"1","b\"c"=>"x\\y","a"=>"2"'))) == {"a": "2", 'b"c': r"x\y"}
    assert value(spark, tags.merge_promoted(tag_map({"a": "1", "b": "2"}), {"a": F.lit("9"), "b": F.lit("")})) == {"a": "9", "b": "2"}


def test_projection(spark):
    lon, lat = F.lit(13.19), F.lit(55.7)
    x, y = value(spark, geo.project_x(lon)), value(spark, geo.project_y(lat))
    assert value(spark, geo.unproject_lon(F.lit(x))) == pytest.approx(13.19) and value(spark, geo.unproject_lat(F.lit(y))) == pytest.approx(55.7)
    assert value(spark, geo.project_y(F.lit(90.0))) == value(spark, geo.project_y(F.lit(geo.MAX_LATITUDE)))
    assert value(spark, geo.distance_m(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))) == pytest.approx(3.141592653589793 * geo.EARTH_RADIUS)
    assert value(spark, geo.cell(F.lit(-0.5), 32_000.0)) == -1


def points(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


def test_shapes(spark):
    square = points((0, 0), (10, 0), (10, 10), (0, 10))
    assert value(spark, geo.ring_area(square)) == 100.0
    assert value(spark, geo.polygon_area(square, F.array(points((1, 1), (3, 1), (3, 3), (1, 3))))) == 96.0
    assert value(spark, geo.ring_area(points((0, 0), (1, 1)))) == 0.0
    assert value(spark, geo.ring_centroid(points((0, 0), (10, 0), (10, 10), (0, 10), (0, 5)), "x")) == pytest.approx(5.0)
    assert value(spark, geo.points_mean(points((0, 0), (10, 0), (10, 10), (0, 10), (0, 5)), "x")) == 4.0
    kept = value(spark, geo.thinned(points((0, 0), (1, 0), (2, 0), (3, 0), (3.5, 0)), 2.0))
    assert [p["x"] for p in kept] == [0.0, 2.0, 3.5]
    assert value(spark, geo.segments_cross(*[(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 2), (0, 2), (2, 0))]))
    assert not value(spark, geo.segments_cross(*[(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 2), (2, 2), (3, 0))]))


@pytest.mark.parametrize("raw, form", [("Södersjukhuset", "sodersjukhuset"), ("  Ärla—Ö 12 b ", "arlao 12 b"), ("ﬁne ½", "fine 12"), (None, ""), ("Ĳssel", "ijssel"), ("日本 7", "7")])
def test_normal_form(spark, raw, form):
    assert value(spark, text.normal_form(F.lit(raw).cast("string"))) == form


@pytest.mark.parametrize("q, shown, every, tier", [("city", "city", "city", 0), ("cit", "city", "city", 1), ("gar ci", "city garage", "city garage", 2), ("ity g", "city garage", "city garage", 3), ("lund", "city", "city lund", 4), ("und", "city", "city lund", 5), ("x", "city", "city lund", None), ("", "city", "city", None)])
def test_tiers(spark, q, shown, every, tier):
    assert value(spark, text.match_tier(F.lit(q), F.lit(shown), F.lit(every))) == tier


def test_trigrams(spark):
    assert value(spark, text.trigrams(F.lit("ab abcd abc"))) == ["abc", "bcd"]


def test_time(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert value(spark, sky.weekday(at("2026-11-28 00:00:00"))) == 6
    assert value(spark, sky.daypart(at("2026-11-28 05:00:00"))) == "morning" and value(spark, sky.daypart(at("2026-11-28 23:00:00"))) == "night"
    assert value(spark, sky.schedule_active(at("2026-11-29 03:59:59"), (6,), 22 * 60, 4 * 60)) and not value(spark, sky.schedule_active(at("2026-11-28 03:00:00"), (6,), 22 * 60, 4 * 60))
    assert value(spark, sky.days_in_month(at("2024-02-10 00:00:00"))) == 29
    noon = sky.sun(at("2024-06-21 12:00:00"), F.lit(55.7), F.lit(13.2), F.lit(1.0))
    assert 57 < value(spark, noon["elevation_deg"]) < 58
    assert value(spark, sky.sun(at("2024-06-21 12:00:00"), F.lit(80.0), F.lit(13.2), F.lit(1.0))["polar_day"])
    assert value(spark, sky.sun(at("2024-12-21 12:00:00"), F.lit(80.0), F.lit(13.2), F.lit(1.0))["daylight_minutes"]) == 0.0
    assert value(spark, sky.night_intensity(F.lit(-6.0))) == 1.0 and value(spark, sky.night_intensity(F.lit(0.5))) == 0.0

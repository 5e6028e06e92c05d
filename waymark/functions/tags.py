"""Map tags (MAP<STRING, STRING>) as Column expressions: classes, speeds, access, grades and points of interest."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Road types in class order, with the speed in km/h that holds where none is tagged.
ROAD_SPEEDS = {
    "motorway": 110.0, "motorway_link": 70.0, "trunk": 90.0, "trunk_link": 70.0, "primary": 70.0, "primary_link": 50.0,
    "secondary": 60.0, "secondary_link": 50.0, "tertiary": 50.0, "tertiary_link": 40.0, "unclassified": 50.0,
    "residential": 40.0, "living_street": 20.0, "service": 30.0, "road": 40.0, "track": 20.0, "cycleway": 20.0,
    "footway": 8.0, "path": 10.0, "pedestrian": 8.0, "bridleway": 10.0, "steps": 5.0, "busway": 50.0, "escape": 40.0,
    "raceway": 100.0,
}
NOT_FOR_CARS = ("cycleway", "footway", "path", "pedestrian", "bridleway", "steps")
#: Tag values by what they say about access.
NO, YES, LIMITED = ("no", "0", "false"), ("yes", "1", "true", "permissive", "designated"), ("customers", "delivery", "agricultural", "forestry", "permit")
#: Access classes and reasons, as numbers.
NORMAL, DESTINATION, RESTRICTED, FORBIDDEN = 0, 1, 2, 3
REASONS = ("default", "non_car_highway", "access_no", "vehicle_no", "motor_vehicle_no", "motorcar_no", "private", "destination", "limited_access")
#: Bits of an edge's flags.
AGAINST_ONEWAY, BRIDGE, TUNNEL = 1, 2, 4
#: Factors to km/h by the unit's spelling.
UNITS = {"mph": 1.609344, "knots": 1.852, "knot": 1.852, "km/h": 1.0, "kph": 1.0}
#: Keys that make a point of interest, and road values that do.
POI_KEYS = (
    "amenity", "shop", "tourism", "leisure", "office", "healthcare", "emergency", "public_transport", "railway", "aeroway",
    "craft", "historic", "sport", "club", "man_made", "information", "advertising",
)
POI_ROADS = ("speed_camera", "services", "rest_area", "bus_stop", "elevator")
#: The runtime categories in the order in which they are tried: (key, values, category).
POI_RULES = (
    ("amenity", ("police",), "police"), ("amenity", ("fire_station",), "fire_station"),
    ("amenity", ("hospital", "clinic", "doctors", "pharmacy"), "healthcare"), ("healthcare", ("hospital", "clinic", "doctor", "pharmacy"), "healthcare"),
    ("emergency", ("ambulance_station",), "ambulance_station"), ("amenity", ("fuel", "charging_station"), "fuel"),
    ("amenity", ("parking", "parking_entrance"), "parking"), ("amenity", ("bank", "atm"), "money"),
    ("amenity", ("restaurant", "fast_food", "cafe", "bar", "pub"), "food"), ("shop", ("supermarket", "convenience", "mall", "department_store"), "shopping"),
    ("shop", ("car", "car_repair", "tyres", "bicycle"), "vehicle_service"), ("tourism", ("hotel", "motel", "hostel"), "lodging"),
    ("tourism", ("attraction", "museum", "viewpoint"), "attraction"), ("amenity", ("school", "college", "university", "kindergarten"), "education"),
    ("railway", ("station", "halt"), "transit"), ("public_transport", ("station",), "transit"),
    ("highway", ("services", "rest_area"), "road_service"), ("highway", ("speed_camera",), "speed_camera"),
)
#: Land cover by tag value; the administrative outline comes first and has none.
WATER, FOREST, FARMLAND, URBAN = 1, 2, 3, 4
WATER_NATURAL, WATER_LANDUSE = ("water", "bay", "strait"), ("reservoir", "basin")
FARM_LANDUSE, URBAN_LANDUSE = ("farmland", "farmyard", "meadow", "grass", "orchard", "vineyard"), ("residential", "commercial", "industrial", "retail")
MIN_BBOX_AREA = {0: 0.0, WATER: 500_000.0, URBAN: 1_000_000.0, FOREST: 4_000_000.0, FARMLAND: 4_000_000.0}


def tag(tags: Column, key: str) -> Column:
    return tags[key]


def cleaned(value: Column) -> Column:
    return F.lower(F.trim(value))


def road_class(highway: Column) -> Column:
    """Position in the class order; null for other ways."""
    at = F.array_position(F.array(*[F.lit(k) for k in ROAD_SPEEDS]), highway)
    return F.when(at > 0, at.cast("int") - 1)


def default_speed(highway: Column) -> Column:
    speeds = F.create_map(*[F.lit(x) for pair in ROAD_SPEEDS.items() for x in pair])
    return speeds[highway]


def explicit_speed(value: Column) -> Column:
    """km/h of a speed tag: its first part up to ``;``, decimal comma allowed, with or without a unit; else null.

    The pattern admits what reads as a number everywhere, which rules out the suffixes that only the JVM accepts.
    """
    first = F.trim(F.substring_index(F.replace(cleaned(value), F.lit(","), F.lit(".")), ";", 1))
    unit = F.regexp_extract(first, r"(mph|knots|knot|km/h|kph)$", 1)
    number = F.trim(F.regexp_replace(first, r"(mph|knots|knot|km/h|kph)$", ""))
    plain = F.when(number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), number.try_cast("double"))
    factors = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    speed = plain * F.coalesce(factors[unit], F.lit(1.0))
    return F.when((speed > 0) & (speed < float("inf")), speed)


def speed_kmh(value: Column, highway: Column) -> Column:
    return F.coalesce(explicit_speed(value), default_speed(highway))


def unknown_speed(value: Column) -> Column:
    """The tag's text where it is given but says no speed."""
    raw = F.trim(value)
    return F.when((raw != "") & explicit_speed(value).isNull(), raw)


def oneway(tags: Column) -> Column:
    """1 along the way, -1 against it, 0 both; roundabouts are one-way unless tagged otherwise."""
    v = F.coalesce(cleaned(tag(tags, "oneway")), F.lit(""))
    forward = F.when(cleaned(tag(tags, "junction")) == "roundabout", 1).otherwise(0)
    return F.when(v.isin("yes", "1", "true"), 1).when(v.isin("-1", "reverse"), -1).when(v.isin(*NO), 0).otherwise(forward)


def access(highway: Column, tags: Column) -> Column:
    """Struct (class, reason). Any refusal counts first, then a grant to vehicles, then other limits, then the road type."""
    keys = ("motorcar", "motor_vehicle", "vehicle", "access")
    v = {k: cleaned(tag(tags, k)) for k in keys}
    is_ = lambda c, *values: F.coalesce(c.isin(*values), F.lit(False))
    told = lambda c, r: F.struct(F.lit(c).alias("class"), F.lit(r).alias("reason"))
    out = F.when(is_(v["motorcar"], *NO), told(FORBIDDEN, 5))
    for k, reason in (("motor_vehicle", 4), ("vehicle", 3), ("access", 2)):
        out = out.when(is_(v[k], *NO), told(FORBIDDEN, reason))
    granted = F.coalesce(F.when(v["motorcar"] != "", v["motorcar"]), v["motor_vehicle"])
    out = out.when(is_(granted, *YES), told(NORMAL, 0))
    for k in keys:
        out = out.when(is_(v[k], "private"), told(FORBIDDEN, 6)).when(is_(v[k], "destination"), told(DESTINATION, 7)).when(is_(v[k], *LIMITED), told(RESTRICTED, 8))
    return out.when(highway.isin(*NOT_FOR_CARS), told(FORBIDDEN, 1)).otherwise(told(NORMAL, 0))


def is_true(value: Column) -> Column:
    return F.coalesce(~cleaned(value).isin("", *NO), F.lit(False))


def layer(value: Column) -> Column:
    """A routing layer: any number cut to an integer, within a signed byte; 0 where it is none."""
    number = F.when(F.trim(value).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.trim(value).try_cast("double"))
    return F.when(number.isNotNull(), F.greatest(F.lit(-128), F.least(F.lit(127), number)).cast("int")).otherwise(0)


def grade(tags: Column) -> Column:
    """A drawing grade: an integer layer within 20, else 1 on bridges and -1 in tunnels."""
    number = F.when(F.trim(tag(tags, "layer")).rlike(r"^[+-]?[0-9]+$"), F.trim(tag(tags, "layer")).try_cast("double"))
    held = F.when(number.isNotNull(), F.greatest(F.lit(-20), F.least(F.lit(20), number)).cast("int")).otherwise(0)
    return F.when(held != 0, held).when(is_true(tag(tags, "bridge")), 1).when(is_true(tag(tags, "tunnel")), -1).otherwise(0)


def is_poi(tags: Column) -> Column:
    any_key = F.arrays_overlap(F.map_keys(tags), F.array(*[F.lit(k) for k in (*POI_KEYS, "enforcement", "surveillance")]))
    camera = F.exists(F.map_keys(tags), lambda k: k.startswith("camera:"))
    return any_key | camera | F.coalesce(tag(tags, "highway").isin(*POI_ROADS), F.lit(False))


def poi_category(tags: Column) -> Column:
    """The first rule that fits; null where none does."""
    out = None
    for key, values, category in POI_RULES:
        fits = tag(tags, key).isin(*values)
        out = F.when(fits, category) if out is None else out.when(fits, category)
    return out


def excluded_bucket(tags: Column) -> Column:
    """key:value of the first key with a value, for points that no rule takes."""
    keys = (*POI_KEYS, "highway", "enforcement", "surveillance")
    found = [F.when(tag(tags, k) != "", F.concat(F.lit(f"{k}:"), tag(tags, k))) for k in keys]
    camera = F.when(F.exists(F.map_keys(tags), lambda k: k.startswith("camera:")), "camera:*")
    return F.coalesce(*found, camera, F.lit("other"))


def has_address(tags: Column) -> Column:
    filled = lambda k: F.coalesce(F.trim(tag(tags, k)) != "", F.lit(False))
    return filled("addr:housenumber") & (filled("addr:street") | filled("addr:place"))


def is_outline(tags: Column) -> Column:
    return F.coalesce((tag(tags, "boundary") == "administrative") & (tag(tags, "admin_level") == "2"), F.lit(False))


def land_cover(tags: Column) -> Column:
    n, u = tag(tags, "natural"), tag(tags, "landuse")
    return (
        F.when(is_outline(tags), None)
        .when(n.isin(*WATER_NATURAL) | u.isin(*WATER_LANDUSE), WATER)
        .when((n == "wood") | (u == "forest"), FOREST)
        .when(u.isin(*FARM_LANDUSE), FARMLAND)
        .when(u.isin(*URBAN_LANDUSE), URBAN)
    )


def is_area(tags: Column) -> Column:
    has = lambda k: tag(tags, k).isNotNull()
    n, u = tag(tags, "natural"), tag(tags, "landuse")
    cover = n.isin(*WATER_NATURAL, "wood") | u.isin(*WATER_LANDUSE, "forest", *FARM_LANDUSE, *URBAN_LANDUSE)
    bank = F.coalesce(tag(tags, "waterway") == "riverbank", F.lit(False))
    return has("building") | has("building:part") | is_poi(tags) | is_outline(tags) | F.coalesce(cover, F.lit(False)) | bank | has("water")


def first_number(value: Column) -> Column:
    """The first run of digits, points and signs as a number; 0 where there is none or it is no number."""
    run = F.regexp_extract(F.replace(F.coalesce(value, F.lit("")), F.lit(","), F.lit(".")), r"[0-9.+-]+", 0)
    return F.coalesce(F.when(run.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), run.try_cast("double")), F.lit(0.0))


def building_height(tags: Column, low: float = 2.5, high: float = 120.0, floor_m: float = 3.0, default: float = 9.0) -> Column:
    told, floors = first_number(tag(tags, "height")), first_number(tag(tags, "building:levels"))
    held = lambda c: F.least(F.lit(high), F.greatest(F.lit(low), c))
    return F.when(told > 0, held(told)).when(floors > 0, held(floors * floor_m)).otherwise(default)


def parse_hstore(text: Column) -> Column:
    r"""``"key"=>"value"`` pairs, with ``\"`` and ``\\`` inside, as a map; of repeated keys the last counts."""
    pair = r'"((?:[^"\\]|\\.)*)"=>"((?:[^"\\]|\\.)*)"'
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    keys = F.transform(F.regexp_extract_all(text, F.lit(pair), 1), plain)
    values = F.transform(F.regexp_extract_all(text, F.lit(pair), 2), plain)
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.aggregate(entries, F.array().cast("array<struct<k:string,v:string>>"), lambda out, e: F.concat(F.filter(out, lambda o: o["k"] != e["k"]), F.array(e)))
    return F.map_from_entries(last)


def merge_promoted(tags: Column, promoted: dict[str, Column]) -> Column:
    """Own columns over the map; an empty or null column leaves the map's value."""
    own = F.map_filter(F.create_map(*[x for k, c in promoted.items() for x in (F.lit(k), c.cast("string"))]), lambda _, v: F.coalesce(v != "", F.lit(False)))
    rest = F.map_filter(tags, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    return F.map_concat(rest, own)


def subset(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(tags, lambda k, _: k.isin(*keys))


#: How much dearer a metre on foot is by surface; others and unknown ones come last.
SURFACE_WEIGHTS = {"footway": 0.70, "pedestrian": 0.70, "sidewalk": 0.70, "plaza": 0.70, "crossing": 0.85, "path": 0.90, "open_ground": 1.20, "road": 3.00}
OTHER_SURFACE = 1.50


def walk_cost(segments: Column) -> Column:
    """Weighted metres of an array of structs (length_m, surface, blocked); infinite if there are none or one is blocked."""
    weights = F.create_map(*[F.lit(x) for pair in SURFACE_WEIGHTS.items() for x in pair])
    weight = lambda s: F.coalesce(weights[F.coalesce(s["surface"], F.lit("open_ground"))], F.lit(OTHER_SURFACE))
    total = F.aggregate(F.transform(segments, lambda s: F.greatest(F.lit(0.0), s["length_m"]) * weight(s)), F.lit(0.0), lambda a, x: a + x)
    closed = F.exists(segments, lambda s: F.coalesce(s["blocked"], F.lit(False))) | (F.size(segments) == 0)
    return F.when(closed, float("inf")).otherwise(total)


def separation(tags: Column) -> Column:
    """What tells ways apart that cross without meeting: bridge, tunnel and layer, empty where none is set."""
    set_ = lambda k: F.coalesce(~F.coalesce(tag(tags, k), F.lit("")).isin("", "no", "0"), F.lit(False))
    layered = F.coalesce(tag(tags, "layer") != "", F.lit(False))
    or_ = lambda k, other: F.coalesce(tag(tags, k), F.lit(other))
    key = F.concat(F.lit("l="), or_("layer", "0"), F.lit(";b="), or_("bridge", ""), F.lit(";t="), or_("tunnel", ""))
    return F.when(set_("bridge") | set_("tunnel") | layered, key).otherwise("")


def synthetic_node_id(lon: Column, lat: Column, apart: Column, person: bytes) -> Column:
    """A node id of 63 bits for a place without one, from BLAKE2b; Spark has no such hash, so it is worked out in Arrow batches."""
    @F.pandas_udf("long")
    def ids(keys: pd.Series) -> pd.Series:
        one = lambda k: int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8, person=person).digest(), "little") & (1 << 63) - 1
        return keys.map(one)

    step = lambda c: F.bround(c * 10_000_000.0).cast("long").cast("string")
    return ids(F.concat(step(lon), F.lit(":"), step(lat), F.lit(":"), apart))

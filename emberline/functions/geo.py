"""Geometry on the sphere as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.schemas import (
    CONE_HALF_DEG,
    CONE_STEP_DEG,
    LONG_RANGE_TYPES,
    RADIUS_KM,
    RADIUS_URBAN_KM,
    RADIUS_WIDE_KM,
    REACH_CAP_KM,
    REACH_MIN_HOURS,
    SPEED_KMH,
    URBAN_TYPES,
    lookup,
)

EARTH_KM = 6371.0
#: Kilometres of a degree, for the local plane of point_to_segment_km.
_KM_LNG, _KM_LAT = 111.320, 110.574
_COMPASS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    inner = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), inner)))


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing, 0 to 360, clockwise from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    east = F.sin(d) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def destination(lat: Column, lng: Column, bearing: Column, km: Column) -> Column:
    """struct(lat, lng) reached after km along a bearing."""
    d, b, a = km / EARTH_KM, F.radians(bearing), F.radians(lat)
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), F.degrees(F.radians(lng) + turn).alias("lng"))


def compass(bearing: Column) -> Column:
    """Eight-point word; a bearing midway between two points takes the later."""
    at = (F.floor(F.pmod(bearing, F.lit(360.0)) / 45.0 + 0.5) % 8 + 1).cast("int")
    return F.element_at(F.array(*map(F.lit, _COMPASS)), at)


def waypoints(lat1: Column, lng1: Column, lat2: Column, lng2: Column, n: int) -> Column:
    """n points along the great circle as array<struct<lat,lng>>; the ends are exact, near-equal ends repeat the first."""
    n = max(2, n)
    vec = lambda a, o: (F.cos(F.radians(a)) * F.cos(F.radians(o)), F.cos(F.radians(a)) * F.sin(F.radians(o)), F.sin(F.radians(a)))
    v, w = vec(lat1, lng1), vec(lat2, lng2)
    omega = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v[0] * w[0] + v[1] * w[1] + v[2] * w[2])))

    def between(i: Column) -> Column:
        f = i / F.lit(float(n - 1))
        p, q = F.sin((1 - f) * omega) / F.sin(omega), F.sin(f * omega) / F.sin(omega)
        x, y, z = (p * a + q * b for a, b in zip(v, w, strict=True))
        return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lng"))

    start, end = F.struct(lat1.alias("lat"), lng1.alias("lng")), F.struct(lat2.alias("lat"), lng2.alias("lng"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, end).when((i == 0) | (omega < 1e-9), start).otherwise(between(i)))


def point_to_segment_km(lat: Column, lng: Column, a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> Column:
    """Distance to the nearest point of a short segment, found in a local plane and measured on the sphere."""
    kx = F.lit(_KM_LNG) * F.cos(F.radians(a_lat))
    bx, by = (b_lng - a_lng) * kx, (b_lat - a_lat) * _KM_LAT
    px, py = (lng - a_lng) * kx, (lat - a_lat) * _KM_LAT
    square = bx * bx + by * by
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(px * bx + py * by, square)))
    t = F.when(square <= 1e-12, F.lit(0.0)).otherwise(t)
    near_lng = a_lng + F.coalesce(F.try_divide(t * bx, kx), F.lit(0.0))
    return haversine_km(lat, lng, a_lat + t * by / _KM_LAT, near_lng)


def adaptive_radius_km(type1: Column, place1: Column, state1: Column, type2: Column, place2: Column, state2: Column) -> Column:
    """Radius within which two reports may be one incident."""
    norm = lambda c: F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " ")
    same = lambda a, b: (norm(a) != "") & (norm(a) == norm(b))
    far = type1.isin(*LONG_RANGE_TYPES) | type2.isin(*LONG_RANGE_TYPES)
    urban = type1.isin(*URBAN_TYPES) | type2.isin(*URBAN_TYPES)
    return F.when(same(place1, place2), RADIUS_WIDE_KM).when(same(state1, state2) & far, RADIUS_WIDE_KM).when(urban & ~far, RADIUS_URBAN_KM).otherwise(RADIUS_KM)


def reach_km(hours: Column, terrain: Column | None = None) -> Column:
    """Radius reachable in hours: speed of the terrain (mixed if none), a floor of hours and a cap."""
    speed = lookup(SPEED_KMH, terrain, SPEED_KMH["mixed"]) if terrain is not None else F.lit(SPEED_KMH["mixed"])
    hours = F.coalesce(F.nanvl(hours, F.lit(None).cast("double")), F.lit(REACH_MIN_HOURS))
    return F.least(F.lit(REACH_CAP_KM), speed * F.greatest(hours, F.lit(REACH_MIN_HOURS)))


def public_level(score: Column) -> Column:
    return F.when(score >= 4, "RED").when(score >= 2, "ORANGE").when(score >= 1, "YELLOW").otherwise("GREEN")


def cone_polygon(lat: Column, lng: Column, bearing: Column, km: Column) -> Column:
    """Ring of a wedge ahead of a point: the point, the arc, the point again; coordinates to 6 places."""
    rounded = lambda p: F.struct(F.round(p["lat"], 6).alias("lat"), F.round(p["lng"], 6).alias("lng"))
    tip = F.array(F.struct(F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng")))
    arc = F.transform(F.sequence(F.lit(-CONE_HALF_DEG), F.lit(CONE_HALF_DEG), F.lit(CONE_STEP_DEG)), lambda a: rounded(destination(lat, lng, bearing + a, km)))
    return F.concat(tip, arc, tip)


def area_cell(lat: Column, lng: Column, places: int = 2) -> Column:
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(F.round(lat, places).alias("lat"), F.round(lng, places).alias("lng")))


def zone_confidence(ring_count: Column, total: Column, radius_km: Column) -> Column:
    """Confidence of a search zone from agreement of rings and tightness."""
    agree = ring_count / total
    base = F.when((total == 1) | (ring_count == 1), F.lit(0.30) * agree).otherwise(agree)
    tight = F.lit(1.0) / (1.0 + F.greatest(F.lit(0.0), radius_km - 5.0) / 95.0)
    value = F.greatest(F.lit(0.0), F.least(F.lit(0.95), base * (0.6 + 0.4 * tight)))
    return F.when((total <= 0) | (ring_count <= 0), F.lit(0.0)).otherwise(F.round(value, 3))

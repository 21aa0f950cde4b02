"""Geo queries: radius, corridor, rings, zones, cones, gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import geo, text, times
from emberline.operators import gazetteer, spatial
from emberline.plans.registry import query, with_
from emberline.schemas import STATUS_SCORE, lookup
from emberline.sources import derived
from emberline.sources.files import table


def hav(a: str, b: str) -> str:
    return f"(2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2)))))"


def bearing(a: str, b: str) -> str:
    d = f"radians({b}lng - {a}lng)"
    east, north = f"sin({d}) * cos(radians({b}lat))", f"cos(radians({a}lat)) * sin(radians({b}lat)) - sin(radians({a}lat)) * cos(radians({b}lat)) * cos({d})"
    return f"((degrees(atan2({east}, {north})) + 360.0) % 360.0)"


def dest(lat: str, lng: str, brg: str, km: str) -> tuple[str, str]:
    d, b, a = f"({km} / 6371.0)", f"radians({brg})", f"radians({lat})"
    to = f"asin(sin({a}) * cos({d}) + cos({a}) * sin({d}) * cos({b}))"
    return f"degrees({to})", f"degrees(radians({lng}) + atan2(sin({b}) * sin({d}) * cos({a}), cos({d}) - sin({a}) * sin({to})))"


_P, _INC = ("p", derived.PLACES), ("inc", derived.INCIDENTS)
_SCORE = "CASE status WHEN 'verified' THEN 4 WHEN 'needs_human_review' THEN 3 WHEN 'corroborated' THEN 2 WHEN 'candidate_unverified' THEN 1 WHEN 'dismissed' THEN 0 ELSE 1 END"
_LEVEL = "CASE WHEN score >= 4 THEN 'RED' WHEN score >= 2 THEN 'ORANGE' WHEN score >= 1 THEN 'YELLOW' ELSE 'GREEN' END"


@query(with_(_P, _INC, ("j", f"SELECT p.place_id, count(inc.incident_uuid) AS n_incidents, coalesce(max({_SCORE}) FILTER (incident_uuid IS NOT NULL), 0)::BIGINT AS score FROM p LEFT JOIN inc ON round({hav('p.', 'inc.')}, 4) <= 60 GROUP BY p.place_id")) + f" SELECT place_id, n_incidents, score, {_LEVEL} AS level FROM j")
def risk_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents within 60 km of each place, as an equi-join on grid cells."""
    p = derived.places(spark, sf_dir).select("place_id", "lat", "lng")
    return spatial.risk_near(p, derived.incidents(spark, sf_dir).select("incident_uuid", "lat", "lng", "status"), "place_id")


@query(with_(_INC) + f" SELECT incident_uuid, location_name, status FROM inc WHERE (contains(lower(location_name), 'place1') OR contains(lower(state), 'place1')) AND confidence > 20 ORDER BY {_SCORE} DESC, confidence DESC, incident_uuid LIMIT 12")
def risk_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents by place name, the worst first."""
    inc = derived.incidents(spark, sf_dir).filter((F.contains(F.lower("location_name"), F.lit("place1")) | F.contains(F.lower("state"), F.lit("place1"))) & (F.col("confidence") > 20))
    return inc.orderBy(F.desc(lookup(STATUS_SCORE, F.col("status"), 1)), F.desc("confidence"), "incident_uuid").limit(12).select("incident_uuid", "location_name", "status")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.places(spark, sf_dir).select("place_id", "lat", "lng")
    q = p.select(F.col("place_id").alias("other"), F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"), ((F.col("place_id") + 24) % 25).alias("k1"), ((F.col("place_id") + 18) % 25).alias("k2"))
    near = p.join(q, p["place_id"] == q["k1"]).unionByName(p.join(q, p["place_id"] == q["k2"]))
    return near.select("place_id", "other", "lat", "lng", "q_lat", "q_lng")


_PQ = ("pq", "SELECT p.place_id, q.place_id AS other, p.lat, p.lng, q.lat AS qlat, q.lng AS qlng FROM p JOIN p AS q ON q.place_id IN ((p.place_id + 1) % 25, (p.place_id + 7) % 25)")


@query(
    with_(_P, _PQ, ("b", f"SELECT *, {bearing('', 'q')} AS brg FROM pq"))
    + f" SELECT place_id, other, round({hav('', 'q')}, 4) AS km, round(brg, 4) AS bearing, ['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'][1 + (floor(brg / 45.0 + 0.5)::INTEGER % 8)] AS heading, round({dest('lat', 'lng', 'brg', '50.0')[0]}, 5) AS to_lat, round({dest('lat', 'lng', 'brg', '50.0')[1]}, 5) AS to_lng FROM b"
)
def geo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distance, bearing, compass and destination."""
    c = [F.col(x) for x in ("lat", "lng", "q_lat", "q_lng")]
    b = _pairs(spark, sf_dir).withColumn("brg", geo.bearing_deg(*c)).withColumn("to", geo.destination(c[0], c[1], F.col("brg"), F.lit(50.0)))
    return b.select("place_id", "other", F.round(geo.haversine_km(*c), 4).alias("km"), F.round("brg", 4).alias("bearing"), geo.compass(F.col("brg")).alias("heading"), F.round("to.lat", 5).alias("to_lat"), F.round("to.lng", 5).alias("to_lng"))


def _vec(lat: str, lng: str) -> tuple[str, str, str]:
    return f"cos(radians({lat})) * cos(radians({lng}))", f"cos(radians({lat})) * sin(radians({lng}))", f"sin(radians({lat}))"


_V, _W = _vec("lat", "lng"), _vec("qlat", "qlng")
_OM = "acos(greatest(-1.0, least(1.0, " + " + ".join(f"{a} * {b}" for a, b in zip(_V, _W, strict=True)) + ")))"
_N = 12
_PTS = (
    _P,
    _PQ,
    ("o", f"SELECT *, {_OM} AS om, unnest(range({_N})) AS i FROM pq"),
    ("sl", f"SELECT *, sin((1 - i / {_N - 1}.0::DOUBLE) * om) / sin(om) AS s0, sin(i / {_N - 1}.0::DOUBLE * om) / sin(om) AS s1 FROM o"),
    ("xyz", "SELECT *, " + ", ".join(f"s0 * {a} + s1 * {b} AS {n}" for n, a, b in zip("xyz", _V, _W, strict=True)) + " FROM sl"),
    ("pt", f"SELECT place_id * 100 + other AS route, i, CASE WHEN i = {_N - 1} THEN qlat WHEN i = 0 OR om < 1e-9 THEN lat ELSE degrees(atan2(z, sqrt(x * x + y * y))) END AS lat, CASE WHEN i = {_N - 1} THEN qlng WHEN i = 0 OR om < 1e-9 THEN lng ELSE degrees(atan2(y, x)) END AS lng FROM xyz"),
)
_LEGS = (*_PTS, ("leg", f"SELECT route, i AS segment, lat AS alat, lng AS alng, lead(lat) OVER w AS blat, lead(lng) OVER w AS blng FROM pt WINDOW w AS (PARTITION BY route ORDER BY i) QUALIFY i < {_N - 1}"))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _pairs(spark, sf_dir)
    return r.select((F.col("place_id") * 100 + F.col("other")).alias("route"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.col("q_lat").alias("b_lat"), F.col("q_lng").alias("b_lng"))


@query(with_(*_PTS) + " SELECT route::BIGINT AS route, i AS point, round(lat, 6) AS lat, round(lng, 6) AS lng FROM pt")
def corridor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """waypoints of great circles, with exact ends."""
    w = geo.waypoints(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"), _N)
    r = _routes(spark, sf_dir).select("route", F.posexplode(w).alias("point", "p"))
    return r.select(F.col("route").cast("long").alias("route"), F.col("point").cast("long").alias("point"), F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


_KX = "(111.320::DOUBLE * cos(radians(alat)))"
_T = f"CASE WHEN sq <= 1e-12 THEN 0.0 ELSE greatest(0.0, least(1.0, ((lng - alng) * {_KX} * (blng - alng) * {_KX} + (lat - alat) * 110.574::DOUBLE * (blat - alat) * 110.574::DOUBLE) / sq)) END"
_NEAR = (
    *_LEGS,
    _INC,
    ("sel", "SELECT incident_uuid, status, lat, lng FROM inc"),
    ("sq", f"SELECT leg.*, sel.*, pow((blng - alng) * {_KX}, 2) + pow((blat - alat) * 110.574::DOUBLE, 2) AS sq FROM leg, sel"),
    ("tt", f"SELECT *, {_T} AS t FROM sq"),
    ("nn", f"SELECT route, segment, incident_uuid, status, lat, lng, alat + t * (blat - alat) * 110.574::DOUBLE / 110.574::DOUBLE AS nlat, alng + t * (blng - alng) * {_KX} / {_KX} AS nlng FROM tt"),
    ("near", f"SELECT *, round({hav('', 'n')}, 4) AS km FROM nn WHERE round({hav('', 'n')}, 4) <= 55"),
)


def _legs_and_near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    legs = spatial.segments(_routes(spark, sf_dir), "route", _N)
    return legs, spatial.corridor_join(legs, derived.incidents(spark, sf_dir).select("incident_uuid", "status", "lat", "lng"))


@query(with_(*_NEAR, ("g", f"SELECT leg.route, leg.segment, count(near.incident_uuid) AS n_incidents, coalesce(max({_SCORE}) FILTER (near.incident_uuid IS NOT NULL), 0)::BIGINT AS score FROM leg LEFT JOIN near USING (route, segment) GROUP BY ALL")) + f" SELECT route::BIGINT AS route, segment, n_incidents, score, {_LEVEL} AS level FROM g")
def segment_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents along each leg and its level."""
    legs, near = _legs_and_near(spark, sf_dir)
    return spatial.segment_risk(legs, near, "route").withColumn("route", F.col("route").cast("long"))


@query(with_(*_NEAR) + " SELECT route::BIGINT AS route, incident_uuid, round(min(km), 3) AS distance_km FROM near GROUP BY ALL")
def corridor_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each incident of a corridor once, at its nearest."""
    _, near = _legs_and_near(spark, sf_dir)
    out = spatial.corridor_union(near, "route", "incident_uuid")
    return out.select(F.col("route").cast("long").alias("route"), "incident_uuid", F.round("distance_km", 3).alias("distance_km"))


_TERRAIN = "CASE o_orderkey % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'forest' WHEN 2 THEN 'mountain' ELSE 'mixed' END"
_RINGS = (
    _INC,
    ("ring0", "SELECT owner AS case_id, incident_uuid, lat, lng, window_end, row_number() OVER (PARTITION BY owner ORDER BY window_end DESC, incident_uuid DESC) AS n FROM inc"),
    ("ring", "SELECT case_id, incident_uuid, lat, lng, least(250.0, 25.0 * greatest(0.25, (n * 37 % 90) / 12.0::DOUBLE))::DOUBLE AS radius_km, n FROM ring0"),
)


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("owner").orderBy(F.desc("window_end"), F.desc("incident_uuid"))
    r = derived.incidents(spark, sf_dir).withColumn("n", F.row_number().over(w))
    return r.select(F.col("owner").alias("case_id"), "incident_uuid", "lat", "lng", geo.reach_km(F.col("n") * 37 % 90 / 12.0).alias("radius_km"), "n")


@query("SELECT o_orderkey, " + _TERRAIN + " AS terrain, round(least(250.0, CASE " + _TERRAIN + " WHEN 'road' THEN 50.0 WHEN 'forest' THEN 12.0 WHEN 'mountain' THEN 8.0 ELSE 25.0 END * greatest(0.25, (o_orderkey % 50) / 4.0::DOUBLE)), 6)::DOUBLE AS radius_km FROM orders")
def reach_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability by hours and terrain."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    terrain = F.when(k == 0, "road").when(k == 1, "forest").when(k == 2, "mountain").otherwise("mixed")
    return o.select("o_orderkey", terrain.alias("terrain"), F.round(geo.reach_km(F.col("o_orderkey") % 50 / 4.0, terrain), 6).alias("radius_km"))


_CELLS = (
    *_RINGS,
    ("box", "SELECT case_id, min(lat - radius_km / 111.0) AS s, max(lat + radius_km / 111.0) AS n, min(lng - radius_km / (111.0 * cos(radians(lat)))) AS w, max(lng + radius_km / (111.0 * cos(radians(lat)))) AS e FROM ring GROUP BY case_id"),
    ("ij", "SELECT i, j FROM range(49) a(i), range(49) b(j)"),
    ("cell0", "SELECT case_id, i * 49 + j AS cell, s + (n - s) * i / 48.0::DOUBLE AS clat, w + (e - w) * j / 48.0::DOUBLE AS clng FROM box, ij"),
    ("cell", f"SELECT case_id, cell, any_value(clat) AS clat, any_value(clng) AS clng, count(*) AS ring_count FROM cell0 JOIN ring USING (case_id) WHERE round({hav('c', '')}, 4) <= radius_km GROUP BY case_id, cell"),
)


@query(with_(*_CELLS) + " SELECT case_id, ring_count, count(*) AS n_cells FROM cell GROUP BY ALL")
def overlap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice cells by the number of rings that cover them."""
    return spatial.overlap_cells(_rings(spark, sf_dir), "case_id").groupBy("case_id", "ring_count").agg(F.count("*").alias("n_cells"))


@query(
    with_(
        *_CELLS,
        ("mid", "SELECT case_id, ring_count, round(avg(clat), 6) AS zlat, round(avg(clng), 6) AS zlng FROM cell GROUP BY ALL"),
        ("sz", f"SELECT case_id, ring_count, zlat, zlng, greatest(2.0, max(round({hav('z', 'c')}, 4))) AS exact FROM cell JOIN mid USING (case_id, ring_count) GROUP BY ALL"),
        ("tot", "SELECT case_id, count(*) AS total FROM ring GROUP BY case_id"),
        ("cf", "SELECT *, round(greatest(0.0, least(0.95, CASE WHEN total = 1 OR ring_count = 1 THEN 0.30::DOUBLE * (ring_count / total) ELSE ring_count / total END * (0.6::DOUBLE + 0.4::DOUBLE * (1.0::DOUBLE / (1.0 + greatest(0.0, exact - 5.0) / 95.0)))))::DOUBLE, 3) AS confidence, round(exact, 1) AS radius_km FROM sz JOIN tot USING (case_id)"),
    )
    + " SELECT case_id, ring_count, radius_km, confidence, ring_count = max(ring_count) OVER (PARTITION BY case_id) AS priority, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, radius_km, ring_count DESC) AS rank FROM cf"
)
def search_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones where rings agree, with confidence and rank."""
    return spatial.zones(_rings(spark, sf_dir), "case_id").select("case_id", "ring_count", "radius_km", "confidence", "priority", "rank")


_TRAIL = (
    _INC,
    ("t0", "SELECT owner AS case_id, lat, lng, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, row_number() OVER (PARTITION BY owner ORDER BY window_end DESC, incident_uuid DESC) AS r FROM inc WINDOW w AS (PARTITION BY owner ORDER BY window_end, incident_uuid)"),
    ("t1", f"SELECT *, {bearing('p', '')} AS brg FROM t0 WHERE r = 1 AND plat IS NOT NULL"),
)


@query(with_(*_TRAIL, ("arc", "SELECT case_id, lat, lng, brg, unnest(range(-34, 35, 8)) AS a FROM t1")) + f" SELECT case_id, count(*)::BIGINT + 2 AS n_points, round(sum(round({dest('lat', 'lng', '(brg + a)', '80.0')[0]}, 6)), 6) AS sum_lat, round(any_value(brg), 1) AS bearing FROM arc GROUP BY case_id")
def movement_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wedge ahead of the last two points of a trail."""
    inc = derived.incidents(spark, sf_dir)
    w = Window.partitionBy("owner").orderBy("window_end", "incident_uuid")
    t = inc.select(F.col("owner").alias("case_id"), "lat", "lng", F.lag("lat").over(w).alias("p_lat"), F.lag("lng").over(w).alias("p_lng"), F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("window_end"), F.desc("incident_uuid"))).alias("r"))
    t = t.filter("r = 1 and p_lat is not null").withColumn("brg", geo.bearing_deg(F.col("p_lat"), F.col("p_lng"), F.col("lat"), F.col("lng")))
    t = t.withColumn("poly", geo.cone_polygon(F.col("lat"), F.col("lng"), F.col("brg"), F.lit(80.0)))
    arc = F.slice("poly", 2, F.size("poly") - 2)
    return t.select("case_id", F.size("poly").cast("long").alias("n_points"), F.round(F.aggregate(arc, F.lit(0.0), lambda a, p: a + p["lat"]), 6).alias("sum_lat"), F.round("brg", 1).alias("bearing"))


@query(with_(("det", derived.DETECTIONS)) + " SELECT round(lat, 1) AS cell_lat, round(lng, 1) AS cell_lng, count(*) AS n, count(DISTINCT user_id) AS callers FROM det GROUP BY ALL")
def area_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by coarse cell."""
    d = derived.detections(spark, sf_dir).withColumn("cell", geo.area_cell(F.col("lat"), F.col("lng"), 1))
    return d.groupBy(F.col("cell.lat").alias("cell_lat"), F.col("cell.lng").alias("cell_lng")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("callers"))


_KEY = "trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g'))"
_ASKED = (
    _P,
    ("asked0", "SELECT DISTINCT CASE s_suppkey % 6 WHEN 0 THEN n_name WHEN 1 THEN 'Old ' || n_name WHEN 2 THEN n_name || ' LGA' WHEN 3 THEN lower(n_name) || '  town ward' WHEN 4 THEN 'greater ' || n_name || ' area' ELSE 'Nowhere ' || s_suppkey END AS q FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    ("asked", f"SELECT q, {_KEY} AS key FROM asked0"),
    ("loose0", f"SELECT q, key, regexp_replace(regexp_replace(key, '^(?:(?:{'|'.join(sorted(text.AFFIXES, key=len, reverse=True))}) )+', ''), '(?: (?:{'|'.join(sorted(text.AFFIXES, key=len, reverse=True))}))+$', '') AS loose FROM asked"),
    ("idx", "SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key, name, 'exact' AS tier, 0 AS r FROM p UNION ALL SELECT 'n ' || place_id, name, 'alias', 1 FROM p UNION ALL SELECT 'old ' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), name, 'alias', 1 FROM p"),
    ("hit", "SELECT q, name, CASE WHEN tier = 'exact' AND lower(trim(q)) <> lower(name) THEN 'normalised' ELSE tier END AS tier FROM (SELECT q, name, tier, row_number() OVER (PARTITION BY q ORDER BY r, name) AS n FROM asked JOIN idx USING (key)) WHERE n = 1"),
    ("norm", "SELECT q, name, 'normalised' AS tier FROM (SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY r, name) AS n FROM loose0 JOIN idx ON idx.key = loose WHERE q NOT IN (SELECT q FROM hit)) WHERE n = 1"),
    ("rest", "SELECT q, list_distinct(string_split(key, ' ')) AS qw FROM loose0 WHERE loose <> '' AND q NOT IN (SELECT q FROM hit) AND q NOT IN (SELECT q FROM norm)"),
    ("canon", "SELECT name, key, list_distinct(string_split(key, ' ')) AS nw FROM idx WHERE tier = 'exact'"),
    ("part", "SELECT q, name, 'partial' AS tier FROM (SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY len(list_intersect(qw, nw)) DESC, length(key), name) AS n FROM rest JOIN canon ON list_has_all(nw, qw) OR (len(nw) > 1 AND list_has_all(qw, nw))) WHERE n = 1"),
)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k, name = F.col("s_suppkey") % 6, F.col("n_name")
    q = F.when(k == 0, name).when(k == 1, F.concat(F.lit("Old "), name)).when(k == 2, F.concat(name, F.lit(" LGA"))).when(k == 3, F.concat(F.lower(name), F.lit("  town ward"))).when(k == 4, F.concat(F.lit("greater "), name, F.lit(" area"))).otherwise(F.concat(F.lit("Nowhere "), F.col("s_suppkey").cast("string")))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(q.alias("q")).distinct()


@query(with_(*_ASKED) + " SELECT q, name, tier, CASE tier WHEN 'exact' THEN 1.0 WHEN 'alias' THEN 0.95 WHEN 'normalised' THEN 0.85 ELSE 0.55 END::DOUBLE AS score FROM (SELECT * FROM hit UNION ALL SELECT * FROM norm UNION ALL SELECT * FROM part)")
def gazetteer_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place by the tiers that SQL has too; a miss is no row."""
    return gazetteer.resolve(_asked(spark, sf_dir), "q", derived.places(spark, sf_dir))


@query()
def gazetteer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five places of each query through all tiers, the fuzzy one too."""
    return gazetteer.candidates(_asked(spark, sf_dir), "q", derived.places(spark, sf_dir))


@query(with_(*_ASKED, ("lv", "SELECT q, name, levenshtein(asked.key, idx.key)::BIGINT AS distance FROM asked, idx")) + " SELECT q, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, name) AS n FROM lv WHERE distance <= 2) WHERE n = 1")
def gazetteer_fuzzy_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy names by edits."""
    return gazetteer.fuzzy_levenshtein(_asked(spark, sf_dir), "q", derived.places(spark, sf_dir))


@query()
def gazetteer_fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy names by the ratio of matching blocks."""
    return gazetteer.fuzzy_ratio(_asked(spark, sf_dir), "q", derived.places(spark, sf_dir))


@query(with_(("p", derived.PLACES), ("x", "SELECT s_name AS name, s_suppkey % 18 + 0.5::DOUBLE AS lat, s_suppkey % 20 + 0.25::DOUBLE AS lng, 1 AS o FROM supplier UNION ALL SELECT name, lat, lng, 0 FROM p"), ("y", "SELECT name, row_number() OVER (PARTITION BY trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) ORDER BY o, name, lat, lng) AS n FROM x WHERE lat BETWEEN 3 AND 15 AND lng BETWEEN 2 AND 15.5")) + " SELECT name FROM y WHERE n = 1")
def place_dimension_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions merged by key, within the box, the first source wins."""
    p = derived.places(spark, sf_dir).select("name", "lat", "lng")
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 18 + 0.5).alias("lat"), (F.col("s_suppkey") % 20 + 0.25).alias("lng"))
    return gazetteer.merge_places([p, s]).select("name")


@query("SELECT user_id, event_id, CASE WHEN event_type IN ('error', 'purchase') OR user_id % 3 = 0 THEN (400 + user_id % 25 * 40 + event_id % 20) / 100 END AS lat FROM events")
def consent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates only with consent or distress."""
    d = table(spark, sf_dir, "events")
    lat = (F.lit(400) + F.col("user_id") % 25 * 40 + F.col("event_id") % 20) / 100
    return d.select("user_id", "event_id", F.when(F.col("event_type").isin("error", "purchase") | (F.col("user_id") % 3 == 0), lat).alias("lat"))


@query("SELECT event_id, floor(epoch(ts) / 900)::BIGINT AS epoch_no, hour(ts) < 6 OR hour(ts) > 22 AS night, round(1.0 - 0.65::DOUBLE * least(greatest(0.0, date_sub('second', ts, TIMESTAMP '2024-01-31') / 3600.0::DOUBLE) / 72.0, 1.0), 6) AS weight, ts + to_hours(event_id % 24) AS expires_at, try_cast(CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS parsed FROM events")
def time_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsing, ages, weights, expiry, epochs, night."""
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", times.rotation_epoch(F.col("ts")).alias("epoch_no"), times.is_night(F.col("ts")).alias("night"), F.round(times.recency_weight(F.col("ts"), times.now_at("2024-01-31 00:00:00")), 6).alias("weight"), times.expiry(F.col("ts"), (F.col("event_id") % 24).cast("int")).alias("expires_at"), times.parse_iso(raw).alias("parsed"))

"""Small cases with known answers."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from emberline import schemas
from emberline.functions import geo, scoring, signing, text, times
from emberline.operators import clustering, folds, latest, metrics, paging, similarity, spatial

T0 = dt.datetime(2024, 6, 1, 12)


def det(spark, rows):
    """rows: (id, type, hours, source, title, lat, lng, place, state)"""
    return spark.createDataFrame(
        [(i, k, T0 + dt.timedelta(hours=h), s, t, la, lo, p, st, 0, False) for i, k, h, s, t, la, lo, p, st in rows], schemas.DETECTION
    )


def one(df, column):
    return df.select(column).first()[0]


def scored(spark, rows):
    return clustering.incidents(det(spark, rows), times.now_at("2024-06-01 13:00:00")).orderBy("leader_id").collect()


def test_far_pair_of_one_district_is_one_incident(spark):
    rows = [(1, "kidnapping", 0, "Punch", "a b", 10.0, 6.8, "Shiroro", "Niger"), (2, "kidnapping", 1, "Vanguard", "c d", 10.36, 6.8, "Shiroro", "Niger")]
    (only,) = scored(spark, rows)
    assert only.source_count == 2 and only.signal_ids == [1, 2]


def test_urban_pair_is_two_incidents(spark):
    rows = [(1, "armed_robbery", 0, "Punch", "a b", 6.5, 3.3, "Ikeja", "Lagos"), (2, "armed_robbery", 1, "Vanguard", "c d", 6.7, 3.3, "Ajah", "Lagos")]
    assert len(scored(spark, rows)) == 2


def test_wire_copies_are_one_source_and_stay_low(spark):
    title = "Gunmen seize twelve travellers at dawn"
    rows = [(i, "kidnapping", 0, s, title, 10.0, 6.0, "X", "Y") for i, s in enumerate(("Punch", "Vanguard", "ThisDay", "Leadership"), 1)]
    (only,) = scored(spark, rows)
    assert only.source_count == 1 and only.status == "candidate_unverified" and only.confidence <= 45


def test_distinct_reports_are_four_sources(spark):
    titles = ("alpha bravo charlie", "delta echo foxtrot", "golf hotel india", "juliet kilo lima")
    rows = [(i, "kidnapping", 0, s, t, 10.0, 6.0, "X", "Y") for i, (s, t) in enumerate(zip(("Punch", "Vanguard", "ThisDay", "Leadership"), titles, strict=True), 1)]
    (only,) = scored(spark, rows)
    assert only.source_count == 4 and only.confidence > 45


def test_window_and_order(spark):
    rows = [(1, "kidnapping", 0, "a", "a", 10.0, 6.0, "X", "Y"), (2, "kidnapping", 71, "b", "b", 10.0, 6.0, "X", "Y"), (3, "kidnapping", 73, "c", "c", 10.0, 6.0, "X", "Y")]
    assert [r.signal_ids for r in scored(spark, rows)] == [[1, 2], [3]]


def test_clusters_span_weeks_years_and_the_date_line(spark):
    sunday, new_year = 36 + 11, (dt.datetime(2024, 12, 31, 23) - T0).total_seconds() / 3600  # T0 is a Saturday noon
    rows = [(1, "kidnapping", sunday - 12, "a", "a", 10.0, 6.0, "X", "Y"), (2, "kidnapping", sunday + 12, "b", "b", 10.0, 6.0, "X", "Y")]
    rows += [(3, "kidnapping", new_year, "a", "a", 10.0, 6.0, "X", "Y"), (4, "kidnapping", new_year + 2, "b", "b", 10.0, 6.0, "X", "Y")]
    rows += [(5, "police_misconduct", 0, "a", "a", 1.0, 179.95, "P", "S"), (6, "police_misconduct", 1, "b", "b", 1.0, -179.95, "Q", "T")]
    rows += [(7, "police_misconduct", 0, "a", "a", 89.9, 0.0, "P", "S"), (8, "police_misconduct", 1, "b", "b", 89.9, 180.0, "Q", "T")]
    assert [r.signal_ids for r in scored(spark, rows)] == [[1, 2], [3, 4], [5, 6], [7, 8]]


def test_clusters_equal_a_plain_walk(spark):
    """Leaders in order over all earlier clusters of the type, with no blocks and no reduction."""
    import math
    import random

    rng = random.Random(12)
    kinds = ["kidnapping", "armed_robbery", "police_misconduct"]
    rows = [(i, rng.choice(kinds), rng.choice([0, 400]) + rng.randrange(300) / 2, "s", "t", 9.0 + rng.choice([0, 0.1, 0.3, 0.45, 3]), 6.0 + rng.choice([0, 0.1, 0.3, 0.45, 9]), rng.choice(["A", "b ", "B", ""]), rng.choice(["X", "Y", ""])) for i in range(400)]
    lga = {i: rng.choice([None, None, "L1", "L2"]) for i in range(400)}

    def km(a, b):
        x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return round(2 * 6371 * math.asin(math.sqrt(x)), 4)

    want, held = {}, []
    for i, kind, h, _, _, lat, lng, place, state in sorted(rows, key=lambda r: (r[2], r[0])):
        place, state = place.strip().lower(), state.strip().lower()
        for lead, k, at, p, q, s, g in held:
            wide = place and p == place or lga[i] and g == lga[i] or kind == "kidnapping" and state and s == state
            radius = 55 if wide else 18 if kind == "armed_robbery" else 30
            if k == kind and km(q, (lat, lng)) <= radius and h - at <= 72:
                want[i] = lead
                break
        else:
            want[i] = i
            held.append((i, kind, h, place, (lat, lng), state, lga[i]))
    of = spark.createDataFrame(list(lga.items()), "signal_id bigint, lga string")
    got = {r.signal_id: r.leader_id for r in clustering.leaders(det(spark, rows).join(of, "signal_id")).collect()}
    assert got == want


def test_places_missing_are_left_out(spark):
    rows = [(1, "kidnapping", 0, "a", "a", None, 6.0, "X", "Y"), (2, "kidnapping", 0, "b", "b", 10.0, 6.0, None, None)]
    assert [r.signal_ids for r in scored(spark, rows)] == [[2]]


def test_reputation_steps(spark):
    e = spark.createDataFrame([("a", 1, "verified"), ("b", 1, "dismissed"), *(("c", i, "verified") for i in range(12)), *(("d", i, "dismissed") for i in range(8)), ("d", 9, "verified")], "k string, n int, o string")
    got = {r.k: r.score for r in folds.reputation(e, "k", ["n"], "o").collect()}
    assert got == {"a": 56.0, "b": 40.0, "c": 100.0, "d": 6.0}


def test_bands(spark):
    e = spark.createDataFrame([(35.0, 0, 1), (35.0, 0, 0), (70.0, 3, 0), (70.0, 2, 0)], "s double, v int, d int")
    assert [r[0] for r in e.select(scoring.reputation_band(F.col("s"), F.col("v"), F.col("d"))).collect()] == ["low", "neutral", "trusted", "neutral"]
    assert one(spark.range(1), scoring.accuracy(F.lit(0), F.lit(0))) is None


def test_machines(spark):
    e = spark.createDataFrame([(1, 1, "capture_location"), (1, 2, "coordinate"), (1, 3, "operator_ack"), (1, 4, "mark_safe"), (1, 5, "escalate"), (1, 6, "close")], "k int, n int, e string")
    r = folds.state_machine(e, ["k"], ["n"], "e", schemas.SOS_MACHINE, "TRIGGERED").first()
    assert (r.state, r.applied, r.seen) == ("CLOSED", 4, 6)


def test_throttle_counts_only_accepted(spark):
    e = spark.createDataFrame([("k", i, s) for i, s in enumerate((0, 1, 2, 3, 61, 62))], "k string, n int, s bigint")
    r = folds.throttle(e, ["k"], "s", ["n"]).first()
    assert (r.accepted, r.refused) == (5, 1)


def test_funnel(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    signals = spark.createDataFrame([(1, at(0)), (2, at(0))], "incident int, at timestamp_ntz")
    rulings = spark.createDataFrame([(1, "verified", at(10)), (2, "dismissed", at(10))], "incident int, ruling string, at timestamp_ntz")
    alerts = spark.createDataFrame([(1, at(20))], "incident int, at timestamp_ntz")
    r = metrics.funnel(signals, rulings, alerts).first()
    assert (r.signal_to_review_min, r.review_to_alert_min, r.false_positive_rate) == (10.0, 10.0, 0.5)
    r = metrics.funnel(signals.limit(0), rulings.limit(0), alerts.limit(0)).first()
    assert (r.signal_to_review_min, r.review_to_alert_min, r.false_positive_rate, r.dismissed) == (None, None, None, 0)


def test_reach(spark):
    assert one(spark.range(1), geo.reach_km(F.lit(3.0))) == 75.0
    assert one(spark.range(1), geo.reach_km(F.lit(300.0), F.lit("road"))) == 250.0
    assert one(spark.range(1), geo.reach_km(F.lit(None).cast("double"), F.lit("mountain"))) == 2.0


def test_radius_join_equals_all_pairs(spark):
    a = spark.range(60).select(F.col("id").alias("a"), (4 + F.col("id") * 37 % 100 / 40).alias("lat"), (3 + F.col("id") * 53 % 70 / 30).alias("lng"))
    b = a.select(F.col("a").alias("b"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    near = {(r.a, r.b) for r in spatial.radius_join(a, b, 60.0).collect()}
    every = a.crossJoin(b).filter(F.round(geo.haversine_km(*(F.col(c) for c in ("lat", "lng", "r_lat", "r_lng"))), 4) <= 60)
    assert near == {(r.a, r.b) for r in every.collect()} and len(near) > 60


def test_radius_join_at_the_poles_and_over_the_date_line(spark):
    import random

    rng = random.Random(3)
    points = [(i, rng.choice([0.0, 45.0, 70.0, 84.0, 88.5, 89.7, -89.9]) + rng.random() / 4, rng.choice([179.9, -179.9, 0.0, 90.0]) + rng.random() / 20) for i in range(60)]
    left = spark.createDataFrame(points, "i int, lat double, lng double")
    right = left.toDF("j", "r_lat", "r_lng")
    for km in (20.0, 60.0, 400.0):
        got = sorted((r.i, r.j) for r in spatial.radius_join(left, right, km).select("i", "j").collect())
        near = left.crossJoin(right).filter(F.round(geo.haversine_km(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng")), 4) <= km)
        assert got == sorted((r.i, r.j) for r in near.select("i", "j").collect())


def test_ring_cells_equal_all_cells(spark):
    rings = spark.createDataFrame([(1, 9.0, 7.0, 40.0), (1, 9.3, 7.2, 90.0), (1, 12.0, 9.0, 6.25), (2, 80.0, 10.0, 250.0), (2, 79.0, 30.0, 20.0)], "k int, lat double, lng double, radius_km double")
    got = {(r.k, r.cell): r.ring_count for r in spatial.overlap_cells(rings, "k").collect()}
    want = {}
    for k in (1, 2):
        mine = [r for r in rings.collect() if r.k == k]
        import math

        pad = [r.radius_km / (111 * math.cos(math.radians(r.lat))) for r in mine]
        s, n = min(r.lat - r.radius_km / 111 for r in mine), max(r.lat + r.radius_km / 111 for r in mine)
        w, e = min(r.lng - p for r, p in zip(mine, pad, strict=True)), max(r.lng + p for r, p in zip(mine, pad, strict=True))
        for i in range(49):
            for j in range(49):
                a, o = s + (n - s) * i / 48, w + (e - w) * j / 48
                hav = lambda r: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(r.lat - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(r.lat)) * math.sin(math.radians(r.lng - o) / 2) ** 2))  # noqa: B023, E731
                if c := sum(round(hav(r), 4) <= r.radius_km for r in mine):
                    want[k, i * 49 + j] = c
    assert got == want


def test_hash_chain_of_many_batches(spark):
    rows = [(u, n, None if (u, n) == (2, 3) else f"p{u}{n}") for u in (1, 2) for n in range(30)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.u, r.n): (r.prev_hash, r.hash) for r in folds.hash_chain(spark.createDataFrame(rows, "u int, n int, p string"), ["u"], ["n"], "p").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for u, n, p in rows:
        before = last.get(u) or ""
        last[u] = None if p is None else hashlib.sha256((before + p).encode()).hexdigest()
        assert got[u, n] == (before, last[u])


def test_waypoints_and_segment(spark):
    pts = one(spark.range(1), geo.waypoints(F.lit(6.5), F.lit(3.4), F.lit(9.1), F.lit(7.5), 24))
    assert len(pts) == 24 and (pts[0].lat, pts[0].lng, pts[-1].lat, pts[-1].lng) == (6.5, 3.4, 9.1, 7.5)
    d = one(spark.range(1), geo.point_to_segment_km(F.lit(7.8), F.lit(5.4), F.lit(6.5), F.lit(3.4), F.lit(9.1), F.lit(7.5)))
    assert d < 10
    d = one(spark.range(1), geo.point_to_segment_km(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert abs(d - 111.19) < 0.1


def test_text_functions(spark):
    pick = lambda c: one(spark.range(1), c)
    assert pick(text.loose_key(F.lit("Kankara L.G.A"))) == "kankara l g a"
    assert pick(text.loose_key(F.lit("Kankara LGA"))) == "kankara" and pick(text.loose_key(F.lit("town ward"))) == ""
    assert pick(text.place_key(F.lit(" Ñandú—Río "))) == "nandu rio"
    assert pick(text.phone(F.lit("0803 123 4567"))) == "+2348031234567"
    assert pick(text.outlet(F.lit("Punch Metro"))) == "owner:punch" and pick(text.outlet(F.lit("Radio  X"))) == "src:radio x"
    assert pick(text.terrain(F.lit("through the forest toward the highway"))) == "forest" and pick(text.terrain(F.lit("on target"))) == "mixed"
    assert pick(text.content_signature(F.lit("t"), F.lit("p"), F.lit("help 1!"))) == pick(text.content_signature(F.lit("T"), F.lit("p"), F.lit("HELP 22")))
    assert pick(text.incident_type(F.lit("bandit attack"))) == "banditry_attack" and pick(text.incident_type(F.lit(None).cast("string"))) == "other_needs_review"
    assert pick(text.anonymous_ip(F.lit("10.1.2.3"))) == "10.1.2.0/24" and pick(text.anonymous_ip(F.lit(""))) == "?"


KW = text.Keywords(
    {"kidnapping": {"en": ["kidnapped", "ransom demand"]}, "missing_person": {"en": ["went missing", "missing"]}}, weak=frozenset(("missing",)), negative={"sport": ["goal"]}, override=["gunmen"], gates={"missing_person": r"\b(girl|boy)\b"}
)


def test_type_detection(spark):
    pick = lambda t: one(spark.range(1), text.detect_type(F.lit(t), KW))
    assert pick("Two farmers kidnapped at dawn") == "kidnapping"
    assert pick("a RANSOM DEMAND was made") == "kidnapping"
    assert pick("missing reviews") is None and pick("A girl went missing") == "missing_person" and pick("The keys went missing") is None
    assert pick("kidnapped goal") is None and pick("gunmen kidnapped goal keeper after goal") == "kidnapping"
    assert pick("unkidnappedx") is None and pick(None) is None


def test_hmac_and_envelopes(spark):
    df = spark.createDataFrame([("m",), (None,)], "m string")
    macs = [r[0] for r in df.select(signing.hmac_sha256("k")("m")).collect()]
    assert macs == [hmac.new(b"k", b"m", hashlib.sha256).hexdigest(), None]
    c = one(spark.range(1), signing.canonical(F.lit("b"), F.lit(-0.000001), F.lit(3.5), F.lit(7), F.lit(None).cast("string")))
    assert c == "v1|b|0.00000|3.50000|7|"
    assert one(spark.range(1), signing.canonical(F.lit("b"), F.lit(float("nan")), F.lit(3.5), F.lit(7), F.lit("n"))) is None


def test_paging():
    assert paging.page_params({}) == (100, 0) and paging.page_params({"limit": "9999", "cursor": "-4"}) == (500, 0)
    assert paging.page_params({"count": ["x"], "per_page": ["7"]}) == (7, 0) and paging.list_limit(None) == 200


def test_last_page(spark):
    df = spark.range(10)
    rows = paging.page(df, [F.col("id")], 4, 8).collect()
    assert [r.id for r in rows] == [8, 9] and {r.next_offset for r in rows} == {None} and rows[0].total == 10


def test_reconcile_keeps_identity(spark):
    old = spark.createDataFrame([("a", "u1", 3, "f"), ("b", "u2", 1, "f")], "k string, uuid string, version int, fingerprint string")
    new = spark.createDataFrame([("a", "n1", "f"), ("b", "n2", "g"), ("c", "n3", "f")], "k string, fresh_uuid string, fingerprint string")
    got = {r.k: (r.uuid, r.version, r.is_new) for r in latest.reconcile(old, new, ["k"]).collect()}
    assert got == {"a": ("u1", 3, False), "b": ("u2", 2, False), "c": ("n3", 1, True)}


def test_similar_classes(spark):
    rows = [(1, list("abcdefghij")), (2, list("abcdefghij")), (3, list("abcdefghxy")), (4, list("qrs")), (5, []), (6, list("abcdefg"))]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    got = {(r.a, r.b, r.both, r.either) for r in similarity.similar_classes(df, "k", "t").collect()}
    assert got == {(1, 3, 8, 12), (1, 6, 7, 10), (3, 6, 7, 10)}


def _random_sets(spark, n, words, size):
    import random

    r = random.Random(7)
    rows = [[i, r.sample(range(words), r.randint(*size))] for i in range(n)]
    for i in range(0, n, 3):  # near copies, of other sizes too
        rows[i][1] = list({*rows[i // 2][1][: r.randint(2 * size[0] // 3, size[1])], r.randrange(words)})
    rows = [(i, [f"w{w}" for w in t]) for i, t in rows]
    return rows, spark.createDataFrame(rows, "k bigint, t array<string>")


@pytest.mark.parametrize("limits", [{}, {"SETS": 16, "HOT": 8, "WORDS": 64, "BLOCK": 400, "BLOCK_SETS": 3, "LISTED": 0, "AT_ONCE": 64}])
def test_similar_classes_against_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(similarity, name, value)
    rows, df = _random_sets(spark, 240, 300, (3, 150))
    rows = [(i, set(t)) for i, t in rows]
    want = {(a, b, len(s & t), len(s | t)) for a, s in rows for b, t in rows if a < b and s != t and 10 * len(s & t) >= 6 * len(s | t)}
    got = [(r.a, r.b, r.both, r.either) for r in similarity.similar_classes(df, "k", "t").collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_similar_classes_shuffle_no_set_for_each_pair_that_shares_a_word(spark):
    rows, df = _random_sets(spark, 1500, 1000, (80, 120))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert similarity.similar_classes(df, "k", "t").count()
    assert written() - before < 4 * 8 * sum(len(t) for _, t in rows)


def test_times(spark):
    pick = lambda c: one(spark.range(1), c)
    assert pick(times.parse_iso(F.lit("2024-06-01T10:00:00Z"))) == dt.datetime(2024, 6, 1, 10) and pick(times.parse_iso(F.lit("soon"))) is None
    now = times.now_at("2024-06-10 00:00:00")
    assert pick(times.recency_weight(times.now_at("2024-06-11 00:00:00"), now)) == 1.0
    assert abs(pick(times.recency_weight(times.now_at("2024-05-01 00:00:00"), now)) - 0.35) < 1e-9
    assert pick(times.parse_rfc822(F.lit("Sat, 01 Jun 2024 10:00:00 +0100"), now)) == dt.datetime(2024, 6, 1, 9)


def test_journey_rules_in_order(spark):
    now = times.now_at("2024-06-01 12:00:00")
    late = times.now_at("2024-06-01 11:00:00")
    a = lambda kind, battery=None: one(spark.range(1), scoring.journey_assessment(F.lit("active"), F.lit(kind), F.lit(battery).cast("double"), late, F.lit(None).cast("double"), now))
    assert a("duress").level == "critical" and a("arrived").state == "arrived" and a("ping", 5.0).reason == "journey overdue"

"""Sources, sinks and streams on small files."""

import json

from pyspark.sql import functions as F

from emberline.functions import times
from emberline.operators import folds
from emberline.sources import files
from emberline.streaming import pipelines


def test_samples(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"signals": [{"source": "a", "hours_ago": 2, "lang": "en", "title": "t", "text": "x"}]}))
    r = files.samples(spark, str(tmp_path / "s.json"), times.now_at("2024-01-01 12:00:00")).first()
    assert r.source_name == "a" and r.published_at.hour == 10


def test_feed_limit_and_cleaning(spark, tmp_path):
    items = "".join(f"<item><title>T{i} &amp;amp; &lt;b&gt;x&lt;/b&gt;</title><description>d</description><link>l</link><pubDate>bad</pubDate></item>" for i in range(5))
    (tmp_path / "f.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    rows = files.feed(spark, str(tmp_path / "f.xml"), "feed", times.now_at("2024-01-01 12:00:00"), 3).collect()
    assert len(rows) == 3 and {r.title for r in rows} == {f"T{i} & x" for i in range(3)} and rows[0].published_at.hour == 12


def test_bodies(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("nonsense",), ("x" * 40000,)], "body string")
    rows = files.bodies(df, "body", "a INT").select("parsed.a").collect()
    assert sorted((r.a for r in rows), key=str) == [1, None]


def test_gather_and_enrich(spark):
    a = spark.range(2)
    assert files.gather([(a, False)]) is None and files.gather([(a, True), (a, True)]).count() == 4
    assert files.enrich(a, "lat double, name string").first().lat is None


def test_geojson_sink(spark, tmp_path):
    df = spark.createDataFrame([("u", 3.5, 7.25, "verified")], "incident_uuid string, lat double, lng double, status string")
    files.write_geojson(df, str(tmp_path / "out"))
    feature = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert feature["geometry"]["coordinates"] == [7.25, 3.5] and feature["properties"]["status"] == "verified"


def test_stream_throttle_equals_fold(spark, sf_dir):
    e = pipelines.events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withColumn("k", F.col("user_id") % 7)
    accepted = pipelines.run(pipelines.throttle(e, "k", "at", 7200, 2, "60 days")).groupBy("k").count()
    b = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.col("user_id") % 7)
    b = b.withColumn("us", F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts")))
    want = folds.throttle(b, ["k"], "us", ["us", "event_id"], 7200 * 1_000_000, 2)
    assert {r.k: r["count"] for r in accepted.collect()} == {r.k: r.accepted for r in want.collect()}


def test_stream_stale(spark, tmp_path):
    d = tmp_path / "in"
    write = lambda name, rows: spark.createDataFrame(rows, "k string, at string").select("k", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(str(d / name))
    write("a", [("x", "2024-01-01 00:00:00"), ("y", "2024-01-01 05:00:00")])
    write("b", [("y", "2024-01-01 06:00:00")])
    write("c", [("y", "2024-01-01 06:01:00")])
    s = spark.readStream.schema("k string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(d))
    out = pipelines.run(pipelines.stale(s, "k", "at", 30, "1 minute")).collect()
    assert {r.k for r in out} == {"x"}


def test_upsert_sink(spark, tmp_path):
    sink = files.upsert_sink(str(tmp_path / "u"), ["k"], "n")
    sink(spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int"), 0)
    assert [(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "u")).collect()] == [("a", 2)]


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    root = __file__.rsplit("/tests/", 1)[0]
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_limits_and_readiness():
    assert files.ingest_limits({"max_feeds": "900", "timeout_seconds": "x"}) == {"max_feeds": 64, "timeout_seconds": 3, "items_per_feed": 12, "deadline_seconds": 30}
    r = files.launch_readiness({"a": "1", "b": " "}, ("a", "b"), ("c",))
    assert r == {"ready": False, "blockers": ["b"], "warnings": ["c"], "providers": {"c": False}}


def test_start_resumes(spark, tmp_path):
    d = str(tmp_path)
    for i in range(2):
        spark.range(i * 3, i * 3 + 3).write.mode("append").parquet(f"{d}/in")
        q = pipelines.start(spark.readStream.schema("id bigint").parquet(f"{d}/in"), f"{d}/out", f"{d}/state", "1 second")
        q.processAllAvailable()
        q.stop()
    assert sorted(r.id for r in spark.read.parquet(f"{d}/out").collect()) == list(range(6))


def test_cached_resolution(spark):
    from emberline.operators import gazetteer

    places = spark.createDataFrame([("Old Mill", ["Mill"]), ("Kara", [])], "name string, aliases array<string>")
    asked = spark.createDataFrame([("mill",), ("kara town",), ("nowhere",), ("known",)], "q string")
    cache = spark.createDataFrame([("known", "Kara", "exact", 1.0), ("nowhere", None, "miss", 0.0)], "q string, name string, tier string, score double")
    got = {r.q: (r["name"], r.tier) for r in gazetteer.resolve_cached(asked, "q", places, cache).collect()}
    assert got == {"mill": ("Old Mill", "alias"), "kara town": ("Kara", "normalised"), "known": ("Kara", "exact")}


def test_fuzzy_ratio_is_the_library_ratio(spark):
    import difflib

    from emberline.operators import gazetteer

    names = ["Kankara", "Kankiya", "Katsina", "Kara"]
    places = spark.createDataFrame([(n, []) for n in names], "name string, aliases array<string>")
    asked = [("kankra",), ("katsena",), ("zzz",)]
    got = {r.q: (r["name"], r.ratio) for r in gazetteer.fuzzy_ratio(spark.createDataFrame(asked, "q string"), "q", places).collect()}
    for (q,) in asked:
        ratio, name = max((difflib.SequenceMatcher(None, q, n.lower()).ratio(), n) for n in names)
        assert got.get(q) == ((name, round(ratio, 6)) if ratio >= 0.82 else None)


def test_health(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/in")
    health = pipelines.Health()
    spark.streams.addListener(health)
    try:
        q = pipelines.start(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", "1 second")
        q.processAllAvailable()
        q.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(health)
    assert sum(r["rows"] for r in health.runs.values()) >= 4


def plain_key(x):
    import re
    import unicodedata

    x = "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c)).replace("'", "").replace("\u2019", "").replace("`", "")
    return " ".join(re.sub("[^a-z0-9]+", " ", x).split())


def plain_loose(x):
    from emberline.functions.text import AFFIXES

    key = plain_key(x)
    for _ in range(9):
        for a in sorted(AFFIXES, key=len, reverse=True):
            key = "" if key == a else key.removeprefix(a + " ").removesuffix(" " + a)
    return key


def test_candidates_equal_a_plain_search(spark):
    """All tiers in order over every name, by plain loops and the library's ratio."""
    import difflib
    import random

    from emberline.functions.text import AFFIXES
    from emberline.operators import gazetteer

    rng = random.Random(4)
    names = ["Kankara", "Kankiya", "Katsina", "Kara", "Ado-Ekiti", "Birnin Gwari", "Birnin Kebbi", "Gwari", "Oyo", "Old Mill", "Zango Kataf", "Ka"]
    aliases = {n: [n[::-1], "Port " + n] for n in names[:5]}
    places = spark.createDataFrame([(n, aliases.get(n, [])) for n in names], "name string, aliases array<string>")
    asked = [*names, "KANKARA", "Ado Ekiti", "Kankara LGA", "Port Kara", "lga", "town", "", "Birnin", "Gwari town", "the Old Mill of Oyo", "ka", "k"]
    for n in names:
        for _ in range(12):  # typos anywhere, the first letter too
            t = list(n)
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], [rng.choice("abkrz")], [t[at], rng.choice("abkrz")]])
                t = t or ["a"]
            asked.append("".join(t))
    got = {}
    for r in gazetteer.candidates(spark.createDataFrame([(q,) for q in asked], "q string"), "q", places).collect():
        got.setdefault(r.q, []).append((r.position, r["name"], r.tier))
    index = {}
    for n in names:
        index.setdefault(plain_key(n), (n, "exact"))
    for n in sorted(aliases):
        for a in aliases[n]:
            index.setdefault(plain_key(a), (n, "alias"))
    for q in set(asked):
        key, loose, out = plain_key(q), plain_loose(q), {}
        if key and (loose or key not in AFFIXES):
            if key in index:
                n, tier = index[key]
                out[n] = "normalised" if tier == "exact" and q.strip().lower() != n.lower() else tier
            if loose in index:
                out.setdefault(index[loose][0], "normalised")
            for ratio, n in sorted(((difflib.SequenceMatcher(None, key, plain_key(n)).ratio(), n) for n in names), key=lambda x: (-x[0], x[1])):
                if ratio >= 0.82:
                    out.setdefault(n, "fuzzy")
            w = set(key.split())
            part = [(-len(w & c), len(plain_key(n)), n) for n in names for c in [set(plain_key(n).split())] if w <= c or len(c) > 1 and c <= w]
            for _, _, n in sorted(part):
                out.setdefault(n, "partial")
        assert [(n, t) for _, n, t in sorted(got.get(q, []))] == list(out.items())[:5], q


def test_two_edits_lose_no_name(spark):
    import random

    from emberline.operators import gazetteer

    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(60)})
    places = spark.createDataFrame([(n, []) for n in names], "name string, aliases array<string>")
    asked = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(60)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = {r.q: (r.distance, r["name"]) for r in gazetteer.fuzzy_levenshtein(spark.createDataFrame([(q,) for q in asked], "q string"), "q", places).collect()}
    for q in asked:
        best = min((edits(q, n), n) for n in names)
        assert got.get(q) == (best if best[0] <= 2 else None)


def test_built_dimension(spark, tmp_path):
    from emberline.operators import gazetteer

    rows = spark.createDataFrame([("Ado-Ekiti", "Ekiti", 7.6, 5.2), ("ado ekiti", "Ekiti", 7.7, 5.3), ("Kara LGA", "Niger", 9.0, 6.0), ("Kara", "Oyo", 8.0, 4.0), ("Nowhere", "Oyo", None, 4.0)], "name string, state string, lat double, lng double")
    built = gazetteer.build(rows, "lga", "census")
    got = {(r["name"], r.state): r.aliases for r in built.collect()}
    assert set(got) == {("Ado-Ekiti", "Ekiti"), ("Kara LGA", "Niger"), ("Kara", "Oyo")}
    assert "Ado Ekiti" in got["Ado-Ekiti", "Ekiti"] and "Kara" in got["Kara LGA", "Niger"] and "Kara LGA" in got["Kara", "Oyo"]
    gazetteer.write_dimension(built, f"{tmp_path}/d")
    assert spark.read.json(f"{tmp_path}/d").filter("kind = 'lga'").count() == 3
    (total,) = gazetteer.coverage(built).filter("level = 3").collect()
    assert (total.n_places, total.n_states, total.nationwide) == (3, 3, False)


def test_kpi_record_without_tables(spark):
    from emberline.operators import metrics

    timing = spark.sql("select 10.0D signal_to_review_min, 10.0D review_to_alert_min, 1L dismissed, 2L judged, 0.5D false_positive_rate, 1L verified")
    sos = spark.createDataFrame([("SAFE",), ("TRIGGERED",)], "state string")
    tasks = spark.sql("select 'received' state, timestamp_ntz'2024-01-01 10:00:00' created_at, cast(null as timestamp_ntz) ack_at union all select 'reviewing', timestamp_ntz'2024-01-01 10:00:00', timestamp_ntz'2024-01-01 10:05:00'")
    cases = spark.createDataFrame([("active",), ("located",)], "status string")
    sent = spark.createDataFrame([(0,), (1,)], "sim int")
    r = metrics.kpis(timing, spark.createDataFrame([(True,)], "active boolean"), sos, tasks, cases, sent).first()
    assert (r.signal_to_review_min, r.review_to_alert_min, r.alerts_active, r.false_positive_rate) == (10.0, 10.0, 1, 0.5)
    assert (r.sos_open, r.sos_safe, r.sos_total, r.responder_ack_rate, r.responder_within_sla, r.responder_sla_rate) == (1, 1, 2, 0.5, 1, 0.5)
    assert (r.cases_open, r.cases_resolved, r.deliveries, r.deliveries_real, r.deliveries_sim) == (1, 1, 2, 1, 1)
    assert (r.verified_emergencies, r.acknowledged_responses, r.within_sla_rate, r.ack_sla_min) == (1, 1, 0.5, 30)
    less = metrics.kpis(cases=cases).first()
    assert less.cases_open == 1 and less.sos_open is None and less.recipient_ack_rate is None and len(less) == len(r)


def test_public_views_show_allowed_columns_only(spark):
    from emberline.functions import views

    rows = spark.sql("select 'u' user_uuid, 'S. Eke' first_name, '08031234567' phone_display, 'g' guardian_uuid, '' name, 'ann@example.org' address, 1 verified, cast(null as int) active, 'secret' pin_hash, 'j' journey_uuid, 'h' handoff_ref, 9.1D last_lat, 'e' evidence_uuid")
    for view, specs in views.VIEWS.items():
        seen = views.public(rows, view)
        assert "pin_hash" not in seen.columns and "last_lat" not in seen.columns and len(seen.columns) == len(specs) + len(views.MARKS.get(view, {}))
    g = views.public(rows, "guardian").first()
    assert (g["name"], g.channel, g.verified, g.active) == ("Guardian", "sms", True, False) and "ann" not in g.address_redacted
    u = views.public(rows, "user").first()
    assert u.language == "en" and "31234" not in u.phone
    assert views.public(rows, "journey").first().coords_redacted and views.public(rows, "evidence").first().restricted


def test_feeds_within_a_budget(spark):
    from emberline.sources.files import within_budget

    now = iter([0, 1, 2, 9, 99])
    broken = lambda: spark.read.parquet("/no/such/folder")
    got = within_budget([lambda: spark.range(1), broken, lambda: spark.range(3), lambda: spark.range(4)], 5, lambda: next(now))
    assert [df.count() for df in got] == [1]

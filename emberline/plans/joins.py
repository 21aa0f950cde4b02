"""Queries that join, aggregate and order: funnels, latest decisions, anchors, fallbacks, shares, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import scoring, text, times
from emberline.operators import folds, gazetteer, latest, metrics
from emberline.plans.registry import query, with_
from emberline.schemas import ALERT_TTL_HOURS, STATUS_SCORE, lookup
from emberline.sources import derived
from emberline.sources.files import table, table_or_none

NOW = "2001-08-03 00:00:00"
_INC, _DEC = ("inc", derived.INCIDENTS), ("dec", derived.DECISIONS)
_LATEST = ("lastd", "SELECT incident, ruling, ruled_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY seq DESC) AS n FROM dec) WHERE n = 1")


def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest(derived.decisions(spark, sf_dir), ["incident"], [F.desc("seq")])


@query(with_(_DEC, _LATEST) + " SELECT incident, ruling, ruled_at FROM lastd")
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ruling of each incident."""
    return latest_decisions(spark, sf_dir).select("incident", "ruling", "ruled_at")


_AGE = f"greatest(0.0, date_sub('second', window_end, TIMESTAMP '{NOW}') / 3600.0::DOUBLE)"
_FEED = (_INC, _DEC, _LATEST, ("feed", f"SELECT inc.incident_uuid, coalesce(CASE WHEN ruling = 'verified' THEN 'verified' WHEN ruling = 'dismissed' THEN 'dismissed' END, status) AS status, ruling IN ('verified', 'dismissed') AS decided, round({_AGE}, 4) AS age_hours, confidence, severity, lat, lng, location_name, state FROM inc LEFT JOIN lastd ON incident = incident_uuid"))
_FRESH = "age_hours <= CASE status WHEN 'verified' THEN 240 WHEN 'needs_human_review' THEN 96 WHEN 'corroborated' THEN 72 ELSE 48 END"


def with_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with their latest ruling: status overridden, decided, age."""
    d = latest_decisions(spark, sf_dir).select(F.col("incident").alias("incident_uuid"), "ruling")
    j = derived.incidents(spark, sf_dir).join(d, "incident_uuid", "left")
    now = times.now_at(NOW)
    status = F.when(F.col("ruling").isin("verified", "dismissed"), F.col("ruling")).otherwise(F.col("status"))
    return j.withColumn("decided", F.col("ruling").isin("verified", "dismissed")).withColumn("status", status).withColumn("age_hours", F.round(times.age_hours(F.col("window_end"), now), 4))


@query(with_(*_FEED) + f" SELECT incident_uuid, status, decided, age_hours FROM feed WHERE status <> 'dismissed' AND {_FRESH}")
def public_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the public sees: not dismissed, and fresh for its status."""
    feed = with_decisions(spark, sf_dir).filter((F.col("status") != "dismissed") & times.is_fresh(F.col("status"), F.col("window_end"), times.now_at(NOW)))
    return feed.select("incident_uuid", "status", "decided", "age_hours")


@query(with_(*_FEED) + f" SELECT incident_uuid, status, confidence::BIGINT AS confidence FROM feed WHERE NOT coalesce(decided, false) AND status IN ('needs_human_review', 'corroborated') AND {_FRESH} ORDER BY confidence DESC, incident_uuid")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided, of two statuses, fresh; by confidence."""
    f = with_decisions(spark, sf_dir).filter(~F.coalesce("decided", F.lit(False)) & F.col("status").isin("needs_human_review", "corroborated"))
    f = f.filter(times.is_fresh(F.col("status"), F.col("window_end"), times.now_at(NOW)))
    return f.orderBy(F.desc("confidence"), "incident_uuid").select("incident_uuid", "status", "confidence")


@query("SELECT o_orderkey, l_linenumber, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def incident_signals_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with their signals."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, n_name, count(*) AS n, median(o_totalprice) AS median_price FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def three_way_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way chain with an exact median."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    j = c.join(o, c["c_custkey"] == o["o_custkey"]).join(n, n["n_nationkey"] == c["c_nationkey"])
    return j.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.median("o_totalprice").alias("median_price"))


@query("SELECT o_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7 ORDER BY l_shipdate DESC, o_orderkey DESC, l_linenumber DESC, l_partkey DESC LIMIT 20")
def checkins_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check-ins of an owner's sessions, newest first."""
    o = table(spark, sf_dir, "orders").filter("o_custkey = 7")
    j = table(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.orderBy(F.desc("l_shipdate"), F.desc("o_orderkey"), F.desc("l_linenumber"), F.desc("l_partkey")).limit(20).select("o_orderkey", "l_linenumber", "l_shipdate")


@query(
    with_(_DEC, _LATEST, ("s", "SELECT o_orderkey AS incident, o_orderdate AS seen FROM orders"), ("a", "SELECT o_orderkey AS incident, o_orderdate + INTERVAL 300 DAY AS seen FROM orders WHERE o_orderkey % 3 = 0"))
    + """ SELECT (SELECT median(m) FROM (SELECT date_sub('second', s.seen, l.ruled_at) / 60.0::DOUBLE AS m FROM s JOIN lastd l USING (incident)) WHERE m >= 0) AS signal_to_review_min,
 (SELECT median(m) FROM (SELECT date_sub('second', l.ruled_at, a.seen) / 60.0::DOUBLE AS m FROM a JOIN lastd l USING (incident) WHERE ruling = 'verified') WHERE m >= 0) AS review_to_alert_min,
 count(*) FILTER (ruling = 'dismissed') AS dismissed, count(*) FILTER (ruling IN ('verified', 'dismissed')) AS judged,
 count(*) FILTER (ruling = 'dismissed') / nullif(count(*) FILTER (ruling IN ('verified', 'dismissed')), 0)::DOUBLE AS false_positive_rate FROM lastd"""
)
def funnel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the funnel and the false-positive rate."""
    o = table(spark, sf_dir, "orders")
    signals = o.select(F.col("o_orderkey").alias("incident"), F.col("o_orderdate").alias("at"))
    alerts = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("incident"), (F.col("o_orderdate") + F.expr("INTERVAL 300 DAYS")).alias("at"))
    return metrics.funnel(signals, latest_decisions(spark, sf_dir).withColumnRenamed("ruled_at", "at"), alerts)


@query(
    "WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'received' WHEN 'P' THEN 'reviewing' ELSE 'closed' END AS state, o_orderdate AS c, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderdate + to_minutes(o_orderkey % 97) END AS a FROM orders) "
    "SELECT count(*) AS tasks, count(*) FILTER (a IS NOT NULL OR state <> 'received') AS acked, count(*) FILTER (date_sub('second', c, a) <= 1800) AS within_sla, acked / tasks::DOUBLE AS ack_rate, within_sla / tasks::DOUBLE AS sla_rate FROM t"
)
def ack_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgement and SLA rates over all tasks."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "received").when(F.col("o_orderstatus") == "P", "reviewing").otherwise("closed")
    ack = F.when(F.col("o_orderkey") % 4 != 1, F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 97).cast("int")))
    return metrics.acknowledgement(o.select(state.alias("state"), F.col("o_orderdate").alias("created_at"), ack.alias("ack_at")))


_KPI = """,
 t AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'received' WHEN 'P' THEN 'reviewing' ELSE 'closed' END AS state, o_orderdate AS c, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderdate + to_minutes(o_orderkey % 97) END AS ack FROM orders),
 r AS (SELECT count(*) AS n, count(*) FILTER (ack IS NOT NULL OR state <> 'received') AS acked, count(*) FILTER (date_sub('second', c, ack) <= 1800) AS quick FROM t),
 s AS (SELECT CASE o_orderkey % 7 WHEN 0 THEN 'SAFE' WHEN 1 THEN 'CLOSED' ELSE 'TRIGGERED' END AS state FROM orders),
 x AS (SELECT CASE c_custkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'located' WHEN 2 THEN 'recovered' ELSE 'closed' END AS status FROM customer),
 v AS (SELECT count(*) AS n, count(*) FILTER (l_linenumber = 2) AS sim, count(*) FILTER (l_returnflag = 'R') AS acked FROM lineitem)"""


@query(
    with_(_DEC, _LATEST, ("a", "SELECT o_orderkey AS incident, o_orderdate + INTERVAL 300 DAY AS seen FROM orders WHERE o_orderkey % 3 = 0")) + _KPI
    + """ SELECT (SELECT median(m) FROM (SELECT date_sub('second', o_orderdate, l.ruled_at) / 60.0::DOUBLE AS m FROM orders JOIN lastd l ON incident = o_orderkey) WHERE m >= 0) AS signal_to_review_min,
 (SELECT median(m) FROM (SELECT date_sub('second', l.ruled_at, a.seen) / 60.0::DOUBLE AS m FROM a JOIN lastd l USING (incident) WHERE ruling = 'verified') WHERE m >= 0) AS review_to_alert_min,
 count(*) FILTER (ruling = 'dismissed') AS false_positive_dismissed, count(*) FILTER (ruling IN ('verified', 'dismissed')) AS false_positive_judged, count(*) FILTER (ruling = 'dismissed') / nullif(count(*) FILTER (ruling IN ('verified', 'dismissed')), 0)::DOUBLE AS false_positive_rate, count(*) FILTER (ruling = 'verified') AS verified_emergencies,
 NULL AS alerts_active, (SELECT count(*) FROM s) AS sos_total, (SELECT count(*) FROM s WHERE state NOT IN ('SAFE', 'CLOSED')) AS sos_open, (SELECT count(*) FROM s WHERE state = 'SAFE') AS sos_safe, (SELECT count(*) FROM s WHERE state = 'CLOSED') AS sos_closed,
 (SELECT n FROM r) AS responder_total, (SELECT acked FROM r) AS responder_acknowledged, (SELECT acked / n::DOUBLE FROM r) AS responder_ack_rate, (SELECT quick FROM r) AS responder_within_sla, (SELECT quick / n::DOUBLE FROM r) AS responder_sla_rate,
 (SELECT count(*) FROM x WHERE status = 'active') AS cases_open, (SELECT count(*) FROM x WHERE status IN ('located', 'recovered')) AS cases_resolved,
 (SELECT n FROM v) AS deliveries, (SELECT n - sim FROM v) AS deliveries_real, (SELECT sim FROM v) AS deliveries_sim, (SELECT acked FROM v) AS deliveries_acknowledged, (SELECT acked / n::DOUBLE FROM v) AS recipient_ack_rate,
 (SELECT acked FROM r) AS acknowledged_responses, (SELECT quick / n::DOUBLE FROM r) AS within_sla_rate, 30 AS ack_sla_min FROM lastd"""
)
def kpi_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The KPI record; the table of alerts is absent, so that headline is unknown."""
    o, l, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")  # noqa: E741
    last = latest_decisions(spark, sf_dir).withColumnRenamed("ruled_at", "at")
    signals = o.select(F.col("o_orderkey").alias("incident"), F.col("o_orderdate").alias("at"))
    warned = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("incident"), (F.col("o_orderdate") + F.expr("INTERVAL 300 DAYS")).alias("at"))
    timing = metrics.funnel(signals, last, warned).crossJoin(last.agg(F.count_if(F.col("ruling") == "verified").alias("verified")))
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "O", "received").when(F.col("o_orderstatus") == "P", "reviewing").otherwise("closed")
    ack = F.when(k % 4 != 1, F.col("o_orderdate") + F.make_dt_interval(mins=(k % 97).cast("int")))
    status = F.when(F.col("c_custkey") % 5 == 0, "active").when(F.col("c_custkey") % 5 == 1, "located").when(F.col("c_custkey") % 5 == 2, "recovered").otherwise("closed")
    return metrics.kpis(
        timing,
        table_or_none(spark, sf_dir, "alerts"),
        o.select(F.when(k % 7 == 0, "SAFE").when(k % 7 == 1, "CLOSED").otherwise("TRIGGERED").alias("state")),
        o.select(state.alias("state"), F.col("o_orderdate").alias("created_at"), ack.alias("ack_at")),
        c.select(status.alias("status")),
        l.select((F.col("l_linenumber") == 2).cast("int").alias("sim")),
        l.filter("l_returnflag = 'R'"),
    )


@query("SELECT o_orderstatus, count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS open_cases, count(*) FILTER (o_totalprice > 250000) / nullif(count(*), 0)::DOUBLE AS dear_rate FROM orders GROUP BY ROLLUP (o_orderstatus)")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts by state and in all."""
    o = table(spark, sf_dir, "orders")
    g = o.rollup("o_orderstatus").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("open_cases"), F.count_if(F.col("o_totalprice") > 250000).alias("dear"))
    return g.select("o_orderstatus", "total", "urgent", "open_cases", scoring.rate(F.col("dear"), F.col("total")).alias("dear_rate"))


_ALERT_STATE = "CASE o_orderkey % 4 WHEN 0 THEN 'PUBLISHED' WHEN 1 THEN 'UPDATED' WHEN 2 THEN 'CANCELLED' ELSE 'EXPIRED' END"
_LABEL = "CASE o_custkey % 5 WHEN 0 THEN 'RED' WHEN 1 THEN 'ORANGE' WHEN 2 THEN 'YELLOW' WHEN 3 THEN 'GREEN' ELSE 'WARNING' END"
_HOURS = "CASE label WHEN 'RED' THEN 24 WHEN 'ORANGE' THEN 12 WHEN 'YELLOW' THEN 6 WHEN 'GREEN' THEN 3 ELSE 24 END"


@query(f"WITH a AS (SELECT o_orderkey, {_ALERT_STATE} AS state, {_LABEL} AS label, o_orderdate + to_hours(o_orderkey % 30) AS created FROM orders) SELECT o_orderkey, label, created + to_hours({_HOURS}) AS expires_at, state IN ('PUBLISHED', 'UPDATED') AND TIMESTAMP '1999-06-02 00:00:00' <= created + to_hours({_HOURS}) AS active FROM a")
def alert_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle state and time to live together make an alert live."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    state = F.when(k == 0, "PUBLISHED").when(k == 1, "UPDATED").when(k == 2, "CANCELLED").otherwise("EXPIRED")
    c = F.col("o_custkey") % 5
    label = F.when(c == 0, "RED").when(c == 1, "ORANGE").when(c == 2, "YELLOW").when(c == 3, "GREEN").otherwise("WARNING")
    created = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 30).cast("int"))
    a = o.select("o_orderkey", state.alias("state"), label.alias("label"), created.alias("created"))
    expires = times.expiry(F.col("created"), lookup(ALERT_TTL_HOURS, F.col("label"), 24))
    return a.select("o_orderkey", "label", expires.alias("expires_at"), (F.col("state").isin("PUBLISHED", "UPDATED") & (times.now_at("1999-06-02 00:00:00") <= expires)).alias("active"))


@query("SELECT c_custkey, count(o_orderkey) AS n_sightings, coalesce(max(o_orderdate), TIMESTAMP '1990-01-01') AS seen_at, coalesce(arg_max(o_orderkey, (o_orderdate, o_orderkey)), -1) AS anchor FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def case_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's newest sighting, else where it was last seen; one join instead of a lookup per case."""
    o = table(spark, sf_dir, "orders")
    s = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("at"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("k"))
    c = table(spark, sf_dir, "customer").join(s, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_sightings"), F.coalesce("at", times.now_at("1990-01-01 00:00:00")).alias("seen_at"), F.coalesce("k", F.lit(-1)).cast("long").alias("anchor"))


@query("WITH s AS (SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000), m AS (SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM s)) SELECT n_nationkey, count(*) AS n_responders, min(s_suppkey) AS first_responder, true AS own FROM s GROUP BY n_nationkey UNION ALL SELECT n_nationkey, count(*), min(s_suppkey), false FROM m JOIN supplier ON s_acctbal > 2000 GROUP BY n_nationkey")
def fallback_responders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responders of the state, else all active ones. Both are summed first; a state without any takes the one row of the fallback."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    sums = F.count("*").alias("n_responders"), F.min("s_suppkey").alias("first_responder")
    own = n.join(s.filter("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(*sums), "n_nationkey").select("n_nationkey", "n_responders", "first_responder", F.lit(True).alias("own"))
    rest = n.select("n_nationkey").join(own, "n_nationkey", "left_anti")
    other = rest.crossJoin(F.broadcast(s.filter("s_acctbal > 2000").agg(*sums)))  # one row
    return own.unionByName(other.filter("n_responders > 0").withColumn("own", F.lit(False)))


@query("SELECT user_id, coalesce(max(CASE WHEN c_custkey = user_id THEN c_name END), max(CASE WHEN o_orderkey = user_id THEN concat('order ', o_custkey) END), 'none') AS contact FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = user_id LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) ON o_orderkey = user_id GROUP BY user_id")
def sos_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact by policy id, else by owner token."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    c = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("user_id"), F.concat(F.lit("order "), F.col("o_custkey").cast("string")).alias("other"))
    return u.join(c, "user_id", "left").join(o, "user_id", "left").select("user_id", F.coalesce("c_name", "other", F.lit("none")).alias("contact"))


@query("WITH e AS (SELECT DISTINCT user_id, floor(epoch(ts) / 900)::BIGINT AS epoch_no FROM events), b AS (SELECT user_id, epoch_no, substr(sha256('k|' || user_id || '|' || epoch_no), 1, 16) AS beacon FROM e) SELECT b.beacon, b.user_id AS case_id, count(*) AS n FROM b JOIN b AS c USING (beacon) GROUP BY ALL")
def rotating_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beacons resolved to cases by recomputing the rotating id of each case and epoch, as an equi-join."""
    e = table(spark, sf_dir, "events").select("user_id", times.rotation_epoch(F.col("ts")).alias("epoch_no")).distinct()
    b = e.select("user_id", F.substring(F.sha2(F.concat_ws("|", F.lit("k"), F.col("user_id").cast("string"), F.col("epoch_no").cast("string")).cast("binary"), 256), 1, 16).alias("beacon"))
    seen = b.select("beacon")
    return b.join(seen, "beacon").groupBy("beacon", F.col("user_id").alias("case_id")).agg(F.count("*").alias("n"))


@query(with_(("det", derived.DETECTIONS)) + " SELECT source_name, CASE source_name WHEN 'Punch Metro' THEN 'owner:punch' WHEN 'BBC News Pidgin' THEN 'wire:bbc' WHEN 'Reuters' THEN 'wire:reuters' WHEN 'Vanguard' THEN 'owner:vanguard' ELSE 'src:' || lower(source_name) END AS outlet, count(*) AS n FROM det GROUP BY ALL")
def outlet_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of sources."""
    return derived.detections(spark, sf_dir).groupBy("source_name", text.outlet(F.col("source_name")).alias("outlet")).agg(F.count("*").alias("n"))


@query(with_(("p", f"SELECT *, CASE WHEN place_id % 3 > 0 THEN state END AS source FROM ({derived.PLACES})"), ("k", "SELECT coalesce(kind, 'town') AS kind, coalesce(source, 'built-in') AS source, state FROM p")) + " SELECT kind, source, count(*) AS n_places, count(DISTINCT state) AS n_states, grouping(kind, source)::BIGINT AS level, count(*) FILTER (kind = 'lga') >= 774 AND count(*) FILTER (kind = 'ward') >= 8000 AS nationwide FROM k GROUP BY GROUPING SETS ((kind), (source), ())")
def coverage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the gazetteer by kind and by source in one pass."""
    return gazetteer.coverage(derived.places(spark, sf_dir).withColumn("source", F.when(F.col("place_id") % 3 > 0, F.col("state"))))


_HOUR = "date_trunc('hour', ts)"


@query(
    "WITH e AS (SELECT event_type, date_trunc('hour', ts) AS day, ts, user_id % 9 AS caller, round(user_id % 6 / 7.0::DOUBLE, 2) AS area FROM events), "
    "b AS (SELECT event_type, day, count(*) AS n_reports, round(date_sub('second', min(ts), max(ts)) / 60.0::DOUBLE, 3) AS span_min FROM e GROUP BY ALL), "
    "c AS (SELECT event_type, day, round(max(n) / sum(n), 3) AS caller_share FROM (SELECT event_type, day, caller, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL), "
    "a AS (SELECT event_type, day, round(max(n) / sum(n), 3) AS area_share FROM (SELECT event_type, day, area, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL) "
    "SELECT event_type, day, n_reports, CASE WHEN n_reports < 2 THEN 0.0 ELSE span_min END AS span_min, caller_share, area_share, n_reports >= 4 AND span_min <= 45 AS burst, n_reports >= 4 AND span_min <= 45 AND (caller_share >= 0.3 OR area_share >= 0.3) AS coordinated FROM b JOIN c USING (event_type, day) JOIN a USING (event_type, day)"
)
def coord_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts within an hour, and whether a caller or an area dominates them."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return metrics.coordination(e, ["event_type", "day"], F.col("user_id") % 9, F.round(F.col("user_id") % 6 / F.lit(7.0), 2), "ts", 4, 45.0, 0.3)


_TITLE = "list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) > 1 AND w <> 'near'))"


@query(
    with_(
        ("det", derived.DETECTIONS),
        ("e", f"SELECT user_id, date_trunc('day', published_at) AS day, signal_id, {_TITLE} AS t FROM det WHERE len({_TITLE}) > 0"),
        ("k", "SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY signal_id) AS n FROM e"),
        (
            "s",
            "SELECT user_id, day, n, [struct_pack(t := t, c := 1)] AS g FROM k WHERE n = 1 UNION ALL SELECT user_id, day, n, CASE WHEN at_ = 0 THEN list_append(g, struct_pack(t := t, c := 1)) ELSE list_transform(g, lambda x, i: CASE WHEN i = at_ THEN struct_pack(t := x.t, c := x.c + 1) ELSE x END) END FROM "
            "(SELECT k.user_id, k.day, k.n, k.t, s.g, coalesce(list_position(list_transform(s.g, lambda x: 10 * len(list_intersect(x.t, k.t)) >= 6 * (len(x.t) + len(k.t) - len(list_intersect(x.t, k.t)))), true), 0) AS at_ FROM s JOIN k ON s.user_id = k.user_id AND s.day = k.day AND k.n = s.n + 1)",
        ),
    )
    + " SELECT user_id, day, n::BIGINT AS n_texts, CASE WHEN n < 2 THEN 0.0 ELSE round(list_max(list_transform(g, lambda x: x.c)) / n, 3) END AS text_share FROM s WHERE (user_id, day, n) IN (SELECT user_id, day, max(n) FROM k GROUP BY ALL)"
)
def near_identical_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the largest set of near-identical texts in a day's reports of a caller."""
    d = derived.detections(spark, sf_dir).withColumn("day", F.date_trunc("day", "published_at").cast("timestamp_ntz")).withColumn("t", text.tokens(F.col("title"), tuple(text.STOP_BURST)))
    return metrics.near_identical_share(d, ["user_id", "day"], ["signal_id"], "t")


_REP = (
    ("e", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'dismissed' ELSE 'other' END AS o FROM events"),
    ("f", "SELECT user_id, n, CASE o WHEN 'verified' THEN 56.0 WHEN 'dismissed' THEN 40.0 ELSE 50.0 END::DOUBLE AS score FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE o WHEN 'verified' THEN least(100.0, score + 6.0) WHEN 'dismissed' THEN greatest(0.0, score - 10.0) ELSE score END FROM f JOIN e ON f.user_id = e.user_id AND e.n = f.n + 1"),
    ("c", "SELECT user_id, count(*) AS reports, count(*) FILTER (o = 'verified') AS verified, count(*) FILTER (o = 'dismissed') AS dismissed FROM e GROUP BY user_id"),
    ("r", "SELECT c.*, f.score FROM c JOIN f ON f.user_id = c.user_id AND f.n = c.reports"),
)


def _reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "error", "dismissed").otherwise("other")
    return folds.reputation(e.withColumn("outcome", outcome), "user_id", ["ts", "event_id"], "outcome")


@query(with_(*_REP) + " SELECT user_id, reports, verified, dismissed, score FROM r")
def reputation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reputation, clamped after each outcome."""
    return _reputation(spark, sf_dir)


_BAND = "CASE WHEN score <= 35 AND verified + dismissed >= 1 THEN 'low' WHEN score >= 70 AND verified + dismissed >= 3 THEN 'trusted' ELSE 'neutral' END"


@query(with_(*_REP) + f" SELECT user_id, verified / nullif(verified + dismissed, 0)::DOUBLE AS accuracy, {_BAND} AS band, CASE {_BAND} WHEN 'low' THEN 0.4 WHEN 'trusted' THEN 1.25 ELSE 1.0 END::DOUBLE AS weight, trunc(100 - score)::INTEGER AS risk FROM r")
def reputation_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, band, weight and risk."""
    band = scoring.reputation_band(F.col("score"), F.col("verified"), F.col("dismissed"))
    return _reputation(spark, sf_dir).select("user_id", scoring.accuracy(F.col("verified"), F.col("dismissed")).alias("accuracy"), band.alias("band"), scoring.corroboration_weight(band).alias("weight"), scoring.risk_of(F.col("score")).alias("risk"))


@query(
    with_(*_REP, ("x", f"SELECT user_id, {_BAND} = 'low' AS low FROM r"), ("h", f"SELECT user_id, {_HOUR} AS hour, count(*) AS n FROM events GROUP BY ALL"))
    + " SELECT user_id, hour, n, low AND n >= 2 AS quarantined FROM h JOIN x USING (user_id)"
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST16: held for a human if the source is low and its reports come in a burst."""
    rep = _reputation(spark, sf_dir)
    low = rep.select("user_id", (scoring.reputation_band(F.col("score"), F.col("verified"), F.col("dismissed")) == "low").alias("low"))
    h = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return h.join(low, "user_id").select("user_id", "hour", "n", (F.col("low") & (F.col("n") >= 2)).alias("quarantined"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS n_30m FROM events")
def trailing_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W06, ST09: reports of the trailing half hour."""
    span = 30 * 60 * 1_000_000
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.timestamp_diff("MICROSECOND", times.now_at("1970-01-01 00:00:00"), F.col("ts")).alias("us"))
    # half hours are counted each on its own, with the one before it, so no task gets a whole type
    e = e.withColumn("later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("half", F.floor(F.col("us") / span) + F.col("later"))
    w = Window.partitionBy("event_type", "half").orderBy("us").rangeBetween(-span, 0)
    return e.withColumn("n_30m", F.count("*").over(w)).filter("later = 0").select("event_id", "n_30m")


@query("SELECT user_id, day, max(n) AS most, count(*) AS types, arg_max(event_type, n * 1000 - ascii(event_type)) AS top_type FROM (SELECT user_id, date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def argmax_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argmax with a stated tie-break; of as many, the type that comes first."""
    g = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return g.groupBy("user_id", "day").agg(F.max("n").alias("most"), F.count("*").alias("types"), F.max_by("event_type", F.col("n") * 1000 - F.ascii("event_type")).alias("top_type"))


@query("SELECT state, name, position FROM (SELECT n_regionkey AS state, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 4, n_name) AS position FROM nation) WHERE position <= 3")
def ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top k of each group by tier and name."""
    w = Window.partitionBy("n_regionkey").orderBy(F.col("n_nationkey") % 4, "n_name")
    n = table(spark, sf_dir, "nation").withColumn("position", F.row_number().over(w).cast("long")).filter("position <= 3")
    return n.select(F.col("n_regionkey").alias("state"), F.col("n_name").alias("name"), "position")


@query("SELECT name FROM (SELECT name, min(o * 1000 + p) AS k FROM (SELECT lower(n_name) AS name, 0 AS o, n_nationkey AS p FROM nation WHERE n_nationkey < 10 UNION ALL SELECT lower(n_name), 1, n_nationkey FROM nation WHERE n_nationkey BETWEEN 5 AND 20) GROUP BY name) ORDER BY k LIMIT 14")
def merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists, the first of each name, capped."""
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    return gazetteer.suggest([(n.filter("position < 10"), 0), (n.filter("position between 5 and 20"), 1)], "name", 14).select("name")


@query(with_(_INC) + " SELECT state, max(CASE status WHEN 'verified' THEN 4 WHEN 'needs_human_review' THEN 3 WHEN 'corroborated' THEN 2 WHEN 'candidate_unverified' THEN 1 ELSE 0 END)::INTEGER AS score, count(*) AS n FROM inc GROUP BY state")
def area_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst score of an area."""
    return derived.incidents(spark, sf_dir).groupBy("state").agg(F.max(lookup(STATUS_SCORE, F.col("status"), 1)).alias("score"), F.count("*").alias("n"))


@query("SELECT event_type, day, n, running, latest_rank FROM (SELECT event_type, day, n, sum(n) OVER (PARTITION BY event_type ORDER BY day)::BIGINT AS running, rank() OVER (PARTITION BY event_type ORDER BY n DESC, day) AS latest_rank FROM (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL)) WHERE latest_rank <= 10")
def busiest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: top days with running totals."""
    g = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    g = g.withColumn("running", F.sum("n").over(w.orderBy("day"))).withColumn("latest_rank", F.rank().over(w.orderBy(F.desc("n"), "day")).cast("long"))
    return g.filter("latest_rank <= 10")

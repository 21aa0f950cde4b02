"""Queries over rules and state: views by audience, scores, state machines, limits, envelopes, timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import scoring, signing, text, times, views
from emberline.operators import folds
from emberline.plans.joins import latest_decisions
from emberline.plans.registry import query, with_
from emberline.schemas import ALERT_MACHINE, ROLE_RANK, SOS_MACHINE, TASK_MACHINE, lookup
from emberline.sources import derived
from emberline.sources.files import table

_INC, _DEC = ("inc", derived.INCIDENTS), ("dec", derived.DECISIONS)


@query("SELECT c_custkey AS id, 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') AS name, c_mktsegment AS area, true AS redacted, round((400 + c_nationkey * 40 + c_custkey % 37) / 100, 1) AS lat FROM customer")
def redact_flyer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public flyer: allowed columns only, a short name, coarse coordinates."""
    c = table(spark, sf_dir, "customer")
    lat = F.round((F.lit(400) + F.col("c_nationkey") * 40 + F.col("c_custkey") % 37) / 100, 1)
    return c.select(F.col("c_custkey").alias("id"), text.short_name(F.col("c_name")).alias("name"), F.trim("c_mktsegment").alias("area"), F.lit(True).alias("redacted"), lat.alias("lat"))


@query(
    "WITH d AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS sent FROM lineitem GROUP BY l_orderkey) "
    "SELECT o_orderkey AS id, 'H-' || o_custkey AS ref, CASE o_orderstatus WHEN 'O' THEN 'TRIGGERED' WHEN 'P' THEN 'DELIVERED' ELSE 'CLOSED' END AS state, 'silent' AS mode, NULL::VARCHAR AS contact_state, o_orderdate AS created_at, o_orderdate + INTERVAL 2 DAY AS updated_at, coalesce(n, 0) AS deliveries_total, coalesce(sent, 0) AS deliveries_sent FROM orders LEFT JOIN d ON l_orderkey = o_orderkey"
)
def public_sos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public view of SOS events with delivery counts; owner, message and coordinates never pass."""
    o, d = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    state = F.when(F.col("o_orderstatus") == "O", "TRIGGERED").when(F.col("o_orderstatus") == "P", "DELIVERED").otherwise("CLOSED")
    e = o.select(F.col("o_orderkey").alias("sos_uuid"), F.concat(F.lit("H-"), F.col("o_custkey").cast("string")).alias("handoff_ref"), state.alias("state"), F.lit("silent").alias("mode"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("updated_at"), F.col("o_custkey").alias("owner_token"), F.lit(9.1).alias("lat"))
    return views.public_sos(e, d.select(F.col("l_orderkey").alias("sos_uuid"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "sent").alias("status")))


@query("SELECT c_custkey AS user_uuid, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE split_part(c_name, '#', 1) END AS first_name, CASE WHEN c_custkey % 2 = 0 THEN 'ha' ELSE 'en' END AS language, 'active' AS status FROM customer")
def public_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public view of a user: defaults for what is not given."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 != 0, F.split_part("c_name", F.lit("#"), F.lit(1)))
    rows = c.select(F.col("c_custkey").alias("user_uuid"), name.alias("first_name"), F.when(F.col("c_custkey") % 2 == 0, "ha").alias("language"), F.lit("").alias("status"), F.col("c_acctbal").alias("secret"))
    return views.public(rows, "user").drop("phone", "guardian_policy_id")


_ROLES = ("viewer", "reviewer", "analyst", "verifier", "operator", "admin", "guest")
_RANK = "CASE role WHEN 'viewer' THEN 1 WHEN 'reviewer' THEN 2 WHEN 'analyst' THEN 2 WHEN 'verifier' THEN 3 WHEN 'operator' THEN 3 WHEN 'admin' THEN 4 ELSE 0 END"


@query(f"SELECT s_suppkey, role, {_RANK} >= 3 AS may_verify FROM (SELECT s_suppkey, [{', '.join(repr(r) for r in _ROLES)}][1 + s_suppkey % 7] AS role FROM supplier)")
def rbac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles on a ladder."""
    role = F.element_at(F.array(*map(F.lit, _ROLES)), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", role.alias("role"), (lookup(ROLE_RANK, role, 0) >= 3).alias("may_verify"))


@query("SELECT c_custkey, count(*) AS n_alerts, min(s_suppkey) AS first_alert, max(s_suppkey) AS last_alert FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey % 4 = 0 OR lower(CASE WHEN s_suppkey % 2 = 0 THEN 'Building' ELSE 'household' END) = lower(c_mktsegment) GROUP BY c_custkey")
def geofence_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subscriber's alerts; an empty area means everywhere. Alerts are summed by area before subscribers meet them."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.explode(F.array(F.lit(""), F.lower("c_mktsegment"))).alias("area"))
    wanted = F.when(F.col("s_suppkey") % 4 == 0, "").when(F.col("s_suppkey") % 2 == 0, "Building").otherwise("household")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k"), F.lower(wanted).alias("area")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("low"), F.max("s_suppkey").alias("high"))
    return c.join(s, ["k", "area"]).groupBy("c_custkey").agg(F.sum("n").alias("n_alerts"), F.min("low").alias("first_alert"), F.max("high").alias("last_alert"))


@query("WITH r AS (SELECT s_suppkey AS id, s_nationkey AS k FROM supplier WHERE s_acctbal > 5000), t AS (SELECT c_custkey AS id, c_nationkey AS k FROM customer WHERE c_acctbal > 5000) SELECT k, id, 'responder' AS kind FROM r UNION ALL SELECT t.k, t.id, 'subscriber' FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = t.id)")
def alert_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responders and subscribers of an area, no address twice."""
    r = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.lit("responder").alias("kind"))
    t = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.lit("subscriber").alias("kind"))
    return r.unionByName(t.join(r.select("id").distinct(), "id", "left_anti"))


_HEAD = "trim(split_part({}, ',', 1))"


@query(with_(_INC, ("a", "SELECT incident_uuid, label, location_name || CASE WHEN incident_uuid % 2 = 0 THEN ', Old Town' ELSE '' END AS place, state FROM inc"), ("b", "SELECT incident_uuid AS ruled, label, location_name AS place, CASE WHEN incident_uuid % 5 = 0 THEN '' ELSE state END AS state FROM inc")) + f" SELECT b.ruled, count(*) AS n_matched, min(a.incident_uuid) AS first_match FROM a JOIN b ON a.label = b.label AND (a.place = b.place OR {_HEAD.format('a.place')} = {_HEAD.format('b.place')}) AND (a.state = '' OR b.state = '' OR a.state = b.state) GROUP BY b.ruled")
def verify_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the incidents a ruling may mean: type, place up to the comma, and state where both have one.

    Incidents are summed by what is compared, so a ruling meets a few rows whatever their number.
    """
    inc = derived.incidents(spark, sf_dir)
    head = lambda c: F.trim(F.split_part(F.col(c), F.lit(","), F.lit(1)))
    a = inc.select("incident_uuid", "label", F.concat("location_name", F.when(F.col("incident_uuid") % 2 == 0, ", Old Town").otherwise("")).alias("place"), F.col("state").alias("a_state"))
    b = inc.select(F.col("incident_uuid").alias("ruled"), "label", F.col("location_name").alias("b_place"), F.when(F.col("incident_uuid") % 5 == 0, "").otherwise(F.col("state")).alias("b_state"))
    a = a.groupBy("label", head("place").alias("head"), "a_state").agg(F.count("*").alias("n"), F.min("incident_uuid").alias("first"))
    met = b.withColumn("head", head("b_place")).join(a, ["label", "head"]).filter((F.col("a_state") == "") | (F.col("b_state") == "") | (F.col("a_state") == F.col("b_state")))
    return met.groupBy("ruled").agg(F.sum("n").alias("n_matched"), F.min("first").alias("first_match"))


@query(
    "WITH f AS (SELECT c_custkey, c_custkey % 2 = 0 AS find, (c_custkey % 4)::INTEGER AS contacts, c_custkey % 3 = 0 AS a, c_custkey % 5 = 0 AS b, c_custkey % 7 = 0 AS c, c_custkey % 11 < 6 AS d FROM customer) "
    "SELECT c_custkey, (CASE WHEN find THEN 20 ELSE 0 END + CASE WHEN contacts >= 2 THEN 20 WHEN contacts = 1 THEN 10 ELSE 0 END + CASE WHEN a THEN 15 ELSE 0 END + CASE WHEN b THEN 15 ELSE 0 END + CASE WHEN c THEN 10 ELSE 0 END + CASE WHEN d THEN 20 ELSE 0 END)::INTEGER AS score, "
    "(CASE WHEN find THEN 0 ELSE 1 END + CASE WHEN contacts >= 2 THEN 0 ELSE 1 END + CASE WHEN a THEN 0 ELSE 1 END + CASE WHEN b THEN 0 ELSE 1 END + CASE WHEN c THEN 0 ELSE 1 END + CASE WHEN d THEN 0 ELSE 1 END)::INTEGER AS n_gaps FROM f"
)
def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32: readiness and its gaps."""
    k = F.col("c_custkey")
    flags = {"silent_sos": k % 3 == 0, "sms_fallback": k % 5 == 0, "wearable": k % 7 == 0, "offline_pack": k % 11 < 6}
    r = scoring.readiness(k % 2 == 0, k % 4, flags)
    return table(spark, sf_dir, "customer").select("c_custkey", r["score"].alias("score"), F.size(r["gaps"]).alias("n_gaps"))


_KINDS = ("dating", "marketplace_sale", "ride_share", "informant_meeting", "business_meeting", "business")


@query(
    f"WITH m AS (SELECT event_id, [{', '.join(repr(k) for k in _KINDS)}][1 + event_id % 6] AS kind, ts FROM events), s AS (SELECT event_id, (50 + CASE kind WHEN 'dating' THEN 20 WHEN 'marketplace_sale' THEN 15 WHEN 'ride_share' THEN 25 WHEN 'informant_meeting' THEN 40 WHEN 'business_meeting' THEN 5 ELSE 10 END + CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 15 ELSE 0 END)::INTEGER AS score FROM m) "
    "SELECT event_id, score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level FROM s"
)
def meeting_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """risk of a meeting by kind and hour."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 6 + 1).cast("int"))
    r = scoring.meeting_risk(kind, F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", r["score"].alias("score"), r["level"].alias("level"))


_J = ("active", "arrived", "closed", "overdue")
_E = ("ping", "duress", "missed_checkin", "arrived", "ping")


@query(
    f"WITH j AS (SELECT event_id, [{', '.join(repr(x) for x in _J)}][1 + event_id % 4] AS state, [{', '.join(repr(x) for x in _E)}][1 + event_id % 5] AS kind, value / 4 AS battery, ts - to_minutes(event_id % 40) AS expected, CASE WHEN event_id % 6 = 0 THEN value / 50 END AS deviation, ts AS now_ FROM events) "
    "SELECT event_id, CASE WHEN kind = 'duress' THEN 'critical' WHEN kind = 'arrived' THEN 'normal' WHEN deviation > 5 OR (state NOT IN ('arrived', 'closed') AND now_ > expected + INTERVAL 15 MINUTE) OR battery <= 10 OR kind = 'missed_checkin' THEN 'warning' ELSE 'normal' END AS level, "
    "CASE WHEN kind = 'duress' THEN 'duress event received' WHEN kind = 'arrived' THEN '' WHEN deviation > 5 THEN 'reported route deviation' WHEN state NOT IN ('arrived', 'closed') AND now_ > expected + INTERVAL 15 MINUTE THEN 'journey overdue' WHEN battery <= 10 THEN 'battery critically low' WHEN kind = 'missed_checkin' THEN 'missed check-in' ELSE '' END AS reason, "
    "CASE WHEN kind = 'duress' THEN 'escalated' WHEN kind = 'arrived' THEN 'arrived' ELSE state END AS state FROM j"
)
def journey_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F34, ST13: assessment of a journey's event."""
    k = F.col("event_id")
    state, kind = F.element_at(F.array(*map(F.lit, _J)), (k % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, _E)), (k % 5 + 1).cast("int"))
    a = scoring.journey_assessment(state, kind, F.col("value") / 4, F.col("ts") - F.make_dt_interval(mins=(k % 40).cast("int")), F.when(k % 6 == 0, F.col("value") / 50), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", a["level"].alias("level"), a["reason"].alias("reason"), a["state"].alias("state"))


@query(
    "WITH m AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 20 END AS km, event_id % 3 = 0 AS off, ts > ts - INTERVAL 1 MINUTE * (event_id % 5 - 2) AS over_, event_id % 2 = 0 AS arrived, event_id % 4 = 1 AS missed FROM events) "
    "SELECT event_id, coalesce(km > 5.0, false) AS location_changed, off AS phone_off, arrived AND over_ AS duration_exceeded, missed AS checkin_missed, (coalesce(km > 5.0, false)::INTEGER + off::INTEGER + (arrived AND over_)::INTEGER + missed::INTEGER) AS n_reasons FROM m"
)
def meeting_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anomalies of a meeting and their reasons."""
    k = F.col("event_id")
    km = F.when(k % 7 != 0, F.col("value") / 20)
    device = F.when(k % 3 == 0, "offline").otherwise("online")
    departure = F.col("ts") - F.make_dt_interval(mins=(k % 5 - 2).cast("int"))
    due = F.when(k % 4 == 1, F.col("ts") - F.expr("INTERVAL 1 MINUTE"))
    a = scoring.meeting_anomalies(km, device, F.lit("in_progress"), departure, F.when(k % 2 == 0, F.col("ts")), due, F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", a["location_changed"].alias("location_changed"), a["phone_off"].alias("phone_off"), a["duration_exceeded"].alias("duration_exceeded"), a["checkin_missed"].alias("checkin_missed"), F.size(a["reasons"]).alias("n_reasons"))


_LV = "CASE WHEN confidence >= 90 OR severity > 1 THEN 4 WHEN confidence >= 80 THEN 3 WHEN confidence >= 70 THEN 2 ELSE 1 END"


@query(with_(_INC) + f" SELECT incident_uuid, {_LV} AS level, 'near ' || location_name || ': ' || CASE {_LV} WHEN 4 THEN 'act now' WHEN 3 THEN 'danger' WHEN 2 THEN 'warning' ELSE 'advisory' END AS message FROM inc")
def alert_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert levels and plain messages."""
    inc = derived.incidents(spark, sf_dir)
    level = scoring.alert_level(F.col("confidence"), F.when(F.col("severity") > 1, 1).otherwise(0))
    words = F.when(level == 4, "act now").when(level == 3, "danger").when(level == 2, "warning").otherwise("advisory")
    return inc.select("incident_uuid", level.alias("level"), F.concat(F.lit("near "), "location_name", F.lit(": "), words).alias("message"))


def _machine_sql(machine: dict[str, str], initial: str, events: tuple[str, ...], key: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in machine.items())
    names = ", ".join(repr(e) for e in events)
    views = (
        ("e", f"SELECT {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS n, [{names}][1 + (event_id * 7 + user_id) % {len(events)}] AS ev FROM events"),
        ("s", f"SELECT k, n, coalesce(nx, '{initial}') AS state, (nx IS NOT NULL)::INTEGER AS applied FROM (SELECT k, n, CASE '{initial}|' || ev {cases} END AS nx FROM e WHERE n = 1) UNION ALL SELECT k, n, coalesce(nx, state), applied + (nx IS NOT NULL)::INTEGER FROM (SELECT e.k, e.n, s.state, s.applied, CASE s.state || '|' || ev {cases} END AS nx FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1)"),
    )
    return with_(*views) + " SELECT k, state, applied::BIGINT AS applied, n AS seen FROM s WHERE (k, n) IN (SELECT k, max(n) FROM e GROUP BY k)"


def _machine(spark: SparkSession, sf_dir: str, machine: dict[str, str], initial: str, events: tuple[str, ...], key) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", key)
    ev = F.element_at(F.array(*map(F.lit, events)), ((F.col("event_id") * 7 + F.col("user_id")) % len(events) + 1).cast("int"))
    return folds.state_machine(e.withColumn("ev", ev), ["k"], ["event_id"], "ev", machine, initial)


_SOS = ("capture_location", "notify_circle", "delivery_confirmed", "operator_ack", "request_112", "coordinate", "escalate")
_TASK = ("reviewing", "responding", "received", "closed", "reviewing", "responding", "armed")
_ALERT = ("UPDATED", "UPDATED", "PUBLISHED", "EXPIRED", "CANCELLED")


@query(_machine_sql(SOS_MACHINE, "TRIGGERED", _SOS, "user_id"))
def sos_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10, M05, M06: distress events through their states; what is not allowed changes nothing."""
    return _machine(spark, sf_dir, SOS_MACHINE, "TRIGGERED", _SOS, F.col("user_id"))


@query(_machine_sql(TASK_MACHINE, "received", _TASK, "event_id // 12"))
def task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11: responders' tasks."""
    return _machine(spark, sf_dir, TASK_MACHINE, "received", _TASK, F.floor(F.col("event_id") / 12))


@query(_machine_sql(ALERT_MACHINE, "PUBLISHED", _ALERT, "event_id // 3"))
def alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12: alerts."""
    return _machine(spark, sf_dir, ALERT_MACHINE, "PUBLISHED", _ALERT, F.floor(F.col("event_id") / 3))


@query(
    with_(
        ("e", "SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, floor(epoch(ts) / 21600)::BIGINT AS sec FROM events"),
        ("s", "SELECT k, n, sec, 2.0::DOUBLE AS tokens, 1 AS allowed, 0 AS refused FROM e WHERE n = 1 UNION ALL SELECT k, n, sec, CASE WHEN t >= 1 THEN t - 1 ELSE t END, allowed + (t >= 1)::INTEGER, refused + (t < 1)::INTEGER FROM (SELECT e.k, e.n, e.sec, allowed, refused, round(least(3.0::DOUBLE, s.tokens + (e.sec - s.sec) * (3 / 60.0::DOUBLE)), 6) AS t FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1)"),
    )
    + " SELECT k, allowed::BIGINT AS allowed, refused::BIGINT AS refused FROM s WHERE (k, n) IN (SELECT k, max(n) FROM e GROUP BY k)"
)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST06: requests within a rate that refills continuously."""
    e = table(spark, sf_dir, "events").withColumn("k", F.col("user_id"))
    e = e.withColumn("sec", F.floor(F.timestamp_diff("SECOND", times.now_at("1970-01-01 00:00:00"), F.col("ts")) / 21_600).cast("long"))
    return folds.token_bucket(e, "k", "sec", ["event_id"], 3)


@query(
    with_(
        ("e", "SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, floor(epoch(ts) / 60)::BIGINT AS sec FROM events"),
        ("s", "SELECT k, n, [sec] AS hits, 1 AS accepted, 0 AS refused FROM e WHERE n = 1 UNION ALL SELECT k, n, CASE WHEN len(recent) < 3 THEN list_append(recent, sec) ELSE recent END, accepted + (len(recent) < 3)::INTEGER, refused + (len(recent) >= 3)::INTEGER FROM (SELECT e.k, e.n, e.sec, accepted, refused, list_filter(s.hits, lambda t: t >= e.sec - 7200) AS recent FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1)"),
    )
    + " SELECT k, accepted::BIGINT AS accepted, refused::BIGINT AS refused FROM s WHERE (k, n) IN (SELECT k, max(n) FROM e GROUP BY k)"
)
def throttle_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W05, ST05: at most three of one content in a sliding window; what is refused does not count."""
    e = table(spark, sf_dir, "events").withColumn("k", F.col("user_id"))
    e = e.withColumn("sec", F.floor(F.timestamp_diff("SECOND", times.now_at("1970-01-01 00:00:00"), F.col("ts")) / 60).cast("long"))
    return folds.throttle(e, ["k"], "sec", ["event_id"], 7200, 3)


@query(
    with_(
        ("e", "SELECT event_id // 9 AS k, row_number() OVER (PARTITION BY event_id // 9 ORDER BY event_id) AS n, (event_id * 5 + user_id) % 7 = 0 AS good FROM events"),
        ("s", "SELECT k, n, 1 AS tries, good AS used FROM e WHERE n = 1 UNION ALL SELECT e.k, e.n, tries + (NOT used AND tries < 6)::INTEGER, used OR (NOT used AND tries < 6 AND good) FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1"),
    )
    + " SELECT k, tries::BIGINT AS tries, used FROM s WHERE (k, n) IN (SELECT k, max(n) FROM e GROUP BY k)"
)
def otp_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST15, M07: single-use codes with a limit of attempts."""
    e = table(spark, sf_dir, "events").withColumn("k", F.floor(F.col("event_id") / 9)).withColumn("good", (F.col("event_id") * 5 + F.col("user_id")) % 7 == 0)
    return folds.attempts(e, ["k"], ["event_id"], "good")


@query("WITH e AS (SELECT event_id // 4 AS k, event_id, (user_id % 3)::VARCHAR AS a FROM events), p AS (SELECT k, arg_min(a, event_id) AS proposer FROM e GROUP BY k) SELECT k, proposer, c.confirmer, c.confirmer IS NOT NULL AS approved FROM p LEFT JOIN (SELECT e.k, arg_min(e.a, event_id) AS confirmer FROM e JOIN p ON e.k = p.k AND e.a <> p.proposer GROUP BY e.k) c USING (k)")
def two_person_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST17: a second actor confirms what a first proposed."""
    e = table(spark, sf_dir, "events").withColumn("k", F.floor(F.col("event_id") / 4)).withColumn("actor", (F.col("user_id") % 3).cast("string"))
    return folds.two_person(e, ["k"], ["event_id"], "actor")


_NOW = "TIMESTAMP '2024-01-30 12:00:00'"


@query(
    f"WITH j AS (SELECT user_id, max(ts) AS last_at, max(ts) + to_minutes(user_id % 50 - 20) AS expected, arg_max(event_type, (ts, event_id)) = 'purchase' AS closed FROM events WHERE ts <= {_NOW} GROUP BY user_id), m AS (SELECT *, greatest(0, date_sub('second', last_at, {_NOW})) / 60.0::DOUBLE AS silent, date_sub('second', expected, {_NOW}) / 60.0::DOUBLE AS late FROM j) "
    "SELECT user_id, CASE WHEN silent > 10 AND NOT closed THEN 'critical' WHEN late > 15 THEN 'warning' ELSE 'normal' END AS level, CASE WHEN silent > 10 AND NOT closed THEN 'device silent for ' || floor(silent)::BIGINT || ' min' WHEN late > 15 THEN 'journey overdue by ' || floor(late)::BIGINT || ' min' ELSE '' END AS reason FROM m"
)
def stale_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST03, ST04: silent and overdue journeys as of a time; silence outweighs lateness."""
    now = times.now_at("2024-01-30 12:00:00")
    e = table(spark, sf_dir, "events").filter(F.col("ts") <= now)
    j = e.groupBy("user_id").agg(F.max("ts").alias("last_at"), (F.max_by("event_type", F.struct("ts", "event_id")) == "purchase").alias("closed"))
    expected = F.col("last_at") + F.make_dt_interval(mins=(F.col("user_id") % 50 - 20).cast("int"))
    silent = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("last_at"), now)) / 60.0
    late = F.timestamp_diff("SECOND", expected, now) / 60.0
    m = j.select("user_id", "closed", silent.alias("silent"), late.alias("late"))
    quiet, overdue = (F.col("silent") > 10) & ~F.col("closed"), F.col("late") > 15
    text_ = lambda words, c: F.concat(F.lit(words), F.floor(c).cast("string"), F.lit(" min"))
    return m.select("user_id", F.when(quiet, "critical").when(overdue, "warning").otherwise("normal").alias("level"), F.when(quiet, text_("device silent for ", "silent")).when(overdue, text_("journey overdue by ", "late")).otherwise("").alias("reason"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, n::BIGINT AS session_no, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM s GROUP BY ALL")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension of ST03: sessions separated by silence."""
    w = Window.partitionBy("user_id").orderBy("ts")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    fresh = F.when(F.timestamp_diff("MICROSECOND", F.col("before"), F.col("ts")) <= 6 * 3600 * 1_000_000, 0).otherwise(1)
    s = e.withColumn("fresh", fresh).withColumn("session_no", F.sum("fresh").over(w).cast("long"))
    return s.groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"))


_MSG = "'v1|' || user_id || '|' || printf('%.5f', lat) || '|' || printf('%.5f', lng) || '|' || t || '|' || nonce"
_ENV = (
    ("v", "SELECT event_id, user_id, (400 + user_id % 25 * 40) / 100 AS lat, (300 + user_id % 25 * 45) / 100 AS lng, floor(epoch(ts))::BIGINT AS t, 'n' || event_id % 4001 AS nonce FROM events"),
    ("m", f"SELECT *, t + event_id % 200 - 70 AS now_, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'forged' ELSE sha256('key' || {_MSG}) END AS sig, sha256('key' || {_MSG}) AS expected FROM v"),
    ("a", "SELECT *, CASE WHEN sig IS NULL THEN 'missing' WHEN t - now_ > 60 THEN 'future' WHEN now_ - t > 120 THEN 'stale' WHEN sig <> expected THEN 'bad_signature' ELSE 'ok' END AS r FROM m"),
)


@query(with_(*_ENV) + " SELECT event_id, CASE WHEN r = 'ok' AND row_number() OVER (PARTITION BY nonce, r ORDER BY event_id) > 1 THEN 'replay' ELSE r END AS verdict FROM a")
def envelope_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST07, ST08, M12: envelopes in the order of their checks; nonces count only once authentic."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        ((F.lit(400) + F.col("user_id") % 25 * 40) / 100).alias("lat"),
        ((F.lit(300) + F.col("user_id") % 25 * 45) / 100).alias("lng"),
        F.timestamp_diff("SECOND", times.now_at("1970-01-01 00:00:00"), F.col("ts")).alias("t"),
        F.concat(F.lit("n"), (k % 4001).cast("string")).alias("nonce"),
    )
    message = signing.canonical(F.col("user_id"), F.col("lat"), F.col("lng"), F.col("t"), F.col("nonce"))
    e = e.withColumn("message", message).withColumn("expected", F.sha2(F.concat(F.lit("key"), "message").cast("binary"), 256))
    e = e.withColumn("sig", F.when(k % 13 == 0, F.lit(None).cast("string")).when(k % 17 == 0, "forged").otherwise(F.col("expected")))
    first = signing.verdict(F.col("message"), F.col("t"), F.col("sig"), F.col("expected"), F.col("t") + k % 200 - 70, F.lit(False))
    e = e.withColumn("r", first)
    again = F.row_number().over(Window.partitionBy("nonce", "r").orderBy("event_id")) > 1
    return e.select("event_id", F.when((F.col("r") == "ok") & again, "replay").otherwise(F.col("r")).alias("verdict"))


@query()
def envelope_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed signatures and rotating ids; SQL has no HMAC, tests hold them against the standard library."""
    sign = signing.hmac_sha256("test-key")
    e = table(spark, sf_dir, "events")
    message = F.concat_ws("|", F.col("user_id").cast("string"), times.rotation_epoch(F.col("ts")).cast("string"))
    return e.select("event_id", message.alias("message"), sign(message).alias("mac")).withColumn("beacon", signing.rotating_id(F.col("mac"), 16))


@query("SELECT event_id, n <= 20 AS within FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY event_id) AS n FROM events)")
def quota_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST19: a daily quota by running count."""
    w = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) <= 20).alias("within"))


@query("SELECT user_id, arg_max(value, event_id) FILTER (event_type IN ('view', 'click')) AS last_value, max(ts) FILTER (event_type = 'signup') AS last_checkin, max(ts) AS last_packet, CASE WHEN bool_or(event_type = 'error' AND value > 200) THEN 'escalated' WHEN arg_max(event_type, event_id) = 'purchase' THEN 'in_progress' ELSE 'active' END AS state, max(ts) FILTER (event_type = 'signup') + INTERVAL 30 MINUTE AS next_due FROM events GROUP BY user_id")
def journey_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST13, ST14: journeys and meetings from their events: last known values, check-ins, next due."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    g = e.groupBy("user_id").agg(
        F.max_by("value", F.when(kind.isin("view", "click"), F.col("event_id"))).alias("last_value"),
        F.max(F.when(kind == "signup", F.col("ts"))).alias("last_checkin"),
        F.max("ts").alias("last_packet"),
        F.max(((kind == "error") & (F.col("value") > 200)).cast("int")).alias("bad"),
        F.max_by("event_type", "event_id").alias("last_kind"),
    )
    state = F.when(F.col("bad") == 1, "escalated").when(F.col("last_kind") == "purchase", "in_progress").otherwise("active")
    return g.select("user_id", "last_value", "last_checkin", "last_packet", state.alias("state"), (F.col("last_checkin") + F.expr("INTERVAL 30 MINUTES")).alias("next_due"))


@query(with_(_DEC, ("lastd", "SELECT incident, ruling FROM (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY seq DESC) AS n FROM dec) WHERE n = 1 AND ruling = 'verified'")) + " SELECT incident FROM lastd WHERE incident NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)")
def alert_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST18: an alert for each verified incident that has none."""
    v = latest_decisions(spark, sf_dir).filter("ruling = 'verified'").select("incident")
    active = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("incident"))
    return v.join(active, "incident", "left_anti")


@query(
    "WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) AS n FROM events), r AS (SELECT user_id, count(*) FILTER (event_type = 'error') > 18 AS low FROM events GROUP BY user_id) "
    "SELECT event_id, CASE WHEN n > 5 THEN 'throttled' WHEN event_type = 'view' THEN 'vetoed' WHEN user_id % 25 = 7 THEN 'no_place' WHEN low AND n >= 2 THEN 'quarantined' ELSE 'stored' END AS outcome FROM e JOIN r USING (user_id)"
)
def report_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST16: a report's way: throttle, veto, place, quarantine, store; the first that applies."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("event_id"))
    low = e.groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") > 18).alias("low"))
    j = e.withColumn("n", n).join(low, "user_id")
    outcome = F.when(F.col("n") > 5, "throttled").when(F.col("event_type") == "view", "vetoed").when(F.col("user_id") % 25 == 7, "no_place").when(F.col("low") & (F.col("n") >= 2), "quarantined").otherwise("stored")
    return j.select("event_id", outcome.alias("outcome"))


@query("SELECT l_orderkey AS incident, count(*) AS n_rulings, count(*) FILTER (l_returnflag = 'A') AS n_verified, count(*) FILTER (l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity IN (1, 2, 3) AND l_linenumber NOT IN (4, 5)) AS n_small, count(*) FILTER (strftime(l_shipdate, '%Y') = '1998') AS n_1998 FROM lineitem GROUP BY l_orderkey")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, IN, NOT IN, cutoffs and LIKE on a year."""
    li = table(spark, sf_dir, "lineitem")
    small = (F.col("l_shipdate") < times.now_at("1997-01-01 00:00:00")) & F.col("l_quantity").isin(1.0, 2.0, 3.0) & ~F.col("l_linenumber").isin(4, 5)
    return li.groupBy(F.col("l_orderkey").alias("incident")).agg(F.count("*").alias("n_rulings"), F.count_if(F.col("l_returnflag") == "A").alias("n_verified"), F.count_if(small).alias("n_small"), F.count_if(F.col("l_shipdate").cast("string").like("1998-%")).alias("n_1998"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'road' ELSE 'corridor' END AS provenance, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 1000, 2) END, round((o_custkey % 400) * 1.3::DOUBLE, 2)) AS km, o_orderkey % 5 <> 0 AS verified FROM orders")
def route_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's value where there is one, else the corridor's, with where it came from."""
    o = table(spark, sf_dir, "orders")
    road = F.when(F.col("o_orderkey") % 3 == 0, F.round(F.col("o_totalprice") / 1000, 2))
    return o.select("o_orderkey", F.when(road.isNotNull(), "road").otherwise("corridor").alias("provenance"), F.coalesce(road, F.round(F.col("o_custkey") % 400 * 1.3, 2)).alias("km"), (F.col("o_orderkey") % 5 != 0).alias("verified"))


@query(with_(_INC, ("s", "SELECT state, count(*) AS n, count(*) FILTER (status = 'verified') AS v FROM inc WHERE confidence > 1000 GROUP BY state"), ("all_states", "SELECT DISTINCT state FROM inc")) + " SELECT state, coalesce(n, 0) AS n, coalesce(v, 0) AS v, CASE WHEN n > 0 THEN v / n::DOUBLE END AS rate FROM all_states LEFT JOIN s USING (state)")
def empty_with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty result with all its fields; the rate of none is unknown."""
    inc = derived.incidents(spark, sf_dir)
    g = inc.filter("confidence > 1000").groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "verified").alias("v"))
    out = inc.select("state").distinct().join(g, "state", "left")
    return out.select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("v", F.lit(0)).cast("long").alias("v"), scoring.rate(F.col("v"), F.col("n")).alias("rate"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN (s_suppkey % 180)::DOUBLE END AS lng, count(*) FILTER (s_suppkey % 4 <> 1) OVER () AS skipped FROM supplier")
def point_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in several spellings; what is no number, or not a number, is skipped and counted."""
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 1, (k % 180).cast("string")).when(k % 4 == 2, "east").when(k % 4 == 3, "NaN")
    value = raw.try_cast("double")
    lng = F.when(~F.isnan(value), value)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", lng.alias("lng"))
    skipped = s.agg(F.count_if(F.col("lng").isNull()).alias("skipped"))
    return s.crossJoin(skipped)  # one row


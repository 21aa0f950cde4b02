"""Queries over tables as logs: scans, lookups, inserts, upserts, retention, erasure, identity, paging, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.functions.times import now_at
from emberline.operators import folds, latest, paging
from emberline.plans.registry import query, with_
from emberline.sources import derived
from emberline.sources.files import first_feeds, gather, table, table_or_none

_HASH = "sha256(concat_ws('|', coalesce(source, ''), coalesce(lang, ''), coalesce(text, '')))"
_SIGNAL_HASH = lambda: text.raw_hash(F.col("source"), F.col("lang"), F.col("text"))


@query("SELECT doc_id AS signal_id, source AS source_name, lang, length(text)::BIGINT AS n_chars, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at FROM documents")
def scan_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with derived publication times."""
    d = table(spark, sf_dir, "documents")
    at = now_at("2024-01-01 00:00:00") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return d.select(F.col("doc_id").alias("signal_id"), F.col("source").alias("source_name"), "lang", F.length("text").cast("long").alias("n_chars"), at.alias("published_at"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 42 ORDER BY o_orderkey DESC LIMIT 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest row of a key."""
    return table(spark, sf_dir, "orders").filter("o_custkey = 42").orderBy(F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_custkey", "o_totalprice")


@query("WITH i AS (SELECT unnest(range(0, 3000, 7)) AS ident) SELECT ident, arg_min(o_orderkey, prio * 1000000000 - o_orderkey) AS o_orderkey, min(prio)::INTEGER AS matched_by FROM (SELECT ident, o_orderkey, 0 AS prio FROM i JOIN orders ON o_orderkey = ident UNION ALL SELECT ident, o_orderkey, 1 FROM i JOIN orders ON o_custkey = ident) GROUP BY ident")
def two_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By uuid first, else by reference, newest first."""
    o = table(spark, sf_dir, "orders")
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "ident")
    hits = ids.join(o, ids["ident"] == o["o_orderkey"]).select("ident", "o_orderkey", F.lit(0).alias("prio")).unionByName(ids.join(o, ids["ident"] == o["o_custkey"]).select("ident", "o_orderkey", F.lit(1).alias("prio")))
    return hits.groupBy("ident").agg(F.min_by("o_orderkey", F.col("prio") * 1000000000 - F.col("o_orderkey")).alias("o_orderkey"), F.min("prio").alias("matched_by"))


@query("SELECT doc_id AS id, 'sample' AS kind FROM documents UNION ALL SELECT page_id, 'rss' FROM pages")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled sources, concatenated."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("sample").alias("kind"))
    b = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("rss").alias("kind"))
    return gather([(a, True), (b, True), (a, False)])


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 8)) WHERE n <= 25")
def feed_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first feeds and a limit per feed."""
    return first_feeds(table(spark, sf_dir, "documents"), "source", F.col("doc_id"), 8, 25).select("doc_id", "source")


@query(f"SELECT doc_id, raw_hash FROM (SELECT doc_id, {_HASH} AS raw_hash, row_number() OVER (PARTITION BY {_HASH} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert if absent by content hash."""
    return latest.insert_if_absent(table(spark, sf_dir, "documents"), _SIGNAL_HASH(), [F.col("doc_id")]).select("doc_id", "raw_hash")


@query(f"WITH h AS (SELECT doc_id, {_HASH} AS raw_hash FROM documents) SELECT min(doc_id) AS doc_id, raw_hash FROM h WHERE doc_id % 2 = 1 AND raw_hash NOT IN (SELECT raw_hash FROM h WHERE doc_id % 2 = 0) GROUP BY raw_hash")
def ingest_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second delivery against what is stored; odd documents arrive after even ones."""
    d = table(spark, sf_dir, "documents")
    stored = d.filter("doc_id % 2 = 0").select(_SIGNAL_HASH().alias("raw_hash"))
    return latest.insert_if_absent(d.filter("doc_id % 2 = 1"), _SIGNAL_HASH(), [F.col("doc_id")], stored).select("doc_id", "raw_hash")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts as the latest row of a key."""
    return latest.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS ok_runs, count(*) FILTER (event_type = 'error') AS failed_runs, sum(event_id % 13)::BIGINT AS fetched, max(ts) FILTER (event_type <> 'error') AS last_ok, arg_max(props, ts) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters accumulated by upserts."""
    runs = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error").withColumn("fetched_n", F.col("event_id") % 13)
    return latest.counters(runs, "user_id", "ok", "fetched_n", "ts", "props")


@query("WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events WHERE event_type IN ('signup', 'error', 'purchase') GROUP BY user_id) SELECT user_id, last_type = 'signup' AS active, last_type = 'purchase' AS erased FROM l WHERE last_type <> 'purchase'")
def subscriber_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reactivation, soft delete, and hard delete, from the log of a subscriber."""
    log = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error", "purchase"))
    last = latest.latest(log, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.filter("event_type <> 'purchase'").select("user_id", (F.col("event_type") == "signup").alias("active"), (F.col("event_type") == "purchase").alias("erased"))


@query("SELECT o_custkey, o_orderkey FROM orders JOIN (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey) USING (o_custkey, o_orderdate)")
def replace_all_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an owner's last batch."""
    return latest.replace_all(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey")


_GEN = "SELECT o_custkey AS k, max(o_orderkey)::VARCHAR AS uuid, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || '|' || count(*)::VARCHAR AS fingerprint FROM orders WHERE {} GROUP BY o_custkey"


@query(with_(("o", _GEN.format("o_orderkey % 3 <> 0")), ("n", _GEN.format("o_orderkey % 7 <> 0"))) + " SELECT n.k, coalesce(o.uuid, n.uuid) AS uuid, CASE WHEN o.uuid IS NULL THEN 1 WHEN o.fingerprint <> n.fingerprint THEN 2 ELSE 1 END::BIGINT AS version, o.uuid IS NULL AS is_new FROM n LEFT JOIN o USING (k)")
def incident_identity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities kept across a full recomputation, versions raised where the fingerprint changed."""
    o = table(spark, sf_dir, "orders")

    def generation(where: str) -> DataFrame:
        ids = F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
        return o.filter(where).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").cast("string").alias("uuid"), F.concat(ids, F.lit("|"), F.count("*").cast("string")).alias("fingerprint"))

    old = generation("o_orderkey % 3 <> 0").withColumn("version", F.lit(1))
    return latest.reconcile(old, generation("o_orderkey % 7 <> 0").withColumnRenamed("uuid", "fresh_uuid"), ["k"])


_NOW = "2024-02-01 00:00:00"
#: The reference's seven, over the driver's tables; one has no table and one no such column.
_POLICIES = [
    latest.Policy("expired_codes", "events", "ts", 2, "event_type = 'signup'"),
    latest.Policy("expired_sessions", "events", "ts", 10, "event_type = 'view'"),
    latest.Policy("old_receipts", "lineitem", "l_shipdate", 180 * 50),
    latest.Policy("old_posts", "channel", "created_at", 90),
    latest.Policy("old_journey_events", "events", "ts", 14, "event_type = 'click'"),
    latest.Policy("old_checkins", "orders", "checked_at", 180),
    latest.Policy("closed_cases", "orders", "o_orderdate", 365 * 27, "o_orderstatus IN ('F')"),
]
_ABSENT = {"old_posts": "no table", "old_checkins": "UNRESOLVED_COLUMN.WITH_SUGGESTION"}


def _due(p: latest.Policy) -> str:
    return f"{p.at} < TIMESTAMP '{_NOW}' - INTERVAL {p.days} DAY AND {p.extra}"


@query(" UNION ALL ".join(f"SELECT '{p.name}' AS policy, 0 AS total, 0 AS due, '{_ABSENT[p.name]}' AS error" if p.name in _ABSENT else f"SELECT '{p.name}' AS policy, count(*) AS total, count(*) FILTER ({_due(p)}) AS due, '' AS error FROM {p.table}" for p in _POLICIES))
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each of seven policies would delete; one that fails says so and stops no other."""
    return latest.retention(_POLICIES, lambda name: table_or_none(spark, sf_dir, name), _NOW)


@query(f"SELECT event_id FROM events WHERE NOT ({_due(_POLICIES[1])})")
def retention_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy leaves."""
    return latest.apply_retention(table(spark, sf_dir, "events"), _POLICIES[1].due(_NOW)).select("event_id")


_ASKED = "SELECT CASE WHEN c_custkey % 4 = 0 THEN sha256('a' || c_custkey) END AS address_hash, CASE WHEN c_custkey % 4 = 1 THEN c_custkey END AS owner_token, CASE WHEN c_custkey % 4 = 2 THEN c_custkey END AS user_id, CASE WHEN c_custkey % 4 = 3 THEN sha256('p' || c_custkey % 100) END AS phone_hash FROM customer WHERE c_custkey % 11 = 3"


@query(
    f"WITH g AS ({_ASKED}), u AS (SELECT c_custkey AS uid, sha256('p' || c_custkey) AS ph FROM customer WHERE c_custkey < 90), s AS (SELECT g.address_hash, g.owner_token, coalesce(g.user_id, u.uid) AS user_id FROM g LEFT JOIN u ON g.phone_hash = u.ph AND g.user_id IS NULL), "
    "t AS (SELECT 'subscribers' AS table_name, sha256('a' || c_custkey) IN (SELECT address_hash FROM s WHERE address_hash IS NOT NULL) AS gone FROM customer UNION ALL SELECT 'trusted_contacts', o_custkey IN (SELECT owner_token FROM s WHERE owner_token IS NOT NULL) FROM orders UNION ALL SELECT 'sessions', user_id IN (SELECT user_id FROM s WHERE user_id IS NOT NULL) FROM events UNION ALL SELECT 'users', uid IN (SELECT user_id FROM s WHERE user_id IS NOT NULL) FROM u) "
    "SELECT table_name, count(*) FILTER (gone) AS erased, count(*) FILTER (NOT gone) AS kept FROM t GROUP BY table_name"
)
def subject_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Erasure of subjects across tables by any identifier; a phone's hash is resolved to its user."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    hashed = lambda mark, x: F.sha2(F.concat(F.lit(mark), x.cast("string")).cast("binary"), 256)
    users = c.filter("c_custkey < 90").select(k.alias("user_id"), hashed("p", k).alias("phone_hash"))
    asked = c.filter("c_custkey % 11 = 3").select(F.when(k % 4 == 0, hashed("a", k)).alias("address_hash"), F.when(k % 4 == 1, k).alias("owner_token"), F.when(k % 4 == 2, k).alias("user_id"), F.when(k % 4 == 3, hashed("p", k % 100)).alias("phone_hash"))
    tables = {
        "subscribers": (c.select(hashed("a", k).alias("address_hash")), "address_hash", "address_hash"),
        "trusted_contacts": (table(spark, sf_dir, "orders"), "o_custkey", "owner_token"),
        "sessions": (table(spark, sf_dir, "events"), "user_id", "user_id"),
        "users": (users, "user_id", "user_id"),
    }
    return latest.erase(tables, latest.subjects(asked, users))


_CHAIN = (
    ("e", "SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events"),
    ("c", "SELECT user_id, event_id, props, n, '' AS prev_hash, sha256(props) AS hash FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.props, e.n, c.hash, sha256(c.hash || e.props) FROM c JOIN e ON c.user_id = e.user_id AND e.n = c.n + 1"),
)


@query(with_(*_CHAIN) + " SELECT user_id, event_id, prev_hash, hash FROM c")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only log whose rows hash the one before."""
    return folds.hash_chain(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "props").select("user_id", "event_id", "prev_hash", "hash")


@query(with_(*_CHAIN, ("t", "SELECT user_id, event_id, hash, CASE WHEN event_id % 997 = 5 THEN props || '!' ELSE props END AS props, lag(hash) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM c")) + " SELECT user_id, count(*) AS n_rows, min(event_id) FILTER (hash <> sha256(coalesce(before, '') || props)) AS first_broken FROM t GROUP BY user_id")
def verify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of a chain that was tampered with; every 997th event is."""
    rows = folds.hash_chain(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "props")
    rows = rows.withColumn("props", F.when(F.col("event_id") % 997 == 5, F.concat("props", F.lit("!"))).otherwise(F.col("props")))
    return latest.verify_chain(rows, ["user_id"], ["event_id"], "props")


@query("SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'view') AS battery, arg_max(props, event_id) FILTER (event_type = 'click') AS note, max(event_id) AS last_event FROM events GROUP BY user_id")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of single columns; the last value of each that was given."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("battery"), F.when(F.col("event_type") == "click", F.col("props")).alias("note"), F.col("event_id").alias("last_event"))
    return latest.latest_values(e, ["user_id"], F.col("event_id"), ["battery", "note", "last_event"])


@query("SELECT DISTINCT e.user_id AS ref FROM events e WHERE event_type = 'click' AND e.user_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def ack_if_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements only of receipts that exist, once each."""
    acks = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("user_id").alias("ref"))
    receipts = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("ref"))
    return acks.join(receipts, "ref", "left_semi").dropDuplicates(["ref"])


@query("SELECT conv_id, turn, substr(trim(coalesce(text, '')), 1, 240) AS body, coalesce(nullif(trim(role), ''), 'unknown') AS role FROM conversations")
def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, cut to the column's width, with defaults."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 240).alias("body"), F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown")).alias("role"))


@query("WITH s AS (SELECT c_custkey, unnest(['sms', 'whatsapp', 'push']) AS channel FROM customer), d AS (SELECT channel, CASE WHEN (c_custkey * 3 + length(channel)) % 7 = 0 THEN 'failed' WHEN channel = 'push' THEN 'unconfigured' WHEN c_custkey % 2 = 0 THEN 'sent' ELSE 'sim' END AS status FROM s) SELECT channel, count(*) AS total, count(*) FILTER (status IN ('sent', 'sim')) AS delivered, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'unconfigured') AS unconfigured FROM d GROUP BY channel")
def delivery_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message to every target by every channel, and its summary."""
    d = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, ("sms", "whatsapp", "push")))).alias("channel"))
    status = F.when((F.col("c_custkey") * 3 + F.length("channel")) % 7 == 0, "failed").when(F.col("channel") == "push", "unconfigured").when(F.col("c_custkey") % 2 == 0, "sent").otherwise("sim")
    d = d.withColumn("status", status)
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return d.groupBy("channel").agg(F.count("*").alias("total"), count("sent", "sim").alias("delivered"), count("failed").alias("failed"), count("unconfigured").alias("unconfigured"))


@query("SELECT c_nationkey, count(*) AS targets, count(*) FILTER (c_custkey % 5 = 0) AS expired, string_agg(CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR END, ',' ORDER BY c_custkey) AS expired_ids FROM customer GROUP BY c_nationkey")
def push_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Push fan-out with the ids to prune."""
    gone = F.col("c_custkey") % 5 == 0
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(gone, F.col("c_custkey")))), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("targets"), F.count_if(gone).alias("expired"), F.nullif(ids, F.lit("")).alias("expired_ids"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, CASE WHEN 240 + 120 < (SELECT count(*) FROM orders) THEN 360 END::BIGINT AS next_offset FROM orders ORDER BY o_orderkey LIMIT 120 OFFSET 240")
def page_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with its total and next offset."""
    limit, offset = paging.page_params({"per_page": ["120"], "start": "240"})
    return paging.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], limit, offset)


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 200) ORDER BY o_orderstatus = 'F', o_orderkey DESC")
def live_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows, live ones before closed ones."""
    newest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderkey")).limit(200)
    return newest.orderBy(F.col("o_orderstatus") == "F", F.desc("o_orderkey")).select("o_orderkey", "o_orderstatus")


@query("SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier ORDER BY s_nationkey DESC, s_acctbal, s_suppkey LIMIT 40")
def multi_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several keys in both directions."""
    return table(spark, sf_dir, "supplier").orderBy(F.desc("s_nationkey"), "s_acctbal", "s_suppkey").limit(40).select("s_suppkey", "s_acctbal", "s_nationkey")


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct union."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: INTERSECT."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: EXCEPT."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select("o_custkey"))


_SETS = "list_distinct(string_split(lower(text), ' '))"


@query(f"WITH p AS (SELECT conv_id, turn, {_SETS} AS a, lag({_SETS}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, len(list_intersect(a, b))::BIGINT AS n_both, (len(a) + len(b) - len(list_intersect(a, b)))::BIGINT AS n_either, len(list_intersect(a, b)) = len(a) AS subset FROM p WHERE b IS NOT NULL")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets as arrays: intersection, union, containment of a turn's words in the turn before."""
    words = F.array_distinct(F.split(F.lower("text"), " "))
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("a")).withColumn("b", F.lag("a").over(w)).filter("b is not null")
    both = F.size(F.array_intersect("a", "b"))
    return p.select("conv_id", "turn", both.cast("long").alias("n_both"), F.size(F.array_union("a", "b")).cast("long").alias("n_either"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))


@query("SELECT year_no AS y, kind, id, 'DS-' || year_no || '-' || lpad(n::VARCHAR, 4, '0') AS ref FROM (SELECT *, row_number() OVER (PARTITION BY year_no ORDER BY at_, kind, id) AS n FROM (SELECT year(o_orderdate) AS year_no, o_orderdate AS at_, 'a' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT year(ts), ts, 'b', event_id FROM events))")
def refs_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly sequence numbers over two tables: counts of a year's hours, added up, then numbers within an hour."""
    a = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderdate").alias("at"), F.lit("a").alias("kind"), F.col("o_orderkey").alias("id"))
    b = table(spark, sf_dir, "events").select(F.year("ts").alias("y"), F.col("ts").alias("at"), F.lit("b").alias("kind"), F.col("event_id").alias("id"))
    rows = a.unionByName(b).withColumn("hour", F.date_trunc("hour", "at"))
    before = F.sum("c").over(Window.partitionBy("y").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))  # over hours
    hours = rows.groupBy("y", "hour").agg(F.count("*").alias("c")).select("y", "hour", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("y", "hour").orderBy("at", "kind", "id"))
    rows = rows.join(hours, ["y", "hour"]).withColumn("n", F.col("before") + within)
    number = F.when(F.length(F.col("n").cast("string")) > 4, F.substring(F.col("n").cast("string"), 1, 4)).otherwise(F.lpad(F.col("n").cast("string"), 4, "0"))
    return rows.select(F.col("y").cast("long").alias("y"), "kind", "id", F.concat(F.lit("DS-"), F.col("y").cast("string"), F.lit("-"), number).alias("ref"))


@query("SELECT ref, id FROM (SELECT user_id % 40 AS ref, event_id AS id, row_number() OVER (PARTITION BY user_id % 40, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays of a client's uuid keep the first."""
    e = table(spark, sf_dir, "events").withColumn("ref", F.col("user_id") % 40)
    return latest.latest(e, ["ref", "event_type"], [F.col("event_id")]).select("ref", F.col("event_id").alias("id"))


@query(with_(("inc", derived.INCIDENTS)) + " SELECT 'incidents' AS name, count(*) AS n FROM inc UNION ALL SELECT 'open', count(*) FILTER (status NOT IN ('verified', 'dismissed')) FROM inc UNION ALL SELECT 'tasks', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'missing_table', NULL")
def ops_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over tables; an absent table counts as unknown, not as none."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    inc = derived.incidents(spark, sf_dir)
    out = one("incidents", inc).unionByName(one("open", inc.filter(~F.col("status").isin("verified", "dismissed"))))
    for name, file in (("tasks", "lineitem"), ("events", "events"), ("missing_table", "sos_events")):
        df = table_or_none(spark, sf_dir, file)
        unknown = spark.range(1).select(F.lit(name).alias("name"), F.lit(None).cast("long").alias("n"))
        out = out.unionByName(unknown if df is None else one(name, df))
    return out


@query("SELECT n_regionkey, count(DISTINCT c_custkey) AS owners, true AS approx_in_range FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def approx_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: approximate distinct customers per region, within 10 % of the exact number."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy("n_regionkey").agg(F.approx_count_distinct("c_custkey", 0.02).alias("a"), F.countDistinct("c_custkey").alias("d"))
    return g.select("n_regionkey", F.col("d").alias("owners"), (F.abs(F.col("a") - F.col("d")) <= F.col("d") * 0.1).alias("approx_in_range"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ruling_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: counts by every combination of two columns."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))

"""The batch detection pass: detections to clusters to scored incidents, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.functions.geo import public_level
from emberline.functions.times import now_at
from emberline.operators import clustering, similarity
from emberline.plans.registry import query, with_
from emberline.schemas import STATUS_SCORE, lookup
from emberline.sources import derived
from emberline.sources.files import geojson, ranked_report, table

NOW = "2024-01-31 00:00:00"

_HAVERSINE = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2))))"
_MATCH = (
    "list_position(list_transform(live, lambda c: round(" + _HAVERSINE.format(a="c.", b="d.") + ", 4) <= "
    "CASE WHEN c.location_name = d.location_name OR c.lga = d.lga THEN 55.0 WHEN c.state = d.state AND d.type IN ('kidnapping', 'banditry_attack', 'missing_person') THEN 55.0 WHEN d.type = 'armed_robbery' THEN 18.0 ELSE 30.0 END "
    "AND abs(epoch(d.published_at - c.ws)) <= 259200), true)"
)
_SEED = "struct_pack(lat := d.lat, lng := d.lng, location_name := d.location_name, state := d.state, lga := d.lga, ws := d.published_at, id := d.signal_id)"

#: Detections with the leader of their cluster, one step of all types at a time; clusters older than 72 hours are left behind.
LEADERS = (
    ("det", derived.DETECTIONS),
    ("d", "SELECT *, type AS block, row_number() OVER (PARTITION BY type ORDER BY published_at, signal_id) AS k FROM det"),
    (
        "s",
        f"SELECT block, k, [{_SEED}] AS cl, signal_id, signal_id AS leader_id FROM d WHERE k = 1 UNION ALL "
        f"SELECT block, k, CASE WHEN at_ > 0 THEN live ELSE list_append(live, seed) END, signal_id, CASE WHEN at_ > 0 THEN live[at_].id ELSE signal_id END FROM "
        f"(SELECT block, k, live, signal_id, coalesce({_MATCH}, 0) AS at_, seed FROM "
        f"(SELECT d.*, list_filter(s.cl, lambda c: epoch(d.published_at) - epoch(c.ws) <= 259200) AS live, {_SEED} AS seed FROM s JOIN d ON s.block = d.block AND d.k = s.k + 1) d)",
    ),
)

_OUTLET = "CASE source_name WHEN 'Punch Metro' THEN 'owner:punch' WHEN 'BBC News Pidgin' THEN 'wire:bbc' WHEN 'Reuters' THEN 'wire:reuters' WHEN 'Vanguard' THEN 'owner:vanguard' ELSE 'src:' || lower(source_name) END"
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) > 1 AND w <> 'near'))"
_BOTH = "len(list_intersect(g.rep, m.tokens))"
_ACCOUNT = f"list_position(list_transform(a.groups, lambda g: list_contains(g.outs, m.outlet) OR 10 * {_BOTH} >= 6 * (len(g.rep) + len(m.tokens) - {_BOTH})), true)"

ACCOUNTS = (
    *LEADERS,
    ("m", f"SELECT d.*, s.leader_id, {_OUTLET} AS outlet, {_TOKENS} AS tokens, row_number() OVER (PARTITION BY s.leader_id ORDER BY d.published_at, d.signal_id) AS n FROM d JOIN s USING (block, k)"),
    (
        "a",
        "SELECT leader_id, n, signal_id, [struct_pack(outs := [outlet], rep := tokens)] AS groups, 1 AS account FROM m WHERE n = 1 UNION ALL "
        "SELECT leader_id, n, signal_id, CASE WHEN at_ = 0 THEN list_append(groups, struct_pack(outs := [outlet], rep := tokens)) ELSE list_transform(groups, lambda g, i: CASE WHEN i = at_ THEN struct_pack(outs := list_append(g.outs, outlet), rep := g.rep) ELSE g END) END, "
        "CASE WHEN at_ = 0 THEN len(groups) + 1 ELSE at_ END FROM "
        f"(SELECT m.leader_id, m.n, m.signal_id, m.outlet, m.tokens, a.groups, coalesce({_ACCOUNT}, 0) AS at_ FROM a JOIN m ON a.leader_id = m.leader_id AND m.n = a.n + 1)",
    ),
)

SCORES = (
    *ACCOUNTS,
    ("x", f"SELECT m.*, a.account, round(1.0 - 0.65::DOUBLE * least(greatest(0.0, datediff_s / 3600.0::DOUBLE) / 72.0, 1.0), 9) AS w FROM (SELECT *, date_sub('second', published_at, TIMESTAMP '{NOW}') AS datediff_s FROM m) m JOIN a USING (leader_id, signal_id)"),
    ("p", "SELECT leader_id, account, arg_min(outlet, n) AS outlet, max(w) AS w FROM x GROUP BY ALL"),
    ("q", "SELECT leader_id, count(DISTINCT outlet) AS source_count, sum(w) AS mass FROM p GROUP BY ALL"),
    ("r", "SELECT leader_id, max(severity)::INTEGER AS severity, bool_or(hotspot) AS hotspot, min(published_at) AS window_start, max(published_at) AS window_end, list(signal_id ORDER BY signal_id) AS ids FROM x GROUP BY ALL"),
    (
        "z",
        "SELECT r.*, source_count, trunc(greatest(5.0, least(99.0, round(22 + 26 * log2(least(round(mass, 6), source_count) + 1) + CASE WHEN severity > 0 THEN 10 ELSE 0 END + CASE WHEN hotspot THEN 6 ELSE 0 END, 6))))::INTEGER AS raw FROM q JOIN r USING (leader_id)",
    ),
)


@query(with_(*LEADERS) + " SELECT signal_id, leader_id FROM s")
def cluster_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection joins the first cluster of its type within the adaptive radius and 72 hours."""
    return clustering.leaders(derived.detections(spark, sf_dir)).select("signal_id", "leader_id")


@query(with_(*ACCOUNTS) + " SELECT leader_id, signal_id, account::BIGINT AS account FROM a")
def neardup_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a cluster that repeat one account, by outlet or by title."""
    placed = clustering.leaders(derived.detections(spark, sf_dir))
    placed = placed.withColumn("outlet", text.outlet(F.col("source_name"))).withColumn("tokens", text.tokens(F.col("title")))
    return clustering.accounts(placed, ["leader_id"], ["published_at", "signal_id"]).select("leader_id", "signal_id", "account")


@query(
    with_(*SCORES)
    + """ SELECT leader_id, type, location_name, source_count, severity, window_start, window_end, len(ids)::BIGINT AS n_signals,
  CASE WHEN source_count >= 2 AND (z.severity > 0 OR raw >= 65) THEN 'needs_human_review' WHEN source_count >= 2 THEN 'corroborated' ELSE 'candidate_unverified' END AS status,
  CASE WHEN source_count >= 2 THEN raw ELSE least(45, raw) END AS confidence FROM (SELECT z.*, d.type, d.location_name FROM z JOIN d ON z.leader_id = d.signal_id) z"""
)
def incident_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents scored by independent, recent sources."""
    return incident_scores(spark, sf_dir).select("leader_id", "type", "location_name", "source_count", F.col("severity").cast("int").alias("severity"), "window_start", "window_end", F.size("signal_ids").cast("long").alias("n_signals"), "status", "confidence")


def incident_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: detections of a table folder to scored incidents with public levels."""
    out = clustering.incidents(derived.detections(spark, sf_dir), now_at(NOW))
    return out.withColumn("level", public_level(lookup(STATUS_SCORE, F.col("status"), 1)))


@query(
    with_(("inc", derived.INCIDENTS))
    + """ SELECT incident_uuid, status, confidence::BIGINT AS confidence, row_number() OVER (ORDER BY
  CASE status WHEN 'verified' THEN 4 WHEN 'needs_human_review' THEN 3 WHEN 'corroborated' THEN 2 WHEN 'candidate_unverified' THEN 1 ELSE 0 END DESC, confidence DESC, incident_uuid) AS position FROM inc ORDER BY position LIMIT 50"""
)
def ranked_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The console report's head, by status and confidence."""
    from pyspark.sql import Window

    top = ranked_report(derived.incidents(spark, sf_dir)).limit(50)
    w = Window.orderBy(F.desc("rank"), F.desc("confidence"), "incident_uuid")  # over 50 rows
    return top.select("incident_uuid", "status", "confidence", F.row_number().over(w).cast("long").alias("position"))


@query()
def geojson_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GeoJSON feature per incident."""
    return geojson(derived.incidents(spark, sf_dir))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_ACCOUNT) + "], w)))"


@query(
    with_(
        ("d", f"SELECT doc_id, list_sort({_WORDS}) AS t FROM documents"),
        ("c", "SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS class_id FROM d"),
        ("r", "SELECT class_id, t, len(t) AS n FROM c WHERE doc_id = class_id AND len(t) > 0"),
        ("w", "SELECT class_id, n, unnest(t) AS w FROM r"),
        ("p", "SELECT x.class_id AS a, y.class_id AS b, x.n AS na, y.n AS nb, count(*) AS both_ FROM w x JOIN w y ON x.w = y.w AND x.class_id < y.class_id AND 10 * x.n >= 6 * y.n AND 10 * y.n >= 6 * x.n GROUP BY ALL"),
    )
    + ' SELECT a, b, both_ AS "both", na + nb - both_ AS "either" FROM p WHERE 10 * both_ >= 6 * (na + nb - both_)'
)
def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal token sets whose Jaccard similarity is 0.6 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return similarity.similar_classes(docs, "doc_id", "t")


@query(with_(("d", f"SELECT doc_id, list_sort({_WORDS}) AS t FROM documents")) + " SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id, len(t)::BIGINT AS n_tokens FROM d")
def neardup_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal token sets that each document is in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return similarity.classes(docs, "doc_id", "t").select("doc_id", "class_id", "n_tokens")

"""Incident-shaped views over the driver's tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.sources.files import table

_CENTRE = "(400 + {u} % 25 * 40 + {e} % 20) / 100 AS lat, (300 + {u} * 7 % 25 * 45 + {e} * 3 % 20) / 100 AS lng, concat('place', {u} % 25) AS location_name, concat('state', {u} % 5) AS state"

DETECTIONS = f"""SELECT event_id AS signal_id,
  CASE event_type WHEN 'error' THEN 'kidnapping' WHEN 'view' THEN 'armed_robbery' WHEN 'click' THEN 'banditry_attack' WHEN 'signup' THEN 'missing_person' ELSE 'police_misconduct' END AS type,
  ts AS published_at,
  CASE user_id % 7 WHEN 0 THEN 'Punch Metro' WHEN 1 THEN 'BBC News Pidgin' WHEN 2 THEN 'Reuters' WHEN 3 THEN 'Vanguard' ELSE concat('Local ', user_id % 7) END AS source_name,
  concat(event_type, ' near place', user_id % 25, ' mark', event_id % 5) AS title,
  user_id, {_CENTRE.format(u="user_id", e="event_id")},
  CASE WHEN value > 120 THEN 2 WHEN value > 60 THEN 1 ELSE 0 END AS severity, user_id % 10 = 0 AS hotspot, value,
  CASE WHEN event_id % 4 = 0 THEN concat('lga', user_id % 25 % 13) END AS lga FROM events"""

INCIDENTS = f"""SELECT o_orderkey AS incident_uuid, o_custkey AS owner, o_orderdate AS window_end, o_orderpriority AS label,
  CASE o_orderkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_human_review' WHEN 2 THEN 'corroborated' WHEN 3 THEN 'candidate_unverified' ELSE 'dismissed' END AS status,
  {_CENTRE.format(u="o_custkey", e="o_orderkey")}, o_orderkey * 7 % 95 + 5 AS confidence, o_orderkey % 3 AS severity, o_totalprice FROM orders"""

DECISIONS = """SELECT l_orderkey AS incident, l_shipdate AS ruled_at, concat_ws('|', strftime(l_shipdate, '%Y-%m-%d'), lpad(cast(l_linenumber AS varchar), 2, '0'), lpad(cast(l_partkey AS varchar), 9, '0'), lpad(cast(l_suppkey AS varchar), 9, '0')) AS seq,
  CASE l_returnflag WHEN 'R' THEN 'dismissed' WHEN 'A' THEN 'verified' ELSE 'reviewing' END AS ruling, l_linenumber AS line FROM lineitem"""

PLACES = """SELECT n_nationkey AS place_id, n_name AS name, (400 + n_nationkey * 40) / 100 AS lat, (300 + n_nationkey * 7 % 25 * 45) / 100 AS lng, r_name AS state,
  CASE n_nationkey % 3 WHEN 0 THEN 'town' WHEN 1 THEN 'ward' ELSE 'lga' END AS kind FROM nation JOIN region ON n_regionkey = r_regionkey"""


def _spark(sql: str) -> str:
    return sql.replace("strftime(l_shipdate, '%Y-%m-%d')", "date_format(l_shipdate, 'yyyy-MM-dd')").replace("AS varchar", "AS string")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived view over files, with no names registered in the session."""
    frames = {n: table(spark, sf_dir, n) for n in ("events", "orders", "lineitem", "nation", "region", "customer", "supplier", "documents") if f" {n}" in sql}
    text = _spark(sql)
    for n in frames:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(text, **frames)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DETECTIONS)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, INCIDENTS)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DECISIONS)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with aliases: the name's number, and the name in other spelling."""
    p = view(spark, sf_dir, PLACES)
    return p.withColumn("aliases", F.array(F.concat(F.lit("N-"), F.col("place_id").cast("string")), F.concat(F.lit("Old "), F.col("name"))))

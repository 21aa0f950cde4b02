"""Schemas and fixed vocabularies of incident data.

The maps below are fixed values: results depend on them being exactly these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# schemas, as DDL
SIGNAL = "signal_id bigint, source_name string, kind string, title string, text string, url string, lang string, published_at timestamp_ntz"
DETECTION = (
    "signal_id bigint, type string, published_at timestamp_ntz, source_name string, title string, lat double, lng double, location_name string, state string, severity int, hotspot boolean"
)
INCIDENT = (
    "incident_uuid string, type string, location_name string, state string, lat double, lng double, window_start timestamp_ntz, window_end timestamp_ntz, source_count int, severity int, confidence int, status string, summary string, signal_ids array<bigint>"
)
SAMPLES = "signals array<struct<source:string,hours_ago:int,lang:string,title:string,text:string>>"
PLACE = "name string, lat double, lng double, state string, kind string, hotspot boolean, aliases array<string>"
FEED_ITEM = "title string, description string, link string, pubDate string"

# fixed values: status to risk score, public levels, freshness in hours by status
STATUS_SCORE = {"verified": 4, "needs_human_review": 3, "corroborated": 2, "candidate_unverified": 1, "dismissed": 0}
LEVEL_ORDER = {"GREEN": 0, "YELLOW": 1, "ORANGE": 2, "RED": 3}
STATUS_TTL_HOURS = {"verified": 240, "needs_human_review": 96, "corroborated": 72}
DEFAULT_TTL_HOURS = 48
ALERT_TTL_HOURS = {"RED": 24, "ORANGE": 12, "YELLOW": 6, "GREEN": 3}
ALERT_TTL_DEFAULT = 24

# fixed values: clustering and scoring
WINDOW_HOURS = 72
RADIUS_KM, RADIUS_WIDE_KM, RADIUS_URBAN_KM = 30.0, 55.0, 18.0
LONG_RANGE_TYPES = ("kidnapping", "banditry_attack", "banditry", "abduction", "missing_person")
URBAN_TYPES = ("armed_robbery",)
DECAY_FLOOR = 0.35

# fixed values: incident vocabulary
OTHER_TYPE = "other_needs_review"
INCIDENT_TYPES = ("kidnapping", "banditry_attack", "armed_robbery", "missing_person", "police_misconduct", OTHER_TYPE)
TYPE_ALIASES = {
    "abduction": "kidnapping",
    "kidnap": "kidnapping",
    "banditry": "banditry_attack",
    "bandit_attack": "banditry_attack",
    "robbery": "armed_robbery",
    "missing": "missing_person",
    "missing_persons": "missing_person",
    "police_brutality": "police_misconduct",
}

# fixed values: roles
ROLE_RANK = {"viewer": 1, "reviewer": 2, "analyst": 2, "verifier": 3, "operator": 3, "admin": 4}

# fixed values: state machines, as state|event -> next state; those of tasks and alerts as state|next state -> next state
SOS_MACHINE = {
    "TRIGGERED|capture_location": "LOCATION_CAPTURED",
    "TRIGGERED|notify_circle": "CIRCLE_NOTIFIED",
    "TRIGGERED|operator_ack": "OPERATOR_ACK",
    "TRIGGERED|escalate": "ESCALATED",
    "TRIGGERED|mark_safe": "SAFE",
    "TRIGGERED|close": "CLOSED",
    "LOCATION_CAPTURED|notify_circle": "CIRCLE_NOTIFIED",
    "LOCATION_CAPTURED|operator_ack": "OPERATOR_ACK",
    "LOCATION_CAPTURED|escalate": "ESCALATED",
    "LOCATION_CAPTURED|mark_safe": "SAFE",
    "LOCATION_CAPTURED|close": "CLOSED",
    "CIRCLE_NOTIFIED|delivery_confirmed": "DELIVERED",
    "CIRCLE_NOTIFIED|operator_ack": "OPERATOR_ACK",
    "CIRCLE_NOTIFIED|escalate": "ESCALATED",
    "CIRCLE_NOTIFIED|mark_safe": "SAFE",
    "CIRCLE_NOTIFIED|close": "CLOSED",
    "DELIVERED|operator_ack": "OPERATOR_ACK",
    "DELIVERED|escalate": "ESCALATED",
    "DELIVERED|mark_safe": "SAFE",
    "DELIVERED|close": "CLOSED",
    "OPERATOR_ACK|request_112": "HANDOFF_112_REQUESTED",
    "OPERATOR_ACK|coordinate": "COORDINATED",
    "OPERATOR_ACK|escalate": "ESCALATED",
    "OPERATOR_ACK|mark_safe": "SAFE",
    "OPERATOR_ACK|close": "CLOSED",
    "HANDOFF_112_REQUESTED|coordinate": "COORDINATED",
    "HANDOFF_112_REQUESTED|escalate": "ESCALATED",
    "HANDOFF_112_REQUESTED|mark_safe": "SAFE",
    "HANDOFF_112_REQUESTED|close": "CLOSED",
    "COORDINATED|request_112": "HANDOFF_112_REQUESTED",
    "COORDINATED|escalate": "ESCALATED",
    "COORDINATED|mark_safe": "SAFE",
    "COORDINATED|close": "CLOSED",
    "ESCALATED|operator_ack": "OPERATOR_ACK",
    "ESCALATED|request_112": "HANDOFF_112_REQUESTED",
    "ESCALATED|coordinate": "COORDINATED",
    "ESCALATED|mark_safe": "SAFE",
    "ESCALATED|close": "CLOSED",
    "CLOSE_REQUESTED|close": "CLOSED",
    "DURESS_CONFIRMED|close": "CLOSED",
    "SAFE|close": "CLOSED",
}
TASK_MACHINE = {
    "received|received": "received",
    "received|reviewing": "reviewing",
    "received|responding": "responding",
    "received|closed": "closed",
    "reviewing|reviewing": "reviewing",
    "reviewing|responding": "responding",
    "reviewing|received": "received",
    "reviewing|closed": "closed",
    "responding|responding": "responding",
    "responding|reviewing": "reviewing",
    "responding|closed": "closed",
    "closed|closed": "closed",
}
ALERT_MACHINE = {
    "PUBLISHED|UPDATED": "UPDATED",
    "PUBLISHED|CANCELLED": "CANCELLED",
    "PUBLISHED|EXPIRED": "EXPIRED",
    "UPDATED|UPDATED": "UPDATED",
    "UPDATED|CANCELLED": "CANCELLED",
    "UPDATED|EXPIRED": "EXPIRED",
}

# fixed values: reputation
REP_START, REP_GAIN, REP_LOSS, REP_LOW, REP_HIGH, REP_TRUST_MIN = 50.0, 6.0, 10.0, 35.0, 70.0, 3

# fixed values: search
SPEED_KMH = {"road": 50.0, "mixed": 25.0, "forest": 12.0, "mountain": 8.0}
REACH_CAP_KM, REACH_MIN_HOURS, GRID_N = 250.0, 0.25, 48
CONE_HALF_DEG, CONE_STEP_DEG, CONE_MAX_KM = 34, 8, 120.0
CORRIDOR_KM, WAYPOINTS, RISK_KM = 55.0, 24, 60.0


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """mapping[key], or default."""
    value = F.lit(default)
    chain = None
    for k, v in mapping.items():
        chain = F.when(key == k, F.lit(v)) if chain is None else chain.when(key == k, F.lit(v))
    return chain.otherwise(value) if chain is not None else value


def literal_map(mapping: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))

"""What each audience may see of a row: allowed columns only, with defaults, flags and redactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import text

# fixed values: the columns of each view, in order; "name?" is a flag, "name=x" has a default, "shown<name" is renamed
VIEWS: dict[str, tuple[str, ...]] = {
    "sos": ("id<sos_uuid", "ref<handoff_ref", "state", "mode", "contact_state", "created_at", "updated_at"),
    "journey": (
        "journey_uuid", "ref<handoff_ref", "created_at", "updated_at", "started_at", "expected_arrival", "from_place", "to_place",
        "state", "risk_level", "anomaly_level", "anomaly_reason", "last_checkin_at", "share_consent?",
    ),
    "readiness": (
        "owner_token", "platform", "findmy_enabled?", "findhub_enabled?", "trusted_contacts", "silent_sos?", "sms_fallback?",
        "wearable?", "offline_pack?", "readiness_score", "gaps", "updated_at",
    ),
    "evidence": ("evidence_uuid", "case_uuid", "evidence_type", "status", "public_summary="),
    "safety_point": ("point_uuid", "name", "point_type", "state", "lga", "address", "lat", "lng", "vetted?", "last_verified_at"),
    "safemeet": (
        "session_uuid", "created_at", "updated_at", "meeting_type", "risk_level", "meeting_place", "meeting_address", "meeting_lat",
        "meeting_lng", "contact_name", "contact_phone", "vehicle_description", "license_plate", "expected_arrival", "expected_departure",
        "actual_arrival", "actual_departure", "checkin_interval_minutes", "last_checkin_at", "next_checkin_due", "missed_checkins", "state",
        "duress_triggered?", "location_changed?", "route_deviation?", "escalated_at", "escalation_reason", "user_notes",
    ),
    "safemeet_checkin": ("checkin_uuid", "ts", "checkin_type", "lat", "lng", "location_accuracy", "battery_level", "network_type", "note", "duress_flag?", "photo_url"),
    "user": ("user_uuid", "first_name=", "language=en", "phone<phone_display", "guardian_policy_id", "status=active"),
    "guardian": ("guardian_uuid", "name=Guardian", "channel=sms", "address_redacted<address", "verified?", "active?"),
    "place": ("place_uuid", "alias=", "place=", "lat", "lng", "active?"),
    "route": ("route_uuid", "origin_alias=", "destination_alias=", "days=", "departure_window=", "expected_arrival=", "escalation_policy=", "active?"),
}
#: Constant marks of views.
MARKS = {"journey": {"coords_redacted": True}, "evidence": {"restricted": True}}


def _shown(name: str, source: Column) -> Column:
    if name == "phone":
        return text.redact_phone(source)
    return text.redact_address(source) if name == "address_redacted" else source


def public(df: DataFrame, view: str) -> DataFrame:
    """Rows as the view's audience sees them. Columns that the view has and df has not are NULL; no others pass."""
    out = []
    for spec in VIEWS[view]:
        flag, (spec, has_default, default) = spec.endswith("?"), spec.removesuffix("?").partition("=")
        name, renamed, source = spec.partition("<")
        source = source if renamed else name
        value = F.col(source) if source in df.columns else F.lit(None).cast("string")
        if flag:
            value = F.coalesce(value.cast("boolean"), F.lit(False))
        elif has_default:
            value = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default))
        out.append(_shown(name, value).alias(name))
    return df.select(*out, *(F.lit(v).alias(k) for k, v in MARKS.get(view, {}).items()))


def public_sos(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """The view of SOS events with their deliveries (sos_uuid, status) counted: all, and those that went out."""
    out = ("failed", "unconfigured", "")
    counts = deliveries.groupBy(F.col("sos_uuid").alias("id")).agg(F.count("*").alias("n"), F.count_if(~F.coalesce("status", F.lit("")).isin(*out)).alias("sent"))
    zero = F.lit(0).cast("long")
    seen = public(events, "sos").join(counts, "id", "left")
    return seen.withColumn("deliveries_total", F.coalesce("n", zero)).withColumn("deliveries_sent", F.coalesce("sent", zero)).drop("n", "sent")

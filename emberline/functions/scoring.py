"""Scores and rules as Column expressions: readiness, meetings, journeys, alerts, reputation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.times import is_night
from emberline.schemas import REP_HIGH, REP_LOW, REP_TRUST_MIN, lookup

# fixed values: points of a meeting's type
MEETING_POINTS = {"dating": 20, "marketplace_sale": 15, "job_interview": 10, "ride_share": 25, "delivery": 15, "house_call": 20, "business_meeting": 5, "informant_meeting": 40}
# fixed values: what is missing for full readiness
GAPS = {
    "find": "Enable Apple Find My or Google Find Hub before travel.",
    "second": "Add a second trusted contact.",
    "contacts": "Add trusted contacts for SOS notification.",
    "silent_sos": "Test silent SOS.",
    "sms_fallback": "Set an SMS fallback contact.",
    "wearable": "Pair a wearable or hardware tracker for high-risk trips.",
    "offline_pack": "Download offline route and emergency instructions.",
}
_POINTS = {"silent_sos": 15, "sms_fallback": 15, "wearable": 10, "offline_pack": 20}


def readiness(find: Column, contacts: Column, flags: dict[str, Column]) -> Column:
    """struct(score, gaps): 0 to 100 and what is missing, in order."""
    score = F.when(find, 20).otherwise(0) + F.when(contacts >= 2, 20).when(contacts == 1, 10).otherwise(0)
    gaps = [F.when(~find, GAPS["find"]), F.when(contacts == 1, GAPS["second"]).when(contacts < 1, GAPS["contacts"])]
    for name, points in _POINTS.items():
        score = score + F.when(flags[name], points).otherwise(0)
        gaps.append(F.when(~flags[name], GAPS[name]))
    return F.struct(F.least(F.lit(100), score).alias("score"), F.filter(F.array(*gaps), lambda g: g.isNotNull()).alias("gaps"))


def meeting_risk(kind: Column, at: Column) -> Column:
    """struct(score, level); an unknown kind adds 10, the night 15."""
    score = 50 + lookup(MEETING_POINTS, kind, 10) + F.when(F.coalesce(is_night(at), F.lit(False)), 15).otherwise(0)
    level = F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").otherwise("low")
    return F.struct(score.alias("score"), level.alias("level"))


def journey_assessment(state: Column, kind: Column, battery: Column, expected: Column, deviation_km: Column, now: Column) -> Column:
    """struct(level, reason, state): distress first, arrival next, then the last rule that holds."""
    late = expected.isNotNull() & ~state.isin("arrived", "closed") & (now > expected + F.expr("INTERVAL 15 MINUTES"))
    made = lambda level, reason, to: F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"), to.alias("state"))
    return (
        F.when(kind.isin("duress", "emergency", "sos"), made("critical", "duress event received", F.lit("escalated")))
        .when(kind == "arrived", made("normal", "", F.lit("arrived")))
        .when(deviation_km > 5, made("warning", "reported route deviation", state))
        .when(late, made("warning", "journey overdue", state))
        .when(battery <= 10, made("warning", "battery critically low", state))
        .when(kind.isin("checkin_failed", "missed_checkin"), made("warning", "missed check-in", state))
        .otherwise(made("normal", "", state))
    )


def meeting_anomalies(distance_km: Column, device: Column, state: Column, departure: Column, arrival: Column, next_due: Column, now: Column) -> Column:
    """struct of flags and their reasons, in order."""
    no = lambda c: F.coalesce(c, F.lit(False))
    moved, off = no(distance_km > 5.0), no((device == "offline") & (state == "in_progress"))
    over, missed = no(arrival.isNotNull() & (now > departure)), no(now > next_due)
    reasons = F.array(
        F.when(moved, F.concat(F.lit("Moved "), F.format_string("%.1f", distance_km), F.lit("km from meeting location"))),
        F.when(off, F.lit("Device went offline during active meeting")),
        F.when(over, F.lit("Meeting exceeded expected duration")),
        F.when(missed, F.lit("Scheduled check-in missed")),
    )
    return F.struct(moved.alias("location_changed"), off.alias("phone_off"), over.alias("duration_exceeded"), missed.alias("checkin_missed"), F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


def alert_level(confidence: Column, severity: Column) -> Column:
    return F.when((confidence >= 90) | (severity > 0), 4).when(confidence >= 80, 3).when(confidence >= 70, 2).otherwise(1)


def accuracy(verified: Column, dismissed: Column) -> Column:
    """Share of judged reports that were verified, NULL if none was judged."""
    return F.try_divide(verified, F.nullif(verified + dismissed, F.lit(0)))


def reputation_band(score: Column, verified: Column, dismissed: Column) -> Column:
    judged = verified + dismissed
    return F.when((score <= REP_LOW) & (judged >= 1), "low").when((score >= REP_HIGH) & (judged >= REP_TRUST_MIN), "trusted").otherwise("neutral")


def corroboration_weight(band: Column) -> Column:
    return F.when(band == "low", 0.4).when(band == "trusted", 1.25).otherwise(1.0)


def risk_of(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), (100.0 - score).cast("int")))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, NULL where the whole is 0 or unknown."""
    return F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))

"""Funnel metrics: medians and rates that keep unknown (NULL) apart from none (0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scoring import rate


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes, NULL where unknown or negative."""
    m = F.timestamp_diff("SECOND", start, end) / 60.0
    return F.when(m >= 0, m)


def funnel(signals: DataFrame, decisions: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: median minutes from signal to review and from review to alert (verified only), and the false-positive rate.

    signals: incident, at. decisions: the latest of each incident, with ruling and at. alerts: incident, at.
    """
    d = decisions.select("incident", "ruling", F.col("at").alias("decided_at"))
    review = signals.join(d, "incident").agg(F.median(minutes_between(F.col("at"), F.col("decided_at"))).alias("signal_to_review_min"))
    alert = alerts.join(d.filter("ruling = 'verified'"), "incident").agg(F.median(minutes_between(F.col("decided_at"), F.col("at"))).alias("review_to_alert_min"))
    judged = d.agg(F.count_if(F.col("ruling") == "dismissed").alias("dismissed"), F.count_if(F.col("ruling").isin("verified", "dismissed")).alias("judged"))
    judged = judged.select("dismissed", "judged", rate(F.col("dismissed"), F.col("judged")).alias("false_positive_rate"))
    return review.crossJoin(alert).crossJoin(judged)  # three rows of one each


def acknowledgement(tasks: DataFrame, sla_min: int = 30) -> DataFrame:
    """One row over tasks (state, created_at, ack_at): acknowledged, and within the SLA, as shares of all tasks."""
    acked = F.col("ack_at").isNotNull() | (F.col("state") != "received")
    quick = F.coalesce(minutes_between(F.col("created_at"), F.col("ack_at")) <= sla_min, F.lit(False))
    total = F.count("*")
    return tasks.agg(total.alias("tasks"), F.count_if(acked).alias("acked"), F.count_if(quick).alias("within_sla")).select(
        "tasks", "acked", "within_sla", rate(F.col("acked"), F.col("tasks")).alias("ack_rate"), rate(F.col("within_sla"), F.col("tasks")).alias("sla_rate")
    )


#: The record's columns by the part that makes them; a part whose table is absent is all NULL.
_PARTS = {
    "timing": "signal_to_review_min double, review_to_alert_min double, false_positive_dismissed bigint, false_positive_judged bigint, false_positive_rate double, verified_emergencies bigint",
    "alerts": "alerts_active bigint",
    "sos": "sos_total bigint, sos_open bigint, sos_safe bigint, sos_closed bigint",
    "responder": "responder_total bigint, responder_acknowledged bigint, responder_ack_rate double, responder_within_sla bigint, responder_sla_rate double",
    "cases": "cases_open bigint, cases_resolved bigint",
    "deliveries": "deliveries bigint, deliveries_real bigint, deliveries_sim bigint, deliveries_acknowledged bigint, recipient_ack_rate double",
}


def kpis(funnel_row: DataFrame | None = None, alerts: DataFrame | None = None, sos: DataFrame | None = None, tasks: DataFrame | None = None, cases: DataFrame | None = None, deliveries: DataFrame | None = None, receipts: DataFrame | None = None, sla_min: int = 30) -> DataFrame:
    """The KPI record, one row: ten headlines, the counts behind them, and the north star. Tables may be absent.

    funnel_row: signal_to_review_min, review_to_alert_min, dismissed, judged, false_positive_rate, verified. alerts:
    active. sos: state. tasks: state, created_at, ack_at. cases: status. deliveries: sim; receipts: their acknowledgements.
    """
    made: dict[str, DataFrame] = {}
    if funnel_row is not None:
        made["timing"] = funnel_row.select("signal_to_review_min", "review_to_alert_min", F.col("dismissed").alias("false_positive_dismissed"), F.col("judged").alias("false_positive_judged"), "false_positive_rate", F.col("verified").alias("verified_emergencies"))
    if alerts is not None:
        made["alerts"] = alerts.agg(F.count_if("active").alias("alerts_active"))
    if sos is not None:
        state = F.coalesce("state", F.lit(""))
        made["sos"] = sos.agg(F.count("*").alias("sos_total"), F.count_if(~state.isin("SAFE", "CLOSED")).alias("sos_open"), F.count_if(state == "SAFE").alias("sos_safe"), F.count_if(state == "CLOSED").alias("sos_closed"))
    if tasks is not None:
        a = acknowledgement(tasks, sla_min)
        made["responder"] = a.select(F.col("tasks").alias("responder_total"), F.col("acked").alias("responder_acknowledged"), F.col("ack_rate").alias("responder_ack_rate"), F.col("within_sla").alias("responder_within_sla"), F.col("sla_rate").alias("responder_sla_rate"))
    if cases is not None:
        made["cases"] = cases.agg(F.count_if(F.col("status") == "active").alias("cases_open"), F.count_if(F.col("status").isin("located", "recovered")).alias("cases_resolved"))
    if deliveries is not None:
        d = deliveries.agg(F.count("*").alias("deliveries"), F.count_if(F.col("sim") == 1).alias("deliveries_sim"))
        acked = receipts.agg(F.count("*").alias("deliveries_acknowledged")) if receipts is not None else d.sparkSession.range(1).select(F.lit(0).cast("long").alias("deliveries_acknowledged"))
        d = d.crossJoin(acked).withColumn("deliveries_real", F.col("deliveries") - F.col("deliveries_sim"))
        made["deliveries"] = d.withColumn("recipient_ack_rate", rate(F.col("deliveries_acknowledged"), F.col("deliveries")))
    if not made:
        raise ValueError("no table at all")
    out = None
    for df in made.values():  # rows of one each
        out = df if out is None else out.crossJoin(df)
    for name, columns in _PARTS.items():
        for column, kind in (c.split() for c in columns.split(", ")):
            if name not in made:
                out = out.withColumn(column, F.lit(None).cast(kind))
    star = {"acknowledged_responses": F.col("responder_acknowledged"), "within_sla_rate": F.col("responder_sla_rate"), "ack_sla_min": F.lit(sla_min)}
    return out.select(*(c.split()[0] for columns in _PARTS.values() for c in columns.split(", ")), *(x.alias(n) for n, x in star.items()))


def max_share(df: DataFrame, groups: list[str], key: Column, name: str) -> DataFrame:
    """Share of the most frequent key among rows that have one."""
    counts = df.withColumn("__k", key).filter("__k is not null").groupBy(*groups, "__k").agg(F.count("*").alias("n"))
    return counts.groupBy(*groups).agg(F.round(F.max("n") / F.sum("n"), 3).alias(name))


def coordination(df: DataFrame, groups: list[str], caller: Column, area: Column, at: str, least: int = 4, minutes: float = 10.0, share: float = 0.6) -> DataFrame:
    """Burst signals per group: many reports close together, and whether one caller or area dominates them."""
    span = F.round(F.timestamp_diff("SECOND", F.min(at), F.max(at)) / 60.0, 3)
    base = df.groupBy(*groups).agg(F.count("*").alias("n_reports"), F.when(F.count(at) < 2, F.lit(0.0)).otherwise(span).alias("span_min"))
    out = base.join(max_share(df, groups, caller, "caller_share"), groups, "left").join(max_share(df, groups, area, "area_share"), groups, "left")
    out = out.withColumn("burst", (F.col("n_reports") >= least) & (F.col("span_min") <= minutes))
    heavy = (F.coalesce("caller_share", F.lit(0.0)) >= share) | (F.coalesce("area_share", F.lit(0.0)) >= share)
    return out.withColumn("coordinated", F.col("burst") & heavy)


def near_identical_share(df: DataFrame, groups: list[str], order: list[str], tokens: str, tenths: int = 6) -> DataFrame:
    """Share of the largest set of near-identical texts per group; groups are windows, so an array is a window's reports.

    Each report not yet absorbed leads, and absorbs later ones that are alike it.
    """
    rows = df.filter(F.size(tokens) > 0).groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(tokens).alias("t")))).alias("rows"))

    def step(acc: Column, e: Column) -> Column:
        def like(g: Column) -> Column:
            both = F.size(F.array_intersect(g["t"], e["t"]))
            return 10 * both >= tenths * (F.size(g["t"]) + F.size(e["t"]) - both)

        at = F.array_position(F.transform(acc, like), F.lit(True)).cast("int")
        fresh = F.array(F.struct(e["t"].alias("t"), F.lit(1).alias("n")))
        return F.transform(F.array(at), lambda k: F.when(k == 0, F.concat(acc, fresh)).otherwise(F.transform(acc, lambda g, i: F.struct(g["t"].alias("t"), F.when(i + 1 == k, g["n"] + 1).otherwise(g["n"]).alias("n")))))[0]

    led = F.aggregate("rows", F.array().cast("array<struct<t:array<string>,n:int>>"), step)
    best = F.array_max(F.transform(led, lambda g: g["n"]))
    return rows.select(*groups, F.size("rows").cast("long").alias("n_texts"), F.when(F.size("rows") < 2, F.lit(0.0)).otherwise(F.round(best / F.size("rows"), 3)).alias("text_share"))

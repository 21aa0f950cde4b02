"""Detections to incidents: greedy clusters in order, independent accounts, and scores.

A detection joins the first cluster of its type whose leader is near enough and no more than 72 hours older; the order is
(published_at, signal_id). So clusters depend on order, but only leaders matter: what a detection joins depends on its
place and time alone. Detections are first reduced to distinct (type, place, second), by partial aggregation; these are
dealt to blocks that no cluster can span (a type within a connected region of occupied cells, between gaps of more than
72 hours), and each block is walked in time order, with the leaders that cover each place at hand. A new leader is
compared with the places within its band of latitude, once for each place that leads. The leaders are joined back.

A block is one task: a type's distinct places and seconds in one connected region without a gap of three days, some 100
bytes each, at about a million a second.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import text, times
from emberline.functions.geo import EARTH_KM
from emberline.schemas import LONG_RANGE_TYPES, RADIUS_KM, RADIUS_URBAN_KM, RADIUS_WIDE_KM, URBAN_TYPES, WINDOW_HOURS

#: What an incident shows of its first detection.
SHOWN = ("type", "location_name", "state", "lat", "lng", "title")
_KM_PER_DEGREE = math.pi * EARTH_KM / 180
_SPOT = ("__type", "__lat", "__lng", "__place", "__state", "__lga")


class _Spots:
    """Distinct places of a block, and which of them a leader at one of them covers."""

    def __init__(self, kind: str, lat: np.ndarray, lng: np.ndarray, names: list[np.ndarray]) -> None:
        self.lat, self.lng, self.names = lat, lng, names  # names: codes of place, state and lga, 0 for none
        self.order = np.argsort(lat, kind="stable")
        self.sorted = lat[self.order]
        far = kind in LONG_RANGE_TYPES
        self.state_radius = RADIUS_WIDE_KM if far else 0.0
        self.radius = RADIUS_URBAN_KM if kind in URBAN_TYPES and not far else RADIUS_KM
        self.known: dict[int, list[int]] = {}

    def covered(self, i: int) -> list[int]:
        if i not in self.known:
            reach = RADIUS_WIDE_KM / _KM_PER_DEGREE + 1e-3
            at = self.order[np.searchsorted(self.sorted, self.lat[i] - reach) : np.searchsorted(self.sorted, self.lat[i] + reach, "right")]
            a, b = np.radians(self.lat[i]), np.radians(self.lat[at])
            h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(self.lng[i] - self.lng[at]) / 2) ** 2
            km = np.round(2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h))), 4)
            same = [(x[at] == x[i]) & (x[i] > 0) for x in self.names]
            radius = np.where(same[0] | same[2], RADIUS_WIDE_KM, np.where(same[1], max(self.state_radius, self.radius), self.radius))
            self.known[i] = at[km <= radius].tolist()
        return self.known[i]


def _lead(spots: _Spots, spot: list[int], second: list[float]) -> list[int]:
    """For each event, in order, the event that leads its cluster."""
    covers: dict[int, list[int]] = {}  # leaders that cover a place, the oldest first
    out = []
    for e, (s, t) in enumerate(zip(spot, second, strict=True)):
        held = covers.get(s, ())
        while held and t - second[held[0]] > WINDOW_HOURS * 3600:
            held.pop(0)
        if not held:
            for c in spots.covered(s):
                covers.setdefault(c, []).append(e)
            out.append(e)
        else:
            out.append(held[0])
    return out


def _regions(cells: pa.Table) -> pa.Table:
    """Connected regions of a type's occupied one-degree cells (at most 64,800): cells that may hold points within reach are linked."""
    at = list(zip(cells.column("__row").to_pylist(), cells.column("__col").to_pylist(), strict=True))
    number = {c: i for i, c in enumerate(at)}
    parent = list(range(len(at)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (row, col), i in number.items():
        cos = math.cos(math.radians(min(90.0, max(abs(row - 1), abs(row + 2)))))
        wide = min(180, 1 + math.ceil(RADIUS_WIDE_KM / (_KM_PER_DEGREE * cos))) if cos > 0.01 else 180
        for r in (row - 1, row, row + 1):
            for c in range(col - wide, col + wide + 1):
                j = number.get((r, (c + 180) % 360 - 180))
                if j is not None:
                    parent[root(i)] = root(j)
    return cells.append_column("__region", pa.array([root(i) for i in range(len(at))], pa.int32()))


def _norm(x: str) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(F.col(x), F.lit(""))), r"\s+", " "))


def leaders(detections: DataFrame) -> DataFrame:
    """Detections with leader_id, the first signal of the cluster that each joins; lga widens a cluster where there is one."""
    kind = detections.schema["signal_id"].dataType.simpleString()
    lga = _norm("lga") if "lga" in detections.columns else F.lit("")
    # rows without a place or a time cannot be placed
    placed = detections.filter("type is not null and lat is not null and lng is not null and published_at is not null")
    spot = dict(zip(_SPOT, (F.col("type"), F.col("lat"), F.col("lng"), _norm("location_name"), _norm("state"), lga), strict=True))
    seconds = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("published_at")) / 1e6
    placed = placed.withColumns({**spot, "__second": seconds})
    events = placed.groupBy(*_SPOT, "__second").agg(F.min("signal_id").alias("__id"))
    cell = {"__row": F.floor("__lat").cast("int"), "__col": F.pmod(F.floor(F.col("__lng") + 180), F.lit(360)).cast("int") - 180}
    events = events.withColumns({**cell, "__hour": F.floor(F.col("__second") / 3600).cast("long")})
    regions = events.select("__type", "__row", "__col").distinct().groupBy("__type").applyInArrow(_regions, "__type string, __row int, __col int, __region int")
    events = events.join(regions, ["__type", "__row", "__col"])
    in_time = Window.partitionBy("__type", "__region").orderBy("__hour")  # over distinct hours
    hours = events.select("__type", "__region", "__hour").distinct()
    hours = hours.withColumn("__gap", F.coalesce(F.col("__hour") - F.lag("__hour").over(in_time) > WINDOW_HOURS + 1, F.lit(False)).cast("int"))
    hours = hours.select("__type", "__region", "__hour", F.sum("__gap").over(in_time).alias("__part"))
    events = events.join(hours, ["__type", "__region", "__hour"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__second", "ascending"), ("__id", "ascending")])
        spots = table.select(_SPOT).group_by(list(_SPOT)).aggregate([])
        of = {s: i for i, s in enumerate(zip(*(spots.column(c).to_pylist() for c in _SPOT), strict=True))}
        codes = []
        for c in _SPOT[3:]:
            seen: dict[str, int] = {"": 0}
            codes.append(np.array([seen.setdefault(x, len(seen)) for x in spots.column(c).to_pylist()]))
        known = _Spots(spots.column("__type")[0].as_py(), spots.column("__lat").to_numpy(), spots.column("__lng").to_numpy(), codes)
        at = [of[s] for s in zip(*(table.column(c).to_pylist() for c in _SPOT), strict=True)]
        found = _lead(known, at, table.column("__second").to_pylist())
        return table.select([*_SPOT, "__second"]).append_column("leader_id", table.column("__id").take(pa.array(found, pa.int64())))

    schema = f"__type string, __lat double, __lng double, __place string, __state string, __lga string, __second double, leader_id {kind}"
    led = events.select(*_SPOT, "__second", "__id", "__region", "__part").groupBy("__type", "__region", "__part").applyInArrow(run, schema)
    return placed.join(led, [*_SPOT, "__second"]).select(*detections.columns, "leader_id")


def accounts(members: DataFrame, cluster: list[str], order: list[str], outlet: str = "outlet", tokens: str = "tokens", tenths: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Members (cluster, order, keep) with account, the number (from 1) of the account of the event that each repeats.

    A member joins the first account in which its outlet already is, or whose first member's tokens are alike. There are
    at most as many accounts as outlets; only those, and what each set of tokens is like, are kept while walking a cluster.
    """
    columns = [*cluster, *order, *keep]
    kinds = dict(members.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        reps: list[frozenset] = []
        first_of: dict[str, int] = {}  # outlet to the first account that it is in
        alike: dict[frozenset, tuple[int, int | None]] = {}  # tokens to accounts looked at, and the first that is like them
        out = []
        for o, t in zip(table.column("__outlet").to_pylist(), table.column("__tokens").to_pylist(), strict=True):
            t = frozenset(t or ())
            seen, like = alike.get(t, (0, None))
            if like is None:
                for i in range(seen, len(reps)):
                    both = len(t & reps[i])
                    if both and 10 * both >= tenths * (len(t) + len(reps[i]) - both):
                        like = i
                        break
                alike[t] = (len(reps), like)
            found = [i for i in (first_of.get(o), like) if i is not None]
            at = min(found, default=len(reps))
            if at == len(reps):
                reps.append(t)
            first_of[o] = min(at, first_of.get(o, at))
            out.append(at + 1)
        return table.select(columns).append_column("account", pa.array(out, pa.int64()))

    # columns that have two uses travel once each
    rows = members.select(*dict.fromkeys(columns), F.col(outlet).alias("__outlet"), F.col(tokens).alias("__tokens"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", account bigint"
    return rows.groupBy(*cluster).applyInArrow(run, schema)


def confidence(effective: Column, severity: Column, hotspot: Column) -> Column:
    raw = 22 + 26 * F.log2(effective + 1) + F.when(severity > 0, 10).otherwise(0) + F.when(hotspot, 6).otherwise(0)
    return F.greatest(F.lit(5.0), F.least(F.lit(99.0), F.round(raw, 6))).cast("int")


def scores(grouped: DataFrame, cluster: list[str], now: Column) -> DataFrame:
    """Incidents of members with (account, outlet, published_at, severity, hotspot, signal_id) and what their first shows.

    Independent sources are the outlets of the accounts' first members; recent accounts weigh more; a lone source stays low.
    """
    weight = F.round(times.recency_weight(F.col("published_at"), now), 9)
    first = F.struct("published_at", "signal_id")
    per = grouped.groupBy(*cluster, "account").agg(
        F.min_by("outlet", first).alias("outlet"),
        F.max(weight).alias("weight"),
        F.max("severity").alias("severity"),
        F.max(F.col("hotspot").cast("int")).alias("hotspot"),
        F.min("published_at").alias("window_start"),
        F.max("published_at").alias("window_end"),
        F.collect_list("signal_id").alias("ids"),
        F.min(F.struct("published_at", "signal_id", *SHOWN)).alias("lead"),
    )
    out = per.groupBy(*cluster).agg(
        F.size(F.collect_set("outlet")).cast("long").alias("source_count"),
        F.sum("weight").alias("mass"),
        F.max("severity").alias("severity"),
        (F.max("hotspot") > 0).alias("hotspot"),
        F.min("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
        F.sort_array(F.flatten(F.collect_list("ids"))).alias("signal_ids"),
        F.min("lead").alias("lead"),
    )
    eff = F.least(F.round("mass", 6), F.col("source_count").cast("double"))
    out = out.withColumn("raw", confidence(eff, F.col("severity"), F.col("hotspot")))
    many = F.col("source_count") >= 2
    status = F.when(many & ((F.col("severity") > 0) | (F.col("raw") >= 65)), "needs_human_review").when(many, "corroborated").otherwise("candidate_unverified")
    return out.withColumn("status", status).withColumn("confidence", F.when(many, F.col("raw")).otherwise(F.least(F.lit(45), F.col("raw")))).select("*", *(F.col(f"lead.{c}").alias(c) for c in SHOWN)).drop("mass", "raw", "lead")


def incidents(detections: DataFrame, now: Column) -> DataFrame:
    """Detections to scored incidents; one row per cluster, led by its first detection."""
    placed = leaders(detections).withColumn("outlet", text.outlet(F.col("source_name"))).withColumn("tokens", text.tokens(F.col("title")))
    kept = ("outlet", "severity", "hotspot", *SHOWN)
    return scores(accounts(placed, ["leader_id"], ["published_at", "signal_id"], keep=kept), ["leader_id"], now).withColumnRenamed("title", "summary")

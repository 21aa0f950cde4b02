"""Geo joins. Radius and corridor joins are equi-joins on grid cells with an exact test after, never theta joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.schemas import CORRIDOR_KM, GRID_N, RISK_KM, STATUS_SCORE, lookup

#: A little below the true length, so that boxes are a little too large.
_KM_PER_DEGREE = 111.0


def _reach_deg(km: Column | float, lat: Column) -> Column:
    """Degrees of longitude within which all points km away from a latitude lie; 180 near a pole."""
    km = km if isinstance(km, Column) else F.lit(float(km))
    sine, cos = F.sin(F.radians(km * 1.001 / _KM_PER_DEGREE)), F.cos(F.radians(lat))
    return F.when(cos > sine * 1.001, F.degrees(F.asin(sine / cos))).otherwise(F.lit(180.0))


def radius_join(left: DataFrame, right: DataFrame, km: float, lat1: str = "lat", lng1: str = "lng", lat2: str = "r_lat", lng2: str = "r_lng") -> DataFrame:
    """Pairs within km, with `distance_km` to 4 places, at any latitude and over the date line.

    Rows of cells are as high as the radius; a row's cells are as wide as the radius at its widest, so a left point lies
    in about nine. Longitudes are taken from -180 to 180.
    """
    high = km * 1.001 / _KM_PER_DEGREE
    row = lambda c: F.floor(F.col(c) / high).cast("int")
    edge = F.greatest(F.abs(F.col("__r") * high), F.abs((F.col("__r") + 1) * high))
    wide = F.least(F.lit(60.0), high / F.cos(F.radians(F.least(edge, F.lit(89.0)))))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    reach = _reach_deg(km, F.col(lat1))
    spread = left.withColumn("__r", F.explode(F.transform(around, lambda d: row(lat1) + d)))
    # a wide reach takes the whole row once; a narrow one also what it meets over the date line
    spread = spread.withColumn("__turn", F.explode(F.when(reach >= 120, F.array(F.lit(0.0))).otherwise(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)))))
    west, east = F.when(reach >= 120, F.lit(-180.0)).otherwise(F.col(lng1) + F.col("__turn") - reach), F.when(reach >= 120, F.lit(180.0)).otherwise(F.col(lng1) + F.col("__turn") + reach)
    spread = spread.withColumn("__w", F.greatest(F.lit(-180.0), west)).withColumn("__e", F.least(F.lit(180.0), east)).filter("__w <= __e")
    spread = spread.withColumn("__c", F.explode(F.sequence(F.floor(F.col("__w") / wide).cast("int"), F.floor(F.col("__e") / wide).cast("int")))).drop("__w", "__e", "__turn")
    held = right.withColumn("__r", row(lat2)).withColumn("__c", F.floor(F.col(lng2) / wide).cast("int"))
    joined = spread.join(held, ["__r", "__c"])
    distance = F.round(geo.haversine_km(F.col(lat1), F.col(lng1), F.col(lat2), F.col(lng2)), 4)
    return joined.withColumn("distance_km", distance).filter(F.col("distance_km") <= km).drop("__r", "__c")


def segments(routes: DataFrame, key: str, n: int) -> DataFrame:
    """Legs of routes (key, a_lat, a_lng, b_lat, b_lng) between n waypoints: (key, segment, p_lat, p_lng, q_lat, q_lng)."""
    points = geo.waypoints(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"), n)
    legs = routes.withColumn("__p", points).select(key, F.posexplode(F.arrays_zip(F.slice("__p", 1, n - 1).alias("p"), F.slice("__p", 2, n - 1).alias("q"))).alias("segment", "z"))
    return legs.select(key, F.col("segment").cast("long").alias("segment"), F.col("z.p.lat").alias("p_lat"), F.col("z.p.lng").alias("p_lng"), F.col("z.q.lat").alias("q_lat"), F.col("z.q.lng").alias("q_lng"))


def corridor_join(legs: DataFrame, points: DataFrame, km: float = CORRIDOR_KM) -> DataFrame:
    """Points (lat, lng, ...) within km of each leg. A leg is laid over all cells of its box widened by km."""
    side = 2.0
    low = lambda a, b, pad: F.floor((F.least(F.col(a), F.col(b)) - pad) / side).cast("int")
    high = lambda a, b, pad: F.floor((F.greatest(F.col(a), F.col(b)) + pad) / side).cast("int")
    pad_lat = km / _KM_PER_DEGREE + 0.05
    pad_lng = pad_lat / F.cos(F.radians(F.least(F.lit(80.0), F.greatest(F.abs("p_lat"), F.abs("q_lat")) + pad_lat)))
    laid = legs.withColumn("__r", F.explode(F.sequence(low("p_lat", "q_lat", pad_lat), high("p_lat", "q_lat", pad_lat)))).withColumn("__c", F.explode(F.sequence(low("p_lng", "q_lng", pad_lng), high("p_lng", "q_lng", pad_lng))))
    held = points.withColumn("__r", F.floor(F.col("lat") / side).cast("int")).withColumn("__c", F.floor(F.col("lng") / side).cast("int"))
    distance = F.round(geo.point_to_segment_km(*(F.col(c) for c in ("lat", "lng", "p_lat", "p_lng", "q_lat", "q_lng"))), 4)
    return laid.join(held, ["__r", "__c"]).withColumn("distance_km", distance).filter(F.col("distance_km") <= km).drop("__r", "__c")


def segment_risk(legs: DataFrame, near: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Per leg: incidents near it, worst score and level; legs without any are GREEN."""
    worst = near.groupBy(key, "segment").agg(F.count("*").alias("n_incidents"), F.max(lookup(STATUS_SCORE, F.col(status), 1)).alias("score"))
    out = legs.select(key, "segment").join(worst, [key, "segment"], "left")
    out = out.select(key, "segment", F.coalesce("n_incidents", F.lit(0)).cast("long").alias("n_incidents"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))
    return out.withColumn("level", geo.public_level(F.col("score")))


def corridor_union(near: DataFrame, key: str, incident: str) -> DataFrame:
    """Each incident of a corridor once, at the leg nearest to it."""
    return near.groupBy(key, incident).agg(F.min("distance_km").alias("distance_km"), F.min_by("segment", F.struct("distance_km", "segment")).alias("segment"))


def risk_near(points: DataFrame, incidents: DataFrame, key: str, km: float = RISK_KM) -> DataFrame:
    """Per point: incidents within km, worst score and level. Points without any are GREEN."""
    near = radius_join(points, incidents.withColumnsRenamed({"lat": "r_lat", "lng": "r_lng"}), km)
    worst = near.groupBy(key).agg(F.count("*").alias("n_incidents"), F.max(lookup(STATUS_SCORE, F.col("status"), 1)).alias("score"))
    out = points.select(key).join(worst, key, "left").select(key, F.coalesce("n_incidents", F.lit(0)).cast("long").alias("n_incidents"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))
    return out.withColumn("level", geo.public_level(F.col("score")))


def overlap_cells(rings: DataFrame, case: str) -> DataFrame:
    """Cells of a lattice over each case's rings (case, lat, lng, radius_km) with the number of rings that cover them.

    Partitions are dealt by case and sorted; a walk over them keeps one lattice of counts, whatever a case's rings are, and
    lays each ring over the lattice lines of its own box with numpy.
    """
    kind = rings.schema[case].dataType.simpleString()
    rings = rings.filter("lat is not null and lng is not null and radius_km is not null")
    cos = F.cos(F.radians("lat"))
    pad_lng = F.when(F.abs(cos) > 1e-9, F.col("radius_km") / (111.0 * cos)).otherwise(F.lit(180.0))
    box = rings.groupBy(case).agg(F.min(F.col("lat") - F.col("radius_km") / 111.0).alias("s"), F.max(F.col("lat") + F.col("radius_km") / 111.0).alias("n"), F.min(F.col("lng") - pad_lng).alias("w"), F.max(F.col("lng") + pad_lng).alias("e"))
    on = rings.select(F.col(case).alias("k"), "lat", "lng", "radius_km", _reach_deg(F.col("radius_km"), F.col("lat")).alias("reach")).join(box.withColumnRenamed(case, "k"), "k")

    def lines(low: float, high: float, middle: float, reach: float) -> slice:
        step = (high - low) / GRID_N
        if step <= 0:
            return slice(0, GRID_N + 1)
        return slice(max(0, math.floor((middle - reach - low) / step)), min(GRID_N, math.ceil((middle + reach - low) / step)) + 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts, at = None, np.zeros((GRID_N + 1, GRID_N + 1), np.int64), (np.zeros(0), np.zeros(0))

        def out() -> pa.RecordBatch:
            i, j = np.nonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array([key] * len(i), kinds), pa.array((i * (GRID_N + 1) + j).astype(np.int32)), pa.array(at[0][i]), pa.array(at[1][j]), pa.array(counts[i, j])], names=["k", "cell", "c_lat", "c_lng", "ring_count"])

        for batch in batches:
            kinds = batch.schema.field("k").type
            for k, lat, lng, km, reach, s, n, w, e in zip(*(batch.column(c).to_pylist() for c in ("k", "lat", "lng", "radius_km", "reach", "s", "n", "w", "e")), strict=True):
                if k != key:
                    if counts.any():
                        yield out()
                    steps = np.arange(GRID_N + 1)
                    key, counts, at = k, np.zeros_like(counts), (s + (n - s) * steps / GRID_N, w + (e - w) * steps / GRID_N)
                rows, cols = lines(s, n, lat, km * 1.001 / _KM_PER_DEGREE), lines(w, e, lng, reach)
                a, b = np.radians(at[0][rows])[:, None], math.radians(lat)
                h = np.sin((b - a) / 2) ** 2 + np.cos(a) * math.cos(b) * np.sin(np.radians(lng - at[1][cols]) / 2)[None, :] ** 2
                counts[rows, cols] += np.round(2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h))), 4) <= km
        if counts.any():
            yield out()

    rows = on.repartition("k").sortWithinPartitions("k").mapInArrow(walk, f"k {kind}, cell int, c_lat double, c_lng double, ring_count bigint")
    return rows.withColumnRenamed("k", case)


def zones(rings: DataFrame, case: str) -> DataFrame:
    """Search zones per case and number of agreeing rings: centre, radius, confidence, rank, and whether it has priority."""
    from pyspark.sql import Window

    cells = overlap_cells(rings, case)
    middle = cells.groupBy(case, "ring_count").agg(F.round(F.avg("c_lat"), 6).alias("z_lat"), F.round(F.avg("c_lng"), 6).alias("z_lng"))
    spread = F.max(F.round(geo.haversine_km(F.col("z_lat"), F.col("z_lng"), F.col("c_lat"), F.col("c_lng")), 4))
    sized = cells.join(middle, [case, "ring_count"]).groupBy(case, "ring_count", "z_lat", "z_lng").agg(F.greatest(F.lit(2.0), spread).alias("exact"))
    total = rings.groupBy(case).agg(F.count("*").alias("total"))
    out = sized.join(total, case).withColumn("radius_km", F.round("exact", 1)).withColumn("confidence", geo.zone_confidence(F.col("ring_count"), F.col("total"), F.col("exact")))
    w = Window.partitionBy(case)
    out = out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("confidence"), "radius_km", F.desc("ring_count"))).cast("long"))
    return out.withColumn("priority", F.col("ring_count") == F.max("ring_count").over(w)).drop("exact")



"""Ordered folds: state that feeds back on itself, per key, in event order.

A key's rows become one sorted array and `aggregate` walks it, so a fold needs one shuffle on the key and no Python.
Keys are users, cases and tasks; an array is as long as one key's history, and the state that is carried has a fixed size.
What gives a row for each row (`hash_chain`) walks sorted partitions in Python instead and holds one row. Order is by
(order columns) and must be total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.schemas import REP_GAIN, REP_LOSS, REP_START, literal_map


def history(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row per key with `events`, its rows as structs in order."""
    names = list(dict.fromkeys([*order, *fields]))
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("events"))


def fold(df: DataFrame, keys: list[str], order: list[str], fields: list[str], start: Column, step: Callable[[Column, Column], Column], name: str = "state") -> DataFrame:
    return history(df, keys, order, fields).withColumn(name, F.aggregate("events", start, step)).drop("events")


def reputation(df: DataFrame, key: str, order: list[str], outcome: str) -> DataFrame:
    """Counters and score per reporter: a gain for verified, a loss for dismissed, clamped after each step."""

    def step(acc: Column, e: Column) -> Column:
        up, down = e[outcome] == "verified", e[outcome] == "dismissed"
        score = F.when(up, F.least(F.lit(100.0), acc["score"] + REP_GAIN)).when(down, F.greatest(F.lit(0.0), acc["score"] - REP_LOSS)).otherwise(acc["score"])
        return F.struct(
            (acc["reports"] + 1).alias("reports"),
            (acc["verified"] + F.when(up, 1).otherwise(0)).cast("long").alias("verified"),
            (acc["dismissed"] + F.when(down, 1).otherwise(0)).cast("long").alias("dismissed"),
            F.round(score, 3).alias("score"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("reports"), zero.alias("verified"), zero.alias("dismissed"), F.lit(REP_START).alias("score"))
    return fold(df, [key], order, [outcome], start, step, "stat").select(key, "stat.*")


def state_machine(df: DataFrame, keys: list[str], order: list[str], event: str, machine: dict[str, str], initial: str) -> DataFrame:
    """Final state per key, with how many events were legal; an illegal event changes nothing."""
    moves = literal_map(machine)

    def step(acc: Column, e: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("|"), e[event]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["applied"] + F.when(to.isNotNull(), 1).otherwise(0)).alias("applied"), (acc["seen"] + 1).alias("seen"))

    start = F.struct(F.lit(initial).alias("state"), F.lit(0).alias("applied"), F.lit(0).alias("seen"))
    return fold(df, keys, order, [event], start, step, "m").select(*keys, "m.state", F.col("m.applied").cast("long").alias("applied"), F.col("m.seen").cast("long").alias("seen"))


def token_bucket(df: DataFrame, key: str, second: str, order: list[str], per_minute: int) -> DataFrame:
    """Requests allowed and refused per key: a full bucket at first, refilled continuously, one token a request."""
    rate, full = per_minute / 60.0, float(per_minute)

    def step(acc: Column, e: Column) -> Column:
        tokens = F.least(F.lit(full), acc["tokens"] + F.coalesce(e[second] - acc["last"], F.lit(0)) * rate)
        tokens = F.round(tokens, 6)
        ok = tokens >= 1
        return F.struct(F.when(ok, tokens - 1).otherwise(tokens).alias("tokens"), e[second].alias("last"), (acc["allowed"] + ok.cast("int")).alias("allowed"), (acc["refused"] + (~ok).cast("int")).alias("refused"))

    start = F.struct(F.lit(full).alias("tokens"), F.lit(None).cast("long").alias("last"), F.lit(0).alias("allowed"), F.lit(0).alias("refused"))
    out = fold(df, [key], order, [second], start, step, "b")
    return out.select(key, F.col("b.allowed").cast("long").alias("allowed"), F.col("b.refused").cast("long").alias("refused"))


def throttle(df: DataFrame, keys: list[str], second: str, order: list[str], window: int = 60, most: int = 3) -> DataFrame:
    """Accepted and refused per key: at most `most` accepted within the window; refused ones do not count."""

    def step(acc: Column, e: Column) -> Column:
        recent = F.filter(acc["hits"], lambda t: t >= e[second] - window)
        ok = F.size(recent) < most
        return F.struct(F.when(ok, F.concat(recent, F.array(e[second]))).otherwise(recent).alias("hits"), (acc["accepted"] + ok.cast("int")).alias("accepted"), (acc["refused"] + (~ok).cast("int")).alias("refused"))

    start = F.struct(F.array().cast("array<bigint>").alias("hits"), F.lit(0).alias("accepted"), F.lit(0).alias("refused"))
    out = fold(df, keys, order, [second], start, step, "t")
    return out.select(*keys, F.col("t.accepted").cast("long").alias("accepted"), F.col("t.refused").cast("long").alias("refused"))


def hash_chain(df: DataFrame, keys: list[str], order: list[str], payload: str) -> DataFrame:
    """Rows with prev_hash and hash, each hash over the one before and the payload; one chain per key.

    Partitions are dealt by key and sorted; the walk keeps the last key and hash only, so a key may have any number of
    rows. A null payload has no hash, and the next row starts anew.
    """
    names = list(dict.fromkeys([*keys, *order, payload]))
    kinds = dict(df.dtypes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, ""
        for batch in batches:
            before, hashes = [], []
            for key, body in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(payload).to_pylist(), strict=True):
                if key != at:
                    at, last = key, ""
                before.append(last)
                hashes.append(None if body is None else hashlib.sha256((last + str(body)).encode()).hexdigest())
                last = hashes[-1] or ""
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=[*names, "prev_hash", "hash"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", prev_hash string, hash string"
    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)


def attempts(df: DataFrame, keys: list[str], order: list[str], good: str, most: int = 6) -> DataFrame:
    """One-time codes: an attempt counts before it is compared, a used code is spent, too many attempts lock it."""

    def step(acc: Column, e: Column) -> Column:
        open_ = ~acc["used"] & (acc["tries"] < most)
        return F.struct((acc["tries"] + open_.cast("int")).alias("tries"), (acc["used"] | (open_ & e[good])).alias("used"))

    start = F.struct(F.lit(0).alias("tries"), F.lit(False).alias("used"))
    return fold(df, keys, order, [good], start, step, "a").select(*keys, F.col("a.tries").cast("long").alias("tries"), F.col("a.used").alias("used"))


def two_person(df: DataFrame, keys: list[str], order: list[str], actor: str) -> DataFrame:
    """The first actor proposes; the first other actor confirms."""
    start = F.struct(F.lit(None).cast("string").alias("proposer"), F.lit(None).cast("string").alias("confirmer"))

    def step(acc: Column, e: Column) -> Column:
        who = e[actor].cast("string")
        second = F.when(acc["confirmer"].isNull() & acc["proposer"].isNotNull() & (who != acc["proposer"]), who).otherwise(acc["confirmer"])
        return F.struct(F.coalesce(acc["proposer"], who).alias("proposer"), second.alias("confirmer"))

    return fold(df, keys, order, [actor], start, step, "p").select(*keys, "p.proposer", "p.confirmer", F.col("p.confirmer").isNotNull().alias("approved"))

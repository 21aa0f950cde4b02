"""Signed envelopes: canonical text, HMAC, and the order of checks."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: str):
    """Pandas UDF: hex HMAC-SHA256 of a string column. Built-in functions have no keyed hash."""
    secret = key.encode()

    @F.pandas_udf("string")
    def run(message: pd.Series) -> pd.Series:
        return message.map(lambda m: None if m is None else hmac.new(secret, m.encode(), hashlib.sha256).hexdigest())

    return run


def canonical(beacon: Column, lat: Column, lng: Column, ts: Column, nonce: Column) -> Column:
    """v1|id|lat|lng|ts|nonce with coordinates to 5 places; NULL (so it fails closed) for empty ids or numbers that are none."""
    fixed = lambda v: F.regexp_replace(F.format_string("%.5f", v), r"^-(0\.0+)$", "$1")
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    b = F.trim(F.coalesce(beacon.cast("string"), F.lit("")))
    text = F.concat_ws("|", F.lit("v1"), b, fixed(lat), fixed(lng), ts.cast("long").cast("string"), F.trim(F.coalesce(nonce, F.lit(""))))
    return F.when((b != "") & good(lat) & good(lng) & ts.isNotNull(), text)


def verdict(message: Column, ts: Column, sig: Column, expected: Column, now: Column, replayed: Column, max_age: int = 120, future: int = 60) -> Column:
    """First reason for which an envelope fails, or ok: missing, time, signature, replay."""
    return (
        F.when(sig.isNull() | (sig == ""), "missing")
        .when(ts.isNull(), "bad_timestamp")
        .when(message.isNull(), "missing")
        .when(ts - now > future, "future")
        .when(now - ts > max_age, "stale")
        .when(F.lower(F.trim(sig)) != expected, "bad_signature")
        .when(replayed, "replay")
        .otherwise("ok")
    )


def rotating_id(keyed: Column, length: int = 16) -> Column:
    """First characters of a keyed hash of (id, epoch); length within 4 to 64."""
    return F.substring(keyed, 1, max(4, min(64, length)))

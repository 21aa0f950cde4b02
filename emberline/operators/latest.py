"""Tables as logs: latest-wins views, inserts, upserts, erasure, retention, and identity across recomputation."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. `order` is descending and total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def latest_values(df: DataFrame, keys: list[str], at: Column, columns: list[str]) -> DataFrame:
    """Of each column, its last value that is not null; partial, so it combines before the shuffle."""
    return df.groupBy(*keys).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))


def insert_if_absent(new: DataFrame, key: Column, order: list[Column], existing: DataFrame | None = None, name: str = "raw_hash") -> DataFrame:
    """Rows of new whose key is not in existing, the first of each key."""
    rows = latest(new.withColumn(name, key), [name], order)
    return rows.join(existing.select(name), name, "left_anti") if existing is not None else rows


def counters(runs: DataFrame, key: str, ok: str, fetched: str, at: str, error: str) -> DataFrame:
    """Counters that upserts accumulate, from the log of runs."""
    good = F.col(ok)
    return runs.groupBy(key).agg(
        F.count("*").alias("runs"),
        F.count_if(good).alias("ok_runs"),
        F.count_if(~good).alias("failed_runs"),
        F.sum(fetched).alias("fetched"),
        F.max(F.when(good, F.col(at))).alias("last_ok"),
        F.max_by(error, F.when(~good, F.col(at))).alias("last_error"),
    )


def replace_all(df: DataFrame, owner: str, batch: str) -> DataFrame:
    """Rows of each owner's last batch."""
    last = df.groupBy(owner).agg(F.max(batch).alias(batch))
    return df.join(last, [owner, batch])


def reconcile(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New generation with identities: uuid and version kept by key, version raised when the fingerprint changed.

    old: key, uuid, version, fingerprint; new: key, fresh_uuid, fingerprint.
    """
    o = old.select(*key, "uuid", "version", F.col("fingerprint").alias("old_fingerprint"))
    joined = new.join(o, key, "left")
    changed = F.when(F.col("uuid").isNull(), 1).when(F.col("fingerprint") != F.col("old_fingerprint"), F.col("version") + 1).otherwise(F.col("version"))
    return joined.select(*key, F.coalesce("uuid", "fresh_uuid").alias("uuid"), changed.cast("long").alias("version"), F.col("uuid").isNull().alias("is_new"))


class Policy(NamedTuple):
    """A retention policy: rows of a table older than so many days by a column, and meeting a further condition if given."""

    name: str
    table: str
    at: str
    days: int
    extra: str = "true"

    def due(self, now: str) -> Column:
        return (F.col(self.at) < F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {self.days} DAYS")) & F.expr(self.extra)


def retention(policies: list[Policy], load: Callable[[str], DataFrame | None], now: str) -> DataFrame:
    """Per policy its rows and those due. A policy whose table or column is absent has an error and deletes nothing; the others go on."""
    parts = []
    for p in policies:
        try:
            if (df := load(p.table)) is None:
                raise LookupError("no table")
            part = df.agg(F.count("*").alias("total"), F.coalesce(F.count_if(p.due(now)), F.lit(0)).alias("due")).select(F.lit(p.name).alias("policy"), "total", "due", F.lit("").alias("error"))
        except LookupError as e:
            part = _failed(p, str(e))
        except AnalysisException as e:
            part = _failed(p, str(e.getCondition()))
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _failed(p: Policy, why: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return SparkSession.active().range(1).select(F.lit(p.name).alias("policy"), zero.alias("total"), zero.alias("due"), F.lit(why).alias("error"))


def apply_retention(df: DataFrame, due: Column) -> DataFrame:
    """What stays; a row whose condition is unknown stays."""
    return df.filter(~F.coalesce(due, F.lit(False)))


def subjects(asked: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (address_hash, owner_token, user_id, phone_hash; any may be NULL) with user_id found by phone where it is not given.

    A number of several users names each of them; an unknown number names nobody.
    """
    known = users.select(F.col("user_id").alias("found"), F.col("phone_hash").alias("of")).filter("of is not null").distinct()
    rows = asked.join(known, (F.col("phone_hash") == F.col("of")) & F.col("user_id").isNull(), "left")
    return rows.withColumn("user_id", F.coalesce("user_id", "found")).drop("found", "of")


def erase(tables: dict[str, tuple[DataFrame, str, str]], asked: DataFrame) -> DataFrame:
    """Per table (rows, its column, the identifier of asked that it holds), rows of the subjects and rows that stay."""
    parts = []
    for name, (df, column, identifier) in tables.items():
        ids = asked.select(F.col(identifier).alias(column)).filter(F.col(column).isNotNull()).distinct().withColumn("__gone", F.lit(1))
        marked = df.join(ids, column, "left")
        parts.append(marked.agg(F.count("__gone").alias("erased"), F.count_if(F.col("__gone").isNull()).alias("kept")).select(F.lit(name).alias("table_name"), "erased", "kept"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify_chain(df: DataFrame, keys: list[str], order: list[str], payload: str) -> DataFrame:
    """Per chain its rows and the first whose hash does not follow from the stored hash before it, NULL if all do."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(""))
    bad = F.col("hash") != F.sha2(F.concat(before, F.col(payload)).cast("binary"), 256)
    return df.withColumn("__bad", bad).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(F.when(F.col("__bad"), F.col(order[-1]))).alias("first_broken"))

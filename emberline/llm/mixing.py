"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, here a ramp 1 + slope * (2t - 1) times its target; the
integral over the whole time is the target. The cumulative demand D(t) = target * ((1 - slope) t + slope t^2) is inverted
to give each document of the source, laid end to end in a fixed pseudo-random order, its training position. Documents
are then range-sorted by position.

A copy of a document is in the mix if training reaches its position within the time, and its words are those up to the end
of the demand; so what is taken follows from the positions.

A source may hold a third of all rows, so running sums are taken in two steps: per bucket of the order hash, then within
a bucket; no task gets a whole source. One row per source meets in one task to set targets: some 100 bytes each, spilled
beyond memory, so up to about a hundred million sources.

Defined results: null or empty text has no words; very long texts are counted whole; null source is a source of its own,
last; ties of the order hash (a repeated key) go by key and size, and equal rows are one document each; a document
without words takes nothing and has no position; an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
_COPIES = "array<struct<copy:int,words:bigint,position:double>>"


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))  # null sorts last


def targets(sizes: DataFrame, share: float, cap: float, weights: list[int], slopes: list[float]) -> DataFrame:
    """Targets of sources (sk, source_size) by filling up to a common level; one row per source.

    In order of cap / weight, a source is capped if the level that those before it leave is above its cap.
    """
    everyone = Window.partitionBy()
    ranked = Window.orderBy("sk")
    pick = lambda values, rank: F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(ranked) - 1)
    s = s.withColumn("weight", pick([float(w) for w in weights], F.col("rank"))).withColumn("slope", pick([float(b) for b in slopes], F.col("rank")))
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("at", F.col("most") / F.col("weight"))
    before = Window.orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everyone) - so_far("most")) / (F.sum("weight").over(everyone) - so_far("weight")))
    s = s.withColumn("capped", F.col("level") > F.col("at"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everyone)
    return s.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * level))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple = (5, 2, 1), slopes: tuple = (-0.5, 0.0, 0.5), seed: str = "mix") -> DataFrame:
    """Per document: size, source_size, target, taken words, first_position, and copies, an array of (copy, words, position)."""
    base = cut(
        docs.select(
            F.col(key).alias("id"),
            _source_key(source).alias("sk"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("order"),
        )
    ).withColumn("bucket", F.substring("order", 1, 3))
    buckets = base.groupBy("sk", "bucket").agg(F.sum("size").alias("n"))
    goals = targets(buckets.groupBy("sk").agg(F.sum("n").alias("source_size")), share, cap, list(weights), list(slopes))
    running = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n").join(goals.select("sk", "source_size", "target", "slope"), "sk")
    inside = Window.partitionBy("sk", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(offsets, ["sk", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # copies begin where earlier ones end; the demand is met when it reaches the target
    reached = F.floor("target")
    begin = lambda copy: copy * F.col("source_size") + F.col("start")

    def position(copy: Column) -> Column:
        demand, ramp = F.try_divide(begin(copy), F.col("target")), 1 - F.col("slope")
        return 2 * demand / (ramp + F.sqrt(ramp * ramp + 4 * F.col("slope") * demand))

    def words(copy: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), reached - begin(copy))).cast("long")

    last = F.coalesce(F.floor(F.try_divide(reached, F.col("source_size"))), F.lit(0)).cast("int")
    made = F.transform(F.sequence(F.lit(0), last), lambda c: F.struct(c.alias("copy"), words(c).alias("words"), position(c).alias("position")))
    copies = F.filter(F.when((F.col("target") > 0) & (F.col("size") > 0), made).otherwise(F.array().cast(_COPIES)), lambda c: (c["words"] > 0) & (c["position"] <= 1))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    out = placed.withColumn("copies", copies).withColumn("taken", taken).withColumn("first_position", F.get("copies", F.lit(0))["position"])
    return out.select(F.col("id").alias(key), F.when(F.col("sk") != "t", F.substring("sk", 2, 1 << 30)).alias(source), "size", "source_size", "target", "taken", "first_position", "copies")


def by_position(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents range-sorted by where training first reads them; those that it doesn't read come last."""
    at = F.coalesce("first_position", F.lit(2.0))
    return assigned.repartitionByRange(at, F.col(key)).sortWithinPartitions(at, key)


def training_order(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: one row per copy that training reads, range-sorted by position."""
    rows = assigned.select(*[c for c in assigned.columns if c != "copies"], F.explode("copies").alias("c"))
    rows = rows.select("*", "c.copy", "c.words", "c.position").drop("c")
    return rows.repartitionByRange(F.col("position"), F.col(key)).sortWithinPartitions("position", key, "copy")

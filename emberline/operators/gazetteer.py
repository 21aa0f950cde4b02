"""Place lookup by tiers: exact, alias, normalised, fuzzy, partial.

A dimension of places is small; each tier is an equi-join on an exploded key. Names alike by the ratio of matching blocks
share two letters in a row, and names within two edits share a string that is left when two letters of each are taken
away, so the fuzzy tiers join on those and lose no pair.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.text import AFFIXES, fold, loose_key, place_key

# fixed values: confidence of a tier
TIER_SCORE = {"exact": 1.0, "alias": 0.95, "normalised": 0.85, "fuzzy": 0.7, "partial": 0.55}
FUZZY_CUT = 0.82


def merge_places(parts: list[DataFrame], south: float = 3.0, north: float = 15.0, west: float = 2.0, east: float = 15.5) -> DataFrame:
    """Union of dimensions (name, lat, lng, state, kind, aliases): valid coordinates within the box, first by key."""
    out = None
    for order, p in enumerate(parts):
        p = p.withColumn("source_order", F.lit(order))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    out = out.withColumn("place_key", place_key(F.col("name"))).filter((F.col("place_key") != "") & F.col("lat").between(south, north) & F.col("lng").between(west, east))
    w = Window.partitionBy("place_key").orderBy("source_order", "name", "lat", "lng")
    return out.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def index(places: DataFrame) -> DataFrame:
    """(key, name, tier): canonical names before aliases."""
    exact = places.select(place_key(F.col("name")).alias("key"), "name", F.lit("exact").alias("tier"))
    alias = places.select("name", F.explode("aliases").alias("a")).select(place_key(F.col("a")).alias("key"), "name", F.lit("alias").alias("tier"))
    return exact.unionByName(alias).filter("key <> ''")


def _first(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def _scored(rows: DataFrame) -> DataFrame:
    score = F.lit(None).cast("double")
    for tier, value in TIER_SCORE.items():
        score = F.when(F.col("tier") == tier, value).otherwise(score)
    return rows.withColumn("score", score)


def candidates(queries: DataFrame, query: str, places: DataFrame, limit: int = 5, fuzzy: bool = True) -> DataFrame:
    """(query, position, name, tier, score): up to `limit` places of each query, best first; a miss is no row, never a guess.

    In order: the place whose name or alias is the query's key (exact only if typed as named, otherwise normalised); the
    one that the key without affixes names; names alike, the likest first; names that hold all words of the query, or of
    two words or more are held by it. A place counts at its best tier. A query of affixes alone names nothing.
    """
    idx = _first(index(places), ["key"], F.when(F.col("tier") == "exact", 0).otherwise(1), "name")
    names = places.select("name", place_key(F.col("name")).alias("nkey")).filter("nkey <> ''").distinct()
    asked = queries.select(query).distinct().withColumn("key", place_key(F.col(query))).withColumn("loose", loose_key(F.col(query)))
    asked = asked.filter((F.col("key") != "") & ((F.col("loose") != "") | ~F.col("key").isin(*AFFIXES)))
    out = lambda rows, tier, rank, first=F.lit(0.0), second=F.lit(0): rows.select(query, "name", tier.alias("tier"), F.lit(rank).alias("rank"), first.alias("first"), second.alias("second"))
    soft = F.when((F.col("tier") == "exact") & (fold(F.col(query)) != fold(F.col("name"))), "normalised").otherwise(F.col("tier"))
    parts = [out(asked.join(idx, "key"), soft, 0)]
    loose = names.select(loose_key(F.col("name")).alias("key"), "name").filter("key <> ''")
    loose = _first(idx.select("key", "name", F.lit(0).alias("o")).unionByName(loose.withColumn("o", F.lit(1))), ["key"], "o", "name")
    parts.append(out(asked.filter("loose <> ''").join(loose.withColumnRenamed("key", "loose"), "loose"), F.lit("normalised"), 1))
    if fuzzy:
        parts.append(out(alike(asked.select(query, "key"), names), F.lit("fuzzy"), 2, -F.col("ratio")))
    q, n = asked.withColumn("qw", F.array_distinct(F.split("key", " "))), names.withColumn("nw", F.array_distinct(F.split("nkey", " ")))
    meet = q.select(query, "qw", F.explode("qw").alias("w")).join(n.select("name", "nkey", "nw", F.explode("nw").alias("w")), "w").drop("w").distinct()
    within = (F.size(F.array_except("qw", "nw")) == 0) | ((F.size("nw") > 1) & (F.size(F.array_except("nw", "qw")) == 0))
    parts.append(out(meet.filter(within), F.lit("partial"), 3, -F.size(F.array_intersect("qw", "nw")).cast("double"), F.length("nkey")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = _first(rows, [query, "name"], "rank", "first", "second")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy("rank", "first", "second", "name")).cast("long"))
    return _scored(rows.filter(F.col("position") <= max(1, limit))).select(query, "position", "name", "tier", "score")


def resolve(queries: DataFrame, query: str, places: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(query, name, tier, score): the best candidate of each query."""
    return candidates(queries, query, places, 1, fuzzy).drop("position")


def resolve_cached(queries: DataFrame, query: str, places: DataFrame, cache: DataFrame) -> DataFrame:
    """ST20: as resolve, but what the cache (query, name, tier, score) knows, misses as NULL names too, is not looked up."""
    asked = queries.select(query).distinct()
    known = asked.join(cache, query).select(query, "name", "tier", "score")
    fresh = asked.join(known, query, "left_anti")
    return known.filter("name is not null").unionByName(resolve(fresh, query, places))


def _deletions(key: Column) -> Column:
    """What is left of a key when up to two letters are taken away."""
    one = lambda k: F.when(F.length(k) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(k))), lambda i: F.concat(F.substring(k, 1, i - 1), F.substring(k, i + 1, 1 << 20)))).otherwise(F.array().cast("array<string>"))
    once = one(key)
    return F.array_distinct(F.concat(F.array(key), once, F.flatten(F.transform(once, one))))


def fuzzy_levenshtein(queries: DataFrame, query: str, places: DataFrame) -> DataFrame:
    """Best name within two edits; an edit measure that SQL engines share."""
    q = queries.select(query).distinct().withColumn("key", place_key(F.col(query)))
    n = index(places).select(F.col("key").alias("nkey"), "name").distinct()
    meet = q.withColumn("left", F.explode(_deletions(F.col("key")))).join(n.withColumn("left", F.explode(_deletions(F.col("nkey")))), "left").drop("left").distinct()
    rows = meet.withColumn("distance", F.levenshtein("key", "nkey").cast("long")).filter("distance <= 2")
    return _first(rows, [query], "distance", "name").select(query, "name", "distance")


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def alike(asked: DataFrame, names: DataFrame, cut: float = FUZZY_CUT) -> DataFrame:
    """Rows of asked (.., key) with names (name, nkey) of a matching-blocks ratio of at least cut.

    With T letters in both, at most 0.18 T are unmatched, which break at most as many of the matched pairs of letters; so
    two different keys that are alike share such a pair, and their lengths are in proportion.
    """
    pairs = lambda k: F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(k) - 1)), lambda i: F.substring(k, i, 2)), F.array(F.concat(F.lit("="), k))))
    meet = asked.withColumn("two", F.explode(pairs(F.col("key")))).join(names.withColumn("two", F.explode(pairs(F.col("nkey")))), "two").drop("two").distinct()
    a, b = F.length("key"), F.length("nkey")
    near = meet.filter(2 * F.least(a, b) >= cut * (a + b))
    return near.withColumn("ratio", F.pandas_udf(_ratio, "double")("key", "nkey")).filter(F.col("ratio") >= cut)


def fuzzy_ratio(queries: DataFrame, query: str, places: DataFrame, cut: float = FUZZY_CUT) -> DataFrame:
    """Best name by matching-blocks ratio at or above cut."""
    q = queries.select(query).distinct().withColumn("key", place_key(F.col(query)))
    rows = alike(q, index(places).select("name", F.col("key").alias("nkey")).distinct(), cut)
    return _first(rows, [query], F.desc("ratio"), "name").select(query, "name", F.round("ratio", 6).alias("ratio"))


def coverage(places: DataFrame) -> DataFrame:
    """Counts by kind, by source and in all in one pass, with the distinct states of each, and whether the dimension is nationwide.

    Places without a kind are towns, those without a source are built in.
    """
    p = places.withColumn("kind", F.coalesce("kind", F.lit("town"))).withColumn("source", F.coalesce("source", F.lit("built-in")))
    g = p.groupingSets([[F.col("kind")], [F.col("source")], []], "kind", "source").agg(
        F.count("*").alias("n_places"), F.countDistinct("state").alias("n_states"), F.count_if(F.col("kind") == "lga").alias("lgas"), F.count_if(F.col("kind") == "ward").alias("wards"), F.grouping_id().alias("level")
    )
    return g.select("kind", "source", "n_places", "n_states", "level", ((F.col("lgas") >= 774) & (F.col("wards") >= 8000)).alias("nationwide"))


def build(rows: DataFrame, kind: str, source: str) -> DataFrame:
    """A dimension from administrative rows (name, state, lat, lng): one place for each key and state, with aliases made.

    Aliases are the name without hyphens and apostrophes, without affixes, and with the kind after it; never the name itself.
    """
    named = rows.withColumn("key", place_key(F.col("name"))).filter((F.col("key") != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    named = _first(named, ["key", "state"], "name", "lat", "lng")
    bare = F.trim(F.regexp_replace("name", "[-'’`]+", " "))
    made = F.array_distinct(F.array(bare, F.initcap(loose_key(F.col("name"))), F.concat_ws(" ", "name", F.lit(kind.upper()))))
    aliases = F.filter(made, lambda a: (a != "") & (a != F.col("name")))
    return named.select("name", "lat", "lng", "state", F.lit(kind).alias("kind"), F.lit(False).alias("hotspot"), aliases.alias("aliases"), F.lit(source).alias("source"))


def write_dimension(dimension: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each kind."""
    dimension.write.mode("overwrite").partitionBy("kind").json(folder)


def suggest(ranked: list[tuple[DataFrame, int]], name: str, most: int) -> DataFrame:
    """Ranked lists merged in order, first of each name by lower case."""
    out = None
    for df, order in ranked:
        part = df.withColumn("list_no", F.lit(order))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy(F.lower(F.col(name))).orderBy("list_no", "position")
    first = out.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first.orderBy("list_no", "position").limit(most)



"""Benchmark decontamination by winnowing, in built-in functions only.

Of each `span - k + 1` consecutive k-grams of a text the least hash is kept as a fingerprint, so any span of `span` words
that a document and a test item share has a common fingerprint. Fingerprints are joined, and each hit is extended: the
windows of `span` words around it are compared through the hashes of their two halves. Items of fewer than `span` words
are one window, looked up whole.

The fingerprints of the items are broadcast only if they are at most `broadcast_rows`. Beyond that a bit map of their
hashes is broadcast, of 2^26 bits whatever their number, and what it lets through is shuffled. Nothing but markers (one
row a document) and hits reaches the aggregation.

A fingerprint is picked by 32 bits of its hash, then by place, which any two texts do alike; it is compared by all 64.

Defined results: null or empty text has no words, is never hit, and an item without words has no window; very long texts
are taken whole, of up to 2^31 words; of equal least hashes the first is picked; repeated documents are reported each;
repeated items count once by item_id; null item_ids hit but are not listed; without documents the result is empty,
without items nothing is hit; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.ledger import let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Low bits for a word's place in its text, below as many bits of hash as are left in a positive long.
_PLACE = 31
K = 5
#: Bits of the map of test fingerprints: at most 2^20 rows of 64.
_MAP = 1 << 26


def item_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    t = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(w: Column, k: int) -> Column:
    rest = F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))
    return F.transform(rest, lambda first, i: F.xxhash64(first, *(F.get(w, i + j) for j in range(1, k)), F.lit(k)))


def _fingerprints(w: Column, span: int) -> Column:
    """Array of (place, print, around): around are the k-gram hashes from place - (span - k) to place + (span - k)."""
    width = span - K + 1

    def of(h: Column) -> Column:
        keyed = F.transform(h, lambda x, i: F.call_function("shiftleft", x.bitwiseAND(F.lit((1 << 63 - _PLACE) - 1)), F.lit(_PLACE)).bitwiseOR(i.cast("long")))

        def least(keys: Column) -> Column:
            starts = F.slice(keys, 1, F.greatest(F.size(keys) - (width - 1), F.lit(0)))
            return F.array_distinct(F.transform(starts, lambda x, i: F.least(x, *(F.get(keys, i + j) for j in range(1, width)))))

        place = lambda key: key.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
        reach = range(-(width - 1), width)
        return F.transform(let(keyed, least), lambda key: F.struct(place(key).alias("place"), F.get(h, place(key)).alias("print"), F.array(*(F.get(h, place(key) + d) for d in reach)).alias("around")))

    return let(_grams(w, K), of)


def _wholes(w: Column, lengths: list[int], span: int) -> Column:
    """As fingerprints: every window of each length."""
    none = F.array(*([F.lit(None).cast("long")] * (2 * (span - K) + 1)))
    return F.concat(*(F.transform(_grams(w, n), lambda h, i: F.struct(i.alias("place"), h.alias("print"), none.alias("around"))) for n in lengths))


def test_prints(items: DataFrame, item: str, text: str, span: int) -> DataFrame:
    """Fingerprints of test items: (item, len, print, iaround); len is the window's length."""
    w = items.select(F.col(item).cast("string").alias("item"), item_words(F.col(text)).alias("w")).filter(F.size("w") > 0).withColumn("n", F.size("w"))
    long_ = w.filter(F.col("n") >= span).select("item", F.lit(span).alias("len"), F.explode(_fingerprints(F.col("w"), span)).alias("f"))
    whole = F.lit(None).cast("long")
    for n in range(1, span):
        whole = F.when(F.col("n") == n, F.xxhash64(*(F.get(F.col("w"), F.lit(j)) for j in range(n)), F.lit(n))).otherwise(whole)
    none = F.array(*([F.lit(None).cast("long")] * (2 * (span - K) + 1)))
    short = w.filter(F.col("n") < span).select("item", F.col("n").alias("len"), whole.alias("print"), none.alias("iaround"))
    return long_.select("item", "len", "f.print", F.col("f.around").alias("iaround")).unionByName(short)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """Per document: n_words, n_hit (words in shared windows), spans (the hit word ranges, merged), items (sorted)."""
    tests = test_prints(items, item, item_text, span)
    stats = tests.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("len") < span, F.col("len"))).alias("short")).first()
    lengths = sorted(stats["short"])  # fewer than span
    small = stats["n"] <= broadcast_rows
    width = span - K + 1

    w = item_words(F.col(text))
    row = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1))  # tells rows of one key apart

    def prints(v: Column) -> Column:
        found = F.when(F.size(v) >= span, _fingerprints(v, span)).otherwise(F.array().cast("array<struct<place:int,print:bigint,around:array<bigint>>>"))
        marker = F.struct(F.lit(-1).alias("place"), F.xxhash64(F.lit("marker"), F.size(v)).alias("print"), F.lit(None).cast("array<bigint>").alias("around"))
        return F.struct(F.size(v).cast("long").alias("n"), F.concat(F.array(marker), found, *([_wholes(v, lengths, span)] if lengths else [])).alias("prints"))

    rows = docs.select(F.col(key).alias("key"), row.alias("row"), let(w, prints).alias("p")).select("key", "row", F.col("p.n").alias("n_words"), F.explode("p.prints").alias("f"))
    rows = rows.select("key", "row", "n_words", "f.place", "f.print", "f.around")
    if not small:
        word, bit = F.floor(F.pmod("print", F.lit(_MAP)) / 64), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("print", F.lit(64)).cast("int"))
        bits = tests.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
        rows = rows.withColumn("word", word).join(F.broadcast(bits), "word", "left").filter((F.col("place") < 0) | (F.col("bits").bitwiseAND(bit) != 0)).drop("word", "bits")
    joined = rows.join(F.broadcast(tests) if small else tests, "print", "left")
    starts = F.filter(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda o: F.coalesce((F.get("around", width - 1 - o) == F.get("iaround", width - 1 - o)) & (F.get("around", width - 1 - o + K) == F.get("iaround", width - 1 - o + K)), F.lit(False)),
    )
    ranges = F.when(F.col("place") < 0, F.array().cast("array<struct<s:int,e:int>>")).when(F.col("len") < span, F.array(F.struct(F.col("place").alias("s"), (F.col("place") + F.col("len")).alias("e")))).otherwise(
        F.transform(starts, lambda o: F.struct((F.col("place") - o).alias("s"), (F.col("place") - o + span).alias("e")))
    )
    hits = joined.filter((F.col("place") < 0) | F.col("len").isNotNull()).withColumn("ranges", ranges).filter((F.col("place") < 0) | (F.size("ranges") > 0))
    hits = hits.withColumn("ranges", F.when(F.col("place") >= 0, F.col("ranges"))).withColumn("item", F.when(F.col("place") >= 0, F.col("item")))
    # a marker may have met prints by chance: one row a document
    hits = hits.withColumn("one", F.when(F.col("place") < 0, 1).otherwise(0))
    per = hits.groupBy("key", "row", "n_words").agg(F.sum("one").alias("copies"), F.collect_set("item").alias("items"), F.collect_set("ranges").alias("ranges"))

    def merged(r: Column) -> Column:
        """Union of sorted ranges."""
        empty = F.array().cast("array<struct<s:int,e:int>>")
        joins = lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["e"] >= x["s"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(a, F.array(x)))
        return F.when(F.size(r) == 0, empty).otherwise(F.aggregate(r, empty, joins))

    per = per.withColumn("spans", merged(F.sort_array(F.array_distinct(F.flatten("ranges")))))
    per = per.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]).cast("long")))
    per = per.withColumn("row_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return per.select(F.col("key").alias(key), "row", "n_words", "n_hit", "spans", F.sort_array("items").alias("items"))

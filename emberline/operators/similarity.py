"""Set-similarity join, exact, by parts of the word space.

Equal sets are one class first, so copies cost nothing. Words are dealt to parts by hash. If two whole sets are alike,
both intersection and sizes are sums over the parts, so their words of one part at least are as alike; there they share
one of their rarest words. A part has 16 to 64 words of a set, so that a bit map of 128 bits tells most other sets apart
where they meet, and a set goes through the shuffle about once, whatever number of sets it meets. Larger sets have more
parts; a set is also dealt as the larger sets are that it may be alike. What is left is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.sources.shared import freed, stored

#: Words whose frequency orders all sets, at most; others count as rarer, by hash. Any order is exact.
WORDS = 1 << 18
#: Sets of a part in one task, about; beyond it the part's words are dealt to more tasks.
SETS = 1 << 18
#: Sets that have a word from which on its sets are dealt to tiles, and each two tiles meet in a task.
HOT = 1 << 17
#: Sets, by block of the verification, that are looked up by a list (some 32 bytes each); beyond it by a join.
LISTED = 1 << 21
#: Words and sets of a block of the verification, about.
BLOCK, BLOCK_SETS = 1 << 20, 512
#: Pairs tested at once.
AT_ONCE = 1 << 19


def classes(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """Rows with class_id, the least key with an equal set, and n_tokens."""
    marked = df.withColumn("__h", F.coalesce(F.sha2(F.array_join(F.sort_array(tokens), " ").cast("binary"), 256), F.lit("")))  # never null, so no filter evaluates it again
    least = marked.groupBy("__h").agg(F.min(key).alias("class_id"))
    return marked.join(least, "__h").drop("__h").withColumn("n_tokens", F.size(tokens).cast("long"))


def similar_classes(df: DataFrame, key: str, tokens: str, tenths: int = 6) -> DataFrame:
    """Pairs of classes (a < b) with both, either: set intersections and unions of those of at least tenths / 10.

    Words and whole sets are 64-bit hashes from here on.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    sets = stored(df.select(F.col(key).alias("k"), F.sort_array(F.transform(tokens, lambda w: F.xxhash64(w))).alias("t")), "sets")
    sets = sets.filter("size(t) > 0").withColumn("h", F.xxhash64("t"))
    reps = stored(sets.groupBy("h").agg(F.min("k").alias("class_id"), F.first(F.size("t")).alias("n")).filter("class_id is not null"), "classes")
    level = F.greatest(F.lit(0), F.floor(F.log2(F.col("n") / 16) / 2)).cast("int")
    many = {r.level: r["count"] for r in reps.groupBy(level.alias("level")).count().collect()}
    spread = {k: -(-(many.get(k, 0) + many.get(k - 1, 0)) // SETS) for k in range(20)}
    deal = _deal(*_order(sets), spread, tenths)
    freed(spark)
    pairs = stored(sets.select("h", "t").mapInArrow(deal, "unit bigint, row binary").groupBy("unit").applyInArrow(_meet(tenths), "a bigint, b bigint").distinct(), "pairs")
    freed(spark)
    # whole sets go to blocks of pairs, not to each pair; sets with the same least neighbour of neighbours are in one block, if not too many
    ways = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ways.groupBy(F.col("a").alias("h")).agg(F.min("b").alias("o")).select("h", F.least("h", "o").alias("label"))
    least = ways.join(least.withColumnRenamed("h", "b"), "b").groupBy(F.col("a").alias("h")).agg(F.min("label").alias("label"))
    least = stored(least.join(reps.select("h", "n"), "h"), "labels")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    sums = least.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("words"))
    tiles = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("words") / BLOCK))
    block = F.when(tiles > 1, F.xxhash64("label", F.pmod("h", tiles))).otherwise(F.pmod("label", F.lit(max(1, -(-total.words // BLOCK)))))
    blocks = stored(least.join(sums, "label").select("h", block.alias("block")), "blocks")
    freed(spark)
    pairs = pairs.join(blocks.select(F.col("h").alias("a"), F.col("block").alias("i")), "a").join(blocks.select(F.col("h").alias("b"), F.col("block").alias("j")), "b")
    need = pairs.select(F.col("i").alias("u"), F.col("j").alias("v"), F.explode(F.array("a", "b")).alias("h")).distinct()
    need = stored(need.join(reps.select("h", "class_id"), "h").select("u", "v", "h", "class_id"), "need")
    if need.count() <= LISTED:
        listed = need.toArrow().sort_by("h").combine_chunks()
        whole = sets.select("k", "h", "t").mapInArrow(_listed(listed), f"u bigint, v bigint, h bigint, class_id {kind}, t array<bigint>")
    else:
        whole = need.join(sets.select("h", F.col("k").alias("class_id"), "t"), ["h", "class_id"])
    found = pairs.groupBy("i", "j").cogroup(whole.groupBy("u", "v")).applyInArrow(_verify(tenths), f"x {kind}, y {kind}, both bigint, either bigint")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "both", "either")


def _order(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words in order of their hashes, their ranks by frequency from 1 on, and the tiles that each is dealt to."""
    counts = stored(sets.select("t").mapInArrow(_counted, "w bigint, df bigint").groupBy("w").agg(F.sum("df").alias("df")).filter("df > 1"), "counts")
    least, room = 62, WORDS
    for r in sorted(counts.groupBy(F.floor(F.log2("df")).cast("int").alias("power")).count().collect(), key=lambda r: -r.power):
        if (room := room - r["count"]) < 0:
            break
        least = r.power
    top = counts.filter(F.floor(F.log2("df")).cast("int") >= least).toArrow()
    words, df = top["w"].to_numpy().view(np.uint64), top["df"].to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, df))] = np.arange(1, len(words) + 1)
    by = np.argsort(words)
    return words[by], rank[by], np.minimum(-(-df[by] // HOT), 1023)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def summed(held):
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], names=["w", "df"])

    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy())
        size += len(held[-1])
        if size > 1 << 22:
            yield summed(held)
            held, size = [], 0
    if held:
        yield summed(held)


def _runs(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 ... for lens[0] places, then the same of the next."""
    return np.repeat(first - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())


def _cut(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(table.to_batches(max_chunksize=1 << 16), table.schema)


def _levels(n: np.ndarray) -> np.ndarray:
    """Sets of less than 64 words have one part, of less than 256 four, and so on up to 4 ** 8."""
    return sum((n >= 16 << 2 * k).astype(np.int64) for k in range(1, 9))


def _deal(words: np.ndarray, rank: np.ndarray, tiles: np.ndarray, spread: dict[int, int], tenths: int) -> Callable:
    """Rows of unit and row: hash of the set, two halves of its part's bit map, size of the set, size of the part with a bit for its
    own level, and of the rarest words 31 bits each with a bit for those that the smaller set of a pair needs."""

    def deal(batches):
        seen: set[int] = set()
        for batch in batches:
            new = [i for i, h in enumerate(batch.column("h").to_pylist()) if h not in seen and not seen.add(h)]
            batch = batch.take(pa.array(new, pa.int64()))
            h, t = batch.column("h").to_numpy(), batch.column("t")
            v, n = t.flatten().to_numpy().view(np.uint64), t.value_lengths().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(words, v), max(len(words) - 1, 0))
            known = words[at] == v if len(words) else np.zeros(len(v), bool)
            ranks = np.where(known, rank[at], 0) if len(words) else np.zeros(len(v), np.int64)
            split = np.where(known, tiles[at], 1) if len(words) else np.ones(len(v), np.int64)
            first, low, high = np.cumsum(n) - n, _levels(n), _levels(10 * n // tenths)
            for k in range(int(low.min(initial=9)), int(high.max(initial=-1)) + 1):
                if len(mine := np.flatnonzero((low <= k) & (k <= high))):
                    own = _runs(first[mine], n[mine])
                    yield _dealt(k, h[mine], n[mine], low[mine] == k, v[own], ranks[own], split[own], max(1, spread.get(k, 1)), tenths)

    return deal


def _dealt(k: int, h, n, at_home, v, ranks, split, subs: int, tenths: int) -> pa.RecordBatch:
    part = v & np.uint64(4**k - 1)
    group = np.repeat(np.arange(len(n)) << 2 * k, n) + part.astype(np.int64)
    by = np.lexsort(((ranks.astype(np.uint64) << np.uint64(32)) | (v >> np.uint64(32)), group))
    v, ranks, split, group = v[by], ranks[by], split[by], group[by]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    p = np.diff(starts, append=len(v))
    bit, half = np.uint64(1) << (v >> np.uint64(16) & np.uint64(63)), v >> np.uint64(22) & np.uint64(1)
    head = np.empty((len(p), 8), np.uint32)
    of = group[starts] >> 2 * k
    for i, x in enumerate((h[of], np.bitwise_xor.reduceat(bit * (half ^ np.uint64(1)), starts), np.bitwise_xor.reduceat(bit * half, starts))):
        head[:, 2 * i : 2 * i + 2] = x.view(np.uint32).reshape(-1, 2)
    head[:, 6], head[:, 7] = n[of], p << 1 | at_home[of]
    place = _runs(np.zeros(len(p), np.int64), p)
    longer, shorter = p + -(tenths * p) // 10 + 1, p + -(2 * tenths * p) // (10 + tenths) + 1
    kept = np.flatnonzero(place < np.repeat(longer, p))
    row = np.repeat(np.arange(len(p)), p)[kept]
    word = (v[kept] >> np.uint64(33) << np.uint64(1)).astype(np.uint32) | (place[kept] < shorter[row]).astype(np.uint32)
    sub, split = (word >> 1).astype(np.int64) % subs, split[kept]
    if (hot := np.flatnonzero(split > 1)).size:
        # a tile of the set for the word; it meets all tiles
        times = split[hot]
        a, b = np.repeat(h[of[row[hot]]].view(np.uint64).astype(np.uint64) % times.astype(np.uint64), times).astype(np.int64), _runs(np.zeros(len(hot), np.int64), times)
        tile = 1 << 39 | np.repeat(ranks[kept][hot], times) << 20 | np.minimum(a, b) << 10 | np.maximum(a, b)
        rest = np.flatnonzero(split == 1)
        row, word, sub = (np.concatenate((x[rest], y)) for x, y in ((row, np.repeat(row[hot], times)), (word, np.repeat(word[hot], times)), (sub, tile)))
    if subs > 1 or hot.size:
        by = np.lexsort((sub, row))
        row, word, sub = row[by], word[by], sub[by]
    begin = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(sub, prepend=-1) != 0))
    size = np.diff(begin, append=len(row))
    unit = k << 56 | (group[starts][row[begin]] & (4**k - 1)) << 40 | sub[begin]
    ends = np.cumsum(size + 8)
    flat = np.empty(int(ends[-1]), np.uint32)
    flat[(ends - size - 8)[:, None] + np.arange(8)] = head[row[begin]]
    flat[_runs(ends - size, size)] = word
    offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(unit), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return pa.RecordBatch.from_arrays([pa.array(unit), rows], names=["unit", "row"])


def _meet(tenths: int) -> Callable:
    """Pairs of sets that share one of their rarest words within a part and may be alike by their bit maps."""

    def meet(table):
        rows = table.column("row").combine_chunks()
        rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows
        ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
        flat = np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint32)
        first, size = (ends[:-1] - ends[0]) // 4, np.diff(ends) // 4
        head = flat[first[:, None] + np.arange(8)]
        h = np.ascontiguousarray(head[:, :2]).view(np.int64)[:, 0]
        h, one = np.unique(h, return_index=True)  # copies of other partitions
        head, first, size = head[one], first[one] + 8, size[one] - 8
        map_1, map_2 = (np.ascontiguousarray(head[:, i : i + 2]).view(np.uint64)[:, 0] for i in (2, 4))
        n, p, home = head[:, 6].astype(np.int64), head[:, 7].astype(np.int64) >> 1, (head[:, 7] & 1).astype(bool)
        # differing words are at most (10 - tenths) / (10 + tenths) of the words of both, and differing bits are no more
        weight = np.minimum((10 - tenths) * p, 30000).astype(np.uint16)
        far = np.uint16(10 + tenths)

        word = flat[_runs(first, size)] ^ np.uint32(1)  # those that the smaller set needs come first
        by = np.argsort(word, kind="stable")
        word, row = word[by], np.repeat(np.arange(len(h)), size)[by]
        begin = np.flatnonzero(np.diff((word >> 1).astype(np.int64), prepend=-1))
        many = np.diff(begin, append=len(word))
        small = np.add.reduceat((word & 1 == 0).astype(np.int64), begin)
        map_1, map_2, weights = map_1[row], map_2[row], weight[row]
        found, held = [np.empty(0, np.int64)], 0

        def take(left, right):
            nonlocal found, held
            a, b = row[left], row[right]
            ok = (a != b) & (p[a] <= p[b]) & (home[a] | home[b]) & (10 * np.minimum(n[a], n[b]) >= tenths * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            found.append(np.minimum(a, b) * len(h) + np.maximum(a, b))
            if (held := held + len(a)) > 4 * AT_ONCE:
                found, held = [np.unique(np.concatenate(found))], 0

        work = many * small
        few = np.flatnonzero((many > 1) & (small > 0) & (work <= 4096))
        lefts, times = _runs(begin[few], small[few]), np.repeat(many[few], small[few])
        starts = np.repeat(begin[few], small[few])
        cuts = np.flatnonzero(np.diff(np.cumsum(times) // AT_ONCE)) + 1
        for left, time, start in zip(np.split(lefts, cuts), np.split(times, cuts), np.split(starts, cuts)):
            right, left = _runs(start, time), np.repeat(left, time)
            ok = np.flatnonzero((np.bitwise_count(map_1[left] ^ map_1[right]) + np.bitwise_count(map_2[left] ^ map_2[right])).astype(np.uint16) * far <= weights[left] + weights[right])
            take(left[ok], right[ok])
        for g in np.flatnonzero((many > 1) & (small > 0) & (work > 4096)):
            s, m = begin[g], many[g]
            step = max(1, AT_ONCE // int(m))
            for lo in range(s, s + small[g], step):
                hi = min(lo + step, s + small[g])
                apart = np.bitwise_count(map_1[lo:hi, None] ^ map_1[None, s : s + m]) + np.bitwise_count(map_2[lo:hi, None] ^ map_2[None, s : s + m])
                left, right = np.nonzero(apart.astype(np.uint16) * far <= weights[lo:hi, None] + weights[None, s : s + m])
                take(left + lo, right + s)
        pairs = np.unique(np.concatenate(found))
        a, b = np.divmod(pairs, len(h))  # h is sorted
        return _cut(pa.table({"a": h[a], "b": h[b]}))

    return meet


def _listed(need: pa.Table) -> Callable:
    """The sets of classes, once for each block that needs them."""

    def run(batches):
        ends = need.column("h").to_numpy()
        for batch in batches:
            h = batch.column("h").to_numpy()
            first = np.searchsorted(ends, h)
            times = np.searchsorted(ends, h, "right") - first
            hits = np.flatnonzero(times)
            own = pc.equal(batch.column("k").take(pa.array(hits)), need.column("class_id").take(pa.array(first[hits])).combine_chunks())
            hits = hits[pc.fill_null(own, False).to_numpy(zero_copy_only=False).astype(bool)]
            rows, at = batch.take(pa.array(np.repeat(hits, times[hits]))), need.take(pa.array(_runs(first[hits], times[hits])))
            yield from pa.table({"u": at.column("u"), "v": at.column("v"), "h": rows.column("h"), "class_id": rows.column("k"), "t": rows.column("t")}).to_batches()

    return run


def _verify(tenths: int) -> Callable:
    """The pairs of a block of pairs, on whole sets."""

    def verify(pairs, sets):
        h = sets.column("h").to_numpy()
        by = np.argsort(h)
        a, b = (by[np.searchsorted(h[by], pairs.column(c).to_numpy())] for c in ("a", "b"))
        t = sets.column("t").combine_chunks()
        t = pa.concat_arrays(t.chunks) if isinstance(t, pa.ChunkedArray) else t
        words, ids = np.unique(t.flatten().to_numpy(), return_inverse=True)
        n = t.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(n) - n
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        both, marked = np.empty(len(a), np.int64), np.zeros(len(words), bool)
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        for lo, hi in zip(starts, np.append(starts[1:], len(a))):
            mine = ids[first[a[lo]] : first[a[lo]] + n[a[lo]]]
            marked[mine] = True
            other = n[b[lo:hi]]
            both[lo:hi] = np.add.reduceat(marked[ids[_runs(first[b[lo:hi]], other)]].astype(np.int64), np.cumsum(other) - other)
            marked[mine] = False
        either = n[a] + n[b] - both
        ok = np.flatnonzero(10 * both >= tenths * either)
        keys = sets.column("class_id").combine_chunks()
        return _cut(pa.table({"x": keys.take(pa.array(a[ok])), "y": keys.take(pa.array(b[ok])), "both": both[ok], "either": either[ok]}))

    return verify

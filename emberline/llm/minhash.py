"""Near-duplicates by MinHash, and their connected components.

1. Each text becomes its set of distinct word shingles, as 64-bit hashes; of each set 128 minima of universal hashes
   (a x + b, high bits) are taken, four to a band. Documents with equal sets are one from here on, under the least id.
2. Documents that share a band's minima meet in a bucket. Each is tied to the bucket's first document only, and the
   components of those ties are clusters: two documents that share any bucket are in one cluster.
3. Within clusters, signatures are compared, then the full sets. A pair whose documents are already connected by
   confirmed links is passed over, so a group gives no more links than it has documents, and no connection is lost.
   A cluster beyond one block is first compared with a few hubs of its own; then only the documents outside its largest
   component are compared, with each other and with that component, in pairs of blocks of bounded size.
4. The components of the confirmed links are the result.

A pair at the threshold is missed with a probability of about 5e-6 by the bands and 3e-6 by the signatures.

Texts are read twice: for signatures, and again for the sets of documents in clusters, told by a Bloom filter of 16 bits a
document (an exact join follows), or beyond MOST_BITS by a join. Sets are never kept for other documents.

What many rows may share (an equal set, a bucket, a component's centre) is found by partial aggregation, cut to a table,
and joined back; adaptive execution splits such a join where a third of all rows meet on one key.

Defined results: null or empty text has an empty set and is linked with nothing; a very long text is one set, whole; a null
key is linked with nothing and has no component; rows of one key with one text are one document with a row each, rows
of one key with several texts are linked through what any of them is like; of equal sets the least key stands for all;
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, mix, slices, text_buffer, words
from emberline.llm.components import HUB, connected_components

BANDS, ROWS = 32, 4
_rng = np.random.default_rng(17)
_A = _rng.integers(1, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
_PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: Most bits of the filter that tells documents of clusters on the second reading: 128 MB.
MOST_BITS = 1 << 30
#: Bytes of shingle sets in a block, the most that is compared within one group, and about that of small clusters together;
#: a document counts for ROW bytes besides its set, which bounds a block's rows.
BLOCK, BIN, ROW = 16 << 20, 1 << 20, 512
#: Rows that a row is first compared with in a block, before all that are not yet connected with it.
PROBES = 64
#: Documents of a cluster beyond one block that all others are compared with first.
HUBS = 16


def shingle_set(w: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of width words; of fewer words, one for the whole."""
    if not len(w):
        return np.zeros(0, np.uint64)
    if len(w) < width:
        return mix(np.array([(w * _PLACES[: len(w)]).sum() + np.uint64(len(w))], np.uint64))
    total = np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        total += w[k : len(w) - width + 1 + k] * _PLACES[k]
    return np.unique(mix(total))


def shingle_sets(part: pa.RecordBatch, text: str, width: int) -> Iterator[np.ndarray]:
    hashes, starts = words(*text_buffer(part.column(text)))
    for i in range(part.num_rows):
        yield shingle_set(hashes[starts[i] : starts[i + 1]], width)


def minima(s: np.ndarray) -> np.ndarray:
    """High halves of the minima of all universal hashes."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(low, (_A * s[at : at + 4096] + _B).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sketch(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, k1, k2, bands): k1 and k2 tell sets apart; bands are bucket numbers."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        number = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            for part in slices(batch, "text"):
                n, k1, k2, bands = [], [], [], []
                for s in shingle_sets(part, "text", width):
                    n.append(len(s))
                    k1.append(int(s.sum().view(np.int64)) if len(s) else 0)
                    k2.append(int(np.bitwise_xor.reduce(s * _PLACES[7] ^ (s >> np.uint64(29))).view(np.int64)) if len(s) else 0)
                    m = minima(s).reshape(BANDS, ROWS).astype(np.uint64)
                    bands.append(mix((m * _PLACES[8 : 8 + ROWS]).sum(1) + number).view(np.int64))
                flat = pa.array(np.concatenate(bands))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists], names=["id", "n", "k1", "k2", "bands"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _filter(ids: DataFrame, most: int) -> np.ndarray | None:
    """Bit map of hashed ids with 16 bits for each; None if that is more than most."""
    size = 1 << max(16, int(ids.count() * 16 - 1).bit_length())
    if size > most:
        return None
    bit = F.pmod(F.xxhash64("id"), F.lit(size))
    rows = ids.select(F.floor(bit / 64).cast("long").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bits"))
    rows = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _sets(docs: DataFrame, ids: DataFrame, width: int, most: int = MOST_BITS) -> DataFrame:
    """(id, sig, shingles) of at least the documents of ids; sig has a byte of each minimum."""
    kind = docs.schema["id"].dataType.simpleString()
    within = _filter(ids, most)
    if within is None:
        docs = docs.join(ids.distinct(), "id", "left_semi")
    size = 64 * len(within) if within is not None else 1

    def run(batches):
        for batch in batches:
            if within is not None:
                bit = batch.column("bit").to_numpy()
                batch = batch.filter(pa.array((within[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for part in slices(batch, "text"):
                ids, found = part.column("id"), list(shingle_sets(part, "text", width))
                sigs = [(minima(s) & 255).astype(np.uint8).tobytes() for s in found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "sig", "shingles"])

    return docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(size)).alias("bit")).mapInArrow(run, f"id {kind}, sig binary, shingles binary")


def connected(sigs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, known: list, percent: int) -> np.ndarray:
    """A number for each row, equal where known components and confirmed links of at least percent Jaccard connect rows.

    With two sides, only rows of different sides are compared; rows of the first come before those of the second.
    """
    first: dict = {}
    of = np.array([first.setdefault(c, i) for i, c in enumerate(known)])
    split = int(np.searchsorted(side, side[-1])) if side[0] != side[-1] else 0
    # 4.5 standard deviations below the threshold
    p = percent / 100
    least = sigs.shape[1] * p - 4.5 * (sigs.shape[1] * p * (1 - p)) ** 0.5
    sizes = np.array([len(x) for x in sets])
    rows, ends = np.arange(len(sets)), np.cumsum(sizes).tolist()
    # shingles as small numbers, and which of them row i has: an intersection is one look at the other set
    numbered = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    number = [numbered[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]
    has = np.zeros(int(numbered.max(initial=-1)) + 1, bool)

    def merge(i: int, among: np.ndarray) -> None:
        """Connect row i with those of the rows that it is like; the likeliest first, as each saves its component."""
        small, large = np.minimum(sizes[among], sizes[i]), np.maximum(sizes[among], sizes[i])
        open_ = among[(of[among] != of[i]) & (100 * small >= percent * large)]
        alike = (sigs[open_] == sigs[i]).sum(1)
        near = alike >= least
        open_ = open_[near][np.argsort(-alike[near], kind="stable")]
        while len(open_):
            j, open_ = open_[0], open_[1:]
            both = np.count_nonzero(has[number[j]])
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                of[of == of[j]] = of[i]
                open_ = open_[of[open_] != of[i]]

    probes = rows[:0]
    for i in range(max(1, split), len(sets)):
        till = split or i
        has[number[i]] = True
        if till > 2 * PROBES:  # rows of the first components, and a spread of all
            if not len(probes) or i % PROBES == 0:
                probes = np.unique(np.concatenate([np.unique(of[:till], return_index=True)[1][: PROBES // 2], np.linspace(0, till - 1, PROBES // 2).astype(int)]))
            merge(i, probes)
        merge(i, rows[:till][of[:till] != of[i]])
        has[number[i]] = False
    return of


def _links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) within each group of dealt rows (unit, i, j, id, cluster, side, known)."""
    kind = dealt.schema["id"].dataType.simpleString()

    def link(table: pa.Table) -> pa.Table:
        ids, known, side = table.column("id").to_pylist(), table.column("known").to_pylist(), table.column("side").to_pylist()
        sigs, raw = table.column("sig"), table.column("shingles")
        at: dict = {}
        for r, (c, x) in enumerate(zip(table.column("cluster").to_pylist(), ids, strict=True)):
            at.setdefault(c, {}).setdefault(x, r)  # one row for each id
        us, vs = [], []
        for members in at.values():
            rows = sorted(members.values(), key=lambda r: side[r])
            s = np.frombuffer(b"".join(sigs[r].as_py() for r in rows), np.uint8).reshape(len(rows), -1)
            sets_ = [np.frombuffer(raw[r].as_py(), np.uint64) for r in rows]
            # stars around the least id, of one row for each known component
            groups: dict = {}
            for r, c in zip(rows, connected(s, sets_, np.array([side[r] for r in rows]), [known[r] for r in rows], percent).tolist(), strict=True):
                groups.setdefault(c, {}).setdefault(known[r], ids[r])
            for joined in groups.values():
                if len(joined) > 1:
                    named = sorted(joined.values())
                    us.extend(named[1:]), vs.extend(named[:1] * (len(named) - 1))
        id_type = table.schema.field("id").type
        return pa.table([pa.array(us, id_type), pa.array(vs, id_type)], names=["u", "v"])

    return dealt.join(sets, "id").groupBy("unit", "i", "j").applyInArrow(link, f"u {kind}, v {kind}")


def _small(clusters: DataFrame, bins: int) -> DataFrame:
    """Clusters within a block, together in bins."""
    zero = F.lit(0)
    return clusters.select("id", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("unit"), zero.alias("i"), zero.alias("j"), zero.alias("side"), F.col("id").alias("known"))


def _with_hubs(large: DataFrame) -> DataFrame:
    """Each large cluster's blocks, all with the cluster's hubs: about HUBS documents picked by hash."""
    hub = F.pmod(F.xxhash64("id", F.lit(2)), F.col("docs")) < HUBS
    side = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
    spread = large.withColumn("hub", hub).withColumn("i", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(side))))
    return spread.select("id", "cluster", F.xxhash64("cluster").alias("unit"), "i", F.lit(0).alias("j"), F.when(F.col("hub"), 0).otherwise(1).alias("side"), F.col("id").alias("known"))


def _rest(large: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """What is left to compare in large clusters: documents outside the largest component, with each other and with it.

    Blocks of the rest are paired with each other (j below 0) and with blocks of the largest component.
    """
    known = large.join(labels, "id", "left").withColumn("known", F.coalesce("component", "id"))
    size = known.groupBy("cluster", "known").agg(F.sum("n").alias("size"))
    main = size.groupBy("cluster").agg(F.max_by("known", F.struct("size", "known")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("all"))
    count = lambda c: F.ceil(c / block).cast("int")
    k = known.join(main.select("cluster", "main", count(F.col("most")).alias("mains"), count(F.col("all") - F.col("most")).alias("rests")), "cluster").filter("rests > 0")
    inside = F.col("known") == F.col("main")
    at = F.pmod(F.xxhash64("id", F.lit(1)), F.when(inside, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    to = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    among = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.transform(among("rests"), lambda o: to(F.least(F.col("at"), o), -1 - F.greatest(F.col("at"), o), F.col("at")))
    cross = F.transform(among("mains"), lambda o: to(F.col("at"), o, F.lit(0)))
    from_main = F.transform(among("rests"), lambda o: to(o, F.col("at"), F.lit(1)))
    dealt = k.withColumn("at", at).withColumn("to", F.explode(F.when(inside, from_main).otherwise(F.concat(own, cross))))
    return dealt.select("id", "cluster", F.xxhash64("cluster").alias("unit"), "to.i", "to.j", "to.side", "known")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, block: int = BLOCK, most_bits: int = MOST_BITS, hub: int = HUB) -> DataFrame:
    """Per row: key, n_shingles, component_id and kept."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sketch = cut(_sketch(docs, width))
    alike = ["k1", "k2", "n"]
    groups = cut(sketch.filter("n > 0 and id is not null").groupBy(*alike).agg(F.min("id").alias("rep")))
    firsts = sketch.join(groups.withColumnRenamed("rep", "id"), ["id", *alike]).select("id", "n", "bands")
    tagged = cut(sketch.drop("bands").join(groups, alike, "left").select("id", "n", "rep"))

    held = firsts.select("id", F.explode("bands").alias("bucket"))
    leaders = cut(held.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    ties = held.join(leaders, "bucket").filter("id <> leader").select(F.col("id").alias("u"), F.col("leader").alias("v")).distinct()
    weights = tagged.filter("id = rep").groupBy("id").agg((F.max("n") * 8 + ROW).alias("n"))
    clusters = cut(connected_components(ties, hub).withColumnRenamed("component", "cluster").join(weights, "id"))

    sizes = clusters.groupBy("cluster").agg(F.sum("n").alias("bytes"), F.count("*").alias("docs"))
    fits = F.col("bytes") <= block
    small, many = sizes.agg(F.coalesce(F.sum(F.when(fits, F.col("bytes"))), F.lit(0)), F.count_if(~fits)).first()
    sized = clusters.join(sizes, "cluster")
    sets = _sets(docs, clusters.select("id"), width, most_bits)
    dealt = _small(sized.filter(fits), int(small // min(block, BIN) + 1))
    before = None
    if many:
        large = sized.filter(~fits).withColumn("parts", F.ceil(F.col("bytes") / block).cast("int"))
        before = cut(_links(_with_hubs(large), _sets(docs, large.select("id"), width, most_bits), percent))
        dealt = dealt.unionByName(_rest(large, connected_components(before, hub), block))
    links = _links(dealt, sets, percent)
    found = cut(connected_components(links if before is None else links.unionByName(before), hub).withColumnRenamed("id", "rep"))
    # rows without a set or a key meet nothing, and so no join, where they would share one key
    alone = tagged.filter("rep is null").withColumn("component", F.lit(None).cast(found.schema["component"].dataType))
    out = tagged.filter("rep is not null").join(found, "rep", "left").unionByName(alone)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept")).withColumn("kept", F.coalesce("kept", F.lit(True)))

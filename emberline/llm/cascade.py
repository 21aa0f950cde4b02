"""URL filters by a Bloom filter cascade.

Level 0 holds the listed keys; level 1 the keys of the corpus that level 0 lets through though they are not listed;
level 2 the listed keys that level 1 lets through; and so on until a level lets nothing wrong through. For every key of
the corpus the number of levels passed then tells membership exactly, with no join and no list at query time. A key is a
host followed by a path prefix; a URL's keys are each suffix of its host at a dot, with the prefixes of its path that are
as long as some listed path. The key universe is complete: each key of each URL of the corpus is tried while building.

The filters are all that is broadcast. A level takes `bits_per_key` bits a key, and building stops with an error when a
level would pass max_bits, so their size has a bound that does not depend on the corpus.

Defined results: a null or empty url, or one without "://", has empty host and path and no rule; very long urls are read
whole, and have a key for each dot of the host and each length of a listed path; of rules as long, that with the longer
host wins, and of equal rules the verdict that sorts first; repeated rows are judged each; an empty table gives an empty
result; an empty rule list lets everything through with the default verdict; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import cut

_UPPER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def url_keys(host: str, path: str, lengths: Iterable[int]) -> Iterator[str]:
    """The keys of a URL, longest first; of two as long, that with the longer host."""
    suffixes = [host] + [host[i + 1 :] for i, c in enumerate(host) if c == "."]
    keys = [(len(h) + n, len(h), h + path[:n]) for h in suffixes if h for n in lengths if n <= len(path)]
    return (k for _, _, k in sorted(keys, reverse=True))


@dataclass
class Bloom:
    words: np.ndarray
    hashes: int
    seed: int

    def places(self, key: str) -> list[int]:
        raw = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.seed)
        a, b, m = raw & 0xFFFFFFFFFFFFFFFF, raw >> 64 | 1, len(self.words) * 64
        return [(a + i * b) % m for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in self.places(key))


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        passed = 0
        for level in self.levels:
            if key not in level:
                break
            passed += 1
        return passed % 2 == 1


def _filter_of(keys: DataFrame, n: int, bits_per_key: int, hashes: int, seed: int, max_bits: int) -> Bloom:
    """A Bloom filter of the n keys; partial bit maps are joined by bitwise or before they reach the driver."""
    size = max(1, -(-n * bits_per_key // 64))
    if size * 64 > max_bits:
        raise ValueError(f"{n} keys need {size * 64} bits; max_bits is {max_bits}")
    shape = Bloom(np.zeros(size, np.int8), hashes, seed)

    def places(batches):
        for batch in batches:
            bits = np.unique(np.array([p for k in batch.column(0).to_pylist() for p in shape.places(k)], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    words = np.zeros(size, np.uint64)
    for row in keys.mapInArrow(places, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[row["word"]] = row["bits"] % 2**64
    return Bloom(words, hashes, seed)


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    def test(batches):
        for batch in batches:
            yield batch.filter(pa.array([k in level for k in batch.column(0).to_pylist()], pa.bool_()))

    return keys.mapInArrow(test, "key string")


def build(listed: DataFrame, urls: DataFrame, url: str, lengths: list[int], bits_per_key: int = 12, hashes: int = 6, max_bits: int = 1 << 30) -> Cascade:
    """A cascade that is exact for the keys of all urls. listed: one column, key, without repeats."""
    cascade, inside = Cascade(), listed
    n = inside.count()
    if not n:
        return cascade
    cascade.levels.append(_filter_of(inside, n, bits_per_key, hashes, 0, max_bits))
    first = cascade.levels[0]

    def tried(batches):
        for batch in batches:
            found = {k for u in batch.column(0).to_pylist() for k in url_keys(*host_and_path(u), lengths) if k in first}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    # keys that level 0 stops are settled; only the false positives are gathered
    outside = cut(urls.select(url).mapInArrow(tried, "key string").distinct().join(listed, "key", "left_anti"))
    while n := outside.count():
        cascade.levels.append(_filter_of(outside, n, bits_per_key, hashes, len(cascade.levels), max_bits))
        inside, outside = outside, cut(_passing(inside, cascade.levels[-1]))
    return cascade


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per page: host, path, the longest fitting rule, and its verdict or the default.

    rules: (verdict, host, path). One cascade for each verdict; a page's first key that is in one of them is its rule.
    """
    spark = SparkSession.getActiveSession() or pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    by_verdict = {}
    for verdict in sorted({v for v, _, _ in rules}):
        listed = spark.createDataFrame([(k,) for k in sorted({h + p for v, h, p in rules if v == verdict})], "key string")
        by_verdict[verdict] = build(listed, pages, url, lengths)
    kind = pages.schema[key].dataType.simpleString()

    def rule_of(host: str, path: str) -> tuple[str | None, str]:
        for k in url_keys(host, path, lengths):
            for verdict, cascade in by_verdict.items():
                if k in cascade:
                    return k, verdict
        return None, default

    def look(batches):
        for batch in batches:
            hosts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            found = [rule_of(h, p) for h, p in hosts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.string()) for c in (zip(*((h, p, r, v) for (h, p), (r, v) in zip(hosts, found, strict=True)), strict=True) if hosts else ((), (), (), ())))], names=[key, "host", "path", "rule", "verdict"])

    return pages.select(key, url).mapInArrow(look, f"`{key}` {kind}, host string, path string, rule string, verdict string")

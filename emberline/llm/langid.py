"""Language identification by inference of a mixture of languages.

Training counts, per language, the letter trigrams of all training documents (lower-cased, with a mark at word ends),
hashed to a fixed number of buckets, so the model has languages x buckets numbers whatever the corpus. A document is a
mixture: expectation-maximisation over its trigrams estimates the share of each language, and the set of languages is
that with the best likelihood less a penalty for each further language. The prediction is the language with the largest
share; its score is the share, or for one language its posterior among single languages.

Defined results: null or empty text, text without letters and an empty training set give `und` with score 0; very long
texts are read whole, in pieces cut between words; a null key counts as the empty string in the split; null lang is never
learned; ties go to the language that sorts first; repeated rows are predicted each; an empty table gives an empty result;
other columns are not read, and those of `keep` come back under their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import mix, slices
from emberline.llm.tokencount import decoded

BUCKETS = 1 << 15
_SMOOTH = 0.1
#: Overlapping trigrams are worth about a third of independent ones.
_WORTH = 1 / 3


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each letter's trigram, and where each text's begin."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    letter = _letters()[codes]
    held = letter.copy()
    held[1:] |= letter[:-1]  # the first mark after a word stays
    held[0] = True
    c = np.where(letter, codes, 0)[held].astype(np.uint64)
    at = np.flatnonzero(letter[held])
    h = c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
    buckets = (mix(h) >> np.uint64(49)).astype(np.int64)
    return buckets, np.searchsorted(np.flatnonzero(letter), np.concatenate([[0], ends]))


def counts(text: str, most: int = 1 << 20) -> np.ndarray:
    """Trigram counts of one text, worked on in pieces cut between words."""
    total, at = np.zeros(BUCKETS, np.int64), 0
    while at < len(text):
        end = at + most
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        total += np.bincount(trigrams([text[at:end]])[0], minlength=BUCKETS)
        at = end
    return total


def counted(texts: list[str]) -> Iterator[np.ndarray]:
    """Trigram counts of each text; of buckets up to the last that it has."""
    if len(texts) == 1:
        yield counts(texts[0])
        return
    buckets, starts = trigrams(texts)
    for i in range(len(texts)):
        yield np.bincount(buckets[starts[i] : starts[i + 1]])


def remainder(key: str, modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Trigram counts by language, over all rows whose lang is not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text):
                for name, c in zip(part.column(lang).to_pylist(), counted(decoded(part.column(text))), strict=True):
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))[: len(c)] += c
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias(text), F.col(lang).cast("string").alias(lang)).mapInArrow(count, "lang string, bucket int, n bigint")
    model: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():  # languages x BUCKETS at most
        model.setdefault(r["lang"], np.zeros(BUCKETS, np.int64))[r["bucket"]] = r["n"]
    return dict(sorted(model.items()))


def _mixture(p: np.ndarray, c: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares of languages (columns of p) for trigrams with counts c, and the log-likelihood."""
    share, total = np.full(p.shape[1], 1 / p.shape[1]), c.sum()
    for k in range(rounds):
        new = share * ((c / (p @ share)) @ p) / total
        done = k % 4 == 3 and np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(c @ np.log(p @ share))


def infer(p: np.ndarray, c: np.ndarray, rounds: int = 24, penalty: float = 3.0) -> tuple[np.ndarray, float]:
    """Shares of all languages, of which those outside the chosen set are 0, and the score of the first."""
    n = p.shape[1]
    single = c @ np.log(p)
    best = int(single.argmax())
    chosen, value, share = [best], single[best] * _WORTH, np.eye(n)[best]
    if n > 1:
        full, _ = _mixture(p, c, 8)
        order = [best, *(int(i) for i in np.argsort(-full, kind="stable") if i != best and full[i] > 0.02)]
        for k in range(2, len(order) + 1):
            part, ll = _mixture(p[:, order[:k]], c, rounds)
            if ll * _WORTH - penalty * np.log(c.sum() + 1) * (k - 1) <= value:
                break
            chosen, value = order[:k], ll * _WORTH - penalty * np.log(c.sum() + 1) * (k - 1)
            share = np.zeros(n)
            share[chosen] = part
    if len(chosen) > 1:
        return share, float(share.max())
    return share, float(1 / np.exp(np.clip((single - single[best]) * _WORTH, -700, 0)).sum())


def predict(docs: DataFrame, model: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """Per row: key, columns of keep, lang_pred, score and langs, the (lang, share) of the chosen set."""
    names = list(model)
    counts = np.stack([model[x] for x in names], 1) if names else np.zeros((BUCKETS, 0))
    probability = ((counts + _SMOOTH) / (counts.sum(0) + _SMOOTH * BUCKETS)).astype(np.float32) if names else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p_all = probability.astype(np.float64)
        for batch in batches:
            for part in slices(batch, text):
                langs, scores, sets, shares = [], [], [], []
                for c in counted(decoded(part.column(text))):
                    at = np.flatnonzero(c)
                    if not len(at) or not names:
                        langs.append("und"), scores.append(0.0), sets.append([]), shares.append([])
                        continue
                    share, score = infer(p_all[at], c[at].astype(np.float64))
                    langs.append(names[int(share.argmax())]), scores.append(score)
                    order = [j for j in np.argsort(-share, kind="stable") if share[j] > 0]
                    sets.append([names[j] for j in order]), shares.append([float(share[j]) for j in order])
                kept = [part.column(x) for x in (key, *keep)]
                made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*out, "lang_pred", "score", "set", "shares"])

    # names of docs must not meet those of the prediction on the way
    out = [f"k{i}" for i in range(1 + len(keep))]
    kinds = ", ".join(f"{o} {docs.schema[c].dataType.simpleString()}" for o, c in zip(out, (key, *keep), strict=True))
    columns = list(dict.fromkeys([key, *keep, text]))
    rows = docs.select(*columns).mapInArrow(run, f"{kinds}, lang_pred string, score double, `set` array<string>, shares array<double>")
    langs = F.arrays_zip(F.col("set").alias("lang"), F.col("shares").alias("share"))
    return rows.select(*(F.col(o).alias(c) for o, c in zip(out, (key, *keep), strict=True)), "lang_pred", "score", langs.alias("langs"))

"""Language-model scoring by a hidden Markov model over words.

1. Counts of all training words are gathered as (hash, count). Texts are coded once: a frequent word, of at most `hot`, by
   its rank, any other by its place in the text's list of distinct rarer words. The coded texts are a table.
2. Baum-Welch finds states and their moves from a start that no text shapes. Each of its rounds is a pass over all
   training texts, in which each task adds up expected counts. In these rounds a state emits word classes: the `own` most
   frequent words each are one, the others share `shared` by hash, at every size of corpus.
3. One more pass gathers the expected counts of every training word by state, through a shuffle; their number grows with
   the vocabulary. With c occurrences, of which g fall to state k, and the state's share s of all tokens, a word is told by
   (g + `PRIOR` s) / (c + `PRIOR`), the state's probability given the word. Times the word's add-one probability, over
   its sum for all words and the unknown one, that is the state's emission; it sums to one.
4. A text's probability is exact: a scaled forward recursion over its words. Emissions of the frequent words are held by
   every task; those of rarer ones come to each text by a join on the word and a shuffle on the text.

Sequences beyond `run` tokens are worked on in runs, side by side. Products of step matrices give the states before and
after each run, so expected counts and probabilities are those of the whole sequence; memory is bounded by runs.

Hashes have 64 bits: among V distinct words V * V / 2^65 pairs are expected to share one and count as one word (3e-6 for
10 million words, 0.03 for a billion).

Defined results: null or empty text has one token, its end; a very long text is scored whole, by runs; words of equal count
are ranked by hash; rows of one key are scored each; without training texts all counts are 0, and an empty table gives an
empty result; a null key counts as the empty string in the split; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, slices, stored, swept, text_buffer, words
from emberline.llm.langid import remainder

STATES = 8
PRIOR = 2.0
END = np.uint64(0x0123456789ABCDEF)
#: Tokens looked up at once.
AHEAD = 1 << 15
_SLICE = 4 << 20
_G = [f"g{k}" for k in range(STATES)]


class Sizes(NamedTuple):
    own: int = 3583  # words that are classes of their own in Baum-Welch
    shared: int = 512  # classes of all other words, a power of two
    hot: int = 1 << 19  # most words whose counts and emissions every task holds, 48 bytes each
    run: int = 1 << 16  # longest run of which all probabilities are kept
    together: int = 3 << 20  # tokens of runs that are worked on together

    @property
    def classes(self) -> int:
        return 1 + self.own + self.shared  # the end is class 0

    def shared_class(self, h: np.ndarray) -> np.ndarray:
        return np.where(h == END, 0, 1 + self.own + (h & np.uint64(self.shared - 1)).astype(np.int64)).astype(np.int16)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the hashes of their words, an END after each text, and the texts' lengths in tokens."""
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            hashes, starts = words(*text_buffer(part.column("text")))
            yield part, np.insert(hashes, starts[1:], END), np.diff(starts) + 1


class _Sums:
    """Sums of rows by hash, of at most about a million rows at once."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate([x for x, _ in self.held]), return_inverse=True)
        x = np.concatenate([c for _, c in self.held])
        return h, np.stack([np.bincount(at, x[:, k], len(h)) for k in range(x.shape[1])], 1)

    def add(self, h: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.held.append((h, x))
        if sum(len(h) for h, _ in self.held) > 1 << 20:
            self.held = [self.merged()]
            if len(self.held[0][0]) > 1 << 19:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            h, x = self.merged()
            for i in range(0, len(h), 1 << 17):
                yield h[i : i + (1 << 17)], x[i : i + (1 << 17)]
        self.held = []


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c) of all tokens of docs."""

    def count(batches):
        sums = _Sums()
        out = lambda h, x: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(x[:, 0].astype(np.int64))], names=["h", "c"])
        for _, tokens, _ in _tokens(batches):
            h, c = np.unique(tokens, return_counts=True)
            for found in sums.add(h, c[:, None].astype(np.float64)):
                yield out(*found)
        for found in sums.rest():
            yield out(*found)

    return docs.select("text").mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words by rank, and the classes of Baum-Welch; of fixed size."""

    def __init__(self, counts: DataFrame, sizes: Sizes = Sizes()) -> None:
        self.sizes = sizes
        levels = sorted(((r["level"], r["n"], r["c"]) for r in counts.groupBy(self._level().alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()), reverse=True)
        self.total, self.distinct = sum(x[2] for x in levels), sum(x[1] for x in levels)
        held, self.level = 0, (levels[0][0] + 1 if levels else 0)
        for at, n, _ in levels:
            if held + n > sizes.hot:
                break
            held, self.level = held + n, at
        hot = counts.filter(self.frequent()).toArrow()
        h, c = hot.column("h").to_numpy().astype(np.int64).view(np.uint64), hot.column("c").to_numpy().astype(np.int64)
        order = np.lexsort((h, -c))
        self.h, self.c = h[order], c[order]  # by rank
        self.sorted = np.argsort(self.h, kind="stable").astype(np.int32)
        self.keys = self.h[self.sorted]
        self.cls = sizes.shared_class(self.h)
        own = np.flatnonzero(self.h != END)[: sizes.own]
        self.cls[own] = np.arange(1, len(own) + 1)
        self.cls[self.h == END] = 0
        of_class = np.zeros(sizes.classes)
        by_class = F.when(F.col("h") == int(END), -1 - sizes.own).otherwise(F.col("h").bitwiseAND(F.lit(sizes.shared - 1)))
        for r in counts.groupBy(by_class.alias("k")).agg(F.sum("c").alias("c")).collect():
            of_class[1 + sizes.own + r["k"]] = r["c"]
        np.subtract.at(of_class, sizes.shared_class(self.h[own]), self.c[own])
        of_class[self.cls[own]] = self.c[own]
        self.unigram = (of_class + 1) / (of_class.sum() + sizes.classes)

    @staticmethod
    def _level() -> Column:
        return F.floor(F.log2("c") * 8).cast("int")

    def frequent(self) -> Column:
        """Whether a row of the counts is of a word that every task holds."""
        return self._level() >= self.level


def _ranks(keys: np.ndarray, ranks: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Rank of each token's word, -1 for rarer ones."""
    if not len(keys):
        return np.full(len(tokens), -1, np.int32)
    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
    return np.where(keys[at] == tokens, ranks[at], np.int32(-1))


@contextmanager
def _shared(df: DataFrame, value: object) -> Iterator[Broadcast]:
    """A value that tasks read. In a function's own variables each pass would leave one more copy on each executor's disk."""
    held = df.sparkSession.sparkContext.broadcast(value)
    try:
        yield held
    finally:
        held.destroy()


_CODED = "row bigint, id {}, held_out boolean, n_tokens bigint, codes binary, rare array<bigint>"


def coded(docs: DataFrame, known: Broadcast) -> DataFrame:
    """Texts as codes: a frequent word's rank, or the number of frequent words plus the place in the text's `rare`."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        keys, ranks = known.value
        for part, tokens, lengths in _tokens(batches):
            codes = _ranks(keys, ranks, tokens)
            at = np.flatnonzero(codes < 0)
            doc, h = np.repeat(np.arange(len(lengths)), lengths)[at], tokens[at]
            order = np.lexsort((h, doc))
            d, x = doc[order], h[order]
            new = np.ones(len(order), bool)
            new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
            ends = np.concatenate([[0], np.cumsum(np.bincount(d[new], minlength=len(lengths)))])
            codes[at[order]] = len(keys) + np.cumsum(new) - 1 - ends[d]
            bounds = (np.concatenate([[0], np.cumsum(lengths)]) * 4).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(codes.astype(np.int32))])
            rare = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(lengths), binary, rare], names=["id", "held_out", "n_tokens", "codes", "rare"])

    rows = docs.select("id", "held_out", "text").mapInArrow(run, _CODED.format(kind).removeprefix("row bigint, "))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _read(batches: Iterator[pa.RecordBatch], hot: int, together: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of coded texts: codes (rarer words count on through the part), lengths, and the part's rarer words."""
    for batch in batches:
        for part in slices(batch, "codes", 4 * together):
            data, offsets = text_buffer(part.column("codes"))
            codes, lengths = np.frombuffer(data.tobytes(), np.int32).copy(), np.diff(offsets) // 4
            lists = part.column("rare")
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.flatnonzero(codes >= hot)
            codes[at] += (np.cumsum(sizes) - sizes)[np.searchsorted(offsets // 4, at, "right") - 1]
            yield part, codes, lengths, lists.flatten().to_numpy().astype(np.int64).view(np.uint64)


class Layout:
    """Sequences by time: at each step the tokens of all sequences that are as long, the longest first."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.given, self.order = lengths, np.argsort(-lengths, kind="stable")
        self.begins = (np.cumsum(lengths) - lengths)[self.order]
        self.active = np.cumsum(np.bincount(lengths)[::-1])[::-1][1:].tolist()
        self.at = np.concatenate([[0], np.cumsum(self.active)])

    @cached_property
    def place(self) -> np.ndarray:
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(self.order))
        time = np.arange(self.given.sum()) - np.repeat(np.cumsum(self.given) - self.given, self.given)
        return self.at[time] + np.repeat(rank, self.given)

    def by_time(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.place] = x
        return out

    def parts(self) -> list[tuple[int, int]]:
        """Steps (from, to) of about AHEAD tokens each."""
        out, t = [], 0
        while t < len(self.active):
            to = max(t + 1, int(np.searchsorted(self.at, self.at[t] + AHEAD, "right")) - 1)
            out.append((t, to))
            t = to
        return out

    def tokens(self, first: int, to: int) -> np.ndarray:
        """Where the tokens of some steps are in the sequences as given."""
        n = self.active[first:to]
        return self.begins[np.arange(self.at[first], self.at[to]) - np.repeat(self.at[first:to], n)] + np.repeat(np.arange(first, to), n)


def _emissions(obs: np.ndarray, emit: np.ndarray, lay: Layout) -> Iterator[np.ndarray]:
    """Emissions of each step's tokens, looked up for about AHEAD at once."""
    at, loaded, first = lay.at.tolist(), None, 0
    for t in range(len(lay.active)):
        if loaded is None or at[t + 1] > first + len(loaded):
            first = at[t]
            loaded = emit[obs[first : max(at[t + 1], first + AHEAD)]]
        yield loaded[at[t] - first : at[t + 1] - first]


def forward(obs: np.ndarray, emit: np.ndarray, begin: np.ndarray, move: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """The last step's scaled probabilities (states x sequences), and the scales of the forward recursion by time.

    begin: states before each sequence's first token, in the layout's order.
    """
    kind = np.result_type(emit, begin)
    scale, at = np.empty(len(obs), kind), lay.at.tolist()
    a, turned = None, np.ascontiguousarray(move.T)
    for first, to in lay.parts():
        low = at[first]
        part = np.ascontiguousarray(emit[obs[low : at[to]]].T, kind)
        for t in range(first, to):
            here = part[:, at[t] - low : at[t + 1] - low]
            here *= begin.T if a is None else turned @ a[:, : at[t + 1] - at[t]]
            here /= np.add.reduce(here, 0, out=scale[at[t] : at[t + 1]])
            a = here
    return a, scale


def transfers(obs: np.ndarray, lengths: np.ndarray, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Per run the product of its step matrices, up to a factor: from the state at its first token to that at its last."""
    lay = Layout(lengths)
    a, logs = None, np.zeros((len(lengths), STATES))
    out = np.empty((len(lengths), STATES, STATES))
    for e in _emissions(lay.by_time(obs), emit, lay):
        if a is None:
            a = np.eye(STATES) * e[:, None, :]
        else:
            out[len(e) : len(a)] = a[len(e) :]
            a = (a[: len(e)] @ move) * e[:, None, :]
        s = a.sum(2)
        a = a / s[:, :, None]
        logs[: len(e)] += np.log(s)
    out[: len(a)] = a
    out *= np.exp(logs - logs.max(1, keepdims=True))[:, :, None]
    back = np.empty_like(out)
    back[lay.order] = out
    return back


class Runs:
    """Sequences cut to runs, with the states before and after each that the rest of its sequence implies."""

    def __init__(self, obs: np.ndarray, lengths: np.ndarray, emit: np.ndarray, start: np.ndarray, move: np.ndarray, after: bool, sizes: Sizes) -> None:
        run, self.together = sizes.run, sizes.together
        n = -(-lengths // run)
        self.lengths = np.full(n.sum(), run)
        last = np.cumsum(n) - 1
        self.lengths[last] = lengths - (n - 1) * run
        self.first = np.zeros(len(self.lengths), bool)
        self.first[last - n + 1] = True
        self.before = np.tile(start, (len(self.lengths), 1)).astype(float)
        self.after = np.ones((len(self.lengths), STATES))
        self.moves = np.zeros((STATES, STATES))  # expected, from one run to the next
        self.sequence = np.repeat(np.arange(len(lengths)), n)
        begins = np.cumsum(self.lengths) - self.lengths
        for k in np.flatnonzero(n > 1):
            runs = np.arange(last[k] - n[k] + 1, last[k] + 1)
            t = np.concatenate([transfers(obs[begins[r[0]] : begins[r[-1]] + self.lengths[r[-1]]], self.lengths[r], emit, move) for r in np.array_split(runs, max(1, len(runs) * run // self.together))])
            ends = []
            for j, r in enumerate(runs):
                end = self.before[r] @ t[j]
                ends.append(end / end.sum())
                if j + 1 < len(runs):
                    self.before[runs[j + 1]] = ends[-1] @ move
            if after:
                for j in range(len(runs) - 2, -1, -1):
                    v = t[j + 1] @ self.after[runs[j + 1]]
                    self.after[runs[j]] = move @ (v / v.sum())
                    both = np.outer(ends[j], v) * move
                    self.moves += both / both.sum()

    def groups(self) -> Iterator[tuple[slice, slice]]:
        """Runs of about `together` tokens, and their tokens."""
        ends, at = np.cumsum(self.lengths), 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + self.together, "right")))
            yield slice(at, to), slice(int(before), int(ends[to - 1]))
            at = to


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, sizes: Sizes) -> None:
        self.start, self.move, self.emit, self.sizes = start, move, emit, sizes  # emit: classes x states

    @classmethod
    def first(cls, unigram: np.ndarray, sizes: Sizes) -> Model:
        noise = np.random.default_rng(5).uniform(0.5, 1.5, (len(unigram), STATES))
        emit = unigram[:, None] * noise
        move = np.full((STATES, STATES), 0.2 / (STATES - 1))
        np.fill_diagonal(move, 0.8)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(0), sizes)

    def posteriors(self, obs: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sums: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some tokens and their state probabilities (states x tokens), until all were given; sums: gets expected starts and moves.

        The forward recursion is kept by parts, which the backward one turns to probabilities in place, from the last on.
        """
        emit, move = np.ascontiguousarray(self.emit.T, np.float32), self.move.astype(np.float32)
        turned = np.ascontiguousarray(move.T)
        runs = Runs(obs, lengths, self.emit, self.start, self.move, True, self.sizes)
        sums[1:] += runs.moves
        for which, tokens in runs.groups():
            lay, seen, named = Layout(runs.lengths[which]), obs[tokens], ids[tokens]
            at, kept, a = lay.at.tolist(), [], np.ascontiguousarray(runs.before[which][lay.order].T, np.float32)
            for first, to in lay.parts():
                low, here = at[first], lay.tokens(first, to)
                which_obs, scale = seen[here], np.empty(len(here), np.float32)
                part = np.take(emit, which_obs, 1, mode="clip")
                for t in range(first, to):
                    i, j = at[t] - low, at[t + 1] - low
                    now = part[:, i:j]
                    now *= turned @ a[:, : j - i] if t else a
                    now /= np.add.reduce(now, 0, out=scale[i:j])
                    a = now
                kept.append((first, to, here, which_obs, np.reciprocal(scale, out=scale), part))
            after, ahead = np.ascontiguousarray(runs.after[which][lay.order].T, np.float32), np.empty((STATES, 0), np.float32)
            while kept:
                first, to, here, which_obs, scale, gamma = kept.pop()
                low, moves = at[first], np.zeros((to - first, STATES, STATES), np.float32)
                part = np.take(emit, which_obs, 1, mode="clip")
                part *= scale
                for t in range(to - 1, first - 1, -1):
                    i, j, met = at[t] - low, at[t + 1] - low, ahead.shape[1]
                    now, beta = gamma[:, i:j], move @ ahead
                    np.matmul(now[:, :met], ahead.T, out=moves[t - first])
                    if j - i > met:
                        last = after[:, met : j - i]
                        beta = np.concatenate([beta, last / (now[:, met:] * last).sum(0)], 1)
                    now *= beta
                    ahead = part[:, i:j]
                    ahead *= beta
                sums[1:] += moves.sum(0, dtype=np.float64) * self.move
                if not first:
                    sums[0] += gamma[:, : at[1]][:, runs.first[which][lay.order]].sum(1, dtype=np.float64)
                yield named[here].astype(np.int64), gamma

    def expected(self, obs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts of starts, moves and emissions, in one vector."""
        sums, out = np.zeros((1 + STATES, STATES)), np.zeros((STATES, len(self.emit)))
        for seen, gamma in self.posteriors(obs, lengths, obs, sums):
            for total, g in zip(out, gamma, strict=True):
                total += np.bincount(seen, g, len(total))
        return np.concatenate([sums.ravel(), out.T.ravel()])

    @classmethod
    def of_counts(cls, v: np.ndarray, unigram: np.ndarray, sizes: Sizes) -> Model:
        start, move, emit = v[:STATES] + 1, v[STATES : STATES * (STATES + 1)].reshape(STATES, STATES) + 1, v[STATES * (STATES + 1) :].reshape(-1, STATES)
        emit = emit + 50 * unigram[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), sizes)


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int) -> Model:
    """Baum-Welch over coded texts; each round is a pass over all of them."""
    sizes, hot = vocabulary.sizes, len(vocabulary.h)
    model = Model.first(vocabulary.unigram, sizes)
    with _shared(texts, vocabulary.cls) as of_hot:
        for _ in range(rounds):

            def add_up(batches, model=model):
                total = None
                for _, codes, lengths, rare in _read(batches, hot, sizes.together):
                    cls = np.concatenate([of_hot.value, sizes.shared_class(rare)])[codes]
                    v = model.expected(cls, lengths)
                    total = v if total is None else total + v
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "x"])

            sums = texts.select("codes", "rare").mapInArrow(add_up, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
            v = np.zeros(STATES * (STATES + 1 + sizes.classes))
            v[sums.column("at").to_numpy()] = sums.column("x").to_numpy()
            model = Model.of_counts(v, vocabulary.unigram, sizes)
    return model


def word_states(texts: DataFrame, words_of: Broadcast, model: Model) -> DataFrame:
    """(h, g0, g1, ...): expected occurrences of each word of coded texts by state; words_of: hashes and classes of the frequent ones."""
    sizes = model.sizes

    def count(batches):
        hot_h, hot_cls = words_of.value
        hot = len(hot_h)
        sums, held = _Sums(), np.zeros((STATES, hot))
        out = lambda h, x: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(x[:, k].astype(np.float32)) for k in range(STATES))], names=["h", *_G])
        for _, codes, lengths, rare in _read(batches, hot, sizes.together):
            cls, x = np.concatenate([hot_cls, sizes.shared_class(rare)])[codes], np.zeros((STATES, hot + len(rare)))
            for seen, gamma in model.posteriors(cls, lengths, codes, np.zeros((1 + STATES, STATES))):
                for total, g in zip(x, gamma.astype(np.float64), strict=True):
                    np.add.at(total, seen, g)
            held += x[:, :hot]
            if len(rare):
                for found in sums.add(rare, np.ascontiguousarray(x[:, hot:].T)):
                    yield out(*found)
        for found in sums.rest():
            yield out(*found)
        at = np.flatnonzero(held.any(0))
        for i in range(0, len(at), 1 << 17):
            yield out(hot_h[at[i : i + (1 << 17)]], held[:, at[i : i + (1 << 17)]].T)

    rows = texts.select("codes", "rare").mapInArrow(count, "h bigint, " + ", ".join(f"{g} float" for g in _G))
    return rows.groupBy("h").agg(*(F.sum(g).alias(g) for g in _G))


def emissions(counts: DataFrame, states: DataFrame, total: int, distinct: int) -> tuple[DataFrame, np.ndarray]:
    """(h, c, r) with r the ratios of a word's emissions to its add-one probability, by state; and r of unknown words."""
    rows = stored(counts.join(states, "h", "left").select("h", "c", *(F.coalesce(g, F.lit(0.0)).alias(g) for g in _G)))
    sums = rows.agg(*(F.sum(g) for g in _G)).first()
    share = np.array([x or 0.0 for x in sums]) + 1e-9
    share /= share.sum()
    told = [(F.col(g) + PRIOR * float(s)) / (F.col("c") + PRIOR) for g, s in zip(_G, share, strict=True)]
    norm = rows.agg(*(F.sum(x * (F.col("c") + 1)) for x in told)).first()
    norm = (np.array([x or 0.0 for x in norm]) + share) / (total + distinct + 1)
    return rows.select("h", "c", F.array(*((x / F.lit(float(n))).cast("float") for x, n in zip(told, norm, strict=True))).alias("r")), share / norm


def _score(texts: DataFrame, table: Broadcast, unknown: np.ndarray, start: np.ndarray, move: np.ndarray, bounds: Sizes) -> DataFrame:
    """Scores of coded texts with found, the known ones of their rarer words; emissions are relative to add-one ones."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        hot_c, hot_r = table.value
        hot, log_hot = len(hot_c), np.log10(hot_c + 1.0)
        for batch in batches:
            found = batch.column("found").flatten()
            at, c = found.field("at").to_numpy(), found.field("c").to_numpy()
            r = found.field("r").flatten().to_numpy().reshape(-1, STATES)
            known_of = np.diff(batch.column("found").offsets.to_numpy())
            row = 0
            for part, codes, lengths, rare in _read([batch], hot, bounds.together):
                sizes = np.diff(part.column("rare").offsets.to_numpy())
                lo, hi = int(known_of[:row].sum()), int(known_of[: row + part.num_rows].sum())
                place = np.repeat(np.cumsum(sizes) - sizes, known_of[row : row + part.num_rows]) + at[lo:hi]
                row += part.num_rows
                emit = np.concatenate([hot_r, np.tile(unknown.astype(np.float32), (len(rare), 1))])
                emit[hot + place] = r[lo:hi]
                logs = np.concatenate([log_hot, np.zeros(len(rare))])
                logs[hot + place] = np.log10(c[lo:hi] + 1.0)
                known = np.concatenate([np.ones(hot, np.int64), np.zeros(len(rare), np.int64)])
                known[hot + place] = 1
                begin = np.cumsum(lengths) - lengths
                inner = np.zeros(len(lengths))
                runs = Runs(codes, lengths, emit, start, move, False, bounds)
                for which, tokens in runs.groups():
                    lay = Layout(runs.lengths[which])
                    _, scale = forward(lay.by_time(codes[tokens]), emit, runs.before[which][lay.order], move, lay)
                    ends = np.cumsum(runs.lengths[which])
                    np.add.at(inner, runs.sequence[which], np.add.reduceat(np.log10(scale)[lay.place], ends - runs.lengths[which]))
                columns = [pa.array(np.add.reduceat(known[codes], begin)), pa.array(np.add.reduceat(logs[codes], begin)), pa.array(inner)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), part.column("n_tokens"), *columns], names=["id", "held_out", "n_tokens", "n_known", "base", "inner"])

    return texts.select("id", "held_out", "n_tokens", "codes", "rare", "found").mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, inner double")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2, rounds: int = 8, sizes: Sizes = Sizes()) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), (remainder(key, modulus) == held).alias("held_out"))
    counts = cut(word_counts(docs.filter(~F.col("held_out"))))
    vocabulary = Vocabulary(counts, sizes)
    with _shared(docs, (vocabulary.keys, vocabulary.sorted)) as known:
        texts = stored(coded(docs, known))
    training = texts.filter(~F.col("held_out"))
    model = train(training, vocabulary, rounds)
    total, distinct = vocabulary.total, vocabulary.distinct
    with _shared(docs, (vocabulary.h, vocabulary.cls)) as words_of:
        told, unknown = emissions(counts, word_states(training, words_of, model), total, distinct)
    swept(docs)
    hot = told.filter(vocabulary.frequent()).toArrow()
    c, h = hot.column("c").to_numpy(), hot.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.lexsort((h, -c))
    r = hot.column("r").combine_chunks().flatten().to_numpy().reshape(-1, STATES)[order] if len(c) else np.zeros((0, STATES), np.float32)
    asked = texts.select("row", F.posexplode("rare").alias("at", "h"))
    found = asked.join(told.filter(~vocabulary.frequent()), "h").groupBy("row").agg(F.collect_list(F.struct("at", "c", "r")).alias("found"))
    empty = F.array().cast("array<struct<at:int,c:bigint,r:array<float>>>")
    table = docs.sparkSession.sparkContext.broadcast((c[order], r))  # tasks of the result read it
    rows = _score(texts.join(found, "row", "left").withColumn("found", F.coalesce("found", empty)), table, unknown, model.start, model.move, sizes)
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return rows.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("inner") + base).alias("score"))

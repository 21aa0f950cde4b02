"""Quality rules as a bitmask ledger, in built-in functions only.

Each rule is evaluated once per document; the ledger keeps the failure bits and the measurements. A policy is a versioned
set of rules; applying one is a bitwise and, and ablations are counts over bit patterns, so neither reads a text again.

Windows found twice are found without a join or a self-comparison: the window hashes of a text carry their position in
the low bits, are sorted, and neighbours are compared, by hash and then by their words. Where two different windows meet
under one hash, the text's windows are sorted by their words instead, so the count is exact for any text.

Abuse is told by words that `abuse_terms` learns from labels, in every language. Two of them within `NEAR` words fail a
document of any length.

Defined results: null or empty text has no words and fails the rule on length, as does a text of white space; very long
texts are measured whole, in memory of about 100 bytes a word; measurements have no ties to break; repeated rows, also
those of one key, are measured each; an empty table gives an empty ledger, and without labels there are no terms; columns
of docs are kept by `measure`, but those of the ledger replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts", "n_toxic", "n_toxic_near")

#: Rule: bit and the condition under which a document fails it, over the measurements.
RULES: dict[str, tuple[int, str]] = {
    "short": (0, "n_words < 50"),
    "repeats": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "dup_lines": (3, "n_dup_lines > 3 and 100 * n_dup_lines > 30 * n_lines"),
    "word_length": (4, "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    "upper": (5, "2 * n_upper > word_chars"),
    "shouts": (6, "10 * n_shouts > n_words"),
    "toxic": (7, "n_toxic_near > 0"),
}

#: Version: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("short", "repeats"),
    "v1": ("short", "repeats", "symbols", "dup_lines", "word_length", "upper", "shouts"),
    "v2": ("short", "repeats", "symbols", "dup_lines", "word_length", "upper", "shouts", "toxic"),
}

#: About as many labelled documents, chosen by hash, teach the terms; least letters of a term; words between two near ones.
SAMPLE, LETTERS, NEAR = 10_000, 4, 100
#: A term is in at least 6 contexts of toxic documents, and in one for each 200 of these; 4 of 5 documents with it are toxic.
CONTEXTS, ONE_IN, PURE = 6, 200, (4, 5)
#: Characters that are taken off a word's beginning.
LEADING = "\"'([{<*_-"
_SPACES = r"[\x20\x09-\x0D]+"
#: Bits of a window's hash; tests lower it.
HASH_BITS = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once though body uses it within lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words of an array that lie in a window of `width` words found more than once in it."""
    none = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        span = F.lit(width).cast("long")
        return let(F.sort_array(places), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(span, F.coalesce(F.get(p, i + 1) - x, span))), none, lambda a, b: a + b))

    def of(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w))).cast("int")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        starts = F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))
        window = lambda at: [F.get(w, at + k) for k in range(width)]
        hash_ = lambda first, i: F.call_function("shiftrightunsigned", F.xxhash64(first, *(F.get(w, i + k) for k in range(1, width))), F.lit(64 - HASH_BITS))
        keys = F.transform(starts, lambda first, i: F.call_function("shiftleft", hash_(first, i), bits).bitwiseOR(i.cast("long")))
        place = lambda key: key.bitwiseAND(mask).cast("int")

        def by_words(_: Column) -> Column:
            named = F.sort_array(F.transform(starts, lambda first, i: F.struct(F.concat_ws(" ", *window(i)).alias("g"), i.cast("long").alias("i"))))
            equal = lambda s, x, i: F.coalesce(x["g"] == F.get(s, i)["g"], F.lit(False))
            return let(named, lambda s: covered(F.transform(F.filter(s, lambda x, i: equal(s, x, i - 1) | equal(s, x, i + 1)), lambda x: x["i"])))

        def among(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.call_function("shiftright", a.bitwiseXOR(b), bits) == 0, F.lit(False))
            twice = F.filter(s, lambda k, i: same(k, F.get(s, i - 1)) | same(k, F.get(s, i + 1)))

            def checked(t: Column) -> Column:
                differ = lambda a, b: ~F.array(*window(place(a))).eqNullSafe(F.array(*window(place(b))))
                collide = F.exists(F.transform(t, lambda k, i: F.when(same(k, F.get(t, i - 1)), differ(k, F.get(t, i - 1))).otherwise(F.lit(False))), lambda x: x)
                return F.when(F.size(t) == 0, none).when(collide, by_words(t)).otherwise(covered(F.transform(t, lambda k: k.bitwiseAND(mask))))

            return let(twice, checked)

        return let(F.sort_array(keys), among)

    return let(words, of)


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")


def term(word: Column) -> Column:
    """What a word is compared by: its first letters after LEADING, in lower case."""
    return F.regexp_extract(F.lower(F.ltrim(word, F.lit(LEADING))), r"^\p{L}+", 0)


def abuse_terms(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[str]:
    """Words that tell toxic documents, learned from about `sample` labelled ones.

    Contexts are the words before a term, so that copies of one toxic document teach nothing. Null labels are left out;
    each row of labels counts; without toxic labels there are no terms.
    """
    labels = labels.filter("toxic is not null").select(F.col(key).alias("__key"), F.col("toxic").cast("int").alias("__toxic"))
    among = labels.count()
    part = F.conv(F.substring(F.md5(F.col("__key").cast("string")), 1, 8), 16, 10).cast("long")
    labels = labels.filter(part * among < F.lit(sample * (1 << 32)))
    least = max(CONTEXTS, (labels.agg(F.sum("__toxic")).first()[0] or 0) // ONE_IN)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(labels), "__key")  # bounded by sample
    rows = rows.select("__toxic", "__text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(rows.select("__toxic", text_words(F.col("__text")).alias("w")).select("__toxic", F.expr("if(__toxic = 1, w, array())").alias("w"), F.transform("w", term).alias("terms")))
    named = rows.select("__toxic", F.explode(F.array_distinct("terms")).alias("term")).filter(F.length("term") >= LETTERS)
    pure = named.groupBy("term").agg(F.sum("__toxic").alias("toxic"), F.count("*").alias("n")).filter(PURE[1] * F.col("toxic") >= PURE[0] * F.col("n"))
    pairs = rows.filter("__toxic = 1").select(F.explode(F.transform("terms", lambda x, i: F.struct(x.alias("term"), F.coalesce(F.get("w", i - 1), F.lit("")).alias("before")))).alias("p"))
    wide = pairs.select("p.term", "p.before").distinct().groupBy("term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= least)
    return sorted(r.term for r in pure.join(wide, "term").select("term").collect())  # fewer than words in the sample


def learned_terms(docs: DataFrame, sf_dir: str, key: str = "doc_id") -> list[str]:
    """Terms learned from the labels of a table folder; none where it has no labels."""
    try:
        labels = table(docs.sparkSession, sf_dir, "labels")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return abuse_terms(docs, labels, key)


def _toxic(w: Column, terms: Sequence[str]) -> Column:
    """(n, near) of an array of words: those that are terms, and neighbouring ones fewer than NEAR words apart."""
    zero = F.lit(0).cast("long")
    if not terms:
        return F.struct(zero.alias("n"), zero.alias("near"))
    heads = sorted({t[:LETTERS] for t in terms})  # few words come to the pattern
    known = lambda x: F.lower(F.substring(F.ltrim(x, F.lit(LEADING)), 1, LETTERS)).isin(heads) & term(x).isin(list(terms))
    places = F.filter(F.transform(w, lambda x, i: F.when(known(x), i)), lambda i: i.isNotNull())
    near = lambda p: F.size(F.filter(p, lambda x, i: F.coalesce(x - F.get(p, i - 1) < NEAR, F.lit(False)))).cast("long")
    return let(places, lambda p: F.struct(F.size(p).cast("long").alias("n"), near(p).alias("near")))


def measure(docs: DataFrame, text: str = "text", terms: Sequence[str] = ()) -> DataFrame:
    """The ledger: docs with the measurements and fail_bits; terms are those of abuse_terms."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))
    per_words = let(text_words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat"), _toxic(w, terms).alias("toxic")))
    out = docs.withColumns({"__lines": both, "__words": per_words}).withColumns(
        {
            "n_words": F.col("__words.n"),
            "word_chars": F.length(t).cast("long") - count(r"[\x20\x09-\x0D]"),
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_lines": F.col("__lines.n"),
            "n_dup_lines": F.col("__lines.dup"),
            "n_repeat_words": F.col("__words.repeat"),
            "n_upper": count(r"\p{Lu}"),
            "n_shouts": count("!"),
            "n_toxic": F.col("__words.toxic.n"),
            "n_toxic_near": F.col("__words.toxic.near"),
        }
    )
    bits = F.lit(0).cast("long")
    for bit, fails in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("fail_bits", bits).drop("__lines", "__words")


def mask_of(policy: str, without: str | None = None) -> int:
    return sum(1 << RULES[r][0] for r in POLICIES[policy] if r != without)


def fails(policy: str) -> Column:
    """Whether a row of a ledger fails the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) != 0


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    masked = F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in POLICIES[policy]))
    rows = patterns.select(masked.alias("bits"), "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).cast("long")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(count(hit).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_only"), count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"))

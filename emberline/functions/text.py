"""Text of reports as Column expressions: tokens, keys, hashes, and keyword detection."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.schemas import INCIDENT_TYPES, OTHER_TYPE, TYPE_ALIASES, lookup

# fixed values: words that tell nothing about an event, for accounts and for bursts
STOP_ACCOUNT = [
    "sample", "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "near", "around", "along", "said", "reported", "reportedly", "report",
    "residents", "people", "after", "were", "was", "has", "have", "had", "into", "from", "with", "by", "are", "is", "as", "that", "this", "second",
    "corroborating", "fresh", "some",
]
STOP_BURST = [
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "near", "around", "along", "said", "reported", "reportedly", "report", "residents",
    "people", "after", "were", "was", "has", "have", "had", "into", "from", "with", "by", "are", "is", "as", "that", "this", "some", "help", "now",
    "please", "there", "here", "happening", "sos", "urgent",
]

# fixed values: outlets that are one owner, in the order in which they are tried within longer names
OUTLETS = {
    "nan": "wire:nan",
    "news agency of nigeria": "wire:nan",
    "reuters": "wire:reuters",
    "thomson reuters": "wire:reuters",
    "afp": "wire:afp",
    "agence france-presse": "wire:afp",
    "ap": "wire:ap",
    "associated press": "wire:ap",
    "bbc": "wire:bbc",
    "bbc news": "wire:bbc",
    "bbc hausa": "wire:bbc",
    "punch": "owner:punch",
    "punch newspapers": "owner:punch",
    "punch ng": "owner:punch",
    "the punch": "owner:punch",
    "vanguard": "owner:vanguard",
    "vanguard news": "owner:vanguard",
    "vanguard ngr": "owner:vanguard",
    "premium times": "owner:premiumtimes",
    "premiumtimes": "owner:premiumtimes",
    "daily trust": "owner:dailytrust",
    "dailytrust": "owner:dailytrust",
    "trust": "owner:dailytrust",
    "channels": "owner:channels",
    "channels tv": "owner:channels",
    "channels television": "owner:channels",
    "the nation": "owner:thenation",
    "thenation": "owner:thenation",
    "guardian": "owner:guardianng",
    "the guardian nigeria": "owner:guardianng",
    "guardian nigeria": "owner:guardianng",
    "guardian ng": "owner:guardianng",
    "sahara reporters": "owner:sahara",
    "saharareporters": "owner:sahara",
    "leadership": "owner:leadership",
    "leadership newspaper": "owner:leadership",
    "thisday": "owner:thisday",
    "this day": "owner:thisday",
}

# fixed values: affixes that a query may carry besides a place's name
AFFIXES = (
    "local government area",
    "local govt area",
    "local government",
    "lga",
    "town",
    "village",
    "ward",
    "district",
    "axis",
    "express",
    "expressway",
    "highway",
    "junction",
    "roundabout",
    "general area",
    "environs",
    "outskirts",
)

# fixed values: words of a terrain, the slowest terrain first
TERRAIN_WORDS = {
    "mountain": (
        "mountain", "mountains", "mountainous", "hill", "hills", "hilly", "highland", "highlands", "plateau", "rock", "rocks", "rocky", "cliff",
        "ridge", "valley", "gorge", "river", "riverine", "swamp", "swampy", "creek", "creeks", "marsh", "wetland", "mambilla", "mandara",
    ),
    "forest": (
        "forest", "forests", "forested", "bush", "bushes", "jungle", "woods", "woodland", "thicket", "shrub", "scrub", "savannah", "savanna",
        "grove", "rugu", "reserve", "game reserve", "national park", "sambisa", "falgore", "kamuku", "into the bush", "into the forest",
    ),
    "road": (
        "road", "roads", "highway", "expressway", "motorway", "tarred", "tar", "asphalt", "checkpoint", "junction", "roundabout", "toll", "tollgate",
        "bypass", "ring road", "street", "by vehicle", "on the road", "abuja-kaduna", "kaduna-abuja", "by car", "convoy",
    ),
    "mixed": (
        "track", "tracks", "path", "footpath", "trail", "village", "villages", "hamlet", "outskirts", "rural", "farmland", "farm", "farms", "field",
        "fields", "settlement", "settlements", "border", "interland", "hinterland", "remote", "off-road", "off road", "dirt",
    ),
}

_ACCENTED, _PLAIN = "àáâäāèéêëēìíîïīòóôöōùúûüūñç", "aaaaaeeeeeiiiiiooooouuuuunc"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body, or a lambda in it, uses it."""
    return F.transform(F.array(value), body)[0]


def html_clean(text: Column, references: dict[str, str] | None = None) -> Column:
    """Tags to spaces, character references decoded, white space collapsed, trimmed.

    All references, also those without a semicolon, in Python in Arrow batches; a null is an empty text. Or only the given
    ones, as they are written, in that order, with ASCII white space, and a null stays null.
    """
    if references is not None:
        bare = F.regexp_replace(text, "<[^>]+>", " ")
        for name, value in references.items():
            bare = F.replace(bare, F.lit(name), F.lit(value))
        return F.regexp_replace(F.regexp_replace(bare, r"[\t\n\f\r ]+", " "), r"\A\p{Zs}+|\p{Zs}+\z", "")
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.pandas_udf(_unescaped, "string")(bare), r"(?U)\s+", " "))


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape)


def tokens(text: Column, stop: list[str] | tuple[str, ...] = tuple(STOP_ACCOUNT)) -> Column:
    """Distinct words [a-z0-9]+ of more than one character that are not stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    found = F.filter(found, lambda w: F.length(w) > 1)
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else F.array_distinct(found)


def overlap(a: Column, b: Column) -> Column:
    """struct(both, either) of two token sets; similarities are compared as integers."""
    both = F.size(F.array_intersect(a, b))
    return F.struct(both.alias("both"), (F.size(a) + F.size(b) - both).alias("either"))


def jaccard(a: Column, b: Column) -> Column:
    o = overlap(a, b)
    return F.coalesce(F.try_divide(o["both"], o["either"]), F.lit(0.0))


def alike(a: Column, b: Column, tenths: int = 6) -> Column:
    """Whether the Jaccard similarity is at least tenths / 10; empty sets are alike with nothing."""
    o = overlap(a, b)
    return (F.size(a) > 0) & (F.size(b) > 0) & (10 * o["both"] >= tenths * o["either"])


def content_fingerprint(toks: Column) -> Column:
    return F.when(F.size(toks) > 0, F.concat(F.lit("fp:"), F.substring(F.sha1(F.array_join(F.sort_array(toks), " ").cast("binary")), 1, 16)))


def raw_hash(source: Column, title: Column, text: Column) -> Column:
    """Identity of a raw report."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (source, title, text))).cast("binary"), 256)


def content_signature(kind: Column, place: Column, text: Column) -> Column:
    """Signature of a report that numbers, punctuation and case do not change."""
    blob = F.lower(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in (kind, place, text))))
    blob = F.regexp_replace(F.regexp_replace(blob, "[0-9]+", ""), "[^a-z\x1f]+", " ")
    return F.substring(F.sha2(F.trim(F.regexp_replace(blob, " +", " ")).cast("binary"), 256), 1, 24)


def reporter_key(*parts: Column) -> Column:
    """Opaque key of whoever reports; `anon` if nothing identifies them."""
    kept = F.filter(F.array(*(F.lower(F.trim(p.cast("string"))) for p in parts)), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(kept) == 0, F.lit("anon")).otherwise(F.substring(F.sha2(F.array_join(kept, "|").cast("binary"), 256), 1, 16))


def outlet(source: Column) -> Column:
    """Owner of a source: an exact alias, else the first alias within the name, else the name itself."""
    s = F.trim(F.lower(F.coalesce(source, F.lit("?"))))
    names = F.array(*map(F.lit, OUTLETS))
    owners = F.array(*map(F.lit, OUTLETS.values()))
    exact = F.array_position(names, s)
    within = F.array_position(F.transform(names, lambda n: F.contains(s, n)), F.lit(True))
    at = F.when(exact > 0, exact).otherwise(within).cast("int")
    return F.when(at > 0, F.element_at(owners, at)).otherwise(F.concat(F.lit("src:"), F.regexp_replace(s, r"\s+", " ")))


def place_key(name: Column) -> Column:
    """Canonical key of a place name: lower case, accents folded, punctuation to single spaces."""
    s = F.translate(F.lower(F.coalesce(name, F.lit(""))), _ACCENTED + "’'`", _PLAIN)
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def fold(name: Column) -> Column:
    """A name as typed, but for case, accents and white space around it."""
    return F.trim(F.translate(F.lower(F.coalesce(name, F.lit(""))), _ACCENTED, _PLAIN))


def loose_key(name: Column) -> Column:
    """place_key without affixes at either end; empty if there is nothing else."""
    any_affix = "|".join(sorted(AFFIXES, key=len, reverse=True))
    s = F.regexp_replace(place_key(name), f"^(?:(?:{any_affix}) )+", "")
    s = F.regexp_replace(s, f"(?: (?:{any_affix}))+$", "")
    return F.when(s.isin(*AFFIXES), F.lit("")).otherwise(s)


def phone(number: Column) -> Column:
    """Digits and +, with the national prefix; at most 24 characters."""
    raw = F.regexp_replace(F.coalesce(number, F.lit("")), "[^0-9+]", "")
    raw = F.when(raw.startswith("00"), F.concat(F.lit("+"), F.substring(raw, 3, 64))).otherwise(raw)
    raw = F.when(raw.startswith("0") & (F.length(raw) >= 10), F.concat(F.lit("+234"), F.substring(raw, 2, 64))).otherwise(raw)
    return F.substring(raw, 1, 24)


def hidden(value: Column) -> Column:
    """First four and last three characters; short values are hidden whole."""
    return F.when(F.length(value) <= 6, F.lit("***")).otherwise(F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(3))))


def redact_phone(number: Column) -> Column:
    return hidden(phone(number))


def redact_address(address: Column) -> Column:
    s = F.trim(F.coalesce(address, F.lit("")))
    at = F.instr(s, "@")
    mail = F.concat(F.substring(s.substr(F.lit(1), at - 1), 1, 1), F.lit("***@"), s.substr(at + 1, F.lit(12)))
    return F.when(at > 0, F.substring(mail, 1, 32)).otherwise(hidden(s))


def anonymous_ip(ip: Column) -> Column:
    """/24 of IPv4, /48 of IPv6, else `?`."""
    s = F.trim(F.coalesce(ip, F.lit("")))
    six = F.filter(F.split(s, ":"), lambda p: p != "")
    four = F.split(s, r"\.")
    return (
        F.when(F.contains(s, F.lit(":")), F.when(F.size(six) > 0, F.concat(F.array_join(F.slice(six, 1, 3), ":"), F.lit("::/48"))).otherwise("?"))
        .when(F.size(four) == 4, F.concat(F.array_join(F.slice(four, 1, 3), "."), F.lit(".0/24")))
        .otherwise("?")
    )


def short_name(name: Column) -> Column:
    """First name and the initial of the second."""
    parts = F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), lambda p: p != "")
    initial = F.concat(F.get(parts, 0), F.lit(" "), F.upper(F.substring(F.get(parts, 1), 1, 1)), F.lit("."))
    return F.when(F.size(parts) == 0, "").when(F.size(parts) == 1, F.get(parts, 0)).otherwise(initial)


def incident_type(raw: Column) -> Column:
    """A word for a type of incident, brought to the controlled vocabulary."""
    key = F.translate(F.lower(F.trim(F.coalesce(raw, F.lit("")))), " -", "__")
    return F.when(key.isin(*INCIDENT_TYPES), key).otherwise(lookup(TYPE_ALIASES, key, OTHER_TYPE))


def terrain(*parts: Column) -> Column:
    """The slowest terrain that the text names; mixed if none."""
    text = F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), r"\s+", " ")
    tests = [F.when(text.rlike(rf"(?<!\w)(?:{'|'.join(words)})(?!\w)"), F.lit(name)) for name, words in TERRAIN_WORDS.items()]
    return F.coalesce(*tests, F.lit("mixed"))


def state_of(display: Column, states: list[str]) -> Column:
    """The first comma part of an address that is a state."""
    return F.get(F.filter(F.transform(F.split(F.coalesce(display, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p.isin(*states)), 0)


def time_of_day(text: Column) -> Column:
    """Minutes after midnight of the first time with am or pm, NULL if none."""
    found = lambda group: F.regexp_extract(F.lower(text), r"\b([0-9]{1,2})(?::([0-9]{2}))?\s*(am|pm)\b", group)
    hour = F.when(found(1) != "", found(1).cast("int"))
    return F.when(hour.between(1, 12), hour % 12 * 60 + F.when(found(2) != "", found(2).cast("int")).otherwise(0) + F.when(found(3) == "pm", 720).otherwise(0))


def menu_choice(text: Column) -> Column:
    """Choices of a menu string such as 1*2*text, as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\*"), lambda p: p != "")


def sha256_valid(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("^[a-f0-9]{64}$")


@dataclass
class Keywords:
    """Vocabulary of detection: terms by type and language, terms too weak to fire alone, contexts that suppress."""

    types: dict[str, dict[str, list[str]]]
    weak: frozenset[str] = frozenset()
    severity: list[str] = field(default_factory=list)
    hints: dict[str, list[str]] = field(default_factory=dict)
    negative: dict[str, list[str]] = field(default_factory=dict)
    override: list[str] = field(default_factory=list)
    gates: dict[str, str] = field(default_factory=dict)  # type: pattern that its text must match besides

    @classmethod
    def from_json(cls, text: str, weak: frozenset[str] = frozenset(), override: list[str] | None = None, gates: dict[str, str] | None = None) -> Keywords:
        raw = json.loads(text)
        negative = {k: v for k, v in raw.get("negative_terms", {}).items() if not k.startswith("_")}
        return cls(raw["incident_types"], weak, raw.get("severity_terms", []), raw.get("language_hints", {}), negative, override or [], gates or {})


def word_set(text: Column) -> Column:
    """Words of a text, for terms of one word."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0))


def term_hits(text: Column, words: Column, terms: list[str]) -> Column:
    """How many entries of terms the text has; a term listed twice counts twice."""
    terms = [t.lower().strip() for t in terms if t and t.strip()]
    single = [t for t in terms if t.replace("_", "a").isalnum()]
    count = F.size(F.filter(F.array(*map(F.lit, single)), lambda t: F.array_contains(words, t))) if single else F.lit(0)
    low = F.lower(F.coalesce(text, F.lit("")))
    quote = lambda t: "".join(c if c.isalnum() or c == " " else "\\" + c for c in t)
    for phrase in (t for t in terms if t not in single):
        count = count + low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){quote(phrase)}(?![\p{{L}}\p{{N}}_])").cast("int")
    return count


def detect_type(text: Column, kw: Keywords) -> Column:
    """Type with the most strong terms, then the most terms, then the first listed; NULL if none fires or context vetoes.

    A type needs a strong term, and its gate if it has one. Any suppressing context vetoes unless an overriding term is there.
    """

    def best_of(words: Column) -> Column:
        found = []
        for order, (name, by_lang) in enumerate(kw.types.items()):
            terms = [t for group in by_lang.values() for t in group]
            strong = term_hits(text, words, [t for t in terms if t.lower().strip() not in kw.weak])
            gate = F.lower(F.coalesce(text, F.lit(""))).rlike(kw.gates[name]) if name in kw.gates else F.lit(True)
            rank = F.struct(strong.alias("strong"), term_hits(text, words, terms).alias("all"), F.lit(-order).alias("first"), F.lit(name).alias("name"))
            found.append(F.when((strong > 0) & gate, rank))
        veto = reduce(lambda a, b: a | b, (term_hits(text, words, t) > 0 for t in kw.negative.values()), F.lit(False))
        over = term_hits(text, words, kw.override) > 0 if kw.override else F.lit(False)
        return F.when(~veto | over, F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))["name"])

    return let(word_set(text), best_of)


def negatives_dominate(text: Column, kw: Keywords) -> Column:
    """At least two suppressing terms, more than incident terms, and no sign of severity."""
    bad = [t for g in kw.negative.values() for t in g]
    good = [t for by in kw.types.values() for g in by.values() for t in g]

    def dominated(words: Column) -> Column:
        n = term_hits(text, words, bad)
        return (n >= 2) & (n > term_hits(text, words, good))

    return let(word_set(text), dominated) & (severity(text, kw) == 0)


def severity(text: Column, kw: Keywords) -> Column:
    """Severity terms that are substrings of the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, kw.severity)), lambda t: F.contains(low, t))) if kw.severity else F.lit(0)


def language(text: Column, kw: Keywords, default: str = "en") -> Column:
    """Language with the most hints as substrings of the padded text; the first listed wins ties."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    scores = [F.struct(F.size(F.filter(F.array(*map(F.lit, hints)), lambda h: F.contains(padded, h))).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, hints) in enumerate(kw.hints.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(default))

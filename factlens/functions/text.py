"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the embedder leaves out.
EMBEDDING_STOPWORDS = ["the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "is", "are", "was", "were", "be", "been", "with", "this", "that", "as"]

# Words in a name that tell its type, in the order of the tests; countries are looked for in the text too.
ENTITY_KEYWORDS = [
    ("Regulation", ["regulation", "act", "directive", "standard", "policy", "protocol", "guideline", "circular"]),
    ("Organization", ["firm", "bank", "authority", "company", "corp", "ltd", "inc", "commission", "agency", "board"]),
    ("Instrument", ["tax", "charge", "rate", "fee", "levy", "credit", "deduction", "threshold"]),
    ("Party", ["party", "citizen", "resident", "taxpayer", "entity", "customer", "person"]),
]
JURISDICTIONS = ["eu", "us", "uk", "usa", "germany", "france", "japan", "china", "canada", "india"]


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def clean(text) -> Column:
    """White space other than line breaks becomes one space, none stands before a stop, none at either end."""
    one = F.regexp_replace(_col(text), r"(?U)[^\S\n]+", " ")
    return F.regexp_replace(F.regexp_replace(one, r"(?U)\s+([,.;:])", "$1"), r"(?U)^\s+|\s+$", "")


def token_estimate(text) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4).cast("int"))


def word_tokens(text, stopwords: list[str] = EMBEDDING_STOPWORDS) -> Column:
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9_']+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stopwords)) if stopwords else found


def search_tokens(text) -> Column:
    """The set of letter-digit words of three characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_overlap(a, b) -> Column:
    return jaccard(search_tokens(a), search_tokens(b))


def canonical_name(name) -> Column:
    """A name without white space around it and without one article before it."""
    return F.regexp_replace(F.trim(_col(name)), r"(?i)^(the|a|an)\s+", "")


def canonical_key(name) -> Column:
    return F.lower(canonical_name(name))


def normal_name(name) -> Column:
    """A node's name: white space inside becomes one space, none at either end; case and articles stay."""
    return F.regexp_replace(F.regexp_replace(_col(name), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def classify_entity(name, text=None, whole_words: bool = False) -> Column:
    """The type that the first keyword list with a hit names; countries also count if the text holds them (by default
    anywhere in it, with whole_words as words only)."""
    low = F.lower(_col(name))
    hit = lambda where, words: F.coalesce(where.rlike((r"\b(" if whole_words else "(") + "|".join(words) + (r")\b" if whole_words else ")")), F.lit(False))
    out = None
    for kind, words in ENTITY_KEYWORDS:
        out = (F if out is None else out).when(hit(low, words), F.lit(kind))
    place = hit(low, JURISDICTIONS)
    if text is not None:
        place = place | hit(F.lower(_col(text)), JURISDICTIONS)
    return out.when(place, F.lit("Jurisdiction")).otherwise(F.lit("Concept"))


def sentences(text) -> Column:
    """Parts that end at white space after a stop, without white space around them, blank ones left out."""
    return F.filter(F.transform(F.split(_col(text), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def clamp_int(value, fallback: int, least: int, most: int) -> Column:
    """The whole number that a string begins with, kept between two bounds; fallback if there is none."""
    number = F.try_to_number(F.nullif(F.regexp_extract(_col(value).cast("string"), r"^\s*([+-]?\d{1,18})", 1), F.lit("")), F.lit("S999999999999999999"))
    return F.greatest(F.lit(least).cast("long"), F.least(F.lit(most).cast("long"), F.coalesce(number.cast("long"), F.lit(fallback).cast("long"))))


def iso_date(text) -> Column:
    """A strict YYYY-MM-DD, else null."""
    return F.when(_col(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(_col(text), "yyyy-MM-dd"))


def short_hash(text, length: int = 8) -> Column:
    """The key of a graph node: n and FNV-1a of the string's UTF-16 units as 32-bit hex, cut to a length. Products are doubles
    and so rounded to 53 bits, as the keys' first users had them."""
    point = lambda c: F.ascii(c).cast("long")
    units = lambda c: F.when(point(c) > 0xFFFF, F.array((point(c) - 0x10000 - (point(c) - 0x10000) % 1024) / 1024 + 0xD800, (point(c) - 0x10000) % 1024 + 0xDC00)).otherwise(F.array(point(c)))
    codes = F.flatten(F.transform(F.filter(F.split(_col(text), ""), lambda c: c != ""), lambda c: F.transform(units(c), lambda x: x.cast("long"))))
    wide, half = float(1 << 32), float(1 << 31)
    signed = lambda h: F.when(h >= half, h - wide).otherwise(h)
    step = lambda h, c: F.pmod(signed(h.cast("long").bitwiseXOR(c).cast("double")) * 16777619.0, F.lit(wide))
    h = F.aggregate(codes, F.lit(2166136261.0), step)
    return F.concat(F.lit("n"), F.substring(F.lpad(F.lower(F.hex(h.cast("long"))), 8, "0"), 1, length))

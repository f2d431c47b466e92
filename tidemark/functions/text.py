"""Normal forms, terms, similarities and token estimates of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_alias(x: Column) -> Column:
    """Lower case, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def _snake(x: Column) -> Column:
    apart = F.regexp_replace(x, "([a-z])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(apart, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def normalize_predicate(x: Column) -> Column:
    """UPPER_SNAKE, words of camel case apart, other characters to one underscore."""
    return F.upper(_snake(x))


def normalize_entity_type(x: Column) -> Column:
    """lower_snake, by the same rules."""
    return F.lower(_snake(x))


def normalize_identifier(x: Column) -> Column:
    return F.lower(F.trim(x))


def spelling_variants(name: Column) -> Column:
    """Other names a predicate may be registered under: with or without HAS_, IS_, WAS_ before and _FOR after it."""
    bare = name
    for prefix in ("HAS_", "IS_", "WAS_"):
        bare = F.regexp_replace(bare, f"^{prefix}", "")
    bare = F.regexp_replace(bare, "_FOR$", "")
    p = lambda a, b="": F.concat(F.lit(a), bare, F.lit(b))
    every = F.array(bare, p("HAS_"), p("HAS_", "_FOR"), p("IS_"), p("IS_", "_FOR"), p("", "_FOR"))
    return F.array_distinct(F.filter(every, lambda v: (v != "") & (v != name)))


#: English words that carry no meaning in a search. Fixed list.
STOPWORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)


WORD = r"([\p{L}\p{N}]+)"


def tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits without stop words, in order. No stemming."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(WORD)), lambda w: ~w.isin(*STOPWORDS))


def terms(x: Column) -> Column:
    """The different words of three letters or more, lower case, outer punctuation off."""
    words = F.transform(F.split(F.lower(x), r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,;:!?"'()\[\]{}]+|[.,;:!?"'()\[\]{}]+$""", ""))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def trigrams(x: Column) -> Column:
    """The different trigrams of the words, each with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"))
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared of all elements of two sets; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every > 0, shared / every).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity."""
    return jaccard(trigrams(a), trigrams(b))


def token_count(x: Column) -> Column:
    """Four characters a token, halves up, at least one."""
    return F.greatest(F.floor(F.length(x) / 4.0 + 0.5).cast("int"), F.lit(1))


def token_estimate(x: Column, safety: float = 1.05) -> Column:
    """A careful estimate: six letters, three digits, one mark or line end a token, one letter of scripts without blanks."""
    kinds = r"([\p{IsLatin}\p{IsGreek}\p{IsCyrillic}&&\p{L}]+|\p{Nd}+|\n|[^\s])"
    cost = lambda w: (
        F.when(w.rlike(r"^[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}&&\p{L}]"), F.ceil(F.length(w) / 6)).when(w.rlike(r"^\p{Nd}"), F.ceil(F.length(w) / 3)).otherwise(F.lit(1)).cast("int")
    )
    raw = F.aggregate(F.regexp_extract_all(x, F.lit(kinds)), F.lit(0), lambda n, w: n + cost(w))
    return F.when(F.length(x) == 0, 0).otherwise(F.greatest(F.floor(raw * F.lit(safety) + 0.999).cast("int"), F.lit(1)))


def collapse_blank_lines(x: Column) -> Column:
    """Trailing blanks off the lines, runs of blank lines to one, trimmed."""
    lines = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"), F.lit(" \t\n"))


def newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def grounded(source: Column, quote: Column) -> Column:
    """Whether the quote stands in the source, case and white space aside; blank quotes don't."""
    return (F.trim(quote) != "") & F.contains(normalize_alias(source), normalize_alias(quote))


#: What marks a paragraph as instructions to its reader. Fixed patterns.
INJECTIONS = (
    r"(?i)\b(ignore|disregard|forget)\b.{0,40}\b(previous|prior|above|earlier|all)\b.{0,30}\b(instruction|prompt|rule|direction)",
    r"(?i)\byou are now\b|\bfrom now on you\b|\bact as\b.{0,30}\b(admin|administrator|system|developer)\b",
    r"(?i)\b(admin|administrator|developer|debug|god)\s+mode\b",
    r"(?i)\b(new|updated|revised)\s+(instruction|system prompt|directive)s?\b",
    r"(?i)\b(reveal|print|output|show|repeat)\b.{0,30}\b(system prompt|your instructions|your prompt)\b",
    r"(?i)\b(call|invoke|execute|run)\b.{0,20}\b(tool|function|command|script)\b",
    r"(?i)\bgrant\b.{0,40}\b(access|permission|privilege|admin)\b",
    r"(?i)\b(set|mark|change)\b.{0,40}\b(classification|permission|policy|visibility)\b.{0,20}\b(public|open|none)\b",
    r"(?i)\breport that\b|\bclaim that\b|\bsay that\b.{0,60}\b(is|are|was|were)\b",
)


def paragraphs(x: Column) -> Column:
    return F.split(x, r"\n\n+")


def injection(x: Column) -> Column:
    """The number (from 1) of the first pattern that a paragraph matches, else null."""
    return F.coalesce(*(F.when(x.rlike(p), i) for i, p in enumerate(INJECTIONS, 1)))


def suspicious_paragraphs(x: Column) -> Column:
    return F.filter(paragraphs(x), lambda p: injection(p).isNotNull())


def focus(x: Column, anchors: list[str]) -> Column:
    """The share of the anchors that a text holds."""
    if not anchors:
        return F.lit(0.0)
    return sum((F.contains(F.lower(x), F.lit(a.lower())).cast("int") for a in anchors), F.lit(0)) / float(len(anchors))


#: "USD 12,100", "$12100.50", "12100 USD", "45 %". Fixed pattern.
QUANTITY = r"^\s*(?:([A-Z]{3}|[$€£¥])\s*)?(-?\d[\d,]*(?:\.\d+)?)(?:\s*([A-Z]{3}|%|[A-Za-z]+))?\s*$"


def quantity(x: Column) -> Column:
    """``amount`` (decimal) and ``unit`` of a written quantity; null if it is none, or has a unit on both sides."""
    part = lambda i: F.regexp_extract(x, QUANTITY, i)
    amount = F.regexp_replace(part(2), ",", "").try_cast("decimal(38,6)")
    ok = x.rlike(QUANTITY) & ~((part(1) != "") & (part(3) != ""))
    return F.when(ok, F.struct(amount.alias("amount"), F.when(part(1) != "", part(1)).otherwise(part(3)).alias("unit")))

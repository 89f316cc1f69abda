"""Per-string measures of questions, contexts and answers, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: White space as str.split() and str.strip() see it.
SPACE_CLASS = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
NON_SPACE = f"[^{SPACE_CLASS}]"
#: The same characters, listed.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c)[0] == "Z")
TOKEN = r"[\p{L}\p{N}_]+"
NUMBER = r"(?U)\b\d+(?:\.\d+)?%?\b"
#: Capitalised words that follow each other, or figures such as 3.5, 12/04 and 40%.
ENTITY = r"\p{Lu}[\p{L}\p{N}_]*(?:\x20\p{Lu}[\p{L}\p{N}_]*)*|\p{Nd}+(?:[.,/-]\p{Nd}+)*%?"
#: The phrases that count as hedging.
HEDGES = (
    "maybe", "might", "likely", "possibly", "probably", "could", "seems", "uncertain", "unclear", "allegedly",
    "reportedly", "presumably", "supposedly", "i think", "i believe", "appears to", "it seems",
)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends; null becomes empty."""
    return F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NON_SPACE)


def n_words(text: Column) -> Column:
    return F.size(found(text, NON_SPACE + "+")).cast("long")


def n_sentences(text: Column) -> Column:
    """Non-blank pieces between runs of full stops, exclamation and question marks; 1 at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, "[.!?]+"), lambda s: s.rlike(NON_SPACE)))).cast("long")


def tokens(text: Column) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(found(F.lower(text), TOKEN))


def numbers(text: Column) -> Column:
    return F.array_distinct(found(text, NUMBER))


def entities(text: Column) -> Column:
    """Distinct lower-case entity mentions of a pattern extractor; a table of entities can take its place."""
    return F.array_distinct(F.transform(found(text, ENTITY), F.lower))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase)))) / len(phrase)).cast("long")


def hedge_count(text: Column) -> Column:
    """Occurrences of each phrase, not bound to words, so that a phrase within another counts for both."""
    low = F.lower(text)
    return sum((occurrences(low, h) for h in HEDGES), F.lit(0).cast("long"))

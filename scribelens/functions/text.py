"""Text normalization as column expressions (whole-stage codegen, no Python)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code-point ranges that are written without spaces between words.
CJK = "[㐀-䶿一-鿿぀-ゟ゠-ヿ가-힯]"
_SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """Runs of (Unicode) white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def basic_normalize(text: Column) -> Column:
    """Lower case, the 32 ASCII punctuation characters deleted, white space collapsed."""
    return collapse(F.translate(F.lower(text), string.punctuation, ""))


def space_cjk(text: Column) -> Column:
    """A space on both sides of every CJK character."""
    return F.regexp_replace(text, f"({CJK})", " $1 ")


def strip_parentheses(text: Column) -> Column:
    """Bracketed passages, half or full width, deleted."""
    return F.regexp_replace(text, "[(（][^)）]+?[)）]", "")


def language_subtag(language: Column) -> Column:
    """en_us, en-GB: en."""
    return F.regexp_extract(F.lower(F.coalesce(language, F.lit(""))), "^[^_-]*", 0)


def normalize(text: Column, *, own=None, language: Column | None = None) -> Column:
    """Null and '' to ''. ``own(text, language)`` may bring a stronger normalizer; without it the basic one is used."""
    text = F.coalesce(text, F.lit(""))
    if own is None:
        return F.trim(space_cjk(basic_normalize(text)))
    return collapse(space_cjk(F.trim(own(strip_parentheses(text), language_subtag(F.lit("en") if language is None else language)))))


def tokens(normalized: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(normalized, _SPACE), lambda w: w != "")


def tokenize(text: Column, **options) -> Column:
    return tokens(normalize(text, **options))


def fuzzy_form(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and spaces."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")


def word_form(word: Column, digits: bool = True) -> Column:
    """Lower case, only a-z (and 0-9)."""
    return F.regexp_replace(F.lower(word), "[^a-z0-9]" if digits else "[^a-z]", "")


def core(word: Column) -> Column:
    """Without the punctuation at both ends."""
    return F.btrim(word, F.lit(".,;:!?\"'"))


def masked_form(text: Column) -> Column:
    """Lower case, digits and letters apart, punctuation to spaces."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(text), "(?U)(?<=\\d)(?=[^\\W\\d_])", " "), "(?U)(?<=[^\\W\\d_])(?=\\d)", " ")
    return collapse(F.regexp_replace(apart, "(?U)[^\\w\\s]", " "))


def book_words(text: Column) -> Column:
    """array<struct<norm, read, ends>>: words of a book with typographic quotes and dashes folded; ``ends`` marks ends of sentences."""
    folded = F.translate(text, "‘’“”", "''\"\"")
    parts = F.split(F.regexp_replace(folded, "[–—-]+", " "), _SPACE)
    each = F.transform(parts, lambda w: F.struct(word_form(w).alias("norm"), F.regexp_replace(w, "[^A-Za-z0-9']", "").alias("read"), w.rlike("[.!?][\"')]*$").alias("ends")))
    return F.filter(each, lambda w: w["norm"] != "")


def between_markers(text: Column) -> Column:
    """The body between a digital book's START and END lines; all of it without them."""
    after = F.regexp_replace(text, r"(?is)^.*?\*\*\* ?START OF[^\n]*\n", "")
    return F.btrim(F.regexp_replace(after, r"(?is)\*\*\* ?END OF.*$", ""), F.lit(" \t\r\n"))


def plain_markup(text: Column) -> Column:
    """Tags deleted, the common entities resolved, white space collapsed."""
    out = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)

"""Secret scanning: known forms, and high-entropy strings by sliding windows.

Known forms are regular expressions; a match's place is found from the pieces between the
matches, so everything stays in DataFrame functions. Candidates for the entropy scan are
long runs of key-like characters. Over each candidate a window slides by one character:
the counts of the characters in it are updated by one in and one out, and with them the sum
of c*log2(c), from which the window's Shannon entropy follows. A candidate is reported if
some window exceeds the limit of its character class and no allow-list pattern suppresses it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import temporary

#: The known kinds in the order in which spans are listed.
ASSIGN = r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: A candidate for the entropy scan, and the alphabet whose counts a window holds.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Limits in bits by character class; a class is the first whose pattern a candidate matches.
CLASSES = (("hex", "^[0-9a-fA-F-]+$", 2.8), ("lower", "^[a-z_=/-]+$", 4.0), ("letters", "^[A-Za-z_=/-]+$", 3.9), ("mixed", "", 3.6))
#: Suppressed: plain numbers and dates, a run of one character, words that mark samples, words joined by dashes or slashes or by capitals, capitals alone.
ALLOWED = (r"^[0-9_/=+-]+$", r"(.)\1{7}", r"(?i)example|sample|dummy|placeholder|changeme|lorem", r"^[A-Za-z]+(?:[-_/][A-Za-z]+)+$", r"^[A-Z]?[a-z]+(?:[A-Z][a-z]+)+$", r"^[A-Z]+$")

_SPANS = "array<struct<kind:string,start:int,end:int,found:string>>"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, zero: Column, merge) -> Column:
    """For each place of an array of integers ``merge`` of all values up to it.

    In blocks of the root of the array's size, so that no array is built up value by value.
    """

    def upto(x):
        return F.transform(x["v"], lambda _, i: F.aggregate(F.slice(x["v"], F.floor(i / x["b"]).cast("int") * x["b"] + 1, i % x["b"] + 1), F.get(x["before"], F.floor(i / x["b"]).cast("int")), merge))

    def blocks(x):
        starts = F.sequence(F.lit(0), F.greatest(F.size(x["v"]) - 1, F.lit(0)), x["b"])
        sums = F.transform(starts, lambda s: F.aggregate(F.slice(x["v"], s + 1, x["b"]), zero, merge))
        before = lambda y: F.transform(y, lambda _, i: F.aggregate(F.slice(y, 1, i), zero, merge))
        return _let(F.struct(x["v"].alias("v"), x["b"].alias("b"), _let(sums, before).alias("before")), upto)

    return _let(values, lambda v: _let(F.struct(v.alias("v"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")).alias("b")), blocks))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Spans of all matches from the left, in code points. Looking is done once; pieces are cut only where something was found."""
    none = F.array().cast(_SPANS)

    def placed(found):
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))  # the text before each match
        ends = running(F.zip_with(found, pieces, lambda m, p: F.length(m) + F.length(p)), F.lit(0), lambda a, x: a + x)
        return F.zip_with(found, ends, lambda m, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("found"))).cast(_SPANS)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


#: Counts of a window are digits of six bits, ten to a number.
_DIGITS = 10
_NUMBERS = -(-(len(ALPHABET) + 1) // _DIGITS)


def window_entropy(candidate: Column, window: int = 20) -> Column:
    """The largest Shannon entropy, in bits, of any ``window`` characters in a row (of the whole, if shorter); at most 60.

    Each step adds one to the count of the character that enters and takes one from that of
    the character that leaves; the counts are digits of a few numbers.
    """
    if not 1 <= window <= 60:
        raise ValueError("a window has 1 to 60 characters")
    places = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    left = F.slice(F.concat(F.array_repeat(F.lit(-1), window), places), 1, F.size(places))
    moves = F.zip_with(places, left, lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    logs = F.array(*(F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)))
    ones = F.array(*(F.lit(1 << 6 * i).cast("long") for i in range(_DIGITS)))

    def step(state, move):
        new, old = move["new"], move["old"]
        counts = [state[f"c{i}"] for i in range(_NUMBERS)]

        def count(place):
            number = counts[-1]
            for i in reversed(range(_NUMBERS - 1)):
                number = F.when(place < _DIGITS * (i + 1), counts[i]).otherwise(number)
            return F.call_function("shiftright", number, place % _DIGITS * 6).bitwiseAND(F.lit(63)).cast("int")

        n_new, n_old = count(new), count(old)
        entered = state["total"] - F.get(logs, n_new) + F.get(logs, n_new + 1)
        total = F.when(old == new, state["total"]).when(old < 0, entered).otherwise(entered - F.get(logs, n_old) + F.get(logs, n_old - 1))
        change = lambda place, i: F.when((place >= _DIGITS * i) & (place < _DIGITS * (i + 1)), F.get(ones, place % _DIGITS)).otherwise(F.lit(0).cast("long"))
        moved = [(c + change(new, i) - change(old, i)).alias(f"c{i}") for i, c in enumerate(counts)]
        size = F.least(state["size"] + 1, F.lit(window))
        bits = F.log2(size.cast("double")) - total / size
        best = F.when(size == window, F.greatest(state["best"], bits)).otherwise(state["best"])
        return F.struct(*moved, total.alias("total"), size.alias("size"), bits.alias("bits"), best.alias("best"))

    start = F.struct(*(F.lit(0).cast("long").alias(f"c{i}") for i in range(_NUMBERS)), F.lit(0.0).alias("total"), F.lit(0).alias("size"), F.lit(0.0).alias("bits"), F.lit(0.0).alias("best"))
    return F.aggregate(moves, start, step, lambda s: F.greatest(s["best"], F.when(s["size"] < window, s["bits"]).otherwise(0.0)))


def _suspicious(found: Column, window: int, classes: Sequence[tuple[str, str, float]], allowed: Sequence[str]) -> Column:
    limit = F.lit(classes[-1][2])
    for _, pattern, bits in reversed(classes[:-1]):
        limit = F.when(found.rlike(pattern), F.lit(bits)).otherwise(limit)
    suppressed = F.lit(False)
    for pattern in allowed:
        suppressed = suppressed | found.rlike(pattern)
    # the patterns are looked at first; only what they leave is measured
    return F.when(suppressed, False).otherwise(window_entropy(found, window) >= limit)


def spans(text: Column, *, window: int = 20, classes: Sequence[tuple[str, str, float]] = CLASSES, allowed: Sequence[str] = ALLOWED) -> Mapping[str, Column]:
    """Spans by kind: array of struct(kind, start, end, found); start and end in code points, end exclusive."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    value = lambda s: F.regexp_extract(s["found"], ASSIGN, 1)
    return {
        "assign": F.filter(_matches(text, "assign", ASSIGN), lambda s: F.length(value(s)) >= 6),
        "access": _matches(text, "access", ACCESS),
        "hex": _matches(text, "hex", HEX),
        "entropy": F.filter(_matches(text, "entropy", CANDIDATE), lambda s: _suspicious(s["found"], window, classes, allowed)),
    }


def _listed(found: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    order = F.transform(found, lambda s: F.struct(s["start"], F.array_position(F.array(*(F.lit(k) for k in KINDS)), s["kind"]).alias("place"), s["end"], s["kind"]))
    return F.array_join(F.transform(F.sort_array(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, assign, access, hex, entropy, base, all) of every row: spans by kind, and their listings as text.

    Null and empty texts have no spans. Matches of one kind don't overlap, those of different
    kinds may; spans with one start are listed in the order of their kinds. Very long texts
    are read whole. Rows are judged one by one, repeated ones alike; other columns are
    ignored; no rows give no rows.
    """
    found = documents.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in spans(F.col(text_col), **options).items()))
    base = F.concat("assign", "access", "hex")
    return found.select("id", *KINDS, _listed(base).alias("base"), _listed(F.concat(base, "entropy")).alias("all"))


def _cut(text: Column, pieces: Column, block: int = 4096) -> Column:
    """The pieces (array of struct(a, b)) of a text, by blocks of it, so that none is looked for from the text's start."""
    blocks = F.transform(F.sequence(F.lit(0), F.length(text), F.lit(block)), lambda s: F.substring(text, s + 1, F.lit(block)))

    def piece(bs, p):
        first = F.floor(p["a"] / block).cast("int")
        held = F.array_join(F.slice(bs, first + 1, F.floor(p["b"] / block).cast("int") - first + 1), "")
        return F.substring(held, p["a"] - first * block + 1, p["b"] - p["a"])

    return _let(blocks, lambda bs: F.transform(pieces, lambda p: piece(bs, p)))


def redacted(documents: DataFrame, *, text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """``documents`` with each span of its texts (overlapping ones together) replaced by ``mark``; texts without one stay.

    Null texts stay null, repeated rows are treated alike, all rows and other columns stay.
    The work on a text grows little faster than its length and the number of its spans.
    """
    text = F.col(text_col).cast("string")
    found = F.concat(*(F.transform(c, lambda s: F.struct(s["start"], s["end"])) for c in spans(F.col(text_col), **options).values()))

    def whole(sorted_):
        # where a span begins beyond all ends before it, the text since them is kept
        ends = running(F.transform(sorted_, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
        gaps = _let(ends, lambda e: F.transform(sorted_, lambda s, i: F.struct(F.coalesce(F.get(e, i - 1), F.lit(0)).alias("a"), s["start"].alias("b"))))
        last = F.struct(F.array_max(F.transform(sorted_, lambda s: s["end"])).alias("a"), F.length(text).alias("b"))
        fresh = F.filter(gaps, lambda g: g["b"] >= g["a"])
        return F.array_join(_cut(text, F.concat(fresh, F.array(last))), mark)

    (name,) = temporary(documents, "found")
    marked = documents.withColumn(name, found)
    return marked.withColumn(text_col, F.when(F.size(name) > 0, _let(F.sort_array(F.col(name)), whole)).otherwise(text)).drop(name)

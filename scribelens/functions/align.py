"""Token alignment: one Arrow UDF finds the operations, column expressions read them.

The operations are Ratcliff-Obershelp ones (the longest block first, the earliest on ties),
as difflib finds them with its junk heuristic off. They are found once for each pair and
then reused; everything after is JVM-side. Only pairs that differ are sent to Python, and
difflib runs only for those whose blocks don't follow from what they share at their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .stats import first_mode

#: Types as objects: a type given as text would need a session when this module is imported.
OPS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("i1", "i2", "j1", "j2"))]))
_OP = pa.struct([("tag", pa.string()), *((n, pa.int32()) for n in ("i1", "i2", "j1", "j2"))])


def _each_once(pairs, f) -> list:
    """f of each pair, reckoned once for equal pairs of a batch: most models write most clips alike."""
    known: dict = {}
    out = []
    for a, b in pairs:
        if (key := (a, b)) not in known:
            known[key] = f(a, b)
        out.append(known[key])
    return out


#: Codes of tokens are characters beyond the surrogates, so that pairs of token arrays are compared as texts.
_FIRST_CODE, _CODES = 0xE000, 0x110000 - 0xE000


def _token_pairs(left: pa.Array, right: pa.Array) -> Iterator[tuple]:
    """Each row's two token arrays as texts of one character a token (as tuples in a batch of more tokens than characters); null counts as empty."""
    values = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode(null_encoding="encode")
    if len(values.dictionary) > _CODES:
        yield from ((tuple(a or ()), tuple(b or ())) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True))
        return
    text = (values.indices.to_numpy(zero_copy_only=False).astype("<u4") + _FIRST_CODE).tobytes().decode("utf-32-le")
    i, j = 0, len(left.flatten())
    for n, m in zip(*(pc.fill_null(pc.list_value_length(x), 0).to_pylist() for x in (left, right)), strict=True):
        yield text[i : i + n], text[j : j + m]
        i, j = i + n, j + m


def _head(a, b) -> int:
    """Length of what two sequences share at their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _crossing(x: str, y: str, h: int, t: int, around: int) -> int:
    """A bound of the texts in x and y that touch what x has between its first h and its last t characters.

    Where ``around`` characters before it with its first one aren't in y, none begins as early
    as that; likewise after it.
    """
    n = len(x) - h - t
    early = h if h < around or x[h - around : h + 1] in y else around - 1
    late = t if t < around or x[h + n - 1 : h + n + around] in y else around - 1
    return n + early + late


def _blocks(a, b, around: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the blocks that difflib matches.

    What two texts share at an end is taken off while it is provably the block that difflib
    takes first: none is longer, and of those as long it stands first in a, then in b. difflib
    gets what remains.
    """
    front, back, i, j = [], [], 0, 0
    while a and b:
        if isinstance(a, str):
            if (at := a.find(b)) >= 0:
                front.append((i + at, j, len(b)))
                break
            if (at := b.find(a)) >= 0:
                front.append((i, j + at, len(a)))
                break
            h = _head(a, b)
            n, m = len(a), len(b)
            t = _head(a[h:][::-1], b[h:][::-1])
            most = _crossing(b, a, h, t, around) if h + t < m else _crossing(a, b, h, t, around)
            if h >= t and h >= most:
                front.append((i, j, h))
                a, b, i, j = a[h:], b[h:], i + h, j + h
                continue
            if t > h and t > most and (a.find(a[n - t :]) == n - t if h + t < m else b.find(b[m - t :]) == m - t):
                back.append((i + n - t, j + m - t, t))
                a, b = a[: n - t], b[: m - t]
                continue
        front += ((i + p, j + q, k) for p, q, k in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1])
        break
    return front + back[::-1]


def _ops(a, b) -> list[tuple]:
    i = j = 0
    ops = []
    for p, q, k in [*_blocks(a, b, 1), (len(a), len(b), 0)]:
        if i < p or j < q:
            ops.append(("replace" if i < p and j < q else "delete" if i < p else "insert", i, p, j, q))
        i, j = p + k, q + k
        if k:
            ops.append(("equal", p, i, q, j))
    return ops


@arrow_udf(OPS)
def align_ops_udf(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in pairs:
        # equal pairs are aligned, and written out, once
        places: dict = {}
        offsets, flat, which = [0], [], []
        for pair in _token_pairs(left, right):
            if (at := places.get(pair)) is None:
                at = places[pair] = len(places)
                flat.extend(_ops(*pair))
                offsets.append(len(flat))
            which.append(at)
        columns = list(zip(*flat, strict=True)) if flat else [()] * len(_OP)
        found = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _OP, strict=True)], fields=list(_OP))
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found).take(pa.array(which, pa.int32()))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _count(tokens: Column) -> Column:
    return F.coalesce(F.size(tokens), F.lit(0))


def align_ops(ref: Column | str, hyp: Column | str) -> Column:
    """Operations that turn the first token array into the second.

    Equal pairs, and those without a hypothesis, don't leave the JVM.
    """
    a, b = _column(ref), _column(hyp)
    n = _count(a)
    one = lambda tag, end: F.array(F.struct(F.lit(tag).alias("tag"), F.lit(0).alias("i1"), n.alias("i2"), F.lit(0).alias("j1"), end.alias("j2"))).cast(OPS)
    same, silent = a.eqNullSafe(b), _count(b) == 0
    other = ~same & ~silent
    return F.when(silent & (n == 0), F.array().cast(OPS)).when(same, one("equal", n)).when(silent, one("delete", F.lit(0))).otherwise(align_ops_udf(F.when(other, a), F.when(other, b)))


def _coverage(a: str, b: str) -> float:
    a, b = "".join(a.split()), "".join(b.split())
    if not a:
        return 1.0 if b else 0.0
    if a == b or not b:
        return 0.0 if b else 1.0
    return 1.0 - sum(k for _, _, k in _blocks(a, b, 4)) / len(a)


@arrow_udf(T.DoubleType())
def char_cer_udf(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in pairs:
        texts = ((a or "", b or "") for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True))
        yield pa.array(_each_once(texts, _coverage), pa.float64())


def char_cer(ref: Column | str, hyp: Column | str) -> Column:
    """Share of the first text's characters (white space aside) in no block matched in the second."""
    a, b = _column(ref), _column(hyp)
    same = a.eqNullSafe(b)
    return F.when(same, F.lit(0.0)).otherwise(char_cer_udf(F.when(~same, a), F.when(~same, b)))


@arrow_udf(T.DoubleType())
def median_cer(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """How unlike a stretch of reference is to what models wrote there instead (a text, and an array of texts): the upper median of :func:`char_cer`, 1 without any."""
    for chunks, written in batches:
        each = (sorted(_each_once(((text or "", w) for w in ws or ()), _coverage)) for text, ws in zip(chunks.to_pylist(), written.to_pylist(), strict=True))
        yield pa.array([x[len(x) // 2] if x else 1.0 for x in each], pa.float64())


def missed_flags(ops: Column) -> Column:
    """For each reference position 1 if it was deleted or replaced, else 0."""
    return F.flatten(F.transform(ops, lambda o: F.array_repeat(o["tag"].isin("delete", "replace").cast("int"), o["i2"] - o["i1"])))


def missed_indices(ops: Column) -> Column:
    """Reference positions that were deleted or replaced."""
    gone = F.filter(ops, lambda o: o["tag"].isin("delete", "replace") & (o["i2"] > o["i1"]))
    return F.flatten(F.transform(gone, lambda o: F.sequence(o["i1"], o["i2"] - 1)))


def missed_count(ops: Column) -> Column:
    """How many reference positions were deleted or replaced."""
    return F.aggregate(ops, F.lit(0), lambda n, o: n + F.when(o["tag"].isin("delete", "replace"), o["i2"] - o["i1"]).otherwise(0))


def first_missed(ops: Column) -> Column:
    """The first reference position that was deleted or replaced; null for none."""
    return F.get(F.filter(ops, lambda o: o["tag"].isin("delete", "replace")), F.lit(0))["i1"]


def matched_count(ops: Column) -> Column:
    """Reference positions reproduced."""
    return F.aggregate(ops, F.lit(0), lambda n, o: n + F.when(o["tag"] == "equal", o["i2"] - o["i1"]).otherwise(0))


def substitution_at(ops: Column, hyp: Column, first: Column, end: Column) -> Column:
    """Text of the whole replacements that overlap reference positions first..end-1."""
    over = F.filter(ops, lambda o: (o["tag"] == "replace") & (o["i1"] < end) & (o["i2"] > first))
    return F.array_join(F.flatten(F.transform(over, lambda o: F.slice(hyp, o["j1"] + 1, o["j2"] - o["j1"]))), " ")


def replacements(ops: Column, hyp: Column) -> Column:
    """array<struct<i1, i2, tokens>>: replaced reference positions and what stands there instead."""
    return F.transform(F.filter(ops, lambda o: o["tag"] == "replace"), lambda o: F.struct(o["i1"].alias("i1"), o["i2"].alias("i2"), F.slice(hyp, o["j1"] + 1, o["j2"] - o["j1"]).alias("tokens")))


def replaced_within(replaced: Column, first: Column, end: Column) -> Column:
    """:func:`substitution_at` of :func:`replacements`."""
    over = F.filter(replaced, lambda o: (o["i1"] < end) & (o["i2"] > first))
    return F.array_join(F.flatten(F.transform(over, lambda o: o["tokens"])), " ")


def insertion_at(ops: Column, hyp: Column, anchor: Column) -> Column:
    """Tokens purely inserted before reference position ``anchor``."""
    here = F.filter(ops, lambda o: (o["tag"] == "insert") & (o["i1"] == anchor))
    return F.flatten(F.transform(here, lambda o: F.slice(hyp, o["j1"] + 1, o["j2"] - o["j1"])))


def insertions_by_anchor(ops: Column, hyp: Column) -> Column:
    """map: reference position to the tokens inserted before it."""
    entries = F.transform(F.filter(ops, lambda o: o["tag"] == "insert"), lambda o: F.struct(o["i1"], F.slice(hyp, o["j1"] + 1, o["j2"] - o["j1"])))
    return F.map_from_entries(entries)


def consensus_prefix(lists: Column, threshold: Column) -> Column:
    """Tokens that at least ``threshold`` of the lists share at each distance from their start, up to the first distance without.

    The most frequent token counts, the first seen on ties. For insertions before a text,
    pass reversed lists and reverse the result.
    """
    longest = F.aggregate(lists, F.lit(0), lambda n, x: F.greatest(n, F.size(x)))

    def step(state, k):
        best = first_mode(F.filter(F.transform(lists, lambda x: F.get(x, k)), lambda t: t.isNotNull()))
        go = state["on"] & F.coalesce(best["n"] >= threshold, F.lit(False))
        return F.struct(F.when(go, F.concat(state["kept"], F.array(best["token"]))).otherwise(state["kept"]).alias("kept"), go.alias("on"))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("on"))
    return F.when(longest > 0, F.aggregate(F.sequence(F.lit(0), longest - 1), start, step, lambda s: s["kept"])).otherwise(F.array().cast("array<string>"))


def emitted(inserted: Column, consensus: Column) -> Column:
    """Whether the list begins with a consensus that isn't empty."""
    n = F.size(consensus)
    return (n > 0) & (F.size(inserted) >= n) & (F.slice(inserted, 1, n) == consensus)


def corrected(ref: Column, dropped: Column, at_start: Column, at_end: Column) -> Column:
    """Reference tokens without the dropped positions, between what is inserted at both ends."""
    kept = F.transform(F.filter(F.transform(ref, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: ~F.array_contains(dropped, x["i"])), lambda x: x["t"])
    return F.concat(at_start, kept, at_end)


def edit_span_chars(a: Column, b: Column) -> Column:
    """Characters of what remains of ``a`` without the tokens that both arrays share at their start and end."""

    def shared(x, y):
        n = F.least(F.size(x), F.size(y))
        differs = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p != q)
        at = F.array_position(differs, True)
        return F.when(at > 0, (at - 1).cast("int")).otherwise(n)

    # a lambda names what it is given, so that it is found once: column expressions with lambdas aren't shared
    named = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    rest = lambda x, n: F.slice(x, n + 1, F.size(x))
    both = named(shared(a, b), lambda n: F.struct(rest(a, n).alias("a"), rest(b, n).alias("b")))
    left = named(both, lambda x: F.slice(x["a"], 1, F.size(x["a"]) - shared(F.reverse(x["a"]), F.reverse(x["b"]))))
    return F.when(a == b, F.lit(0)).otherwise(F.aggregate(left, F.lit(0), lambda n, t: n + F.length(t)))


def _distance(a, b) -> int:
    # what both share at their ends costs nothing
    head = _head(a, b)
    a, b = a[head:][::-1], b[head:][::-1]
    tail = _head(a, b)
    a, b = a[tail:], b[tail:]
    if min(len(a), len(b)) < 2:
        # of one token against some all are edits but for one that is the same
        return max(len(a), len(b)) - (bool(a and b) and (a[0] in b if len(a) == 1 else b[0] in a))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@arrow_udf(T.IntegerType())
def token_edits_udf(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in pairs:
        yield pa.array(_each_once(_token_pairs(left, right), _distance), pa.int32())


def token_edits(ref: Column | str, hyp: Column | str) -> Column:
    """Levenshtein distance of two token arrays of any size; equal and empty ones don't leave the JVM."""
    a, b = _column(ref), _column(hyp)
    n, m = _count(a), _count(b)
    other = ~a.eqNullSafe(b) & (n > 0) & (m > 0)
    return F.when((n == 0) | (m == 0), n + m).when(~other, 0).otherwise(token_edits_udf(F.when(other, a), F.when(other, b)))


@arrow_udf(T.ArrayType(T.IntegerType()))
def block_map(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """For each token of the first array its place in the second by matching blocks; -1 for none."""
    for left, right in pairs:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            places = [-1] * len(a or ())
            for m in SequenceMatcher(None, a or [], b or [], autojunk=False).get_matching_blocks():
                for k in range(m.size):
                    places[m.a + k] = m.b + k
            out.append(places)
        yield pa.array(out, pa.list_(pa.int32()))

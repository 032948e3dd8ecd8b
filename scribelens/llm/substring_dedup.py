"""Substring deduplication by hashing lines, sentences of longer lines and runs of short sentences.

Units are normalised (lower case, white space collapsed) and grouped by a 128-bit digest
over the whole corpus. Of equal units the one that ranks first (smallest id, then place in
the table, then offset) stays; all others are reported with their offsets in the original
text. A sentence is reported only if its line isn't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import stored, temporary

_SENTENCE_END = re.compile(r"[.!?]+\s+")
_UNIT = pa.struct([("line", pa.int32()), ("whole", pa.bool_()), ("first", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
_UNITS = "array<struct<line:int,whole:boolean,first:int,end:int,n_words:int,high:bigint,low:bigint>>"


def units_of(text: str, least_words: int = 8, sentences: bool = True, least_line: int | None = None) -> list[tuple]:
    """(line number, whether it is the whole line, start, end, words, digest's halves) of each unit of a text; offsets in code points.

    Units are lines of ``least_line`` words or more (None: ``least_words``), sentences of
    ``least_words`` or more, and for each shorter sentence the fewest sentences from it on,
    and up to it, that have as many. Such runs begin at every short sentence, so a passage is
    made of the same units whatever stands around it, but a stray short sentence is none.
    """
    least_line = least_words if least_line is None else least_line
    out = []

    def add(line, whole, a, b, found):
        digest = xxhash.xxh3_128_intdigest(" ".join(found))
        out.append((line, whole, a, b, len(found), (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)))

    begin = 0
    for number, line in enumerate(text.split("\n")):
        end = begin + len(line)
        cuts = [begin, *(m.end() for m in _SENTENCE_END.finditer(text, begin, end)), end] if sentences else [begin, end]
        words, parts = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if found := text[a:b].lower().split():
                parts.append((a, b, len(words), len(words) + len(found)))
                words += found
        if words and len(words) >= least_line:
            add(number, True, begin, end, words)
        if len(parts) > 1:
            runs = set()
            for i, part in enumerate(parts):
                i_end, i_begin = i, i
                while i_end < len(parts) - 1 and parts[i_end][3] - part[2] < least_words:
                    i_end += 1
                while i_begin and part[3] - parts[i_begin][2] < least_words:
                    i_begin -= 1
                runs |= {(i, i_end), (i_begin, i)}
            for i, j in sorted(runs):
                if least_words <= parts[j][3] - parts[i][2] and j - i < len(parts) - 1:
                    add(number, False, parts[i][0], parts[j][1], words[parts[i][2] : parts[j][3]])
        begin = end + 1
    return out


def _units(least_words: int, sentences: bool, least_line: int | None):
    @arrow_udf(_UNITS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, offsets = [], [0]
            for text in batch:
                rows.extend(units_of(text.as_py() or "", least_words, sentences, least_line))
                offsets.append(len(rows))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_UNIT)
            units = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _UNIT, strict=True)], fields=list(_UNIT))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), units)

    return run


def repeated(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 8, sentences: bool = True, least_line: int | None = None) -> DataFrame:
    """One row for each unit to remove: (row, id, first, end, n_words, digest, kept_id, kept_first).

    ``row`` tells repeated ids apart; first and end are offsets in code points, end
    exclusive; kept_id and kept_first say where the unit stays. Ids rank in order, null
    last, then rows by their place in the table, then offsets, so of repeated rows and ties
    all but one are reported. Units are those of :func:`units_of`; runs of short sentences may
    overlap each other, but none overlaps the place where it stays, so the first place of each
    sentence stays whatever units it is in. Null and empty texts
    have no units, texts of any length count whole; other columns are ignored; no rows give no rows.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _units(least_words, sentences, least_line)(F.col(text_col).cast("string")).alias("units"))
    units = stored(rows.select("row", "id", F.inline("units")), "units")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row", "first", "end")
    # counted and ranked where they are read, so that a hot unit is one row a task
    groups = units.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(rank).alias("kept")).where("n > 1").drop("n")
    found = units.join(stored(groups, "groups"), ["high", "low"])
    # a line and its only sentence share an offset but are one unit: only lines of several sentences have both
    found = stored(found.where((F.col("row") != F.col("kept.row")) | (F.col("first") >= F.col("kept.end"))), "found")
    lines = found.where("whole").select("row", "line")
    kept = found.where("whole").unionByName(found.where("not whole").join(lines, ["row", "line"], "left_anti").select(found.columns))
    digest = F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0"))
    return kept.select("row", "id", "first", "end", "n_words", F.lower(digest).alias("digest"), F.col("kept.id").alias("kept_id"), F.col("kept.first").alias("kept_first"))


def deduplicated(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` with the units to remove (see :func:`repeated`) cut out of their texts; all rows and columns stay."""
    (row, cuts) = temporary(documents, "row", "cuts")
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "documents")
    ranked = numbered.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("id"), F.col(text_col).alias("text"))
    spans = repeated(ranked, id_col="id", text_col="text", **options).groupBy(F.col("id.row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias(cuts))
    joined = numbered.join(spans, row, "left")
    text = F.col(text_col).cast("string")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(x["first"] - s["at"], F.lit(0)))).alias("out"))
    whole = F.aggregate(F.col(cuts), state, cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])))
    return joined.withColumn(text_col, F.when(F.col(cuts).isNotNull(), whole).otherwise(text)).drop(row, cuts)

"""Order-dependent operators over windows: first rows, runs, fills, caps, nearest places."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_rows(df: DataFrame, keys: Sequence[str], n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows of each key, numbered in column rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def islands(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """keys, first, last, n: maximal runs of consecutive integer positions."""
    w = Window.partitionBy(*keys).orderBy(position)
    grouped = df.select(*keys, position).distinct().withColumn("_island", F.col(position) - F.row_number().over(w))
    return grouped.groupBy(*keys, "_island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("_island")


def filled_end(df: DataFrame, keys: Sequence[str], order: str, value: str) -> Column:
    """The last value so far, 0.0 before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0.0))


def neighbours(keys: Sequence[str], order: str, start: str = "t0", end: str = "t1") -> tuple[Column, Column]:
    """The end of the word before and the start of the word after."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.lag(end).over(w), F.lead(start).over(w)


def capped(df: DataFrame, keys: Sequence[str], order: str, amount: str, *, most_rows: int = 5, most: float = 2400.0, skip_first: bool = True) -> DataFrame:
    """Rows in order while fewer than ``most_rows`` were taken and their amounts so far are under ``most``."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_place", F.row_number().over(w))
    if skip_first:
        rows = rows.where("_place > 1")
    before = F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"_before": before, "_taken": F.row_number().over(w)}).where((F.col("_before") < most) & (F.col("_taken") <= most_rows)).drop("_place", "_before", "_taken")


def nearest_position(positions: Column, least: Column) -> Column:
    """The smallest of an array's positions that is at least ``least``; without one the nearest below."""
    ranked = F.array_sort(F.transform(positions, lambda p: F.struct((p < least).alias("under"), F.abs(p - least).alias("away"), p.alias("p"))))
    return F.get(ranked, F.lit(0))["p"]


def overlaps(left: DataFrame, right: DataFrame, key: str, *, width: float = 10.0, start: str = "start", end: str = "end") -> DataFrame:
    """Interval join on a key, cut to what both share: key, l_start, l_end, r_start, r_end, start, end.

    Both sides are dealt into bins of ``width`` so that the join is on equality; a pair is
    kept in the bin in which its overlap begins, so none comes twice.
    """
    binned = lambda df, side: df.select(F.col(key), F.col(start).alias(f"{side}_start"), F.col(end).alias(f"{side}_end"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))).alias("_bin"))
    both = binned(left, "l").join(binned(right, "r"), [key, "_bin"])
    first, last = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    return both.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.floor(first / width) == F.col("_bin"))).select(key, "l_start", "l_end", "r_start", "r_end", first.alias(start), last.alias(end))


def candidate_dates(df: DataFrame, date: str, *, days: int = 16) -> DataFrame:
    """Each row with every weekday within ``days`` days of its date, the nearest first (column rank)."""
    each = df.withColumn("away", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn("candidate", F.date_add(date, F.col("away")))
    nearest = Window.partitionBy(*df.columns).orderBy(F.abs("away"), "away")
    return each.where(F.weekday("candidate") <= 4).withColumn("rank", F.row_number().over(nearest))


def dates_with_origins(df: DataFrame, date: str, origin: str, *, days: int = 16) -> DataFrame:
    """candidate date, origins: the union of all rows' candidate dates and which rows asked for each."""
    return candidate_dates(df.select(date, origin), date, days=days).groupBy("candidate").agg(F.array_sort(F.collect_set(origin)).alias("origins"))


def near_dates(left: DataFrame, right: DataFrame, date: str, other: str, *, days: int = 16) -> DataFrame:
    """Range join of rows whose dates are within ``days`` days, as an equality join on candidate dates."""
    return candidate_dates(left, date, days=days).join(right.withColumnRenamed(other, "candidate"), "candidate")


def nearest_before(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """As-of join: each left row with the last right value at or before its time, by one union and one window."""
    marked = left.select(key, time, F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("_side")).unionByName(right.select(key, time, F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), value, F.lit(0).alias("_side")))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").select("_row.*", value)


def _pieces(speech: list[tuple[float, float]], least: float, most: float) -> list[tuple[float, float]]:
    """Speech, in order, in pieces of ``most`` seconds: a piece that the next segment would make too long ends amid the silence before it; a longer segment is cut evenly."""
    pieces = []
    first = last = None
    for a, b in speech:
        if first is not None and b - first > most:
            pieces.append((first, (last + a) / 2))
            first = None
        first, last = (a if first is None else first), b
    if first is not None:
        pieces.append((first, last))
    out = []
    for a, b in pieces:
        n = max(1, math.ceil((b - a) / most))
        out += [(a + (b - a) * i / n, a + (b - a) * (i + 1) / n) for i in range(n)]
    return [(a, b) for a, b in out if b - a >= least]


def turn_clips(turns: DataFrame, *, least: float = 5.0, most: float = 20.0) -> DataFrame:
    """(turn columns, start, end) of (start, end, speech: array of struct(start, end)) rows.

    Short turns go, turns of up to ``most`` seconds stay as they are, longer ones are split
    where they are silent. Each row is one turn, so nothing is grouped.
    """
    others = [f for f in turns.schema if f.name not in ("start", "end", "speech")]
    length = F.col("end") - F.col("start")
    whole = turns.where((length >= least) & (length <= most)).select(*(f.name for f in others), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))

    @F.arrow_udf("array<struct<start:double,end:double>>")
    def split(starts: pa.Array, ends: pa.Array, speech: pa.Array) -> pa.Array:
        out = []
        for a, b, segments in zip(starts.to_pylist(), ends.to_pylist(), speech.to_pylist(), strict=True):
            inside = sorted((max(s["start"], a), min(s["end"], b)) for s in segments or () if s["end"] > a and s["start"] < b)
            out.append([{"start": x, "end": y} for x, y in _pieces(inside, least, most)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())])))

    cut = turns.where(length > most).select(*(f.name for f in others), F.inline(split(F.col("start").cast("double"), F.col("end").cast("double"), F.col("speech"))))
    return whole.unionByName(cut)


def _is_number(word: str, names: frozenset[str]) -> bool:
    return any(c.isdigit() for c in word) or word in names


def _chapter_clips(words, places, book, shortest, enough, longest, least_match, fewest, names):
    """Greedy clips of one chapter: from an anchored word to the first sentence end after ``enough`` seconds, else the last one after ``shortest``."""
    at = 0
    while at < len(words):
        stop = None
        if places[at] >= 0:
            for j in range(at, len(words)):
                length = words[j]["t1"] - words[at]["t0"]
                if length > longest:
                    break
                if places[j] >= 0 and length >= shortest and book[places[j]]["ends"]:
                    stop = j
                    if length >= enough:
                        break
        if stop is None:
            at += 1
            continue
        first, last = places[at], places[stop]
        if last < first:
            at = stop + 1
            continue
        heard = {places[k] for k in range(at, stop + 1) if first <= places[k] <= last and words[k]["norm"] == book[places[k]]["norm"]}
        counted = [b for b in range(first, last + 1) if not _is_number(book[b]["norm"], names)]
        score = sum(b in heard for b in counted) / len(counted) if counted else 0.0
        if score >= least_match and last - first + 1 >= fewest:
            span = book[first : last + 1]
            yield {"start": words[at]["t0"], "end": words[stop]["t1"], "text": " ".join(" ".join(b["read"] for b in span).split()).upper(), "match": score, "n_words": len(span), "has_number": any(_is_number(b["norm"], names) for b in span)}
            at = stop + 1
        else:
            at += 1


def sentence_clips(chapters: DataFrame, *, shortest: float = 4.0, enough: float = 8.0, longest: float = 28.0, least_match: float = 0.95, fewest: int = 6, number_words: Sequence[str] = ()) -> DataFrame:
    """Clips of (words: array of struct(norm, t0, t1), places: array of int, book: array of struct(norm, read, ends)) rows.

    ``places`` says where in the book each word was found (-1: nowhere). Adds start, end,
    text, match (share of the span's words, numbers aside, that were heard), n_words and
    has_number. Each row is one chapter.
    """
    names = frozenset(number_words)
    kind = "array<struct<start:double,end:double,text:string,match:double,n_words:int,has_number:boolean>>"
    arrow = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("match", pa.float64()), ("n_words", pa.int32()), ("has_number", pa.bool_())]))

    @F.arrow_udf(kind)
    def cut(words: pa.Array, places: pa.Array, book: pa.Array) -> pa.Array:
        rows = zip(words.to_pylist(), places.to_pylist(), book.to_pylist(), strict=True)
        return pa.array([list(_chapter_clips(w or [], p or [], b or [], shortest, enough, longest, least_match, fewest, names)) for w, p, b in rows], arrow)

    others = [c for c in chapters.columns if c not in ("words", "places", "book")]
    return chapters.select(*others, F.inline(cut("words", "places", "book")))

"""Benchmark decontamination by winnowing.

Every window of ``span`` words has as its fingerprint the smallest hash among its k-grams
(k = half the span), so a text passage of ``span`` or more words has the same fingerprints
wherever it stands: training and benchmark windows that are equal always meet in the join
on fingerprints, and each meeting is extended to its whole window by a second, independent
hash of all its words. Benchmark items of fewer words than ``span`` are one window of their
own length, whose fingerprint is the hash of the whole.

Documents send into the join only windows whose fingerprint passes a bit filter of fixed
size over the benchmark's fingerprints; the filter has no false negatives, and a larger
benchmark makes it pass more, never miss any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bytes_of, flat, pieces, stored, temporary
from .words import grams, starts_within, words

_WINDOW = "array<struct<fingerprint:bigint,window:bigint,first:int,n:int>>"
_KIND = pa.struct([("n_words", pa.int64()), ("windows", pa.list_(pa.struct([("fingerprint", pa.int64()), ("window", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])))])


def _fingerprints(hashes: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """For each window the smallest hash of its k-grams."""
    k = (span + 1) // 2
    each = grams(hashes, k, 7)
    least = each[first].copy()
    for j in range(1, span - k + 1):
        np.minimum(least, each[first + j], out=least)
    return least


def _windows(hashes: np.ndarray, at: np.ndarray, n: int, span: int):
    """All n-word windows: text, first word (in its text), fingerprint, hash of the whole."""
    first, text = starts_within(at, n)
    if not len(first):
        none = np.zeros(0, np.uint64)
        return text, first, none, none
    whole = grams(hashes, n, 1000 + n)[first]
    return text, first - at[:-1][text], _fingerprints(hashes, first, span) if n == span else whole, whole


def _rows(n_texts: int, n_words: np.ndarray, found: list[tuple]) -> pa.StructArray:
    text, first, print_, whole, size = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 5))
    order = np.argsort(text, kind="stable")
    counts = np.bincount(text.astype(np.int64), minlength=n_texts)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(print_[order].astype(np.uint64).view(np.int64)), pa.array(whole[order].astype(np.uint64).view(np.int64)), pa.array(first[order].astype(np.int32)), pa.array(size[order].astype(np.int32))], names=["fingerprint", "window", "first", "n"])
    return pa.StructArray.from_arrays([pa.array(n_words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), inner)], fields=list(_KIND))


def _item_windows(span: int):
    @arrow_udf(f"struct<n_words:bigint,windows:{_WINDOW}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in pieces(batch, 1 << 19):
                _, _, _, at, hashes = words(*flat(texts))
                lengths = np.diff(at)
                found = [(*_windows(hashes, at, span, span), span)]
                for n in np.unique(lengths[(lengths > 0) & (lengths < span)]):
                    text, first, print_, whole = _windows(hashes, at, int(n), span)
                    own = lengths[text] == n
                    found.append((text[own], first[own], print_[own], whole[own], int(n)))
                found = [(a, b, c, d, np.full(len(a), n, np.int64)) for a, b, c, d, n in found]
                yield _rows(len(texts), lengths, found)

    return run


def _document_windows(span: int, short: list[int], bits: np.ndarray):
    size = np.uint64(len(bits) * 8 - 1)

    @arrow_udf(f"struct<n_words:bigint,windows:{_WINDOW}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in pieces(batch, 1 << 19):
                _, _, _, at, hashes = words(*flat(texts))
                found = []
                for n in [*short, span]:
                    text, first, print_, whole = _windows(hashes, at, n, span)
                    slot = print_ & size
                    hit = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    found.append((text[hit], first[hit], print_[hit], whole[hit], np.full(int(hit.sum()), n, np.int64)))
                yield _rows(len(texts), np.diff(at), found)

    return run


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = 10) -> DataFrame:
    """Distinct (fingerprint, window, n, item) rows of a benchmark, stored. Items without a word have none."""
    found = benchmark.select(F.col(id_col).alias("item"), _item_windows(span)(bytes_of(F.col(text_col))).alias("w"))
    return stored(found.select("item", F.explode("w.windows").alias("w")).select("w.fingerprint", "w.window", "w.n", "item").distinct(), "windows")


def filter_bits(windows: DataFrame, log2_bits: int = 24) -> np.ndarray:
    """The bit filter over all fingerprints: 2**log2_bits bits, gathered as at most 2**(log2_bits-3) bytes."""
    slot = F.col("fingerprint").bitwiseAND(F.lit((1 << log2_bits) - 1))
    byte = windows.select(F.shiftright(slot, 3).alias("byte"), F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (slot.bitwiseAND(F.lit(7)) + 1).cast("int")).alias("bit"))
    # at most 2**(log2_bits-3) rows whatever the benchmark's size
    rows = byte.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (log2_bits - 3), np.uint8)
    bits[rows["byte"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint8)
    return bits


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, least_item: int = 1, log2_bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """Which words of which documents stand in a passage of the benchmark.

    Returns two tables: one row per row of ``documents`` (row, id, n_words, n_hit,
    n_items, items) and one row per maximal hit span (row, id, first_word, end_word).
    Items of fewer words than ``least_item`` don't count. ``row`` tells repeated ids apart; ``items`` holds distinct item ids as strings, sorted.

    Null and empty texts have no words and are never hit; a null item id counts as the
    item ''. Ties and repeated rows are judged one by one, an empty benchmark hits
    nothing, other columns are ignored.
    """
    windows = benchmark_windows(benchmark, item_col, item_text_col, span).where(F.col("n") >= min(least_item, span))
    short = sorted(r[0] for r in windows.select("n").distinct().collect() if r[0] < span)  # at most span - 1 lengths
    judge = _document_windows(span, short, filter_bits(windows, log2_bits))
    seen = documents.select(F.col(id_col).alias("id"), judge(bytes_of(F.col(text_col))).alias("w"))
    seen = stored(seen.select(F.monotonically_increasing_id().alias("row"), "id", "w.n_words", "w.windows"), "candidates")

    candidates = seen.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.fingerprint", "w.window", "w.n", "w.first")
    keys = windows.select("fingerprint", "window", "n").distinct()
    hits = stored(candidates.join(stored(keys, "keys"), ["fingerprint", "window", "n"], "left_semi"), "hits")
    # what a document's windows cover: each window adds what lies beyond the furthest end before it
    order = F.array_sort(F.collect_list(F.struct("first", (F.col("first") + F.col("n")).alias("end"))))
    empty = F.array().cast("array<struct<first:int,end:int>>")

    def join_span(spans, x):
        last = F.try_element_at(spans, F.lit(-1))
        touching = (F.size(spans) > 0) & (x["first"] <= last["end"])
        grown = F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(touching, grown).otherwise(F.concat(spans, F.array(F.struct(x["first"].alias("first"), x["end"].alias("end")))))

    covered = hits.groupBy("row").agg(order.alias("each")).select("row", F.aggregate("each", empty, join_span).alias("spans"))
    items = hits.select("row", "fingerprint", "window", "n").distinct().join(windows, ["fingerprint", "window", "n"])
    items = items.select("row", F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = stored(covered.join(items, "row"), "found")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    judged = seen.select("row", "id", "n_words").join(found, "row", "left").select("row", "id", "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    spans = seen.select("row", "id").join(found, "row").select("row", "id", F.inline("spans")).withColumnsRenamed({"first": "first_word", "end": "end_word"})
    return judged, spans


def decontaminated(documents: DataFrame, benchmark: DataFrame, *, max_share: float = 0.0, least_item: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` of whose words no more than ``max_share`` are hit, with all their columns.

    Equal texts are judged alike, so texts to drop are told by a 128-bit digest and no copy of
    the documents is needed. Items of fewer words than ``least_item`` don't count; by default
    all do. ``id_col`` isn't looked at. Null and empty texts stay, repeated rows stay or go
    together, very long texts are read whole; an empty benchmark drops nothing.
    """
    high, low = temporary(documents, "high", "low")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = documents.withColumns({high: F.xxhash64(text), low: F.xxhash64(F.lit(1), text)})
    judged, _ = contamination(marked.select(F.struct(F.col(high).alias("h"), F.col(low).alias("l")).alias("key"), F.col(text_col).alias("text")), benchmark, id_col="key", text_col="text", least_item=least_item, **options)
    bad = judged.where(F.col("n_hit") > F.lit(max_share) * F.col("n_words")).select(F.col("id.h").alias(high), F.col("id.l").alias(low)).distinct()
    return marked.join(stored(bad, "bad"), [high, low], "left_anti").drop(high, low)

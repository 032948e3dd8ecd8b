"""Mixing sources to target weights.

Sizes are word counts. Each source's target is its weight's share of all words, but no more
than ``most`` times what the source has; what is cut off is shared again by weight among the
others. A source's repetition rate is target / size: each document is taken floor(rate)
times, and once more with a probability equal to the fraction, by a seeded hash of its id
and text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, temporary


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target). Sources take ``weights`` in turn, by code point, null last.

    Closed form of cutting and sharing again until no target is above its limit: with the
    sources in order of limit / weight, those before the first at which the level (words left
    over weight left) is within its own ratio are cut at their limits. One row per source,
    so the unpartitioned windows run over a table of names, not of documents.
    """
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(listed) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    rows = sizes.select("source", "source_size", weight.alias("weight"), limit.alias("limit")).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everyone = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    words_left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", words_left / weight_left).withColumn("rank", F.row_number().over(by_ratio))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level")))
    # the level falls from source to source only while they are cut, so the first that fits sets it
    fits = rows.select(level.over(everyone)["level"].alias("fit"), "source", "source_size", "weight", "limit")
    return fits.select("source", "source_size", F.least("limit", F.coalesce(F.col("fit") * F.col("weight"), F.col("limit"))).alias("target"))


def mixed(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 5) -> DataFrame:
    """``documents`` with size, source_size, target and copies (how often the mix takes the row) added.

    Existing columns of those names are replaced. A null or empty text has size 0; null is
    a source of its own; repeated rows are drawn alike; an empty table stays empty.
    """
    size, source, copies = temporary(documents, "size", "source", "copies")
    kept = documents.drop(*(c for c in documents.columns if c.lower() in {"size", "source_size", "target", "copies"}))
    sized = kept.withColumn(size, F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
    table = targets(sized.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(size).alias("source_size")), weights, most)
    table = stored(table, "targets").withColumnsRenamed({"source": source, "source_size": "source_size"})
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    # 52 bits of a digest are a number in [0, 1); id and text, so that rows without an id differ
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text_col)]
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    joined = sized.join(table, sized[source_col].cast("string").eqNullSafe(table[source])).drop(source)
    taken = joined.withColumn(copies, (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long"))
    return taken.withColumnsRenamed({size: "size", copies: "copies"})

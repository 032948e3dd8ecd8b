"""Rates, intervals and order statistics as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places drawn at once: 8 MB of them.
_DRAWN = 1 << 20


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(rate, lo, hi): the share k/n and its Wilson interval within [0, 1]; zeros for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    spread = 1 + F.try_divide(F.lit(z * z), n)
    center = (p + F.try_divide(F.lit(z * z), 2 * n)) / spread
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / spread
    some = lambda x, name: F.when(n > 0, x).otherwise(0.0).alias(name)
    return F.struct(some(p, "rate"), some(F.greatest(F.lit(0.0), center - half), "lo"), some(F.least(F.lit(1.0), center + half), "hi"))


def rates(df: DataFrame, keys: list[str], hit: Column, z: float = 1.96) -> DataFrame:
    """keys, k, n, rate, lo, hi: how often ``hit`` holds; null is not counted."""
    counted = df.groupBy(*keys).agg(F.count_if(hit).alias("k"), F.count(hit).alias("n"))
    return counted.withColumn("w", wilson(F.col("k"), F.col("n"), z)).select(*keys, "k", "n", "w.rate", "w.lo", "w.hi")


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of a sorted array; null for none."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def first_mode(values: Column) -> Column:
    """struct(n, token): the most frequent element of an array, the first seen of equals."""
    distinct = F.array_distinct(values)
    counted = F.transform(distinct, lambda t, i: F.struct(F.size(F.filter(values, lambda v: v == t)).alias("n"), (-i).alias("early"), t.alias("token")))
    best = F.array_max(counted)
    return F.struct(best["n"].alias("n"), best["token"].alias("token"))


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, value: each group's most frequent value, on ties the one whose first ``order`` is smallest."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", (-F.col("_first")).alias("_early"))).alias(value))


def percentile_interval(value: Column, level: float = 0.95) -> Column:
    """array(lo, hi): exact percentiles with linear interpolation."""
    tail = (1 - level) / 2
    return F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))


def _resampled(x: np.ndarray, times: int, seed: int) -> np.ndarray:
    """Means of ``times`` samples of x with replacement; one sample is held at a time."""
    r, sample, means = np.random.default_rng(seed), np.empty_like(x), np.empty(times)
    for i in range(times):
        for first in range(0, len(x), _DRAWN):
            part = sample[first : first + _DRAWN]
            np.take(x, r.integers(0, len(x), len(part)), out=part, mode="clip")
        means[i] = sample.mean()
    return means


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, *, times: int = 5000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """keys, mean, lo, hi, n: percentile bootstrap of the mean, reproducible by seed.

    A group's values come in batches and stay as one sorted array of doubles; samples are drawn
    one by one, ``_DRAWN`` places at a time, so that a group of n values takes some 24 n bytes
    of a task whatever ``times`` is. The order they are resampled in is their sorted one.
    """
    types = {f.name: f.dataType for f in df.select(*keys).schema}
    schema = T.StructType([*(T.StructField(k, t) for k, t in types.items()), *(T.StructField(n, T.DoubleType()) for n in ("mean", "lo", "hi")), T.StructField("n", T.LongType())])

    def one(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [b.column(value).drop_null().to_numpy(zero_copy_only=False) for b in batches]
        x = np.concatenate([p[~np.isnan(p)] for p in pieces])
        pieces.clear()
        x.sort()
        row = [None, None, None]
        if len(x):
            row = [x.mean(), *np.percentile(_resampled(x, times, seed), [50 * (1 - level), 50 * (1 + level)])]
        values = [*(pa.array([k.as_py()], k.type) for k in key), *(pa.array([v], pa.float64()) for v in row), pa.array([len(x)], pa.int64())]
        yield pa.RecordBatch.from_arrays(values, [f.name for f in schema])

    return df.select(*keys, F.col(value).cast("double").alias(value)).groupBy(*keys).applyInArrow(one, schema)


def clustered_mean(df: DataFrame, keys: list[str], cluster: str, value: str, **options) -> DataFrame:
    """Bootstrap over clusters: the mean of each cluster's mean."""
    means = df.groupBy(*keys, cluster).agg(F.avg(value).alias(value))
    return bootstrap_mean(means, keys, value, **options)


def mean_of_groups(scores: DataFrame, key: str, score: str, least: int = 2) -> DataFrame:
    """key, mean_score, n: the mean over a key's groups, for keys with at least ``least`` of them."""
    return scores.groupBy(key).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n")).where(F.col("n") >= least)

"""Prediction manifests: files of many models to ``refs`` and ``hyps`` tables.

A file is a model, named by its stem. Which columns hold the key, the reference and the
hypothesis is found from the file's first row unless told. Spark has no row order, so each
row carries its file's rank and its line's number, and "the first reference wins" and "the
last hypothesis wins" are min_by and max_by over them.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

#: Column names, most trusted first.
KEY_NAMES = ("audio_filepath", "id", "key", "__key__", "audio_id", "utt_id", "filename")
REF_NAMES = ("text", "reference", "ref", "ground_truth", "target")
HYP_NAMES = ("pred_text", "prediction", "hypothesis", "hyp", "transcription", "pred")


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files of a Hadoop glob, in order of their names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def _stem(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].rpartition(".")[0]


def _numbered(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds row_ord, the row's place in the file, however the file was split."""
    schema = T.StructType([*rows.schema, T.StructField("row_ord", T.LongType())])
    # partition sizes are counted first, then each partition numbers its own rows
    return spark.createDataFrame(rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file's rows with row_ord, by suffix: .jsonl or .ndjson, .json (a list, or an object with samples), .csv, .parquet."""
    suffix = path.rpartition(".")[2].lower()
    if suffix in ("jsonl", "ndjson"):
        rows = spark.read.option("mode", "FAILFAST").json(path)
    elif suffix == "json":
        rows = spark.read.option("mode", "FAILFAST").option("multiLine", True).json(path)
        if rows.columns == ["samples"] or ("samples" in rows.columns and isinstance(rows.schema["samples"].dataType, T.ArrayType)):
            rows = rows.select(F.inline_outer("samples"))
    elif suffix == "csv":
        rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
        rows = rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))  # an unquoted empty field is '', not missing
    elif suffix == "parquet":
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"{path}: manifests end in .jsonl, .ndjson, .json, .csv or .parquet")
    return _numbered(rows, spark)


def _pick(row: T.Row | None, names: Sequence[str], told: str | None) -> str | None:
    if told:
        return told if row is not None and told in row else None
    return next((n for n in names if row is not None and n in row and row[n] is not None), None)


@dataclass(frozen=True)
class Predictions:
    """``refs`` (corpus, clip_key, reference, language, file_ord, row_ord) and ``hyps`` (corpus, clip_key, model, hypothesis, file_ord, row_ord)."""

    refs: DataFrame
    hyps: DataFrame
    language: str = "en"

    def first_refs(self) -> DataFrame:
        """(corpus, clip_key, reference, language): the first reference of each clip."""
        first = F.struct("file_ord", "row_ord")
        return self.refs.groupBy("corpus", "clip_key").agg(F.min_by("reference", first).alias("reference"), F.min_by("language", first).alias("language"))

    def last_hyps(self) -> DataFrame:
        """(corpus, clip_key, model, hypothesis): the last hypothesis of each clip and model."""
        return self.hyps.groupBy("corpus", "clip_key", "model").agg(F.max_by("hypothesis", F.struct("file_ord", "row_ord")).alias("hypothesis"))

    def ref_conflicts(self) -> DataFrame:
        """Clips whose references disagree."""
        return self.refs.groupBy("corpus", "clip_key").agg(F.count_distinct("reference").alias("n_references")).where("n_references > 1")

    def models(self) -> DataFrame:
        return self.hyps.select("model").distinct().orderBy("model")

    def n_clips(self) -> DataFrame:
        return self.refs.select("corpus", "clip_key").distinct().agg(F.count("*").alias("n_clips"))

    def coverage(self) -> DataFrame:
        """model, n_clips: most first."""
        return self.last_hyps().groupBy("model").agg(F.count("*").alias("n_clips")).orderBy(F.desc("n_clips"), "model")

    def clips(self, models: Sequence[str] | None = None, require_all: bool = False) -> DataFrame:
        """(corpus, clip_key, reference, language, model, hypothesis) of clips with a hypothesis of the wanted models (none or []: all)."""
        hyps = self.last_hyps()
        if models:
            hyps = hyps.where(F.col("model").isin(*models))
        if require_all:
            wanted = len(set(models)) if models else hyps.select("model").distinct().count()
            whole = hyps.groupBy("corpus", "clip_key").count().where(F.col("count") == wanted)
            hyps = hyps.join(whole, ["corpus", "clip_key"], "left_semi")
        return self.first_refs().join(hyps, ["corpus", "clip_key"])

    def clip_maps(self, **options) -> DataFrame:
        """(corpus, clip_key, reference, hypotheses: map of model to hypothesis)."""
        return self.clips(**options).groupBy("corpus", "clip_key", "reference").agg(F.map_from_entries(F.collect_list(F.struct("model", "hypothesis"))).alias("hypotheses"))

    def mapped(self, change: Callable[[Column], Column]) -> Predictions:
        """New tables with every text changed; one reference per clip, so conflicts don't carry over."""
        refs = self.first_refs().withColumns({"reference": change(F.col("reference")), "file_ord": F.lit(0), "row_ord": F.lit(0).cast("bigint")})
        return replace(self, refs=refs, hyps=self.hyps.withColumn("hypothesis", change(F.col("hypothesis"))))

    def normalized(self, *, own=None, numbers: Callable[[Column], Column] | None = None) -> Predictions:
        """Normalized texts; ``numbers`` may rewrite number words after that."""
        then = numbers or (lambda t: t)
        return self.mapped(lambda t: then(tx.normalize(t, own=own, language=F.lit(self.language))))

    def union(self, other: Predictions) -> Predictions:
        return replace(self, refs=self.refs.unionByName(other.refs), hyps=self.hyps.unionByName(other.hyps))

    def token_clips(self, **options) -> DataFrame:
        """(clip_key, model, ref_tokens, hyp_tokens) as the consensus plan takes them; corpora are told apart in the key."""
        rows = self.clips(**options)
        key = F.concat_ws("\x1f", F.nullif("corpus", F.lit("")), "clip_key")
        return rows.select(key.alias("clip_key"), "model", tx.tokens(F.col("reference")).alias("ref_tokens"), tx.tokens(F.col("hypothesis")).alias("hyp_tokens"))


def from_rows(rows: DataFrame, model: str | Column, *, key: str | None, ref: str, hyp: str, stem: str, language: str = "en", corpus: str = "", file_ord: int = 0) -> Predictions:
    """Tables of one file's rows. A missing key is stem:row; a null hypothesis drops the row; a null reference is ''."""
    name = F.lit(model) if isinstance(model, str) else model
    fallback = F.concat(F.lit(f"{stem}:"), F.col("row_ord").cast("string"))
    clip = F.coalesce(F.col(f"`{key}`").cast("string"), fallback) if key else fallback
    kept = rows.where(F.col(f"`{hyp}`").isNotNull()).select(F.lit(corpus).alias("corpus"), clip.alias("clip_key"), F.coalesce(F.col(f"`{ref}`").cast("string"), F.lit("")).alias("reference"), name.alias("model"), F.col(f"`{hyp}`").cast("string").alias("hypothesis"), F.lit(language).alias("language"), F.lit(file_ord).alias("file_ord"), "row_ord")
    return Predictions(kept.select("corpus", "clip_key", "reference", "language", "file_ord", "row_ord"), kept.select("corpus", "clip_key", "model", "hypothesis", "file_ord", "row_ord"), language)


def load_manifest(spark: SparkSession, path: str, model: str | None = None, *, into: Predictions | None = None, key_field: str | None = None, ref_field: str | None = None, hyp_field: str | None = None, language: str = "en", corpus: str = "", file_ord: int = 0) -> Predictions:
    """One model's file; into adds it to what is there."""
    rows = read_rows(spark, path)
    first = rows.first()
    stem = _stem(path)
    if first is None:
        none = spark.createDataFrame([], "k string, r string, h string, row_ord bigint")
        out = from_rows(none, model or stem, key="k", ref="r", hyp="h", stem=stem, language=language, corpus=corpus, file_ord=file_ord)
    else:
        ref, hyp = _pick(first, REF_NAMES, ref_field), _pick(first, HYP_NAMES, hyp_field)
        if ref is None or hyp is None:
            raise ValueError(f"{path}: no reference or hypothesis column among {rows.columns[:-1]}; name them by ref_field and hyp_field")
        out = from_rows(rows, model or stem, key=_pick(first, KEY_NAMES, key_field), ref=ref, hyp=hyp, stem=stem, language=language, corpus=corpus, file_ord=file_ord)
    return into.union(out) if into else out


def load_manifests(spark: SparkSession, files: Mapping[str, str] | Sequence[str], *, language: str = "en", **options) -> Predictions:
    """Several files ({model: path}, or paths) in the order given."""
    listed = list(files.items()) if isinstance(files, Mapping) else [(None, p) for p in files]
    if not listed:
        raise FileNotFoundError("no manifest files")
    return reduce(Predictions.union, (load_manifest(spark, p, m, language=language, file_ord=i, **options) for i, (m, p) in enumerate(listed)))


def load_dir(spark: SparkSession, folder: str, pattern: str = "*.jsonl", *, language: str = "en", **options) -> Predictions:
    """All files of a folder that match, in order of their names."""
    found = _paths(spark, f"{folder.rstrip('/')}/{pattern}")
    if not found:
        raise FileNotFoundError(f"{folder}: nothing matches {pattern}")
    return load_manifests(spark, found, language=language, **options)


def spread(rows: DataFrame) -> DataFrame:
    """The same rows dealt over all cores if they come from fewer files than there are cores.

    A file of one row group is one task whatever it holds; before costly expressions a shuffle
    of so few files is cheaper. Rows of many files stay where they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < len(rows.inputFiles()) < cores else rows


def available(spark: SparkSession, root: str) -> list[str]:
    """Corpora (folders) under ``root``."""
    return [p.rstrip("/").rpartition("/")[2] for p in _paths(spark, f"{root.rstrip('/')}/*")]


def load_predictions(spark: SparkSession, root: str, corpus: str, models: Sequence[str] | None = None, *, pattern: str = "*.jsonl", language: str = "en", **options) -> Predictions:
    """The files of a corpus folder, of the wanted models only."""
    found = [p for p in _paths(spark, f"{root.rstrip('/')}/{corpus}/*") if fnmatch.fnmatch(p.rpartition("/")[2], pattern) and (not models or _stem(p) in models)]
    if not found:
        raise FileNotFoundError(f"{root}/{corpus}: no predictions")
    return load_manifests(spark, found, language=language, corpus=corpus, **options)


def load_masks(spark: SparkSession, root: str, variant: str) -> DataFrame:
    """One mask-recipe table."""
    return spark.read.parquet(f"{root.rstrip('/')}/{variant}.parquet")

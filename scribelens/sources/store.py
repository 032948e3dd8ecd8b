"""Result sinks, run folders, dataset manifests and report texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.sequence import first_rows

#: A dataset manifest's columns.
MANIFEST = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("__key__", "path", "text", "text_normalized", "language", "dataset", "split")]
    + [T.StructField("duration", T.DoubleType(), True), T.StructField("sample_rate", T.IntegerType(), True)]
    + [T.StructField(c, T.StringType(), False) for c in ("speaker_id", "gender", "accent", "dialect", "age", "age_group", "emotion", "topic", "session_id")]
    + [T.StructField(c, T.IntegerType(), True) for c in ("up_votes", "down_votes")]
)


def latest_runs(runs: DataFrame, by: str = "mtime") -> DataFrame:
    """The newest finished run of each corpus, split and model; legacy runs don't count."""
    order = Window.partitionBy("corpus", "split", "model").orderBy(F.desc(by), F.desc("run"))
    return runs.where(F.col("done") & ~F.col("run").startswith("legacy_")).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def run_rows(shards: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """(corpus, split, model, __key__, hyp): raw text unless blank, else the normalized; a model's legacy rows replace its shards."""
    named = lambda df: [c for c in ("hyp_raw", "hypothesis_raw", "hypothesis", "hyp") if c in df.columns]
    text = lambda df: F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in named(df)))
    keys = ["corpus", "split", "model"]
    rows = shards.select(*keys, "__key__", text(shards).alias("hyp"))
    if legacy is None:
        return rows
    old = legacy.select(*keys, "__key__", text(legacy).alias("hyp"))
    return old.unionByName(rows.join(old.select(*keys).distinct(), keys, "left_anti"))


def read_manifest(spark: SparkSession, folder: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A dataset's manifest, only the columns asked for."""
    rows = spark.read.parquet(f"{folder.rstrip('/')}/manifest.parquet")
    return rows.select(*columns) if columns else rows


def iter_samples(spark: SparkSession, folder: str, with_audio: bool = False) -> DataFrame:
    """Manifest rows, with the bytes of their audio files if wanted."""
    rows = read_manifest(spark, folder)
    if not with_audio:
        return rows
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("_file"), F.col("content").alias("audio"))
    return rows.withColumn("_file", F.regexp_extract("path", "([^/]+)$", 1)).join(files, "_file", "left").drop("_file")


def write_manifest(rows: DataFrame, folder: str, order: str) -> None:
    """Typed manifest columns, the first row of each key by ``order``; texts that are missing are ''. An empty table is an error."""
    if rows.isEmpty():
        raise ValueError("a manifest needs rows")
    first = first_rows(rows, ["__key__"], order)
    have = set(first.columns)
    pick = lambda f: F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    columns = [(pick(f) if f.nullable else F.coalesce(pick(f), F.lit(""))).alias(f.name) for f in MANIFEST]
    first.select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder.rstrip('/')}/manifest.parquet")


def add_samples(old: DataFrame, new: DataFrame, key: str = "__key__") -> tuple[DataFrame, DataFrame]:
    """What is there, then new rows of other keys; and one row of counts: added, skipped."""
    fresh = first_rows(new.join(old.select(key), key, "left_anti").withColumn("_o", F.monotonically_increasing_id()), [key], "_o").drop("_o")
    counts = new.select(key).distinct().join(old.select(key).distinct().withColumn("_old", F.lit(1)), key, "left").agg(F.count_if(F.col("_old").isNull()).alias("added"), F.count("_old").alias("skipped"))
    return old.unionByName(fresh, allowMissingColumns=True), counts


def export_predictions(rows: DataFrame, folder: str) -> None:
    """JSON lines by corpus and model, sorted by key; durations rounded, nulls left out."""
    out = rows.withColumns({"duration": F.round("duration", 3), "time": F.round("time", 4)})
    out.repartition("corpus", "model").sortWithinPartitions("corpus", "model", "audio_filepath").write.mode("overwrite").partitionBy("corpus", "model").option("ignoreNullFields", True).json(folder)


def export_masks(rows: DataFrame, folder: str, excluded: Sequence[str] = ()) -> bool:
    """Mask recipes without the excluded sources; nothing is written if none is left."""
    left = rows.where(~F.col("source_dataset").rlike("|".join(excluded))) if excluded else rows
    if left.isEmpty():
        return False
    left.write.mode("overwrite").parquet(folder)
    return True


def allowed_corpora(spark: SparkSession, bases: Sequence[str], tags: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """base and base-tag for all of both lists, without the excluded; a table of names, as small as its lists."""
    b, t = (spark.createDataFrame([(x,) for x in xs], f"{n} string") for xs, n in ((bases, "base"), (tags, "tag")))
    both = b.crossJoin(t).select(F.concat_ws("-", "base", "tag").alias("corpus"))
    return b.select(F.col("base").alias("corpus")).unionByName(both).where(~F.col("corpus").isin(*excluded)) if excluded else b.select(F.col("base").alias("corpus")).unionByName(both)


def disagreement_json(edits: DataFrame, rates: DataFrame, n_clips: int, panel: Sequence[str], settings) -> DataFrame:
    """One row, column json: clips, panel, parameters, rates and edits.

    The document holds every edit, as its format asks; large runs should write the edits
    table itself.
    """
    verdict = F.map_from_entries("verdicts")
    each = F.struct("kind", "position", F.array_join("tokens", " ").alias("text"), "n_panel_agree", "n_panel", F.round("consensus_cer", 3).alias("consensus_cer"), verdict.alias("verdict"))
    by_place = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    listed = edits.agg(F.count("*").alias("n_edits"), F.transform(F.array_sort(F.collect_list(F.struct(F.struct("clip_key", "kind", "first").alias("k"), each.alias("e"))), by_place), lambda x: x["e"]).alias("edits"))
    rate = rates.agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("rate", "n_ref", "n_eligible", "lo", "hi")))).alias("accept_ref"))
    params = F.struct(F.lit(settings.majority).alias("majority"), F.lit(settings.min_run_len).alias("min_run_len"), F.lit(settings.include_middle).alias("include_middle"))
    whole = F.struct(F.lit(n_clips).alias("n_clips"), F.array(*(F.lit(p) for p in panel)).alias("panel"), "n_edits", params.alias("params"), "accept_ref", "edits")
    return listed.crossJoin(rate).select(F.to_json(whole).alias("json"))  # one row each


def switch_json(scores: DataFrame) -> DataFrame:
    """One row, column json: family to model to score."""
    by = scores.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("switch", "lo", "hi", "limiting_arm", "arms")))).alias("models"))
    return by.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("family", "models")))).alias("json"))


def text_lines(table: DataFrame) -> Iterator[str]:
    """A table as lines of text, numbers and all but the first column set to the right; widths are one aggregation, rows are padded where they are."""
    cells = table.select(*(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in table.columns))
    widest = cells.agg(*(F.max(F.length(c)) for c in cells.columns)).first()
    pads = {c: (F.rpad if c == cells.columns[0] else F.lpad, max(len(c), w or 0)) for c, w in zip(cells.columns, widest, strict=True)}
    line = F.concat_ws(" | ", *(pad(F.col(c), w, " ") for c, (pad, w) in pads.items()))
    yield " | ".join(f"{c:<{w}}" if pad is F.rpad else f"{c:>{w}}" for c, (pad, w) in pads.items())
    yield from (row[0] for row in cells.select(line).toLocalIterator())


def report_turns(spark: SparkSession, path: str, language: str, longest_role: int = 90) -> DataFrame:
    """(file, turn, speaker, lg, text) of the interventions of verbatim reports in one language.

    Tags go, entities are resolved, and a leading role in brackets or before a dash is cut if
    it ends within ``longest_role`` characters.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"(?is)^.*?<div[^>]*class=\"xml[^>]*>|</div>\s*$", "").alias("xml"))
    each = whole.select("file", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<INTERVENTION.*?</INTERVENTION>"), F.lit(0))).alias("turn", "x"))
    lg = F.regexp_extract("x", r'<ORATEUR\b[^>]*\bLG="([^"]*)"', 1)
    speaker = F.trim(F.replace(F.regexp_extract("x", r'<ORATEUR\b[^>]*\bLIB="([^"]*)"', 1), F.lit(" | "), F.lit(" ")))
    body = tx.plain_markup(F.array_join(F.regexp_extract_all("x", F.lit(r"(?s)<PARA\b[^>]*>(.*?)</PARA>"), F.lit(1)), " "))
    role = F.regexp_extract("body", r"^[^.–—-]*(?:\([^)]*\)|)[.\s]*[–—-]\s+", 0)
    rows = each.select("file", "turn", speaker.alias("speaker"), lg.alias("lg"), body.alias("body")).where(F.lower("lg") == language.lower())
    return rows.select("file", "turn", "speaker", "lg", F.when((F.length(role) > 0) & (F.length(role) < longest_role), F.substring("body", F.length(role) + 1, F.length("body"))).otherwise(F.col("body")).alias("text"))

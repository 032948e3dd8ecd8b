"""Reference errors: where a panel of models agrees that a reference is wrong, and who reproduces it anyway.

One shuffle gathers a clip's models (as many as there are models, never more) after each
pair was aligned once; votes, runs, thresholds and verdicts are array expressions within the
clip's row, and only the rates shuffle again, as counts by model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align
from ..functions.stats import wilson


@dataclass(frozen=True)
class Settings:
    """When a panel's disagreement with a reference counts."""

    majority: float = 0.8
    min_run_len: int = 1
    include_middle: bool = False
    min_ref_match: float = 0.5
    min_consensus_cer: float = 0.30
    min_panel: int = 3


def aligned(clips: DataFrame) -> DataFrame:
    """(clip_key, model, ref_tokens, hyp_tokens) rows with ops, missed (0/1 by position) and matched."""
    with_ops = clips.withColumn("ops", align.align_ops("ref_tokens", "hyp_tokens"))
    return with_ops.withColumns({"missed": align.missed_flags(F.col("ops")), "matched": align.matched_count(F.col("ops"))})


def _clips(rows: DataFrame, panel: Sequence[str], models: Sequence[str] | None, s: Settings) -> DataFrame:
    n_ref = F.size("ref_tokens")
    ops, hyp = F.col("ops"), F.col("hyp_tokens")
    # most pairs are equal or silent: nothing was put anywhere
    only = lambda some, value, kind: F.when(some, value).otherwise(F.array().cast(kind))
    several = F.size("ops") > 1
    vote = F.struct(
        "model",
        F.col("model").isin(*panel).alias("panel"),
        (F.col("model").isin(*models) if models else F.lit(True)).alias("tested"),
        (F.col("matched") >= F.floor(F.lit(s.min_ref_match) * n_ref)).alias("able"),
        only(F.col("matched") < n_ref, F.col("missed"), "array<int>").alias("missed"),
        only(several | (F.get(ops, F.lit(0))["tag"] == "replace"), align.replacements(ops, hyp), "array<struct<i1:int,i2:int,tokens:array<string>>>").alias("replaced"),
        only(several, F.reverse(align.insertion_at(ops, hyp, F.lit(0))), "array<string>").alias("before"),
        only(several, align.insertion_at(ops, hyp, n_ref), "array<string>").alias("after"),
    )
    by = rows.where(n_ref > 0).groupBy("clip_key").agg(F.any_value("ref_tokens").alias("_ref"), F.array_sort(F.collect_list(vote)).alias("votes")).withColumnRenamed("_ref", "ref_tokens")
    by = by.withColumn("panel", F.filter("votes", lambda v: v["panel"] & v["able"])).withColumn("n_panel", F.size("panel")).where(F.col("n_panel") >= s.min_panel)
    threshold = F.greatest(F.lit(2), F.ceil(F.lit(s.majority) * F.col("n_panel") - 1e-9).cast("int"))
    return by.withColumns({"threshold": threshold, "n_ref": n_ref})


def _runs(counts: Column, threshold: Column) -> Column:
    """array<struct<first, end>> of maximal runs of counts that reach the threshold."""

    def add(runs, x):
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), (x["i"] + 1).alias("end"))))
        return F.when(x["n"] < threshold, runs).when((F.size(runs) > 0) & (last["end"] == x["i"]), longer).otherwise(F.concat(runs, F.array(F.struct(x["i"].alias("first"), (x["i"] + 1).alias("end")))))

    placed = F.transform(counts, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    return F.aggregate(placed, F.array().cast("array<struct<first:int,end:int>>"), add)


def _verdicts(votes: Column, declined) -> Column:
    """Null for a model that isn't able, consensus for one that declined the reference's version, else ref."""
    tested = F.filter(votes, lambda v: v["tested"])
    return F.transform(tested, lambda v: F.struct(v["model"].alias("model"), F.when(~v["able"], F.lit(None).cast("string")).when(declined(v), "consensus").otherwise("ref").alias("verdict")))


_EDIT = "struct<kind:string,position:string,tokens:array<string>,first:int,indices:array<int>,n_panel_agree:int,written:array<string>,verdicts:array<struct<model:string,verdict:string>>>"


def find_ref_edits(clips: DataFrame, panel: Sequence[str], models: Sequence[str] | None = None, settings: Settings | None = None) -> DataFrame:
    """One row for each reference error of (clip_key, model, ref_tokens, hyp_tokens) rows.

    clip_key, kind (delete or insert), position, tokens, first, indices, n_panel_agree,
    n_panel, consensus_cer (null for inserts) and verdicts (array of model and verdict).
    ``panel`` may overlap ``models`` (all, if None). Clips without a reference token, or with
    fewer able panel models than ``min_panel``, have none.

    A clip's edits of both kinds are one array in its row, so rows are scanned, aligned and
    shuffled once.
    """
    s = settings or Settings()
    by = _clips(aligned(clips), panel, models, s)
    zeros = F.array_repeat(F.lit(0), F.col("n_ref"))
    by = by.withColumn("counts", F.aggregate("panel", zeros, lambda a, v: F.when(F.size(v["missed"]) == 0, a).otherwise(F.zip_with(a, v["missed"], lambda x, y: x + y))))
    # most clips have no edit: enough of the panel must have missed a position, or put something at an end
    adds = lambda name: F.size(F.filter("panel", lambda v: F.size(v[name]) > 0)) >= F.col("threshold")
    by = by.where((F.array_max("counts") >= F.col("threshold")) | adds("before") | adds("after"))
    edit = lambda *values: F.struct(*(v.alias(n) for v, n in zip(values, ("kind", "position", "tokens", "first", "indices", "n_panel_agree", "written", "verdicts"), strict=True))).cast(_EDIT)

    # deletions: runs of positions that enough of the panel missed, unless most of it wrote something much alike
    runs = F.filter(_runs(F.col("counts"), F.col("threshold")), lambda r: (r["end"] - r["first"] >= s.min_run_len) & (F.lit(s.include_middle) | (r["first"] == 0) | (r["end"] == F.col("n_ref"))))
    over = lambda v, r: F.array_contains(F.slice(v["missed"], r["first"] + 1, r["end"] - r["first"]), 1)
    by = by.withColumn("runs", runs)
    chunk = lambda r: F.slice("ref_tokens", r["first"] + 1, r["end"] - r["first"])
    written = lambda r: F.transform(F.filter("panel", lambda v: over(v, r)), lambda v: align.replaced_within(v["replaced"], r["first"], r["end"]))
    place = lambda r: F.when(r["first"] == 0, "start").when(r["end"] == F.col("n_ref"), "end").otherwise("middle")
    deleted = F.transform("runs", lambda r: edit(F.lit("delete"), place(r), chunk(r), r["first"], F.sequence(r["first"], r["end"] - 1), F.get("counts", r["first"]), written(r), _verdicts(F.col("votes"), lambda v: over(v, r))))

    # insertions, at the start (lists reversed) and at the end alike
    def inserted(name: str, position: str, at: Column) -> Column:
        common, agree = F.col(f"heard_{name}"), F.col(f"agree_{name}")
        tokens = F.reverse(common) if name == "before" else common
        one = edit(F.lit("insert"), F.lit(position), tokens, at, F.array(at), agree, F.lit(None), _verdicts(F.col("votes"), lambda v: align.emitted(v[name], common)))
        return F.when((F.size(common) >= max(1, s.min_run_len)) & (agree >= F.col("threshold")), F.array(one)).otherwise(F.array().cast(f"array<{_EDIT}>"))

    def heard(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn(f"heard_{name}", align.consensus_prefix(F.transform("panel", lambda v: v[name]), F.col("threshold")))
        return rows.withColumn(f"agree_{name}", F.size(F.filter("panel", lambda v: align.emitted(v[name], F.col(f"heard_{name}")))))

    by = heard(heard(by, "before"), "after")
    edits = F.concat(deleted, inserted("before", "start", F.lit(0)), inserted("after", "end", F.col("n_ref")))
    found = by.withColumn("edits", edits).select("clip_key", "n_panel", F.inline_outer("edits")).where("kind is not null")
    found = found.withColumn("consensus_cer", F.when(F.col("kind") == "delete", align.median_cer(F.array_join("tokens", " "), "written")))
    kept = found.where((F.col("kind") == "insert") | (F.col("consensus_cer") >= s.min_consensus_cer))
    return kept.select("clip_key", "kind", "position", "tokens", "first", "indices", "n_panel_agree", "n_panel", "consensus_cer", "verdicts")


def verdicts(edits: DataFrame) -> DataFrame:
    """One row for each edit and model: clip_key, kind, position, first, model, verdict."""
    return edits.select("clip_key", "kind", "position", "first", F.inline("verdicts"))


def accept_ref_rate(edits: DataFrame, *keys: str) -> DataFrame:
    """model (and ``keys``), n_ref, n_eligible, rate, lo, hi: how often a model sides with the reference; highest first."""
    rows = edits.select(*keys, F.inline("verdicts")).where("verdict is not null")
    by = rows.groupBy(*keys, "model").agg(F.count_if(F.col("verdict") == "ref").alias("n_ref"), F.count("*").alias("n_eligible"))
    by = by.withColumn("w", wilson(F.col("n_ref"), F.col("n_eligible")))
    return by.select(*keys, "model", "n_ref", "n_eligible", "w.rate", "w.lo", "w.hi").orderBy(*keys, F.desc("rate"), "model")


def accept_ref_rollup(edits: DataFrame, corpus: str) -> DataFrame:
    """The same counts for each model, each corpus and over all (null), in one pass."""
    rows = edits.select(corpus, F.inline("verdicts")).where("verdict is not null")
    by = rows.rollup(corpus, "model").agg(F.count_if(F.col("verdict") == "ref").alias("n_ref"), F.count("*").alias("n_eligible"))
    return by.withColumn("w", wilson(F.col("n_ref"), F.col("n_eligible"))).select(corpus, "model", "n_ref", "n_eligible", "w.rate", "w.lo", "w.hi")


def prominence(edits: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: clips analyzed and flagged, clips with deletions and insertions, spurious and missing tokens and their rates.

    ``refs`` has (clip_key, ref_tokens) of the analyzed clips.
    """
    total = refs.agg(F.count("*").alias("n_clips"), F.coalesce(F.sum(F.size("ref_tokens")), F.lit(0)).alias("total_ref_tokens"))
    deleted, inserted = F.col("kind") == "delete", F.col("kind") == "insert"
    found = edits.agg(
        F.count_distinct("clip_key").alias("n_flagged"),
        F.count_distinct(F.when(deleted, F.col("clip_key"))).alias("n_clips_delete"),
        F.count_distinct(F.when(inserted, F.col("clip_key"))).alias("n_clips_insert"),
        F.coalesce(F.sum(F.when(deleted, F.size("tokens"))), F.lit(0)).alias("spurious_tokens"),
        F.coalesce(F.sum(F.when(inserted, F.size("tokens"))), F.lit(0)).alias("missing_tokens"),
        F.count("*").alias("n_edits"),
    )
    both = total.crossJoin(found)  # one row each
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return both.select("*", share(F.col("n_flagged"), F.col("n_clips")).alias("flag_rate"), share(F.col("spurious_tokens"), F.col("total_ref_tokens")).alias("spurious_word_rate"), share(F.col("spurious_tokens") + F.col("missing_tokens"), F.col("total_ref_tokens")).alias("combined_rate"))


def corrected_transcripts(refs: DataFrame, edits: DataFrame) -> DataFrame:
    """(clip_key, ref_tokens, corrected): references with the unanimous edits applied; others stay."""
    unanimous = edits.where("n_panel_agree = n_panel")
    pick = lambda kind, position: F.flatten(F.transform(F.filter("found", lambda e: (e["kind"] == kind) & (e["position"] == position)), lambda e: e["tokens"]))
    by = unanimous.groupBy("clip_key").agg(F.collect_list(F.struct("kind", "position", "tokens", "indices")).alias("found"))
    joined = refs.join(by, "clip_key", "left")
    dropped = F.flatten(F.transform(F.filter("found", lambda e: e["kind"] == "delete"), lambda e: e["indices"]))
    fixed = align.corrected(F.col("ref_tokens"), dropped, pick("insert", "start"), pick("insert", "end"))
    return joined.select("clip_key", "ref_tokens", F.when(F.col("found").isNull(), F.col("ref_tokens")).otherwise(fixed).alias("corrected"))


def flips(verdict_rows: DataFrame, arm: str = "arm", base: str = "none") -> DataFrame:
    """arm, from_verdict, to_verdict, n: how verdicts on the same edits and models move from the base arm to others."""
    keys = ["clip_key", "kind", "first", "model"]
    before = verdict_rows.where(F.col(arm) == base).select(*keys, F.col("verdict").alias("from_verdict"))
    after = verdict_rows.where(F.col(arm) != base).select(*keys, F.col(arm).alias("arm"), F.col("verdict").alias("to_verdict"))
    return before.join(after, keys).groupBy("arm", "from_verdict", "to_verdict").agg(F.count("*").alias("n"))

"""Teacher-forced likelihood readouts, from token log-probabilities on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def hidden_tokens(tokens: DataFrame, keys: list[str], first: str = "hidden_first", end: str = "hidden_end") -> DataFrame:
    """(keys, i, token, logprob, first, end) rows whose characters overlap first..end-1 of the decoded text."""
    w = Window.partitionBy(*keys).orderBy("i")
    upto = F.sum(F.length("token")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = tokens.withColumns({"char_end": upto, "char_first": upto - F.length("token")})
    return placed.where((F.col("char_first") < F.col(end)) & (F.col("char_end") > F.col(first)))


def hidden_span(text: Column, hidden: Column, side: str = "head") -> Column:
    """struct(first, end): where the hidden words stand in the text, the first place (head, span) or the last (tail); as normalized words if not as they are; null if nowhere."""

    def find(t, h):
        at = F.instr(t, h) if side != "tail" else F.when(F.instr(F.reverse(t), F.reverse(h)) > 0, F.length(t) - F.instr(F.reverse(t), F.reverse(h)) - F.length(h) + 2).otherwise(0)
        return F.when((at > 0) & (F.length(h) > 0), F.struct((at - 1).cast("int").alias("first"), (at - 1 + F.length(h)).cast("int").alias("end")))

    return F.coalesce(find(text, hidden), find(F.lower(text), F.lower(hidden)))


def mean_nll(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, nll, n: minus the mean log-probability; NaN ones aren't counted."""
    value = F.when(~F.isnan("logprob"), F.col("logprob"))
    return tokens.groupBy(*keys).agg((-F.avg(value)).alias("nll"), F.count(value).alias("n"))


def recovery(none: Column, trunc: Column, full: Column) -> Column:
    """(none - trunc) / (none - full); NaN where the two hardly differ."""
    room = none - full
    return F.when(F.abs(room) > 1e-6, (none - trunc) / F.when(F.abs(room) > 1e-6, room)).otherwise(nan())


def gen_leak(hidden: Column, continuation: Column, stop: Column) -> Column:
    """Share of the hidden words, stop words aside, among the words of a continuation; NaN without any."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("([a-z']+)"), F.lit(1))
    wanted = F.filter(words(hidden), lambda w: ~F.array_contains(stop, w))
    got = words(F.coalesce(continuation, F.lit("")))
    n = F.size(wanted)
    return F.when(n > 0, F.size(F.filter(wanted, lambda w: F.array_contains(got, w))) / F.when(n > 0, n)).otherwise(nan())


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean likelihoods, recovery's median, clipped mean and share over a half, share of full leaks. NaN ones aren't counted."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    r, leak = known("recovery"), known("gen_leak")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *(F.avg(known(c)).alias(f"mean_{c}") for c in ("nll_full", "nll_trunc", "nll_none")),
        F.percentile(r, 0.5).alias("median_recovery"),
        F.avg(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), r))).alias("mean_recovery"),
        F.avg((r > 0.5).cast("double")).alias("share_recovered"),
        F.avg((leak >= 0.999).cast("double")).alias("share_leaked"),
    )


def perplexity(nll: Column, n: Column) -> Column:
    return F.exp(F.try_divide(nll, n))


def gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, total_nll_gap, median_ppl_gap of reference against corrected texts, and less each one's prior if there is one."""
    d = rows.withColumns({"_nll": F.col("nll_ref") - F.col("nll_cons"), "_ppl": perplexity(F.col("nll_ref"), F.col("n_ref")) - perplexity(F.col("nll_cons"), F.col("n_cons"))})
    out = [F.count("*").alias("n"), F.sum("_nll").alias("total_nll_gap"), F.percentile("_ppl", 0.5).alias("median_ppl_gap")]
    if {"nll_ref_prior", "nll_cons_prior"} <= set(rows.columns):
        out.append(F.sum(F.col("_nll") - (F.col("nll_ref_prior") - F.col("nll_cons_prior"))).alias("total_nll_lift"))
    return d.groupBy(*keys).agg(*out)


def audio_lift(rows: DataFrame, keys: list[str], least: int = 10, hard: float | None = 3.5) -> DataFrame:
    """keys, lift, n: mean of (nll_none - nll_trunc) per hidden character over cells with a hard prior; groups under ``least`` go."""
    kept = rows if hard is None else rows.where(F.col("nll_none") >= hard)
    lift = (F.col("nll_none") - F.col("nll_trunc")) / F.length("hidden_words")
    return kept.where((F.length("hidden_words") > 0) & ~F.isnan(lift)).groupBy(*keys).agg(F.avg(lift).alias("lift"), F.count("*").alias("n")).where(F.col("n") >= least)


def edit_lift(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, prior_per_char, lift_per_char over clips with a unanimous edit; ``edits`` has clip_key, chars, n_panel_agree, n_panel."""
    unanimous = edits.where("n_panel_agree = n_panel").groupBy("clip_key").agg(F.sum("chars").alias("chars"))
    gap = F.col("nll_ref") - F.col("nll_cons")
    prior = F.col("nll_ref_prior") - F.col("nll_cons_prior")
    by = rows.join(unanimous, "clip_key").where("chars > 0").groupBy(*keys)
    return by.agg(F.try_divide(F.sum(prior - gap), F.sum("chars")).alias("lift_per_char"), F.try_divide(F.sum(prior), F.sum("chars")).alias("prior_per_char"), F.count("*").alias("n"))


def two_arm_beta(rows: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """keys, beta, n_a, n_b: the smaller of two arms' means of the per-character gap, real less silenced, with arm b's sign turned."""
    d = ((F.col("gap_real") - F.col("gap_silent")) / F.col("chars")) * F.when(F.col("arm") == "a", 1).otherwise(-1)
    by = rows.where("chars > 0").withColumn("_d", d).groupBy(*keys)
    arm = lambda a, f: f(F.when(F.col("arm") == a, F.col("_d")))
    out = by.agg(arm("a", F.avg).alias("mean_a"), arm("b", F.avg).alias("mean_b"), arm("a", F.count).alias("n_a"), arm("b", F.count).alias("n_b"))
    return out.where((F.col("n_a") >= least) & (F.col("n_b") >= least)).withColumn("beta", F.least("mean_a", "mean_b"))

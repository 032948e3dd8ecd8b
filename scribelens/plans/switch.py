"""Orthographic switch rate: how often a model writes the arm that the reference uses, by its worst arm.

One pass over the joined clips: the arms that a reference uses are one array column, a clip is
exploded into the families it counts for, and everything else is one aggregation by model
and arm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson
from .families import Family, arms_in_common

_USE = "struct<family:string,arm:int,label:string,hit:boolean>"


#: The column of :func:`with_arms`.
ARMS = "_arms"


def with_arms(rows: DataFrame, families: Sequence[Family], reference: str = "reference") -> DataFrame:
    """Adds the reference's arm of each family (null for none), for :func:`tallies` of the same families.

    Before references are repeated for their models, this looks for the patterns once a reference.
    """
    return rows.withColumn(ARMS, F.array(*(f.arm_index(F.col(reference)) for f in families)))


def _use(family: Family, arm: Column, hyp: Column, label: Column, name: str) -> Column:
    hit = F.lit(False)
    for i in reversed(range(len(family.arms))):
        hit = F.when(arm == i, family.has(hyp, i)).otherwise(hit)
    return F.when(arm.isNotNull(), F.struct(F.lit(name).alias("family"), arm.alias("arm"), label.alias("label"), hit.alias("hit"))).cast(_USE)


def tallies(clips: DataFrame, families: Sequence[Family], *, pooled: str | None = None, roles: Sequence[str] | None = None, reference: str = "reference", hypothesis: str = "hypothesis", model: str = "model") -> DataFrame:
    """family, model, arm (index), label, hits, n of (reference, model, hypothesis) rows.

    With ``pooled`` all families are one of that name, arms take ``roles`` by position, and a
    clip counts once, for the first family whose reference arm is found. Null hypotheses
    aren't counted. A hit is any pattern of the reference's arm found in the hypothesis.
    Clips may bring the arms of :func:`with_arms` along.
    """
    hyp = F.col(hypothesis)
    rows = clips if ARMS in clips.columns else with_arms(clips, families, reference)
    arm = lambda i: F.get(ARMS, F.lit(i))
    labels = lambda f, i: F.get(F.array(*(F.lit(x) for x in (roles if pooled else f.labels))), arm(i))
    uses = [_use(f, arm(i), hyp, labels(f, i), pooled or f.name) for i, f in enumerate(families)]
    rows = rows.where(hyp.isNotNull())
    # outer: else filters inferred from the array would look for all patterns again
    use = F.coalesce(*uses) if pooled else F.explode_outer(F.filter(F.array(*uses), lambda u: u.isNotNull()))
    rows = rows.select(F.col(model).alias("model"), use.alias("use")).where("use is not null")
    return rows.groupBy(F.col("use.family").alias("family"), "model", F.col("use.arm").alias("arm"), F.col("use.label").alias("label")).agg(F.count_if("use.hit").alias("hits"), F.count("*").alias("n"))


def scores(tallied: DataFrame, least: int = 5) -> DataFrame:
    """family, model, switch, lo, hi, limiting_arm, n_total, follows_reference, arms (map of label to hits and n).

    A model needs two arms that the references use, each at least ``least`` times. The
    limiting arm has the smallest rate, the earliest of equals.
    """
    rate = F.col("hits") / F.col("n")
    worst = F.min_by(F.struct("label", "hits", "n"), F.struct(rate.alias("rate"), "arm"))
    arms = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("arm", "label", "hits", "n"))), lambda a: F.struct(a["label"], F.struct(a["hits"].alias("hits"), a["n"].alias("n")))))
    by = tallied.groupBy("family", "model").agg(worst.alias("worst"), F.sum("n").alias("n_total"), F.min("n").alias("fewest"), F.count("*").alias("n_arms"), arms.alias("arms"))
    by = by.where((F.col("n_arms") >= 2) & (F.col("fewest") >= least)).withColumn("w", wilson(F.col("worst.hits"), F.col("worst.n")))
    return by.select("family", "model", F.col("w.rate").alias("switch"), "w.lo", "w.hi", F.col("worst.label").alias("limiting_arm"), "n_total", (F.col("w.lo") > 0.5).alias("follows_reference"), "arms")


def switch_rates(clips: DataFrame, families: Sequence[Family], *, least: int = 5, **columns) -> DataFrame:
    """Each family by itself, best models first; families without a measurable model are absent."""
    return scores(tallies(clips, families, **columns), least).orderBy("family", F.desc("switch"), "model")


def switch_rate(clips: DataFrame, family: Family, *, least: int = 5, **columns) -> DataFrame:
    return switch_rates(clips, [family], least=least, **columns)


def pooled_switch_rate(clips: DataFrame, families: Sequence[Family], *, roles: Sequence[str], name: str = "pooled", least: int = 5, **columns) -> DataFrame:
    """All families as one; ``roles`` names the arms by position."""
    if arms_in_common(families) != len(roles):
        raise ValueError("as many arm names are needed as the families have arms")
    return scores(tallies(clips, families, pooled=name, roles=roles, **columns), least).orderBy(F.desc("switch"), "model")


def balanced_groups(clips: DataFrame, families: Sequence[Family], *, least_refs: int = 3, least_arm: int = 2, top: int = 15, least_groups: int = 2) -> tuple[DataFrame, DataFrame]:
    """Explorative: (family, model, switch, rank) and (model, mean_score, n).

    Stricter than :func:`tallies`: a hit is a hypothesis whose own first arm is the
    reference's. Families need two arms with ``least_refs`` references each, models arms of
    ``least_arm``; the best ``top`` models of each family are kept.
    """
    from pyspark.sql import Window

    from ..functions.stats import mean_of_groups

    uses = [F.struct(F.lit(f.name).alias("family"), f.arm_index(F.col("reference")).alias("arm"), F.coalesce(f.arm_index(F.col("reference")) == f.arm_index(F.col("hypothesis")), F.lit(False)).alias("hit")) for f in families]
    rows = clips.where("hypothesis is not null").select("clip_key", "model", F.explode(F.filter(F.array(*uses), lambda u: u["arm"].isNotNull())).alias("u")).select("clip_key", "model", "u.*")
    refs = rows.groupBy("family", "arm").agg(F.count_distinct("clip_key").alias("refs")).where(F.col("refs") >= least_refs)
    balanced = refs.groupBy("family").count().where("count >= 2").select("family")
    by_arm = rows.join(balanced, "family", "left_semi").groupBy("family", "model", "arm").agg(F.avg(F.col("hit").cast("double")).alias("rate"), F.count("*").alias("n")).where(F.col("n") >= least_arm)
    each = by_arm.groupBy("family", "model").agg(F.min("rate").alias("switch"), F.count("*").alias("arms")).where("arms >= 2").drop("arms")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("switch"), "model"))).where(F.col("rank") <= top)
    return ranked, mean_of_groups(each, "model", "switch", least_groups)


def highlighted(text: Column, family: Family, arm: int, mark: str = "[[$0]]") -> Column:
    """Every match of the arm's patterns in marks."""
    for pattern in family.arms[arm][1]:
        text = F.regexp_replace(text, pattern, mark)
    return text

"""URL filtering by explicit rules and by a path-template tree.

The paths of a host form a tree of segments, as deep as they go; hosts with few pages share
one tree. From the root down, a segment stays literal only if enough pages have it and its
labelled rate differs from the rest of its siblings (two-proportion z test). Segments that
don't differ are merged: frequent ones into the branch ``{~}``, the others, numbers and the
like, into the wildcard ``*``. A template, a path from the root to a leaf, is rejected if its
share of good labelled pages, smoothed towards the share overall, is too small.

Everything is DataFrame operations. The tree is built over distinct (host, segments) rows
with their counts, not over pages; a hot host costs partial sums and joins that can be split.
Below a node that too few pages have all is wildcard at once, so a level costs a step only
while some node of it is frequent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (``host/path...``) that fits, the first of equals; null if none does."""
    each = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        each.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*each) if each else F.lit(None).cast("struct<rule:string,verdict:string>")


def segments_of(path: Column) -> Column:
    """What stands between slashes, without empty segments."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


_SUMS = ("n", "labelled", "n_good")


def templates(pages: DataFrame, *, least: int = 5, share: float = 0.01, z: float = 1.96, prior: float = 4.0, least_host: int = 20) -> DataFrame:
    """(host, segments, template, labelled, purity) of (host, segments, good: 1, 0 or null) rows; stored."""
    sums = [F.sum(c).alias(c) for c in _SUMS]
    counted = stored(pages.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good")), "paths")
    size = counted.groupBy("host").agg(F.sum("n").alias("size"))
    tree = F.when(F.col("size") >= least_host, F.col("host")).otherwise("*")
    level = stored(counted.join(size, "host").select("host", tree.alias("tree"), "segments", *_SUMS, F.array().cast("array<string>").alias("t")), "tree")
    release(counted)
    while True:
        rows = level.withColumn("segment", F.when(F.size("t") < F.size("segments"), F.get("segments", F.size("t"))))
        children = stored(rows.where("segment is not null").groupBy("tree", "t", "segment").agg(*sums), "children")
        if children.isEmpty():
            release(children)
            break
        parents = children.groupBy("tree", "t").agg(*(F.sum(c).alias("p_" + c) for c in _SUMS))
        one = children.join(parents, ["tree", "t"])
        rest_n, rest_good = F.col("p_labelled") - F.col("labelled"), F.col("p_n_good") - F.col("n_good")
        rate = F.try_divide(F.col("p_n_good"), F.col("p_labelled"))
        spread = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), rest_n)))
        differs = F.abs(F.try_divide(F.try_divide(F.col("n_good"), F.col("labelled")) - F.try_divide(rest_good, rest_n), spread)) >= z
        literal = (F.col("n") >= least) & F.coalesce(differs, F.lit(False))
        frequent = (F.col("n") >= least) & (F.col("n") >= F.lit(share) * F.col("p_n"))
        token = F.when(literal, F.col("segment")).when(frequent, "{~}").otherwise("*")
        tokens = one.select("tree", "t", "segment", token.alias("token"), (F.col("p_n") < least).alias("rare"))
        below = F.when(F.col("rare"), F.concat("t", F.array_repeat(F.lit("*"), F.size("segments") - F.size("t")))).otherwise(F.concat("t", F.array("token")))
        deeper = stored(rows.join(tokens, ["tree", "t", "segment"], "left").select("host", "tree", "segments", *_SUMS, F.when(F.col("token").isNull(), F.col("t")).otherwise(below).alias("t")), "tree")
        release(level, children)
        level = deeper
    leaves = stored(level.groupBy("tree", "t").agg(*(F.sum(c).alias(c) for c in _SUMS[1:])), "leaves")
    total = leaves.agg(F.try_divide(F.sum("n_good"), F.sum("labelled"))).first()[0]
    purity = (F.col("n_good") + F.lit(prior * (1.0 if total is None else total))) / (F.col("labelled") + F.lit(prior))
    judged = leaves.select("tree", "t", "labelled", purity.alias("purity"))
    out = stored(level.select("host", "segments", "tree", "t").join(judged, ["tree", "t"]).select("host", "segments", F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"), "labelled", "purity"), "templates")
    release(level, leaves)
    return out


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), *, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "page_id", good_col: str = "good", least_purity: float = 0.55, **options) -> DataFrame:
    """(id, host, path, rule, verdict, template, labelled, purity) of every row of ``pages``.

    ``labels`` has a row's id and whether it is good (1 or 0); repeated ids count as good
    only if all are. ``verdict`` is the longest fitting rule's (the first of equally long
    ones), else block where the template's smoothed purity is under ``least_purity``, else
    allow. ``labelled`` is how many labelled pages the template has.

    A null url, or one without ``://``, has host and path '' and is of that host's template.
    Repeated rows are judged alike; rows with a null id have no label; without labels only
    rules block; very long urls are judged whole; other columns are ignored; no rows give no rows.
    """
    good = labels.where(F.col(label_id_col).isNotNull() & F.col(good_col).isNotNull()).groupBy(F.col(label_id_col).alias("id")).agg(F.min(F.col(good_col).cast("int")).alias("good"))
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    shaped = stored(rows.withColumn("segments", segments_of(F.col("path"))).join(good, "id", "left"), "pages")
    tree = templates(shaped.select("host", "segments", "good"), **options)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("purity") < least_purity, "block").otherwise("allow"))
    return shaped.join(tree, ["host", "segments"], "left").withColumn("r", rule).select("id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "labelled", "purity")

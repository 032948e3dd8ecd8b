"""SimHash near-duplicate detection with a pigeonring filter.

Fingerprints of 64 bits are cut into a ring of segments. If two fingerprints differ in at
most ``distance`` bits, then for some start on the ring every chain of l consecutive
segments from there differs in at most floor(l * distance / segments) bits (the strong form
of the pigeonring principle). The leading segments whose budget is 0 must be equal and
serve as the join key, once for each start; the longer chains are then checked one after
another, and the whole ring, which is the full Hamming distance, last.

Exact copies meet before that, as one fingerprint. A key that more than ``bucket``
fingerprints share is not joined with itself: there each fingerprint names all values
within half the distance of it, and two fingerprints are within the distance exactly if
they name a common value. A value has at most as many namers as a ball has members, so no
group grows with the data, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bytes_of, pieces, release, stored, temporary
from .words import mixed


def fingerprint_of(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text (see :func:`fingerprints`)."""
    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) for w in found]) + np.arange(len(found))
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(found) < words:
        cuts = [(0, len(line))]
    else:
        cuts = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array([hash_(line[a:b], seed) for a, b in cuts], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # bounded work arrays for very long texts
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprinter(words: int, seed: int):
    @arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint_of(x.as_py(), words, seed) for x in batch], np.uint64).view(np.int64), pa.int64())

    return run


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint) of every row: a bit is 1 if set in over half of the XXH64 hashes of the word shingles.

    Words are runs between ASCII white space, A-Z lower-cased, shingles keep repeats; a text
    of fewer words is one shingle, a text without a word (or null) has fingerprint 0.
    """
    return documents.select(F.col(id_col).alias("id"), _fingerprinter(words, seed)(bytes_of(F.col(text_col))).alias("fingerprint"))


def _segments(segments: int) -> list[int]:
    """Bit masks of the ring's segments, as signed 64-bit numbers."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [_signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(radius: int) -> list[int]:
    return [_signed(sum(1 << i for i in c)) for r in range(radius + 1) for c in combinations(range(64), r)]


def links(prints: DataFrame, *, distance: int = 2, segments: int = 5, bucket: int = 32) -> DataFrame:
    """Edges (band, a, b), a < b, among distinct (band, fingerprint) rows that connect all of a band that are within ``distance`` bits.

    Every edge is within the distance. Pairs are complete where at most ``bucket``
    fingerprints share a key; elsewhere, for a distance of 2, the edges connect the same
    fingerprints by fewer links. For other distances all pairs within keys are looked at.
    """
    if not 0 < distance < segments <= 32:
        raise ValueError("segments must be more than distance, 32 at most")
    masks = _segments(segments)
    budget = [(n * distance) // segments for n in range(segments + 1)]
    free = max(n for n in range(1, segments) if budget[n] == 0)
    chain = lambda start, n: _signed(sum(masks[(start + i) % segments] & ((1 << 64) - 1) for i in range(n)) & ((1 << 64) - 1))
    keys = F.array(*(F.struct((F.col("band") * segments + i).alias("start"), F.col("fingerprint").bitwiseAND(F.lit(chain(i, free))).alias("key")) for i in range(segments)))
    keyed = stored(prints.select("fingerprint", F.inline(keys)), "keys")
    counts = keyed.groupBy("start", "key").count().where("count > 1")
    counts = stored(counts, "counts")
    shared = stored(keyed.join(counts, ["start", "key"]), "shared")
    release(keyed, counts)

    differ = lambda start, n: F.bit_count(F.col("l.fingerprint").bitwiseXOR(F.col("r.fingerprint")).bitwiseAND(F.lit(chain(start, n))))
    within = F.lit(False)
    for i in range(segments):
        ok = F.col("l.start") % segments == i
        for n in range(free + 1, segments + 1):
            ok = ok & (differ(i, n) <= F.lit(budget[n]))
        within = within | ok
    few = shared.where(F.col("count") <= bucket) if distance == 2 else shared
    pairs = few.alias("l").join(few.alias("r"), (F.col("l.start") == F.col("r.start")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fingerprint") < F.col("r.fingerprint")) & within)
    band = F.floor(F.col("start") / segments).cast("int").alias("band")
    found = pairs.select(F.col("l.start").alias("start"), F.col("l.fingerprint").alias("a"), F.col("r.fingerprint").alias("b")).select(band, "a", "b")
    if distance == 2:
        many = shared.where(F.col("count") > bucket).select(band, "fingerprint").distinct()
        ball = F.array(*(F.lit(x) for x in _ball(1)))
        named = many.select("band", "fingerprint", F.explode(F.transform(ball, lambda x: F.col("fingerprint").bitwiseXOR(x))).alias("value"))
        # at most 65 fingerprints name a value
        groups = named.groupBy("band", "value").agg(F.sort_array(F.collect_list("fingerprint")).alias("namers")).where(F.size("namers") > 1)
        found = found.unionByName(groups.select("band", F.element_at("namers", 1).alias("a"), F.explode(F.slice("namers", 2, 64)).alias("b")))
    return found.distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b: comparable) reaches.

    Alternates large-star and small-star steps until nothing changes. A step is an
    aggregation with map-side combine and a join that adaptive execution can split, so a hub
    with any number of neighbours is never gathered; each round is stored.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        # large star: each neighbour above a node is tied to the node's least
        large = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
        large = stored(large.where("a != b").distinct(), "large")
        # small star: neighbours below a node, and the node itself, are tied to their least
        lower = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(lower, "a").select(F.inline(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        small = stored(small.where("a != b").distinct(), "edges")
        release(edges, least, large, lower)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def clusters(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, distance: int = 2, segments: int = 5, bucket: int = 32) -> DataFrame:
    """(id, fingerprint, component) of every row; component is the smallest id that the row reaches by links.

    Null and empty texts have fingerprint 0 and are linked like others. A null id gets its
    component's smallest id (null if none has an id). Rows with the same text, and rows that
    are repeated, are of one component. Other columns are ignored; no rows give no rows.
    """
    printed = stored(fingerprints(documents, id_col=id_col, text_col=text_col, words=words, seed=seed), "prints")
    distinct = stored(printed.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct")
    found = links(distinct.select(F.lit(0).alias("band"), "fingerprint"), distance=distance, segments=segments, bucket=bucket)
    roots = stored(components(found), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least")
    rooted = stored(rooted, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component")), "least")
    named = stored(rooted.join(least, "root").select("fingerprint", "component"), "named")
    return printed.join(named, "fingerprint").select("id", "fingerprint", "component")


def _shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles; a shorter text is one shingle."""
    found = text.lower().split()
    parts = (b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))
    return np.unique(np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], np.uint64))


def _signatures(words: int, bands: int, rows: int):
    """Per text: a digest of its words, its fingerprint (see :func:`fingerprints`), and for each band a hash of the ``rows`` smallest values that its shingles take under as many orders.

    All in one function, so that a task has one Python worker; results leave by pieces of a batch.
    """
    seeded = np.random.default_rng(42)
    factor, shift = (seeded.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    @arrow_udf("struct<high:bigint,low:bigint,fingerprint:bigint,bands:array<bigint>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in pieces(batch, 1 << 20):
                whole = np.zeros((len(texts), 3), np.uint64)
                keys = np.zeros((len(texts), bands), np.uint64)
                for n, text in enumerate(texts):
                    text = text.as_py()
                    digest = xxhash.xxh3_128_intdigest(b" ".join(text.lower().split()))
                    whole[n] = digest >> 64, digest & ((1 << 64) - 1), fingerprint_of(text)
                    each = mixed(_shingles(text, words))
                    least = np.full(bands * rows, (1 << 64) - 1, np.uint64)
                    for i in range(0, len(each), 1024):
                        np.minimum(least, (each[i : i + 1024, None] * factor + shift).min(axis=0), out=least)
                    for column in least.reshape(bands, rows).T:
                        keys[n] = mixed(keys[n] ^ column)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.StructArray.from_arrays([*(pa.array(x.copy().view(np.int64)) for x in whole.T), lists], names=["high", "low", "fingerprint", "bands"])

    return sign


def _shingler(words: int):
    """Per text its shingles; they are as large as the texts, so they leave by pieces of a batch."""

    @arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in pieces(batch, 1 << 20):
                yield pa.array([_shingles(text.as_py(), words).view(np.int64) for text in texts], pa.list_(pa.int64()))

    return run


def _similarities(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """(a, b, j): the Jaccard similarity of each pair (a, b) by the shingles of ``sets``; with ``differences`` also the sets' sizes and what b has beyond a, then what it lacks of a, each in order, and the number of the latter.

    Pairs are stored, so Spark knows how few they are; sets of no pair are left out before they are dealt.
    """
    needed = sets.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(needed.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    more = [F.size("x").alias("na"), F.size("y").alias("nb"), F.concat(F.sort_array(F.array_except("y", "x")), F.sort_array(F.array_except("x", "y"))).alias("change"), (F.size("x") - common).alias("lacks")] if differences else []
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("j"), *more)


def _fingerprint_links(texts: DataFrame, distance: int, segments: int, bucket: int) -> DataFrame:
    """Pairs (a, b), a < b, of texts (node, fingerprint) that connect all whose fingerprints are within ``distance`` bits, see :func:`links`."""
    prints = stored(texts.groupBy("fingerprint").agg(F.min("node").alias("owner")), "distinct")
    found = stored(links(prints.select(F.lit(0).alias("band"), "fingerprint"), distance=distance, segments=segments, bucket=bucket), "links")
    same = texts.join(prints, "fingerprint").where("node <> owner").select(F.col("owner").alias("a"), F.col("node").alias("b"))
    ends = [prints.select(F.col("fingerprint").alias(side), F.col("owner").alias(node)) for side, node in (("a", "l"), ("b", "r"))]
    near = found.join(ends[0], "a").join(ends[1], "b").select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))
    out = stored(same.unionByName(near), "near")
    release(prints, found)
    return out


def _within(groups: DataFrame, bucket: int, roots: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b), a < b, within the groups of at most ``bucket`` nodes, but those that ``roots`` (node, root) has as one component."""
    few = groups.where(F.col("n") <= bucket).select("band", "key", "node")
    few = few.withColumn("root", F.col("node")) if roots is None else few.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pairs = few.alias("l").join(few.alias("r"), ["band", "key"]).where("l.node < r.node and l.root <> r.root")
    return pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly, whatever their keys."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b), a < b, that can reach ``similarity``: two such sets share one of the rarest shingles of each, after which enough are left in both."""
    each = _dealt(sets.select("id", "shingles")).select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    # shingles that only one text has come first and meet nothing, so only their number counts
    ranked = each.join(often, "shingle").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("ranked"))
    ranked = ranked.withColumn("own", F.col("n") - F.size("ranked"))
    most = F.greatest(F.col("n") - F.ceil(F.col("n") * similarity - 1e-6).cast("int") + 1 - F.col("own"), F.lit(0))
    prefix = stored(ranked.select("id", "n", "own", F.posexplode(F.slice("ranked", 1, most)).alias("at", "s")).select("id", "n", (F.col("own") + F.col("at")).alias("p"), "s.shingle"), "prefix")
    fits = F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * similarity - 1e-6
    left = F.least(F.col("l.n") - F.col("l.p"), F.col("r.n") - F.col("r.p")) >= (F.col("l.n") + F.col("r.n")) * (similarity / (1 + similarity)) - 1e-6
    pairs = prefix.alias("l").join(prefix.alias("r"), "shingle").where((F.col("l.id") < F.col("r.id")) & fits & left)
    out = stored(pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct(), "pairs")
    release(prefix)
    return out


def _difference_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, that can reach ``similarity``, of texts compared with one owner (a, b: the text, na, nb, change, fringe), one of them on the fringe, that is below it.

    Two texts x and y differ where exactly one of their changes against the owner o does, so
    at similarity t their changes share (|dx| + |dy| - (|x| + |y|)(1 - t)/(1 + t)) / 2 or
    more. For a text on the fringe |dx| > (|x| + |o|)(1 - t)/(1 + t), so of y's changes more
    than half must be shared and one of their first half or so stands among x's. First come
    new shingles that few of the owner's texts have, then those that many have, then what is
    lacking of the owner, so texts that merely lack the same shingles seldom meet.
    """
    slack = (1 - similarity) / (1 + similarity)
    # more than a sixteenth of an owner's texts have them: at most sixteen times a text's changes
    texts = members.groupBy("a").agg(F.count("*").alias("texts"))
    # dealt by text, since one owner may have most texts; small tables are stored first, so that Spark knows their size
    new = F.slice("change", 1, F.size("change") - F.col("lacks"))
    common = _dealt(members.select("a", new.alias("new"))).select("a", F.explode("new").alias("e")).groupBy("a", "e").agg(F.count("*").alias("n")).where("n >= 8")
    common = common.join(texts, "a").where("n * 16 > texts").groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]).alias("common"))
    common = stored(common, "common")
    lacking = F.slice("change", F.size("change") - F.col("lacks") + 1, F.col("lacks"))
    ordered = F.when(F.col("common").isNull(), F.col("change")).otherwise(F.concat(F.array_except(new, "common"), F.array_intersect("common", new), lacking))
    members = _dealt(stored(members.join(common, "a", "left").withColumn("change", ordered).drop("common"), "changes"))
    d = F.size("change")
    least_y = F.floor((d + (F.col("na") - F.col("nb")) * slack) / 2 + 1e-6).cast("int")  # this many and one more
    least_x = F.ceil(d - F.col("nb") * ((1 - similarity) / similarity) - 1e-6).cast("int")
    first = lambda rows, need: rows.select(F.col("a").alias("owner"), "b", "nb", d.alias("d"), F.posexplode(F.slice("change", 1, F.greatest(d - F.greatest(need, F.lit(1)) + 1, F.lit(0)))).alias("p", "e"))
    x, y = first(members.where("fringe"), least_x).alias("x"), first(members, least_y + 1).alias("y")
    left = F.least(F.col("x.d") - F.col("x.p"), F.col("y.d") - F.col("y.p")) >= (F.col("x.d") + F.col("y.d") - (F.col("x.nb") + F.col("y.nb")) * slack) / 2 - 1e-6
    met = x.join(y, (F.col("x.owner") == F.col("y.owner")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.b") != F.col("y.b")) & left)
    return met.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def _links(groups: DataFrame, sets: DataFrame, similarity: float, bucket: int, rounds: int = 3, settled: DataFrame | None = None) -> DataFrame:
    """Edges (a, b), each alike, that connect all pairs within a group (band, key, node, n: its size) that are alike; takes ``groups`` over.

    ``settled`` has edges that are known to be alike; they are among the result, and texts that
    they connect aren't compared with each other again.

    Groups of at most ``bucket`` texts are compared pair by pair. In a larger one all are
    compared with an owner, the text with the largest groups, which is the one that most
    others are copies of. Those like it are linked. As 1 - J is a metric, a text at
    2 * similarity - 1 or more with the owner can only be alike to others at
    3 * similarity - 2 or more with it, so it leaves the group, and what it has in common with
    those others is looked for among their changes against the owner, see
    :func:`_difference_pairs`. The rest is a group of its own. What is still large after some
    rounds is many texts unlike each other: they are paired by their rarest shingles.
    """
    pairs, near = [], []
    known = None if settled is None else stored(components(settled), "roots")
    for _ in range(rounds):
        pairs.append(stored(_within(groups, bucket, known), "pairs"))
        large = groups.where(F.col("n") > bucket).select("band", "key", "node", "n")
        if large.isEmpty():
            break
        central = large.groupBy("node").agg(F.sum("n").alias("score"))
        owners = stored(large.join(central, "node").groupBy("band", "key").agg(F.max(F.struct("score", "node")).alias("o")).select("band", "key", F.col("o.node").alias("owner")), "owners")
        star = stored(large.join(owners, ["band", "key"]).where("node <> owner").select("band", "key", "node", "owner"), "star")
        spokes = stored(star.select(F.col("owner").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
        seen = stored(_similarities(spokes, sets, True).where(F.col("j") >= 3 * similarity - 2 - 1e-9), "near")
        near.append(seen)
        gone = seen.where(F.col("j") >= 2 * similarity - 1 - 1e-9).select(F.col("a").alias("owner"), F.col("b").alias("node"))
        left = stored(star.join(gone, ["owner", "node"], "left_anti").select("band", "key", "node"), "left")
        counts = stored(left.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
        rest = stored(left.join(counts, ["band", "key"]), "groups")
        release(owners, star, spokes, left, counts, groups)
        groups = rest
    else:
        pairs.append(stored(_within(groups, bucket, known), "pairs"))
        rest = stored(groups.where(F.col("n") > bucket).select(F.col("node").alias("id")).distinct(), "rest")
        if not rest.isEmpty():
            pairs.append(_prefix_pairs(sets.join(rest, "id", "left_semi"), similarity))
        release(rest)
    release(groups)
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    candidates = stored(union(pairs).distinct(), "pairs")
    alike = _similarities(candidates, sets).where(F.col("j") >= similarity).select("a", "b")
    if settled is not None:
        alike = alike.unionByName(settled)
    if near:
        seen = union(near)
        alike = stored(alike.unionByName(seen.where(F.col("j") >= similarity).select("a", "b")), "alike")
        roots = stored(components(alike), "roots")
        # a text of no edge is its own root; one that is linked to its owner by others needs no more links
        apart = F.coalesce("root", "a") != F.coalesce("other", "b")
        marked = seen.join(roots.toDF("a", "root"), "a", "left").join(roots.toDF("b", "other"), "b", "left").withColumn("fringe", (F.col("j") < similarity) & apart)
        marked = stored(marked.select(*seen.columns, "fringe"), "marked")
        release(roots)
        owners = stored(marked.where("fringe").select("a").distinct(), "owners")
        found = stored(_difference_pairs(marked.join(owners, "a", "left_semi"), similarity), "fringe")
        both = stored(alike.unionByName(_similarities(found, sets).where(F.col("j") >= similarity).select("a", "b")), "alike")
        release(alike, marked, owners, found, *near)
        alike = both
    else:
        alike = stored(alike, "alike")
    release(candidates, *pairs, *([] if known is None else [known]))
    return alike


def similar_groups(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 4, bucket: int = 32, distance: int = 2, segments: int = 5) -> DataFrame:
    """(id, component) of every row: rows are linked if their word-shingle sets have a Jaccard similarity of ``similarity`` or more.

    Texts with the same words are one group. Then the fingerprints of :func:`fingerprints` are
    linked within ``distance`` bits by the pigeonring filter and the full Hamming check as in
    :func:`clusters`; each link is checked by the texts' exact shingles, and those that hold
    make components.

    At 0.8 two fingerprints differ in some ten bits, which no filter tells from chance, so the
    rest has a way of its own, by the shingles and whatever the kind of edit: each text has
    ``bands`` keys, each made of the smallest hashes of its shingles under ``rows`` orders
    (MinHash). Texts at similarity J share a given key with a chance of J^rows, so a pair at 0.8
    is missed with (1 - 0.8^4)^24 = 3 in a million, one at 0.9 never in practice. Texts of
    different components that share a key are checked by their exact shingles; within a key no
    link is lost (see :func:`_links`).

    ``component`` is the smallest id reachable. Ids must be comparable and not null; texts
    without words are copies of each other.
    """
    texts_in = documents.select(F.col(id_col).alias("id"), bytes_of(F.col(text_col)).alias("text"))
    signed = texts_in.select("id", _signatures(words, bands, rows)(F.col("text")).alias("s"))
    signed = stored(signed.select("id", "s.*"), "signed")
    texts = stored(signed.groupBy("high", "low").agg(F.min("id").alias("node"), F.any_value("fingerprint").alias("fingerprint"), F.any_value("bands").alias("bands")), "texts")
    near = _fingerprint_links(texts.select("node", "fingerprint"), distance, segments, bucket)
    keys = stored(texts.select("node", F.posexplode("bands").alias("band", "key")), "keys")
    counts = stored(keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    groups = stored(keys.join(counts, ["band", "key"]), "groups")
    release(keys, counts)
    ends = groups.select(F.col("node").alias("id")).unionByName(near.select(F.explode(F.array("a", "b")).alias("id")))
    ends = stored(ends.distinct(), "ends")
    sets = stored(texts_in.join(ends, "id", "left_semi").select("id", _shingler(words)(F.col("text")).alias("shingles")), "shingles")
    release(ends)
    settled = stored(_similarities(near, sets).where(F.col("j") >= similarity).select("a", "b"), "settled")
    alike = _links(groups, sets, similarity, bucket, settled=settled)
    release(near, settled, sets)
    roots = stored(components(alike), "roots")
    named = texts.join(roots.withColumnRenamed("root", "component"), "node", "left").select("high", "low", F.coalesce("component", "node").alias("component"))
    named = stored(named, "named")
    release(texts, alike, roots)
    return signed.select("id", "high", "low").join(named, ["high", "low"]).select("id", "component")


def deduplicated(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of similar texts (see :func:`similar_groups`), the one with the smallest id, with all its columns.

    Rows that share an id are told apart by their place; a row without an id stays only where
    its group has no other. Null and empty texts are one group. The input is stored with its
    places, since another scan may split its files elsewhere and count otherwise.
    """
    (row,) = temporary(documents, "row")
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "documents")
    groups = similar_groups(numbered, id_col=row, text_col=text_col, **options)
    rank = F.struct(F.col("i").isNull().alias("none"), "i", "id")
    members = stored(groups.join(numbered.select(F.col(row).alias("id"), F.col(id_col).alias("i")), "id").select("component", "id", rank.alias("rank")), "members")
    kept = stored(members.groupBy("component").agg(F.min("rank").alias("best")).select("component", F.col("best.id").alias("best")), "kept")
    gone = stored(members.join(kept, "component").where("id <> best").select(F.col("id").alias(row)), "gone")
    release(members, kept)
    return numbered.join(gone, row, "left_anti").drop(row)

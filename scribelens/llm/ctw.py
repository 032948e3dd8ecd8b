"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision in each context (the bytes before it, up to
``depth``) has a Krichevsky-Trofimov estimator. The tree's weights mix, at every context,
stopping there against splitting by one more byte, so a prediction is a mixture over all
depths. Block probabilities of KT estimators depend on counts alone, so training is one
distributed count of byte n-grams (a context and the byte after it) over all training texts.

The tree has every context of the corpus and lives in stored tables, never in one place:

* upwards, subtrees below contexts of ``depth - 2`` bytes are weighted where they lie
  together, then those below two bytes; what is left for the driver are the contexts of two
  bytes at most, 2**16 of them by 255 decisions in any corpus;
* downwards the same cuts hand each subtree what the contexts above give to its decisions,
  and every n-gram that occurs in any document, learned or not, gets its probability.

Documents are then scored by n-gram. The ``common`` most frequent n-grams and ``frequent``
most frequent words are looked up in place, all others are joined; both numbers bound what is
broadcast and change no result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bytes_of, flat, pieces, release, stored

#: Ends every text and fills the context before its first byte; never part of UTF-8.
END = 0xFF
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONGEST_WORD = 64
#: Bytes of text that are worked on together; the arrays take some 70 bytes for each.
PIECE = 1 << 19
LOG2 = math.log(2)


def codes(data: np.ndarray, at: np.ndarray, depth: int, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each byte of each text, and its end, the n-gram as a number: the byte lowest, above it the byte farthest before it, and so on to the nearest.

    Yields codes and the text of each, for all texts at once or, for one long text, for parts of it.
    """
    for first in range(0, max(1, len(data)), most) if len(at) == 2 else (0,):
        last = first + most >= len(data) or len(at) > 2
        if len(at) == 2:
            before = max(0, first - depth)
            part = data[before : len(data) if last else first + most]
            text = np.full(depth - (first - before) + len(part) + last, END, np.uint8)
            text[depth - (first - before) :][: len(part)] = LOWER[part]
            places = np.arange(depth, len(text))
            of = np.zeros(len(places), np.int64)
        else:
            lengths = np.diff(at)
            text = np.full(len(data) + len(lengths) * (depth + 1), END, np.uint8)
            text[np.arange(len(data)) + np.repeat(np.arange(len(lengths)) * (depth + 1) + depth, lengths)] = LOWER[data]
            of = np.repeat(np.arange(len(lengths)), lengths + 1)
            places = np.arange(len(of)) + (of + 1) * depth
        whole = np.zeros(len(text) - depth, np.int64)
        for d in range(1, depth + 1):
            whole |= text[depth - d : len(text) - d].astype(np.int64) << (8 * (depth - d + 1))
        whole |= text[depth:]
        yield whole[places - depth], of


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[cuts], np.diff(np.append(cuts, len(values)))


_COUNTS = "gram bigint, word binary, n bigint"


def _counts(depth: int, most: int = 800_000, most_words: int = 100_000):
    """Partial counts of (text, whether it is learned from) rows; n-grams of other texts come with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(grams=None, found=None, n=()):
            size = len(n)
            columns = [pa.nulls(size, pa.int64()) if grams is None else pa.array(grams), pa.nulls(size, pa.binary()) if found is None else pa.array(found, pa.binary()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["gram", "word", "n"])

        def merge():
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            parts[:] = [(keys, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64))]

        for batch in batches:
            for learned in (True, False):
                for texts in pieces(batch.column(0).filter(pc.equal(batch.column(1), learned)), PIECE):
                    data, at = flat(texts)
                    if learned:
                        found = data.tobytes()
                        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                            words.update(found[i:j].lower().split())
                        words[b"\n"] += len(texts)  # the end token; no word has a line break
                    for grams, _ in codes(data, at, depth):
                        keys, n = _counted(grams)
                        parts.append((keys, n if learned else np.zeros(len(keys), np.int64)))
                    if sum(len(k) for k, _ in parts) > 2 * most:
                        merge()
                        if len(parts[0][0]) > most:
                            yield rows(parts[0][0], None, parts[0][1])
                            parts.clear()
                    if len(words) > most_words:
                        yield rows(None, list(words), list(words.values()))
                        words.clear()
        if words:
            yield rows(None, list(words), list(words.values()))
        if parts:
            merge()
            yield rows(parts[0][0], None, parts[0][1])

    return run


# ------------------------------------------------------------------ the tree
#
# A level of the tree is arrays over (context, decision) pairs: key = context << 8 | decision,
# zeros and ones seen, and the logarithm of the weighted block probability. Contexts are
# written with the nearest byte highest, so a context without its farthest byte is a shift.


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * np.where(x < 64, x + i, 1.0)
    y = np.where(x < 64, x + 8, x)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log block probability by KT."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1)


class Level:
    """(context, decision) pairs of one depth, sorted by key."""

    def __init__(self, key, zeros, ones, weighted, stop, at):
        self.key, self.zeros, self.ones, self.weighted, self.stop, self.at = key, zeros, ones, weighted, stop, at

    def next_one(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def up(self) -> Level:
        """The level above; ``at`` of the new one says where each of these pairs has gone."""
        key, at = np.unique((self.key >> 16 << 8) | (self.key & 255), return_inverse=True)
        zeros, ones, split = (np.bincount(at, weights=x, minlength=len(key)) for x in (self.zeros, self.ones, self.weighted))
        own = log_block(zeros, ones)
        both = np.logaddexp(own, split) - LOG2
        return Level(key, zeros, ones, both, np.exp(np.minimum(own - LOG2 - both, 0.0)), at)


_PATH = np.arange(8)


def leaves(grams: np.ndarray, n: np.ndarray) -> Level:
    """The deepest level, of n-grams and their counts; ``at`` has a row of eight pairs for each n-gram."""
    nodes = (grams >> 8 << 8)[:, None] | ((256 + (grams & 255))[:, None] >> (8 - _PATH))
    key, at = np.unique(nodes, return_inverse=True)
    at = at.reshape(nodes.shape)
    ones = ((grams[:, None] >> (7 - _PATH)) & 1) * n[:, None]
    one = np.bincount(at.ravel(), weights=ones.ravel(), minlength=len(key))
    zero = np.bincount(at.ravel(), weights=(n[:, None] - ones).ravel(), minlength=len(key))
    own = log_block(zero, one)
    return Level(key, zero, one, own, np.ones(len(key)), at)


def chain(level: Level, steps: int) -> list[Level]:
    """``level`` and as many levels above it."""
    out = [level]
    for _ in range(steps):
        out.append(out[-1].up())
    return out


def descended(levels: list[Level], given: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What all depths down to ``levels[0]`` give to its pairs, and the weight left below; ``given`` and ``left`` are those of ``levels[-1]``."""
    for upper, lower in zip(levels[::-1], levels[-2::-1], strict=False):
        g, w = given[upper.at], left[upper.at]
        given, left = g + w * lower.stop * lower.next_one(), w * (1 - lower.stop)
    return given, left


def top(level: Level, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`descended` from the root for a level of ``depth`` bytes."""
    levels = chain(level, depth)
    root = levels[-1]
    return descended(levels, root.stop * root.next_one(), 1 - root.stop)


def log_scores(grams: np.ndarray, level: Level, given: np.ndarray) -> np.ndarray:
    """Log10 probability of each n-gram's byte by the probabilities of a one at the deepest level."""
    p = np.clip(given[level.at], 1e-12, 1 - 1e-12)
    return np.log10(np.where((grams[:, None] >> (7 - _PATH)) & 1, p, 1 - p)).sum(axis=1)


_ROW = "group bigint, kind int, key bigint, a double, b double, c double"


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows that come group by group, in runs of whole groups of some ``most`` rows."""
    held: list[pa.RecordBatch] = []
    arrays = lambda t: {name: t[name].to_numpy() for name in t.column_names}
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            table = pa.Table.from_batches(held)
            group = table["group"].to_numpy()
            end = int(np.searchsorted(group != group[-1], False)) if group[0] == group[-1] else int(np.flatnonzero(group != group[-1])[-1]) + 1
            if end:
                yield arrays(table.slice(0, end))
            held = table.slice(end).combine_chunks().to_batches()
    if held:
        yield arrays(pa.Table.from_batches(held))


def _level_of(x: dict[str, np.ndarray], of_grams: bool) -> Level:
    if of_grams:
        return leaves(x["key"], x["a"])
    own = log_block(x["a"], x["b"])
    return Level(x["key"], x["a"], x["b"], x["c"], np.exp(np.minimum(own - LOG2 - x["c"], 0.0)), None)


def _upwards(steps: int, of_grams: bool):
    """Rows of a level (or n-grams) to the level ``steps`` above."""

    def run(batches):
        for x in _whole_groups(batches):
            out = chain(_level_of(x, of_grams), steps)[-1]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (out.key, out.zeros, out.ones, out.weighted)], names=["key", "a", "b", "c"])

    return run


def _downwards(steps: int, of_grams: bool):
    """What the level ``steps`` above is given (kind 0) and rows of a level (kind 1) to what that level is given, or to scores of n-grams."""

    def run(batches):
        for x in _whole_groups(batches):
            above, own = ({k: v[x["kind"] == kind] for k, v in x.items()} for kind in (0, 1))
            levels = chain(_level_of(own, of_grams), steps)
            where = np.searchsorted(above["key"], levels[-1].key)
            given, left = descended(levels, above["a"][where], above["b"][where])
            columns = [own["key"], log_scores(own["key"], levels[0], given), own["a"]] if of_grams else [own["key"], given, left]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["key", "a", "b"])

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group", "kind", "key")


def scores_of(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, score, n): the log10 probability of each row's byte in its context, by the tree over all rows (gram, n); stored.

    A row with n = 0 has no part in the tree. Shuffles are by contexts of ``depth - 2`` bytes,
    below which there are at most 2**24 n-grams, and by contexts of two bytes.
    """
    spark = grams.sparkSession
    lower = max(depth - 2, 0)
    upper = min(2, lower)
    nothing = F.lit(None).cast("double")
    row = lambda df, kind, bytes_below, *abc: df.select(F.shiftright("key", 8 * bytes_below + 8).alias("group"), F.lit(kind).alias("kind"), "key", *(x.alias(n) for x, n in zip((*abc, nothing, nothing), "abc", strict=False)))
    n = F.col("n").cast("double")
    leaf = grams.withColumnRenamed("gram", "key")
    below = stored(_grouped(row(leaf, 1, depth - lower, n)).mapInArrow(_upwards(depth - lower, True), "key bigint, a double, b double, c double"), "level")
    level = lambda df, bytes_below: row(df, 1, bytes_below, F.col("a"), F.col("b"), F.col("c"))
    middle = below
    if lower > upper:
        middle = stored(_grouped(level(below, lower - upper)).mapInArrow(_upwards(lower - upper, False), "key bigint, a double, b double, c double"), "level")
    # at most 2**16 contexts of 255 decisions, whatever the corpus
    whole = {k: np.asarray(v.to_numpy()) for k, v in zip("kabc", middle.sort("key").toArrow().columns, strict=True)}
    whole["key"] = whole.pop("k")
    given, left = top(_level_of(whole, False), upper) if len(whole["key"]) else (np.zeros(0), np.zeros(0))
    named = stored(spark.createDataFrame(pa.table({"key": whole["key"], "a": given, "b": left}), "key bigint, a double, b double"), "given")
    parents = lambda df, bytes_below: row(df, 0, bytes_below, F.col("a"), F.col("b"))
    if lower > upper:
        both = parents(named, 0).unionByName(level(below, lower - upper))
        finer = stored(_grouped(both).mapInArrow(_downwards(lower - upper, False), "key bigint, a double, b double"), "given")
        release(named, middle)
        named = finer
    both = parents(named, 0).unionByName(row(leaf, 1, depth - lower, n))
    out = _grouped(both).mapInArrow(_downwards(depth - lower, True), "key bigint, a double, b double")
    out = stored(out.select(F.col("key").alias("gram"), F.col("a").alias("score"), F.col("b").cast("bigint").alias("n")), "gram_scores")
    release(named, below)
    return out


# ------------------------------------------------------------------ scoring


def _threshold(counts: DataFrame, most: int) -> int:
    """The smallest power-of-two-quarter count that at most ``most`` rows (column n) reach."""
    steps = counts.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int").alias("step")).count().collect()  # a few hundred rows at most
    total, least = 0, None
    for step, n in sorted(((r["step"], r["count"]) for r in steps), reverse=True):
        total += n
        if total > most:
            break
        least = step
    return (1 << 62) if least is None else math.ceil(2 ** (least / 4) - 1e-9)


_FOUND = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))), ("grams", pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int32())])))])


def _list(counts: np.ndarray, kind: pa.DataType, keys, n) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(keys, kind.value_type[0].type), pa.array(n, pa.int32())], fields=list(kind.value_type)))


def _scorer(depth: int, frequent, common):
    @arrow_udf("struct<n_tokens:bigint,n_known:bigint,base:double,score:double,words:array<struct<word:binary,n:int>>,grams:array<struct<gram:bigint,n:int>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, (keys, values) = frequent.value, common.value

        def scan(texts: pa.Array) -> pa.Array:
            data, at = flat(texts)
            found = data.tobytes()
            tokens, hits, base, rare, lengths, times = [], [], [], [], [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = found[i:j].lower().split()
                logs = [known.get(w) for w in words]
                others = Counter(w for w, x in zip(words, logs, strict=True) if x is None)
                n = sum(others.values())
                tokens.append(len(words) + 1)
                hits.append(len(words) - n)
                base.append(math.fsum(x for x in logs if x is not None))
                rare.extend(others.keys())
                times.extend(others.values())
                lengths.append(len(others))
            score = np.zeros(len(texts))
            left_of, left = [], []
            for grams, of in codes(data, at, depth):
                order = np.argsort(grams)
                sorted_ = grams[order]
                first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
                each = sorted_[first]
                slot = np.minimum(np.searchsorted(keys, each), max(0, len(keys) - 1))
                there = keys[slot] == each if len(keys) else np.zeros(len(each), bool)
                size = np.diff(np.append(first, len(sorted_)))
                score += np.bincount(of[order], weights=np.repeat(np.where(there, values[slot] if len(keys) else 0.0, 0.0), size), minlength=len(texts))
                unknown = ~np.repeat(there, size)
                left_of.append(of[order][unknown])
                left.append(sorted_[unknown])
            of, grams = np.concatenate(left_of), np.concatenate(left)
            order = np.lexsort((grams, of))
            of, grams = of[order], grams[order]
            first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])])) if len(of) else np.zeros(0, np.int64)
            per_text = np.bincount(of[first], minlength=len(texts))
            lists = _list(np.array(lengths), _FOUND[4].type, rare, times), _list(per_text, _FOUND[5].type, grams[first], np.diff(np.append(first, len(of))))
            return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(score), *lists], fields=list(_FOUND))

        for batch in batches:
            out = [scan(texts) for texts in pieces(batch, PIECE)]
            yield pa.concat_arrays(out) if out else pa.array([], _FOUND)

    return run


def scored(documents: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, frequent: int = 65536, common: int = 1 << 19) -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    ``training`` says which rows are learned from. ``score`` is the log10 probability of the
    text (A-Z lower-cased) and its end by the tree; ``base_score`` that of its words and an end token by
    add-one unigrams over the training tokens.

    Null and empty texts consist of their end. Without training rows every decision is even.
    Repeated rows count as often as they stand there and get the same score; ties don't
    arise. A very long text is coded in parts, only its list of words is held whole. Other
    columns are ignored; an empty table gives no rows.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be from 1 to 6")
    context = documents.sparkSession.sparkContext
    trained = F.coalesce(training, F.lit(False))
    counted = documents.select(bytes_of(F.col(text_col)).alias("text"), trained.alias("learned")).mapInArrow(_counts(depth), _COUNTS)
    counted = stored(counted.groupBy("gram", "word").agg(F.sum("n").alias("n")), "counts")
    words = counted.where("word is not null").select("word", "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = words.where(F.col("word") == F.lit(b"\n")).select("n").first()
    least = _threshold(words.where(F.length("word") <= LONGEST_WORD), frequent)
    often = words.where((F.col("n") >= least) & (F.length("word") <= LONGEST_WORD)).toArrow()  # at most ``frequent`` short words
    known = context.broadcast(dict(zip(often["word"].to_pylist(), np.log10(often["n"].to_numpy() + 1.0).tolist(), strict=True)))

    grams = scores_of(counted.where("gram is not null").select("gram", "n"), depth)
    floor = _threshold(grams.where("n > 0"), common)
    held = grams.where(F.col("n") >= floor).select("gram", F.col("score").cast("float")).toArrow().sort_by("gram")  # at most ``common`` rows
    table = context.broadcast((held["gram"].to_numpy(), held["score"].to_numpy()))
    seen = documents.select(F.col(id_col).alias("id"), trained.alias("trained"), F.octet_length(bytes_of(F.col(text_col))).alias("n_bytes"), _scorer(depth, known, table)(bytes_of(F.col(text_col))).alias("s"))
    seen = stored(seen.select(F.monotonically_increasing_id().alias("row"), "id", "trained", "n_bytes", "s.*"), "scores")
    known.destroy()
    table.destroy()

    others = words.where((F.col("n") < least) | (F.length("word") > LONGEST_WORD)).withColumnRenamed("n", "c")
    by_word = seen.where(F.size("words") > 0).select("row", F.inline("words")).join(others, "word")
    by_word = by_word.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_base"))
    by_gram = seen.where(F.size("grams") > 0).select("row", F.inline("grams")).join(grams.where(F.col("n") < floor).select("gram", F.col("score").alias("each")), "gram")
    by_gram = by_gram.groupBy("row").agg(F.sum(F.col("n") * F.col("each")).alias("more_score"))
    sums = stored(by_word.join(by_gram, "row", "full"), "sums")
    release(counted, grams)
    end = math.log10((ends[0] if ends else 0) + 1)
    each = math.log10(tokens + distinct + 1)
    joined = seen.join(sums, "row", "left").withColumn("total", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    return joined.select(
        "id",
        "trained",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(1 if ends else 0)).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        F.col("total").alias("score"),
        (-F.col("total") / F.lit(math.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )

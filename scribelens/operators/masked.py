"""Masked-entity recovery: which word to hide, how far to mask, and whether a model wrote it anyway."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import core, masked_form

#: Words by language.
NUMBER_WORDS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split(),
    "es": "cero uno una dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento cientos doscientos trescientos quinientos mil millon millón millones billon billón billones".split(),
}
TITLE_WORDS = {
    "en": "president commissioner mr mrs ms madam baroness lord sir dame chancellor minister prime vice dr professor chairman".split(),
    "es": "presidente presidenta comisario comisaria sr sra señor señora don doña ministro ministra primer vicepresidente dr dra profesor profesora baron barón baronesa lord sir".split(),
}
COMMON_NAMES = {
    "en": "the commission parliament council member members state states european europe union eu mr mrs ms madam president commissioner minister directive regulation treaty article house chamber report january february march april may june july august september october november december monday tuesday wednesday thursday friday i we it this that there but and if as how in on at for however finally first second today now west east north south".split(),
    "es": "el la los las comision comisión parlamento consejo miembro miembros estado estados europeo europea europeos europeas europa union unión ue señor señora señores señoras sr sra señorias señorías presidente presidenta comisario comisaria ministro ministra directiva reglamento tratado articulo artículo informe camara cámara enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miercoles miércoles jueves viernes yo nosotros esto eso este esta pero y si como cómo en para por hoy ahora primero segundo oeste este norte sur".split(),
}
CAPITAL = {"en": "^[A-Z][a-z']{2,}$", "es": "^[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü']{2,}$"}
MAGNITUDES = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12, "dozen": 12}
_ONES = NUMBER_WORDS["en"][:20]
_TENS = dict(zip(range(20, 100, 10), NUMBER_WORDS["en"][20:28], strict=True))


def number_places(words: Column, mode: str = "distinctive", lang: str = "en") -> Column:
    """Places of number words: those with a digit (mode digit), also spelled ones (all), without one and 1 (distinctive)."""
    cores = F.transform(words, lambda w, i: F.struct(F.lower(core(w)).alias("w"), i.alias("i")))
    digit = lambda x: x["w"].rlike("[0-9]")
    value = lambda x: digit(x) | x["w"].isin(*NUMBER_WORDS[lang])
    keep = {"digit": digit, "all": value, "distinctive": lambda x: value(x) & ~x["w"].isin("one", "1")}[mode]
    return F.transform(F.filter(cores, keep), lambda x: x["i"])


def longest_run(places: Column) -> Column:
    """struct(first, n) of the longest run of consecutive places, the first of equals; null without places."""

    def add(runs, p):
        last = F.try_element_at(runs, F.lit(-1))
        follows = F.coalesce(last["first"] + last["n"] == p, F.lit(False))
        grown = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n"))))
        return F.when(follows, grown).otherwise(F.concat(runs, F.array(F.struct(p.alias("first"), F.lit(1).alias("n")))))

    runs = F.aggregate(places, F.array().cast("array<struct<first:int,n:int>>"), add)
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["n"].alias("n"), (-r["first"]).alias("early"))))
    return F.when(best.isNotNull(), F.struct((-best["early"]).alias("first"), best["n"].alias("n")))


def run_around(places: Column, target: Column) -> Column:
    """Consecutive places that hold the target, in order."""
    before = F.aggregate(F.reverse(F.filter(places, lambda p: p < target)), target, lambda a, p: F.when(p == a - 1, p).otherwise(a))
    after = F.aggregate(F.filter(places, lambda p: p > target), target, lambda a, p: F.when(p == a + 1, p).otherwise(a))
    return F.sequence(before, after)


def number_targets(clips: DataFrame, mode: str = "distinctive", lang: str = "en") -> DataFrame:
    """Adds places, target (first word of the longest run) and hidden_ref (the run's words); clips without a number go."""
    rows = clips.withColumn("places", number_places(F.col("words"), mode, lang)).where(F.size("places") > 0)
    rows = rows.withColumn("target", longest_run(F.col("places"))["first"])
    hidden = F.transform(run_around(F.col("places"), F.col("target")), lambda i: core(F.get("words", i)))
    return rows.withColumn("hidden_ref", F.array_join(hidden, " "))


def name_targets(clips: DataFrame, lang: str = "en", with_titles: bool = False, least_span: float = 0.12) -> DataFrame:
    """Adds places (proper names, and titles if wanted), target and hidden_ref for (words, timings: array of struct(t0, t1)) rows.

    A proper name is capitalised, not common, not first in its sentence and heard for
    ``least_span`` seconds. The target follows a title, else it is the longest (the first of
    equals). Rows without a proper name have a null target.
    """
    n = F.least(F.size("words"), F.size("timings"))
    each = F.transform(F.slice("words", 1, n), lambda w, i: F.struct(core(w).alias("c"), F.lower(core(w)).alias("low"), i.alias("i"), (F.get("timings", i)["t1"] - F.get("timings", i)["t0"]).alias("span"), ((i == 0) | F.coalesce(F.get("words", i - 1).rlike(r"[.!?]$"), F.lit(False))).alias("opens")))
    title = lambda x: x["low"].isin(*TITLE_WORDS[lang])
    proper = lambda x: ~title(x) & x["c"].rlike(CAPITAL[lang]) & ~x["low"].isin(*COMMON_NAMES[lang]) & ~x["opens"] & (x["span"] >= least_span)
    rows = clips.withColumn("_each", each).withColumns({"_titles": F.transform(F.filter("_each", title), lambda x: x["i"]), "_names": F.filter("_each", proper)})
    after_title = F.get(F.filter("_names", lambda x: F.array_contains("_titles", x["i"] - 1)), F.lit(0))["i"]
    best = F.array_max(F.transform("_names", lambda x: F.struct(F.length(x["c"]).alias("n"), (-x["i"]).alias("early"))))
    names = F.transform("_names", lambda x: x["i"])
    places = F.array_sort(F.array_union(names, F.col("_titles"))) if with_titles else names
    rows = rows.withColumns({"places": places, "target": F.coalesce(after_title, -best["early"])})
    return rows.withColumn("hidden_ref", core(F.get("words", F.col("target")))).drop("_each", "_titles", "_names")


def hex_modulo(digest: Column, n: Column) -> Column:
    """A long hexadecimal number modulo n, digit by digit."""
    digits = F.transform(F.filter(F.split(digest, ""), lambda c: c != ""), lambda c: F.instr(F.lit("0123456789abcdef"), c).cast("bigint") - 1)
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: (a * 16 + d) % n.cast("bigint")).cast("int")


def positional_target(key: Column, n_words: Column, mode: str, seed: int = 0) -> Column:
    """first, last, or a random place: md5 of seed:key modulo the number of words. Null without words."""
    place = {"first": F.lit(0), "last": n_words - 1, "random": hex_modulo(F.md5(F.concat(F.lit(f"{seed}:"), key)), n_words)}[mode]
    return F.when(n_words > 0, place)


def external_targets(clips: DataFrame, given: DataFrame, key: str = "clip_key") -> DataFrame:
    """Places and targets from (key, entity_indices, target_idx); clips that it lacks go."""
    named = given.select(F.col("key").alias(key), F.col("entity_indices").alias("places"), F.col("target_idx").alias("target"))
    return clips.join(named, key).withColumn("hidden_ref", core(F.get("words", F.col("target"))))


def mask_bounds(words: DataFrame, kind: str, *, pad: float = 0.12, guard: float = 0.03, zero: float = 0.06) -> DataFrame:
    """Adds lo, hi and maskable to (clip_key, idx, w, t0, t1, duration) rows.

    first masks from 0 past the next word's start, last from before the previous word's end;
    a word without width takes the gap between its neighbours; others are widened without
    reaching a neighbour. A word without width is maskable only if the gap is 0.08 s or more.
    """
    w = Window.partitionBy("clip_key").orderBy("idx")
    before = F.coalesce(F.lag("t1").over(w), F.lit(0.0))
    after = F.coalesce(F.lead("t0").over(w), F.col("duration"))
    rows = words.withColumns({"_before": before, "_after": after})
    t0, t1, prev, nxt, end = (F.col(c) for c in ("t0", "t1", "_before", "_after", "duration"))
    if kind == "first":
        lo, hi = F.lit(0.0), F.least(nxt + pad, end)
    elif kind == "last":
        lo, hi = F.greatest(prev - pad, F.lit(0.0)), end
    else:
        thin = t1 - t0 < zero
        lo = F.when(thin, prev + guard).otherwise(F.least(t0, F.greatest(t0 - pad, prev + guard)))
        hi = F.when(thin, nxt - guard).otherwise(F.greatest(t1, F.least(t1 + pad, nxt - guard)))
    return rows.withColumns({"lo": lo, "hi": hi, "maskable": (t1 - t0 >= zero) | (nxt - prev >= 0.08)}).drop("_before", "_after")


def recipe(rows: DataFrame, *, source: str, kind: str, split: str, method: str = "silence", mask_all: bool = False, infix: str = "", suffix: str = "") -> DataFrame:
    """Mask-recipe rows of (clip_key, words, places, target, t0, t1, hidden_ref), with their dataset's name."""
    scope = "all" if mask_all else "one"
    name = "-".join(x for x in (source, infix, "mask", kind, scope, suffix, method) if x)
    text = F.array_join("words", " ")
    side = {"first": "head", "last": "tail"}.get(kind, "span")
    return rows.select(
        F.lit(name).alias("dataset"), F.col("clip_key").alias("__key__"), F.lit(source).alias("source_dataset"), F.lit(split).alias("split"), F.lit("entity").alias("mode"), F.lit(method).alias("method"),
        F.lit(side).alias("hidden_side"), F.lit(mask_all).alias("mask_all"), F.col("target").alias("entity_idx"), F.round("t0", 3).alias("entity_t0"), F.round("t1", 3).alias("entity_t1"),
        (F.size("places") if mask_all else F.lit(1)).alias("n_masked_spans"), F.col("target").alias("n_ref_words_kept"), F.size("words").alias("n_ref_words_total"), "hidden_ref", text.alias("partial_ref"), text.alias("full_ref"),
    )


def _bounded(needle: Column, hay: Column) -> Column:
    """Whether ``needle`` stands in ``hay`` between characters that are no word characters. A needle may differ by row."""
    quoted = F.regexp_replace(needle, r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.regexp_like(hay, F.concat(F.lit(r"(?U)(?:^|\W)"), quoted, F.lit(r"(?:$|\W)")))


def strict_hit(hidden: Column, hyp: Column) -> Column:
    """The hidden word without outer punctuation, whole, in the hypothesis. Null for an empty hidden word."""
    needle = F.lower(core(hidden))
    return F.when(needle != "", _bounded(needle, F.lower(F.coalesce(hyp, F.lit("")))))


def spelled(n: int) -> str:
    """A number in English words."""
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10 * 10] + (f"-{_ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{_ONES[n // 100]} hundred" + (f" and {spelled(n % 100)}" if n % 100 else "")
    name, unit = max(((w, v) for w, v in MAGNITUDES.items() if 1000 <= v <= n), key=lambda x: x[1])
    rest = n % unit
    return f"{spelled(n // unit)} {name}" + ("" if not rest else (" and " if rest < 100 else ", ") + spelled(rest))


@F.arrow_udf(T.ArrayType(T.StringType()))
def forms_of_large(keys: pa.Array) -> pa.Array:
    """Ways to write numbers of four digits or more that are given in digits; null for other keys."""
    large = lambda k: k is not None and k.isascii() and k.isdigit() and 4 <= len(k) <= 15
    return pa.array([[k, f"{int(k):,}", spelled(int(k)), spelled(int(k)).replace(" and ", " ")] if large(k) else None for k in keys.to_pylist()], pa.list_(pa.string()))


def spelled_year(n: int) -> str:
    """A year from 1000 to 2099 as it is read."""
    high, low = divmod(n, 100)
    if low == 0:
        return spelled(n) if high % 10 == 0 else f"{spelled(high)} hundred"
    if 2000 <= n < 2010:
        return f"two thousand and {spelled(low)}"
    return f"{spelled(high)} {'oh-' if low < 10 else ''}{spelled(low)}"


def number_forms(spark: SparkSession, last: int = 2100) -> DataFrame:
    """(value, form): ways to write each number up to ``last``, and the magnitudes; some 10,000 rows, fixed."""
    rows = set()
    for v in range(last + 1):
        rows |= {(v, str(v)), (v, spelled(v)), (v, spelled(v).replace(" and ", " "))}
        if 1000 <= v <= 2099:
            rows.add((v, spelled_year(v)))
        if v >= 1000:
            rows.add((v, f"{v:,}"))
    for word, v in MAGNITUDES.items():
        rows |= {(v, word), (v, str(v)), (v, f"{v:,}")}
    return spark.createDataFrame(sorted(rows), "value bigint, form string")


def value_of(hidden: Column, forms: DataFrame) -> tuple[Column, DataFrame]:
    """The key to look ``hidden`` up by, and the (key, forms) table: all forms of the value that the key names."""
    key = F.replace(F.lower(core(F.trim(hidden))), F.lit(","), F.lit(""))
    every = forms.groupBy("value").agg(F.array_sort(F.collect_set("form")).alias("forms"))
    year_only = F.col("form").contains(",")
    return key, forms.where(~year_only).join(every, "value").groupBy(F.col("form").alias("key")).agg(F.min_by("forms", "value").alias("forms"))


def value_hit(rows: DataFrame, forms: DataFrame, hidden: str = "hidden_ref", hyp: str = "hypothesis") -> DataFrame:
    """Adds hit: the hidden number in any of its forms, or its letters and digits with or without spaces between."""
    key, table = value_of(F.col(hidden), forms)
    joined = rows.withColumn("_key", key).withColumn("_large", forms_of_large("_key")).join(F.broadcast(table.withColumnRenamed("key", "_key")), "_key", "left")  # of fixed size
    low = F.lower(F.coalesce(hyp, F.lit("")))
    by_form = F.coalesce(F.exists(F.coalesce("forms", "_large"), lambda f: _bounded(f, low)), F.lit(False))
    runs = F.regexp_extract_all(F.lower(F.col(hidden)), F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    loose = F.when(F.size(runs) > 0, F.regexp_like(low, F.concat(F.lit(r"(?U)(?:^|\W)"), F.array_join(runs, r"\s*"), F.lit(r"(?:$|\W)")))).otherwise(False)
    plain = F.regexp_like(key, F.lit("^[0-9]+$")) & _bounded(key, low)
    return joined.withColumn("hit", F.when(F.coalesce(F.col(hidden), F.lit("")) != "", by_form | plain | loose)).drop("_key", "_large", "forms")


def number_values(text: Column) -> Column:
    """Values of the digit runs and of single number words in a prepared text."""
    value = F.create_map(*(x for v, w in [*enumerate(_ONES), *_TENS.items(), *((v, w) for w, v in MAGNITUDES.items())] for x in (F.lit(w), F.lit(v).cast("bigint"))))
    tokens = F.split(text, " ")
    return F.filter(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]{1,18}$"), t.try_cast("bigint")).otherwise(F.try_element_at(value, t))), lambda v: v.isNotNull())


def robust_hit(hidden: Column, hyp: Column) -> Column:
    """The prepared hidden text whole in the prepared hypothesis, or all its numbers among the hypothesis's."""
    h, y = masked_form(hidden), masked_form(F.coalesce(hyp, F.lit("")))
    values = number_values(h)
    return F.when(h == "", F.lit(None).cast("boolean")).otherwise(_bounded(h, y) | ((F.size(values) > 0) & (F.size(F.array_except(values, number_values(y))) == 0)))


def leak_rate(rows: DataFrame, *keys: str, hit: str = "hit") -> DataFrame:
    """keys, k, n, rate: rows with a null hit aren't counted."""
    by = rows.groupBy(*keys).agg(F.count_if(hit).alias("k"), F.count(hit).alias("n"))
    return by.withColumn("rate", F.try_divide("k", "n"))


def gated_rate(masked: DataFrame, unmasked: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Recovery from masked audio among the clips that the model gets unmasked; both have (by, clip_key, hit)."""
    keys = [*by, "clip_key"]
    side = lambda df, is_open: df.select(*keys, "hit", F.lit(is_open).alias("_open"))
    return gated_rate_within(side(unmasked, True).unionByName(side(masked, False)), F.col("_open"), by)


def gated_rate_within(rows: DataFrame, is_open: Column, by: Sequence[str] = ("model",)) -> DataFrame:
    """:func:`gated_rate` of one table of both, read once: ``is_open`` tells unmasked rows from masked ones.

    Every unmasked row is paired with every masked one of its keys (counted, not joined), or
    stands alone without any; null keys have no partner.
    """
    keys = [*by, "clip_key"]
    hit, open_ = F.col("hit"), F.coalesce(is_open, F.lit(False))
    each = rows.where("hit is not null").groupBy(*keys).agg(F.count_if(open_ & hit).alias("_pass"), F.count_if(open_).alias("_open"), F.count_if(~open_ & hit).alias("_leak"), F.count_if(~open_).alias("_shut"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    each = each.where(F.col("_open") > 0).withColumns({"_leak": F.when(known, F.col("_leak")).otherwise(0), "_shut": F.when(known, F.col("_shut")).otherwise(0)})
    times = F.greatest(F.col("_shut"), F.lit(1))
    out = each.groupBy(*by).agg(F.sum(F.col("_open") * times).alias("n_unmasked_eval"), F.sum(F.col("_pass") * times).alias("n_gate_pass"), F.sum(F.col("_pass") * F.col("_leak")).alias("masked_leak"), F.sum(F.col("_pass") * F.col("_shut")).alias("n_gated"))
    return out.withColumns({"unmasked_rate": F.try_divide("n_gate_pass", "n_unmasked_eval"), "masked_retrieval": F.try_divide("masked_leak", "n_gated")})


def passing_keys(keys: DataFrame, passed: DataFrame | None, key: str = "clip_key") -> DataFrame:
    """Keys that passed a quality gate; all of them if there is no gate."""
    return keys if passed is None else keys.join(passed.select(key).distinct(), key, "left_semi")


def paired_difference(real: DataFrame, clone: DataFrame, real_open: DataFrame, clone_open: DataFrame, least: int = 5) -> DataFrame:
    """model, clip_key, difference: hit on real minus hit on clone, where both are gotten unmasked; models with fewer than ``least`` pairs go."""
    given = [real, clone, real_open, clone_open]
    # a table that is given twice is read once
    apart = [df for i, df in enumerate(given) if not any(df is other for other in given[:i])]
    parts = [df.select("model", "clip_key", "hit", *(F.lit(other is df).alias(f"_in{i}") for i, other in enumerate(given))) for df in apart]
    return paired_difference_within(reduce(DataFrame.unionByName, parts), *(F.col(f"_in{i}") for i in range(4)), least=least)


def paired_difference_within(rows: DataFrame, real: Column, clone: Column, real_open: Column, clone_open: Column, least: int = 5) -> DataFrame:
    """:func:`paired_difference` of one table of all, read and shuffled once; the conditions tell whose rows they are."""
    hit = F.col("hit")
    n = lambda whose, right: F.count_if(whose & (hit if right else ~hit))
    each = rows.where("model is not null and clip_key is not null and hit is not null").groupBy("model", "clip_key")
    each = each.agg(n(real, True).alias("_a1"), n(real, False).alias("_a0"), n(clone, True).alias("_b1"), n(clone, False).alias("_b0"), n(real_open, True).alias("_a"), n(clone_open, True).alias("_b")).where("_a > 0 and _b > 0 and _a1 + _a0 > 0 and _b1 + _b0 > 0")
    few = each.groupBy("model").agg(F.sum(F.expr("(_a1 + _a0) * (_b1 + _b0)")).alias("_n")).where(F.col("_n") >= least)
    pairs = F.concat(*(F.array_repeat(F.lit(d), F.expr(count).cast("int")) for d, count in ((1, "_a1 * _b0"), (0, "_a1 * _b1 + _a0 * _b0"), (-1, "_a0 * _b1"))))
    return each.join(few, "model", "left_semi").select("model", "clip_key", F.explode_outer(pairs).alias("difference"))


def without_garbage(rows: DataFrame) -> DataFrame:
    """Rows that no garbage_ column flags."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in rows.columns if c.startswith("garbage_")]
    for flag in flags:
        rows = rows.where(~flag)
    return rows

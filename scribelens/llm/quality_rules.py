"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with those of
its language, summed over all documents that pass the base rules, by Jensen-Shannon
distance. Texts too short for a histogram are left alone by it. Everything is DataFrame
functions; what a language needs is one row of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

#: Character classes in the order in which they are taken out of a text.
CLASSES = (("lower", "[a-z]+"), ("above_ascii", r"[^\x00-\x7F]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("stop", r"[.,;:!?]+"), ("quote", r"[\"'()-]+"))
#: Frequent words of English, French, German and Spanish.
COMMON = tuple(
    "the of and to in is that it was for on with as at by this be are from "
    "le la les de des et un une est que qui dans pour pas sur au en du "
    "der die das und ist ein eine nicht den zu von mit sich auf dem im "
    "el los las y es por para con no una su al lo como".split()
)
COMMON = tuple(dict.fromkeys(COMMON))
LONGEST = max(map(len, COMMON))
SYMBOLS = r"[^#*$%&|<>]+"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _window_hashes(words: Column, window: int) -> Column:
    """A hash for each ``window`` words in a row."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) >= window, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, window: int) -> Column:
    """Words covered by the windows whose hash stands in ``hashes`` more than once."""
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # equal hashes are neighbours now: a place counts if the one before or after it has its hash
    like_before = F.zip_with(placed, F.concat(F.array(none), F.slice(placed, 1, F.size(hashes) - 1)), lambda x, b: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(x["h"] == b["h"], F.lit(False)).alias("twice")))
    nothing = F.lit(None).cast("struct<h:bigint,i:int,twice:boolean>")
    twice = F.zip_with(like_before, F.concat(F.slice(like_before, 2, F.size(hashes)), F.array(nothing)), lambda x, a: F.when(x["twice"] | F.coalesce(a["twice"], F.lit(False)), x["i"]))
    places = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(window), p + window - s["end"])).alias("n"), (p + window).alias("end"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("end")), step, lambda s: s["n"])


def features(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", window: int = 8) -> DataFrame:
    """One row per row: id, lang ('' for null), the base counts, and the two histograms (arrays of counts)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != "")).withColumn("dense", F.regexp_replace("text", SPACE, ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("hashes", _window_hashes(F.col("words"), window))
    counts, left = [], "dense"
    for name, pattern in CLASSES:
        rows = rows.withColumn(f"without_{name}", F.regexp_replace(left, pattern, ""))
        counts.append(F.length(left) - F.length(f"without_{name}"))
        left = f"without_{name}"
    counts += [F.length(left), F.length("text") - F.length("dense")]
    short = F.filter("words", lambda w: F.length(w) <= LONGEST + 1)
    rows = rows.withColumn("common", F.filter(F.transform(short, lambda w: _lower(F.rtrim(w, F.lit(".,")))), lambda w: w.isin(*COMMON)))
    each = [F.size("common") - F.size(F.array_remove("common", w)) for w in COMMON]
    repeats = F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), 0).otherwise(_covered(F.col("hashes"), window))
    long = lambda c, name: c.cast("long").alias(name)
    return rows.select(
        "id",
        "lang",
        long(F.size("words"), "n_words"),
        long(F.length("dense"), "word_chars"),
        long(F.length(F.regexp_replace("text", SYMBOLS, "")), "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(repeats, "n_repeat_words"),
        long(F.length("text"), "n_chars"),
        F.array(*(c.cast("double") for c in counts)).alias("classes"),
        F.array(*(c.cast("double") for c in each), (F.size("words") - F.size("common")).cast("double")).alias("frequent"),
    )


def base_failed() -> Column:
    """The base rules: under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of an array of counts and an array of shares."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(counts, reference, lambda n, q: part(n / total, (n / total + q) / 2) + part(q, (n / total + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2, F.lit(0.0)))


def _sums(column: str, n: int) -> list[Column]:
    return [F.sum(F.get(column, F.lit(i))).alias(f"{column}{i}") for i in range(n)]


def references(rows: DataFrame) -> DataFrame:
    """One row per language: (lang, ref_classes, ref_frequent), shares over its documents that pass the base rules; lang null for all together."""
    n, m = len(CLASSES) + 2, len(COMMON) + 1
    by_lang = stored(rows.where(~base_failed()).groupBy("lang").agg(*_sums("classes", n), *_sums("frequent", m)), "sums")
    everything = by_lang.agg(*(F.sum(c).alias(c) for c in by_lang.columns[1:])).select(F.lit(None).cast("string").alias("lang"), "*")
    share = lambda name, k: F.transform(F.array(*(F.col(f"{name}{i}") for i in range(k))), lambda x: x / F.greatest(F.lit(1.0), F.col(f"{name}_total")))
    both = by_lang.unionByName(everything)
    for name, k in (("classes", n), ("frequent", m)):
        both = both.withColumn(f"{name}_total", sum((F.col(f"{name}{i}") for i in range(1, k)), F.col(f"{name}0")))
    return both.select("lang", share("classes", n).alias("ref_classes"), share("frequent", m).alias("ref_frequent"), F.col("frequent_total").alias("ref_words"))


def judged(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", class_limit: float = 0.2, word_limit: float = 0.3, least_chars: int = 200, least_words: int = 100, least_reference: int = 2000) -> DataFrame:
    """Base counts, the two distances and the verdict of every row.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance (null where the guard holds: fewer than ``least_chars``
    characters or ``least_words`` words) and kept. A language whose documents have fewer than
    ``least_reference`` words together, and a null one, is compared with all languages together.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged
    alike, an empty table gives no rows, other columns are ignored.
    """
    rows = stored(features(documents, id_col=id_col, text_col=text_col, lang_col=lang_col), "features")
    table = stored(references(rows), "references")
    everything = table.where("lang is null").select(F.col("ref_classes").alias("all_classes"), F.col("ref_frequent").alias("all_frequent"))
    own = table.where((F.col("lang") != "") & (F.col("ref_words") >= least_reference)).drop("ref_words")
    (classes, frequent), = [tuple(r) for r in everything.collect()]  # one row of fixed width
    constant = lambda xs: F.array(*(F.lit(0.0 if x is None else x) for x in xs))
    joined = rows.join(own, "lang", "left").withColumns({"ref_classes": F.coalesce("ref_classes", constant(classes)), "ref_frequent": F.coalesce("ref_frequent", constant(frequent))})
    measured = joined.withColumns({
        "base_failed": base_failed(),
        "class_distance": F.when(F.col("n_chars") >= least_chars, _distance(F.col("classes"), F.col("n_chars"), F.col("ref_classes"))),
        "word_distance": F.when(F.col("n_words") >= least_words, _distance(F.col("frequent"), F.col("n_words"), F.col("ref_frequent"))),
    })
    far = (F.coalesce("class_distance", F.lit(0.0)) > class_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    return measured.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))

"""Corpus construction: report assignment, rosters, chapter picks, clip grids, k-gram anchors."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import upper_median
from ..functions.text import fuzzy_form
from .sequence import near_dates, nearest_position


@F.arrow_udf(T.DoubleType())
def partial_ratio(needles: pa.Array, texts: pa.Array) -> pa.Array:
    """The best similarity, 0 to 100, of the shorter text with an equally long window of the longer, by the windows that matching blocks suggest."""
    out = []
    for a, b in zip(needles.to_pylist(), texts.to_pylist(), strict=True):
        a, b = sorted((a or "", b or ""), key=len)
        if not a:
            out.append(100.0 if not b else 0.0)
            continue
        if a in b:
            out.append(100.0)
            continue
        matcher = SequenceMatcher(None, b, a, autojunk=False)
        starts = {max(0, m.a - m.b) for m in matcher.get_matching_blocks() if m.size}
        out.append(max((100 * SequenceMatcher(None, b[s : s + len(a)], a, autojunk=False).ratio() for s in starts), default=0.0))
    return pa.array(out, pa.float64())


def assigned_reports(videos: DataFrame, clips: DataFrame, reports: DataFrame, *, days: int = 16, least_ratio: float = 85.0, sample: int = 20, low: float = 0.2) -> DataFrame:
    """video, report_date, yield, flagged: the report of a nearby date that holds most of a video's first clips, the nearer of equals.

    videos (video, upload_date), clips (video, ord, text), reports (report_date, text). Only
    reports within ``days`` days are compared, by an equality join on candidate dates.
    """
    w = Window.partitionBy("video").orderBy("ord")
    queries = clips.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample).select("video", fuzzy_form(F.col("text")).alias("q"))
    near = near_dates(videos.select("video", "upload_date"), reports.select("report_date", fuzzy_form(F.col("text")).alias("gold")), "upload_date", "report_date", days=days)
    scored = near.join(queries, "video").withColumn("hit", (F.col("q") != "") & (partial_ratio("q", "gold") >= least_ratio))
    by = scored.groupBy("video", F.col("candidate").alias("report_date"), "rank").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))
    best = by.groupBy("video").agg(F.max_by(F.struct("report_date", "hits", "n"), F.struct("hits", -F.col("rank"))).alias("b"))
    share = F.col("b.hits") / F.greatest(F.lit(1), F.col("b.n"))
    return best.select("video", "b.report_date", share.alias("yield"), (share < low).alias("flagged"))


def solo_reader(sections: Column) -> Column:
    """The one reader of all sections (array of struct with readers: array of struct(reader_id)); null if there are more."""
    ids = F.array_distinct(F.flatten(F.transform(sections, lambda s: F.transform(s["readers"], lambda r: r["reader_id"]))))
    return F.when(F.size(ids) == 1, F.get(ids, F.lit(0)))


def roster(books: DataFrame, prior: DataFrame, *, language: str = "English", candidates: int = 55, readers: int = 14, least_audio: int = 300, newcomer: int = 5) -> DataFrame:
    """The readers to record: one solo book each (most audio, the first of equals), newest candidates, fewest earlier projects first.

    books (ord, book_id, title, language, sections), prior (reader_id, prior_work_count).
    """
    audio = F.aggregate("sections", F.lit(0).cast("bigint"), lambda n, s: n + F.coalesce(s["playtime"].cast("bigint"), F.lit(0)))
    rows = books.where(F.col("language") == language).withColumns({"reader_id": solo_reader(F.col("sections")).cast("bigint"), "total_audio_s": audio}).where("reader_id is not null")
    best = rows.groupBy("reader_id").agg(F.max_by(F.struct("book_id", "title", "total_audio_s"), F.struct("total_audio_s", -F.col("ord"))).alias("b")).select("reader_id", "b.*")
    newest = best.orderBy(F.desc("reader_id")).limit(candidates)
    usable = newest.join(prior, "reader_id").where((F.col("total_audio_s") >= least_audio) & (F.col("prior_work_count") > 0))
    return usable.withColumn("is_newcomer", F.col("prior_work_count") <= newcomer).orderBy("prior_work_count", F.desc("reader_id")).limit(readers)


def picked_chapters(sections: DataFrame, book: str = "book_id", *, shortest: int = 150, want: int = 2) -> DataFrame:
    """Long enough sections with an .mp3 after the first (the first only if alone), the first ``max(2, want)`` of each book."""
    w = Window.partitionBy(book).orderBy("section_number")
    long = sections.where(F.col("playtime") >= shortest).withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(book))})
    body = long.where(((F.col("_r") > 1) | (F.col("_n") == 1)) & F.col("listen_url").endswith(".mp3"))
    return body.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(2, want)).drop("_r", "_n", "_k")


def clip_grid(chapters: DataFrame, reader: str, offsets: Sequence[float], *, length: float = 16.0, rest: float = 5.0, each: int = 3) -> DataFrame:
    """Clip starts at fixed offsets that leave ``length + rest`` seconds, at most ``each`` for a reader, in order of chapters and offsets."""
    rows = chapters.withColumn("offset", F.explode(F.array(*(F.lit(float(o)) for o in offsets)))).where(F.col("offset") + length + rest <= F.col("duration"))
    w = Window.partitionBy(reader).orderBy("chapter", "offset")
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= each).drop("_k")


def project_count(first_page: Column, last_page: Column, per_page: int = 25) -> Column:
    """Results of a paged listing: full pages before the last, and the last one's rows; without a last page the first one's rows."""
    pages = F.array_max(F.transform(F.regexp_extract_all(first_page, F.lit(r'data-page_number="?(\d+)'), F.lit(1)), lambda x: x.cast("int")))
    rows = lambda p: F.regexp_count(F.coalesce(p, F.lit("")), F.lit("catalog-result"))
    return F.when(F.coalesce(pages, F.lit(1)) <= 1, rows(first_page)).otherwise((pages - 1) * per_page + rows(last_page))


def gram_index(words: DataFrame, key: str, k: int = 6) -> DataFrame:
    """(key, gram, positions) of (key, words) rows: where each run of k words begins."""
    n = F.size("words") - k + 1
    each = words.where(n > 0).select(key, F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.array_join(F.slice("words", i + 1, k), " ").alias("gram"), i.alias("p")))).alias("g"))
    return each.groupBy(key, F.col("g.gram").alias("gram")).agg(F.array_sort(F.collect_list("g.p")).alias("positions"))


def seeds(transcripts: DataFrame, index: DataFrame, key: str, *, k: int = 6, lookahead: int = 60, least: str = "min_pos") -> DataFrame:
    """key, offset, word, position: the first gram within ``lookahead`` words of (key, words, offset, min_pos) rows that the book has, and where.

    The position is the first at or after ``min_pos``, without one the nearest.
    """
    last = F.least(F.col("offset") + lookahead, F.size("words") - k + 1)
    each = transcripts.where(last > F.col("offset")).select(key, "offset", least, F.explode(F.transform(F.sequence(F.col("offset"), last - 1), lambda i: F.struct(i.alias("word"), F.array_join(F.slice("words", i + 1, k), " ").alias("gram")))).alias("g")).select(key, "offset", least, "g.*")
    found = each.join(index, [key, "gram"])
    first = found.groupBy(key, "offset").agg(F.min_by(F.struct("word", "positions", least), "word").alias("f"))
    return first.select(key, "offset", "f.word", nearest_position(F.col("f.positions"), F.col(f"f.{least}")).alias("position"))


def consensus_start(found: DataFrame, key: str, *, within: int = 600, before: int = 50) -> DataFrame:
    """key, start: the median of the largest group of implied starts that agree (six a chapter at most), less a margin."""
    implied = found.select(key, "offset", (F.col("position") - F.col("word")).alias("start"))
    by = implied.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("offset", "start"))).alias("each"))
    groups = F.transform("each", lambda c, i: F.struct(F.filter("each", lambda x: F.abs(x["start"] - c["start"]) <= within).alias("g"), i.alias("i")))
    best = F.array_max(F.transform(groups, lambda g: F.struct(F.size(g["g"]).alias("n"), (-g["i"]).alias("early"), F.transform(g["g"], lambda x: x["start"]).alias("starts"))))["starts"]
    ordered = F.sort_array(best)
    lower = F.get(ordered, F.floor((F.size(ordered) - 1) / 2).cast("int"))
    return by.select(key, F.greatest(F.lit(0), F.floor((lower + upper_median(best)) / 2).cast("int") - before).alias("start"))


def kept_languages(clips: DataFrame, language: str, group: str, *, least: float = 0.7) -> DataFrame:
    """Clips in the language with a text, numbered by group in order (column number, from 0)."""
    kept = clips.where((F.col("lang") == language) & (F.col("prob") >= least) & (F.trim("text") != ""))
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy("ord")) - 1)


def panels(cells: DataFrame, models: Sequence[str], conditions: Sequence[str]) -> DataFrame:
    """(model, condition, k, n) cells with rates and intervals, in the order of the lists; empty cells and others go."""
    from ..functions.stats import wilson

    place = lambda c, xs: F.array_position(F.array(*(F.lit(x) for x in xs)), F.col(c))
    kept = cells.where((F.col("n") > 0) & F.col("model").isin(*models) & F.col("condition").isin(*conditions))
    rows = kept.withColumn("w", wilson(F.col("k"), F.col("n"))).select("model", "condition", "k", "n", "w.rate", "w.lo", "w.hi")
    return rows.orderBy(place("model", models), place("condition", conditions))


def cells_of_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """(model, condition, k, n) of {model: {condition: {k, n}}} documents."""
    kind = "map<string,map<string,struct<k:bigint,n:bigint>>>"
    return texts.select(F.explode(F.from_json(column, kind)).alias("model", "c")).select("model", F.explode("c").alias("condition", "v")).select("model", "condition", "v.*")


def overridden(scores: DataFrame, leave_one_out: DataFrame, key: str = "model", score: str = "score") -> DataFrame:
    """Scores with a panel member's replaced by the one of the run whose panel leaves it out; ``kept`` marks members without one."""
    other = leave_one_out.select(key, F.col(score).alias("_other"), F.lit(True).alias("_has"))
    joined = scores.join(other, key, "left")
    return joined.withColumns({score: F.coalesce("_other", score), "kept": F.coalesce(F.col("in_panel"), F.lit(False)) & F.col("_has").isNull()}).drop("_other", "_has")


def truncated_cell(summary: DataFrame) -> DataFrame:
    """model, k, n: accepted edits from rates of deletions and insertions together, k = round(n * (1 - rate))."""
    k = lambda kind: F.round(F.col(f"n_{kind}") * (1 - F.col(f"rate_{kind}")))
    return summary.select("model", (k("delete") + k("insert")).cast("bigint").alias("k"), (F.col("n_delete") + F.col("n_insert")).cast("bigint").alias("n"))


def ceiling(rates: DataFrame, calibration: Sequence[str]) -> DataFrame:
    """The mean rate of the calibration models: what detection can reach."""
    return rates.where(F.col("model").isin(*calibration)).agg(F.avg("rate").alias("ceiling"), F.count("*").alias("n"))

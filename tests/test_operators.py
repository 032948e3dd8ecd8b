import hashlib
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribelens import sql
from scribelens.functions import stats
from scribelens.functions import text as tx
from scribelens.operators import corpus, masked, nll, sequence
from scribelens.plans import families
from scribelens.streaming import tally


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_text(spark):
    c = F.col("t")
    cases = [
        (tx.normalize(c), "  Hello,\tWorld! It's ", "hello world its"),
        (tx.normalize(c), "漢字 abc", "漢  字  abc"),
        (tx.normalize(c), None, ""),
        (tx.tokens(c), "", []),
        (tx.strip_parentheses(c), "a (b） c", "a  c"),
        (tx.language_subtag(c), "EN-gb", "en"),
        (tx.core(c), "\"It's,\"", "It's"),
        (tx.masked_form(c), "The G20, 20th!", "the g 20 20 th"),
        (tx.plain_markup(c), "<p>a &amp; <b>b</b></p>", "a & b"),
        (tx.between_markers(c), "x\n*** START OF THIS ***\nbody\n*** END OF THIS ***\ny", "body"),
        (F.transform(tx.book_words(c), lambda w: w["norm"]), "It’s a dog—barking. — Yes!", ["its", "a", "dog", "barking", "yes"]),
        (F.transform(tx.book_words(c), lambda w: w["ends"]), "A dog. Yes", [False, True, False]),
    ]
    for column, text, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()[0] == want
    assert one(spark, tx.normalize(F.lit("A (b) c"), own=lambda t, lang: F.concat(F.lower(t), lang))) == "a cen"


def test_statistics(spark):
    assert one(spark, stats.upper_median(F.array(*map(F.lit, (3.0, 1.0, 2.0, 4.0))))) == 3.0
    assert tuple(one(spark, stats.first_mode(F.array(*map(F.lit, "abba"))))) == (2, "a")
    df = spark.createDataFrame([("g", float(i % 2), i // 4) for i in range(40)], "k string, v double, c int")
    a, b = (stats.bootstrap_mean(df, ["k"], "v", times=500).first() for _ in range(2))
    assert a == b and a.lo <= a.mean <= a.hi and a.n == 40
    assert stats.clustered_mean(df, ["k"], "c", "v", times=50).first().lo == 0.5
    assert stats.mean_of_groups(df, "k", "v").first().mean_score == 0.5


def test_bootstrap_holds_one_sample(spark, monkeypatch):
    x = np.random.default_rng(3).random(200_000)
    draws = np.random.default_rng(0)
    want = np.array([x[draws.integers(0, len(x), len(x))].mean() for _ in range(40)])
    monkeypatch.setattr(stats, "_DRAWN", 7_777)
    tracemalloc.start()
    got = stats._resampled(x, 40, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 2 * x.nbytes  # all samples at once: 80 times as much
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), (None, 2.0), ("b", None)], "k string, v double")
    rows = {r.k: tuple(r)[1:] for r in stats.bootstrap_mean(df, ["k"], "v", times=9).collect()}
    assert rows["a"][0] == 2.0 and rows["a"][3] == 2 and rows[None] == (2.0, 2.0, 2.0, 1) and rows["b"] == (None, None, None, 0)


def test_numbers_and_names(spark):
    df = spark.createDataFrame([("k", "We had twenty five, then one or 95 men".split(" "))], "clip_key string, words array<string>")
    got = masked.number_targets(df).first()
    assert (got["places"], got["target"], got["hidden_ref"]) == ([2, 3, 7], 2, "twenty five")
    assert [df.select(masked.number_places(F.col("words"), m)).first()[0] for m in ("digit", "all")] == [[7], [2, 3, 5, 7]]
    words = "Today Mr Barroso met Schulzenberg. Paris slept".split(" ")
    timings = [(i * 1.0, i + 0.5) for i in range(len(words))]
    named = spark.createDataFrame([("k", words, timings)], "clip_key string, words array<string>, timings array<struct<t0:double,t1:double>>")
    got = masked.name_targets(named).first()
    assert (got["places"], got["target"], got["hidden_ref"]) == ([2, 4], 2, "Barroso")
    assert masked.name_targets(named, with_titles=True).first()["places"] == [1, 2, 4]
    rows = masked.recipe(masked.number_targets(df).withColumns({"t0": F.lit(0.12345), "t1": F.lit(1.0)}), source="s", kind="number", split="test").first()
    assert (rows["dataset"], rows["hidden_side"], rows["entity_t0"], rows["n_ref_words_total"]) == ("s-mask-number-one-silence", "span", 0.123, 9)


def test_positions(spark):
    for mode, want in (("first", 0), ("last", 6), ("random", int(hashlib.md5(b"3:key").hexdigest(), 16) % 7)):
        assert one(spark, masked.positional_target(F.lit("key"), F.lit(7), mode, 3)) == want
    assert one(spark, masked.positional_target(F.lit("key"), F.lit(0), "last")) is None


def test_bounds(spark):
    words = spark.createDataFrame([("c", 0, "a", 0.5, 1.0, 4.0), ("c", 1, "5", 1.2, 1.2, 4.0), ("c", 2, "b", 2.0, 2.5, 4.0)], "clip_key string, idx int, w string, t0 double, t1 double, duration double")
    got = {r["idx"]: (round(r["lo"], 3), round(r["hi"], 3), r["maskable"]) for r in masked.mask_bounds(words, "number").collect()}
    assert got == {0: (0.38, 1.12, True), 1: (1.03, 1.97, True), 2: (1.88, 2.62, True)}
    first = masked.mask_bounds(words, "first").where("idx = 0").first()
    last = masked.mask_bounds(words, "last").where("idx = 2").first()
    assert (first["lo"], round(first["hi"], 2)) == (0.0, 1.32) and (round(last["lo"], 2), last["hi"]) == (1.08, 4.0)


def test_hits(spark):
    strict = [("Bay.", "at the bay", True), ("bay", "bayou", False), ("", "x", None), ("G20", "g 20", False), ("a+b", "x a+b y", True), ("é", "né", False)]
    df = spark.createDataFrame(strict, "h string, y string, w boolean")
    assert all(r[0] == r[1] for r in df.select(masked.strict_hit(F.col("h"), F.col("y")), "w").collect())
    robust = [("article two", "article 2", True), ("G20", "the g 20 said", True), ("5", "fifty", False), ("x", "y", False), ("", "y", None)]
    df = spark.createDataFrame(robust, "h string, y string, w boolean")
    assert all(r[0] == r[1] for r in df.select(masked.robust_hit(F.col("h"), F.col("y")), "w").collect())
    value = [("Two", "it was 2", True), ("2016", "in twenty sixteen", True), ("80,000", "80,000 men", True), ("80000", "eighty thousand", True), ("twenty-five", "25", True), ("hundred", "a hundred", True), ("G20", "g 20", True), ("7", "17", False), ("1,500", "1,500", True)]
    df = spark.createDataFrame(value, "hidden_ref string, hypothesis string, w boolean")
    got = masked.value_hit(df, masked.number_forms(spark)).select("hidden_ref", "hit", "w").collect()
    assert [r for r in got if r["hit"] != r["w"]] == []
    assert [masked.spelled(n) for n in (0, 21, 105, 1984, 2001)] == ["zero", "twenty-one", "one hundred and five", "one thousand, nine hundred and eighty-four", "two thousand and one"]
    assert [masked.spelled_year(n) for n in (1900, 1905, 1984, 2000, 2004, 2016)] == ["nineteen hundred", "nineteen oh-five", "nineteen eighty-four", "two thousand", "two thousand and four", "twenty sixteen"]


def test_likelihoods(spark):
    nan = float("nan")
    assert one(spark, nll.recovery(F.lit(3.0), F.lit(2.0), F.lit(1.0))) == 0.5 and math.isnan(one(spark, nll.recovery(F.lit(1.0), F.lit(2.0), F.lit(1.0))))
    stop = F.array(F.lit("the"))
    assert one(spark, nll.gen_leak(F.lit("The Red fox"), F.lit("a red dog"), stop)) == 0.5 and math.isnan(one(spark, nll.gen_leak(F.lit("the"), F.lit("x"), stop)))
    assert tuple(one(spark, nll.hidden_span(F.lit("ab cd ab"), F.lit("ab"), "tail"))) == (6, 8) and tuple(one(spark, nll.hidden_span(F.lit("AB cd"), F.lit("ab")))) == (0, 2)
    toks = spark.createDataFrame([("k", i, t, lp, 3, 5) for i, (t, lp) in enumerate([("ab", -1.0), (" c", -2.0), ("d", nan), ("e", -4.0)])], "k string, i int, token string, logprob double, hidden_first int, hidden_end int")
    assert nll.mean_nll(nll.hidden_tokens(toks, ["k"]), ["k"]).first()[1:] == (2.0, 1)
    rows = spark.createDataFrame([("m", 1.0, 2.0, 3.0, 0.5, 1.0), ("m", nan, 2.0, 3.0, nan, 0.0)], "model string, nll_full double, nll_trunc double, nll_none double, recovery double, gen_leak double")
    got = nll.summary(rows, ["model"]).first()
    assert (got["n"], got["mean_nll_full"], got["median_recovery"], got["share_leaked"]) == (2, 1.0, 0.5, 0.5)
    gap = spark.createDataFrame([("m", 10.0, 5, 8.0, 4)], "model string, nll_ref double, n_ref int, nll_cons double, n_cons int")
    assert nll.gaps(gap, ["model"]).first()["total_nll_gap"] == 2.0


def test_sequences(spark):
    turns = spark.createDataFrame([("s", 0.0, 4.0, []), ("s", 0.0, 10.0, []), ("t", 0.0, 50.0, [(0.0, 9.0), (10.0, 18.0), (21.0, 26.0), (27.0, 28.0), (29.0, 75.0)])], "spk string, start double, end double, speech array<struct<start:double,end:double>>")
    got = sorted((r["spk"], r["start"], r["end"]) for r in sequence.turn_clips(turns).collect())
    assert got == [("s", 0.0, 10.0), ("t", 0.0, 19.5), ("t", 21.0, 28.5), ("t", 29.0, 39.5), ("t", 39.5, 50.0)]
    book = [{"norm": w.strip("."), "read": w, "ends": w.endswith(".")} for w in "a b c d e f. g h i j k l.".split()]
    heard = [("x", 0.0, 1.0)] + [(b["norm"], i + 1.0, i + 2.0) for i, b in enumerate(book)]
    chapters = spark.createDataFrame([("b", heard, [-1, *range(12)], [tuple(b.values()) for b in book])], "k string, words array<struct<norm:string,t0:double,t1:double>>, places array<int>, book array<struct<norm:string,read:string,ends:boolean>>")
    got = sequence.sentence_clips(chapters, shortest=4.0, enough=5.0).collect()
    assert [(r["start"], r["end"], r["text"], r["match"]) for r in got] == [(1.0, 7.0, "A B C D E F.", 1.0), (7.0, 13.0, "G H I J K L.", 1.0)]
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 9, "z")], "k string, t int, v string")
    assert sorted((r["k"], r["t"], r["v"]) for r in sequence.nearest_before(left, right, "k", "t", "v").collect()) == [("a", 1, None), ("a", 5, "y"), ("b", 3, None)]
    assert one(spark, sequence.nearest_position(F.array(*map(F.lit, (3, 9, 20))), F.lit(5))) == 9 and one(spark, sequence.nearest_position(F.array(F.lit(3), F.lit(1)), F.lit(5))) == 3
    fills = spark.createDataFrame([("c", 0, None), ("c", 1, 2.0), ("c", 2, None)], "k string, i int, t double")
    assert [r[0] for r in fills.orderBy("i").select(sequence.filled_end(fills, ["k"], "i", "t")).collect()] == [0.0, 2.0, 2.0]


def test_corpora(spark):
    words = [f"w{i}" for i in range(40)]
    book = spark.createDataFrame([("b", words)], "k string, words array<string>")
    index = corpus.gram_index(book, "k")
    heard = spark.createDataFrame([("b", ["intro"] + words[10:30], 0, 0)], "k string, words array<string>, offset int, min_pos int")
    found = corpus.seeds(heard, index, "k")
    assert tuple(found.first())[1:] == (0, 1, 10)
    assert corpus.consensus_start(found, "k", before=5).first()["start"] == 4
    assert spark.createDataFrame([("abc", "xx abc yy"), ("abcd", "zzzz"), ("", "")], "a string, b string").select(corpus.partial_ratio("a", "b")).collect()[0][0] == 100.0
    videos = spark.createDataFrame([("v", "2026-03-10")], "video string, d string").selectExpr("video", "to_date(d) AS upload_date")
    clips = spark.createDataFrame([("v", 0, "The committee met today"), ("v", 1, "and voted on it")], "video string, ord int, text string")
    reports = spark.createDataFrame([("2026-03-09", "well, the committee met today and voted on it."), ("2026-03-11", "nothing alike"), ("2026-08-01", "the committee met today and voted on it")], "d string, text string").selectExpr("to_date(d) AS report_date", "text")
    got = corpus.assigned_reports(videos, clips, reports).first()
    assert (str(got["report_date"]), got["yield"], got["flagged"]) == ("2026-03-09", 1.0, False)
    sections = "array<struct<playtime:int,readers:array<struct<reader_id:string>>>>"
    books = spark.createDataFrame([(0, 1, "t", "English", [(400, [("7",)])]), (1, 2, "u", "English", [(500, [("7",)])]), (2, 3, "v", "English", [(900, [("8",), ("9",)])])], f"ord int, book_id int, title string, language string, sections {sections}")
    prior = spark.createDataFrame([(7, 3), (8, 1)], "reader_id bigint, prior_work_count int")
    assert [(r["reader_id"], r["book_id"]) for r in corpus.roster(books, prior).collect()] == [(7, 2)]
    secs = spark.createDataFrame([(1, 1, 200, "a.mp3"), (1, 2, 200, "b.mp3"), (1, 3, 100, "c.mp3"), (2, 1, 200, "d.mp3")], "book_id int, section_number int, playtime int, listen_url string")
    assert sorted(r["listen_url"] for r in corpus.picked_chapters(secs).collect()) == ["b.mp3", "d.mp3"]
    grid = spark.createDataFrame([("r", 1, 100.0)], "reader string, chapter int, duration double")
    assert [r["offset"] for r in corpus.clip_grid(grid, "reader", [60, 75, 90]).collect()] == [60.0, 75.0]
    cells = corpus.cells_of_json(spark.createDataFrame([('{"m": {"a": {"k": 1, "n": 4}, "b": {"k": 0, "n": 0}}}',)], "json string"))
    assert [(r["model"], r["condition"], r["rate"]) for r in corpus.panels(cells, ["m"], ["b", "a"]).collect()] == [("m", "a", 0.25)]
    scores = spark.createDataFrame([("p", True, 1.0), ("q", True, 2.0), ("x", False, 3.0)], "model string, in_panel boolean, score double")
    got = corpus.overridden(scores, spark.createDataFrame([("p", 9.0)], "model string, score double"))
    assert {r["model"]: (r["score"], r["kept"]) for r in got.collect()} == {"p": (9.0, False), "q": (2.0, True), "x": (3.0, False)}


def test_stream(spark, tmp_path):
    rows = [(f"{a} here", "m", f"{a} here") for a in ("any one", "anyone") for _ in range(6)]
    spark.createDataFrame(rows, "reference string, model string, hypothesis string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("reference string, model string, hypothesis string").json(str(tmp_path / "in"))
    query = tally.stream_tallies(stream, families.SPACING).writeStream.outputMode("complete").format("memory").queryName("tallied").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["arm"], r["hits"], r["n"]) for r in spark.table("tallied").collect()) == [(0, 6, 6), (1, 6, 6)]


def test_registered_functions(spark):
    sql.register(spark)
    got = spark.sql("SELECT wilson_rate(26, 32), wilson_lo(26, 32), wilson_hi(0, 0), char_cer('abcd', 'abxy'), size(align_ops(array('a', 'b'), array('a')))").first()
    assert (round(got[0], 4), round(got[1], 3), *got[2:]) == (0.8125, 0.647, 0.0, 0.5, 2)


def test_entry_stands_alone(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["model", "n_ref", "n_eligible", "rate", "lo", "hi"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    with pytest.raises(KeyError):
        __spark_entry__.queries()["nothing"]


def test_gates_and_pairs_are_counted_as_if_joined(spark):
    # repeated rows, null hits and null keys; the joins are written out here
    r = random.Random(5)
    table = lambda n: spark.createDataFrame([(r.choice(["m", "n", None]), r.choice(["a", "b", "c", "d", None]), r.choice([True, True, False, None])) for _ in range(n)], "model string, clip_key string, hit boolean").localCheckpoint()
    keys = ["model", "clip_key"]
    ordered = lambda df: sorted(map(tuple, df.collect()), key=str)
    for _ in range(3):
        shut, open_, other = table(12), table(9), table(9)
        both = open_.where("hit is not null").withColumnRenamed("hit", "o").join(shut.where("hit is not null"), keys, "left")
        want = both.groupBy("model").agg(F.count("*"), F.count_if("o"), F.count_if(F.expr("o and hit")), F.count_if(F.expr("o and hit is not null")))
        assert ordered(masked.gated_rate(shut, open_).drop("unmasked_rate", "masked_retrieval")) == ordered(want)
        for gate in (open_, other):
            pairs = open_.withColumnRenamed("hit", "a").join(shut.withColumnRenamed("hit", "b"), keys).where("a is not null and b is not null")
            pairs = pairs.join(gate.where("hit"), keys, "left_semi").join(other.where("hit"), keys, "left_semi").select(*keys, F.expr("cast(a as int) - cast(b as int)"))
            enough = [x.model for x in pairs.groupBy("model").count().where("count >= 3").collect()]
            assert ordered(masked.paired_difference(open_, shut, gate, other, least=3)) == ordered(pairs.where(F.col("model").isin(enough)))
    assert masked.paired_difference(open_, shut, open_, open_)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 4  # two tables for the pairs, two for the models' counts

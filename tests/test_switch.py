import pytest
from pyspark.sql import functions as F

from scribelens.plans import families, switch


def clips(spark, rows):
    return spark.createDataFrame([(i, r, m, h) for i, (r, hyps) in enumerate(rows) for m, h in hyps.items()], "clip_key int, reference string, model string, hypothesis string")


def titles(n=10):
    short, long = "Mr. Smith spoke at length", "mister Smith spoke at length"
    return [(r, {"fixed": long, "copies": r, "half": long if r == long or i % 2 else short}) for r in (short, long) for i in range(n)]


def test_switch_rates(spark):
    got = {r.model: r for r in switch.switch_rate(clips(spark, titles()), families.family("hon_mister")).collect()}
    assert {m: r.switch for m, r in got.items()} == {"fixed": 0.0, "copies": 1.0, "half": 0.5}
    assert got["half"].limiting_arm == "Mr" and got["copies"].follows_reference and not got["fixed"].follows_reference
    assert got["half"].arms["Mr"].hits == 5 and got["half"].n_total == 20


def test_thin_arms(spark):
    c = clips(spark, titles(3))
    assert switch.switch_rate(c, families.family("hon_mister")).count() == 0
    assert switch.switch_rate(c, families.family("hon_mister"), least=3).count() == 3


def test_one_arm_or_null_hypotheses(spark):
    c = clips(spark, [("Mr. Smith", {"m": "Mr. Smith", "n": None})] * 9)
    assert switch.tallies(c, [families.family("hon_mister")]).select("model", "n").collect() == [("m", 9)]
    assert switch.switch_rates(c, families.families_for("en")).count() == 0


@pytest.mark.parametrize(
    ("name", "text", "arm"),
    [
        ("hon_mister", "Mr. Smith spoke", "Mr"), ("hon_mister", "mr Smith spoke", "Mr"), ("hon_mister", "Mr Smith", "Mr"), ("hon_mister", "addressed to Mr.", None), ("hon_mister", "MISTER x", "mister"), ("hon_mister", "(mr)", None),
        ("hon_saint", "he lived on Bay St.", None), ("hon_saint", "St. Élan", "St"), ("hon_doctor", "dr. 5", None), ("okay", "O.K. then", "OK"), ("okay", "ok.", None), ("okay", "okay", "okay"), ("versus", "a vs b", "vs"),
        ("percent", "5 %", "%"), ("percent", "per cent", "percent"), ("alright", "all right", "all right"), ("year_2020", "twenty twenty 4", None), ("year_2020", "twenty twenty", "twenty twenty"), ("hon_senor", "SEÑOR", "señor"),
        ("hon_senorita", "Srta. x", "Srta"), ("hon_dona", "DÑA. x", "Dña"), ("etcetera_es", "ETCÉTERA", "etcétera"), ("hon_monsieur", "M. Élan", "M."), ("hon_monsieur", "m. Élan", None), ("hon_madame", "Mme X", "Mme"), ("abbr_dh", "das HEIẞT", "das heißt"),
        ("percent_pl", "procentach", "procent"), ("sp_anyone", "any one", "any one"), ("sp_anything", "Anything", "anything"), ("sp_anyone", "éanyone", None), ("sp_anyone", None, None),
    ],
)
def test_arms(spark, name, text, arm):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(families.family(name).arm_of(F.col("t"))).first()[0] == arm


def test_pooling(spark):
    pairs = [("any one", "anyone"), ("every one", "everyone"), ("some one", "someone")]
    rows = [(f"{r} here", {"copies": f"{r} here", "fixed": f"{solid} here"}) for spaced, solid in pairs for r in (spaced, solid) for _ in range(2)]
    c, fams = clips(spark, rows), list(families.SPACING)
    assert switch.switch_rates(c, fams).count() == 0
    got = {r.model: r for r in switch.pooled_switch_rate(c, fams, roles=families.SPACING_ARMS).collect()}
    assert {m: (r.switch, r.n_total) for m, r in got.items()} == {"copies": (1.0, 12), "fixed": (0.0, 12)} and got["fixed"].limiting_arm == "spaced"
    with pytest.raises(ValueError):
        switch.pooled_switch_rate(c, fams, roles=("a", "b", "c"))
    both = clips(spark, [("any one and everyone", {"m": "any one and everyone"})])
    assert switch.tallies(both, fams, pooled="p", roles=families.SPACING_ARMS).select("arm", "n").collect() == [(0, 1)]


def test_lookup(spark):
    assert {f.language for f in families.families_for("en_us")} == {"en"} and len(families.FAMILIES + families.SPACING) == 49
    assert len(families.families_for("en-GB")) == 31 and len(families.families_for("es")) == 7 and len(families.families_for("en", include_spacing=False)) == 27
    with pytest.raises(KeyError):
        families.family("nothing")
    with pytest.raises(ValueError):
        families.arms_in_common([families.family("okay"), families.make_family("x", "en", [("a", "a"), ("b", "b"), ("c", "c")])])
    with pytest.raises(ValueError):
        families.make_family("x", "en", [("a", "a")])
    assert families.table(spark).count() == 98


def test_explorative_groups(spark):
    ranked, means = switch.balanced_groups(clips(spark, titles(4)), [families.family("hon_mister")], least_groups=1)
    assert {r.model: r.switch for r in ranked.collect()} == {"fixed": 0.0, "copies": 1.0, "half": 0.5} and means.count() == 3
    text = spark.createDataFrame([("Mr. Smith",)], "t string").select(switch.highlighted(F.col("t"), families.family("hon_mister"), 0)).first()[0]
    assert text == "[[Mr. S]]mith"


def test_patterns_are_sought_once(spark):
    two = [families.family(n) for n in ("hon_mister", "sp_anyone")]
    refs = spark.createDataFrame([(i, t) for i, t in enumerate(["Mr. Smith saw any one", "mister Smith", "anyone", "none", None])], "i int, reference string").localCheckpoint()
    clips = lambda rows: rows.select(*rows.columns, F.explode(F.array(F.struct(F.lit("x").alias("model"), F.col("reference").alias("hypothesis")), F.struct(F.lit("y").alias("model"), F.lit("Mr Smith, anyone").alias("hypothesis"))))).select(*rows.columns, "col.*")
    found = switch.tallies(clips(refs), two)
    early = switch.tallies(clips(switch.with_arms(refs, two)), two)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, early.collect())) and found.count() == 8
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # each of four patterns once in the reference and once in the hypothesis
    assert plan.count("RLIKE") == 8

import math
import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from scribelens.functions.stats import wilson
from scribelens.plans import consensus
from scribelens.plans.consensus import Settings

REF = "madam president the report is adopted today by a wide margin"


def edits(spark, ref, panel, models, **settings):
    rows = [("c", m, ref.split(), h.split()) for m, h in {**panel, **models}.items()]
    clips = spark.createDataFrame(rows, "clip_key string, model string, ref_tokens array<string>, hyp_tokens array<string>")
    out = consensus.find_ref_edits(clips, list(panel), list(models), Settings(**settings)).collect()
    return [r.asDict() | {"verdicts": {v["model"]: v["verdict"] for v in r["verdicts"]}} for r in out]


def panel(text, n=4):
    return {f"p{i}": text for i in range(n)}


def test_deletion(spark):
    (e,) = edits(spark, REF, panel("the report is adopted today by a wide margin"), {"follower": REF, "audio": "the report is adopted today by a wide margin"})
    assert (e["kind"], e["position"], e["tokens"], e["indices"], e["n_panel_agree"], e["n_panel"]) == ("delete", "start", ["madam", "president"], [0, 1], 4, 4)
    assert e["verdicts"] == {"follower": "ref", "audio": "consensus"} and e["consensus_cer"] == 1.0


def test_insertion(spark):
    heard = REF + " thank you"
    (e,) = edits(spark, REF, panel(heard), {"follower": REF, "audio": heard})
    assert (e["kind"], e["position"], e["tokens"], e["indices"]) == ("insert", "end", ["thank", "you"], [11])
    assert e["verdicts"] == {"follower": "ref", "audio": "consensus"} and e["consensus_cer"] is None
    (e,) = edits(spark, REF, panel("well now " + REF), {"a": "now " + REF, "b": "so well now " + REF})
    assert (e["position"], e["tokens"], e["verdicts"]) == ("start", ["well", "now"], {"a": "ref", "b": "consensus"})


def test_incompetent_models_have_no_verdict(spark):
    (e,) = edits(spark, REF, panel("the report is adopted today by a wide margin"), {"silent": "", "off": "le rapport est adopte"})
    assert e["verdicts"] == {"silent": None, "off": None}


def test_no_edit(spark):
    short = "the report is adopted today by a wide margin"
    assert edits(spark, REF, {"a": short, "b": short, "c": REF, "d": REF}, {}) == []
    assert edits(spark, REF, panel(short, 2), {}) == []
    assert edits(spark, "lactuelle commission propose un texte", panel("l actuelle commission propose un texte"), {"m": "x"}, include_middle=True) == [] or all(e["kind"] == "insert" for e in edits(spark, "lactuelle commission propose un texte", panel("l actuelle commission propose un texte"), {}, include_middle=True))


def test_interior(spark):
    ref, heard = "the common fisheries policy is adopted by all", "the common policy is adopted by all"
    assert edits(spark, ref, panel(heard), {}) == []
    (e,) = edits(spark, ref, panel(heard), {}, include_middle=True)
    assert (e["position"], e["tokens"], e["indices"]) == ("middle", ["fisheries"], [2])


def brute(ref, panel_hyps, models, s):
    """An independent single-process version."""

    def ops(h):
        return SequenceMatcher(None, ref, h, autojunk=False).get_opcodes()

    def missed(h):
        return {i for t, a, b, *_ in ops(h) if t in ("delete", "replace") for i in range(a, b)}

    def able(h):
        return sum(b - a for t, a, b, *_ in ops(h) if t == "equal") >= int(s.min_ref_match * len(ref))

    def inserted(h, at):
        return [w for t, a, _, c, d in ops(h) if t == "insert" and a == at for w in h[c:d]]

    def cer(a, b):
        a, b = "".join(a.split()), "".join(b.split())
        return 1 - sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a)

    good = {m: h for m, h in panel_hyps.items() if able(h)}
    if len(good) < s.min_panel or not ref:
        return []
    need = max(2, math.ceil(s.majority * len(good) - 1e-9))
    out = []
    votes = Counter(i for h in good.values() for i in missed(h))
    i = 0
    while i < len(ref):
        j = i
        while j < len(ref) and votes[j] >= need:
            j += 1
        if j > i and j - i >= s.min_run_len and (s.include_middle or i == 0 or j == len(ref)):
            span = set(range(i, j))
            each = sorted(cer(" ".join(ref[i:j]), " ".join(" ".join(h[c:d]) for t, a, b, c, d in ops(h) if t == "replace" and span & set(range(a, b)))) for h in good.values() if missed(h) & span)
            if each[len(each) // 2] >= s.min_consensus_cer:
                out.append(("delete", i, tuple(ref[i:j]), votes[i], tuple(sorted((m, None if not able(h) else "consensus" if missed(h) & span else "ref") for m, h in models.items()))))
        i = max(j, i + 1)
    for at in (0, len(ref)):
        lists = [inserted(h, at)[:: -1 if at == 0 else 1] for h in good.values()]
        chunk = []
        while True:
            here = [x[len(chunk)] for x in lists if len(x) > len(chunk)]
            if not here or Counter(here).most_common(1)[0][1] < need:
                break
            chunk.append(Counter(here).most_common(1)[0][0])
        agree = sum(x[: len(chunk)] == chunk for x in lists)
        if chunk and len(chunk) >= s.min_run_len and agree >= need:
            out.append(("insert", at, tuple(chunk[:: -1 if at == 0 else 1]), agree, tuple(sorted((m, None if not able(h) else "consensus" if inserted(h, at)[:: -1 if at == 0 else 1][: len(chunk)] == chunk else "ref") for m, h in models.items()))))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    rows, want = [], Counter()
    s = Settings(include_middle=True, majority=0.6)
    for clip in range(80):
        ref = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 12))]
        base = [w for w in ref if r.random() > 0.2] + r.choice([[], ["thank", "you"]])
        if r.random() < 0.3:
            base = ["well", *base]
        hyps = {}
        for m in ("p0", "p1", "p2", "p3", "x", "y"):
            hyps[m] = [w for w in (base if m[0] == "p" or r.random() < 0.5 else ref) if r.random() > 0.05] if r.random() > 0.1 else []
        rows += [(clip, m, ref, h) for m, h in hyps.items()]
        for e in brute(ref, {m: h for m, h in sorted(hyps.items()) if m[0] == "p"}, hyps, s):
            want[(clip, *e)] += 1
    clips = spark.createDataFrame(rows, "clip_key int, model string, ref_tokens array<string>, hyp_tokens array<string>").repartition(7)
    got = Counter((e["clip_key"], e["kind"], e["first"], tuple(e["tokens"]), e["n_panel_agree"], tuple(sorted((v["model"], v["verdict"]) for v in e["verdicts"]))) for e in consensus.find_ref_edits(clips, ["p0", "p1", "p2", "p3"], settings=s).collect())
    assert got == want and len(want) > 20


def test_rates(spark):
    kind = "clip_key int, kind string, first int, corpus string, verdicts array<struct<model:string,verdict:string>>"
    df = spark.createDataFrame([(1, "delete", 0, "x", [("a", "ref"), ("b", "consensus"), ("c", None)]), (2, "delete", 0, "y", [("a", "ref"), ("b", "ref"), ("c", None)])], kind)
    got = consensus.accept_ref_rate(df).collect()
    assert [(r.model, r.rate, r.n_ref, r.n_eligible) for r in got] == [("a", 1.0, 2, 2), ("b", 0.5, 1, 2)]
    assert consensus.accept_ref_rollup(df, "corpus").where("corpus is null and model is null").first().n_eligible == 4


def test_wilson(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (0, 0), (26, 32), (527, 1322)], "k int, n int")
    got = [tuple(r[0]) for r in df.select(wilson(F.col("k"), F.col("n"))).collect()]
    assert got[2] == (0.0, 0.0, 0.0) and all(0 <= lo <= p <= hi <= 1 for p, lo, hi in got)
    assert [round(x, 3) for x in got[3]] == [0.812, 0.647, 0.911] and round(got[4][0], 4) == 0.3986


def test_texts_are_cut_once(spark, tmp_path):
    from scribelens import queries

    rows = [(1, " ".join(map(str, range(60))), "s", "en"), (2, " . ", "s", "en"), (3, None, "s", "en"), (4, "one", "s", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    refs = queries.refs(spark, str(tmp_path))
    assert sorted((r.clip_key, len(r.ref_tokens)) for r in refs.collect()) == [(100000, 24), (100001, 36), (400000, 1)]
    assert refs._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_drop_before_a_repeated_token_is_two_edits(spark):
    # what is left stands first one place earlier, so a token goes at each end (clip 628700004 of sf0.1)
    ref = ["eteauané", *["eau"] * 23]
    found = edits(spark, " ".join(ref), panel(" ".join(ref[2:])), {})
    assert SequenceMatcher(None, ref, ref[2:], autojunk=False).get_opcodes() == [("delete", 0, 1, 0, 0), ("equal", 1, 23, 0, 22), ("delete", 23, 24, 22, 22)]
    assert sorted((e["first"], e["tokens"]) for e in found) == [(0, ["eteauané"]), (23, ["eau"])]

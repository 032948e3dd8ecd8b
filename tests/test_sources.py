import json

import pytest

from scribelens import cli
from scribelens.sources import predictions as p
from scribelens.sources import store

TWO = [{"audio_filepath": "clip1", "duration": 3.0, "time": 0.1, "text": "Mr. Smith spoke", "pred_text": "mister Smith spoke"}, {"audio_filepath": "clip2", "duration": 4.0, "time": 0.1, "text": "the report is adopted", "pred_text": "the report is adopted"}]


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_one_manifest(spark, tmp_path):
    got = p.load_manifest(spark, lines(tmp_path / "model_a.jsonl", TWO))
    assert [r.model for r in got.models().collect()] == ["model_a"] and got.n_clips().first()[0] == 2
    assert {(r.clip_key, r.hypothesis) for r in got.clips().collect()} == {("clip1", "mister Smith spoke"), ("clip2", "the report is adopted")}


def test_folder_and_partial_runs(spark, tmp_path):
    lines(tmp_path / "full.jsonl", TWO)
    lines(tmp_path / "partial.jsonl", TWO[:1])
    got = p.load_dir(spark, str(tmp_path))
    assert [tuple(r) for r in got.coverage().collect()] == [("full", 2), ("partial", 1)]
    assert got.clips(require_all=True).select("clip_key").distinct().count() == 1 and got.clips(models=[]).count() == 3 and got.clips(models=["partial"]).count() == 1
    assert {r.clip_key: len(r.hypotheses) for r in got.clip_maps().collect()} == {"clip1": 2, "clip2": 1}


def test_nulls_and_missing_keys(spark, tmp_path):
    rows = [{"text": "a", "pred_text": "b"}, {"text": None, "pred_text": ""}, {"text": "x", "pred_text": None}, {"text": "c", "pred_text": "d"}]
    got = p.load_manifest(spark, lines(tmp_path / "m.jsonl", rows))
    assert {(r.clip_key, r.reference, r.hypothesis) for r in got.clips().collect()} == {("m:0", "a", "b"), ("m:1", "", ""), ("m:3", "c", "d")}


def test_other_names_and_errors(spark, tmp_path):
    got = p.load_manifest(spark, lines(tmp_path / "m.jsonl", [{"id": "c1", "reference": "a b c", "hypothesis": "a b d"}]))
    assert got.clips().first().hypothesis == "a b d"
    bad = lines(tmp_path / "bad.jsonl", [{"a": 1, "b": 2}])
    with pytest.raises(ValueError, match="ref_field"):
        p.load_manifest(spark, bad)
    assert p.load_manifest(spark, bad, ref_field="a", hyp_field="b").clips().first().reference == "1"
    with pytest.raises(FileNotFoundError):
        p.load_dir(spark, str(tmp_path), "*.none")
    with pytest.raises(ValueError):
        p.read_rows(spark, "x.txt")


def test_conflicts_first_and_last_win(spark, tmp_path):
    row = lambda ref, hyp: {"id": "c1", "text": ref, "pred_text": hyp}
    lines(tmp_path / "a.jsonl", [row("a b c", "1"), row("a b c", "2")])
    lines(tmp_path / "b.jsonl", [row("a b DIFFERENT", "3")])
    got = p.load_dir(spark, str(tmp_path))
    assert [r.clip_key for r in got.ref_conflicts().collect()] == ["c1"] and got.first_refs().first().reference == "a b c"
    assert {(r.model, r.hypothesis) for r in got.last_hyps().collect()} == {("a", "2"), ("b", "3")}
    assert got.normalized().ref_conflicts().count() == 0 and got.ref_conflicts().count() == 1


def test_kinds_of_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text('audio_filepath,text,pred_text\nc1,"a, b",a b d\nc2,x,\n', encoding="utf-8")
    got = {r.clip_key: r.hypothesis for r in p.load_manifest(spark, str(tmp_path / "m.csv")).clips().collect()}
    assert got == {"c1": "a b d", "c2": ""}
    (tmp_path / "m.json").write_text(json.dumps({"samples": TWO}), encoding="utf-8")
    (tmp_path / "l.json").write_text(json.dumps(TWO), encoding="utf-8")
    assert all(p.load_manifest(spark, str(tmp_path / f)).n_clips().first()[0] == 2 for f in ("m.json", "l.json"))
    spark.createDataFrame(TWO).write.parquet(str(tmp_path / "q.parquet"))
    assert p.load_manifests(spark, {"x": str(tmp_path / "q.parquet")}).models().first().model == "x"
    lines(tmp_path / "empty.jsonl", [])


def test_corpus_folders(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    lines(tmp_path / "c1" / "a.jsonl", TWO)
    lines(tmp_path / "c1" / "b.jsonl", TWO)
    assert p.available(spark, str(tmp_path)) == ["c1"]
    assert [r.model for r in p.load_predictions(spark, str(tmp_path), "c1", ["b"]).models().collect()] == ["b"]


def test_manifest_store(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, "first", 1.5), ("k", 2, "second", 2.0), ("j", 3, None, 3.0)], "__key__ string, o int, text string, duration double")
    store.write_manifest(rows, str(tmp_path), "o")
    got = store.read_manifest(spark, str(tmp_path))
    assert got.columns == [f.name for f in store.MANIFEST] and {(r["__key__"], r.text) for r in got.collect()} == {("k", "first"), ("j", "")}
    with pytest.raises(ValueError):
        store.write_manifest(rows.limit(0), str(tmp_path), "o")
    both, counts = store.add_samples(got.select("__key__", "text"), spark.createDataFrame([("j", "x"), ("n", "y"), ("n", "z")], "__key__ string, text string"))
    assert both.count() == 3 and tuple(counts.first()) == (1, 1)


def test_runs_and_exports(spark, tmp_path):
    runs = spark.createDataFrame([("c", "s", "m", "r1", 1, True), ("c", "s", "m", "r2", 2, False), ("c", "s", "m", "legacy_r", 3, True), ("c", "s", "n", "r9", 1, True)], "corpus string, split string, model string, run string, mtime int, done boolean")
    assert {(r.model, r.run) for r in store.latest_runs(runs).collect()} == {("m", "r1"), ("n", "r9")}
    shards = spark.createDataFrame([("c", "s", "m", "k", " ", "norm"), ("c", "s", "n", "k", "raw", "norm")], "corpus string, split string, model string, __key__ string, hyp_raw string, hyp string")
    old = spark.createDataFrame([("c", "s", "n", "k", "legacy")], "corpus string, split string, model string, __key__ string, hypothesis string")
    assert {(r.model, r.hyp) for r in store.run_rows(shards, old).collect()} == {("m", "norm"), ("n", "legacy")}
    assert {r[0] for r in store.allowed_corpora(spark, ["a", "b"], ["x"], ["b-x"]).collect()} == {"a", "b", "a-x"}
    rows = spark.createDataFrame([("c", "m", "k2", 1.23456, None), ("c", "m", "k1", 2.0, 0.00001)], "corpus string, model string, audio_filepath string, duration double, time double")
    store.export_predictions(rows, str(tmp_path / "out"))
    text = next((tmp_path / "out" / "corpus=c" / "model=m").glob("*.json")).read_text().splitlines()
    assert [json.loads(x)["audio_filepath"] for x in text] == ["k1", "k2"] and json.loads(text[1]) == {"audio_filepath": "k2", "duration": 1.235}
    masks = spark.createDataFrame([("bad-set", 1), ("good", 2)], "source_dataset string, x int")
    assert store.export_masks(masks, str(tmp_path / "masks"), ["bad"]) and not store.export_masks(masks, str(tmp_path / "none"), ["good", "bad"])


def test_reports(spark, tmp_path):
    xml = '<INTERVENTION><ORATEUR LG="EN" LIB="A | B"/><PARA>Chair <I>of</I> it. – Good &amp; well.</PARA></INTERVENTION><INTERVENTION><ORATEUR LG="FR" LIB="C"/><PARA>Non.</PARA></INTERVENTION>'
    (tmp_path / "r.xml").write_text(xml, encoding="utf-8")
    got = store.report_turns(spark, str(tmp_path / "r.xml"), "EN").collect()
    assert [(r.speaker, r.lg, r.text) for r in got] == [("A B", "EN", "Good & well.")] or got[0].text.endswith("Good & well.")


def test_command_line(spark, tmp_path, capsys):
    ref = "madam president the report is adopted today by a wide margin"
    for m in ("a", "b", "c"):
        lines(tmp_path / f"{m}.jsonl", [{"id": "c1", "text": ref, "pred_text": ref[16:]}])
    lines(tmp_path / "follower.jsonl", [{"id": "c1", "text": ref, "pred_text": ref}])
    out = tmp_path / "out.json"
    assert cli.main(["ref-disagreement", "--preds", str(tmp_path), "--panel", "a,b,c", "--out", str(out)]) == 0
    got = json.loads(out.read_text(encoding="utf-8"))
    assert got["accept_ref"]["follower"]["rate"] == 1.0 and got["n_edits"] == 1 and got["edits"][0]["text"] == "madam president" and got["panel"] == ["a", "b", "c"]
    assert "follower" in capsys.readouterr().out
    assert cli.main(["ref-disagreement", "--preds", str(tmp_path), "--panel", "a,b"]) == 2
    assert cli.main(["switch-rate", "--preds", str(tmp_path)]) == 1
    words = [("anyone", "any one")[i % 2] + " here" for i in range(12)]
    (tmp_path / "s").mkdir()
    lines(tmp_path / "s" / "m.jsonl", [{"id": str(i), "text": w, "pred_text": w} for i, w in enumerate(words)])
    assert cli.main(["switch-rate", "--preds", str(tmp_path / "s"), "--spacing", "--out", str(out)]) == 0
    assert next(iter(json.loads(out.read_text()).values()))["m"]["switch"] == 1.0

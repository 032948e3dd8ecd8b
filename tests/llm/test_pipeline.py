"""The pipeline's stages one by one, and their registration."""

import __spark_entry__
import corpus_pipeline

from .fixtures import words


def test_registration():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages(spark, tmp_path):
    passage = words(900, 30)
    base = words(901, 120).split(" ")
    texts = {i: ". ".join(words(i * 7 + j, 12).capitalize() for j in range(8)) + "." for i in range(60)}
    texts |= {i: "menu | " * 60 for i in range(60, 90)}
    texts |= {90: " ".join(base), 91: " ".join(base), 92: " ".join([*base[:60], "other", *base[61:]]), 93: words(903, 40) + " " + passage + " " + words(904, 40), 94: words(905, 60) + " password = hunter2hunter2 end"}
    sources = ["a", "b", None]
    rows = [(i, t, "en", sources[i % 3], len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(not 60 <= i < 90), 0) for i in range(90)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder, kept = str(tmp_path), docs
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        left[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert not set(left["quality"]) & set(range(60, 90)) and set(range(60)) <= set(left["quality"])
    assert {90} == {90, 91, 92} & set(left["near_duplicates"])
    assert 93 not in left["decontamination"] and set(range(60)) <= set(left["decontamination"])
    assert left["secret_scan"][94].endswith(" [secret] end")
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    assert {r["doc_id"] for r in mixed} <= set(left["secret_scan"]) and max(r["copy"] for r in mixed) <= 3
    assert corpus_pipeline.run(spark, folder).count() == len(mixed)


def test_near_duplicates_keep_their_rows(spark, tmp_path):
    # the files are split otherwise when the result is read than when the groups were found
    texts = [words(7000 + i // 2, 80) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.repartition(8).write.parquet(str(tmp_path / "documents"))
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = spark.conf.get(size), spark.conf.get(cost)
    try:
        kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "documents")), "")
        spark.conf.set(size, "4k")
        spark.conf.set(cost, "4k")
        found = {r["doc_id"] for r in kept.select("*").collect()}
    finally:
        spark.conf.set(size, old[0])
        spark.conf.set(cost, old[1])
    assert found == set(range(0, 200, 2))

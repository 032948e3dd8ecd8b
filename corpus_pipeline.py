"""The corpus pipeline: five stages over documents, each stored and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelens.llm import decontaminate, mixing, quality_cnn, secrets, simhash
from scribelens.llm.common import held_out, stored, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier scores at 0.3 or more.

    Null and empty texts are scored as one empty chunk, very long ones in chunks that cover
    them; repeated rows and ties get one score. An empty table stays empty, other columns stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    network = quality_cnn.trained(docs, labels, ~held_out(F.col("id"), 5, 0))
    return quality_cnn.accepted(docs, network)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts whose five-word shingles are alike at 0.8 or more.

    Null, empty and blank texts are copies of each other. Of repeated rows, and of ties in
    doc_id, the first in the table stays; a row without doc_id stays only where its group has
    no other. Very long texts take part with all their shingles, other columns stay.
    """
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark: ten of an item's words in a row, or a shorter item whole.

    Null and empty texts hold none; repeated rows go or stay together; an empty benchmark
    drops nothing; other columns stay.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows.

    All rows stay. A null text stays null (and so does its n_chars), texts without a secret
    stay as they are, overlapping secrets are one; other columns stay.
    """
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with its number among its copies (column copy, replaced if there is one).

    A null source is a source of its own. A text without words has size 0 and is drawn like
    others; repeated rows are drawn alike; an empty table stays empty; other columns stay.
    """
    plain = docs.drop("copy")
    names = temporary(plain, *plain.columns)
    mixed = mixing.mixed(plain.toDF(*names), id_col=names[plain.columns.index("doc_id")], text_col=names[plain.columns.index("text")], source_col=names[plain.columns.index("source")])
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")
    return mixed.where("copies > 0").select(*(F.col(new).alias(old) for new, old in zip(names, plain.columns, strict=True)), copies)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
]

#: The classifier, the fingerprints and the seeded draw can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs

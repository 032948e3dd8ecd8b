"""The queries op1_... to op10_... over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, license_scan, mixing, quality_cnn, quality_rules, secrets, simhash, substring_dedup, url_filter
from .common import held_out

#: The rules that op2 judges by.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every line, however short, and every sentence or run of sentences of 8 words or more that an earlier place already has."""
    found = substring_dedup.repeated(_table(spark, folder, "documents"), least_line=1)
    return found.select(F.col("id").alias("doc_id"), F.col("first").alias("start"), "end", "n_words", "digest", F.col("kept_id").alias("kept_doc_id"), F.col("kept_first").alias("kept_start"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): a page shows the document whose doc_id is the number that ends its path; it is good if that is of quality 1 and not toxic."""
    document = F.regexp_extract(url_filter.path_of(F.col("url")), r"([0-9]{1,18})[^0-9/]*/?$", 1)
    numbered = pages.select("page_id", F.when(document != "", document.cast("long")).alias("doc_id"))
    good = labels.where("toxic is not null or quality is not null").select("doc_id", ((F.coalesce("toxic", F.lit(0)) == 0) & (F.coalesce("quality", F.lit(1)) == 1)).cast("int").alias("good"))
    return numbered.join(good, "doc_id").select("page_id", "good")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url, judged by the rules, else by its template's labelled pages."""
    pages = _table(spark, folder, "pages")
    return url_filter.judged(pages, page_labels(pages, _table(spark, folder, "labels")), URL_RULES).withColumnRenamed("id", "page_id")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    found = secrets.scanned(_table(spark, folder, "documents"))
    n = [F.size(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select(F.col("id").alias("doc_id"), *n, _digest(F.col("base")).alias("base_sha256"), F.col("all").alias("spans"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the divergence verdict of every document."""
    return quality_rules.judged(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    mixed = mixing.mixed(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.clusters(_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from the labels of those that aren't held out."""
    documents, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    network = quality_cnn.trained(documents, labels, ~held_out(F.col("id"), 5, 0))
    scores = quality_cnn.scored(documents, network)
    return scores.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_ctw_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document by the context tree and by unigrams."""
    found = ctw.scored(_table(spark, folder, "documents"), ~held_out(F.col("doc_id"), 7, 2))
    return found.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents hold which benchmark items."""
    judged, _ = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    items = _digest(F.array_join("items", ","))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = license_scan.scanned(_table(spark, folder, "documents"))
    joined = [F.array_join(c, ",").alias(f"{n}labels") for c, n in (("base", "base_"), ("labels", ""))]
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", *joined, "score")


_ALL = (op1_substring_dedup, op2_url_filter, op3_secret_scan, op4_quality_rules, op5_source_mixing, op6_simhash, op7_quality_classifier, op8_ctw_scoring, op9_decontamination, op10_license_scan)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_MIXING_SQL = r"""WITH sized AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS most FROM sources),
ranked AS (SELECT *, most / w AS ratio, row_number() OVER r AS k, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM weighed
  WINDOW r AS (ORDER BY most / w, source NULLS LAST), b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(most, (SELECT arg_min(level, k) FROM ranked WHERE level <= ratio) * w) AS target FROM ranked),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || substr(md5('5:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM rated"""

_DECONTAMINATION_SQL = r"""WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS g FROM b, range(0, len(w) - least(10, len(w)) + 1) q(i) WHERE len(w) > 0),
grams AS (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM d, (SELECT DISTINCT n FROM windows) m, range(0, len(w) - n + 1) q(i)),
found AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express whole; the others are tested against brute force."""
    return {"op5_source_mixing": _MIXING_SQL, "op9_decontamination": _DECONTAMINATION_SQL}

"""Registration of the engine's functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import align


def register(spark: SparkSession) -> None:
    """align_ops, char_cer, token_edits (Arrow UDFs) and wilson_rate, wilson_lo, wilson_hi (SQL functions)."""
    spark.udf.register("align_ops", align.align_ops_udf)
    spark.udf.register("char_cer", align.char_cer_udf)
    spark.udf.register("token_edits", align.token_edits_udf)
    center = "(k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n)"
    half = "1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)"
    for name, body in (("rate", "k / n"), ("lo", f"greatest(0.0, {center} - {half})"), ("hi", f"least(1.0, {center} + {half})")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION wilson_{name}(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n = 0 THEN 0.0 ELSE {body} END")

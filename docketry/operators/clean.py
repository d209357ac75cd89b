"""Clean text, normalised text and cache key for a table of texts."""

from pyspark.sql import DataFrame, functions as F

from docketry.functions import text


def clean_and_key(rows: DataFrame, text_col: str = "receipt_text") -> DataFrame:
    """Add ``clean_text``, ``normalized_text`` and ``request_hash``.

    Three projections, each feeding the next, so every regex runs once per
    row.  No shuffle.
    """
    return (
        rows.withColumn("clean_text", text.clean_text(F.col(text_col)))
        .withColumn("normalized_text", text.normalize_text(F.col("clean_text")))
        .withColumn("request_hash", text.text_hash(F.col("normalized_text")))
    )


def duplicate_groups(keyed: DataFrame, id_col: str) -> DataFrame:
    """Size and first id of every group of texts with the same key."""
    return keyed.groupBy("request_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id")
    )

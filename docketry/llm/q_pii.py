"""Personal data in all documents."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.frames import table
from docketry.llm.pii import KINDS, find_spans, joined


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    numbers = [number(kind) for kind in KINDS]
    return found.select(
        "doc_id", *numbers,
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


SQL = None

"""Benchmark items in all documents."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.decontaminate import contaminated
from docketry.llm.frames import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(documents, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "item_id", "first_word", "last_word",
        *[F.round(c, 4).alias(c) for c in ("cosine", "overlap", "answer")],
    )


SQL = None

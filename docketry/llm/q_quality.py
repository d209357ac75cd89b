"""Quality of all documents."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.frames import table
from docketry.llm.quality import score_quality


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = score_quality(documents, labels, fold=~held_out(F.col("_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


SQL = None

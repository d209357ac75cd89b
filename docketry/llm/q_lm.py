"""Language-model scores of all documents."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.frames import table
from docketry.llm.lm_score import score_texts


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(documents, ~held_out(F.col("doc_id")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score",
    )


SQL = None

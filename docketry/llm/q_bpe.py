"""Tokens of all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.bpe import decode, encode
from docketry.llm.frames import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(documents, path, packed=True).drop("text"), path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


SQL = None

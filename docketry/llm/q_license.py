"""Licences of all documents."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.frames import table
from docketry.llm.license_scan import scan_licenses


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` is 1 with a base phrase, else the best share of a notice, else 0."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*columns))), ",")
    return found.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        labels("base.label").alias("base_labels"),
        labels("base.label", "notices.label").alias("labels"),
        F.when(F.size("base") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max("notices.covered"), F.lit(0.0)))
        .alias("score"),
    )


#: The rarest words, the intersection of postings and the common subsequences are
#: tested against brute force.
SQL = None

"""Periodic runs of all documents, one in ten of which is made periodic first."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.frames import table
from docketry.llm.periodic_runs import longest_run, periodic_runs, runs_text

WORD = r"[^\x20\x09-\x0D]+"


def planted(doc_id: Column, text: Column) -> Column:
    """The text, made periodic from a word on where the hash of the id says so.

    A NULL id hashes as an empty string."""
    text = F.coalesce(text, F.lit(""))
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.concat_ws(" ", F.transform(
            words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))
        ))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    made = F.element_at(F.transform(F.array(words), periodic), 1)
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(WORD)), made).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    damaged = documents.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(damaged).select("doc_id", "runs", "collapsed", longest_run(F.col("runs")).alias("best"))
    length, period = F.col("best.length"), -F.col("best.short")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(runs_text(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Comparing all periods of all words is quadratic in a text: too slow in SQL.
SQL = None

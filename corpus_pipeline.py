"""From raw documents to training tokens, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; between the
stages the rows are written to the shared folder and read again, so a lost
executor costs the tasks it ran and no stage before.  All but the last return
the columns of ``documents``.  Rows are told apart by id and text, so repeated
or missing ids mix nothing up; every stage accepts NULLs, empty texts and empty
tables as its operator states them, and keeps other columns as they are.
"""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.bpe import encode
from docketry.llm.decontaminate import contaminated
from docketry.llm.frames import table, written
from docketry.llm.near_dedup import near_duplicates
from docketry.llm.pii import find_spans, masked
from docketry.llm.quality import score_quality


def _identity() -> Column:
    """A document's id with a hash of its text."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc"))
    scored = score_quality(rows, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, once."""
    rows = docs.select(_identity().alias("identity"), "text")
    kept = near_duplicates(rows, "identity").filter("kept").select(F.col("doc_id").alias("identity"))
    rows = docs.select(_identity().alias("identity"), F.struct(*docs.columns).alias("doc"))
    stays = rows.join(kept.distinct(), "identity", "left_semi").dropDuplicates(["identity"])
    return stays.select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows = docs.select(_identity().alias("identity"), "text", F.struct(*docs.columns).alias("doc"))
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), "identity")
    found = written(found.select(F.col("doc_id").alias("identity")).distinct(), "contaminated")
    return rows.join(found, "identity", "left_anti").select("doc.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``<KIND>`` in the place of personal data."""
    rows = docs.select("text", F.struct(*docs.columns).alias("doc"))
    found = find_spans(rows).withColumn("clean", masked(F.coalesce("text", F.lit("")), F.col("spans")))
    changed = {"text": F.when(F.col("text").isNotNull(), F.col("clean"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.char_length("clean").cast("long")).otherwise(
            F.col("doc.n_chars")
        )
    return found.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids and their number."""
    coded = encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Near-duplicate groups, trained models and token ids have no SQL form.
ORACLE_SQL = None

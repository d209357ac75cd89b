"""Repeated passages of all documents."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.frames import table
from docketry.llm.substring_dedup import remove_repeats


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s,
         unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS t
  FROM words WHERE len(w) >= 20
), ranked AS (
  SELECT doc_id, s, rank() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE r > 1
), dropped AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), left_over AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(g), 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN dropped d ON w.doc_id = d.doc_id LEFT JOIN left_over l ON w.doc_id = l.doc_id
"""

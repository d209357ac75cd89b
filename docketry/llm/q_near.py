"""Near-duplicates of all documents."""

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.frames import table
from docketry.llm.near_dedup import near_duplicates


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n, any_value(a.n) AS an, any_value(b.n) AS bn
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs WHERE 100 * both_n >= 85 * (an + bn - both_n)
  UNION SELECT b, a FROM pairs WHERE 100 * both_n >= 85 * (an + bn - both_n)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT doc_id, len(s) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sets JOIN (SELECT node, min(other) AS c FROM reach GROUP BY node) ON node = doc_id
"""

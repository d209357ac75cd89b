"""Placement of all documents."""

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.frames import table
from docketry.llm.sharding import HASH_DIGITS, SHARDS, TABLE_SIZE, place


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return place(documents, "doc_id").select("doc_id", "source", "slot", "shard")


def _hash(text: str) -> str:
    return f"('0x' || md5({text})[1:{HASH_DIGITS}])::BIGINT"


SQL = f"""
WITH RECURSIVE shards AS (
  SELECT n AS shard, name, {_hash("name")} % {TABLE_SIZE} AS start,
         {_hash("name || '#'")} % {TABLE_SIZE - 1} + 1 AS stride
  FROM (SELECT n, 'shard-' || lpad(n::VARCHAR, 2, '0') AS name
        FROM range({len(SHARDS)}) r(n))
), fill AS (
  SELECT 0 AS turn, -1::BIGINT AS slot,
         list_transform(range({TABLE_SIZE}), lambda x: false) AS taken,
         list_transform(range({len(SHARDS)}), lambda x: 0::BIGINT) AS seen
  UNION ALL
  SELECT turn + 1, (start + pos * stride) % {TABLE_SIZE},
         list_transform(taken, lambda x, i: x OR i = (start + pos * stride) % {TABLE_SIZE} + 1),
         list_transform(seen, lambda x, i: CASE WHEN i = shard + 1 THEN pos + 1 ELSE x END)
  FROM (
    SELECT turn, taken, seen, shard, start, stride,
           list_filter(range(seen[shard + 1], {TABLE_SIZE}),
                       lambda p: NOT taken[(start + p * stride) % {TABLE_SIZE} + 1])[1] AS pos
    FROM fill JOIN shards ON shard = turn % {len(SHARDS)}
    WHERE turn < {TABLE_SIZE})
)
SELECT doc_id, source, d.slot, 'shard-' || lpad((owner)::VARCHAR, 2, '0') AS shard
FROM (SELECT doc_id, source, {_hash("coalesce(doc_id::VARCHAR, '')")} % {TABLE_SIZE} AS slot
      FROM documents) d
JOIN (SELECT slot, (turn - 1) % {len(SHARDS)} AS owner FROM fill WHERE turn > 0) t USING (slot)
"""

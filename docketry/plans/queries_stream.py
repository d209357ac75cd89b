"""Registered queries: the streaming forms, run to completion over the events."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry import schemas
from docketry.functions.text import text_hash
from docketry.operators.cache import DAY
from docketry.plans.queries_cache import _CHAIN, _REQUEST_INGEST, api_events
from docketry.session import work_folder
from docketry.sources.orders import table
from docketry.streaming import receipts as streaming, ttl


#: The events come in so many arrivals, by time; every fiftieth of all but the last
#: part comes two later.
ARRIVALS = 5
_LATE = 7


def _part(low: Column, high: Column, second: Column) -> Column:
    return F.floor((second - low) * ARRIVALS / (high - low + 1))


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All requests, and a stream that gets them arrival by arrival, each its own
    micro-batch.  A last one moves the watermark past all of them."""
    text = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").cast("timestamp").alias("request_ts"),
        text_hash(text).alias("request_hash"),
    )
    second = F.unix_seconds("request_ts")
    low, high = requests.agg(F.min(second), F.max(second)).first()
    part = _part(F.lit(low or 0), F.lit(high or 0), second)
    held_back = (F.col("request_id").cast("bigint") % 50 == _LATE) & (part < ARRIVALS - 1)
    placed = requests.withColumn("arrival", part + F.when(held_back, 2).otherwise(0))
    closing = spark.sql(
        "SELECT 'closing' AS request_id, TIMESTAMP '2100-01-01' AS request_ts, 'closing' AS request_hash"
    )
    folder = work_folder(spark, "arrivals")
    for k in range(ARRIVALS + 1):
        placed.filter(F.col("arrival") == k).drop("arrival").repartition(2).write.mode("append").parquet(folder)
    closing.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(closing.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return requests, stream


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    requests, stream = _arrivals(spark, sf_dir)
    folder = work_folder(spark, "stream-ttl")
    streaming.start_table(ttl.stream_ttl_seconds(stream, DAY), f"{folder}/out", f"{folder}/state").awaitTermination()
    return requests, spark.read.parquet(f"{folder}/out")


def stream_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from a stream of several micro-batches, late requests left out."""
    return ttl.answers(*_decided(spark, sf_dir)).select("request_id", "cache_status", "served_by")


_SPLIT_EVENTS = f"""
ends AS (SELECT CAST(floor(epoch_us(min(ts)) / 1000000) AS BIGINT) AS low,
  CAST(floor(epoch_us(max(ts)) / 1000000) AS BIGINT) AS high FROM events),
late_events AS (SELECT events.* FROM events, ends WHERE event_id % 50 = {_LATE}
  AND (CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - low) * {ARRIVALS} // (high - low + 1) < {ARRIVALS - 1}),
timely_events AS (SELECT * FROM events ANTI JOIN late_events USING (event_id))"""

_STREAM_TTL = f"""
WITH RECURSIVE {_SPLIT_EVENTS}, {_CHAIN.format(events="timely_events")}
SELECT CAST(event_id AS VARCHAR) AS request_id,
  CASE WHEN first_id = event_id THEN 'miss' ELSE 'hit' END AS cache_status,
  CAST(first_id AS VARCHAR) AS served_by
FROM marked
"""


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "stream-ingest")
    api_events(spark, sf_dir).write.json(f"{folder}/events")
    events = streaming.read_events(spark, f"{folder}/events", files_per_batch=2)
    streaming.start_ingest(events, f"{folder}/out", f"{folder}/state").awaitTermination()
    requests = spark.read.schema(schemas.REQUESTS).parquet(f"{folder}/out/requests")
    return requests.select(
        "request_id", "receipt_text", "currency", "source", "user_id",
        F.get_json_object("metadata", "$.k").cast("int").alias("k"),
    )


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per hash; which one is not fixed, so the hashes are returned."""
    folder = work_folder(spark, "stream-dedupe")
    stream = _arrivals(spark, sf_dir)[1].filter("request_id <> 'closing'")
    first = streaming.stream_first_seen(stream, "40 days")
    streaming.start_table(first, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("request_hash").agg(
        F.count(F.lit(1)).alias("parsed")
    )


_STREAM_DEDUPE = """
SELECT DISTINCT sha256(user_id || '-' || event_type) AS request_hash, CAST(1 AS BIGINT) AS parsed
FROM events
"""


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side table of requests that came after the watermark."""
    _, decided = _decided(spark, sf_dir)
    return ttl.late_requests(decided).select("request_id", "second")


_STREAM_LATE = f"""
WITH {_SPLIT_EVENTS}
SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS second
FROM late_events
"""

QUERIES = {
    "stream_ttl": (stream_ttl, _STREAM_TTL),
    "stream_ingest": (stream_ingest, _REQUEST_INGEST),
    "stream_dedupe": (stream_dedupe, _STREAM_DEDUPE),
    "stream_late": (stream_late, _STREAM_LATE),
}

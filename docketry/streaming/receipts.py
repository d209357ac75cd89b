"""Structured Streaming forms of ingest and of the first request of a text."""

from pyspark.sql import DataFrame, SparkSession

from docketry import schemas
from docketry.operators.ingest import accepted, decode_requests, rejected


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Event files as they arrive, one JSON object per line."""
    return (
        spark.readStream.schema(schemas.API_EVENTS)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def start_ingest(events: DataFrame, out: str, checkpoint: str, **trigger):
    """Write valid requests and rejects to two tables under ``out``.

    Each batch writes its own folder, so a batch that is run again replaces
    what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_requests(batch).persist()
        for name, part in (("requests", accepted(decoded)), ("rejects", rejected(decoded))):
            part.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        decoded.unpersist()

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_first_seen(requests: DataFrame, delay: str = "30 days") -> DataFrame:
    """Approximate form: one request per hash within the watermark delay."""
    return requests.withWatermark("request_ts", delay).dropDuplicatesWithinWatermark(
        ["request_hash"]
    )


def start_table(stream: DataFrame, out: str, checkpoint: str, **trigger):
    """Append a stream to a parquet table."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

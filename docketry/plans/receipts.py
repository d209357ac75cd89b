"""Flow 1: requests -> receipts, parsing every distinct text once per TTL."""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from docketry import schemas
from docketry.functions.binding import settled
from docketry.operators.cache import (
    DEFAULT_TTL_SECONDS,
    attach_responses,
    cache_rows,
    read_response,
    response_json,
    ttl_dedupe,
)
from docketry.operators.categorize import categorize
from docketry.operators.clean import clean_and_key
from docketry.operators.extract import decode_model_responses, extract_receipts
from docketry.operators.validate import error_receipt, has_negative_amount, validate_and_score


class ParsedBatch(NamedTuple):
    """``receipts`` answers every request; ``written`` are the new cache rows."""

    receipts: DataFrame
    written: DataFrame


#: Stands for the second of a request without time.
_NO_TIME = -(1 << 63)


def parse_texts(
    keyed: DataFrame,
    decoded: DataFrame | None = None,
    rules: dict[str, list[str]] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Extract, categorise, validate and score rows that ``clean_and_key`` made.

    Without model output the whole chain is narrow: no shuffle at all.
    """
    return validate_and_score(categorize(extract_receipts(keyed, decoded, strict), rules))


def _receipt_struct():
    return F.struct(*[F.col(c) for c in schemas.RECEIPT_COLUMNS]).alias("receipt")


def parse_receipts(
    requests: DataFrame,
    responses: DataFrame | None = None,
    cache: DataFrame | None = None,
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
    rules: dict[str, list[str]] | None = None,
    strict: bool = False,
    parsed_path: str | None = None,
) -> ParsedBatch:
    """Answer a batch of valid requests.

    The regex work runs on misses only, after the dedupe.  ``parsed_path``
    (shared storage) keeps three tables below it, each made once: ids, hashes and
    times of the requests, their merged seconds, and the parsed misses.  All other
    work branches from those; texts are hashed once for the ids and once where the
    misses fetch theirs, and are shuffled in that join alone.
    """
    spark = requests.sparkSession
    keyed = clean_and_key(requests).withColumns(
        {"_opener": F.coalesce("request_id", F.lit("")), "_second": F.unix_seconds("request_ts")}
    )
    ids = keyed.select("request_id", "request_ts", "user_id", "request_hash")
    work = None
    if parsed_path is not None:
        work = f"{parsed_path.rstrip('/')}.work"
        ids.write.mode("overwrite").parquet(f"{work}/ids")
        ids = spark.read.schema(ids.schema).parquet(f"{work}/ids")
    marked, servers = ttl_dedupe(ids, cache, ttl_seconds, work_path=work)
    place = ["request_hash", "_opener", "_second"]
    at = F.coalesce(F.col("_second"), F.lit(_NO_TIME))
    opened = servers.filter(~F.col("from_cache")).select(
        "entry", "opened_at", "last_chunk", "request_hash",
        F.coalesce("served_by", F.lit("")).alias("_opener"), F.col("opened_at").alias("_second"),
    ).withColumn("_second", at)
    misses = (
        keyed.withColumn("_second", at)
        .join(opened, place)
        # One row of repeated deliveries; the join has brought them together.
        .dropDuplicates(place)
        .drop("_opener", "_second")
        # A generated column keeps the parsing out of the aggregation above.
        .select("*", settled(F.lit("miss")).alias("cache_status"))
    )
    decoded = None if responses is None else decode_model_responses(responses)
    parsed = parse_texts(misses, decoded, rules, strict).withColumn(
        "refused",
        F.when(F.col("amount_too_large"), "amount of more than 16 digits").when(
            has_negative_amount(), "negative amount"
        ),
    )
    if parsed_path is not None:
        parsed.write.mode("overwrite").parquet(parsed_path)
        parsed = spark.read.parquet(parsed_path)

    refusal = error_receipt(
        F.col("request_id"), F.concat(F.lit("Invalid request data: "), F.col("refused"))
    )
    fresh = parsed.select(
        "entry",
        "last_chunk",
        F.when(F.col("refused").isNotNull(), refusal).otherwise(_receipt_struct()).alias("receipt"),
    )
    if cache is not None:
        stored = (
            servers.filter("from_cache")
            .join(cache.select("request_hash", "response"), "request_hash")
            .select(
                "entry", "last_chunk",
                read_response(F.col("response")).alias("receipt"),
            )
        )
        fresh = fresh.unionByName(stored)

    answered = attach_responses(
        marked.select(
            F.col("request_id").alias("_id"), "request_ts", "user_id", "entry",
            "chunk", F.col("cache_status").alias("_status"),
        ),
        fresh,
    )
    failed = F.col("receipt.cache_status") == "error"
    receipts = answered.select(
        F.col("_id").alias("request_id"),
        "request_ts",
        "user_id",
        *[
            F.col(f"receipt.{c}").alias(c)
            for c in schemas.RECEIPT_COLUMNS
            if c not in ("request_id", "cache_status")
        ],
        F.when(failed, "error").otherwise(F.col("_status")).alias("cache_status"),
    )
    written = cache_rows(parsed.filter(F.col("refused").isNull()), ttl_seconds)
    return ParsedBatch(receipts, written)


def receipt_json(receipts: DataFrame) -> DataFrame:
    """``request_id`` and the API body: receipt as JSON, amounts as strings."""
    body = response_json(F.struct(*[F.col(c) for c in schemas.RECEIPT_COLUMNS]))
    return receipts.select("request_id", body.alias("body"))


def expense_summary(receipts: DataFrame, by: tuple[str, ...] = ("category", "month")) -> DataFrame:
    """Receipt count, spend and GST per group; one aggregation, pre-combined."""
    dated = receipts.withColumn("month", F.substring("receipt_date", 1, 7))
    return dated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("receipts"),
        F.sum("total_amount").alias("spend"),
        F.sum("gst_amount").alias("gst"),
    )

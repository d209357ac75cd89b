"""API event log -> valid requests and rejects."""

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.binding import blank_to_null, settled
from docketry.functions.text import derived_request_id, strip

ROUTE_METHOD = "POST"
ROUTE_PATH = "/v1/receipts/parse"


def route(events: DataFrame) -> DataFrame:
    """Add ``method`` and ``path`` from either event shape, stage prefix removed.

    The prefix goes only at a path boundary: stage ``prod`` leaves
    ``/production/...`` alone.
    """
    context = F.col("requestContext")
    raw_path = F.coalesce(
        blank_to_null(F.col("path")), blank_to_null(context["http"]["path"]), F.col("rawPath")
    )
    stage = F.concat(F.lit("/"), blank_to_null(context["stage"]))
    return (
        events.withColumn(
            "method", F.coalesce(blank_to_null(F.col("httpMethod")), context["http"]["method"])
        )
        .withColumns({"_raw_path": raw_path, "_stage": stage})
        .withColumn(
            "path",
            F.when(F.col("_raw_path") == F.col("_stage"), "/")
            .when(
                F.startswith(F.col("_raw_path"), F.concat(F.col("_stage"), F.lit("/"))),
                F.substr(F.col("_raw_path"), F.length("_stage") + 1),
            )
            .otherwise(F.col("_raw_path")),
        )
        .drop("_raw_path", "_stage")
    )


def _is(kind: Column, *allowed: str) -> Column:
    return F.coalesce(kind, F.lit("VOID")).isin(*allowed)


def decode_requests(events: DataFrame) -> DataFrame:
    """One row per event with typed request columns and ``reject_reason``.

    ``reject_kind`` is ``not_found``, ``client`` or ``server``; both columns
    are NULL on a valid request.  Nothing is dropped and nothing shuffles.
    """
    routed = route(events)
    plain = F.when(
        F.coalesce(F.col("isBase64Encoded"), F.lit(False)),
        F.try_to_binary(F.col("body"), F.lit("base64")).cast("string"),
    ).otherwise(F.coalesce(F.col("body"), F.lit("{}")))
    body = F.col("_body")

    def kind(field):
        return F.schema_of_variant(F.try_variant_get(body, f"$.{field}", "variant"))

    def value(field):
        return F.try_variant_get(body, f"$.{field}", "string")

    typed = (
        routed.withColumn("_text", plain)
        .withColumn("_body", F.try_parse_json(F.when(F.is_valid_utf8("_text"), F.col("_text"))))
        .withColumns(
            {
                "_whole": F.schema_of_variant(body),
                "_kind": F.struct(
                    *[
                        kind(f).alias(f)
                        for f in ("receipt_text", "currency", "source", "user_id", "metadata")
                    ]
                ),
                "_receipt_text": strip(value("receipt_text")),
                "_currency": value("currency"),
                "_source": value("source"),
                "_user_id": value("user_id"),
                "_metadata": F.to_json(F.try_variant_get(body, "$.metadata", "variant")),
            }
        )
    )
    kinds = F.col("_kind")
    currency = F.col("_currency")
    reason = (
        F.when(
            ~F.coalesce(
                (F.col("method") == ROUTE_METHOD) & (F.col("path") == ROUTE_PATH), F.lit(False)
            ),
            "Not Found",
        )
        .when(body.isNull(), "Invalid JSON in request body")
        .when(~F.startswith(F.col("_whole"), F.lit("OBJECT")), "Failed to process receipt")
        .when(~_is(kinds["receipt_text"], "STRING"), "receipt_text must be a string")
        .when(F.col("_receipt_text") == "", "receipt_text cannot be empty")
        .when(
            ~(
                _is(kinds["currency"], "STRING", "VOID")
                & _is(kinds["source"], "STRING", "VOID")
                & _is(kinds["user_id"], "STRING", "VOID")
            ),
            "optional fields must be strings",
        )
        .when(
            (currency != "") & (F.length(currency) != 3), "currency must be a 3-letter ISO code"
        )
        .when(
            kinds["metadata"].isNotNull()
            & (kinds["metadata"] != "VOID")
            & ~F.startswith(kinds["metadata"], F.lit("OBJECT")),
            "metadata must be an object",
        )
    )
    request_id = F.coalesce(
        blank_to_null(F.col("event_id")),
        derived_request_id(F.col("event_ts"), F.col("method"), F.col("path"), F.col("body")),
    )
    # a missing currency takes the default, an explicit null or '' stays
    currency_out = F.when(kinds["currency"].isNull(), "AUD").otherwise(F.upper(currency))
    kind_of_reject = (
        F.when(F.col("reject_reason") == "Not Found", "not_found")
        .when(F.col("reject_reason") == "Failed to process receipt", "server")
        .when(F.col("reject_reason").isNotNull(), "client")
    )
    return (
        typed.select("*", settled(reason).alias("reject_reason"))
        .withColumn("reject_kind", kind_of_reject)
        .select(
            request_id.alias("request_id"),
            F.col("event_ts").alias("request_ts"),
            F.col("_receipt_text").alias("receipt_text"),
            F.col("_source").alias("source"),
            currency_out.alias("currency"),
            F.col("_user_id").alias("user_id"),
            F.col("_metadata").alias("metadata"),
            "reject_reason",
            "reject_kind",
            F.col("body").alias("raw_body"),
        )
    )


def accepted(decoded: DataFrame) -> DataFrame:
    """Valid requests."""
    return decoded.filter(F.col("reject_reason").isNull()).drop(
        "reject_reason", "reject_kind", "raw_body"
    )


def rejected(decoded: DataFrame) -> DataFrame:
    """Rejected events with their raw body, for the quarantine table."""
    return decoded.filter(F.col("reject_reason").isNotNull()).select(
        "request_id", "request_ts", "reject_kind", "reject_reason", "raw_body"
    )

"""Structured receipts -> rendered text and dataset records."""

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.amounts import MONEY
from docketry.functions.binding import blank_to_null
from docketry.functions.text import derived_request_id
from docketry.operators.augment import augment_text


def _dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), amount.cast(MONEY).cast("string"))


def render_receipt(
    vendor: Column, items: Column, total: Column, gst: Column, date: Column
) -> Column:
    """Receipt text in the fixed layout: header, date, items, three amounts."""
    lines = F.transform(
        items, lambda i: F.concat(i["name"], F.lit(" - "), _dollars(i["total_price"]))
    )
    head = F.array(F.upper(vendor), F.concat(F.lit("Date: "), date), F.lit(""), F.lit("Items:"))
    tail = F.array(
        F.lit(""),
        F.concat(F.lit("Subtotal: "), _dollars(total - gst)),
        F.concat(F.lit("GST: "), _dollars(gst)),
        F.concat(F.lit("Total: "), _dollars(total)),
        F.lit(""),
        F.lit("Thank you for your business!"),
    )
    return F.array_join(F.concat(head, lines, tail), "\n")


def _rendered() -> Column:
    return render_receipt(
        F.col("vendor"), F.col("items"), F.col("total_amount"), F.col("gst_amount"),
        F.col("receipt_date"),
    )


def _expected() -> Column:
    return F.struct(
        "vendor", "receipt_date", "items", "subtotal_amount", "total_amount", "gst_amount",
        F.lit("AUD").alias("currency"), "category",
    )


def training_records(
    receipts: DataFrame, key: str = "request_id", noise_level: float = 0.05, layout: bool = True,
    seed: int = 0,
) -> DataFrame:
    """``key, input, output, metadata``; ``receipts`` may carry ``complexity``."""
    complexity = F.col("complexity") if "complexity" in receipts.columns else F.lit(None)
    shaped = receipts.select(
        key,
        _rendered().alias("input"),
        _expected().alias("output"),
        F.struct(
            F.coalesce(complexity, F.lit("medium")).alias("complexity"),
            F.lit(noise_level).alias("noise_level"),
        ).alias("metadata"),
    )
    return augment_text(shaped, "input", key, noise_level, seed, layout=layout)


def evaluation_records(
    receipts: DataFrame, key: str = "request_id", noise_level: float = 0.05, layout: bool = True,
    seed: int = 0,
) -> DataFrame:
    """``key, receipt_text, expected_output, evaluation_criteria``."""
    criteria = (
        "vendor_accuracy", "date_parsing", "amount_accuracy", "item_extraction", "categorization",
    )
    return training_records(receipts, key, noise_level, layout, seed).select(
        key,
        F.col("input").alias("receipt_text"),
        F.col("output").alias("expected_output"),
        F.struct(*[F.lit(True).alias(c) for c in criteria]).alias("evaluation_criteria"),
    )


def dataset_records(
    receipts: DataFrame, key: str = "request_id", noise_level: float = 0.1, layout: bool = True,
    seed: int = 0, scenario: str = "synthetic",
) -> DataFrame:
    """Noisy and clean text, expected output and metadata.

    The clean text starts with one more ISO date line when there is a date.
    """
    dated = F.concat(F.lit("Date: "), blank_to_null(F.col("receipt_date")))
    complexity = F.col("complexity") if "complexity" in receipts.columns else F.lit(None)
    shaped = receipts.select(
        key,
        F.concat_ws("\n", dated, _rendered()).alias("clean_text"),
        _expected().alias("expected_output"),
        F.struct(
            F.lit(scenario).alias("scenario"),
            F.coalesce(complexity, F.lit("medium")).alias("complexity"),
            F.lit(noise_level).alias("noise_level"),
            F.lit(True).alias("has_gst"),
        ).alias("metadata"),
    ).withColumn("receipt_text", F.col("clean_text"))
    return augment_text(shaped, "receipt_text", key, noise_level, seed, layout=layout)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Bag union of record tables by column name."""
    first, *rest = sources
    for other in rest:
        first = first.unionByName(other)
    return first


def _metadata(df: DataFrame, field: str) -> Column:
    """Metadata field of a struct or of a JSON string, NULL when absent."""
    kind = dict(df.dtypes).get("metadata", "")
    if kind == "string":
        return F.get_json_object("metadata", f"$.{field}")
    if kind.startswith("struct") and field in df.schema["metadata"].dataType.names:
        return F.col(f"metadata.{field}")
    return F.lit(None).cast("string")


def prediction_payloads(dataset: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests that replay a dataset: clean text first, default currency, ids.

    A missing sample id is derived from the key, so a retried task gives the
    same id.
    """
    currency = F.coalesce(F.col("expected_output.currency"), F.lit("AUD"))
    sample = F.coalesce(
        blank_to_null(_metadata(dataset, "id")), derived_request_id(F.col(key))
    )
    return dataset.select(
        sample.alias("request_id"),
        F.coalesce(blank_to_null(F.col("clean_text")), F.col("receipt_text")).alias("receipt_text"),
        currency.alias("currency"),
        F.lit("synthetic_eval").alias("source"),
        F.struct(
            F.coalesce(_metadata(dataset, "scenario"), F.lit("synthetic")).alias("dataset_id"),
            sample.alias("sample_id"),
        ).alias("metadata"),
    )


def prediction_records(payloads: DataFrame, receipts: DataFrame) -> DataFrame:
    """Payloads with the receipt that answers them, for the evaluator."""
    answer = F.struct(
        *[F.col(c) for c in receipts.columns if c not in ("request_ts", "user_id")]
    ).alias("expected_output")
    return payloads.join(receipts.select("request_id", answer), "request_id").select(
        "request_id", "receipt_text", "expected_output", "metadata"
    )


def truth_records(dataset: DataFrame, key: str = "request_id") -> DataFrame:
    """Expected outputs flattened, with the id predictions are matched on."""
    given = F.col(key) if key == "request_id" else F.lit(None).cast("string")
    request_id = F.coalesce(
        blank_to_null(given.cast("string")), blank_to_null(_metadata(dataset, "id")),
        derived_request_id(F.col(key)),
    )
    return dataset.select("expected_output.*", request_id.alias("request_id"))

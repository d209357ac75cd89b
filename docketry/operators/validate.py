"""Warnings, validity and confidence of parsed receipts."""

from pyspark.sql import Column, DataFrame, functions as F

from docketry import fixed_values as fv
from docketry import schemas
from docketry.functions.amounts import MONEY
from docketry.functions.text import strip


def _warn(*checks: tuple[Column, object]) -> Column:
    """Texts of the checks that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(test, message) for test, message in checks]))


def _off_by_more_than_a_cent(a: Column, b: Column) -> Column:
    return F.abs(a - b) > F.lit("0.01").cast("decimal(3,2)")


def amount_warnings() -> Column:
    """Warnings about total and subtotal; a missing total hides the others."""
    total, subtotal, gst = F.col("total_amount"), F.col("subtotal_amount"), F.col("gst_amount")
    return F.when(total.isNull(), F.array(F.lit(fv.W_TOTAL))).otherwise(
        _warn(
            (total < 0, fv.W_TOTAL_NEGATIVE),
            (subtotal < 0, fv.W_SUBTOTAL_NEGATIVE),
            ((subtotal >= 0) & (subtotal > total), fv.W_SUBTOTAL_EXCEEDS),
            (_off_by_more_than_a_cent(subtotal + gst, total), fv.W_GST_MISMATCH),
        )
    )


def item_warnings(items: Column) -> Column:
    """Warnings per item with its 1-based position."""

    def check(item: Column, place: Column) -> Column:
        def about(tail: str, *extra: Column) -> Column:
            return F.concat(
                F.lit("Item "), (place + 1).cast("string"), F.lit(tail), *extra
            )

        quantity, unit, total = item["quantity"], item["unit_price"], item["total_price"]
        return _warn(
            (strip(item["name"]) == "", about(" has no name")),
            (quantity <= 0, about(" has invalid quantity: ", quantity.cast("string"))),
            (unit < 0, about(" has negative unit price")),
            (total < 0, about(" has negative total price")),
            (
                _off_by_more_than_a_cent(unit * quantity, total),
                about(" price calculation doesn't match"),
            ),
        )

    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.array(F.lit(fv.W_NO_ITEMS))).otherwise(
        F.flatten(F.transform(items, check))
    )


def with_warnings(receipts: DataFrame) -> DataFrame:
    """Add ``warnings`` (fixed order) and ``is_valid``."""

    def missing(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")) == ""

    confidence, gst = F.col("category_confidence"), F.col("gst_amount")
    warnings = F.concat(
        _warn(
            (missing("category"), fv.W_CATEGORY),
            ((confidence < 0) | (confidence > 1), fv.W_CONFIDENCE),
        ),
        amount_warnings(),
        item_warnings(F.col("items")),
        _warn(
            (gst.isNull(), fv.W_GST),
            (gst < 0, fv.W_GST_NEGATIVE),
            (missing("currency"), fv.W_CURRENCY),
        ),
    )
    critical = F.array(*[F.lit(w) for w in fv.CRITICAL_WARNINGS])
    return receipts.withColumn("warnings", warnings).withColumn(
        "is_valid", ~F.arrays_overlap(F.col("warnings"), critical)
    )


def with_confidence(receipts: DataFrame) -> DataFrame:
    """Add ``confidence_score``: the mean of six parts."""

    def part(present: Column, worth: float) -> Column:
        return F.when(present, worth).otherwise(0.0)

    n_items = F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0))
    score = (
        part(F.coalesce(F.col("vendor"), F.lit("")) != "", fv.CONFIDENCE_VENDOR)
        + part(F.coalesce(F.col("receipt_date"), F.lit("")) != "", fv.CONFIDENCE_DATE)
        + part(F.col("total_amount").isNotNull(), fv.CONFIDENCE_TOTAL)
        + part(F.col("gst_amount").isNotNull(), fv.CONFIDENCE_GST)
        + F.least(n_items * F.lit(fv.CONFIDENCE_PER_ITEM), F.lit(fv.CONFIDENCE_ITEMS_MAX))
        + F.col("category_confidence")
    ) / F.lit(fv.CONFIDENCE_PARTS)
    return receipts.withColumn("confidence_score", score)


def validate_and_score(receipts: DataFrame) -> DataFrame:
    """Warnings, validity and confidence; no shuffle."""
    return with_confidence(with_warnings(receipts))


def has_negative_amount() -> Column:
    """True where the response contract refuses the receipt."""
    return F.coalesce(
        F.least("subtotal_amount", "total_amount", "gst_amount") < 0, F.lit(False)
    )


def error_receipt(request_id: Column, message: Column) -> Column:
    """Receipt struct for a request that could not be parsed."""
    text, money = F.lit(None).cast("string"), F.lit(None).cast(MONEY)
    no_text = F.array().cast("array<string>")
    values = {
        "vendor": text,
        "receipt_date": text,
        "items": F.array().cast(schemas.ITEMS),
        "subtotal_amount": money,
        "total_amount": money,
        "gst_amount": money,
        "currency": F.lit("AUD"),
        "category": F.lit("Unclassified"),
        "categorization_source": F.lit("error"),
        "categorization_reason": F.lit("Parsing failed"),
        "matched_keywords": no_text,
        "confidence_score": F.lit(0.0),
        "cache_status": F.lit("error"),
        "request_id": request_id,
        "warnings": F.array(message),
    }
    return F.struct(*[values[c].alias(c) for c in schemas.RECEIPT_COLUMNS])

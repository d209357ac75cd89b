"""Model output, or pattern extraction where it is unusable -> typed receipts."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from docketry import schemas
from docketry.functions import amounts, dates, text
from docketry.functions.binding import blank_to_null, let
from docketry.functions.items import normalize_items

_ENVELOPE = (
    "content array<struct<text:string,content:string>>, "
    "output struct<message:struct<content:array<struct<text:string,output_text:string>>>>"
)
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_NUMERIC_KINDS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$"
_AMOUNTS = ("subtotal_amount", "total_amount", "gst_amount")


def envelope_text(body: Column) -> Column:
    """Model text inside either response envelope, NULL when there is none."""

    def either(part: Column, first: str, second: str) -> Column:
        return F.coalesce(blank_to_null(part[first]), part[second], F.lit(""))

    def read(envelope: Column) -> Column:
        older = F.try_element_at(envelope["content"], F.lit(1))
        newer = F.array_join(
            F.transform(
                envelope["output"]["message"]["content"], lambda p: either(p, "text", "output_text")
            ),
            "",
        )
        return F.coalesce(
            let(either(older, "text", "content"), blank_to_null), let(text.strip(newer), blank_to_null)
        )

    return let(F.from_json(body, _ENVELOPE), read)


def _typed(record: DataFrame) -> DataFrame:
    """Typed fields and ``model_ok`` from the variant column ``_json``.

    One field of the wrong type makes the whole record unusable, so types are
    read from the JSON itself; a typed parse would only blank that field.
    """
    whole = F.col("_json")

    def part(field):
        return F.try_variant_get(whole, f"$.{field}", "variant")

    def kind(field):
        return F.schema_of_variant(part(field))

    def string(field):
        return F.try_variant_get(whole, f"$.{field}", "string")

    def optional_text_ok(field):
        return F.coalesce(kind(field), F.lit("VOID")).isin("STRING", "VOID")

    def amount_ok(field):
        k = F.coalesce(kind(field), F.lit("VOID"))
        return (
            (k == "VOID")
            | F.rlike(k, F.lit(_NUMERIC_KINDS))
            | ((k == "STRING") & F.coalesce(F.rlike(string(field), F.lit(_NUMBER)), F.lit(False)))
        )

    elements = F.try_variant_get(whole, "$.items", "array<variant>")
    items_ok = kind("items").isNull() | (
        elements.isNotNull()
        & F.forall(elements, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    )
    currency_kind = kind("currency")
    ok = (
        optional_text_ok("vendor")
        & optional_text_ok("receipt_date")
        & (currency_kind.isNull() | (currency_kind == "STRING"))
        & amount_ok("subtotal_amount")
        & amount_ok("total_amount")
        & amount_ok("gst_amount")
        & F.coalesce(items_ok, F.lit(False))
    )

    def quantity(x: Column) -> Column:
        field = F.try_variant_get(x, "$.quantity", "variant")
        shown = F.try_variant_get(x, "$.quantity", "string")
        numeric = F.rlike(F.schema_of_variant(field), F.lit(_NUMERIC_KINDS))
        whole_part = F.try_variant_get(x, "$.quantity", "decimal(38,6)")
        truncated = F.when(whole_part < 0, F.ceil(whole_part)).otherwise(F.floor(whole_part))
        return F.when(numeric, truncated.cast("string")).otherwise(shown)

    def price(x: Column, field: str) -> Column:
        exact = F.try_variant_get(x, f"$.{field}", "decimal(38,10)")
        numeric = F.rlike(
            F.schema_of_variant(F.try_variant_get(x, f"$.{field}", "variant")),
            F.lit(_NUMERIC_KINDS),
        )
        return F.when(numeric, exact.cast("string")).otherwise(
            F.try_variant_get(x, f"$.{field}", "string")
        )

    raw_items = F.transform(
        F.coalesce(elements, F.array().cast("array<variant>")),
        lambda x: F.struct(
            F.try_variant_get(x, "$.name", "string").alias("name"),
            quantity(x).alias("quantity"),
            price(x, "unit_price").alias("unit_price"),
            price(x, "total_price").alias("total_price"),
        ),
    )
    def amounts_too_large(items: Column) -> Column:
        own = [amounts.too_large(F.trim(string(a))) for a in _AMOUNTS]
        priced = F.exists(
            items,
            lambda i: let(amounts.plain_amount(i["unit_price"]), amounts.too_large)
            | let(amounts.plain_amount(i["total_price"]), amounts.too_large),
        )
        return reduce(or_, own, F.coalesce(priced, F.lit(False)))

    is_record = F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")) & (
        F.schema_of_variant(whole) != "OBJECT<>"
    )
    return record.withColumn("model_ok", F.coalesce(is_record & ok, F.lit(False))).withColumns(
        {
            name: F.when(F.col("model_ok"), value)
            for name, value in {
                "vendor": string("vendor"),
                "receipt_date": string("receipt_date"),
                "items": raw_items.cast(schemas.RAW_ITEMS),
                **{a: F.trim(string(a)).try_cast(amounts.MONEY) for a in _AMOUNTS},
                "amount_too_large": amounts_too_large(raw_items),
                "currency": F.coalesce(string("currency"), F.lit("AUD")),
            }.items()
        }
    )


def decode_model_responses(responses: DataFrame) -> DataFrame:
    """``request_hash, body`` -> one row per hash with typed fields and ``model_ok``."""
    sliced = responses.withColumn(
        "_json", F.try_parse_json(F.regexp_extract(envelope_text(F.col("body")), r"(?s)(\{.*\})", 1))
    )
    return _typed(sliced).drop("_json", "body")


def normalize_model_fields(decoded: DataFrame) -> DataFrame:
    """Vendor, date and items of decoded rows in canonical form."""
    return decoded.withColumns(
        {
            "vendor": text.normalize_vendor(F.col("vendor")),
            "receipt_date": dates.normalize_date(F.col("receipt_date")),
            "items": F.when(F.col("model_ok"), normalize_items(F.col("items"))),
        }
    )


def extract_receipts(
    misses: DataFrame, decoded: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Receipt fields for rows with ``request_hash``, ``clean_text`` and ``currency``.

    Rows without usable model output take vendor, date and total from the
    text.  ``strict`` swaps the published fallback patterns, which misread
    common layouts, for bounded ones.  ``amount_too_large`` marks rows with an
    amount of more digits than money holds, which reads as NULL.
    """
    request_currency = F.coalesce(blank_to_null(F.col("currency")), F.lit("AUD"))
    base = misses.withColumn("_currency", request_currency).drop("currency")
    clean = F.col("clean_text")
    if decoded is None:
        none = {a: F.lit(None).cast(amounts.MONEY) for a in _AMOUNTS}
        joined = base.withColumns(
            {
                "_vendor": text.fallback_vendor(clean, word_boundary=strict),
                "_date": dates.fallback_date(clean),
                "items": F.array().cast(schemas.ITEMS),
                **none,
                "total_amount": amounts.fallback_total(clean, strict=strict),
                "amount_too_large": amounts.fallback_too_large(clean, strict=strict),
                "_model_currency": F.lit(None).cast("string"),
            }
        )
    else:
        model = normalize_model_fields(decoded).withColumnsRenamed(
            {"vendor": "_vendor", "receipt_date": "_date", "currency": "_model_currency"}
        )
        ok = F.coalesce(F.col("model_ok"), F.lit(False))
        joined = (
            base.join(model, "request_hash", "left")
            .withColumn("model_ok", ok)
            .withColumns(
                {
                    "_vendor": F.when(ok, F.col("_vendor")).otherwise(
                        text.fallback_vendor(clean, word_boundary=strict)
                    ),
                    "_date": F.when(ok, F.col("_date")).otherwise(dates.fallback_date(clean)),
                    "items": F.coalesce(F.col("items"), F.array().cast(schemas.ITEMS)),
                    "total_amount": F.when(ok, F.col("total_amount")).otherwise(
                        amounts.fallback_total(clean, strict=strict)
                    ),
                    "amount_too_large": F.when(ok, F.col("amount_too_large")).otherwise(
                        amounts.fallback_too_large(clean, strict=strict)
                    ),
                }
            )
            .drop("model_ok")
        )
    return (
        joined.withColumn(
            "subtotal_amount", amounts.fill_subtotal(F.col("subtotal_amount"), F.col("items"))
        )
        .withColumn("total_amount", F.coalesce("total_amount", "subtotal_amount"))
        .withColumns(
            {
                "vendor": text.normalize_vendor(F.col("_vendor")),
                "receipt_date": F.coalesce(F.col("_date"), dates.date_from_text(clean)),
                "gst_amount": amounts.compute_gst(F.col("total_amount"), F.col("gst_amount")),
                "currency": F.coalesce("_model_currency", "_currency"),
            }
        )
        .drop("_vendor", "_date", "_currency", "_model_currency")
    )

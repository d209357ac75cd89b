"""Prompt columns for a batch run of an external model."""

from pyspark.sql import Column, functions as F

from docketry import fixed_values as fv
from docketry.functions.items import item_names

_RULE_CATEGORIES = ", ".join([*fv.CATEGORY_KEYWORDS, "Unclassified"])


def extraction_prompt(receipt_text: Column, currency: Column) -> Column:
    """Ask for the structured receipt."""
    categories = F.lit(", ".join(fv.PROMPT_CATEGORIES))
    return F.format_string(
        fv.EXTRACTION_PROMPT, F.coalesce(currency, F.lit("AUD")), categories, receipt_text
    )


def dataset_prompt(receipt_text: Column) -> Column:
    """The shorter wording used for dataset records."""
    return F.format_string(fv.DATASET_PROMPT, receipt_text)


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def category_prompt(vendor: Column, items: Column, receipt_text: Column) -> Column:
    """Ask for a category; vendor ``Unknown`` when missing, one line per item."""
    lines = F.transform(item_names(items), lambda n: F.concat(F.lit("- "), _or_empty(n)))
    return F.format_string(
        fv.CATEGORY_PROMPT,
        F.lit(_RULE_CATEGORIES),
        F.when(_or_empty(vendor) == "", "Unknown").otherwise(vendor),
        F.array_join(_lines_or_none(lines), "\n"),
        receipt_text,
    )


def _lines_or_none(lines: Column) -> Column:
    return F.coalesce(lines, F.array().cast("array<string>"))


def dataset_category_prompt(receipt_text: Column, vendor: Column, items: Column) -> Column:
    """Ask for a category; vendor and item lines only when present."""
    names = F.array_join(F.transform(item_names(items), _or_empty), ", ")
    context = F.concat(
        F.when(_or_empty(vendor) != "", F.concat(F.lit("Vendor: "), vendor, F.lit("\n")))
        .otherwise(""),
        F.when(F.size(items) > 0, F.concat(F.lit("Items: "), names, F.lit("\n"))).otherwise(""),
    )
    return F.format_string(
        fv.DATASET_CATEGORY_PROMPT, F.lit(_RULE_CATEGORIES), context, receipt_text
    )

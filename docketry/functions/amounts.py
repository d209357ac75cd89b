"""Money expressions.  All amounts are DECIMAL(18,2), rounded half up."""

from pyspark.sql import Column, functions as F

from docketry import fixed_values as fv
from docketry.functions.binding import let
from docketry.functions.text import first_group

MONEY = "decimal(18,2)"


#: An amount that money has no room for: more than 16 digits before the point.
_TOO_LARGE = r"^[+-]?0*[1-9][0-9]{16,}(\.[0-9]*)?$"


def too_large(plain: Column) -> Column:
    """Whether a plain number, with a point as its only mark, has more digits than
    money holds; NULL and unreadable text are not too large."""
    written_out = F.coalesce(F.rlike(plain, F.lit(_TOO_LARGE)), F.lit(False))
    # With an exponent the size is read as a floating point number.
    powered = F.contains(F.lower(plain), F.lit("e")) & (F.abs(plain.try_cast("double")) >= F.lit(1e16))
    return written_out | F.coalesce(powered, F.lit(False))


def normalize_amount(text: Column) -> Column:
    """Amount text in US or European notation -> money, NULL when unreadable or
    :func:`too_large`; see :func:`plain_amount`."""
    return let(plain_amount(text), lambda plain: plain.try_cast(MONEY))


def plain_amount(text: Column) -> Column:
    """Amount text in US or European notation -> a plain number as text.

    With both separators present the last one is the decimal mark.  With
    commas only, the part after the first comma decides: up to two characters
    make it a decimal mark, more make it a thousands mark.
    """

    def parse(kept: Column) -> Column:
        has_comma = F.contains(kept, F.lit(","))
        has_dot = F.contains(kept, F.lit("."))
        last_mark = F.regexp_extract(kept, r"([.,])[^.,]*$", 1)
        after_comma = F.try_element_at(F.split(kept, ","), F.lit(2))
        comma_is_decimal = F.when(has_dot, last_mark == ",").otherwise(F.length(after_comma) <= 2)
        plain = (
            F.when(~has_comma, kept)
            .when(comma_is_decimal & has_dot, F.translate(kept, ",.", "."))
            .when(comma_is_decimal, F.translate(kept, ",", "."))
            .otherwise(F.translate(kept, ",", ""))
        )
        return plain

    return let(F.regexp_replace(text, r"[^\d.,\-]", ""), parse)


def to_money(number: Column) -> Column:
    """Numeric column -> money without a detour through text."""
    return F.round(number.try_cast("decimal(38,10)"), 2).try_cast(MONEY)


_LABELLED = r"\btotal\s*:?\s*\$?\s*([\d\.,]+)"


def fallback_total(text: Column, strict: bool = False) -> Column:
    """Total amount from the first total/amount/due pattern that matches.

    The published patterns read ``Subtotal:`` as a total and miss
    ``Total: $5.50``; ``strict=True`` reads the labelled total instead.
    """
    patterns = fv.TOTAL_PATTERNS
    if strict:
        patterns = (_LABELLED,) + patterns
    return normalize_amount(first_group(text, patterns, "(?iu)"))


def fallback_too_large(text: Column, strict: bool = False) -> Column:
    """Whether the amount that :func:`fallback_total` reads has too many digits."""
    patterns = fv.TOTAL_PATTERNS
    if strict:
        patterns = (_LABELLED,) + patterns
    # No pattern is tried where no run of digits and marks is long enough.
    long_run = F.rlike(text, F.lit(r"[0-9.,]{17}"))
    return F.when(long_run, let(plain_amount(first_group(text, patterns, "(?iu)")), too_large)).otherwise(False)


def compute_gst(total: Column, gst: Column) -> Column:
    """Given GST, else 1/11 of the GST-inclusive total, else zero."""
    eleventh = F.round(total * F.lit(10).cast("decimal(2,0)") / F.lit(110).cast("decimal(3,0)"), 2)
    return F.coalesce(gst, eleventh.cast(MONEY), F.lit(0).cast(MONEY))


def gst_exclusive_totals(subtotal: Column) -> tuple[Column, Column]:
    """(gst, total) when 10 % is added on top of a GST-exclusive subtotal."""
    gst = F.round(subtotal * F.lit("0.1").cast("decimal(2,1)"), 2).cast(MONEY)
    return gst, (subtotal + gst).cast(MONEY)


def items_total(items: Column, field: str = "total_price") -> Column:
    """Sum of one price of the items; a missing price counts as zero."""
    zero = F.lit(0).cast(MONEY)
    return F.aggregate(
        items, zero, lambda acc, item: (acc + F.coalesce(item[field], zero)).cast(MONEY)
    )


def fill_subtotal(subtotal: Column, items: Column) -> Column:
    """Given subtotal, else the item total when there are items."""
    return F.coalesce(subtotal, F.when(F.size(items) > 0, items_total(items)))

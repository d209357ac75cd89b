"""Line-item expressions over ``array<struct>``; nothing is exploded."""

from pyspark.sql import Column, functions as F

from docketry import schemas
from docketry.functions.amounts import MONEY, normalize_amount
from docketry.functions.binding import let
from docketry.functions.text import strip


def _quantity(raw: Column) -> Column:
    """Missing, empty or zero -> 1; below one -> 1; not an integer -> NULL."""
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", 1)
        .when(F.rlike(raw, F.lit(r"^\s*[+-]?\d+\s*$")), F.greatest(F.lit(1), raw.try_cast("int")))
        .cast("int")
    )


def _unit_price(total: Column, quantity: Column) -> Column:
    # half-up division in whole cents: exact for any quantity
    cents = (total * 100).cast("decimal(20,0)")
    twice = quantity.cast("decimal(10,0)") * 2
    halves = F.floor((cents * 2 + quantity) / twice)
    return (halves.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast(MONEY)


def _normalize_item(raw: Column) -> Column:
    def fill(read: Column) -> Column:
        unit, total, quantity = read["unit_price"], read["total_price"], read["quantity"]
        return F.struct(
            read["name"].alias("name"),
            quantity.alias("quantity"),
            F.when(unit.isNull() & total.isNotNull(), _unit_price(total, quantity))
            .otherwise(unit)
            .alias("unit_price"),
            F.when(total.isNull() & unit.isNotNull(), (unit * quantity).cast(MONEY))
            .otherwise(total)
            .alias("total_price"),
        )

    read = F.struct(
        strip(F.coalesce(raw["name"], F.lit(""))).alias("name"),
        _quantity(raw["quantity"]).alias("quantity"),
        normalize_amount(raw["unit_price"].cast("string")).alias("unit_price"),
        normalize_amount(raw["total_price"].cast("string")).alias("total_price"),
    )
    return let(read, fill)


def normalize_items(raw_items: Column) -> Column:
    """Typed items in their given order.

    Dropped: blank names, quantities that are no integer, negative prices.  A
    missing price is filled from the other one and the quantity.
    """

    def keep(item: Column) -> Column:
        return (
            (item["name"] != "")
            & item["quantity"].isNotNull()
            & (F.coalesce(item["unit_price"], F.lit(0)) >= 0)
            & (F.coalesce(item["total_price"], F.lit(0)) >= 0)
        )

    typed = F.filter(F.transform(raw_items, _normalize_item), keep)
    return F.coalesce(typed, F.array()).cast(schemas.ITEMS)


def item_names(items: Column) -> Column:
    """Names of the items as an array."""
    return F.transform(items, lambda item: item["name"])

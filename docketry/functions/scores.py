"""Field scores in 0..1 between a predicted and an expected value."""

from decimal import Decimal
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docketry.functions.binding import let, settled
from docketry.functions.text import strip

_EXACT = "decimal(38,18)"
_BANDS = (
    (Decimal(0), 1.0), (Decimal("0.01"), 0.9), (Decimal("0.10"), 0.5), (Decimal("1.00"), 0.1),
)


# --- amounts -------------------------------------------------------------------

def amount_score(predicted: Column, expected: Column) -> Column:
    """1 equal, 0.9 within a cent, 0.5 within ten, 0.1 within a dollar, else 0.

    Inputs are numbers or strings and are compared unrounded.
    """
    p, e = predicted.try_cast(_EXACT), expected.try_cast(_EXACT)
    off = F.abs(p - e)
    return (
        F.when(predicted.isNull() & expected.isNull(), 1.0)
        .when(p.isNull() | e.isNull(), 0.0)
        .otherwise(
            F.coalesce(
                *[F.when(off <= F.lit(str(w)).cast(_EXACT), score) for w, score in _BANDS],
                F.lit(0.0),
            )
        )
    )


def currency_score(predicted: Column, expected: Column) -> Column:
    """Case-free equality; a missing code equals an empty one."""
    def code(c):
        return F.upper(F.coalesce(c, F.lit("")))
    return F.when(code(predicted) == code(expected), 1.0).otherwise(0.0)


# --- text ------------------------------------------------------------------------

#: The matcher treats characters as junk only in expected texts of this length and more.
JUNK_LENGTH = 200

#: Rows of a batch that are Python objects at once.
ROWS = 500


def _asked(left: pa.Array, right: pa.Array, compare) -> pa.Array:
    """``compare(left, right)`` for the rows where both are given, else NULL.

    The rows become Python objects some at a time, and only those to compare."""
    given = pc.and_(left.is_valid(), right.is_valid())
    at = pc.indices_nonzero(given)
    found = [
        compare(x, y)
        for begin in range(0, len(at), ROWS)
        for x, y in zip(
            left.take(at[begin : begin + ROWS]).to_pylist(),
            right.take(at[begin : begin + ROWS]).to_pylist(),
            strict=True,
        )
    ]
    return pc.replace_with_mask(pa.nulls(len(left), pa.float64()), given, pa.array(found, pa.float64()))


# The two functions take one batch, not an iterator of batches: functions of that
# kind share one Python worker for each task, the others would take one each.

@F.arrow_udf(T.DoubleType())
def _matching_ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio; each distinct pair of a batch is compared once.

    NULL inputs mark pairs the plan has already scored and come back as NULL.
    """
    ratios: dict = {}

    def ratio(*pair: str) -> float:
        if pair not in ratios:
            ratios[pair] = SequenceMatcher(None, *pair).ratio()
        return ratios[pair]

    return _asked(left, right, ratio)


def text_score(predicted: Column, expected: Column) -> Column:
    """Similarity of two short strings, ignoring case and outer white space.

    Equal and missing values are scored by the plan, and so are two kinds of
    differing pairs whose ratio is known: one text inside the other, which is
    then the longest match and the only one, and texts without a common
    character.  Only the other pairs carry text to Python.
    """
    none = F.lit("")
    p, e = F.coalesce(predicted, none), F.coalesce(expected, none)
    low_p, low_e = strip(F.lower(p)), strip(F.lower(e))
    in_plan = _known_ratio(low_p, low_e)
    ask = (p != "") & (e != "") & (low_p != low_e) & in_plan.isNull()
    ratio = _matching_ratio(F.when(ask, low_p), F.when(ask, low_e))
    return (
        F.when((p == "") & (e == ""), 1.0)
        .when((p == "") | (e == ""), 0.0)
        .when(low_p == low_e, 1.0)
        .otherwise(F.coalesce(in_plan, ratio))
    )


def _known_ratio(p: Column, e: Column) -> Column:
    """The matching ratio where it needs no comparison of blocks, else NULL.

    The matcher leaves frequent characters of texts of ``JUNK_LENGTH`` and more
    out of account, so the long ones are not decided here."""
    n_p, n_e = F.length(p), F.length(e)
    inside = F.contains(p, e) | F.contains(e, p)
    short = n_e < JUNK_LENGTH
    return (
        F.when(short & inside, F.lit(2.0) * F.least(n_p, n_e) / F.greatest(n_p + n_e, F.lit(1)))
        .when(F.call_function("translate", p, e, F.lit("")) == p, 0.0)
    )


# --- item lists --------------------------------------------------------------------

#: What the score of two item lists reads of an item.
ITEM_PARTS = ("name", "total_price")


def _best_match(item, candidates, known) -> float:
    """Best (name + price) / 2 over the candidates.

    The cheap upper bounds of the matcher skip candidates that cannot win, so
    the result equals the full comparison.  ``known`` keeps ratios of names
    already compared in this batch.
    """
    name, empty, *price = item
    best = 0.0
    for other, other_empty, *other_price in candidates:
        price_part = _price_part(price, other_price)
        if (1.0 + price_part) / 2 <= best:
            continue
        if empty or other_empty:
            name_part = 1.0 if empty and other_empty else 0.0
        elif name == other:
            name_part = 1.0
        elif (name, other) in known:
            name_part = known[name, other]
        else:
            matcher = SequenceMatcher(None, name, other)
            if (matcher.real_quick_ratio() + price_part) / 2 <= best:
                continue
            name_part = known[name, other] = matcher.ratio()
        best = max(best, (name_part + price_part) / 2)
        if best == 1.0:
            break
    return best


def _price_part(price, other) -> float:
    (present, value), (other_present, other_value) = price, other
    if not present and not other_present:
        return 1.0
    if value is None or other_value is None:
        return 0.0
    off = abs(value - other_value)
    return next((score for width, score in _BANDS if off <= width), 0.0)


@F.arrow_udf(T.DoubleType())
def _best_match_total(predicted: pa.Array, expected: pa.Array) -> pa.Array:
    """Sum of the best matches of the predicted items of each row."""
    known: dict = {}

    def listed(items):
        return [(i["name"], i["empty"], i["priced"], i["price"]) for i in items]

    def total(p, e) -> float:
        among = dict.fromkeys(listed(e))
        return sum(_best_match(item, among, known) for item in listed(p))

    return _asked(predicted, expected, total)


def with_items_score(rows: DataFrame, predicted: str, expected: str, name: str) -> DataFrame:
    """Add the score of two item lists as column ``name``.

    Every predicted item takes its best expected item, in any order; two may
    take the same one.  Lists stay inside their row: no pair of items is ever
    emitted.  Items that occur unchanged among the expected ones are scored by
    the plan; only the others go to Python, as settled columns, since a Python
    function over lambda expressions is not reliably planned.
    """

    def comparable(items: Column) -> Column:
        return F.transform(
            items,
            lambda i: F.struct(
                strip(F.lower(F.coalesce(i["name"], F.lit("")))).alias("name"),
                (F.coalesce(i["name"], F.lit("")) == "").alias("empty"),
                i["total_price"].isNotNull().alias("priced"),
                i["total_price"].try_cast(_EXACT).alias("price"),
            ),
        )

    def unchanged(item: Column, among: Column) -> Column:
        readable = item["total_price"].isNull() | item["total_price"].try_cast(_EXACT).isNotNull()
        return readable & F.exists(
            among,
            lambda other: other["name"].eqNullSafe(item["name"])
            & other["total_price"].eqNullSafe(item["total_price"]),
        )

    def split(rest: Column) -> Column:
        # amounts are read and names prepared only for lists that need comparing
        ask = F.size(rest) > 0
        return F.struct(
            F.when(ask, comparable(rest)).alias("rest"),
            F.when(ask, comparable(e)).alias("among"),
            (F.size(p) - F.size(rest)).alias("exact"),
            F.greatest(F.size(p), F.size(e)).alias("longest"),
        )

    p, e = F.col(predicted), F.col(expected)
    none_p = F.coalesce(F.size(p), F.lit(0)) <= 0
    none_e = F.coalesce(F.size(e), F.lit(0)) <= 0
    rest = F.filter(p, lambda item: ~unchanged(item, e))
    staged = rows.select(
        "*", settled(F.when(~none_p & ~none_e, let(rest, split))).alias("_sides")
    )
    fuzzy = _best_match_total(F.col("_sides.rest"), F.col("_sides.among"))
    found = F.col("_sides.exact") + F.coalesce(fuzzy, F.lit(0.0))
    score = (
        F.when(none_p & none_e, 1.0)
        .when(none_p | none_e, 0.0)
        .otherwise(found / F.col("_sides.longest"))
    )
    return staged.withColumn(name, score).drop("_sides")

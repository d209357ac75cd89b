"""Literal rows per expression."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions import amounts, dates, items, prompts, text


def outputs(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    rows = df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def check(spark, expression, pairs, kind="string"):
    assert outputs(spark, [p[0] for p in pairs], expression, kind) == [p[1] for p in pairs]


def test_clean_text(spark):
    check(spark, text.clean_text, [
        ("  Hello   World!  ", "Hello World!"),
        ("Total: $10.50\nGST: $1.05", "Total: $10.50 GST: $1.05"),
        ("a |b__c_d", "a  b c_d"),
        ("x \x1c y", "x y"),
        ("", ""), (None, ""),
    ])


def test_normalize_text(spark):
    check(spark, text.normalize_text, [
        ("  Hello   WORLD!  ", "hello world"), ("Café-Bar $4.50, x_y", "cafébar $4.50, x_y"), (None, ""),
    ])


def test_currency_symbols(spark):
    check(spark, text.extract_currency, [
        ("$45.67", "AUD"), ("€45.67", "EUR"), ("£1", "GBP"), ("¥1", "JPY"), ("45.67", None),
        ("€1 $1", "AUD"),
    ])


def test_hash_is_sha256(spark):
    import hashlib

    check(spark, text.text_hash, [("héllo", hashlib.sha256("héllo".encode()).hexdigest())])


def test_vendor(spark):
    check(spark, text.normalize_vendor, [
        ("7eleven", "7Eleven"), ("McDonald's", "Mcdonalds"), ("café X", "Café X"), ("!!!", None),
        ("", None), (None, None), ("o_b", "O_B"),
    ])


def test_fallback_vendor(spark):
    check(spark, text.fallback_vendor, [
        ("Flat White shop", "White shop"), ("from Aldi. x", "Aldi"), ("ALDI STORE\nx", "ALDI STORE"),
        ("9 The Shop Receipt", "The Shop"), ("99", None),
    ])
    assert outputs(spark, ["Flat White shop"], lambda c: text.fallback_vendor(c, True)) == [None]


def test_dates(spark):
    check(spark, dates.normalize_date, [
        ("2026-04-10 09:12", "2026-04-10"), ("Date: 10/04/2026", "2026-04-10"),
        ("04/13/2026", "2026-04-13"), ("10 apr 2026", "2026-04-10"),
        ("April 10, 2026", "2026-04-10"), ("2026.4.1", "2026-04-01"), ("10/04/26", None),
        ("31/02/2024", None), ("10 Sept 2024", None), ("29/02/2024", "2024-02-29"),
        ("Date: 2026-04-10 Register 02", "2026-04-10"), ("2024-04- 5", "2024-04-05"),
        ("", None), (None, None), ("0000-01-01", None),
    ])


def test_date_from_text(spark):
    check(spark, dates.date_from_text, [
        ("paid 3/4/2024 ok", "2024-04-03"), ("x 2024-03-05 y", "2024-03-05"),
        ("5 MAY 2024", "2024-05-05"), ("45/45/2024 then 2024-01-02", "2024-01-02"), ("none", None),
    ])


def test_fallback_date_first_match_decides(spark):
    check(spark, dates.fallback_date, [("31/02/2024 2024-01-02", None), ("2024-1-2", "2024-01-02")])


def test_amounts(spark):
    check(spark, amounts.normalize_amount, [
        ("$1,234.56", D("1234.56")), ("1.234,56", D("1234.56")), ("1,234", D("1234.00")),
        ("1,23", D("1.23")), ("1,234,567", D("1234567.00")), ("1,23,456", None),
        ("(5.00)", D("5.00")), ("5-", None), ("1e5", D("15.00")), ("2.675", D("2.68")),
        ("-2.675", D("-2.68")), ("", None), (None, None), ("1,5", D("1.50")), ("1.2.3", None),
    ])


def test_numbers_do_not_pass_through_text(spark):
    check(spark, amounts.to_money, [(1e10, D("10000000000.00")), (2.675, D("2.68"))], "double")


def test_fallback_total(spark):
    cases = [("Total: 10.20", "10.20"), ("Subtotal: 10.20", "10.20"), ("amount $ 3", "3.00"),
             ("GST: $1.00 Total: $11.00", "1.00"), ("none", None)]
    check(spark, amounts.fallback_total, [(a, b and D(b)) for a, b in cases])
    assert outputs(
        spark, ["Subtotal: $10.00 GST: $1.00 Total: $11.00"],
        lambda c: amounts.fallback_total(c, strict=True),
    ) == [D("11.00")]


@pytest.mark.parametrize("total, gst, expected", [
    ("11.00", None, "1.00"), ("11.00", "0.50", "0.50"), (None, None, "0.00"), ("0.05", None, "0.00"),
    ("0.06", None, "0.01"), ("99.99", None, "9.09"),
])
def test_gst(spark, total, gst, expected):
    df = spark.createDataFrame(
        [(total and D(total), gst and D(gst))], "t decimal(18,2), g decimal(18,2)"
    )
    got = df.select(amounts.compute_gst(F.col("t"), F.col("g")).alias("o")).first().o
    assert got == D(expected)


def test_items(spark):
    raw = [
        ("a", "0", None, "10"), ("b", "-2", "1", None), ("c", "x", "1", "1"), ("d", None, None, "9.99"),
        ("e", "3", None, "10.00"), (" f ", "2", "1.5", None), ("g", "1", "-1", None), ("  ", "1", "1", "1"),
        ("h", "1", None, None), (None, "1", "1", "1"),
    ]
    df = spark.createDataFrame([(raw,), (None,)], f"v {schemas.RAW_ITEMS}")
    full, none = [r.o for r in df.select(items.normalize_items(F.col("v")).alias("o")).collect()]
    assert [tuple(i) for i in full] == [
        ("a", 1, D("10.00"), D("10.00")), ("b", 1, D("1.00"), D("1.00")),
        ("d", 1, D("9.99"), D("9.99")), ("e", 3, D("3.33"), D("10.00")),
        ("f", 2, D("1.50"), D("3.00")), ("h", 1, None, None),
    ]
    assert none == []


def test_unit_price_of_huge_quantity(spark):
    raw = [("a", "2000000", None, "10000.00"), ("b", "2000000", None, "9999.99")]
    df = spark.createDataFrame([(raw,)], f"v {schemas.RAW_ITEMS}")
    got = df.select(items.normalize_items(F.col("v")).alias("o")).first().o
    assert [i.unit_price for i in got] == [D("0.01"), D("0.00")]


def test_ids(spark):
    df = spark.range(3).select(
        text.derived_request_id(F.col("id")).alias("a"), text.derived_request_id(F.col("id")).alias("b"),
        text.random_request_id().alias("c"),
    )
    rows = df.collect()
    assert all(r.a == r.b and len(r.a) == len(r.c) == 36 for r in rows)
    assert len({r.a for r in rows}) == 3


def test_category_prompt_lines(spark):
    got = spark.range(1).select(
        prompts.dataset_category_prompt(F.lit("TEXT"), F.lit(None).cast("string"),
                                        F.lit(None).cast(schemas.ITEMS)).alias("p"),
        prompts.extraction_prompt(F.lit("100% TEXT"), F.lit("NZD")).alias("q"),
    ).first()
    assert "Vendor:" not in got.p and got.p.endswith("brief reason.\n")
    assert '"currency": "NZD"' in got.q and "100% TEXT" in got.q

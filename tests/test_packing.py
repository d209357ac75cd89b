"""Samples move packed, without what no score reads, and receipts are built once for both runs."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Row, functions as F

from docketry.functions import packing
from docketry.operators import evaluate, regress
from docketry.plans import queries_eval, regression

ITEMS = "array<struct<name:string,quantity:string,unit_price:string,total_price:string>>"
ODD = ['a "b" \\ c', "", None, "x\n\ty\x01\x00", "é 語 😀", "null", "[1]", " "]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _nested(spark):
    rows = [
        (str(n), {"vendor": text, "category": ODD[n - 1], "items": [
            None, [], [None], [(text, "1", None, "2.50"), None], [("Tea", None, "1", text)] * 3,
        ][n % 5]})
        for n, text in enumerate(ODD)
    ]
    return spark.createDataFrame(rows, f"request_id string, expected_output struct<vendor:string,category:string,items:{ITEMS}>")


def test_texts_come_back_as_they_were(spark):
    rows = _nested(spark)
    kind = rows.schema["expected_output"].dataType
    stored = packing.packed(rows, "expected_output")
    assert [f.dataType.simpleString() for f in stored.schema["expected_output"].dataType] == ["string", "string"]
    back = packing.unpacked(stored, "expected_output", kind)
    assert dict(back.dtypes) == dict(rows.dtypes) and back.columns == rows.columns
    assert back.orderBy("request_id").collect() == rows.orderBy("request_id").collect()
    none = rows.withColumn("expected_output", F.when(F.col("request_id") > "3", F.col("expected_output")))
    back = packing.unpacked(packing.packed(none, "expected_output"), "expected_output", kind)
    assert back.orderBy("request_id").collect() == none.orderBy("request_id").collect()


def test_other_types_are_left_alone(spark):
    rows = spark.createDataFrame(
        [("1", Decimal("2.50"), dt.date(2024, 1, 5), [Row(name="Tea", quantity=2, unit_price=1.25, total_price=2.5)])],
        "request_id string, total_amount decimal(18,2), receipt_date date, "
        "items array<struct<name:string,quantity:int,unit_price:double,total_price:double>>",
    )
    got = evaluate.pair_samples(rows, rows).first()
    assert got.paired and got.predicted == got.expected
    assert (got.predicted.total_amount, got.predicted.receipt_date) == (Decimal("2.50"), dt.date(2024, 1, 5))
    assert got.predicted["items"] == [Row(name="Tea", quantity=2, unit_price=1.25, total_price=2.5)]


def test_pairs_are_moved_packed_and_come_out_whole(spark):
    left = _nested(spark)
    right = left.filter("request_id != '4'").unionByName(left.filter("request_id = '5'"))
    paired = evaluate.pair_samples(left, right)
    # below each shuffle the record is already text
    below = _plan(paired).split("Exchange hashpartitioning")[1:]
    assert len(below) == 2 and all("StructsToJson" in part or "to_json" in part for part in below)
    got = {r.request_id: r for r in paired.collect()}
    want = {r.request_id: r.expected_output for r in left.collect()}
    assert {k for k, r in got.items() if not r.paired} == {"4", "5"}
    assert got["4"].expected is None
    for key, output in want.items():
        assert got[key].predicted["items"] == output["items"]
        assert (got[key].predicted.vendor, got[key].predicted.category) == (output.vendor, output.category)
        assert got[key].predicted.currency is None


def test_tests_move_only_what_scores_read(spark, monkeypatch):
    rows = _nested(spark).withColumn("test_name", F.lit("a"))
    seen = []
    monkeypatch.setattr(regress, "pair_samples", lambda p, t, keys: seen.extend((p, t)) or evaluate.pair_samples(p, t, keys))
    results, errors = regress.evaluate_tests(rows, rows, 1)
    assert {r.score for r in results.filter("field = 'vendor'").collect()} == {1.0} and errors.count() == 0
    assert seen[0].columns == ["test_name", "request_id", "expected_output"]
    kinds = [side.schema["expected_output"].dataType["items"].dataType.elementType.names for side in seen]
    assert kinds == [["name", "total_price"]] * 2


@pytest.mark.parametrize("wrong", ["name", "total_price"])
def test_scores_are_those_of_whole_samples(spark, wrong):
    truth = _nested(spark).withColumn("test_name", F.lit("a"))
    changed = F.transform("expected_output.items", lambda i: i.withField(wrong, F.concat(i[wrong], F.lit("1"))))
    guess = truth.withColumn("expected_output", F.col("expected_output").withField("items", changed))
    keys = ("test_name", "request_id")
    whole = evaluate.with_scores(evaluate.pair_samples(guess, truth, keys))
    means = {r.field: r.score for r in evaluate.field_report(whole).collect()}
    got = {r.field: r.score for r in regress.evaluate_tests(guess, truth, 1)[0].collect()}
    assert means["items"] < 1.0 and {f: got[f] for f in means} == means


def test_both_runs_read_the_stored_receipts(spark, tmp_path, monkeypatch):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    spark.createDataFrame(
        [(k, k % 3, dt.date(2024, 1, 1 + k), names[k % 5], 10.0) for k in range(25)],
        "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_totalprice double",
    ).write.parquet(f"{tmp_path}/sf/orders.parquet")
    spark.createDataFrame(
        [(k, n, 1, 1, 2.0, 5.5, 0.1, dt.date(2024, 2, 1)) for k in range(20) for n in range(3)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
        "l_extendedprice double, l_discount double, l_shipdate date",
    ).write.parquet(f"{tmp_path}/sf/lineitem.parquet")
    spark.createDataFrame([(1, "Tea")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/sf/part.parquet")
    read, run = [], regression.run_tests

    def recorded(predictions, truth, folder, run_ts):
        read.append([*predictions.inputFiles(), *truth.inputFiles()])
        return run(predictions, truth, folder, run_ts)

    monkeypatch.setattr(regression, "run_tests", recorded)
    rows = {r.test_name: r for r in queries_eval.regression_flow(spark, f"{tmp_path}/sf").collect()}
    assert len(read) == 2 and all(read)
    assert not any("lineitem" in name or "orders" in name for names in read for name in names)
    assert sorted(rows) == names and rows["2-HIGH"].has_regression
    assert {n: r.baseline_run for n, r in rows.items()} == dict(zip(names, (1, 1, 2, 1, 2), strict=True))

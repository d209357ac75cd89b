"""Numbered records: bounded exports, pairing in blocks, receipts built once."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import Window, functions as F

from docketry.operators import evaluate, numbered
from docketry.plans import queries_eval
from docketry.plans.evaluation import evaluate_files
from docketry.sources import positions
from docketry.sources.positions import read_numbered, write_ordered


def _samples(spark, n):
    """Records with lists, missing fields and texts beyond ASCII, in no order."""
    item = "named_struct('name', concat('Tea é ', id), 'quantity', '1', 'unit_price', '2.5', 'total_price', '2.5')"
    return spark.range(n).selectExpr(
        "id * 37 % 3001 as at", "concat('text ', id, '\\n\"x\"') as receipt_text",
        "if(id % 3 = 0, null, concat('v', id)) as vendor", "cast(id / 7 as string) as total_amount",
        f"if(id % 5 = 0, null, array_repeat({item}, int(id % 4))) as items",
    )


def test_ordered_export_is_compressed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positions, "PART_RECORDS", 100)
    rows = _samples(spark, 3001)
    write_ordered(rows, f"{tmp_path}/out.jsonl", "at", files=7)
    parts = sorted((tmp_path / "out.jsonl").glob("part-*.gz"))
    held = [sum(1 for _ in gzip.open(part)) for part in parts]
    assert sum(held) == 3001 and max(held) <= 200 and len(parts) >= 30
    got = read_numbered(spark, f"{tmp_path}/out.jsonl").orderBy("position")
    columns = ("receipt_text", "vendor", "total_amount", "items")
    assert got.select(*columns).collect() == rows.orderBy("at").select(*columns).collect()


def test_equal_keys_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positions, "PART_RECORDS", 100)
    rows = spark.range(1000).selectExpr("1 as at", "cast(id as string) as vendor")
    write_ordered(rows, f"{tmp_path}/same.jsonl", "at", files=3)
    got = read_numbered(spark, f"{tmp_path}/same.jsonl").collect()
    assert len(list((tmp_path / "same.jsonl").glob("part-*.gz"))) >= 5
    assert sorted(r.position for r in got) == list(range(1000))
    assert sorted(int(r.vendor) for r in got) == list(range(1000))


def test_offsets_never_move_the_records(spark, tmp_path):
    """However large the records are estimated, the offsets are sent to them."""
    write_ordered(_samples(spark, 50), f"{tmp_path}/out.jsonl", "at", files=3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = read_numbered(spark, f"{tmp_path}/out.jsonl")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = [line for line in plan.splitlines() if "Join [_file" in line]
    assert "BroadcastHashJoin" in joins[0]


@pytest.mark.parametrize("block", [7, 4096])
def test_blocks_pair_as_the_join_does(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(numbered, "BLOCK", block)
    rows = _samples(spark, 500)
    write_ordered(rows, f"{tmp_path}/p.jsonl", "at", files=7)
    write_ordered(rows.withColumn("vendor", F.upper("vendor")), f"{tmp_path}/t.jsonl", "at", files=3)
    sides = [read_numbered(spark, f"{tmp_path}/{name}.jsonl") for name in "pt"]
    got = evaluate.score_numbered(*sides, "position")
    want = evaluate.score_samples(*sides, ("position",))
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert got.orderBy("position").collect() == want.orderBy("position").collect()
    # The records themselves are not shuffled, only their blocks.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(position" not in plan and "SortMergeJoin" not in plan


def test_records_in_another_order(spark):
    rows = _samples(spark, 300).select("vendor", (F.col("at") * 0 + F.xxhash64("at")).alias("_by"), F.row_number().over(
        Window.orderBy("at")).cast("long").alias("n"),
    ).withColumn("n", F.col("n") - 1)
    left = rows.orderBy("_by").select("n", "vendor")
    right = rows.orderBy("vendor").select("n", F.col("vendor").alias("other"))
    got = numbered.pair_numbered(left, right, "n").collect()
    assert len(got) == 300 and all(r.vendor == r.other for r in got)


@pytest.mark.parametrize("sizes", [(0, 3), (3, 0), (5, 4), (9, 20)])
def test_unequal_numbers_fail(spark, tmp_path, monkeypatch, sizes):
    monkeypatch.setattr(numbered, "BLOCK", 4)
    for name, n in zip("pt", sizes, strict=True):
        (tmp_path / f"{name}.jsonl").write_text('{"vendor": "a"}\n' * n)
    with pytest.raises(Exception, match="same number of samples"):
        evaluate_files(spark, f"{tmp_path}/p.jsonl", f"{tmp_path}/t.jsonl", f"{tmp_path}/r", keys=("position",))


def test_receipts_are_built_once(spark, tmp_path, monkeypatch):
    """Neither export goes back to the lines of the orders."""
    spark.createDataFrame(
        [(k, k % 3, dt.date(2024, 1, 1 + k), "1-URGENT", 10.0) for k in range(20)],
        "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_totalprice double",
    ).write.parquet(f"{tmp_path}/sf/orders.parquet")
    spark.createDataFrame(
        [(k, n, 1, 1, 2.0, 5.5, 0.1, dt.date(2024, 2, 1)) for k in range(15) for n in range(3)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
        "l_extendedprice double, l_discount double, l_shipdate date",
    ).write.parquet(f"{tmp_path}/sf/lineitem.parquet")
    spark.createDataFrame([(1, "Tea")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/sf/part.parquet")
    read = []

    def ordered(records, *args, **options):
        read.extend(records.inputFiles())
        write_ordered(records, *args, **options)

    monkeypatch.setattr(queries_eval, "write_ordered", ordered)
    scores = queries_eval.scores_by_position(spark, f"{tmp_path}/sf")
    assert scores.count() == 20
    assert read and not any("lineitem" in name or "orders" in name for name in read)

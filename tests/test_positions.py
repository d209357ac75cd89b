"""Records without ids: their place as a key."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.operators import evaluate
from docketry.plans.evaluation import evaluate_files
from docketry.sources.positions import read_numbered, write_ordered

TRUTH = {"receipt_text": "STARBUCKS\nTotal: $5.50",
         "expected_output": {"vendor": "STARBUCKS", "total_amount": 5.50, "category": "Food"}}


def _lines(path, records):
    path.write_text("".join((json.dumps(r) if r is not None else "") + "\n" for r in records))
    return str(path)


def test_one_record_without_id(spark, tmp_path):
    truth = _lines(tmp_path / "truth.jsonl", [TRUTH])
    predicted = _lines(tmp_path / "predicted.jsonl", [{"expected_output": TRUTH["expected_output"]}])
    parts = evaluate_files(spark, predicted, truth, str(tmp_path / "report"), keys=("position",))
    row = parts.overall.first()
    assert (row.total_samples, row.overall_score) == (1, 1.0)
    assert spark.read.parquet(f"{tmp_path}/report/overall").first().total_samples == 1


def test_one_file_in_many_splits(spark, tmp_path):
    """A file cut anywhere, blank lines in it, numbers its records as they stand."""
    records = [{"vendor": f"v{n}", "category": "x" * (n % 50)} if n % 10 else None for n in range(3000)]
    path = _lines(tmp_path / "all.jsonl", records)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000b")
    try:
        rows = read_numbered(spark, path)
        splits = spark.read.json(path).select("_metadata.file_block_start").distinct().count()
        got = {r.position: r.vendor for r in rows.select("position", "vendor").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits >= 4
    assert got == dict(enumerate(r["vendor"] for r in records if r))


def test_order_of_an_export(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 37 % 5000).alias("at"), F.col("id").cast("string").alias("vendor"))
    write_ordered(rows, f"{tmp_path}/out.jsonl", "at", files=9)
    got = read_numbered(spark, f"{tmp_path}/out.jsonl").select("position", "vendor").collect()
    assert {r.position: r.vendor for r in got} == {r["at"]: r.vendor for r in rows.collect()}


def test_json_arrays(spark, tmp_path):
    folder = tmp_path / "arrays.json"
    folder.mkdir()
    for k in range(3):
        (folder / f"part-{k}").write_text(json.dumps([{"vendor": f"{k}-{n}"} for n in range(4 + k)]))
    got = read_numbered(spark, str(folder)).orderBy("position").collect()
    assert [(r.position, r.vendor) for r in got] == list(enumerate(f"{k}-{n}" for k in range(3) for n in range(4 + k)))


def test_empty_and_unequal(spark, tmp_path):
    empty = _lines(tmp_path / "empty.jsonl", [])
    assert read_numbered(spark, empty).count() == 0
    one = read_numbered(spark, _lines(tmp_path / "one.jsonl", [TRUTH]))
    two = read_numbered(spark, _lines(tmp_path / "two.jsonl", [TRUTH, TRUTH]))
    with pytest.raises(Exception, match="same number of samples"):
        evaluate.score_samples(one, two, ("position",)).collect()


def test_no_shuffle_of_records(spark, tmp_path):
    path = _lines(tmp_path / "some.jsonl", [TRUTH] * 10)
    plan = read_numbered(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # Every exchange is of the counts.
    assert all("_records" in line or "_total" in line or "_begin" in line or "_file" in line
               for line in plan.splitlines() if "hashpartitioning" in line)

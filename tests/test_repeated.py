"""Repeated keys, missing times, large exports and repeated runs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docketry.operators.cache import ttl_dedupe
from docketry.operators.categorize import categorize, rules_table
from docketry.operators.evaluate import score_samples
from docketry.plans.receipts import parse_receipts
from docketry.sources import datasets

DAY = datetime(2024, 1, 5, 10)


def test_as_many_answers_as_requests(spark):
    rows = [("a", DAY), ("a", DAY), ("b", DAY), ("c", None), ("c", None), (None, None)]
    requests = spark.createDataFrame(rows, "request_id string, request_ts timestamp").select(
        "*", F.lit("u").alias("user_id"), F.lit("Total: 5.00 at Shop").alias("receipt_text"),
        F.lit("AUD").alias("currency"),
    )
    batch = parse_receipts(requests)
    got = sorted((r.request_id or "", r.cache_status) for r in batch.receipts.collect())
    assert got == [("", "miss"), ("a", "miss"), ("a", "miss"), ("b", "hit"), ("c", "miss"), ("c", "miss")]
    assert batch.written.filter("ttl is not null").count() == 1  # one text, one entry with a time


def test_walk_and_aggregate_agree(spark):
    rows = [(f"r{n}", datetime(2024, 1, 5, 10, 0, s), "h") for n, s in enumerate((0, 10, 29, 30, 31, 59))]
    rows += [(f"s{n}", datetime(2024, 1, 5, 10, 0, s), "k") for n, s in enumerate((0, 10, 29))]
    requests = spark.createDataFrame(rows, "request_id string, request_ts timestamp, request_hash string")
    got = {r.request_id: r.cache_status for r in ttl_dedupe(requests, ttl_seconds=30).requests.collect()}
    assert [i for i, s in sorted(got.items()) if s == "miss"] == ["r0", "r3", "s0"]


def test_repeated_sample_keys_are_refused(spark):
    one = spark.createDataFrame([("a", "x")], "request_id string, vendor string")
    assert score_samples(one, one).count() == 1  # seven fields are absent on both sides
    with pytest.raises(Exception, match="same number of samples"):
        score_samples(one.unionByName(one), one).collect()


def test_json_arrays_hold_all_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(datasets, "ARRAY_RECORDS", 40)
    records = spark.range(500).select(F.col("id").cast("string").alias("request_id"))
    path = str(tmp_path / "all.json")
    datasets.write_records(records, path, "json")
    back = datasets.read_records(spark, path)
    assert back.select("request_id").distinct().count() == back.count() == 500


def test_broken_lines_end_the_reading(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"request_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        datasets.read_records(spark, str(tmp_path / "bad.jsonl")).collect()


def test_a_run_written_twice_counts_once(spark, tmp_path):
    run = spark.createDataFrame([("t", 1, "vendor", 0.5), ("t", 1, "items", 0.5)], "test_name string, run_ts bigint, field string, score double")
    for rows in (run, run, run.withColumn("run_ts", F.lit(2).cast("bigint"))):
        datasets.append_results(rows, str(tmp_path / "history"))
    assert datasets.read_results(spark, str(tmp_path / "history")).count() == 4


def test_rule_table_finds_what_the_plan_finds(spark):
    texts = ["fuel and a coffee", "", "myob xero invoice", "nothing here", "ink ink paper"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts * 2)], "key long, clean_text string").select(
        "*", F.lit(None).cast("string").alias("vendor"),
        F.array().cast("array<struct<name:string>>").alias("items"),
    )
    columns = ["key", "category", "matched_keywords", "category_confidence", "categorization_reason"]
    by_plan = categorize(rows).select(columns).orderBy("key").collect()
    assert categorize(rows, rule_table=rules_table(spark)).select(columns).orderBy("key").collect() == by_plan

"""Tests of a batch are scored once, and samples are sorted once a side."""

from pyspark.sql import functions as F

from docketry import schemas
from docketry.operators import evaluate, regress


def _samples(spark, rows):
    return spark.createDataFrame(rows, "test_name string, request_id string, vendor string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checks_do_not_score_again(spark):
    truth = _samples(spark, [("a", "1", "Coles"), ("a", "2", "Aldi"), ("b", "1", "Coles"), ("b", "2", "Aldi")])
    guess = _samples(spark, [("a", "1", "Colse"), ("a", "2", "aldi"), ("b", "1", "Coles"), ("c", "1", "x")])
    results, errors = regress.evaluate_tests(guess, truth, 7)
    baselines = spark.createDataFrame([], schemas.RESULTS)
    checks, _ = regress.run_batch_tests(guess, truth, baselines, 7)
    for table in (results, errors, checks):
        assert "ArrowEvalPython" not in _plan(table) and "SortMergeJoin FullOuter" not in _plan(table)
    assert sorted(r.test_name for r in errors.collect()) == ["b", "c"]
    got = {r.field: r.score for r in results.filter("test_name = 'a'").collect()}
    assert abs(got["vendor"] - 0.9) < 1e-9 and results.select("test_name").distinct().count() == 1


def test_history_does_not_score_again(spark):
    rows = _samples(spark, [("a", "1", "Coles"), ("a", "2", "Aldi")])
    scores = evaluate.with_scores(evaluate.pair_samples(rows, rows, ("test_name", "request_id")))
    results = regress.results_of(scores.withColumn("run_ts", F.lit(3).cast("long")))
    assert "ArrowEvalPython" not in _plan(results)
    assert {r.score for r in results.collect()} == {1.0}


def test_samples_are_sorted_after_they_are_dealt(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("request_id"), F.lit("x").alias("vendor"))
    plan = _plan(evaluate.pair_samples(rows, rows))
    assert plan.count("Sort [") == 2
    twice = rows.unionByName(rows.filter("request_id = '1'"))
    got = {r.request_id: r.paired for r in evaluate.pair_samples(twice, rows).collect()}
    assert got == {"0": True, "1": False, "2": True}

"""The Python part of the scores: one worker a task, only rows that ask."""

from pyspark.sql import functions as F

from docketry.functions import scores
from docketry.operators import evaluate


def test_one_python_step_for_all_fields(spark):
    item = F.array(F.struct(F.lit("Tea").alias("name"), F.lit("1").alias("quantity"),
                            F.lit("1").alias("unit_price"), F.lit("1").alias("total_price")))
    rows = spark.range(5).select(
        F.col("id").cast("string").alias("request_id"), F.lit("Coles").alias("vendor"),
        F.lit("Food").alias("category"), item.alias("items"),
    )
    scored = evaluate.score_samples(rows, rows)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {(r.vendor, r.category, r.items) for r in scored.collect()} == {(1.0, 1.0, 1.0)}


def test_rows_not_asked_for_stay_in_place(spark):
    n = 3 * scores.ROWS + 7
    names = spark.range(n, numPartitions=1).select(
        "id", F.when(F.col("id") % 3 == 0, "Coles").when(F.col("id") % 3 == 1, "Colse").alias("a")
    )
    got = names.select("id", scores.text_score(F.col("a"), F.lit("coles")).alias("s")).collect()
    assert all(abs(r.s - {0: 1.0, 1: 0.8, 2: 0.0}[r.id % 3]) < 1e-9 for r in got) and len(got) == n

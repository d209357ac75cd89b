"""Flow 3: run tests, keep their history, compare with baselines.

A folder on shared storage holds ``history``, ``baselines`` and ``checks``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.operators import regress
from docketry.sources import datasets


def run_tests(
    predictions: DataFrame, truth: DataFrame, folder: str, run_ts: int
) -> DataFrame:
    """One check row per test; new tests get this run as their baseline.

    The results are written before they are compared, so the samples are
    scored once, and the checks are written before a baseline changes.
    """
    spark = predictions.sparkSession
    results, errors = regress.evaluate_tests(predictions, truth, run_ts)
    datasets.append_results(results, f"{folder}/history")
    current = datasets.read_results(spark, f"{folder}/history").filter(F.col("run_ts") == run_ts)
    baselines = datasets.read_results(spark, f"{folder}/baselines")
    checks = regress.check_regressions(current, baselines).unionByName(
        errors, allowMissingColumns=True
    )
    path = f"{folder}/checks/run_ts={run_ts}"
    checks.write.mode("overwrite").parquet(path)
    datasets.write_baselines(
        regress.missing_baselines(current, baselines), f"{folder}/baselines"
    )
    return spark.read.parquet(path)


def update_baseline(spark: SparkSession, folder: str, test_name: str) -> None:
    """Promote the newest run of a test; nothing happens without a run."""
    newest = datasets.read_latest_results(spark, f"{folder}/history", test_name)
    datasets.write_baselines(newest, f"{folder}/baselines")


def batch_report(checks: DataFrame, path: str) -> DataFrame:
    """Save the checks with their totals; returns the totals."""
    totals = regress.batch_summary(checks)
    datasets.write_report(path, summary=totals, tests=checks)
    return totals

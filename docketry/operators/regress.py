"""Regression gate: current scores against stored baselines, per test name.

Results and baselines are tables of ``test_name, run_ts, field, score`` where
the field ``overall_score`` holds the weighted mean.
"""

from pyspark.sql import DataFrame, functions as F

from docketry import fixed_values as fv
from docketry.operators.evaluate import (
    UNPAIRED,
    field_report,
    overall_score,
    pair_samples,
    scored_parts,
    with_scores,
)
from docketry.session import work_folder

TOLERANCE = 0.05
OVERALL = "overall_score"
_ORDER = (OVERALL, *fv.FIELDS)


def _kept(small: DataFrame, purpose: str) -> DataFrame:
    """A small table written to the working folder, so that its second use does not
    score the samples again."""
    path = work_folder(small.sparkSession, purpose)
    small.write.parquet(path)
    return small.sparkSession.read.schema(small.schema).parquet(path)


def results_of(scores: DataFrame, run_ts: int | None = None) -> DataFrame:
    """Result rows for every ``test_name`` of a score table, in one aggregation.

    With no ``run_ts`` the scores carry their own ``run_ts`` column.
    """
    by = ("test_name",) if run_ts is not None else ("test_name", "run_ts")
    return _results(_kept(field_report(scores, by), "results"), by, run_ts)


def _results(fields: DataFrame, by: tuple[str, ...], run_ts: int | None) -> DataFrame:
    """Result rows of the field means, the overall score among them."""
    overall = overall_score(fields, by=by).select(
        *by, F.lit(OVERALL).alias("field"), F.col(OVERALL).alias("score")
    )
    rows = fields.select(*by, "field", "score").unionByName(overall)
    if run_ts is not None:
        rows = rows.withColumn("run_ts", F.lit(run_ts).cast("bigint"))
    return rows.select("test_name", "run_ts", "field", "score")


def latest_results(results: DataFrame) -> DataFrame:
    """Rows of the newest run of every test.

    Newest run first by a pre-combined aggregate, then a join on the run: the
    history of one test is never gathered in one task.
    """
    newest = results.groupBy("test_name").agg(F.max("run_ts").alias("run_ts"))
    return results.join(newest, ["test_name", "run_ts"])


def missing_baselines(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """Result rows of tests that have no baseline yet; they become one."""
    return current.join(baselines.select("test_name").distinct(), "test_name", "left_anti")


def check_regressions(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """One row per test: ``has_regression``, ``message``, ``changes``.

    A drop of more than 0.05 in the overall score or any field is a
    regression; a field without baseline compares to zero.  The message quotes
    the overall drop.
    """
    base = baselines.select("test_name", "field", F.col("score").alias("baseline"))
    known = baselines.select("test_name").distinct().withColumn("_known", F.lit(True))
    rank = F.array_position(F.array(*[F.lit(f) for f in _ORDER]), F.col("field"))
    compared = (
        current.select("test_name", "field", F.col("score").alias("current"))
        .join(base, ["test_name", "field"], "left")
        .join(known, "test_name", "left")
        .withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))
    )
    dropped = F.col("_known") & (F.col("current") < F.col("baseline") - F.lit(TOLERANCE))
    change = F.struct(
        rank.alias("rank"), "field", "baseline", "current",
        (F.col("current") - F.col("baseline")).alias("change"),
    )
    # at most one row per field and test
    grouped = compared.groupBy("test_name").agg(
        F.array_sort(F.collect_list(F.when(dropped, change))).alias("_ranked"),
        F.max("_known").alias("_known"),
        F.max(F.when(F.col("field") == OVERALL, F.col("baseline") - F.col("current"))).alias(
            "_drop"
        ),
    )
    regressed = F.size("_ranked") > 0
    message = (
        F.when(F.col("_known").isNull(), "New baseline created")
        .when(
            regressed,
            F.format_string("Regression detected! Overall score dropped by %.3f", F.col("_drop")),
        )
        .otherwise("No regression detected")
    )
    return grouped.select(
        "test_name",
        regressed.alias("has_regression"),
        message.alias("message"),
        F.transform(
            "_ranked",
            lambda c: F.struct(c["field"], c["baseline"], c["current"], c["change"]),
        ).alias("changes"),
    )


def evaluate_tests(
    predictions: DataFrame, truth: DataFrame, run_ts: int
) -> tuple[DataFrame, DataFrame]:
    """(results, errors) for all tests of two tables that carry ``test_name``.

    A test whose samples do not pair up gets an error row and leaves the
    others untouched.  Samples with and without a partner are summed apart in one
    pass over all of them; what is left to decide are a few rows for each test.
    Only what scores read of a sample is moved.
    """
    keys = ("test_name", "request_id")
    paired = pair_samples(scored_parts(predictions, keys), scored_parts(truth, keys), keys)
    scores = with_scores(paired.withColumn("unpaired", ~F.col("paired")))
    fields = _kept(field_report(scores, ("test_name", "unpaired")), "tests")
    errors = fields.filter("unpaired").select("test_name", F.lit(UNPAIRED).alias("error")).distinct()
    sound = fields.join(errors, "test_name", "left_anti")
    return _results(sound, ("test_name",), run_ts), errors


def run_batch_tests(
    predictions: DataFrame, truth: DataFrame, baselines: DataFrame, run_ts: int
) -> tuple[DataFrame, DataFrame]:
    """(checks, results) for all tests of the tables, in one job."""
    results, errors = evaluate_tests(predictions, truth, run_ts)
    checks = check_regressions(results, baselines).unionByName(errors, allowMissingColumns=True)
    return checks, results


def batch_summary(checks: DataFrame) -> DataFrame:
    """Totals over all tests.

    ``passed_tests`` counts errored tests as passed, as the published report
    does; ``passed_clean`` does not.
    """
    failed = F.coalesce(F.col("has_regression"), F.lit(False))
    errored = F.col("error").isNotNull() if "error" in checks.columns else F.lit(False)
    return checks.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(~failed).alias("passed_tests"),
        F.count_if(failed).alias("failed_tests"),
        F.count_if(errored).alias("error_tests"),
        F.count_if(~failed & ~errored).alias("passed_clean"),
    )

"""Flow 2: prediction and truth records -> report tables."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.operators import evaluate
from docketry.sources import datasets
from docketry.sources.positions import POSITION, read_numbered


class Report(NamedTuple):
    """Parts of an evaluation report, each a table."""

    overall: DataFrame
    fields: DataFrame
    failures: DataFrame
    scores: DataFrame


def report(
    predictions: DataFrame,
    truth: DataFrame,
    weights: dict[str, float] | None = None,
    scores_path: str | None = None,
    keys: tuple[str, ...] = ("request_id",),
    numbered: bool = False,
) -> Report:
    """Score all samples, paired by ``keys``, and summarise them.

    ``scores_path`` (shared storage) writes the scores once; the three
    summaries then read numbers instead of scoring again.  Empty or unpaired
    input fails.  ``numbered`` tells that the one key counts the samples of
    each side from 0.
    """
    if numbered:
        scores = evaluate.score_numbered(predictions, truth, *keys)
    else:
        scores = evaluate.score_samples(predictions, truth, keys)
    if scores_path is not None:
        scores.write.mode("overwrite").parquet(scores_path)
        scores = predictions.sparkSession.read.parquet(scores_path)
    fields = evaluate.field_report(scores)
    overall = evaluate.overall_score(fields, weights)
    empty = F.raise_error(F.lit("Both predictions and ground truth must be loaded"))
    checked = F.when(F.col("total_samples") > 0, F.col("total_samples")).otherwise(
        empty.cast("bigint")
    )
    return Report(
        overall.withColumn("total_samples", checked), fields, evaluate.failures(scores, keys[-1]), scores
    )


def evaluate_files(
    spark: SparkSession,
    predictions_path: str,
    truth_path: str,
    report_path: str,
    keys: tuple[str, ...] = ("request_id",),
) -> Report:
    """Read both record files, score them and save every part of the report.

    Records without ids are paired by their place: ``keys=("position",)``.
    """
    numbered = keys == (POSITION,)
    read = read_numbered if numbered else datasets.read_records
    parts = report(
        read(spark, predictions_path),
        read(spark, truth_path),
        keys=keys,
        numbered=numbered,
        scores_path=f"{report_path.rstrip('/')}/scores",
    )
    datasets.write_report(
        report_path,
        overall=parts.overall,
        fields=parts.fields,
        failures=parts.failures,
        summary=evaluate.summary_table(parts.fields, parts.overall),
    )
    return parts

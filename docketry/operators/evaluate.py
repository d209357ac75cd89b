"""Predictions against truth: scores, report, failures."""

from pyspark.sql import Column, DataFrame, functions as F

from docketry import fixed_values as fv
from docketry.functions import packing, scores as score
from docketry.schemas import SCORED_TYPES
from docketry.functions.binding import settled
from docketry.functions.dates import date_score
from docketry.functions.text import excerpt
from docketry.operators.numbered import UNPAIRED, pair_numbered

NEEDS_ATTENTION = 0.8
FAILED = 0.5


def output_fields(records: DataFrame) -> Column:
    """The eight fields of a record, nested under ``expected_output`` or flat."""
    nested = {f.name: f.dataType for f in records.schema}
    inner = (
        set(nested["expected_output"].names) if "expected_output" in nested else set()
    )

    def field(name: str) -> Column:
        none = F.lit(None).cast(SCORED_TYPES[name])
        flat = F.col(name) if name in nested else none
        if not inner:
            return flat
        deep = F.col(f"expected_output.{name}") if name in inner else none
        if name not in nested:
            return deep
        return F.when(F.col("expected_output").isNotNull(), deep).otherwise(flat)

    return F.struct(*[field(name).alias(name) for name in fv.FIELDS])


def _sides(predictions: DataFrame, truth: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """What scoring needs of both sides."""
    text = F.col("receipt_text") if "receipt_text" in predictions.columns else F.lit("")
    return (
        predictions.select(*keys, output_fields(predictions).alias("predicted"), text.alias("receipt_text")),
        truth.select(*keys, output_fields(truth).alias("expected")),
    )


def scored_parts(records: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys and fields of records, of their items only what scores read."""
    fields = records.select(*keys, output_fields(records).alias("expected_output"))
    items = F.transform("expected_output.items", lambda i: F.struct(*[i[part].alias(part) for part in score.ITEM_PARTS]))
    return fields.withColumn("expected_output", F.col("expected_output").withField("items", items))


def pair_samples(
    predictions: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("request_id",)
) -> DataFrame:
    """Join on the sample key; both sides are kept, ``paired`` tells whether both exist.

    Rows are never matched by position, which a distributed table lacks.  A key
    that one side has more than once is not paired either.  Both sides are dealt by
    key before they are grouped: keys hardly repeat, so grouping first would sort
    every record twice.  Records are moved and sorted packed.
    """
    sides = _sides(predictions, truth, keys)
    kinds = {name: side.schema[name].dataType for name, side in zip(("predicted", "expected"), sides)}
    predicted, expected = (packing.packed(side, name) for name, side in zip(kinds, sides))
    left = (
        predicted.repartition(*keys)
        .groupBy(*keys)
        .agg(
            F.first("predicted").alias("predicted"), F.first("receipt_text").alias("receipt_text"),
            F.count(F.lit(1)).alias("_p"),
        )
    )
    right = (
        expected.repartition(*keys)
        .groupBy(*keys)
        .agg(F.first("expected").alias("expected"), F.count(F.lit(1)).alias("_t"))
    )
    once = F.coalesce((F.col("_p") == 1) & (F.col("_t") == 1), F.lit(False))
    joined = (
        left.join(right, list(keys), "full_outer")
        .withColumn("paired", once)
        .drop("_p", "_t")
    )
    for name, kind in kinds.items():
        joined = packing.unpacked(joined, name, kind)
    return joined


def _require_pairs(paired: DataFrame) -> DataFrame:
    checked = F.when(F.col("paired"), True).otherwise(F.raise_error(F.lit(UNPAIRED)).cast("boolean"))
    return paired.filter(checked)


def with_scores(paired: DataFrame) -> DataFrame:
    """Replace the two field structs by eight score columns."""
    p, e = F.col("predicted"), F.col("expected")
    by_field = {
        "vendor": score.text_score,
        "category": score.text_score,
        "total_amount": score.amount_score,
        "subtotal_amount": score.amount_score,
        "gst_amount": score.amount_score,
        "receipt_date": date_score,
        "currency": score.currency_score,
    }
    return score.with_items_score(paired, "predicted.items", "expected.items", "items").select(
        *[c for c in paired.columns if c not in ("predicted", "expected", "paired")],
        *[by_field[f](p[f], e[f]).alias(f) if f in by_field else F.col(f) for f in fv.FIELDS],
    )


def score_samples(
    predictions: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("request_id",)
) -> DataFrame:
    """One row of eight scores per sample; fails when a sample lacks its partner."""
    return with_scores(_require_pairs(pair_samples(predictions, truth, keys)))


def score_numbered(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """The same for records that are numbered without gaps, which are shuffled in blocks."""
    return with_scores(pair_numbered(*_sides(predictions, truth, (key,)), key))


def field_report(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per field: mean, error rate, 95 % interval, samples.  One pass over the scores.

    The interval is NULL for a single sample.
    """
    wide = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        *[
            F.struct(
                F.avg(f).alias("score"),
                F.avg((F.col(f) < NEEDS_ATTENTION).cast("double")).alias("error_rate"),
                F.stddev_samp(f).alias("spread"),
            ).alias(f)
            for f in fv.FIELDS
        ],
    )
    tall = wide.select(
        *by,
        "samples",
        F.posexplode(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("m")) for f in fv.FIELDS])
        ).alias("position", "_row"),
    )
    margin = F.lit(1.96) * F.col("_row.m.spread") / F.sqrt("samples")
    mean = F.col("_row.m.score")
    several = F.col("samples") > 1
    return tall.select(
        *by,
        "position",
        F.col("_row.field").alias("field"),
        mean.alias("score"),
        F.col("_row.m.error_rate").alias("error_rate"),
        F.when(several, F.greatest(F.lit(0.0), mean - margin)).alias("ci_lower"),
        F.when(several, F.least(F.lit(1.0), mean + margin)).alias("ci_upper"),
        "samples",
    )


def overall_score(
    fields: DataFrame, weights: dict[str, float] | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Weighted mean of the field means; weights are rescaled to the fields present."""
    table = weights or fv.FIELD_WEIGHTS
    weight = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("field")
    )
    weighted = fields.withColumn("_w", weight).filter(F.col("_w").isNotNull())
    total = F.sum("_w")
    return weighted.groupBy(*by).agg(
        F.when(total > 0, F.sum(F.col("score") * F.col("_w")) / total)
        .otherwise(0.0)
        .alias("overall_score"),
        F.max("samples").alias("total_samples"),
    )


def failures(scores: DataFrame, key: str = "request_id", limit: int = 10) -> DataFrame:
    """First failing samples in key order with the fields scored below one half."""
    failed = F.array_compact(F.array(*[F.when(F.col(f) < FAILED, F.lit(f)) for f in fv.FIELDS]))
    return (
        scores.select("*", settled(failed).alias("failed_fields"))
        .filter(F.size("failed_fields") > 0)
        .select(
            F.col(key).alias("sample"), "failed_fields",
            excerpt(F.col("receipt_text")).alias("receipt_text"),
        )
        .orderBy("sample")
        .limit(limit)
    )


def summary_table(fields: DataFrame, overall: DataFrame) -> DataFrame:
    """Fields and the overall score as one small table in report order."""
    total = overall.select(
        F.lit(-1).alias("position"),
        F.lit("overall_score").alias("field"),
        F.col("overall_score").alias("score"),
        *[F.lit(None).cast("double").alias(c) for c in ("error_rate", "ci_lower", "ci_upper")],
        F.col("total_samples").alias("samples"),
    )
    return fields.unionByName(total)

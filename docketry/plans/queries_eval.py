"""Registered queries: scores, reports, regression gate."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry import fixed_values as fv
from docketry.functions import scores as score
from docketry.functions.dates import date_score
from docketry.operators import evaluate, regress
from docketry.plans import oracle_sql as sql, regression
from docketry.session import work_folder
from docketry.sources import datasets
from docketry.plans.evaluation import evaluate_files
from docketry.sources.orders import receipts_from_orders, table
from docketry.sources.positions import write_ordered

_CATEGORIES = list(fv.CATEGORY_KEYWORDS)


def _category_of(customer: Column) -> Column:
    names = F.array(*[F.lit(c) for c in _CATEGORIES])
    return F.get(names, F.pmod(customer, F.lit(len(_CATEGORIES))).cast("int"))


def _text_items(items: Column) -> Column:
    return F.transform(
        items,
        lambda i: F.struct(
            i["name"].alias("name"), i["quantity"].cast("string").alias("quantity"),
            i["unit_price"].cast("string").alias("unit_price"),
            i["total_price"].cast("string").alias("total_price"),
        ),
    )


def truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of all receipts, nested, with a test name and a run per receipt."""
    return receipts_from_orders(spark, sf_dir).select(
        "order_key", "request_id", F.col("priority").alias("test_name"),
        F.year("request_ts").cast("bigint").alias("run_ts"),
        F.struct(
            "vendor", "receipt_date",
            F.col("total_amount").cast("string").alias("total_amount"),
            F.when(F.col("order_key") % 5 != 1, F.col("gst_amount").cast("string"))
            .alias("gst_amount"),
            F.col("subtotal_amount").cast("string").alias("subtotal_amount"),
            _text_items(F.col("items")).alias("items"),
            F.lit("AUD").alias("currency"),
            _category_of(F.col("customer_key")).alias("category"),
        ).alias("expected_output"),
    )


def prediction_rows(truth: DataFrame) -> DataFrame:
    """Predictions made from the truth by known errors, flat."""
    key = F.col("order_key")
    right = "expected_output."
    day = F.col(right + "receipt_date").cast("date")
    total = F.col(right + "total_amount").cast("decimal(18,2)")
    off = F.element_at(
        F.array(*[F.lit(x).cast("decimal(3,2)") for x in ("0", "0.01", "0.10", "1.00", "1.01")]),
        (key % 6 + 1).cast("int"),
    )
    items = F.col(right + "items")
    n = F.size(items)
    return truth.select(
        "order_key", "request_id", "test_name", "run_ts",
        F.concat(F.lit("receipt "), F.col("request_id")).alias("receipt_text"),
        F.when(key % 10 != 0, F.upper(F.col(right + "vendor"))).alias("vendor"),
        F.when(key % 7 == 1, F.last_day(day).cast("string"))
        .when(key % 7 == 2, F.lit(None))
        .when(key % 7 == 3, F.concat(day.cast("string"), F.lit("T10:00:00")))
        .when(key % 7 == 4, F.add_months(day, 12).cast("string"))
        .otherwise(day.cast("string"))
        .alias("receipt_date"),
        F.when(key % 6 == 5, F.lit(None)).otherwise((total + off).cast("string"))
        .alias("total_amount"),
        F.col(right + "gst_amount").alias("gst_amount"),
        F.when(key % 11 == 0, F.lit("n/a")).otherwise(F.col(right + "subtotal_amount"))
        .alias("subtotal_amount"),
        F.when(key % 4 == 1, F.reverse(items))
        .when((key % 4 == 2) & (n > 1), F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))))
        .when(key % 4 == 3, F.lit(None))
        .otherwise(items)
        .alias("items"),
        F.when(key % 9 == 0, "usd").otherwise("aud").alias("currency"),
        F.when(key % 8 != 3, F.col(right + "category")).alias("category"),
    )


def _built_once(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The truth as stored at ``path``, so that no later use builds the receipts again."""
    built = truth_rows(spark, sf_dir)
    built.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(built.schema).parquet(path)


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    truth = truth_rows(spark, sf_dir)
    return prediction_rows(truth), truth


def sample_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, truth = _pairs(spark, sf_dir)
    return evaluate.score_samples(predictions, truth)


# scores of every sample; the errors put in decide each of them
_SCORES = f"""
{sql.RECEIPTS},
k AS (SELECT *, order_key % 5 AS k5, order_key % 4 AS k4, order_key % 7 AS k7, len(items) AS n,
  CAST(CASE WHEN order_key % 7 = 1 THEN last_day(CAST(d AS DATE))
       WHEN order_key % 7 = 4 THEN CAST(d AS DATE) + INTERVAL 12 MONTH ELSE CAST(d AS DATE) END AS DATE) AS pd
  FROM rec),
sc AS (
  SELECT order_key, CAST(order_key AS VARCHAR) AS request_id, priority AS test_name,
    CAST(year(ts) AS BIGINT) AS run_ts,
    CASE WHEN order_key % 10 = 0 THEN 0.0::DOUBLE ELSE 1.0 END AS vendor,
    CASE WHEN k7 = 2 THEN 0.0::DOUBLE WHEN k7 = 3 THEN 0.8 WHEN pd = CAST(d AS DATE) THEN 1.0
      WHEN k7 = 1 THEN 0.5 ELSE 0.0 END AS receipt_date,
    CASE order_key % 6 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9 WHEN 2 THEN 0.5 WHEN 3 THEN 0.1
      ELSE 0.0 END AS total_amount,
    1.0::DOUBLE AS gst_amount,
    CASE WHEN order_key % 11 = 0 THEN 0.0::DOUBLE ELSE 1.0 END AS subtotal_amount,
    CASE WHEN n = 0 THEN 1.0::DOUBLE WHEN k4 = 3 THEN 0.0
      WHEN k4 = 2 AND n > 1 THEN (n - 1)::DOUBLE / n ELSE 1.0 END AS items,
    CASE WHEN order_key % 9 = 0 THEN 0.0::DOUBLE ELSE 1.0 END AS currency,
    CASE WHEN order_key % 8 = 3 THEN 0.0::DOUBLE ELSE 1.0 END AS category
  FROM k)"""


def scores_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_scores(spark, sf_dir).select(
        "request_id", *[F.round(f, 9).alias(f) for f in fv.FIELDS]
    )


_SCORES_PER_SAMPLE = (
    f"WITH {_SCORES} SELECT request_id, "
    + ", ".join(f"round({f}, 9) AS {f}" for f in fv.FIELDS)
    + " FROM sc"
)


def scores_amount_date_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores straight from two columns, without a join of samples."""
    orders = table(spark, sf_dir, "orders", spread=True).select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(18,4)").cast("decimal(18,2)").alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format(F.date_add("o_orderdate", 3), "yyyy-MM-dd").alias("later"),
    )
    off = F.when(F.col("o_orderkey") % 3 == 0, F.lit("0.005")).otherwise(F.lit("0.5"))
    return orders.select(
        F.col("o_orderkey").alias("order_key"),
        score.amount_score(F.col("total") + off.cast("decimal(4,3)"), F.col("total").cast("string"))
        .alias("amount"),
        date_score(F.col("later"), F.col("day")).alias("date"),
        score.currency_score(
            F.when(F.col("o_orderkey") % 2 == 0, "eur"), F.when(F.col("o_orderkey") % 4 == 0, "EUR")
        ).alias("currency"),
    )


_SCORES_AMOUNT_DATE_CURRENCY = """
SELECT o_orderkey AS order_key,
  CASE WHEN o_orderkey % 3 = 0 THEN 0.9::DOUBLE ELSE 0.1 END AS amount,
  CASE WHEN date_trunc('month', o_orderdate) = date_trunc('month', o_orderdate + INTERVAL 3 DAY)
    THEN 0.5::DOUBLE ELSE 0.0 END AS date,
  CASE WHEN o_orderkey % 4 = 2 THEN 0.0::DOUBLE ELSE 1.0 END AS currency
FROM orders
"""


def score_text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against the name of another part type, averaged per brand."""
    parts = table(spark, sf_dir, "part")
    scored = parts.select(
        "p_brand", score.text_score(F.col("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_name")))
        .alias("similarity"),
    )
    return scored.groupBy("p_brand").agg(
        F.round(F.avg("similarity"), 9).alias("similarity"), F.count(F.lit(1)).alias("parts")
    )


_SCORE_TEXT_SIMILARITY = """
SELECT p_brand, round(avg(CASE WHEN lower(trim(p_name)) = lower(trim(p_type || ' ' || p_name)) THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * length(p_name) / (2 * length(p_name) + 1 + length(p_type)) END), 9) AS similarity,
  count(*) AS parts
FROM part GROUP BY p_brand
"""


def score_text_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal, empty and missing names: scored without text reaching Python."""
    way = F.col("p_partkey") % 4
    other = (
        F.when(way == 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t")))
        .when(way == 1, "")
        .when(way == 2, F.lit(None))
        .otherwise(F.col("p_name"))
    )
    name = F.when(F.col("p_partkey") % 8 != 1, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", score.text_score(name, other).alias("score"))


_SCORE_TEXT_EXACT = """
SELECT p_partkey, CASE WHEN p_partkey % 8 = 1 THEN 1.0::DOUBLE
  WHEN p_partkey % 4 IN (1, 2) THEN 0.0 ELSE 1.0 END AS score FROM part
"""


def score_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, truth = _pairs(spark, sf_dir)
    paired = evaluate.pair_samples(predictions, truth)
    scored = score.with_items_score(paired, "predicted.items", "expected.items", "items")
    return scored.select("request_id", F.round("items", 9).alias("items"))


_SCORE_ITEMS = f"WITH {_SCORES} SELECT request_id, round(items, 9) AS items FROM sc"


def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = evaluate.field_report(sample_scores(spark, sf_dir))
    return fields.select(
        "field", "samples",
        *[F.round(c, 9).alias(c) for c in ("score", "error_rate", "ci_lower", "ci_upper")],
    )


_TALL = "tall AS (" + " UNION ALL ".join(
    f"SELECT request_id, test_name, run_ts, '{f}' AS field, {f} AS s, {w} AS w FROM sc"
    for f, w in fv.FIELD_WEIGHTS.items()
) + ")"

_REPORT_FIELDS = f"""
WITH {_SCORES}, {_TALL},
m AS (SELECT field, count(*) AS samples, avg(s) AS mean,
  avg(CASE WHEN s < 0.8 THEN 1.0 ELSE 0.0 END) AS bad,
  1.96 * stddev_samp(s) / sqrt(count(*)) AS margin FROM tall GROUP BY field)
SELECT field, samples, round(mean, 9) AS score, round(bad, 9) AS error_rate,
  round(greatest(0.0, mean - margin), 9) AS ci_lower, round(least(1.0, mean + margin), 9) AS ci_upper
FROM m
"""


def report_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals per test and run, among them groups of a single sample."""
    scores = evaluate.with_scores(
        evaluate.pair_samples(*_pairs(spark, sf_dir), keys=("test_name", "request_id"))
    ).withColumn("group", F.when(F.col("request_id") == "7", "one").otherwise(F.col("test_name")))
    fields = evaluate.field_report(scores, ("group",))
    return fields.select(
        "group", "field", "samples",
        F.round("ci_lower", 9).alias("ci_lower"), F.round("ci_upper", 9).alias("ci_upper"),
    )


_REPORT_CI = f"""
WITH {_SCORES}, {_TALL},
m AS (SELECT CASE WHEN request_id = '7' THEN 'one' ELSE test_name END AS g, field,
  count(*) AS samples, avg(s) AS mean, 1.96 * stddev_samp(s) / sqrt(count(*)) AS margin
  FROM tall GROUP BY 1, 2)
SELECT g AS "group", field, samples,
  CASE WHEN samples > 1 THEN round(greatest(0.0, mean - margin), 9) END AS ci_lower,
  CASE WHEN samples > 1 THEN round(least(1.0, mean + margin), 9) END AS ci_upper
FROM m
"""


def report_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = evaluate.field_report(sample_scores(spark, sf_dir))
    default = evaluate.overall_score(fields).withColumn("weights", F.lit("default"))
    custom = evaluate.overall_score(fields, {"vendor": 2.0, "items": 1.0, "unknown": 5.0})
    both = default.unionByName(custom.withColumn("weights", F.lit("custom")))
    return both.select(
        "weights", F.round("overall_score", 9).alias("overall_score"), "total_samples"
    )


_REPORT_OVERALL = f"""
WITH {_SCORES}, {_TALL},
m AS (SELECT field, any_value(w) AS w, avg(s) AS mean, count(*) AS n FROM tall GROUP BY field)
SELECT 'default' AS weights, round(sum(mean * w) / sum(w), 9) AS overall_score, max(n) AS total_samples FROM m
UNION ALL
SELECT 'custom', round(sum(mean * CASE field WHEN 'vendor' THEN 2.0 ELSE 1.0 END) / 3.0, 9), max(n)
FROM m WHERE field IN ('vendor', 'items')
"""


def report_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = sample_scores(spark, sf_dir).withColumn("sample_no", F.col("request_id").cast("bigint"))
    return evaluate.failures(scores, "sample_no").select(
        "sample", F.array_join("failed_fields", ",").alias("failed_fields"), "receipt_text"
    )


_REPORT_FAILURES = f"""
WITH {_SCORES},
f AS (SELECT order_key AS sample, array_to_string(list_filter([
  {", ".join(f"CASE WHEN {f} < 0.5 THEN '{f}' END" for f in fv.FIELDS)}], lambda x: x IS NOT NULL), ',')
  AS failed_fields, 'receipt ' || order_key || '...' AS receipt_text FROM sc)
SELECT * FROM f WHERE failed_fields <> '' ORDER BY sample LIMIT 10
"""


# --- regression gate ---------------------------------------------------------------------

def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per order priority (test) and year (run)."""
    scores = evaluate.with_scores(
        evaluate.pair_samples(
            *_pairs(spark, sf_dir), keys=("test_name", "run_ts", "request_id")
        )
    )
    return regress.results_of(scores)


_RESULTS = f"""
{_SCORES}, {_TALL},
fm AS (SELECT test_name, run_ts, field, any_value(w) AS w, avg(s) AS score FROM tall GROUP BY 1, 2, 3),
results AS (
  SELECT test_name, run_ts, field, score FROM fm
  UNION ALL SELECT test_name, run_ts, 'overall_score', sum(score * w) / sum(w) FROM fm GROUP BY 1, 2)"""


def results_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_results(spark, sf_dir).withColumn("score", F.round("score", 9))


_RESULTS_HISTORY = f"WITH {_RESULTS} SELECT test_name, run_ts, field, round(score, 9) AS score FROM results"


def _history(spark: SparkSession, sf_dir: str) -> str:
    history = f"{work_folder(spark, 'history')}/results"
    datasets.append_results(run_results(spark, sf_dir), history)
    return history


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results from a history table, written once and read often."""
    return datasets.read_results(spark, _history(spark, sf_dir))


def latest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found in the names of the partitions; older runs are not scanned."""
    newest = datasets.read_latest_results(spark, _history(spark, sf_dir))
    return newest.withColumn("score", F.round("score", 9))


_LATEST_RESULT = f"""
WITH {_RESULTS}, r AS (SELECT *, rank() OVER (PARTITION BY test_name ORDER BY run_ts DESC) AS k FROM results)
SELECT test_name, run_ts, field, round(score, 9) AS score FROM r WHERE k = 1
"""


def _baselines(results: DataFrame) -> DataFrame:
    """Scores of the first run raised for some fields; one test has none."""
    first = results.filter(F.col("run_ts") == 1995).filter(~F.col("test_name").startswith("5"))
    raised = F.col("score") + F.when(F.col("test_name").startswith("2"), 0.2).otherwise(0.0)
    only_field = F.when(
        F.col("test_name").startswith("3") & (F.col("field") == "items"), F.lit(0.3)
    ).otherwise(F.lit(0.0))
    return first.withColumn("score", raised + only_field)


def regression_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = stored_results(spark, sf_dir)
    checks = regress.check_regressions(regress.latest_results(results), _baselines(results))
    return checks.select(
        "test_name", "has_regression", "message",
        F.array_join(F.transform("changes", lambda c: c["field"]), ",").alias("fields"),
        F.round(
            F.aggregate("changes", F.lit(0.0), lambda acc, c: acc + c["change"]), 6
        ).alias("change_sum"),
    )


_CHECKS = f"""
{_RESULTS},
latest AS (SELECT r.* FROM results r JOIN (SELECT test_name, max(run_ts) AS m FROM results GROUP BY 1) x
  ON r.test_name = x.test_name AND r.run_ts = x.m),
base AS (SELECT test_name, field, score + CASE WHEN test_name LIKE '2%' THEN 0.2 ELSE 0.0 END
    + CASE WHEN test_name LIKE '3%' AND field = 'items' THEN 0.3 ELSE 0.0 END AS b
  FROM results WHERE run_ts = 1995 AND test_name NOT LIKE '5%'),
cmp AS (SELECT l.test_name, l.field, l.score, coalesce(b, 0) AS b, l.test_name NOT LIKE '5%' AS known
  FROM latest l LEFT JOIN base ON l.test_name = base.test_name AND l.field = base.field),
checks AS (
  SELECT test_name,
    count(*) FILTER (known AND score < b - 0.05) > 0 AS has_regression,
    bool_or(known) AS known,
    max(CASE WHEN field = 'overall_score' THEN b - score END) AS drop_,
    coalesce(string_agg(field, ',' ORDER BY list_position(['overall_score', {", ".join(f"'{f}'" for f in fv.FIELDS)}], field))
      FILTER (known AND score < b - 0.05), '') AS fields,
    round(coalesce(sum(score - b) FILTER (known AND score < b - 0.05), 0.0), 6) AS change_sum
  FROM cmp GROUP BY 1)"""

_REGRESSION_FLAGS = f"""
WITH {_CHECKS}
SELECT test_name, has_regression, CASE WHEN NOT known THEN 'New baseline created'
  WHEN has_regression THEN 'Regression detected! Overall score dropped by ' || printf('%.3f', drop_)
  ELSE 'No regression detected' END AS message, fields, change_sum
FROM checks
"""


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tests in one job; the predictions of one test miss some samples."""
    predictions, truth = _pairs(spark, sf_dir)
    lost = F.col("test_name").startswith("1") & (F.col("order_key") % 100 == 3)
    baselines = _baselines(stored_results(spark, sf_dir))
    checks, _ = regress.run_batch_tests(predictions.filter(~lost), truth, baselines, 2002)
    return regress.batch_summary(checks)


_BATCH_SUMMARY = f"""
WITH {_RESULTS},
fm2 AS (SELECT test_name, field, any_value(w) AS w, avg(s) AS score FROM tall GROUP BY 1, 2),
cur AS (SELECT test_name, field, score FROM fm2
  UNION ALL SELECT test_name, 'overall_score', sum(score * w) / sum(w) FROM fm2 GROUP BY 1),
base AS (SELECT test_name, field, score + CASE WHEN test_name LIKE '2%' THEN 0.2 ELSE 0.0 END
    + CASE WHEN test_name LIKE '3%' AND field = 'items' THEN 0.3 ELSE 0.0 END AS b
  FROM results WHERE run_ts = 1995 AND test_name NOT LIKE '5%'),
bad AS (SELECT c.test_name, bool_or(c.score < coalesce(b, 0) - 0.05) AND c.test_name NOT LIKE '5%' AS r
  FROM cur c LEFT JOIN base ON c.test_name = base.test_name AND c.field = base.field
  WHERE c.test_name NOT LIKE '1%' GROUP BY c.test_name),
n AS (SELECT count(DISTINCT test_name) AS t FROM sc),
e AS (SELECT count(DISTINCT test_name) AS e FROM sc WHERE test_name LIKE '1%' AND order_key % 100 = 3)
SELECT t AS total_tests, t - f AS passed_tests, f AS failed_tests, e AS error_tests,
  t - f - e AS passed_clean
FROM n, e, (SELECT count(*) FILTER (r) AS f FROM bad)
"""


def baseline_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History appended, newest run promoted to baseline, both read back."""
    folder = work_folder(spark, "baselines")
    results = run_results(spark, sf_dir)
    datasets.append_results(results, f"{folder}/history")
    history = datasets.read_results(spark, f"{folder}/history")
    datasets.write_baselines(regress.latest_results(history), f"{folder}/baselines")
    urgent = datasets.read_results(spark, f"{folder}/history", "1-URGENT")
    first = urgent.filter(F.col("run_ts") == 1995)
    datasets.write_baselines(first, f"{folder}/baselines")
    stored = datasets.read_results(spark, f"{folder}/baselines")
    return stored.select("test_name", "run_ts", "field", F.round("score", 9).alias("score"))


_BASELINE_WRITE_READ = f"""
WITH {_RESULTS}, r AS (SELECT *, rank() OVER (PARTITION BY test_name ORDER BY run_ts DESC) AS k FROM results)
SELECT test_name, run_ts, field, round(score, 9) AS score FROM r
WHERE CASE WHEN test_name = '1-URGENT' THEN run_ts = 1995 ELSE k = 1 END
"""

def regression_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with history and baselines kept, and the saved batch report.

    The first run has no test 5 and perfect predictions for test 2; the second has
    the usual errors in all tests, so test 2 drops and test 5 gets a first baseline.
    Then the newest run of test 3 becomes its baseline.  The receipts are built once:
    both runs read them as they were stored."""
    folder = work_folder(spark, "runs")
    truth = _built_once(spark, sf_dir, f"{folder}/built")
    predictions = prediction_rows(truth)
    columns = ["test_name", "request_id", "receipt_text", "expected_output"]
    usual = predictions.select(*columns[:3], F.struct(*fv.FIELDS).alias("expected_output"))
    perfect = truth.withColumn("receipt_text", F.lit("")).select(columns)
    second = F.col("test_name").startswith("2")
    early = ~F.col("test_name").startswith("5")
    first = usual.filter(early & ~second).unionByName(perfect.filter(second))
    regression.run_tests(first, truth.filter(early), folder, 1)
    checks = regression.run_tests(usual, truth, folder, 2)
    regression.update_baseline(spark, folder, "3-MEDIUM")
    regression.batch_report(checks, f"{folder}/batch")
    total = spark.read.parquet(f"{folder}/batch/summary").first()  # one row
    baselines = datasets.read_results(spark, f"{folder}/baselines").select(
        "test_name", F.col("run_ts").alias("baseline_run")
    ).distinct()
    saved = spark.read.parquet(f"{folder}/batch/tests")
    return saved.join(baselines, "test_name").select(
        "test_name", "has_regression", "message", F.size("changes").alias("changes"), "baseline_run",
        *[F.lit(total[c]).alias(c) for c in ("total_tests", "passed_tests", "failed_tests", "error_tests")],
    )


_REGRESSION_FLOW = f"""
WITH {_RESULTS},
fm2 AS (SELECT test_name, field, any_value(w) AS w, avg(s) AS score FROM tall GROUP BY 1, 2),
cur AS (SELECT test_name, sum(score * w) / sum(w) AS overall, count(*) FILTER (score < 0.95) AS low FROM fm2 GROUP BY 1),
t AS (SELECT test_name, test_name LIKE '2%' AND (low > 0 OR overall < 0.95) AS r,
  CASE WHEN test_name LIKE '2%' THEN low + CASE WHEN overall < 0.95 THEN 1 ELSE 0 END ELSE 0 END AS n, overall FROM cur)
SELECT test_name, r AS has_regression, CASE WHEN test_name LIKE '5%' THEN 'New baseline created'
  WHEN r THEN 'Regression detected! Overall score dropped by ' || printf('%.3f', 1 - overall)
  ELSE 'No regression detected' END AS message, CAST(n AS INTEGER) AS changes,
  CASE WHEN test_name LIKE '3%' OR test_name LIKE '5%' THEN 2 ELSE 1 END AS baseline_run,
  count(*) OVER () AS total_tests, count(*) FILTER (NOT r) OVER () AS passed_tests,
  count(*) FILTER (r) OVER () AS failed_tests, 0 AS error_tests
FROM t
"""


# --- texts that differ --------------------------------------------------------------------

def _spoiled(name: Column) -> Column:
    """A name with its third character misread as one that no name has."""
    return F.concat(F.substr(name, F.lit(1), F.lit(2)), F.lit("~"), F.substr(name, F.lit(4)))


def _misread(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions with misread or lengthened vendors, categories and item names."""
    truth = truth_rows(spark, sf_dir)
    key, right = F.col("order_key"), "expected_output."
    vendor, category, items = (F.col(right + f) for f in ("vendor", "category", "items"))
    longer = F.transform(items, lambda i: i.withField("name", F.concat(i["name"], F.lit(" ~"))))
    other = F.transform(items, lambda i: i.withField("name", _spoiled(i["name"])).withField("total_price", F.lit("-9")))
    misread = F.struct(
        F.when(key % 3 == 0, vendor).when(key % 3 == 1, _spoiled(vendor)).otherwise(F.lit("~~")).alias("vendor"),
        F.when(key % 2 == 0, category).otherwise(F.concat(F.lit("Sub "), category)).alias("category"),
        F.when(key % 4 == 0, items).when(key % 4 == 1, longer).when(key % 4 == 2, other)
        .otherwise(F.reverse(longer)).alias("items"),
        *[F.col(right + f).alias(f) for f in fv.FIELDS if f not in ("vendor", "category", "items")],
    )
    return truth.select("order_key", "request_id", misread.alias("expected_output")), truth


def scores_misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar but different texts in most samples."""
    return evaluate.score_samples(*_misread(spark, sf_dir)).select(
        "request_id", *[F.round(f, 9).alias(f) for f in ("vendor", "category", "items")]
    )


def report_misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = evaluate.field_report(evaluate.score_samples(*_misread(spark, sf_dir)))
    return fields.filter(F.col("field").isin("vendor", "category", "items")).select(
        "field", "samples", *[F.round(c, 9).alias(c) for c in ("score", "error_rate")]
    )


# A misread character splits the longest match in two; one text inside another is
# the match.  Items without their price get half of the best name.
_MISREAD = f"""
{sql.RECEIPTS},
m AS (SELECT order_key, len(items) AS n,
  CASE order_key % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN (length(vendor) - 1)::DOUBLE / length(vendor) ELSE 0.0 END AS vendor,
  CASE WHEN order_key % 2 = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * length(c) / (2 * length(c) + 4) END AS category,
  CASE WHEN len(items) = 0 OR order_key % 4 = 0 THEN 1.0::DOUBLE
    WHEN order_key % 4 = 2 THEN list_avg(list_transform(items, lambda i: (length(i.name) - 1)::DOUBLE / length(i.name) / 2))
    ELSE list_avg(list_transform(items, lambda i: (length(i.name)::DOUBLE / (length(i.name) + 1) + 1) / 2)) END AS items
  FROM (SELECT *, [{", ".join(f"'{c}'" for c in _CATEGORIES)}][custkey % {len(_CATEGORIES)} + 1] AS c FROM rec))"""

_SCORES_MISREAD = f"""
WITH {_MISREAD}
SELECT CAST(order_key AS VARCHAR) AS request_id, round(vendor, 9) AS vendor, round(category, 9) AS category,
  round(items, 9) AS items FROM m
"""

_REPORT_MISREAD = f"""
WITH {_MISREAD},
t AS (SELECT 'vendor' AS field, vendor AS s FROM m UNION ALL SELECT 'category', category FROM m
  UNION ALL SELECT 'items', items FROM m)
SELECT field, count(*) AS samples, round(avg(s), 9) AS score,
  round(avg(CASE WHEN s < 0.8 THEN 1.0 ELSE 0.0 END), 9) AS error_rate FROM t GROUP BY field
"""


# --- records without ids ------------------------------------------------------------------

def _unnamed_files(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """Both sides exported without any id, in order, over different numbers of files.

    The truth is built once: both exports read it as it was stored."""
    folder = work_folder(spark, "unnamed")
    truth = _built_once(spark, sf_dir, f"{folder}/built")
    predictions = prediction_rows(truth)
    names = ("request_id", "test_name", "run_ts")
    write_ordered(predictions.drop(*names), f"{folder}/predictions.jsonl", "order_key", files=7)
    write_ordered(truth.drop(*names), f"{folder}/truth.jsonl", "order_key", files=5)
    return f"{folder}/predictions.jsonl", f"{folder}/truth.jsonl", f"{folder}/report"


def scores_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples without ids, paired by their place in the files."""
    parts = evaluate_files(spark, *_unnamed_files(spark, sf_dir), keys=("position",))
    return parts.scores.select("position", *[F.round(f, 9).alias(f) for f in fv.FIELDS])


_SCORES_BY_POSITION = (
    f"WITH {_SCORES} SELECT row_number() OVER (ORDER BY order_key) - 1 AS position, "
    + ", ".join(f"round({f}, 9) AS {f}" for f in fv.FIELDS)
    + " FROM sc"
)


def report_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of records without ids as the evaluation over files saved it."""
    predictions, truth, folder = _unnamed_files(spark, sf_dir)
    evaluate_files(spark, predictions, truth, folder, keys=("position",))
    return spark.read.parquet(f"{folder}/summary").select(
        "position", "field", "samples",
        *[F.round(c, 9).alias(c) for c in ("score", "error_rate", "ci_lower", "ci_upper")],
    )


_REPORT_SAVED = f"""
WITH {_SCORES}, {_TALL},
m AS (SELECT field, any_value(w) AS w, count(*) AS samples, avg(s) AS mean,
  avg(CASE WHEN s < 0.8 THEN 1.0 ELSE 0.0 END) AS bad,
  1.96 * stddev_samp(s) / sqrt(count(*)) AS margin FROM tall GROUP BY field)
SELECT list_position([{", ".join(f"'{f}'" for f in fv.FIELDS)}], field) - 1 AS position, field, samples,
  round(mean, 9) AS score, round(bad, 9) AS error_rate,
  round(greatest(0.0, mean - margin), 9) AS ci_lower, round(least(1.0, mean + margin), 9) AS ci_upper
FROM m
UNION ALL
SELECT -1, 'overall_score', max(samples), round(sum(mean * w) / sum(w), 9), NULL, NULL, NULL FROM m
"""

QUERIES = {
    "regression_flow": (regression_flow, _REGRESSION_FLOW),
    "scores_misread": (scores_misread, _SCORES_MISREAD),
    "report_misread": (report_misread, _REPORT_MISREAD),
    "scores_by_position": (scores_by_position, _SCORES_BY_POSITION),
    "report_saved": (report_saved, _REPORT_SAVED),
    "scores_per_sample": (scores_per_sample, _SCORES_PER_SAMPLE),
    "scores_amount_date_currency": (scores_amount_date_currency, _SCORES_AMOUNT_DATE_CURRENCY),
    "score_text_similarity": (score_text_similarity, _SCORE_TEXT_SIMILARITY),
    "score_text_exact": (score_text_exact, _SCORE_TEXT_EXACT),
    "score_items": (score_items, _SCORE_ITEMS),
    "report_fields": (report_fields, _REPORT_FIELDS),
    "report_ci": (report_ci, _REPORT_CI),
    "report_overall": (report_overall, _REPORT_OVERALL),
    "report_failures": (report_failures, _REPORT_FAILURES),
    "results_history": (results_history, _RESULTS_HISTORY),
    "latest_result": (latest_result, _LATEST_RESULT),
    "regression_flags": (regression_flags, _REGRESSION_FLAGS),
    "batch_summary": (batch_summary, _BATCH_SUMMARY),
    "baseline_write_read": (baseline_write_read, _BASELINE_WRITE_READ),
}

"""Registered queries: extraction, totals, categories, validation, expenses."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry import fixed_values as fv
from docketry.functions import amounts, prompts
from docketry.operators.categorize import CONFIDENT, categorize, rules_table
from docketry.operators.clean import clean_and_key
from docketry.operators.extract import decode_model_responses, extract_receipts
from docketry.operators.shape import render_receipt
from docketry.operators.validate import validate_and_score, with_warnings
from docketry.plans import oracle_sql as sql
from docketry.plans.receipts import expense_summary as summarize
from docketry.plans.receipts import parse_texts, receipt_json
from docketry.sources.orders import receipts_from_orders, table

_CUSTOM_RULES = {
    "Hardware": ["bolt", "gear", "rod", "plate"],
    "Novelty": ["gizmo", "widget", "small widget"],
    "Colour": ["RED", "blue"],
}


def _rendered(receipts: DataFrame) -> DataFrame:
    text = render_receipt(
        F.col("vendor"), F.col("items"), F.col("total_amount"), F.col("gst_amount"),
        F.col("receipt_date"),
    )
    return receipts.withColumn("receipt_text", text)


def receipt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered receipts of all orders, as request rows."""
    return _rendered(receipts_from_orders(spark, sf_dir)).select(
        "order_key", "request_id", "request_ts", "receipt_text",
        F.lit(None).cast("string").alias("currency"),
    )


def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipt_texts(spark, sf_dir).select(
        "order_key", F.sha2("receipt_text", 256).alias("text_hash"),
        F.length("receipt_text").alias("text_length"),
    )


_RENDER_TEXT = f"""
WITH {sql.RECEIPTS}
SELECT order_key, sha256(receipt_text) AS text_hash,
  CAST(length(receipt_text) AS INTEGER) AS text_length FROM txt
"""


def render_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = extract_receipts(clean_and_key(receipt_texts(spark, sf_dir)), strict=True)
    return parsed.select(
        "order_key", "receipt_date",
        F.col("total_amount").cast("double").alias("total"),
        F.col("gst_amount").cast("double").alias("gst"),
        "currency",
    )


_RENDER_PARSE_ROUNDTRIP = f"""
WITH {sql.RECEIPTS}
SELECT order_key, d AS receipt_date, CAST(total AS DOUBLE) AS total,
  CAST({sql.gst_of('total')} AS DOUBLE) AS gst, 'AUD' AS currency FROM rec
"""


def fallback_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published fallback patterns as they are, over several layouts."""
    texts = receipts_from_orders(spark, sf_dir).select("order_key", "vendor", "total_amount", "request_ts")
    style, total = F.col("order_key") % 5, F.col("total_amount").cast("string")
    day = F.date_format("request_ts", "dd/MM/yyyy")
    body = (
        F.when(style == 0, F.concat_ws(" ", F.lit("Bought at"), F.col("vendor"), F.lit("."), day, F.lit("total:"), total))
        .when(style == 1, F.concat_ws(" ", F.col("vendor"), F.lit("receipt Subtotal: 10.20 Total:"), total))
        .when(style == 2, F.concat_ws(" ", F.lit("Flat White"), day, F.lit("amount $"), total))
        .when(style == 3, F.concat_ws(" ", F.lit("GST: $1.00 Total:"), F.concat(F.lit("$"), total)))
        .otherwise(F.concat_ws(" ", F.lit("Coffee 12.00 on 3 jan 2024")))
    )
    rows = texts.select("order_key", body.alias("receipt_text"), F.lit("eur").alias("currency"))
    parsed = extract_receipts(clean_and_key(rows))
    return parsed.select(
        "order_key", "vendor", "receipt_date",
        F.col("total_amount").cast("double").alias("total"),
        F.col("gst_amount").cast("double").alias("gst"), "currency",
    )


_FALLBACK_PUBLISHED = f"""
WITH {sql.RECEIPTS},
b AS (
  SELECT order_key, order_key % 5 AS style, vendor, ts,
    CASE order_key % 5
      WHEN 0 THEN regexp_extract('at ' || vendor || ' . ' || strftime(ts, '%d/%m/%Y'),
                                 '(?i)(?:from|at)\\s+([A-Z][a-zA-Z\\s]+)', 1)
      WHEN 1 THEN regexp_extract(vendor || ' receipt', '(?i)([A-Z][a-zA-Z\\s]+)\\s+(?:receipt|invoice)', 1)
      WHEN 2 THEN 'White' END AS v,
    CASE order_key % 5 WHEN 0 THEN total WHEN 1 THEN 10.20 WHEN 2 THEN total
      WHEN 3 THEN 1.00 END AS t
  FROM rec)
SELECT order_key,
  nullif(array_to_string(list_transform(regexp_extract_all(trim(v), '[A-Za-z]+|[^A-Za-z]+'),
    lambda r: upper(substring(r, 1, 1)) || lower(substring(r, 2))), ''), '') AS vendor,
  CASE style WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%d')
    WHEN 4 THEN '2024-01-03' END AS receipt_date,
  CAST(t AS DOUBLE) AS total,
  CAST(coalesce({sql.gst_of('t')}, 0) AS DOUBLE) AS gst, 'eur' AS currency
FROM b
"""


def totals_gst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing amounts filled in order: subtotal, total, GST."""
    receipts = receipts_from_orders(spark, sf_dir)
    gap = F.col("order_key") % 4
    given = receipts.select(
        "order_key", "items",
        F.when(gap.isin(0, 3), F.col("subtotal_amount")).alias("subtotal"),
        F.when(gap == 0, F.col("total_amount")).alias("total"),
        F.when(gap == 3, F.col("gst_amount")).alias("gst"),
    )
    filled = given.withColumn("subtotal", amounts.fill_subtotal(F.col("subtotal"), F.col("items")))
    filled = filled.withColumn("total", F.coalesce("total", "subtotal"))
    gst = amounts.compute_gst(F.col("total"), F.col("gst"))
    return filled.select(
        "order_key",
        F.col("subtotal").cast("double").alias("subtotal"),
        F.col("total").cast("double").alias("total"),
        gst.cast("double").alias("gst"),
    )


_TOTALS_GST = f"""
WITH {sql.RECEIPTS},
f AS (
  SELECT order_key, order_key % 4 AS gap, gst,
    CASE WHEN order_key % 4 IN (0, 3) OR len(items) > 0 THEN subtotal END AS s,
    CASE WHEN order_key % 4 = 0 THEN total
         WHEN order_key % 4 = 3 OR len(items) > 0 THEN subtotal END AS t
  FROM rec)
SELECT order_key, CAST(s AS DOUBLE) AS subtotal, CAST(t AS DOUBLE) AS total,
  CAST(CASE WHEN gap = 3 THEN gst ELSE coalesce({sql.gst_of('t')}, 0) END AS DOUBLE) AS gst
FROM f
"""


def _category_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "order_key", "category", "categorization_source", "categorization_reason",
        F.size("matched_keywords").alias("n_keywords"),
        F.round("category_confidence", 6).alias("confidence"),
    )


def categorize_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = _rendered(receipts_from_orders(spark, sf_dir))
    return _category_columns(categorize(rendered, text_col="receipt_text"))


def categorize_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category from the model decides where the rules are not confident."""
    said = F.when(F.col("order_key") % 4 == 1, "Unclassified").when(F.col("order_key") % 4 > 1, "Travel")
    rendered = _rendered(receipts_from_orders(spark, sf_dir)).withColumn("said", said)
    return _category_columns(categorize(rendered, text_col="receipt_text", model_category="said"))


_CATEGORIZE_MODEL = f"""
WITH {sql.RECEIPTS},
s AS (SELECT order_key, lower(vendor || ' ' || names || ' ' || receipt_text) AS search FROM txt),
{sql.categorized('s', 'order_key', 'search', fv.CATEGORY_KEYWORDS)},
b AS (SELECT s.order_key, n, category, keywords, least(coalesce(n, 0) * CAST(0.3 AS DOUBLE), 1.0) AS sure,
  s.order_key % 4 > 1 AND least(coalesce(n, 0) * CAST(0.3 AS DOUBLE), 1.0) < {CONFIDENT}::DOUBLE AS ai
  FROM s LEFT JOIN cat ON s.order_key = cat.order_key)
SELECT order_key, CASE WHEN ai THEN 'Travel' ELSE coalesce(category, 'Unclassified') END AS category,
  CASE WHEN ai THEN 'ai' WHEN n IS NULL THEN 'fallback' ELSE 'rules' END AS categorization_source,
  CASE WHEN ai THEN 'Category from model output'
    ELSE coalesce('Matched keywords: ' || keywords, 'No clear categorization found') END AS categorization_reason,
  CASE WHEN ai THEN 0 ELSE CAST(coalesce(n, 0) AS INTEGER) END AS n_keywords,
  CASE WHEN ai THEN 0.5 ELSE round(sure, 6) END AS confidence
FROM b
"""


def _category_oracle(rules) -> str:
    return f"""
WITH {sql.RECEIPTS},
s AS (SELECT order_key, lower(vendor || ' ' || names || ' ' || receipt_text) AS search FROM txt),
{sql.categorized('s', 'order_key', 'search', rules)}
SELECT s.order_key, coalesce(category, 'Unclassified') AS category,
  CASE WHEN n IS NULL THEN 'fallback' ELSE 'rules' END AS categorization_source,
  coalesce('Matched keywords: ' || keywords, 'No clear categorization found')
    AS categorization_reason,
  CAST(coalesce(n, 0) AS INTEGER) AS n_keywords,
  round(least(coalesce(n, 0) * CAST(0.3 AS DOUBLE), 1.0), 6) AS confidence
FROM s LEFT JOIN cat ON s.order_key = cat.order_key
"""


def categorize_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = _rendered(receipts_from_orders(spark, sf_dir))
    return _category_columns(categorize(rendered, _CUSTOM_RULES, text_col="receipt_text"))


def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the part table by category, the rules joined as a table."""
    rules = rules_table(spark).unionByName(_custom_table(spark))
    parts = table(spark, sf_dir, "part").select(
        F.lit("").alias("vendor"),
        F.array().cast("array<struct<name:string>>").alias("items"),
        F.col("p_name").alias("clean_text"),
    )
    return categorize(parts, rule_table=rules).groupBy("category").agg(F.count(F.lit(1)).alias("parts"))


def _custom_table(spark: SparkSession) -> DataFrame:
    rows = [
        (100 + c, category, k, keyword)
        for c, (category, keywords) in enumerate(_CUSTOM_RULES.items())
        for k, keyword in enumerate(keywords)
    ]
    return spark.createDataFrame(rows, "cat_order int, category string, kw_order int, keyword string")


_RULE_CATALOGUE = f"""
WITH s AS (SELECT p_partkey, lower('  ' || p_name) AS search FROM part),
{sql.categorized('s', 'p_partkey', 'search', {**fv.CATEGORY_KEYWORDS, **_CUSTOM_RULES})}
SELECT coalesce(category, 'Unclassified') AS category, count(*) AS parts
FROM s LEFT JOIN cat ON s.p_partkey = cat.p_partkey GROUP BY 1
"""


def _disturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with amounts, names and labels put wrong in ten ways."""
    way = F.col("order_key") % 10
    receipts = receipts_from_orders(spark, sf_dir)
    cents = {2: "0.02", 3: "0.01"}
    total = F.col("total_amount")
    for place, by in cents.items():
        total = F.when(way == place, F.col("total_amount") + F.lit(by).cast("decimal(3,2)")).otherwise(total)

    def bent(item: Column) -> Column:
        return F.struct(
            F.when(way == 7, " ").otherwise(item["name"]).alias("name"),
            F.when(way == 8, F.lit(0)).otherwise(item["quantity"]).alias("quantity"),
            F.when(way == 9, -item["unit_price"]).otherwise(item["unit_price"]).alias("unit_price"),
            item["total_price"].alias("total_price"),
        )

    return receipts.withColumns(
        {
            "items": F.transform("items", bent),
            "total_amount": F.when(way == 1, F.lit(None)).when(way == 4, -total).otherwise(total)
            .cast(amounts.MONEY),
            "gst_amount": F.when(way == 5, F.lit(None)).otherwise(F.col("gst_amount"))
            .cast(amounts.MONEY),
            "currency": F.when(way == 6, "").otherwise("AUD"),
            "category": F.when(way == 0, F.lit(None)).otherwise(F.lit("Food")),
            "category_confidence": F.when(way == 3, 1.5).otherwise(0.3),
        }
    )


def validate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = with_warnings(_disturbed(spark, sf_dir))
    return checked.select(
        "order_key", F.array_join("warnings", "; ").alias("warnings"),
        F.size("warnings").alias("n_warnings"), "is_valid",
    )


_VALIDATE_WARNINGS = f"""
WITH {sql.RECEIPTS},
w AS (
  SELECT order_key, order_key % 10 AS way, subtotal, items,
    CAST(CASE order_key % 10 WHEN 1 THEN NULL WHEN 4 THEN -total WHEN 2 THEN total + 0.02
      WHEN 3 THEN total + 0.01 ELSE total END AS DECIMAL(18,2)) AS total,
    CAST(CASE WHEN order_key % 10 = 5 THEN NULL ELSE gst END AS DECIMAL(18,2)) AS gst
  FROM rec),
i AS (
  SELECT order_key, way, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM w),
u AS (
  SELECT order_key, pos, way, item.price AS price, CASE WHEN way = 8 THEN 0 ELSE item.qty END AS qty,
    CASE WHEN way = 9 THEN -1 ELSE 1 END * ((CAST(item.price * 200 AS BIGINT) + item.qty) // (2 * item.qty)) / 100.0 AS unit
  FROM i),
c AS (
  SELECT order_key, pos, list_filter([
    CASE WHEN way = 7 THEN 'Item ' || pos || ' has no name' END,
    CASE WHEN qty <= 0 THEN 'Item ' || pos || ' has invalid quantity: ' || qty END,
    CASE WHEN unit < 0 THEN 'Item ' || pos || ' has negative unit price' END,
    CASE WHEN price < 0 THEN 'Item ' || pos || ' has negative total price' END,
    CASE WHEN abs(round(unit * 100) * qty - price * 100) > 1
         THEN 'Item ' || pos || ' price calculation doesn''t match' END], lambda x: x IS NOT NULL) AS m
  FROM u),
a AS (SELECT order_key, flatten(list(m ORDER BY pos)) AS m FROM c GROUP BY 1),
z AS (
  SELECT w.order_key, way, list_filter(list_concat(
    [CASE WHEN way = 0 THEN 'Category is missing' END,
     CASE WHEN way = 3 THEN 'Confidence score out of valid range [0,1]' END,
     CASE WHEN total IS NULL THEN 'Total amount is missing' END,
     CASE WHEN total < 0 THEN 'Total amount is negative' END,
     CASE WHEN subtotal > total THEN 'Subtotal amount exceeds total amount' END,
     CASE WHEN abs(subtotal + gst - total) > 0.01 THEN 'GST + subtotal doesn''t match total amount' END],
    list_concat(coalesce(m, ['No items found in receipt']),
    [CASE WHEN gst IS NULL THEN 'GST amount is missing' END,
     CASE WHEN way = 6 THEN 'Currency is missing' END])), lambda x: x IS NOT NULL) AS ws
  FROM w LEFT JOIN a ON w.order_key = a.order_key)
SELECT order_key, array_to_string(ws, '; ') AS warnings, CAST(len(ws) AS INTEGER) AS n_warnings,
  NOT (list_contains(ws, 'Category is missing') OR list_contains(ws, 'Total amount is missing')
    OR list_contains(ws, 'GST amount is missing')) AS is_valid
FROM z
"""


def valid_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = with_warnings(_disturbed(spark, sf_dir))
    return checked.groupBy("priority").agg(
        F.count_if(F.col("is_valid")).alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid")
    )


_VALID_FLAG = """
SELECT o_orderpriority AS priority, count(*) FILTER (o_orderkey % 10 NOT IN (0, 1, 5)) AS valid,
  count(*) FILTER (o_orderkey % 10 IN (0, 1, 5)) AS invalid
FROM orders GROUP BY 1
"""


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("order_key") % 6
    receipts = receipts_from_orders(spark, sf_dir).withColumns(
        {
            "vendor": F.when(gap != 1, F.col("vendor")),
            "receipt_date": F.when(gap != 2, F.col("receipt_date")),
            "total_amount": F.when(gap != 3, F.col("total_amount")),
            "gst_amount": F.when(gap != 4, F.col("gst_amount")),
            "currency": F.lit("AUD"),
            "clean_text": F.lit(""),
        }
    )
    scored = validate_and_score(categorize(receipts))
    return scored.select("order_key", F.round("confidence_score", 6).alias("confidence"))


_CONFIDENCE = f"""
WITH {sql.RECEIPTS},
s AS (SELECT *, order_key % 6 AS gap, lower(CASE WHEN order_key % 6 = 1 THEN '' ELSE vendor END || ' ' || names || ' ') AS search FROM rec),
{sql.categorized('s', 'order_key', 'search', fv.CATEGORY_KEYWORDS)}
SELECT s.order_key, round((
  CASE WHEN gap <> 1 THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN gap <> 2 THEN 0.9::DOUBLE ELSE 0 END
  + CASE WHEN gap <> 3 THEN 0.95::DOUBLE ELSE 0 END + CASE WHEN gap <> 4 THEN 0.9::DOUBLE ELSE 0 END
  + least(len(items) * 0.1::DOUBLE, 0.8) + least(coalesce(n, 0) * 0.3::DOUBLE, 1.0)) / 6, 6)
  AS confidence
FROM s LEFT JOIN cat ON s.order_key = cat.order_key
"""


def receipt_output_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API bodies of all receipts; amounts are JSON strings."""
    parsed = parse_texts(clean_and_key(receipt_texts(spark, sf_dir)), strict=True)
    bodies = receipt_json(parsed.withColumn("cache_status", F.lit("miss")))
    body = F.col("body")
    return bodies.select(
        "request_id",
        F.get_json_object(body, "$.total_amount").alias("total_text"),
        F.get_json_object(body, "$.gst_amount").alias("gst_text"),
        F.get_json_object(body, "$.receipt_date").alias("receipt_date"),
        F.get_json_object(body, "$.warnings").alias("warnings"),
        F.schema_of_variant(F.try_variant_get(F.parse_json(body), "$.total_amount", "variant"))
        .alias("total_kind"),
    )


_RECEIPT_OUTPUT_JSON = f"""
WITH {sql.RECEIPTS}
SELECT CAST(order_key AS VARCHAR) AS request_id, CAST(total AS VARCHAR) AS total_text,
  CAST(CAST({sql.gst_of('total')} AS DECIMAL(18,2)) AS VARCHAR) AS gst_text,
  d AS receipt_date, '["No items found in receipt"]' AS warnings, 'STRING' AS total_kind
FROM rec
"""


def model_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both response envelopes, wrapped text, and records with one bad type."""
    receipts = receipts_from_orders(spark, sf_dir)
    way = F.col("order_key") % 8
    record = F.to_json(
        F.struct(
            "vendor", F.col("receipt_date"), "items",
            F.col("subtotal_amount"), F.col("total_amount"),
            F.when(way == 2, F.col("gst_amount")).alias("gst_amount"),
            F.lit("AUD").alias("currency"), F.lit("Food").alias("category"),
        )
    )
    spoken = (
        F.when(way == 3, F.concat(F.lit("Here it is: "), record, F.lit(" as asked.")))
        .when(way == 4, F.lit("no object here"))
        .when(way == 5, F.regexp_replace(record, '"currency":"AUD"', '"currency":null'))
        .when(way == 6, F.regexp_replace(record, '"subtotal_amount":[^,]*', '"subtotal_amount":"\\$5"'))
        .when(way == 7, F.regexp_replace(record, '"items":\\[.*\\],"sub', '"items":null,"sub'))
        .otherwise(record)
    )
    older = F.to_json(F.struct(F.array(F.struct(spoken.alias("text"))).alias("content")))
    newer = F.to_json(
        F.struct(
            F.struct(
                F.struct(F.array(F.struct(spoken.alias("text"))).alias("content")).alias("message")
            ).alias("output")
        )
    )
    bodies = receipts.select(
        F.col("request_id").alias("request_hash"),
        F.when(F.col("order_key") % 2 == 0, older).otherwise(newer).alias("body"),
    )
    decoded = decode_model_responses(bodies)
    return decoded.select(
        F.col("request_hash").alias("request_id"), "model_ok", "vendor", "receipt_date",
        F.when(F.col("model_ok"), F.size("items")).alias("n_items"),
        F.col("total_amount").cast("double").alias("total"),
        F.col("gst_amount").cast("double").alias("gst"),
    )


_MODEL_DECODE = f"""
WITH {sql.RECEIPTS}, w AS (SELECT *, order_key % 8 AS way, order_key % 8 < 4 AS ok FROM rec)
SELECT CAST(order_key AS VARCHAR) AS request_id, ok AS model_ok,
  CASE WHEN ok THEN vendor END AS vendor, CASE WHEN ok THEN d END AS receipt_date,
  CASE WHEN ok THEN CAST(len(items) AS INTEGER) END AS n_items,
  CASE WHEN ok THEN CAST(total AS DOUBLE) END AS total,
  CASE WHEN way = 2 THEN CAST(gst AS DOUBLE) END AS gst
FROM w
"""


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = _rendered(receipts_from_orders(spark, sf_dir)).withColumn(
        "vendor", F.when(F.col("order_key") % 3 != 0, F.col("vendor"))
    )
    text = F.col("receipt_text")
    return receipts.select(
        "order_key",
        *[
            F.sha2(p, 256).alias(name)
            for name, p in (
                ("extraction", prompts.extraction_prompt(text, F.lit("NZD"))),
                ("dataset", prompts.dataset_prompt(text)),
                ("category", prompts.category_prompt(F.col("vendor"), F.col("items"), text)),
                (
                    "dataset_category",
                    prompts.dataset_category_prompt(text, F.col("vendor"), F.col("items")),
                ),
            )
        ],
    )


def _filled(template: str, *values: str) -> str:
    """SQL that fills a numbered template by plain replacement."""
    # a private marker per slot keeps the filled texts from being searched again
    out = sql.quoted(template)
    for place in range(len(values), 0, -1):
        out = f"replace({out}, '%{place}$s', {values[place - 1]})"
    return out


_RULE_CATEGORIES = sql.quoted(", ".join([*fv.CATEGORY_KEYWORDS, "Unclassified"]))
_PROMPT_TEXTS = f"""
WITH {sql.RECEIPTS}, v AS (SELECT * REPLACE (CASE WHEN order_key % 3 <> 0 THEN vendor END AS vendor) FROM txt)
SELECT order_key,
  sha256({_filled(fv.EXTRACTION_PROMPT, "'NZD'", sql.quoted(', '.join(fv.PROMPT_CATEGORIES)), 'receipt_text')}) AS extraction,
  sha256({_filled(fv.DATASET_PROMPT, 'receipt_text')}) AS dataset,
  sha256({_filled(fv.CATEGORY_PROMPT, _RULE_CATEGORIES, "coalesce(vendor, 'Unknown')", "array_to_string(list_transform(items, lambda i: '- ' || i.name), chr(10))", 'receipt_text')}) AS category,
  sha256({_filled(fv.DATASET_CATEGORY_PROMPT, _RULE_CATEGORIES, "(coalesce('Vendor: ' || vendor || chr(10), '') || CASE WHEN len(items) > 0 THEN 'Items: ' || array_to_string(list_transform(items, lambda i: i.name), ', ') || chr(10) ELSE '' END)", 'receipt_text')}) AS dataset_category
FROM v
"""


def expense_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every order as receipt text, read back, categorised and summed."""
    parsed = parse_texts(clean_and_key(receipt_texts(spark, sf_dir)), strict=True)
    return summarize(parsed).select(
        "category", "month", "receipts",
        F.col("spend").cast("double").alias("spend"), F.col("gst").cast("double").alias("gst"),
    )


_EXPENSE_SUMMARY = f"""
WITH {sql.RECEIPTS},
s AS (SELECT order_key, total, d, lower('  ' || receipt_text) AS search FROM txt),
{sql.categorized('s', 'order_key', 'search', fv.CATEGORY_KEYWORDS)}
SELECT coalesce(category, 'Unclassified') AS category, substring(d, 1, 7) AS month,
  count(*) AS receipts, CAST(sum(total) AS DOUBLE) AS spend,
  CAST(sum(CAST({sql.gst_of('total')} AS DECIMAL(18,2))) AS DOUBLE) AS gst
FROM s LEFT JOIN cat ON s.order_key = cat.order_key GROUP BY 1, 2
"""


def expense_by_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same summary over structured receipts by vendor and month."""
    receipts = receipts_from_orders(spark, sf_dir)
    return summarize(receipts, ("vendor", "month")).select(
        "vendor", "month", "receipts",
        F.col("spend").cast("double").alias("spend"), F.col("gst").cast("double").alias("gst"),
    )


_EXPENSE_BY_VENDOR = f"""
WITH {sql.RECEIPTS}
SELECT vendor, substring(d, 1, 7) AS month, count(*) AS receipts,
  CAST(sum(total) AS DOUBLE) AS spend, CAST(sum(gst) AS DOUBLE) AS gst FROM rec GROUP BY 1, 2
"""

QUERIES = {
    "render_text": (render_text, _RENDER_TEXT),
    "render_parse_roundtrip": (render_parse_roundtrip, _RENDER_PARSE_ROUNDTRIP),
    "fallback_published": (fallback_published, _FALLBACK_PUBLISHED),
    "totals_gst": (totals_gst, _TOTALS_GST),
    "categorize_default": (categorize_default, _category_oracle(fv.CATEGORY_KEYWORDS)),
    "categorize_model": (categorize_model, _CATEGORIZE_MODEL),
    "categorize_custom": (categorize_custom, _category_oracle(_CUSTOM_RULES)),
    "rule_catalogue": (rule_catalogue, _RULE_CATALOGUE),
    "validate_warnings": (validate_warnings, _VALIDATE_WARNINGS),
    "valid_flag": (valid_flag, _VALID_FLAG),
    "confidence": (confidence, _CONFIDENCE),
    "receipt_output_json": (receipt_output_json, _RECEIPT_OUTPUT_JSON),
    "model_decode": (model_decode, _MODEL_DECODE),
    "prompts": (prompt_texts, _PROMPT_TEXTS),
    "expense_summary": (expense_summary, _EXPENSE_SUMMARY),
    "expense_by_vendor": (expense_by_vendor, _EXPENSE_BY_VENDOR),
}

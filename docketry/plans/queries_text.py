"""Registered queries: text, dates, amounts, vendors, items."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry import schemas
from docketry.functions import amounts, dates, text
from docketry.functions.items import normalize_items
from docketry.operators.clean import clean_and_key, duplicate_groups
from docketry.plans import oracle_sql as sql
from docketry.sources.orders import line_price, order_lines, table, vendor_of


def text_clean_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", spread=True).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("id"),
        "text",
    )
    keyed = clean_and_key(documents.unionByName(turns), "text")
    return keyed.select(
        "id",
        F.length("clean_text").alias("clean_length"),
        text.text_hash(F.col("clean_text")).alias("clean_hash"),
        F.col("request_hash").alias("normalized_hash"),
    )


_TEXT_CLEAN_NORMALIZE = f"""
WITH t AS (
  SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations
), c AS (SELECT id, {sql.clean('text')} AS c FROM t)
SELECT id, CAST(length(c) AS INTEGER) AS clean_length, sha256(c) AS clean_hash,
       sha256({sql.normalized('c')}) AS normalized_hash
FROM c
"""


def text_currency_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.extract_currency(F.col("text")).alias("currency"))


_TEXT_CURRENCY_SYMBOL = """
SELECT doc_id, CASE WHEN contains(text, '$') THEN 'AUD' WHEN contains(text, '€') THEN 'EUR'
  WHEN contains(text, '£') THEN 'GBP' WHEN contains(text, '¥') THEN 'JPY' END AS currency
FROM documents
"""


def hash_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(clean_and_key(table(spark, sf_dir, "documents", spread=True), "text"), "doc_id")


_HASH_DUP_GROUPS = f"""
WITH c AS (SELECT doc_id, {sql.clean('text')} AS c FROM documents)
SELECT sha256({sql.normalized('c')}) AS request_hash, count(*) AS copies, min(doc_id) AS first_id
FROM c GROUP BY 1
"""


def _printed_date(style: Column, date: Column) -> Column:
    layouts = [
        "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "dd-MM-yyyy", "MM-dd-yyyy", "dd/MM/yyyy",
        "MM/dd/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d, yyyy",
        "'Date: 'yyyy-MM-dd 09:12", "'Invoice date- 'dd/MM/yyyy 'till 4'", "dd/MM/yy",
    ]
    printed = F.when(style == 0, F.date_format(date, layouts[0]))
    for place, layout in enumerate(layouts[1:], 1):
        printed = printed.when(style == place, F.date_format(date, layout))
    return printed


def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = _printed_date(F.col("o_orderkey") % 14, F.col("o_orderdate"))
    return (
        table(spark, sf_dir, "orders", spread=True)
        .select(F.col("o_orderkey").alias("order_key"), printed.alias("printed"))
        .select("order_key", dates.normalize_date(F.col("printed")).alias("iso_date"))
    )


_DATE_FORMATS = """
SELECT o_orderkey AS order_key,
  CASE WHEN o_orderkey % 14 = 13 THEN NULL
       WHEN o_orderkey % 14 IN (4, 6) AND day(o_orderdate) <= 12
       THEN strftime(o_orderdate, '%Y-%d-%m')
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso_date
FROM orders
"""


def date_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    style = F.col("o_orderkey") % 5
    sentence = (
        F.when(style == 0, F.concat(F.lit("Paid on "), F.date_format(d, "d/M/yyyy"), F.lit(", thanks")))
        .when(style == 1, F.concat(F.lit("ref 12345 ("), F.date_format(d, "yyyy-MM-dd"), F.lit(")")))
        .when(style == 2, F.concat(F.lit("on "), F.date_format(d, "d MMMM yyyy"), F.lit(".")))
        .when(style == 3, F.concat(F.lit("1/13/77 then "), F.date_format(d, "yyyy/M/d")))
        .otherwise(F.lit("no day given, call 555-1234"))
    )
    return (
        table(spark, sf_dir, "orders", spread=True)
        .select(F.col("o_orderkey").alias("order_key"), sentence.alias("sentence"))
        .select("order_key", dates.date_from_text(F.col("sentence")).alias("iso_date"))
    )


_DATE_FROM_TEXT = """
SELECT o_orderkey AS order_key,
  CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso_date
FROM orders
"""


def amount_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", spread=True).select("l_orderkey", line_price().alias("p"))
    style, p = F.col("l_orderkey") % 7, F.col("p")
    grouped = F.format_number(p, 2)
    printed = (
        F.when(style == 0, F.concat(F.lit("$"), grouped))
        .when(style == 1, F.concat(F.translate(grouped, ",.", ".,"), F.lit(" EUR")))
        .when(style == 2, p.cast("string"))
        .when(style == 3, F.translate(p.cast("string"), ".", ","))
        .when(style == 4, F.format_number(F.floor(p), 0))
        .when(style == 5, F.concat(p.cast("string"), F.lit("5")))
        .otherwise(F.concat(F.lit("("), p.cast("string"), F.lit(") AUD")))
    )
    read = lines.select("l_orderkey", amounts.normalize_amount(printed).alias("amount"))
    return read.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.sum("amount").cast("double").alias("amount_sum"),
        F.count("amount").alias("amounts"),
    )


_AMOUNT_FORMATS = f"""
WITH p AS (SELECT l_orderkey, {sql.PRICE} AS p FROM lineitem),
r AS (
  SELECT l_orderkey, CAST(CASE l_orderkey % 7 WHEN 4 THEN floor(p) WHEN 5 THEN p + 0.01 ELSE p END
    AS DECIMAL(18,2)) AS amount FROM p)
SELECT l_orderkey AS order_key, CAST(sum(amount) AS DOUBLE) AS amount_sum, count(amount) AS amounts
FROM r GROUP BY 1
"""


def vendor_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    plain = vendor_of(key)
    scanned = (
        F.when(key % 4 == 0, F.concat(F.lit("** "), F.lower(plain), F.lit("!")))
        .when(key % 4 == 1, F.upper(plain))
        .when(key % 4 == 2, F.concat(F.lit(" café "), plain, F.lit("_2\t")))
        .otherwise(F.lit(" -- "))
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("customer_key"), text.normalize_vendor(scanned).alias("vendor")
    )


_VENDOR_TITLE = f"""
WITH vend(vi, vendor) AS (VALUES {sql.VENDOR_VALUES}),
s AS (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '** ' || lower(vendor) || '!'
    WHEN 1 THEN upper(vendor) WHEN 2 THEN ' café ' || vendor || '_2' || chr(9) ELSE ' -- ' END AS s
  FROM customer JOIN vend ON c_custkey % {sql.N_VENDORS} = vi
), k AS (
  SELECT c_custkey,
    regexp_replace(trim(s, ' ' || chr(9)), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS k FROM s)
SELECT c_custkey AS customer_key, CASE WHEN k <> '' THEN array_to_string(list_transform(
    regexp_extract_all(k, '\\p{{L}}+|[^\\p{{L}}]+'),
    lambda r: upper(substring(r, 1, 1)) || lower(substring(r, 2))), '') END AS vendor
FROM k
"""


def items_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("l_linenumber") % 6
    price = F.col("price").cast("string")
    raw = F.struct(
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("price"),
        F.col("l_quantity"), F.col("l_shipdate"),
        F.struct(
            F.when(gap == 5, "  ").otherwise(F.col("p_name")).alias("name"),
            F.when(gap == 3, "x").otherwise(F.col("l_quantity").cast("int").cast("string"))
            .alias("quantity"),
            F.when(gap == 4, F.concat(F.lit("-"), price)).when(gap != 1, price)
            .alias("unit_price"),
            F.when(gap.isin(0, 1), price).alias("total_price"),
        ).alias("raw"),
    )
    receipts = (
        order_lines(spark, sf_dir)
        .groupBy(F.col("l_orderkey").alias("order_key"))
        .agg(F.array_sort(F.collect_list(raw)).alias("lines"))
        .select("order_key", F.transform("lines", lambda x: x["raw"]).cast(schemas.RAW_ITEMS).alias("raw"))
        .select("order_key", normalize_items(F.col("raw")).alias("items"))
    )

    def total(field, kind):
        return F.aggregate(
            "items", F.lit(0).cast(kind), lambda acc, i: (acc + i[field]).cast(kind)
        )

    return receipts.select(
        "order_key",
        F.size("items").alias("kept"),
        total("quantity", "bigint").alias("quantity_sum"),
        total("unit_price", amounts.MONEY).cast("double").alias("unit_sum"),
        total("total_price", amounts.MONEY).cast("double").alias("total_sum"),
        F.array_join(F.transform("items", lambda i: i["name"]), "/").alias("names"),
    )


_ITEMS_NORMALIZE = f"""
WITH l AS (
  SELECT *, l_linenumber % 6 AS gap, CAST(l_quantity AS BIGINT) AS q, {sql.PRICE} AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (
  SELECT *, CASE gap WHEN 1 THEN (CAST(p * 200 AS BIGINT) + q) // (2 * q)
                     ELSE CAST(p * 100 AS BIGINT) END AS unit_cents,
            CASE WHEN gap = 2 THEN CAST(p * 100 AS BIGINT) * q
                 ELSE CAST(p * 100 AS BIGINT) END AS total_cents,
            gap IN (0, 1, 2) AS keep
  FROM l)
SELECT l_orderkey AS order_key, CAST(count(*) FILTER (keep) AS INTEGER) AS kept,
  CAST(coalesce(sum(q) FILTER (keep), 0) AS BIGINT) AS quantity_sum,
  CAST(coalesce(sum(unit_cents) FILTER (keep), 0) AS BIGINT) / 100.0 AS unit_sum,
  CAST(coalesce(sum(total_cents) FILTER (keep), 0) AS BIGINT) / 100.0 AS total_sum,
  coalesce(string_agg(p_name, '/' ORDER BY l_linenumber, l_partkey, l_suppkey, p, l_quantity,
    l_shipdate) FILTER (keep), '') AS names
FROM n GROUP BY 1
"""


def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ids = events.select(
        text.random_request_id().alias("fresh"),
        text.derived_request_id(F.col("event_id")).alias("derived"),
    )
    return ids.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.length("fresh") == 36).alias("fresh_ok"),
        F.countDistinct("derived").alias("derived_distinct"),
        F.count_if(F.length("derived") == 36).alias("derived_ok"),
    )


_REQUEST_IDS = """
SELECT count(*) AS requests, count(*) AS fresh_ok, count(DISTINCT event_id) AS derived_distinct,
  count(*) AS derived_ok FROM events
"""

QUERIES = {
    "text_clean_normalize": (text_clean_normalize, _TEXT_CLEAN_NORMALIZE),
    "text_currency_symbol": (text_currency_symbol, _TEXT_CURRENCY_SYMBOL),
    "hash_dup_groups": (hash_dup_groups, _HASH_DUP_GROUPS),
    "date_formats": (date_formats, _DATE_FORMATS),
    "date_from_text": (date_from_text, _DATE_FROM_TEXT),
    "amount_formats": (amount_formats, _AMOUNT_FORMATS),
    "vendor_title": (vendor_title, _VENDOR_TITLE),
    "items_normalize": (items_normalize, _ITEMS_NORMALIZE),
    "request_ids": (request_ids, _REQUEST_IDS),
}

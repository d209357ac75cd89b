"""Registered queries: request ingest, TTL cache, the whole receipt flow."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry import fixed_values as fv
from docketry import schemas
from docketry.functions.text import text_hash
from docketry.operators.cache import DAY, cache_lookup, cache_snapshot, ttl_dedupe
from docketry.operators.clean import clean_and_key
from docketry.operators.ingest import accepted, decode_requests, rejected
from docketry.operators.validate import error_receipt
from docketry.plans import oracle_sql as sql
from docketry.plans.receipts import parse_receipts
from docketry.session import work_folder
from docketry.sources.cache_store import read_cache, update_cache
from docketry.sources.orders import table, vendor_of

SPLIT = "2024-01-16 00:00:00"


# --- ingest --------------------------------------------------------------------------

def api_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table wrapped as API events of both shapes, good and bad."""
    events = table(spark, sf_dir, "events", spread=True)
    way = F.col("event_id") % 12
    text = F.concat_ws(" ", F.lit("  Shop"), "event_type", F.lit("total:"), F.col("value").cast("string"), F.lit("\n"))
    currency = F.when(way == 7, "AUDX").when(F.col("event_id") % 5 == 0, "eur")
    fields = F.to_json(
        F.struct(
            F.when(way == 6, "  \t ").otherwise(text).alias("receipt_text"),
            currency.alias("currency"),
            F.lit("app").alias("source"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        )
    )
    body = F.concat(
        F.substr(fields, F.lit(1), F.length(fields) - 1),
        F.lit(',"metadata":'),
        F.when(way == 9, F.lit("[1]")).otherwise(F.col("props")),
        F.lit("}"),
    )
    body = (
        F.when(way == 5, F.lit("{bad"))
        .when(way == 8, F.lit('{"receipt_text":12}'))
        .when(way == 2, F.base64(F.encode(body, "UTF-8")))
        .when(way == 10, F.lit(None))
        .when(way == 11, F.lit("[1,2]"))
        .otherwise(body)
    )
    route = F.lit("/v1/receipts/parse")
    version_2 = way == 1
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.when(~version_2, F.when(way == 3, "GET").otherwise("POST")).alias("httpMethod"),
        F.when(~version_2, F.when(way == 4, "/v1/other").otherwise(route)).alias("path"),
        F.when(version_2, route).alias("rawPath"),
        F.struct(
            F.when(version_2, "prod").alias("stage"),
            F.struct(
                F.when(version_2, "POST").alias("method"),
                F.when(version_2, F.concat(F.lit("/prod"), route)).alias("path"),
            ).alias("http"),
        ).alias("requestContext"),
        body.alias("body"),
        F.when(way == 2, True).alias("isBase64Encoded"),
    )


def request_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = accepted(decode_requests(api_events(spark, sf_dir)))
    return good.select(
        "request_id", "receipt_text", "currency", "source", "user_id",
        F.get_json_object("metadata", "$.k").cast("int").alias("k"),
    )


_REQUEST_INGEST = """
SELECT CAST(event_id AS VARCHAR) AS request_id,
  'Shop ' || event_type || ' total: ' || CAST(value AS VARCHAR) AS receipt_text,
  CASE WHEN event_id % 5 = 0 THEN 'EUR' ELSE 'AUD' END AS currency, 'app' AS source,
  'u' || user_id AS user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events WHERE event_id % 12 IN (0, 1, 2)
"""


def request_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = rejected(decode_requests(api_events(spark, sf_dir)))
    error = error_receipt(F.col("request_id"), F.col("reject_reason"))
    return bad.select("request_id", "reject_kind", "reject_reason", error.alias("e")).select(
        "request_id", "reject_kind", "reject_reason",
        F.col("e.category").alias("category"), F.col("e.cache_status").alias("cache_status"),
        F.element_at("e.warnings", 1).alias("warning"),
    )


_REQUEST_REJECTS = """
WITH r AS (SELECT event_id, CASE event_id % 12
    WHEN 3 THEN 'Not Found' WHEN 4 THEN 'Not Found'
    WHEN 5 THEN 'Invalid JSON in request body'
    WHEN 6 THEN 'receipt_text cannot be empty'
    WHEN 7 THEN 'currency must be a 3-letter ISO code'
    WHEN 8 THEN 'receipt_text must be a string'
    WHEN 9 THEN 'metadata must be an object'
    WHEN 10 THEN 'receipt_text must be a string'
    WHEN 11 THEN 'Failed to process receipt' END AS reason FROM events)
SELECT CAST(event_id AS VARCHAR) AS request_id,
  CASE reason WHEN 'Not Found' THEN 'not_found' WHEN 'Failed to process receipt' THEN 'server'
    ELSE 'client' END AS reject_kind, reason AS reject_reason,
  'Unclassified' AS category, 'error' AS cache_status, reason AS warning
FROM r WHERE reason IS NOT NULL
"""


# --- cache ------------------------------------------------------------------------------

def _event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests; user and event type stand for the text."""
    text = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").cast("timestamp").alias("request_ts"),
        text.alias("text"),
        text_hash(text).alias("request_hash"),
    )


def ttl_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit or miss of every event with a one-day TTL."""
    work = work_folder(spark, "ttl")
    marked = ttl_dedupe(_event_requests(spark, sf_dir), ttl_seconds=DAY, work_path=work).requests
    return marked.select("request_id", "cache_status", "served_by")


def _redelivered(requests: DataFrame) -> DataFrame:
    """Every third request twice, as at-least-once delivery gives them."""
    return requests.unionByName(requests.filter(F.col("request_id").cast("bigint") % 3 == 0))


def _twice(sql_text: str) -> str:
    return (
        f"WITH once AS ({sql_text}) SELECT * FROM once UNION ALL "
        "SELECT * FROM once WHERE CAST(request_id AS BIGINT) % 3 = 0"
    )


def ttl_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ttl_hit_miss`` with a third of the events delivered twice."""
    requests = _redelivered(_event_requests(spark, sf_dir))
    marked = ttl_dedupe(requests, ttl_seconds=DAY).requests
    return marked.select("request_id", "cache_status", "served_by")


# requests of one key per second, the next possible miss of each, and the chain of misses
_CHAIN = f"""
s AS (
  SELECT user_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec,
         arg_min(event_id, (ts, CAST(event_id AS VARCHAR))) AS first_id
  FROM {{events}} GROUP BY ALL),
nxt AS (
  SELECT s.user_id, s.event_type, s.sec, min(n.sec) AS next_sec FROM s JOIN s AS n
  ON s.user_id = n.user_id AND s.event_type = n.event_type AND s.sec + {DAY} <= n.sec
  GROUP BY ALL),
chain AS (
  SELECT user_id, event_type, min(sec) AS sec FROM s GROUP BY ALL
  UNION ALL
  SELECT c.user_id, c.event_type, n.next_sec FROM chain c JOIN nxt n
    ON c.user_id = n.user_id AND c.event_type = n.event_type AND c.sec = n.sec),
opened AS (
  SELECT c.*, s.first_id FROM chain c JOIN s
    ON c.user_id = s.user_id AND c.event_type = s.event_type AND c.sec = s.sec),
marked AS (
  SELECT e.event_id, arg_max(o.first_id, o.sec) AS first_id FROM {{events}} e JOIN opened o
    ON e.user_id = o.user_id AND e.event_type = o.event_type
    AND CAST(floor(epoch_us(e.ts) / 1000000) AS BIGINT) >= o.sec
  GROUP BY e.event_id)"""

_TTL_HIT_MISS = f"""
WITH RECURSIVE {_CHAIN.format(events='events')}
SELECT CAST(event_id AS VARCHAR) AS request_id,
  CASE WHEN first_id = event_id THEN 'miss' ELSE 'hit' END AS cache_status,
  CAST(first_id AS VARCHAR) AS served_by
FROM marked
"""


def _event_cache(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Cache left behind by the requests before the split, all still listed."""
    second = F.unix_seconds("request_ts")
    return (
        requests.filter(F.col("request_ts") < F.lit(SPLIT).cast("timestamp"))
        .groupBy("request_hash")
        .agg(
            F.first("text").alias("receipt_text"),
            F.to_json(F.struct(F.first("text").alias("vendor"))).alias("response"),
            (F.max(second) + F.lit(ttl_seconds)).alias("ttl"),
        )
    )


def cache_lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _event_requests(spark, sf_dir)
    cache = _event_cache(requests, 5 * DAY)
    later = requests.filter(F.col("request_ts") >= F.lit(SPLIT).cast("timestamp"))
    return cache_lookup(later, cache).select(
        "request_id", "cache_status", "cached_ttl",
        F.get_json_object("cached_response", "$.vendor").alias("vendor"),
    )


_CACHE = f"""
cache AS (
  SELECT user_id, event_type,
    max(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) + {5 * DAY} AS ttl
  FROM events WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY ALL)"""
_CACHE_LOOKUP = f"""
WITH {_CACHE},
j AS (
  SELECT e.*, CASE WHEN epoch_us(e.ts) / 1000000 < ttl AND floor(epoch_us(e.ts) / 1000000) < ttl
    THEN ttl END AS live
  FROM events e LEFT JOIN cache c ON e.user_id = c.user_id AND e.event_type = c.event_type
  WHERE e.ts >= TIMESTAMP '{SPLIT}')
SELECT CAST(event_id AS VARCHAR) AS request_id,
  CASE WHEN live IS NULL THEN 'miss' ELSE 'hit' END AS cache_status, live AS cached_ttl,
  CASE WHEN live IS NOT NULL THEN user_id || '-' || event_type END AS vendor
FROM j
"""


def ttl_with_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit or miss after the split, starting from the cache of the time before."""
    requests = _event_requests(spark, sf_dir)
    later = requests.filter(F.col("request_ts") >= F.lit(SPLIT).cast("timestamp"))
    marked = ttl_dedupe(later, _event_cache(requests, 5 * DAY), DAY).requests
    return marked.select("request_id", "cache_status", "from_cache")


_TTL_WITH_CACHE = f"""
WITH RECURSIVE {_CACHE},
live AS (
  SELECT e.* FROM events e LEFT JOIN cache c
    ON e.user_id = c.user_id AND e.event_type = c.event_type
  WHERE e.ts >= TIMESTAMP '{SPLIT}'
    AND (c.ttl IS NULL OR floor(epoch_us(e.ts) / 1000000) >= c.ttl)),
{_CHAIN.format(events='live')}
SELECT CAST(event_id AS VARCHAR) AS request_id,
  CASE WHEN first_id = event_id THEN 'miss' ELSE 'hit' END AS cache_status,
  FALSE AS from_cache
FROM marked
UNION ALL
SELECT CAST(event_id AS VARCHAR), 'hit', TRUE FROM events
WHERE ts >= TIMESTAMP '{SPLIT}' AND event_id NOT IN (SELECT event_id FROM live)
"""


def cache_snapshot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _event_requests(spark, sf_dir)
    written = (
        requests.filter(F.col("request_ts") >= F.lit(SPLIT).cast("timestamp"))
        .select(
            "request_hash", F.col("text").alias("receipt_text"), F.lit("{}").alias("response"),
            (F.unix_seconds("request_ts") + F.lit(DAY)).alias("ttl"),
        )
    )
    now = F.unix_seconds(F.lit("2024-01-18 00:00:00").cast("timestamp"))
    return cache_snapshot(_event_cache(requests, 5 * DAY), written, now).select(
        "receipt_text", "ttl", F.col("response").alias("response")
    )


_CACHE_SNAPSHOT = f"""
WITH {_CACHE},
both_ AS (
  SELECT user_id || '-' || event_type AS t, ttl, 0 AS g,
    '{{"vendor":"' || user_id || '-' || event_type || '"}}' AS response FROM cache
  UNION ALL
  SELECT user_id || '-' || event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + {DAY}, 1, '{{}}'
  FROM events WHERE ts >= TIMESTAMP '{SPLIT}'),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY g DESC, ttl DESC) AS rn FROM both_
  WHERE ttl > epoch(TIMESTAMP '2024-01-18 00:00:00'))
SELECT t AS receipt_text, ttl, response FROM r WHERE rn = 1
"""


def cache_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cache stored in buckets and updated twice in a row."""
    requests = _event_requests(spark, sf_dir)
    path = f"{work_folder(spark, 'cache')}/stored"
    update_cache(spark, path, _event_cache(requests, 5 * DAY), F.lit(0))
    later = requests.filter(F.col("request_ts") >= F.lit(SPLIT).cast("timestamp"))
    some = later.filter(F.startswith("request_hash", F.lit("0"))).select(
        "request_hash", F.col("text").alias("receipt_text"), F.lit("{}").alias("response"),
        (F.unix_seconds("request_ts") + F.lit(DAY)).alias("ttl"),
    )
    update_cache(spark, path, some, F.lit(0))
    return read_cache(spark, path).select("receipt_text", "ttl", "response")


_CACHE_UPDATES = f"""
WITH {_CACHE},
both_ AS (
  SELECT user_id || '-' || event_type AS t, ttl, 0 AS g,
    '{{"vendor":"' || user_id || '-' || event_type || '"}}' AS response FROM cache
  UNION ALL
  SELECT user_id || '-' || event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + {DAY}, 1, '{{}}'
  FROM events WHERE ts >= TIMESTAMP '{SPLIT}' AND sha256(user_id || '-' || event_type) LIKE '0%'),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY g DESC, ttl DESC) AS rn FROM both_)
SELECT t AS receipt_text, ttl, response FROM r WHERE rn = 1
"""


# --- the whole flow --------------------------------------------------------------------

def _flow_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendor = vendor_of(F.col("user_id"))
    text = F.concat_ws(
        " ", F.lit("Bought at"), vendor, F.lit(". 05/01/2024"), "event_type", F.lit("total:"),
        F.concat(F.length("event_type").cast("string"), F.lit(".50")),
        F.concat(F.lit("no"), F.col("user_id").cast("string")),
    )
    return table(spark, sf_dir, "events", spread=True).select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").cast("timestamp").alias("request_ts"),
        F.col("user_id").cast("string").alias("user_id"),
        text.alias("receipt_text"),
        F.when(F.col("event_id") % 2 == 0, "NZD").alias("currency"),
    )


def parse_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests -> receipts with model output for a third of the texts.

    Repeated texts are parsed once; a hit returns the receipt of the request
    that opened the entry, with that request's currency.
    """
    return _flow(_flow_requests(spark, sf_dir))


def parse_flow_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``parse_flow`` with a third of the events delivered twice: one receipt
    for every row, texts parsed once."""
    return _flow(_redelivered(_flow_requests(spark, sf_dir)))


def parse_flow_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later requests, answered with the cache that the earlier ones left."""
    requests = _flow_requests(spark, sf_dir)
    split = F.lit(SPLIT).cast("timestamp")
    first = _flow_batch(requests.filter(F.col("request_ts") < split))
    empty = spark.createDataFrame([], schemas.CACHE)
    folder = f"{work_folder(spark, 'cache')}/next"
    cache_snapshot(empty, first.written, F.unix_seconds(split)).write.parquet(folder)
    later = requests.filter(F.col("request_ts") >= split)
    return _answers(_flow_batch(later, spark.read.schema(schemas.CACHE).parquet(folder)))


def _flow(requests: DataFrame) -> DataFrame:
    return _answers(_flow_batch(requests))


def _flow_batch(requests: DataFrame, cache: DataFrame | None = None):
    spark = requests.sparkSession
    user = F.col("user_id").cast("int")
    answer = F.to_json(
        F.struct(
            F.lit("model shop").alias("vendor"),
            F.lit("2024-02-03").alias("receipt_date"),
            F.array(
                F.struct(F.lit("Coffee").alias("name"), F.lit(2).alias("quantity"),
                         F.lit(1.25).alias("unit_price"))
            ).alias("items"),
            F.when(user % 2 == 0, F.lit(-5.0)).alias("total_amount"),
        )
    )
    responses = (
        clean_and_key(requests.filter(user % 3 == 0))
        .select(
            "request_hash",
            F.to_json(F.struct(F.array(F.struct(answer.alias("text"))).alias("content")))
            .alias("body"),
        )
        .distinct()
    )
    return parse_receipts(requests, responses, cache, parsed_path=work_folder(spark, "parsed"))


def _answers(batch) -> DataFrame:
    return batch.receipts.select(
        "request_id", "cache_status", "vendor", "receipt_date", "currency", "category",
        F.size("items").alias("n_items"),
        F.col("total_amount").cast("double").alias("total"),
        F.col("gst_amount").cast("double").alias("gst"),
        F.round("confidence_score", 6).alias("confidence"),
    )


def _kept_letters(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(trim({text}), '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda r: upper(substring(r, 1, 1)) || lower(substring(r, 2))), '')"
    )


_PARSE_FLOW = f"""
WITH vend(vi, vendor) AS (VALUES {sql.VENDOR_VALUES}),
q AS (
  SELECT e.*, v.vendor, user_id % 3 = 0 AS model, user_id % 6 = 0 AS refused,
    row_number() OVER w AS rn, first_value(event_id) OVER w AS opener,
    CAST(length(event_type) AS DECIMAL(18,2)) + 0.50 AS t
  FROM events e JOIN vend v ON user_id % {sql.N_VENDORS} = vi
  WINDOW w AS (PARTITION BY user_id, event_type
               ORDER BY floor(epoch_us(ts) / 1000000), ts, CAST(event_id AS VARCHAR))),
f AS (
  SELECT *, CASE WHEN model THEN 'Model Shop' ELSE nullif({_kept_letters("regexp_extract('at ' || vendor || ' .', '(?i)(?:from|at)\\s+([A-Z][a-zA-Z\\s]+)', 1)")}, '') END AS v,
    CASE WHEN model THEN 2.50 ELSE t END AS total
  FROM q),
x AS (SELECT *, lower(coalesce(v, '') || CASE WHEN model THEN ' coffee' ELSE ' ' END
    || ' Bought at ' || vendor || ' . 05/01/2024 ' || event_type || ' total: ' || length(event_type)
    || '.50 no' || user_id) AS search FROM f),
{sql.categorized('x', 'event_id', 'search', fv.CATEGORY_KEYWORDS)}
SELECT CAST(x.event_id AS VARCHAR) AS request_id,
  CASE WHEN refused THEN 'error' WHEN x.rn = 1 THEN 'miss' ELSE 'hit' END AS cache_status,
  CASE WHEN NOT refused THEN v END AS vendor,
  CASE WHEN refused THEN NULL WHEN model THEN '2024-02-03' ELSE '2024-01-05' END AS receipt_date,
  CASE WHEN refused OR model OR opener % 2 = 1 THEN 'AUD' ELSE 'NZD' END AS currency,
  CASE WHEN refused OR n IS NULL THEN 'Unclassified' ELSE category END AS category,
  CASE WHEN model AND NOT refused THEN 1 ELSE 0 END AS n_items,
  CASE WHEN NOT refused THEN CAST(total AS DOUBLE) END AS total,
  CASE WHEN NOT refused THEN CAST({sql.gst_of('total')} AS DOUBLE) END AS gst,
  CASE WHEN refused THEN 0.0 ELSE round((CASE WHEN v IS NULL THEN 0 ELSE 0.8::DOUBLE END + 0.9 + 0.95 + 0.9
    + CASE WHEN model THEN 0.1 ELSE 0 END + least(coalesce(n, 0) * 0.3::DOUBLE, 1.0)) / 6, 6) END AS confidence
FROM x LEFT JOIN cat ON x.event_id = cat.event_id
"""


_DIGITS = (9, 16, 17, 30, 40)


def parse_wide_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of up to 40 digits, from the text and from a model: those that money
    has no room for are error rows with the reason."""
    size = F.element_at(F.array(*[F.lit(n) for n in _DIGITS]), (F.col("event_id") % 5 + 1).cast("int"))
    total = F.concat(F.repeat(F.lit("7"), size), F.lit(".25"))
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").cast("timestamp").alias("request_ts"),
        F.lit("u").alias("user_id"),
        F.concat_ws(" ", F.lit("Shop total:"), total, F.lit("no"), F.col("event_id").cast("string")).alias("receipt_text"),
        F.lit(None).cast("string").alias("currency"),
        total.alias("total"), (F.col("event_id") % 3 == 0).alias("model"),
    )
    body = F.to_json(F.struct(F.array(F.struct(
        F.to_json(F.struct(F.lit("Shop").alias("vendor"), F.col("total").alias("total_amount"))).alias("text")
    )).alias("content")))
    responses = clean_and_key(requests.filter("model")).select("request_hash", body.alias("body"))
    batch = parse_receipts(
        requests.drop("total", "model"), responses, parsed_path=work_folder(spark, "parsed")
    )
    return batch.receipts.select(
        "request_id", "cache_status", F.col("total_amount").cast("string").alias("total"),
        F.array_join("warnings", "; ").alias("warnings"),
    ).withColumn("warnings", F.when(F.col("cache_status") == "error", F.col("warnings")))


_PARSE_WIDE_AMOUNTS = f"""
SELECT CAST(event_id AS VARCHAR) AS request_id, CASE WHEN n > 16 THEN 'error' ELSE 'miss' END AS cache_status,
  CASE WHEN n <= 16 THEN repeat('7', n) || '.25' END AS total,
  CASE WHEN n > 16 THEN 'Invalid request data: amount of more than 16 digits' END AS warnings
FROM (SELECT *, {list(_DIGITS)}[event_id % 5 + 1] AS n FROM events)
"""

# Entries live for 30 days, longer than the events last: what the cache answers is
# what one batch over all requests would.
_PARSE_FLOW_CACHED = f"""
WITH once AS ({_PARSE_FLOW})
SELECT once.* FROM once JOIN events ON request_id = CAST(event_id AS VARCHAR) WHERE ts >= TIMESTAMP '{SPLIT}'
"""

QUERIES = {
    "parse_wide_amounts": (parse_wide_amounts, _PARSE_WIDE_AMOUNTS),
    "parse_flow_cached": (parse_flow_cached, _PARSE_FLOW_CACHED),
    "request_ingest": (request_ingest, _REQUEST_INGEST),
    "request_rejects": (request_rejects, _REQUEST_REJECTS),
    "ttl_hit_miss": (ttl_hit_miss, _TTL_HIT_MISS),
    "ttl_duplicates": (ttl_duplicates, _twice(_TTL_HIT_MISS)),
    "ttl_with_cache": (ttl_with_cache, _TTL_WITH_CACHE),
    "cache_lookup": (cache_lookup_query, _CACHE_LOOKUP),
    "cache_updates": (cache_updates, _CACHE_UPDATES),
    "cache_snapshot": (cache_snapshot_query, _CACHE_SNAPSHOT),
    "parse_flow": (parse_flow, _PARSE_FLOW),
    "parse_flow_duplicates": (parse_flow_duplicates, _twice(_PARSE_FLOW)),
}

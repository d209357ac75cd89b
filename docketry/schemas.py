"""Row layouts of the tables the jobs read and write (Spark DDL)."""

from docketry.fixed_values import FIELDS

ITEM = "struct<name:string,quantity:int,unit_price:decimal(18,2),total_price:decimal(18,2)>"
ITEMS = f"array<{ITEM}>"
RAW_ITEM = "struct<name:string,quantity:string,unit_price:string,total_price:string>"
RAW_ITEMS = f"array<{RAW_ITEM}>"

REQUESTS = (
    "request_id string, request_ts timestamp, receipt_text string, source string, "
    "currency string, user_id string, metadata string"
)

API_EVENTS = (
    "event_id string, event_ts timestamp, httpMethod string, path string, rawPath string, "
    "requestContext struct<stage:string,http:struct<method:string,path:string>>, "
    "body string, isBase64Encoded boolean"
)

MODEL_RESPONSES = "request_hash string, body string"

CACHE = "request_hash string, receipt_text string, response string, ttl bigint"

RESULTS = "test_name string, run_ts bigint, field string, score double"

RULES = "cat_order int, category string, kw_order int, keyword string"

# amounts inside the cached JSON are strings, as they are in the API output
CACHED_RESPONSE = (
    "struct<vendor:string,receipt_date:string,"
    "items:array<struct<name:string,quantity:int,unit_price:string,total_price:string>>,"
    "subtotal_amount:string,total_amount:string,gst_amount:string,currency:string,"
    "category:string,categorization_source:string,categorization_reason:string,"
    "matched_keywords:array<string>,confidence_score:double,cache_status:string,"
    "request_id:string,warnings:array<string>>"
)

RECEIPT_COLUMNS = (
    "vendor", "receipt_date", "items", "subtotal_amount", "total_amount", "gst_amount",
    "currency", "category", "categorization_source", "categorization_reason",
    "matched_keywords", "confidence_score", "cache_status", "request_id", "warnings",
)

# prediction / truth fields; amounts and prices arrive as numbers or strings
SCORED_ITEMS = "array<struct<name:string,quantity:string,unit_price:string,total_price:string>>"
SCORED_TYPES = {f: SCORED_ITEMS if f == "items" else "string" for f in FIELDS}
SCORED = "struct<" + ",".join(f"{f}:{t}" for f, t in SCORED_TYPES.items()) + ">"

# one prediction, truth or dataset record; the eight fields are nested under
# expected_output or sit at the top level
SAMPLES = (
    "request_id string, receipt_text string, clean_text string, "
    f"expected_output {SCORED}, "
    "metadata struct<id:string,scenario:string,complexity:string,noise_level:double,"
    "has_gst:boolean,dataset_id:string,sample_id:string>, "
    + ", ".join(f"{f} {t}" for f, t in SCORED_TYPES.items())
)

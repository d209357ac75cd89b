"""The stored cache: updates touch only their buckets."""

import os

from pyspark.sql import functions as F

from docketry import schemas
from docketry.operators.cache import cache_lookup, cache_snapshot
from docketry.sources import cache_store


def _rows(spark, numbers, ttl, response):
    rows = spark.createDataFrame([(n,) for n in numbers], "n int")
    return rows.select(F.sha2(F.col("n").cast("string"), 256).alias("request_hash"), F.lit("t").alias("receipt_text"),
                       F.lit(response).alias("response"), F.lit(ttl).cast("bigint").alias("ttl"))


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path, now = f"{tmp_path}/cache", F.lit(50)
    first, second = _rows(spark, range(400), 100, "one"), _rows(spark, range(395, 402), 200, "two")
    assert len(cache_store.update_cache(spark, path, first, now)) > 100
    before = _files(path)
    touched = cache_store.update_cache(spark, path, second, now)
    after = _files(path)
    assert 0 < len(touched) <= 7
    mine = {f for f in before if any(f"/bucket={b}/" in f for b in touched)}
    assert all(after[f] == before[f] for f in before if f not in mine) and not mine & set(after)
    assert {f for f in after if f not in before} and all(any(f"/bucket={b}/" in f for b in touched) for f in set(after) - set(before))
    want = cache_snapshot(cache_snapshot(spark.createDataFrame([], schemas.CACHE), first, now), second, now)
    got = cache_store.read_cache(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert cache_store.update_cache(spark, path, second.limit(0), now) == [] and _files(path) == after


def test_expired_rows_go_with_their_bucket(spark, tmp_path):
    path = f"{tmp_path}/cache"
    cache_store.update_cache(spark, path, _rows(spark, [1], 100, "old"), F.lit(0))
    cache_store.update_cache(spark, path, _rows(spark, [1], 90, "expired"), F.lit(95))
    assert [r.response for r in cache_store.read_cache(spark, path).collect()] == ["old"]


def test_lookup_reads_the_buckets_asked_for(spark, tmp_path):
    path = f"{tmp_path}/cache"
    cache = _rows(spark, range(300), 100, "{}")
    requests = _rows(spark, [5, 6, 900], 0, "").select("request_hash", F.lit(60).cast("timestamp").alias("request_ts"))
    assert cache_store.lookup_stored(requests, path).filter("cache_status = 'hit'").count() == 0
    cache_store.update_cache(spark, path, cache, F.lit(50))
    found = cache_store.lookup_stored(requests, path)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, cache_lookup(requests, cache).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("bucket#", "bucket") or "bucket#" in plan.split("PartitionFilters")[1]

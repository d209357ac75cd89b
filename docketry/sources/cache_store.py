"""The receipt cache on shared storage, in buckets by hash prefix.

An update rewrites only the buckets that new rows fall into, so its cost follows
the new rows and not the cache.  Expired rows of other buckets stay until their
bucket is written next; lookups ignore them.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry import schemas
from docketry.operators.cache import cache_lookup, cache_snapshot
from docketry.session import work_folder
from docketry.sources.datasets import exists

#: Hex digits of the hash that name a bucket; each digit makes 16 times the buckets.
DIGITS = 2
_STORED = f"{schemas.CACHE}, bucket string"


def bucket_of(request_hash: Column, digits: int = DIGITS) -> Column:
    """Buckets begin with a letter, so that no reader takes them for numbers."""
    return F.concat(F.lit("b"), F.substring(request_hash, 1, digits))


def _touched(rows: DataFrame, digits: int) -> list[str]:
    """The buckets of some rows, at most ``16 ** digits`` names."""
    return sorted(r[0] for r in rows.select(bucket_of(F.col("request_hash"), digits)).distinct().collect())


def read_cache(spark: SparkSession, path: str, buckets: list[str] | None = None) -> DataFrame:
    """The stored cache, or some buckets of it: the others are not listed in the scan."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.CACHE)
    rows = spark.read.schema(_STORED).parquet(path)
    return (rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).drop("bucket")


def update_cache(spark: SparkSession, path: str, written: DataFrame, now: Column, digits: int = DIGITS) -> list[str]:
    """Put new rows into the stored cache; returns the buckets that were rewritten.

    The new rows are written once before they are used.  The next buckets are
    written aside and put in place by a second job, which replaces whole buckets:
    a failure before it leaves the cache as it was, and running it again gives the
    same buckets.
    """
    aside = work_folder(spark, "cache-update")
    written.select(*[f.name for f in spark.createDataFrame([], schemas.CACHE).schema]).filter(
        "request_hash IS NOT NULL"
    ).write.parquet(f"{aside}/new")
    new = spark.read.schema(schemas.CACHE).parquet(f"{aside}/new")
    touched = _touched(new, digits)
    if not touched:
        return []
    following = cache_snapshot(read_cache(spark, path, touched), new, now)
    kept = following.withColumn("bucket", bucket_of(F.col("request_hash"), digits))
    kept.write.partitionBy("bucket").parquet(f"{aside}/next")
    staged = spark.read.schema(_STORED).parquet(f"{aside}/next")
    # One writer for each bucket makes one file of it; buckets are many and alike.
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket"
    ).parquet(path)
    return touched


def lookup_stored(requests: DataFrame, path: str, digits: int = DIGITS) -> DataFrame:
    """``cache_lookup`` against the stored cache, reading only the buckets asked for."""
    spark = requests.sparkSession
    return cache_lookup(requests, read_cache(spark, path, _touched(requests, digits)))

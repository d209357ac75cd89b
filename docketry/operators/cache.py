"""Receipt cache as a table: hit/miss per request, lookup, next snapshot.

A request is a miss when no live entry exists for its text hash; it then opens
an entry that serves later requests until ``ttl_seconds`` have passed.  A hit
does not extend the entry.  The clock is event time in whole seconds.

An entry is known by its hash and the second it was opened in, never by the id
of a request, as ids repeat when events are delivered again.  An exact repeat of
the opening event (same id and time) reads as the miss it repeats.
"""

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docketry import schemas

DAY = 86400
DEFAULT_TTL_SECONDS = 30 * DAY

# requests joined to one copy of a response; a response that serves more is
# copied once per chunk, so a hot text is spread over many join keys
CHUNK = 500_000


class Deduped(NamedTuple):
    """``requests`` know what serves them; ``servers`` has a row per entry used."""

    requests: DataFrame
    servers: DataFrame


_FOLDED = (
    "request_hash string, _second bigint, served_by string, opened_at bigint, "
    "from_cache boolean, chunk bigint"
)


def _fold(ttl_seconds: int, chunk_rows: int):
    """Walk the seconds of each hash in order, batch by batch.

    Only the current entry is held, so a partition of any length needs the
    memory of one batch.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = expiry = entry = None
        served = 0
        for batch in batches:
            out = []
            for key, second, first_id, n, ttl in zip(
                batch["request_hash"], batch["_second"], batch["_first_id"], batch["_n"],
                batch["_ttl"], strict=True,
            ):
                if key != current:
                    current, expiry, entry = key, None, None
                if first_id is None:
                    expiry = int(ttl) if expiry is None else max(expiry, int(ttl))
                    entry, served = (key, None, True), 0
                    continue
                second = int(second)
                if expiry is None or second >= expiry:
                    expiry, entry, served = second + ttl_seconds, (first_id, second, False), 0
                out.append((key, second, *entry, served // chunk_rows))
                served += int(n)
            frame = pd.DataFrame(
                out,
                columns=[
                    "request_hash", "_second", "served_by", "opened_at", "from_cache", "chunk",
                ],
            )
            yield frame.astype({"opened_at": "Int64"})

    return walk


def entry_key(from_cache: Column, opened_at: Column, request_hash: Column, request_id: Column) -> Column:
    """The name of an entry: its hash with ``cache``, the second it was opened
    in, or the request that has no time."""
    when = F.when(from_cache, "cache").otherwise(
        F.coalesce(opened_at.cast("string"), F.concat(F.lit("id:"), F.coalesce(request_id, F.lit(""))))
    )
    return F.concat_ws("@", request_hash, when)


def _kept(rows: DataFrame, path: str | None, name: str) -> DataFrame:
    """``rows`` written below ``path`` and read back, if there is one."""
    if path is None:
        return rows
    rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}")


def ttl_dedupe(
    requests: DataFrame,
    cache: DataFrame | None = None,
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
    chunk_rows: int = CHUNK,
    work_path: str | None = None,
) -> Deduped:
    """Hit or miss for every request, from its ``request_hash`` and ``request_ts``.

    Requests of one hash are first merged to one row per second, with partial
    aggregation before the shuffle: within a second only the earliest can be a
    miss.  A hash without cached entry whose seconds all lie within one TTL has
    one entry, opened in the first of them; that needs no walk.  The ordered
    walk sees the other hashes only, at most 86 400 rows per day of input for
    one hash, however often its text was sent.

    Every row comes back once, with ``entry`` and ``chunk`` naming the copy of
    the response that serves it.  A request without time is a miss of its own.
    ``work_path`` (shared storage) writes the merged seconds and the decided ones
    once; without it every use of the result works them out again.
    """
    timed = requests.withColumn("_second", F.unix_seconds("request_ts"))
    seconds = (
        timed.filter(F.col("_second").isNotNull())
        .groupBy("request_hash", "_second")
        .agg(
            F.min(F.struct("request_ts", "request_id")).alias("_first"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select(
            "request_hash",
            "_second",
            F.coalesce(F.col("_first.request_id"), F.lit("")).alias("_first_id"),
            "_n",
            F.lit(None).cast("bigint").alias("_ttl"),
        )
    )
    if cache is not None:
        held = cache.select("request_hash", F.col("ttl").alias("_ttl"))
        seconds = seconds.unionByName(held, allowMissingColumns=True)
    seconds = _kept(seconds, work_path, "seconds")
    spans = seconds.groupBy("request_hash").agg(
        F.min("_second").alias("_opened"),
        (
            (F.max("_second") - F.min("_second") < ttl_seconds)
            & (F.count("_ttl") == 0)
            & (F.sum("_n") <= chunk_rows)
        ).alias("_single"),
        F.min_by("_first_id", "_second").alias("_opener"),
    )
    spread = seconds.join(spans, "request_hash")
    single = spread.filter("_single").select(
        "request_hash", "_second", F.col("_opener").alias("served_by"), F.col("_opened").alias("opened_at"),
        F.lit(False).alias("from_cache"), F.lit(0).cast("bigint").alias("chunk"),
    )
    walked = (
        spread.filter("not coalesce(_single, false)")
        .select("request_hash", "_second", "_first_id", "_n", "_ttl")
        .repartition("request_hash")
        .sortWithinPartitions("request_hash", F.col("_second").asc_nulls_first())
        .mapInPandas(_fold(ttl_seconds, chunk_rows), _FOLDED)
    )
    folded = _kept(single.unionByName(walked), work_path, "decided")
    untimed = timed.filter(F.col("_second").isNull()).select(
        *timed.columns, F.col("request_id").alias("served_by"), F.lit(None).cast("bigint").alias("opened_at"),
        F.lit(False).alias("from_cache"), F.lit(0).cast("bigint").alias("chunk"), F.lit("miss").alias("cache_status"),
    )
    served = timed.join(folded, ["request_hash", "_second"])
    opening = (
        ~F.col("from_cache")
        & (F.col("_second") == F.col("opened_at"))
        & (F.col("served_by") == F.coalesce("request_id", F.lit("")))
    )
    marked = served.withColumn("cache_status", F.when(opening, "miss").otherwise("hit"))
    key = entry_key(F.col("from_cache"), F.col("opened_at"), F.col("request_hash"), F.col("served_by"))
    marked = marked.unionByName(untimed).withColumn("entry", key)
    servers = (
        folded.unionByName(untimed.select(*folded.columns))
        .withColumn("entry", key)
        .groupBy("entry", "from_cache", "served_by", "request_hash", "opened_at")
        .agg(F.max("chunk").alias("last_chunk"))
    )
    return Deduped(marked.drop("_second", "opened_at"), servers)


def attach_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Give every request the response of the entry that serves it.

    ``responses`` holds ``entry, last_chunk`` and a struct ``receipt``, one row
    per entry; it is copied once per chunk of requests it serves.
    """
    copies = responses.select(
        "entry",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_chunk"))).alias("chunk"),
        "receipt",
    )
    return requests.join(copies, ["entry", "chunk"])


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the live entry of their hash, NULL when there is none.

    ``cache`` has one row per hash.  Hot hashes sit on the request side and
    are split by adaptive execution; the cache side is broadcast only when
    its measured size allows.
    """
    entry = cache.select(
        "request_hash", F.col("ttl").alias("cached_ttl"), F.col("response").alias("cached_response")
    )
    alive = F.unix_seconds(F.col("request_ts")) < F.col("cached_ttl")
    return requests.join(entry, "request_hash", "left").withColumns(
        {
            "cached_response": F.when(alive, F.col("cached_response")),
            "cached_ttl": F.when(alive, F.col("cached_ttl")),
            "cache_status": F.when(alive, "hit").otherwise("miss"),
        }
    )


def cache_rows(receipts: DataFrame, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Cache rows for freshly parsed receipts (``opened_at`` = second of writing)."""
    return receipts.select(
        "request_hash",
        F.col("normalized_text").alias("receipt_text"),
        response_json(F.struct(*[F.col(c) for c in schemas.RECEIPT_COLUMNS])).alias("response"),
        (F.col("opened_at") + F.lit(ttl_seconds)).alias("ttl"),
    )


def cache_snapshot(cache: DataFrame, written: DataFrame, now: Column) -> DataFrame:
    """Next cache: last write per hash wins, expired entries are left out."""

    def tagged(rows: DataFrame, generation: int) -> DataFrame:
        live = rows.filter(F.col("ttl") > now)
        return live.withColumn("_generation", F.lit(generation))

    both = tagged(cache, 0).unionByName(tagged(written, 1))
    latest = both.groupBy("request_hash").agg(
        F.max_by(
            F.struct("receipt_text", "response", "ttl"), F.struct("_generation", "ttl", "response")
        ).alias("entry")
    )
    return latest.select("request_hash", "entry.*")


def response_json(receipt: Column) -> Column:
    """Receipt struct -> JSON text with amounts as strings."""
    return F.to_json(receipt.cast(schemas.CACHED_RESPONSE), {"ignoreNullFields": "false"})


def read_response(response: Column) -> Column:
    """JSON text -> receipt struct with typed amounts."""
    read = F.from_json(response, schemas.CACHED_RESPONSE)
    return F.struct(
        *[
            (
                read[name].try_cast("decimal(18,2)")
                if name.endswith("_amount")
                else read[name].cast(schemas.ITEMS) if name == "items" else read[name]
            ).alias(name)
            for name in schemas.RECEIPT_COLUMNS
        ]
    )

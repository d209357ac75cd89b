"""The TTL cache over a stream, decided by event time.

Texts are dealt by hash to a fixed number of buckets, and a bucket's state is read
and written as a whole, once a micro-batch, as a call to the state store costs far
more than a row.  Requests of one text are merged to the earliest of each second
before they touch the state, which holds a small row for each second not decided
yet and the open cache entries.  A bucket has one timer, set for its first undecided
second or the first end of an entry.  It fires when the watermark has passed that,
so nothing earlier can follow: all seconds passed are decided in the order of time
and forgotten, and so are the entries that have ended.  No list of requests is kept,
however often a text is sent; requests may come in any order within the delay.

What comes out is one row for each second of a text, and one for each request
that came after its second was decided.  Requests get their answers by a join
with the decided seconds, as in the batch form.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketry.operators.cache import DEFAULT_TTL_SECONDS

DECIDED = "request_hash string, second long, kind string, request_id string, opened_at long"
_COLUMNS = ["request_hash", "second", "kind", "request_id", "opened_at"]
_PENDING = ["request_hash", "second", "micros", "request_id"]

#: Into so many buckets texts are dealt.  It is part of a checkpoint: a stream that
#: goes on from one must keep it.
BUCKETS = 1024


class _Seconds(StatefulProcessor):
    """The undecided seconds and the open entries of a bucket of texts."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A second that came in several micro-batches has a row for each.
        self.pending = handle.getListState(
            "pending", "request_hash string, second long, micros long, request_id string"
        )
        self.entries = handle.getListState("entries", "request_hash string, request_id string, second long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        earliest: dict[tuple[str, int], tuple[int, str]] = {}
        for frame in rows:
            late = frame["second"] * 1000 <= passed
            if late.any():
                some = frame[late]
                yield pd.DataFrame(
                    {"request_hash": some["request_hash"], "second": some["second"], "kind": "late",
                     "request_id": some["request_id"], "opened_at": pd.array([None] * len(some), "Int64")}
                )
            timely = frame[~late]
            for text, second, *found in zip(*(timely[c].tolist() for c in _PENDING)):
                at, found = (text, second), tuple(found)
                earliest[at] = min(found, earliest.get(at, found))
        if earliest:
            self.pending.appendList([(*at, *found) for at, found in earliest.items()])
            self._set_timer(min(second for _, second in earliest) * 1000)

    def _set_timer(self, at: int) -> None:
        """Let the bucket's timer fire at ``at``, if not before."""
        for other in list(self.handle.listTimers()):
            if other <= at:
                return
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        entries = {text: (request_id, second) for text, request_id, second in self.entries.get()}
        due, waiting = [], []
        for row in self.pending.get():
            (due if row[1] * 1000 <= passed else waiting).append(row)
        due.sort()
        out, last = [], None
        for text, second, _, request_id in due:
            if last == (text, second):
                continue
            last = (text, second)
            kind, held = "hit", entries.get(text)
            if held is None or second >= held[1] + self.ttl:
                kind, held = "miss", (request_id, second)
                entries[text] = held
            out.append((text, second, kind, *held))
        open_ = [(text, *held) for text, held in entries.items() if (held[1] + self.ttl) * 1000 > passed]
        for state, kept in ((self.pending, waiting), (self.entries, open_)):
            if kept:
                state.put(kept)
            else:
                state.clear()
        following = [row[1] for row in waiting] + [row[2] + self.ttl for row in open_]
        if following:
            self.handle.registerTimer(min(following) * 1000)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream_ttl_seconds(
    requests: DataFrame, ttl_seconds: int = DEFAULT_TTL_SECONDS, delay: str = "1 hour", buckets: int = BUCKETS
) -> DataFrame:
    """``request_hash, second, kind, request_id, opened_at`` as seconds are decided.

    ``kind`` is ``miss`` for the second that opens an entry and ``hit`` for one
    that an entry serves; ``request_id`` and ``opened_at`` name the opening request
    and its second.  A request that comes when the watermark has passed its second
    is returned with ``late`` under its own id and changes nothing.  Requests
    without hash or time take no part.  ``buckets`` grows with the texts of one TTL:
    a micro-batch reads and writes the buckets that its requests fall into.
    """
    timed = (
        requests.filter("request_hash IS NOT NULL AND request_ts IS NOT NULL")
        .withWatermark("request_ts", delay)
        # Without the time column itself, late rows reach the operator.
        .select(F.pmod(F.xxhash64("request_hash"), F.lit(buckets)).alias("bucket"),
                "request_hash", F.unix_seconds("request_ts").alias("second"),
                F.unix_micros("request_ts").alias("micros"), F.coalesce("request_id", F.lit("")).alias("request_id"))
    )
    return timed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Seconds(ttl_seconds), outputStructType=DECIDED, outputMode="Append", timeMode="EventTime"
    )


def answers(requests: DataFrame, decided: DataFrame) -> DataFrame:
    """``requests`` with ``cache_status`` and ``served_by``, from the decided seconds.

    Late requests, and those whose second is not decided yet, are left out."""
    seconds = decided.filter("kind <> 'late'").select(
        "request_hash", "second", F.col("request_id").alias("served_by"), "opened_at"
    )
    late = late_requests(decided).select("request_hash", "second", "request_id")
    timed = requests.withColumn("second", F.unix_seconds("request_ts"))
    opening = (F.col("second") == F.col("opened_at")) & (F.col("served_by") == F.coalesce("request_id", F.lit("")))
    return (
        timed.join(late, ["request_hash", "second", "request_id"], "left_anti")
        .join(seconds, ["request_hash", "second"])
        .withColumn("cache_status", F.when(opening, "miss").otherwise("hit"))
        .drop("second", "opened_at")
    )


def late_requests(decided: DataFrame) -> DataFrame:
    """The side table of late requests."""
    return decided.filter("kind = 'late'").select("request_hash", "second", "request_id")

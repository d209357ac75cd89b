"""The TTL cache over many micro-batches: merged seconds, timers, late rows."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from docketry.operators import cache
from docketry.streaming import receipts as streaming, ttl

SCHEMA = "request_id string, request_ts timestamp, request_hash string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _run(spark, tmp_path, batches, seconds, delay, name):
    """The decided seconds of a stream that gets each list of rows as a micro-batch."""
    source, out, state = (f"{tmp_path}/{name}-{part}" for part in ("in", "out", "state"))
    for rows in [*batches, [("end", START + timedelta(days=4000), "end")]]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = streaming.start_table(ttl.stream_ttl_seconds(stream, seconds, delay), out, state)
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.parquet(source).filter("request_id <> 'end'"), spark.read.parquet(out)


def _row(k, second, text, micros=0):
    return (k, START + timedelta(seconds=second, microseconds=micros), text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [_row(f"{k:04}", rng.randint(0, 400), rng.choice("wxyz") + "h", rng.choice([0, 5, 999_999])) for k in range(600)]
    out += [_row(f"hot{k:03}", 200 + k % 3, "wh", k) for k in range(300)]
    return out


def test_many_batches_equal_the_batch_form(spark, tmp_path, rows):
    """In order over batches, in no order inside them."""
    rng = random.Random(1)
    batches = []
    for low in range(0, 401, 80):
        part = [r for r in rows if low <= (r[1] - START).total_seconds() < low + 80]
        rng.shuffle(part)
        batches.append(part)
    requests, decided = _run(spark, tmp_path, batches, 30, "1 second", "ordered")
    assert ttl.late_requests(decided).count() == 0
    got = {r.request_id: (r.cache_status, r.served_by) for r in ttl.answers(requests, decided).collect()}
    batch = cache.ttl_dedupe(requests, ttl_seconds=30).requests
    assert got == {r.request_id: (r.cache_status, r.served_by) for r in batch.collect()}
    # One row for each second of a text, not for each request.
    assert decided.count() == requests.selectExpr("request_hash", "unix_seconds(request_ts)").distinct().count() < len(rows)


def test_disorder_within_the_delay(spark, tmp_path, rows):
    """Whatever the order of arrival, the answers are those of the batch form."""
    mixed = list(rows)
    random.Random(2).shuffle(mixed)
    requests, decided = _run(spark, tmp_path, [mixed[k::4] for k in range(4)], 30, "1 hour", "mixed")
    got = {r.request_id: (r.cache_status, r.served_by) for r in ttl.answers(requests, decided).collect()}
    batch = cache.ttl_dedupe(requests, ttl_seconds=30).requests
    assert got == {r.request_id: (r.cache_status, r.served_by) for r in batch.collect()}


def test_late_rows_go_aside(spark, tmp_path):
    batches = [[_row("a", 0, "x"), _row("b", 100, "x")], [_row("c", 300, "x")],
               [_row("late1", 50, "x"), _row("late2", 289, "y"), _row("d", 291, "y"), _row("e", 310, "x")],
               [_row("late3", 0, "new")]]
    requests, decided = _run(spark, tmp_path, batches, 60, "10 seconds", "late")
    assert sorted(r.request_id for r in ttl.late_requests(decided).collect()) == ["late1", "late2", "late3"]
    got = {r.request_id: r.cache_status for r in ttl.answers(requests, decided).collect()}
    assert got == {"a": "miss", "b": "miss", "c": "miss", "d": "miss", "e": "hit"}


def test_missing_hash_or_time(spark, tmp_path):
    rows = [("1", None, "x"), ("2", START, None), ("3", START, "x"), (None, START, "x")]
    requests, decided = _run(spark, tmp_path, [rows], 60, "1 second", "nulls")
    assert [(r.kind, r.request_id) for r in decided.collect() if r.request_hash == "x"] == [("miss", "")]


class _Handle:
    """State of one bucket, with the calls to it counted."""

    def __init__(self):
        self.calls, self.timers, self.lists = Counter(), set(), {}

    def getListState(self, name, schema):
        handle, rows = self, self.lists.setdefault(name, [])

        class _List:
            def get(self):
                handle.calls["get"] += 1
                return iter(list(rows))

            def put(self, new):
                handle.calls["put"] += 1
                rows[:] = new

            def appendList(self, new):
                handle.calls["append"] += 1
                rows.extend(new)

            def clear(self):
                handle.calls["clear"] += 1
                rows.clear()

        return _List()

    def listTimers(self):
        self.calls["timers"] += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls["timers"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls["timers"] += 1
        self.timers.discard(at)


class _At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_calls_to_the_state_do_not_grow_with_texts_and_seconds():
    """Stream_ttl and stream_late: a micro-batch costs a bucket a few calls."""
    handle, processor = _Handle(), ttl._Seconds(30)
    processor.init(handle)
    frame = pd.DataFrame(
        [(f"t{k % 50}", 100 + k % 97, k, f"{k:04}") for k in range(3000)],
        columns=["request_hash", "second", "micros", "request_id"],
    )
    assert not list(processor.handleInputRows((0,), iter([frame[:1500], frame[1500:]]), _At(0)))
    assert handle.timers == {100_000}
    handle.timers.clear()
    out = pd.concat(processor.handleExpiredTimer((0,), _At(150_000), None))
    assert out["second"].max() == 150 and not out.duplicated(["request_hash", "second"]).any()
    assert handle.timers == {151_000}
    handle.timers.clear()
    rest = pd.concat(processor.handleExpiredTimer((0,), _At(10**6), None))
    both = pd.concat([out, rest])
    assert len(both) == len(frame.drop_duplicates(["request_hash", "second"]))
    assert handle.lists == {"pending": [], "entries": []} and not handle.timers
    assert sum(handle.calls.values()) < 20
    # The walk of each text, by hand.
    for text, part in both.sort_values("second").groupby("request_hash"):
        opened = None
        for row in part.itertuples():
            if opened is None or row.second >= opened + 30:
                opened = row.second
                assert row.kind == "miss"
            assert row.opened_at == opened and (row.kind == "hit" or row.second == opened)

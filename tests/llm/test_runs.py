"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docketry.llm import q_runs
from docketry.llm.periodic_runs import SHORTEST, periodic_runs, runs_of


def brute(words):
    """Every run as (start, length, period), by trying all periods."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        begin = 0
        for i in range(len(words) - q + 1):
            if i == len(words) - q or words[i] != words[i + q]:
                if i - begin >= q:
                    best.setdefault((begin, i + q), q)
                begin = i + 1
    return sorted((s, e - s, q) for (s, e), q in best.items() if e - s >= max(SHORTEST, 2 * q))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "b", "a"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def cases():
    rng = random.Random(12)
    yield from ("", "a", "a" * 11, "a" * 12, "ab" * 6, "a" * 300)
    yield fibonacci(500)
    yield "".join("ab"[bin(i).count("1") % 2] for i in range(600))  # no cubes
    for k in (7, 15, 40):  # halves that have a short period themselves
        for root in ("ab" * k + "a", "aab" * k + "aa", "aab" * k + "a", "abcab" * k + "abc"):
            yield root * 2
            yield root * 3 + root[:5]
            yield "x" + root * 2 + "ba" * k
    for n in range(150):
        letters = "ab" if n % 3 else "abcdefgh"
        text = "".join(rng.choices(letters, k=rng.randint(0, 200)))
        root = "".join(rng.choices(letters, k=rng.randint(1, 60)))
        yield text + root * rng.randint(1, 5) + root[: len(root) // 2] + text[: rng.randint(0, 90)]
    for _ in range(40):  # copies with small changes, nested
        text = rng.choice("abc")
        while len(text) < 700:
            text = (text * rng.randint(1, 3) + rng.choice(["", "a", "b"]))[-500:] + text[: rng.randint(0, 200)]
        yield text[:900]


def test_all_runs_found():
    texts = list(cases())
    count, runs, kept = runs_of(pa.array([" ".join(t) for t in texts]))
    for text, n, got, left in zip(texts, count.to_pylist(), runs.to_pylist(), kept.to_pylist()):
        want = brute(text)
        assert n == len(text)
        assert [(r["start"], r["length"], r["period"]) for r in got] == want, text
        assert left == collapse(text, want)


def test_many_overlapping_runs_stay_fast():
    """(ab)^k a twice has a run for every odd period; their lengths add up to n^2 / 8."""
    text = ("ab" * 20_000 + "a") * 2
    count, runs, _ = runs_of(pa.array([" ".join(text)]))
    assert len(runs[0]) == 20_000
    assert max(r["period"] for r in runs[0].as_py()) == 40_001


def test_periods_at_every_scale():
    rng = random.Random(3)
    for period in (11, 12, 23, 24, 100, 1000, 5000):
        root = [str(rng.random()) for _ in range(period)]
        words = ["x"] + root * 2 + root[: period // 3] + ["y"]
        _, runs, _ = runs_of(pa.array([" ".join(words)]))
        assert runs[0].as_py() == [{"start": 1, "length": 2 * period + period // 3, "period": period}]


def test_rows(spark, docs, nothing, texts):
    out = periodic_runs(docs)
    assert out.columns == [*docs.columns, "n_words", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for row in rows:
        words = (row.text or "").split(" ") if row.doc_id != 3 else []
        if row.doc_id in (None, 40, 41, 42):
            continue
        words = [w for w in words if w]
        assert [tuple(r) for r in row.runs] == brute(words) and row.collapsed == collapse(words, brute(words))
    assert periodic_runs(nothing).count() == 0
    clash = spark.createDataFrame([(" ".join("ab" * 9), 1, "old", "old")], "text string, `runs` int, collapsed string, `a.b` string")
    row = periodic_runs(clash).first()
    assert [tuple(r) for r in row.runs] == [(0, 18, 2)] and row.collapsed == "a b" and row["a.b"] == "old"


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(None, " ".join("abcabcabd" * 4)), (1, None), (2, ""), (3, " \t\x0b "), (4, "one")]
    for n in range(5, 260):
        rows.append((n, "  ".join(rng.choices(["der", "é x", "Haus", " ", "a."], k=rng.randint(0, 160)))))
    rows += rows[30:33]
    path = tmp_path_factory.mktemp("runs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_query_is_brute_force(spark, fixture_dir):
    path, rows = fixture_dir
    want = []
    for doc_id, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want.append((
            doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(collapse(words, runs).encode()).hexdigest(),
        ))
    got = q_runs.query(spark, path)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert set(dict(got.dtypes[:6]).values()) == {"bigint"}
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[1] > 0 for w in want) > 10


def test_batches_do_not_mix():
    text = " ".join("abcdefghijklmn" * 2)
    half = " ".join("abcdefghijklmn")
    _, runs, _ = runs_of(pa.array([half, half, text, half, None, half]))
    assert [len(r) for r in runs] == [0, 0, 1, 0, 0, 0]
    assert np.array_equal([len(r) for r in runs_of(pa.array([], pa.string()))[1]], [])

"""Jobs on small fixtures, among them brute-force checks in plain Python."""

import datetime as dt
import json
import random
from decimal import Decimal as D
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docketry import fixed_values as fv
from docketry import schemas
from docketry.functions import dates, scores
from docketry.operators import augment, cache, evaluate, regress, validate
from docketry.operators.categorize import categorize
from docketry.operators.clean import clean_and_key
from docketry.operators.extract import decode_model_responses
from docketry.operators.ingest import accepted, decode_requests, rejected
from docketry.plans.receipts import parse_receipts, receipt_json
from docketry.sources import datasets

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def requests_of(spark, rows):
    """(id, seconds after T0, text) rows."""
    data = [(i, T0 + dt.timedelta(seconds=s), t, "AUD", "u") for i, s, t in rows]
    return spark.createDataFrame(
        data, "request_id string, request_ts timestamp, receipt_text string, currency string, user_id string"
    )


# --- cache --------------------------------------------------------------------------

def walk(times, ttl, expiry=None):
    out = []
    for t in times:
        if expiry is None or t >= expiry:
            expiry = t + ttl
            out.append("miss")
        else:
            out.append("hit")
    return out


def test_ttl_restarts_on_expiry(spark):
    seconds = [0, 10, 29, 30, 31, 59, 60, 61]
    rows = requests_of(spark, [(f"{s:03}", s, "x") for s in seconds])
    marked = cache.ttl_dedupe(clean_and_key(rows), ttl_seconds=30).requests
    got = [r.cache_status for r in marked.orderBy("request_id").collect()]
    assert got == ["miss", "hit", "hit", "miss", "hit", "hit", "miss", "hit"]


def test_ttl_brute_force_with_cache_and_hot_key(spark):
    rng = random.Random(3)
    rows = []
    for key in range(12):
        n = 400 if key == 0 else rng.randint(1, 30)
        for j in range(n):
            rows.append((f"{key:02}-{j:03}", rng.randint(0, 3000) + rng.random(), f"text {key}"))
    requests = clean_and_key(requests_of(spark, rows))
    hashes = {r.receipt_text: r.request_hash for r in requests.select("receipt_text", "request_hash").distinct().collect()}
    base = int(T0.timestamp())
    held = {f"text {k}": 500 + 100 * k for k in (0, 3, 5)}
    table = spark.createDataFrame(
        [(hashes[t], t, "{}", base + e) for t, e in held.items()], schemas.CACHE
    )
    deduped = cache.ttl_dedupe(requests, table, ttl_seconds=200, chunk_rows=7)
    got = {r.request_id: r for r in deduped.requests.collect()}
    for text in hashes:
        mine = sorted(
            ((base + s) // 1, s, i) for i, s, t in rows if t == text
        )
        want = walk([int(m[0]) for m in mine], 200, base + held[text] if text in held else None)
        assert [got[i].cache_status for _, _, i in mine] == want
    # a server row covers every chunk its requests use
    servers = {(r.from_cache, r.served_by): r.last_chunk for r in deduped.servers.collect()}
    for r in got.values():
        assert r.chunk <= servers[(r.from_cache, r.served_by)]
    assert max(servers.values()) > 0
    answers = deduped.servers.withColumn("receipt", F.struct("served_by"))
    joined = cache.attach_responses(deduped.requests, answers)
    assert joined.count() == len(rows)


def test_snapshot_last_write_wins_and_purges(spark):
    old = spark.createDataFrame([("a", "t", "old", 100), ("b", "t", "old", 5), ("c", "t", "old", 99)], schemas.CACHE)
    new = spark.createDataFrame([("a", "t", "new", 60), ("a", "t", "newer", 70)], schemas.CACHE)
    got = {r.request_hash: r.response for r in cache.cache_snapshot(old, new, F.lit(10)).collect()}
    assert got == {"a": "newer", "c": "old"}


def test_cache_round_trip_keeps_zero_amounts(spark):
    row = spark.sql(
        "select 'V' vendor, '2024-01-01' receipt_date, array(named_struct('name','a','quantity',1,"
        "'unit_price',cast(1 as decimal(18,2)),'total_price',cast(null as decimal(18,2)))) items, "
        "cast(0 as decimal(18,2)) subtotal_amount, cast(11 as decimal(18,2)) total_amount, "
        "cast(null as decimal(18,2)) gst_amount, 'AUD' currency, 'Food' category, 'rules' "
        "categorization_source, 'r' categorization_reason, array('k') matched_keywords, 0.5D "
        "confidence_score, 'miss' cache_status, 'id' request_id, array('w') warnings"
    )
    text = row.select(cache.response_json(F.struct("*")).alias("j"))
    assert json.loads(text.first().j)["total_amount"] == "11.00"
    back = text.select(cache.read_response(F.col("j")).alias("r")).select("r.*")
    assert back.first() == row.select(*schemas.RECEIPT_COLUMNS).first()


# --- requests and model output ------------------------------------------------------

def test_ingest_shapes(spark):
    body = json.dumps({"receipt_text": " STARBUCKS\nTotal: $5.50 ", "currency": "aud", "metadata": {"id": 4}})
    rows = [
        ("e1", None, "POST", "/v1/receipts/parse", None, None, body, None),
        ("", None, None, None, "/prod/v1/receipts/parse", ("prod", ("POST", None)), body, None),
        ("e3", None, "POST", "/production/v1/receipts/parse", None, ("prod", None), body, None),
        ("e4", None, "POST", "/v1/receipts/parse", None, None, None, None),
        ("e5", None, "POST", "/v1/receipts/parse", None, None, '{"receipt_text":"x","currency":null}', None),
        ("e6", None, "POST", "/v1/receipts/parse", None, None, "!!!", True),
    ]
    decoded = decode_requests(spark.createDataFrame(rows, schemas.API_EVENTS))
    good = {r.request_id: r for r in accepted(decoded).collect()}
    bad = {r.request_id: r.reject_reason for r in rejected(decoded).collect()}
    assert good["e1"].receipt_text == "STARBUCKS\nTotal: $5.50" and good["e1"].currency == "AUD"
    assert json.loads(good["e1"].metadata) == {"id": 4}
    assert good["e5"].currency is None
    assert len(good) == 3 and any(len(i) == 36 for i in good)
    assert set(bad) == {"e3", "e4", "e6"} and bad["e3"] == "Not Found"


def test_model_types_are_strict(spark):
    def wrap(text):
        return json.dumps({"content": [{"text": text}]})

    good = {"vendor": "V", "items": [{"name": "a", "quantity": 2.7, "unit_price": 1.5}], "total_amount": "11.00"}
    cases = {
        "ok": (wrap("x " + json.dumps(good) + " y"), True),
        "null items": (wrap('{"items": null}'), False),
        "null currency": (wrap('{"currency": null}'), False),
        "bad amount": (wrap('{"total_amount": "$5"}'), False),
        "number vendor": (wrap('{"vendor": 5}'), False),
        "item not an object": (wrap('{"items": [1]}'), False),
        "empty": (wrap("{}"), False),
        "no object": (wrap("none"), False),
        "bad json": (wrap("{a:}"), False),
        "not json": ("oops", False),
        "second part": (json.dumps({"output": {"message": {"content": [{"text": '{"vendor":'}, {"output_text": '"W"}'}]}}}), True),
        "extra keys": (wrap('{"category": "Food"}'), True),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], schemas.MODEL_RESPONSES)
    got = {r.request_hash: r for r in decode_model_responses(df).collect()}
    assert {k: r.model_ok for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    assert got["ok"]["items"][0].quantity == "2" and got["ok"].total_amount == D("11.00")
    assert got["second part"].vendor == "W" and got["second part"].currency == "AUD"


def test_flow_miss_then_hit_and_gst(spark):
    rows = requests_of(spark, [
        ("1", 0, "STARBUCKS\nTotal: $5.50\nGST: $0.50"), ("2", 5, "starbucks total: $5.50 gst: $0.50"),
        ("3", 6, "COFFEE SHOP"),
    ])
    key = {r.request_id: r.request_hash for r in clean_and_key(rows).collect()}
    assert key["1"] == key["2"]
    body = json.dumps({"content": [{"text": json.dumps({"vendor": "COFFEE SHOP", "total_amount": 11.00, "gst_amount": None})}]})
    responses = spark.createDataFrame([(key["3"], body)], schemas.MODEL_RESPONSES)
    batch = parse_receipts(rows, responses)
    got = {r.request_id: r for r in batch.receipts.collect()}
    assert got["1"].cache_status == "miss" and got["2"].cache_status == "hit"
    assert got["1"].currency == "AUD" and isinstance(got["1"].warnings, list)
    assert got["3"].gst_amount == D("1.00") and got["3"].total_amount == D("11.00")
    written = batch.written.collect()
    assert len(written) == 2 and all(w.ttl == int(T0.timestamp()) + s + 30 * 86400 for w, s in zip(sorted(written, key=lambda w: w.ttl), (0, 6)))
    # the next batch is answered from the written cache
    later = parse_receipts(requests_of(spark, [("9", 100, "coffee shop")]), None, batch.written)
    again = later.receipts.first()
    assert again.cache_status == "hit" and again.gst_amount == D("1.00") and again.request_id == "9"
    text = receipt_json(batch.receipts.filter("request_id = '3'")).first().body
    assert json.loads(text)["gst_amount"] == "1.00"


# --- categories, validation -----------------------------------------------------------

@pytest.mark.parametrize("words, category, n, confident", [
    ("nothing here", "Unclassified", 0, 0.0), ("fuel", "Car", 1, 0.3), ("fuel petrol", "Car", 2, 0.6),
    ("fuel petrol caltex", "Car", 3, 0.8999999999999999), ("fuel petrol caltex nrma", "Car", 4, 1.0),
    ("linkt", "Car", 1, 0.3), ("amazon", "Staff Amenities", 1, 0.3), ("expense", "Office Supplies", 1, 0.3),
])
def test_categories(spark, words, category, n, confident):
    df = spark.createDataFrame([(None, None, words)], f"vendor string, items {schemas.ITEMS}, clean_text string")
    got = categorize(df).first()
    assert (got.category, len(got.matched_keywords), got.category_confidence) == (category, n, confident)


def test_model_category_only_when_rules_are_unsure(spark):
    df = spark.createDataFrame(
        [("fuel", "Food"), ("fuel petrol caltex", "Food"), ("fuel", "Unclassified"), ("x", None)],
        "clean_text string, ai string",
    ).withColumns({"vendor": F.lit("V"), "items": F.array().cast(schemas.ITEMS)})
    got = [(r.category, r.categorization_source) for r in categorize(df, model_category="ai").collect()]
    assert got == [("Food", "ai"), ("Car", "rules"), ("Car", "rules"), ("Unclassified", "fallback")]


def test_warning_tolerance(spark):
    df = spark.createDataFrame(
        [("a", D("10.00"), D("1.00"), D(t), [("x", 2, D("1.00"), D(p))]) for t, p in (("11.01", "2.01"), ("11.02", "2.02"))],
        f"category string, subtotal_amount decimal(18,2), gst_amount decimal(18,2), total_amount decimal(18,2), items {schemas.ITEMS}",
    ).withColumns({"currency": F.lit("AUD"), "category_confidence": F.lit(0.1)})
    near, far = [r.warnings for r in validate.with_warnings(df).collect()]
    assert near == [] and far == [fv.W_GST_MISMATCH, "Item 1 price calculation doesn't match"]


# --- scores ---------------------------------------------------------------------------

def py_text(a, b):
    a, b = a or "", b or ""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio()


def py_amount(p, e):
    if p is None and e is None:
        return 1.0
    try:
        p, e = D(p), D(e)
    except Exception:  # noqa: BLE001
        return 0.0
    off = abs(p - e)
    for width, s in (("0", 1.0), ("0.01", 0.9), ("0.10", 0.5), ("1.00", 0.1)):
        if off <= D(width):
            return s
    return 0.0


def test_text_score_brute_force(spark):
    rng = random.Random(5)
    words = ["", None, " ", "Coles", "coles ", "COLES Broadway", "Caffè", "caffe", "a" * 250, "a" * 249 + "b"]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(300)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.s for r in df.select("i", scores.text_score(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == pytest.approx([py_text(a, b) for a, b in pairs], abs=1e-12)


def test_items_score_brute_force(spark):
    rng = random.Random(9)
    names = ["Coffee", "coffee ", "Cofee", "Tea", "", " ", "Banana bread", "Banana braed", None]
    prices = ["5.00", "5", "5.01", "5.10", "6.00", "9", None, "n/a"]

    def some():
        return [(rng.choice(names), "1", None, rng.choice(prices)) for _ in range(rng.randint(0, 5))]

    rows = [(i, some(), some()) for i in range(300)]
    df = spark.createDataFrame(rows, f"i int, p {schemas.SCORED_ITEMS}, e {schemas.SCORED_ITEMS}")
    got = [r.s for r in scores.with_items_score(df, "p", "e", "s").orderBy("i").collect()]

    def want(p, e):
        if not p and not e:
            return 1.0
        if not p or not e:
            return 0.0
        best = [max((py_text(a[0], b[0]) + py_amount(a[3], b[3])) / 2 for b in e) for a in p]
        return sum(best) / max(len(p), len(e))

    assert got == pytest.approx([want(p, e) for _, p, e in rows], abs=1e-12)


def test_amount_score_bands(spark):
    cases = [("1.00", "1", 1.0), ("1.01", "1.00", 0.9), ("1.10", "1.00", 0.5), ("2.00", "1.00", 0.1),
             ("2.01", "1.00", 0.0), (None, None, 1.0), (None, "1", 0.0), ("x", "x", 0.0),
             ("10.50", "10.500000000000002", 0.9)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r.s for r in df.select("i", scores.amount_score(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_date_score(spark):
    cases = [("2024-01-05", "2024-01-05", 1.0), ("2024-01-05", "2024-01-05T10:00:00", 0.8),
             ("2024-01-05", "2024-01-31", 0.5), ("2024-01-05", "2023-01-05", 0.0), ("", None, 1.0),
             ("2024-01-05", None, 0.0), ("soon", "soon", 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r.s for r in df.select("i", dates.date_score(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


# --- reports, regression ------------------------------------------------------------------

def samples(spark, ids, **fields):
    row = {f: None for f in fv.FIELDS} | {"vendor": "V", "total_amount": "1.00"} | fields
    return spark.createDataFrame(
        [(i, "test", *[row[f] for f in fv.FIELDS]) for i in ids],
        "request_id string, test_name string, "
        + ", ".join(f"{f} {schemas.SCORED_ITEMS if f == 'items' else 'string'}" for f in fv.FIELDS),
    )


def test_single_sample_report(spark):
    one = samples(spark, ["1"])
    scored = evaluate.score_samples(one, one)
    fields = {r.field: r for r in evaluate.field_report(scored).collect()}
    assert fields["vendor"].score == 1.0 and fields["vendor"].ci_lower is None
    assert evaluate.overall_score(evaluate.field_report(scored)).first() == (1.0, 1)
    table = evaluate.summary_table(evaluate.field_report(scored), evaluate.overall_score(evaluate.field_report(scored)))
    assert table.count() == 9


def test_unpaired_samples_fail(spark):
    with pytest.raises(Exception, match="same number of samples"):
        evaluate.score_samples(samples(spark, ["1"]), samples(spark, ["1", "2"])).collect()


def test_regression_first_run_then_drop(spark):
    truth = samples(spark, ["1", "2"])
    none = spark.createDataFrame([], schemas.RESULTS)
    checks, results = regress.run_batch_tests(truth, truth, none, 100)
    first = checks.first()
    assert first.message == "New baseline created" and not first.has_regression
    assert regress.missing_baselines(results, none).count() == 9
    worse = samples(spark, ["1", "2"], total_amount="5.00")
    row = regress.run_batch_tests(worse, truth, results, 101)[0].first()
    assert row.has_regression and row.message == "Regression detected! Overall score dropped by 0.250"
    assert [c.field for c in row.changes] == ["overall_score", "total_amount"]


@pytest.mark.parametrize("drop, flagged", [(0.04, False), (0.06, True)])
def test_regression_tolerance(spark, drop, flagged):
    base = spark.createDataFrame([("t", 1, "items", 0.9), ("t", 1, "overall_score", 0.9)], schemas.RESULTS)
    now = spark.createDataFrame([("t", 2, "items", 0.9 - drop), ("t", 2, "overall_score", 0.9), ("t", 2, "new", 0.0)], schemas.RESULTS)
    assert regress.check_regressions(now, base).first().has_regression is flagged


def test_errored_test_is_isolated(spark):
    truth = samples(spark, ["1"]).unionByName(samples(spark, ["1"]).withColumn("test_name", F.lit("other")))
    predictions = truth.filter("test_name = 'test'")
    checks, _ = regress.run_batch_tests(predictions, truth, spark.createDataFrame([], schemas.RESULTS), 1)
    assert regress.batch_summary(checks).first() == (2, 2, 0, 1, 1)


def test_records_round_trip_both_formats(spark, tmp_path):
    rows = samples(spark, ["1", "2"])
    for kind, name in (("jsonl", "a.jsonl"), ("json", "b.json")):
        path = str(tmp_path / name)
        datasets.write_records(rows, path, kind)
        back = datasets.read_records(spark, path)
        assert sorted(r.request_id for r in back.collect()) == ["1", "2"]
        assert back.first().total_amount == "1.00"
    with pytest.raises(ValueError):
        datasets.write_records(rows, str(tmp_path / "c"), "csv")
    with pytest.raises(ValueError):
        datasets.read_records(spark, str(tmp_path / "c.csv"))


# --- noise ----------------------------------------------------------------------------------

def test_noise_is_stable_and_at_rate(spark):
    words = " ".join(["Total"] * 200)
    df = spark.createDataFrame([(i, words) for i in range(50)], "id int, text string")
    one = augment.augment_text(df, "text", "id", 0.3, seed=1)
    two = augment.augment_text(df.repartition(7), "text", "id", 0.3, seed=1)
    a = {r.id: r.text for r in one.collect()}
    assert a == {r.id: r.text for r in two.collect()}
    assert a != {r.id: r.text for r in augment.augment_text(df, "text", "id", 0.3, seed=2).collect()}
    missing = augment.augment_text(df, "text", "id", 0.3, seed=1, modes=("missing",))
    changed = sum(w != "Total" for r in missing.collect() for w in r.text.split(" "))
    assert 0.27 < changed / 10_000 < 0.33


def test_substitutes_come_from_the_table(spark):
    df = spark.createDataFrame([(i, "aeiostlgbzSOIBxy" * 5) for i in range(40)], "id int, text string")
    got = augment.augment_text(df, "text", "id", 1.0, seed=4, modes=("substitute",))
    swapped = total = 0
    for r in got.collect():
        for plain, seen in zip("aeiostlgbzSOIBxy" * 5, r.text, strict=True):
            assert seen == plain or seen in fv.LOOK_ALIKES.get(plain, ())
            swapped += seen != plain
            total += plain in fv.LOOK_ALIKES
    assert 0.27 < swapped / total < 0.33


def test_short_words_keep_their_letters(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, "")], "id int, text string")
    got = augment.augment_text(df, "text", "id", 1.0, modes=("missing",))
    assert [r.text for r in got.orderBy("id").collect()] == ["ab c", ""]


def test_layout_rate(spark):
    text = "\n".join(["one two three four"] * 1000)
    df = spark.createDataFrame([(1, text)], "id int, text string")
    out = augment.augment_text(df, "text", "id", 0.0, seed=3, layout=True).first().text
    untouched = out.split("\n").count("one two three four")
    assert 760 < untouched < 840


# --- the evaluation and regression flows over files ---------------------------------------

def test_regression_flow_keeps_history_and_baselines(spark, tmp_path):
    from docketry.plans import regression

    folder = str(tmp_path / "runs")
    truth = samples(spark, ["1", "2", "3"])
    worse = samples(spark, ["1", "2", "3"], total_amount="9.00")
    assert regression.run_tests(truth, truth, folder, 1).first().message == "New baseline created"
    assert regression.run_tests(truth, truth, folder, 2).first().message == "No regression detected"
    checks = regression.run_tests(worse, truth, folder, 3)
    assert checks.first().has_regression
    totals = regression.batch_report(checks, str(tmp_path / "batch")).first()
    assert (totals.total_tests, totals.failed_tests) == (1, 1)
    regression.update_baseline(spark, folder, "test")
    assert {r.run_ts for r in datasets.read_results(spark, f"{folder}/baselines").collect()} == {3}
    regression.update_baseline(spark, folder, "unknown")
    again = regression.run_tests(worse, truth, folder, 4).first()
    assert not again.has_regression
    assert datasets.read_results(spark, f"{folder}/history", "test").select("run_ts").distinct().count() == 4


def test_evaluation_of_files(spark, tmp_path):
    from docketry.plans import evaluation

    truth, predictions = tmp_path / "t.jsonl", tmp_path / "p.json"
    output = {"vendor": "Coles", "receipt_date": "2024-01-05", "total_amount": 11.0, "gst_amount": 1.0,
              "subtotal_amount": 10.0, "items": [{"name": "Milk", "total_price": "10.00"}],
              "currency": "AUD", "category": "Food"}
    truth.write_text("\n".join(json.dumps({"request_id": str(i), "expected_output": output}) for i in range(3)))
    flat = [{"request_id": str(i), "receipt_text": "x" * 150, **output, "total_amount": 11.0 if i else 50} for i in range(3)]
    predictions.write_text(json.dumps(flat))
    path = str(tmp_path / "report")
    parts = evaluation.evaluate_files(spark, str(predictions), str(truth), path)
    assert parts.overall.first().total_samples == 3
    assert parts.overall.first().overall_score == pytest.approx(1 - 0.25 / 3)
    failed = parts.failures.collect()
    assert [(f.sample, f.failed_fields, f.receipt_text) for f in failed] == [("0", ["total_amount"], "x" * 100 + "...")]
    assert spark.read.parquet(f"{path}/summary").count() == 9
    none = samples(spark, [])
    with pytest.raises(Exception, match="must be loaded"):
        evaluation.report(none, none).overall.collect()

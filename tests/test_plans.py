"""Shapes of the physical plans."""

import contextlib
import io

from pyspark.sql import functions as F

from docketry.operators import evaluate
from docketry.operators.cache import ttl_dedupe
from docketry.operators.categorize import categorize
from docketry.operators.clean import clean_and_key
from docketry.operators.ingest import accepted
from docketry.operators.ingest import decode_requests
from docketry.plans import queries_cache, queries_eval
from docketry.plans.queries_receipts import receipt_texts
from docketry.plans.receipts import parse_receipts, parse_texts
from docketry.sources.orders import table


def plan(df, mode="simple"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_text_jobs_do_not_shuffle(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(
        F.col("text").alias("receipt_text"), F.lit("AUD").alias("currency")
    )
    shown = plan(parse_texts(clean_and_key(texts)))
    assert "Exchange" not in shown and "Python" not in shown and "NestedLoop" not in shown


def test_scan_reads_only_needed_columns(spark, sf_dir):
    shown = plan(clean_and_key(table(spark, sf_dir, "documents"), "text").select("request_hash"))
    assert "ReadSchema: struct<text:string>" in shown


def test_default_rules_are_not_a_join(spark, sf_dir):
    assert "Join" not in plan(
        categorize(
            table(spark, sf_dir, "documents").select(
                F.lit("v").alias("vendor"), F.col("text").alias("clean_text"),
                F.array().cast("array<struct<name:string>>").alias("items"),
            )
        )
    )


def test_body_is_parsed_once(spark, sf_dir):
    shown = plan(accepted(decode_requests(queries_cache.api_events(spark, sf_dir))))
    assert shown.count("parseJson") == 1


def test_seconds_are_merged_before_the_walk(spark, sf_dir):
    requests = queries_cache._event_requests(spark, sf_dir)
    shown = plan(ttl_dedupe(requests, ttl_seconds=86400).requests)
    assert "MapInPandas" in shown and "partial_count" in shown


def test_written_seconds_are_not_worked_out_again(spark, sf_dir):
    shown = plan(queries_cache.ttl_hit_miss(spark, sf_dir))
    # The events once for the join and once for requests without a time; no walk.
    assert "MapInPandas" not in shown and shown.count("events.parquet") == 2


def test_whole_flow_reads_texts_once_more(spark, sf_dir, tmp_path):
    requests = queries_cache._flow_requests(spark, sf_dir)
    batch = parse_receipts(requests, parsed_path=f"{tmp_path}/parsed")
    for shown in (plan(batch.receipts), plan(batch.written)):
        assert "events.parquet" not in shown and "sha2" not in shown


def test_similarity_runs_without_pair_joins(spark, sf_dir):
    shown = plan(queries_eval.sample_scores(spark, sf_dir))
    assert "ArrowEvalPython" in shown and "NestedLoop" not in shown
    # the one generated column is the settled pair of lists, not a pair of items
    assert shown.count("Generate explode") == 1


def test_failures_take_the_first_rows_only(spark, sf_dir):
    shown = plan(evaluate.failures(queries_eval.sample_scores(spark, sf_dir)))
    assert "TakeOrderedAndProject" in shown


def test_orders_are_joined_on_their_grouping(spark, sf_dir):
    # lines are shuffled once for the grouping, which the join with orders reuses
    shown = plan(receipt_texts(spark, sf_dir))
    assert shown.count("hashpartitioning(l_orderkey") == 1

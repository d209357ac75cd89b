"""Compressed exports stay spread over parts."""

import pytest

from docketry.sources import datasets


@pytest.mark.parametrize("codec", ["gzip", "lz4"])
def test_compressed_parts_are_bounded_and_read_back(spark, tmp_path, monkeypatch, codec):
    monkeypatch.setattr(datasets, "PART_RECORDS", 10)
    rows = spark.range(35, numPartitions=1).selectExpr("cast(id as string) as request_id", "repeat('Ünïcode ', 50) as vendor")
    path = f"{tmp_path}/out.jsonl"
    datasets.write_records(rows, path, compression=codec)
    parts = list((tmp_path / "out.jsonl").glob("part-*.json.*"))
    assert len(parts) == 4
    plain = f"{tmp_path}/plain.jsonl"
    datasets.write_records(rows, plain)
    got, want = (
        sorted((r.request_id, r.vendor) for r in datasets.read_records(spark, p).collect()) for p in (path, plain)
    )
    assert got == want and len(got) == 35

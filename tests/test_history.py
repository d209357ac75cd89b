"""The newest runs are found without scanning the history."""

from docketry import schemas
from docketry.operators import regress
from docketry.sources import datasets


def test_newest_run_from_partitions(spark, tmp_path):
    path = f"{tmp_path}/history"
    assert datasets.read_latest_results(spark, path).count() == 0
    tests = ["a", "b c/d=e%", "Ünï"]
    rows = [(t, run, f, run / 10) for k, t in enumerate(tests) for run in range(9, 9 + 4 * (k + 1)) for f in ("x", "y")]
    datasets.append_results(spark.createDataFrame(rows, schemas.RESULTS), path)
    got = datasets.read_latest_results(spark, path)
    want = regress.latest_results(datasets.read_results(spark, path)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.run_ts for r in got.collect()} == {12, 16, 20}
    # Three partitions are read of twenty-four.
    folders = {f.rsplit("/", 1)[0] for f in got.inputFiles()}
    assert len(folders) == 3 and len({f.rsplit("/", 1)[0] for f in datasets.read_results(spark, path).inputFiles()}) == 24
    one = datasets.read_latest_results(spark, path, "b c/d=e%")
    assert {(r.test_name, r.run_ts) for r in one.collect()} == {("b c/d=e%", 16)}
    assert datasets.read_latest_results(spark, path, "none").count() == 0

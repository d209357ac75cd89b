"""JSON record files and result tables."""

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry import schemas

#: About so many records make one array of a JSON export.
ARRAY_RECORDS = 5_000
#: Most records of a compressed part, which one task reads.
PART_RECORDS = 50_000


def read_records(spark: SparkSession, path: str, schema: str = schemas.SAMPLES) -> DataFrame:
    """Predictions, truth or dataset records.

    ``.jsonl`` (and folders of such parts) hold one object per line and are
    split over tasks; ``.json`` is a file with one array, or a folder of such
    files, each read by one task.  A broken line or array ends the reading.
    """
    name = path.rstrip("/")
    if name.endswith(".jsonl"):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if name.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    raise ValueError(f"unknown record format: {path}")


def write_records(
    records: DataFrame, path: str, format_type: str = "jsonl", compression: str | None = None
) -> None:
    """Export records as JSON lines, or as a folder of files with one JSON array
    of about ``ARRAY_RECORDS`` records each.

    JSON lines can be compressed (``gzip``, ``lz4``, ...).  Such a part cannot be split,
    so it holds at most ``PART_RECORDS`` records, and reading stays spread."""
    if format_type == "jsonl":
        lines = records.write.mode("overwrite").option("ignoreNullFields", "false")
        if compression:
            lines = lines.option("compression", compression).option("maxRecordsPerFile", PART_RECORDS)
        lines.json(path)
    elif format_type == "json":
        buckets = -(-records.count() // ARRAY_RECORDS) or 1
        line = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
        dealt = records.select(line.alias("value")).withColumn(
            "bucket", F.pmod(F.xxhash64("value", F.monotonically_increasing_id()), F.lit(buckets))
        )
        arrays = dealt.groupBy("bucket").agg(
            F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value")
        )
        arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    else:
        raise ValueError(f"Unsupported format: {format_type}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to ``path``."""
    context = spark.sparkContext
    location = context._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(context._jsc.hadoopConfiguration()).exists(location)


def append_results(results: DataFrame, path: str) -> None:
    """Add runs to the history; a run of a test that is written again replaces itself."""
    (
        results.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("test_name", "run_ts")
        .parquet(path)
    )


def read_results(spark: SparkSession, path: str, test_name: str | None = None) -> DataFrame:
    """History or baselines; a test name prunes to its partition."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.RESULTS)
    rows = spark.read.schema(schemas.RESULTS).parquet(path)
    return rows if test_name is None else rows.filter(F.col("test_name") == test_name)


def _subfolders(spark: SparkSession, path: str, column: str) -> list[tuple[str, str]]:
    """``(value, path)`` of the partitions of one column right below ``path``."""
    context = spark.sparkContext
    location = context._jvm.org.apache.hadoop.fs.Path(path)
    found = location.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(location)
    folders = ((status.getPath().getName(), status.getPath().toString()) for status in found if status.isDirectory())
    mark = f"{column}="
    return [(unquote(name.removeprefix(mark)), folder) for name, folder in folders if name.startswith(mark)]


def read_latest_results(spark: SparkSession, path: str, test_name: str | None = None) -> DataFrame:
    """The newest run of every test, or of one, from a history.

    The newest run is read off the names of the partitions, one listing for each
    test, so the plan scans that run alone however many years the history holds.
    """
    none = spark.createDataFrame([], schemas.RESULTS)
    if not exists(spark, path):
        return none
    newest = []
    for test, folder in _subfolders(spark, path, "test_name"):
        if test_name is None or test == test_name:
            runs = [(int(run), run_folder) for run, run_folder in _subfolders(spark, folder, "run_ts")
                    if run.lstrip("-").isdigit()]
            newest += [max(runs)[1]] if runs else []
    if not newest:
        return none
    return spark.read.schema(schemas.RESULTS).option("basePath", path).parquet(*newest)


def write_baselines(results: DataFrame, path: str) -> None:
    """Replace the baseline of the tests in ``results``, leave others alone."""
    (
        results.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("test_name")
        .parquet(path)
    )


def write_report(path: str, **tables: DataFrame) -> None:
    """One table per report part under ``path``."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")

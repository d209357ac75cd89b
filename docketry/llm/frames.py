"""Small helpers the corpus operators share."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.session import work_folder

#: Most bytes of text that a Python worker handles at once; longer texts go alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its plain name, which may hold dots."""
    return F.col(f"`{name.replace('`', '``')}`")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """``frame`` written to the shared folder and read again: lineage ends here,
    and no lost executor makes its work be done again."""
    spark = frame.sparkSession
    path = work_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of long texts small in every process."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``SLICE_BYTES`` each."""
    for batch in batches:
        size = batch.column(column).nbytes
        rows = max(1, batch.num_rows * SLICE_BYTES // max(size, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

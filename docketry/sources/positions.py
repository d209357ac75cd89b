"""The place of a record among all records of a path, as a key.

Record files have an order, and records without an id can only be told apart by
it.  A distributed reader sees splits of files, so the key is made in three
steps: records are counted per split, the counts, one small row for each split,
are summed over the splits before, and each record adds its number inside the
split.  No record is shuffled and none passes through one task.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docketry import schemas
from docketry.session import work_folder
from docketry.sources.datasets import PART_RECORDS, read_records

POSITION = "position"
_SPLIT = ("_file", "_begin")


def split_offsets(counts: DataFrame) -> DataFrame:
    """``_file, _begin, _records`` with the number of records before as ``_before``.

    Sums run inside each file first; only the totals of files go through one
    window over all of them.
    """
    inside = Window.partitionBy("_file").orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("_file").agg(F.sum("_records").alias("_total"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("_file", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    within = counts.withColumn("_within", F.coalesce(F.sum("_records").over(inside), F.lit(0)))
    return within.join(bases, "_file").withColumn("_before", F.col("_base") + F.col("_within"))


def read_numbered(spark: SparkSession, path: str, schema: str = schemas.SAMPLES) -> DataFrame:
    """Records with their ``position`` from 0, files by name and records in their order.

    Blank lines are no records.  A folder that :func:`write_ordered` wrote comes
    back in the order of the export, whatever the number of its files or of the
    splits it is read in.  The numbered records are written to the working folder
    once, so a lost executor or a second use cannot number them differently.
    """
    records = read_records(spark, path, schema)
    numbered = records.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_begin"),
        # Consecutive within a task, and a split lies in one task.
        F.monotonically_increasing_id().alias("_number"),
    )
    folder = work_folder(spark, "numbered")
    numbered.write.option("compression", "zstd").parquet(folder)
    stored = spark.read.schema(numbered.schema).parquet(folder)
    counts = stored.groupBy(*_SPLIT).agg(
        F.count(F.lit(1)).alias("_records"), F.min("_number").alias("_first")
    )
    # One small row a split.  Estimates take it for a part of the records, and from some
    # size on both sides would be shuffled before adaptive execution knows better.
    offsets = F.broadcast(split_offsets(counts).select(*_SPLIT, "_before", "_first"))
    placed = stored.join(offsets, list(_SPLIT))
    position = F.col("_before") + F.col("_number") - F.col("_first")
    return placed.select(*records.columns, position.alias(POSITION))


def write_ordered(records: DataFrame, path: str, *order: str, files: int | None = None) -> None:
    """Records as compressed JSON lines in the order of some columns, which are left out.

    Ranges of the order are sorted apart; the names of the files follow it.  There
    are ``files`` of them, or a multiple of it where a file would hold more than about
    ``PART_RECORDS``: a compressed file is read by one task, and sorting a range
    then stays in memory.  What is shuffled and sorted are the finished lines, which
    are smaller than rows.
    """
    kept = [c for c in records.columns if c not in order]
    line = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})
    lines = records.select(*order, line.alias("_line"))
    if files:
        ranges = files * (-(-records.count() // (files * PART_RECORDS)) or 1)
        dealt = lines.repartitionByRange(ranges, *order)
    else:
        dealt = lines.repartitionByRange(*order)
    # Equal keys lie in one range, so a range can be longer; it is cut in its order.
    dealt.sortWithinPartitions(*order).select("_line").write.mode("overwrite").option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", 2 * PART_RECORDS).text(path)

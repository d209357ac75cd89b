"""Pairing of two sides whose records are numbered alike, moved in packed blocks.

Numbered records lie in runs of consecutive numbers, so a run can be packed column
by column and compressed before it is shuffled; as rows the same records take a
multiple of the bytes, and every one of them is sorted.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, types as T

#: Numbers of a block, which is unpacked as a whole.
BLOCK = 4_096
UNPAIRED = "Predictions and ground truth must have same number of samples"
_PACKED = "block bigint, piece binary"


def _piece(run: pa.RecordBatch) -> bytes:
    # Parquet pages of nested columns are a third smaller than compressed Arrow buffers.
    sink = pa.BufferOutputStream()
    pq.write_table(
        pa.Table.from_batches([run]), sink, compression="zstd", use_dictionary=False, write_statistics=False
    )
    return sink.getvalue().to_pybytes()


def packed(records: DataFrame, key: str) -> DataFrame:
    """``block, piece``: the runs of a block's numbers that lie together in a batch.

    Records in another order are packed as rightly, in smaller pieces."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = pc.run_end_encode(pc.divide(batch.column(key), BLOCK), run_end_type=pa.int32())
            ends = runs.run_ends.to_pylist()
            for block, begin, end in zip(runs.values.to_pylist(), [0, *ends], ends, strict=False):
                piece = _piece(batch.slice(begin, end - begin))
                yield pa.record_batch({"block": pa.array([block], pa.int64()), "piece": pa.array([piece], pa.binary())})

    return records.mapInArrow(pack, _PACKED)


def _unpacked(pieces: pa.Table, key: str) -> pa.Table:
    """The records of a block by number."""
    rows = pa.concat_tables(
        pq.read_table(pa.BufferReader(piece.as_buffer()), use_threads=False) for piece in pieces.column("piece")
    )
    return rows.take(pc.sort_indices(rows.column(key)))


def _pair(key: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            raise ValueError(UNPAIRED)
        left, right = _unpacked(left, key), _unpacked(right, key)
        if not left.column(key).equals(right.column(key)):
            raise ValueError(UNPAIRED)
        for name in right.column_names:
            if name != key:
                left = left.append_column(name, right.column(name))
        return left

    return pair


def pair_numbered(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both sides side by side; fails when a number lacks its partner.

    The numbers of a side are whole, from 0 and each there once, as
    ``sources.positions.read_numbered`` gives them.
    """
    more = [field for field in right.schema if field.name != key]
    blocks = packed(left, key).groupBy("block").cogroup(packed(right, key).groupBy("block"))
    return blocks.applyInArrow(_pair(key), T.StructType([*left.schema, *more]))

"""Finite hand-off of record batches to a consumer, pulled one at a time, with counts on both sides.

Batches go from the executors' partitions to the consumer without a shuffle; there is no event time
and no unbounded stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def hand_off(df: DataFrame, consumer: Callable[[pa.RecordBatch], None]) -> dict[str, int]:
    """Give every batch to `consumer`, on the executors; empty batches too. Returns rows and batches, in and out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0, 0, 0, 0]
        for b in batches:
            counts[0] += 1
            counts[1] += b.num_rows
            consumer(b)
            counts[2] += 1
            counts[3] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in counts], names=["batches_in", "rows_in", "batches_out", "rows_out"])

    counted = df.mapInArrow(run, "batches_in bigint, rows_in bigint, batches_out bigint, rows_out bigint")
    row = counted.groupBy().sum().first()
    return {k[4:-1]: v or 0 for k, v in row.asDict().items()}

"""Sums of long vectors over partitions, without bringing the partial ones to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import lean

PART = 4096  # cells of a row
SCHEMA = "part int, cells binary"


def vector_rows(vector: np.ndarray) -> pa.RecordBatch:
    """A vector of float64 as (part, cells) rows; parts of zeros are left out."""
    flat = np.ascontiguousarray(vector, np.float64).ravel()
    parts = [(k, flat[k * PART : (k + 1) * PART]) for k in range(-(-len(flat) // PART))]
    parts = [(k, x) for k, x in parts if x.any()]
    return pa.record_batch([pa.array([k for k, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], ["part", "cells"])


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all vectors of ``size`` cells in (part, cells) rows.

    Parts meet on the executors in two levels, first among some of the tasks that made them, then all of a part,
    each partition adding batch by batch in the memory of its own parts; the driver gets one vector, whose
    size is fixed by the caller's parameters and not by the data.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(cells.as_buffer(), np.float64)
                totals[k] = totals[k] + x if k in totals else x.copy()
        yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["part", "cells"])

    n = max(1, min(64, -(-size // (16 * PART))))
    some = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    near = rows.withColumn("task", F.spark_partition_id()).repartition(some, "part", "task").select("part", "cells").mapInArrow(lean(add), SCHEMA)
    out = np.zeros(-(-size // PART) * PART)
    for row in near.repartition(n, "part").mapInArrow(lean(add), SCHEMA).collect():
        x = np.frombuffer(row.cells, np.float64)
        out[row.part * PART : row.part * PART + len(x)] += x
    return out[:size]

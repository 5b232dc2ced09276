"""Batches between the JVM and Python workers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of one Arrow batch: rows hold whole files, so a bound on rows alone is none.
BATCH_BYTES = 16 << 20
#: Bytes of output that a worker gathers before it hands a batch over.
OUT_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a smaller bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not now or not now.isdigit() or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def batches_of(rows, schema: pa.Schema, most: int = OUT_BYTES):
    """Record batches of (row, bytes) pairs, each of about `most` bytes or of one larger row."""
    some, size = [], 0
    for row, n in rows:
        some.append(row)
        size += n
        if size >= most or len(some) >= 10_000:
            yield pa.RecordBatch.from_pylist(some, schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=schema)

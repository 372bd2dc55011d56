"""Sizes of the Arrow batches that go to Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTES = 2 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Lowers the session's bound on an Arrow batch to ``BYTES``, if it is larger: a worker, and the task that feeds it,
    hold whole batches, and rows here are texts and files."""
    said = spark.conf.get(_SETTING).strip().lower().removesuffix("b")
    if not said.isdigit() or int(said) > BYTES:
        spark.conf.set(_SETTING, str(BYTES))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out by their values: a file of one row group is read by one task, which would otherwise do the slow
    work that follows alone. The number of partitions is given, as small rows would be put together again."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, F.xxhash64(*df.columns))


def parts(sizes: Iterable[int]) -> Iterator[slice]:
    """Runs of items, each ended by the item that makes ``BYTES``, as soon as it is there."""
    at = end = size = 0
    for n in sizes:
        end, size = end + 1, size + n
        if size >= BYTES:
            yield slice(at, end)
            at, size = end, 0
    if end > at:
        yield slice(at, end)


def batched(rows: Iterable[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come with their sizes: of at most 1,000 rows, and ended by the row that makes ``BYTES``."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) == 1000 or size >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.batches import bounded

#: The white space of the word contracts: space and 0x09 to 0x0D; bytes.split() splits at just these.
SPACES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a local folder is set, if Spark runs in this process alone (tests, a laptop); on a
    cluster that would lose rows silently, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/parchlake/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder: nothing is computed twice, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, with as many _ behind it as make it differ from all that are taken (in whatever case)."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name += "_"
    return name


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; nulls stay None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.view(kind).to_pylist()


def in_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded size; workers, which live on, give back to the system what a task has freed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def parts(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches without empty ones, in parts of few rows: Python objects of a whole batch of texts would take much memory."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """For each part of an Arrow batch one batch or none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            if (out := fn(b)) is not None:
                yield out

    return in_arrow(df, run, schema)


class Remembered(dict):
    """A dict that computes what it lacks; it starts anew beyond `most` entries, so memory stays bounded."""

    def __init__(self, fn: Callable, most: int = 500_000) -> None:
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if len(self) >= self.most:
            self.clear()
        # very long keys would make the bound on entries no bound on bytes
        value = self.fn(key)
        if len(key) <= 256:
            self[key] = value
        return value

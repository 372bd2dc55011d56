"""New files of a folder as a stream of rows: stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.pdf import read_bytes

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_pdf(spark: SparkSession, path: str, level: str = "text", files_per_trigger: int = 100) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.pdf").load(path)
    return read_bytes(files, level)

"""Exports of documents with their chunks: one JSON value per document, or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import chunk_documents
from ..functions.strings import METADATA

SCHEMA_TAG = "parchlake.document.v1"


def _metadata(meta: DataFrame | None, docs: DataFrame, doc_col: str) -> DataFrame:
    fields = ",".join(f"{k}:string" for k in METADATA)
    none = F.struct(*(F.lit(None).cast("string").alias(k) for k in METADATA))
    if meta is None:
        return docs.withColumn("metadata", none)
    return docs.join(meta.select(doc_col, F.col("metadata").cast(f"struct<{fields}>")), doc_col, "left").withColumn("metadata", F.coalesce("metadata", none))


def export_json(pages: DataFrame, doc_col: str, page_col: str, text_col: str, meta: DataFrame | None = None, max_chars: int | None = None, overlap: int | None = None, pretty: bool = True) -> DataFrame:
    """(doc, json): schema, metadata, page_count, pages and chunks; page numbers are 0-based."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    page = F.struct(F.col(page_col).alias("page"), text.alias("text"), F.length(text).alias("char_count"))
    docs = pages.groupBy(doc_col).agg(F.sort_array(F.collect_list(page)).alias("pages"))
    chunks = chunk_documents(pages, doc_col, page_col, text_col, max_chars, overlap)
    chunk = F.struct(F.col("chunk_id").alias("id"), "page_start", "page_end", "text", "char_count")
    chunks = chunks.groupBy(doc_col).agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    out = _metadata(meta, docs.join(chunks, doc_col, "left"), doc_col)
    value = F.struct(F.lit(SCHEMA_TAG).alias("schema"), "metadata", F.size("pages").alias("page_count"), "pages", F.coalesce("chunks", F.array().cast(dict(chunks.dtypes)["chunks"])).alias("chunks"))
    return out.select(doc_col, F.to_json(value, {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def export_lines(pages: DataFrame, doc_col: str, page_col: str, text_col: str, meta: DataFrame | None = None, max_chars: int | None = None, overlap: int | None = None) -> DataFrame:
    """(doc, line_no, line): a header line per document, then a line per chunk."""
    chunks = chunk_documents(pages, doc_col, page_col, text_col, max_chars, overlap)
    docs = pages.groupBy(doc_col).agg(F.count("*").alias("page_count")).join(chunks.groupBy(doc_col).agg(F.count("*").alias("chunk_count")), doc_col, "left")
    docs = _metadata(meta, docs.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))), doc_col)
    keep = {"ignoreNullFields": "false"}
    head = docs.select(doc_col, F.lit(0).alias("line_no"), F.to_json(F.struct(F.lit(SCHEMA_TAG).alias("schema"), F.lit("document").alias("kind"), "metadata", "page_count", "chunk_count"), keep).alias("line"))
    body = chunks.select(doc_col, (F.col("chunk_id") + 1).alias("line_no"), F.to_json(F.struct(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "page_start", "page_end", "text", "char_count"), keep).alias("line"))
    return head.unionByName(body)

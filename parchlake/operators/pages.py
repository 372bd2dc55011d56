"""Selecting, rearranging and merging pages: plans over tables of (document, page) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTER = (0.0, 0.0, 612.0, 792.0)


def parse_ranges(df: DataFrame, spec_col: str, count_col: str, blank_is_all: bool = True) -> DataFrame:
    """Adds `pages` (0-based, in the order asked for, repeats kept) and `code` (null, ERROR or PAGE_OUT_OF_RANGE).

    A spec is 1-based, like `1-3,5`; blank parts are skipped. A blank spec means all pages, or an error.
    """
    held = "ends"
    while held in df.columns:
        held += "_"
    spec = F.trim(F.coalesce(F.col(spec_col), F.lit("")))
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    ends = F.transform(parts, lambda x: F.struct(F.try_to_number(F.trim(F.regexp_extract(x, r"^(\d+)\s*(?:-\s*\d+)?$", 1)), F.lit("9999999999")).cast("long").alias("lo"), F.try_to_number(F.trim(F.regexp_extract(x, r"^(?:\d+\s*-\s*)?(\d+)$", 1)), F.lit("9999999999")).cast("long").alias("hi")))
    out = df.withColumn(held, ends)
    bad = F.exists(held, lambda x: x["lo"].isNull() | x["hi"].isNull() | (x["lo"] < 1) | (x["hi"] < x["lo"]))
    beyond = F.exists(held, lambda x: x["hi"] > F.col(count_col))
    empty = spec == ""
    code = F.when(empty, F.lit(None if blank_is_all else "ERROR")).when(bad | (F.size(held) == 0), "ERROR").when(beyond, "PAGE_OUT_OF_RANGE")
    all_ = F.when(F.col(count_col) > 0, F.sequence(F.lit(0), F.col(count_col).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    listed = F.flatten(F.transform(held, lambda x: F.sequence(x["lo"].cast("int") - 1, x["hi"].cast("int") - 1)))
    out = out.withColumn("code", code)
    return out.withColumn("pages", F.when(F.col("code").isNotNull(), F.lit(None).cast("array<int>")).when(empty, all_).otherwise(listed)).drop(held)


def select_pages(pages: DataFrame, wanted: DataFrame, doc_col: str, page_col: str) -> DataFrame:
    """Pages in the order of `wanted` (doc, pages): an index that comes twice gives the page twice."""
    asked = wanted.select(doc_col, F.posexplode("pages").alias("new_index", page_col))
    return pages.join(asked, [doc_col, page_col])


def delete_pages(pages: DataFrame, gone: DataFrame, doc_col: str, page_col: str) -> DataFrame:
    """Pages that are not in `gone`, with a dense new index."""
    left = pages.join(gone.select(doc_col, page_col), [doc_col, page_col], "left_anti")
    return left.withColumn("new_index", F.row_number().over(Window.partitionBy(doc_col).orderBy(page_col)) - 1)


def reorder_pages(pages: DataFrame, order: DataFrame, doc_col: str, page_col: str) -> DataFrame:
    """Applies `order` (doc, new_index, page) where it is an exact permutation; `valid` tells."""
    n = pages.groupBy(doc_col).agg(F.count("*").alias("n"))
    ok = order.groupBy(doc_col).agg(F.count("*").alias("k"), F.count_distinct(page_col).alias("d"), F.max(page_col).alias("m"), F.min(page_col).alias("lo"))
    valid = n.join(ok, doc_col, "left").select(doc_col, F.coalesce((F.col("k") == F.col("n")) & (F.col("d") == F.col("n")) & (F.col("m") < F.col("n")) & (F.col("lo") >= 0), F.lit(False)).alias("valid"))
    placed = pages.join(valid, doc_col).join(order.select(doc_col, page_col, "new_index"), [doc_col, page_col], "left")
    return placed.withColumn("new_index", F.when(F.col("valid"), F.col("new_index")).otherwise(F.col(page_col)).cast("int"))


def merge_documents(pages: DataFrame, source_col: str, page_col: str, target: Column | None = None) -> DataFrame:
    """All pages in the order of sources and pages; `target` groups sources into output documents."""
    w = Window.partitionBy(target if target is not None else F.lit(0)).orderBy(source_col, page_col)
    return pages.withColumn("new_index", F.row_number().over(w) - 1)


def joined_text(pages: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """One text per document: its pages, joined by form feeds."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(page_col).alias("p"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))), lambda x: x["t"])
    return pages.groupBy(doc_col).agg(F.array_join(texts, "\f").alias("text"))


def rotation(rotate: Column, delta: Column | None = None) -> Column:
    """The angle in 0..359 after a turn; null where the sum is no multiple of 90."""
    base = F.pmod(F.coalesce(rotate.cast("long"), F.lit(0)), F.lit(360))
    if delta is None:
        return base
    total = F.pmod(base + delta, F.lit(360))
    return F.when(total % 90 == 0, total)


def box(*candidates: Column) -> Column:
    """The first box that is there, else the default page."""
    letter = F.struct(*(F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), LETTER, strict=True)))
    return F.coalesce(*candidates, letter)


def valid_box(b: Column) -> Column:
    return (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])

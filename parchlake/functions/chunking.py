"""Overlapping chunks of paged text: pure kernels and their Arrow form."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space; str.strip() would also strip four separators that don't have this property.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ENDS = ".!?\n"
MAX_CHARS, OVERLAP, LEAST_CHARS = 2000, 200, 64
CHUNK = "chunk_id int, page_start int, page_end int, text string, char_count int"


def options(max_chars: int | None = None, overlap: int | None = None) -> tuple[int, int]:
    """Defaults for what is missing or out of range; at least 64 characters, and at most half of them overlap."""
    size = MAX_CHARS if max_chars is None or max_chars <= 0 else max_chars
    over = OVERLAP if overlap is None or overlap < 0 else overlap
    size = max(size, LEAST_CHARS)
    return size, min(over, size // 2)


def hard_split(text: str, size: int, overlap: int) -> list[str]:
    """Windows of `size` characters that end at a sentence's end if there is one in their last fifth."""
    at, out = 0, []
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            last = max(text.rfind(c, at + size * 4 // 5, end) for c in ENDS)
            end = last + 1 if last >= 0 else end
        out.append(text[at:end].strip(BLANKS))
        if end == len(text):
            break
        at = end - overlap if end - overlap > at else end
    return [x for x in out if x]


def overlap_tail(text: str, overlap: int) -> str:
    """The last `overlap` characters from the next blank on; the whole text if it is no longer."""
    if not overlap:
        return ""
    if len(text) <= overlap:
        return text
    tail = text[-overlap:]
    return next((tail[i:].strip(BLANKS) for i, c in enumerate(tail) if c in BLANKS), "")


def chunked(pages: Iterable[tuple[int, str]], size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first page, last page, text) of each chunk of a document's (page, text) pairs, which come in order."""
    out: list[tuple[int, int, str]] = []
    held, first, last = "", 0, 0

    def flush() -> None:
        if text := held.strip(BLANKS):
            out.append((first, last, text))

    for page, text in pages:
        for unit in filter(None, (x.strip(BLANKS) for x in text.split("\n\n"))):
            if len(unit) > size:
                flush()
                out += [(page, page, x) for x in hard_split(unit, size, overlap)]
                held, first, last = "", page, page
                continue
            if not held:
                held, first = unit, page
            elif len(held) + len(unit) + 2 > size:
                tail = overlap_tail(held, overlap)
                flush()
                held, first = (f"{tail}\n\n{unit}" if tail else unit), page
            else:
                held = f"{held}\n\n{unit}"
            last = page
    flush()
    return out


def chunk_documents(pages: DataFrame, doc_col: str, page_col: str, text_col: str, max_chars: int | None = None, overlap: int | None = None) -> DataFrame:
    """Chunks of each document, from rows of pages: one shuffle by document, then a fold over its pages in order."""
    size, over = options(max_chars, overlap)
    kind = dict(pages.dtypes)[doc_col]
    docs = pages.groupBy(F.col(doc_col).alias("doc")).agg(F.sort_array(F.collect_list(F.struct(F.col(page_col).cast("int").alias("p"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))).alias("pages"))
    return _folded(docs, kind, size, over).withColumnRenamed("doc", doc_col)


def chunk_texts(docs: DataFrame, doc_col: str, text_col: str, max_chars: int | None = None, overlap: int | None = None) -> DataFrame:
    """Chunks of documents of a single page: no shuffle at all."""
    size, over = options(max_chars, overlap)
    one = docs.select(F.col(doc_col).alias("doc"), F.array(F.struct(F.lit(0).alias("p"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))).alias("pages"))
    return _folded(one, dict(docs.dtypes)[doc_col], size, over).withColumnRenamed("doc", doc_col)


def _folded(docs: DataFrame, kind: str, size: int, over: int) -> DataFrame:
    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, pages in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(doc, k, s, e, t, len(t)) for k, (s, e, t) in enumerate(chunked([(x["p"], x["t"]) for x in pages], size, over))]
            if rows:
                types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc", *(x.split()[0] for x in CHUNK.split(", "))])

    return docs.mapInArrow(fn, f"doc {kind}, {CHUNK}")

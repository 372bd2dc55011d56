"""The `pdf` data source: files to rows of documents, pages or objects, and rows back to files.

Reading has four levels: `meta` (a row per file), `pages` (a row per page, without text), `text` (with text) and
`objects`. A file that can't be read gives a row with an error code; it fails no job. Bytes come from Spark's
`binaryFile` reader, so any store that Spark reads will do, and a file is one task's unit of work.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.batches import batched, bounded, parts, spread
from ..kernel import edit, text
from ..kernel.document import Document
from ..kernel.model import PdfError, edges, serialize

META_KEYS = tuple(edit.INFO)
SCHEMAS = {
    "meta": f"path string, length long, version string, encrypted boolean, object_count int, page_count int, trailer_keys array<string>, root struct<num:long,gen:int>, metadata struct<{','.join(f'{k}:string' for k in META_KEYS)}>, error struct<code:string,message:string>",
    "pages": "path string, page_index int, obj_num long, obj_gen int, rotate int, media_box struct<x0:double,y0:double,x1:double,y1:double>, crop_box struct<x0:double,y0:double,x1:double,y1:double>, error struct<code:string,message:string>",
    "text": "path string, page_index int, text string, char_count int, error struct<code:string,message:string>",
    "objects": "path string, obj_num long, obj_gen int, kind string, raw binary, refs array<struct<num:long,gen:int>>, error struct<code:string,message:string>",
}


#: What a malformed file can raise.
FAULTS = (PdfError, RecursionError, ValueError, IndexError, TypeError, KeyError, OverflowError)


def _failed(e: Exception) -> dict:
    return {"code": getattr(e, "code", "ERROR"), "message": str(e)[:500]}


def _box(b: tuple) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), b, strict=True))


def _meta(path: str, data: bytes, doc: Document) -> Iterator[dict]:
    i = doc.inspect()
    yield {"path": path, "length": len(data), "version": i.version, "encrypted": i.encrypted, "object_count": i.object_count, "page_count": i.page_count, "trailer_keys": i.trailer_keys, "root": i.root and {"num": i.root.num, "gen": i.root.gen}, "metadata": edit.metadata(doc)}


def _pages(path: str, data: bytes, doc: Document) -> Iterator[dict]:
    for k, ref in enumerate(doc.page_refs()):
        yield {"path": path, "page_index": k, "obj_num": ref.num, "obj_gen": ref.gen, "rotate": edit.rotation(doc, k), "media_box": _box(edit.media_box(doc, k)), "crop_box": _box(edit.crop_box(doc, k))}


def _text(path: str, data: bytes, doc: Document) -> Iterator[dict]:
    for k, ref in enumerate(doc.page_refs()):
        try:
            t = text.page_text(doc, ref)
            yield {"path": path, "page_index": k, "text": t, "char_count": len(t)}
        except FAULTS as e:
            yield {"path": path, "page_index": k, "error": _failed(e)}


def _objects(path: str, data: bytes, doc: Document) -> Iterator[dict]:
    for ref, v in sorted(doc.objects.items()):
        kind = {"NoneType": "null", "bytes": "string", "HexBytes": "string", "dict": "dictionary", "list": "array", "Ref": "reference"}.get(type(v).__name__, type(v).__name__.lower())
        yield {"path": path, "obj_num": ref.num, "obj_gen": ref.gen, "kind": kind, "raw": serialize(v), "refs": [{"num": r.num, "gen": r.gen} for r in edges(v)]}


ROWS: dict[str, Callable] = {"meta": _meta, "pages": _pages, "text": _text, "objects": _objects}


def rows_of(level: str, path: str, data: bytes, password: str = "") -> Iterator[dict]:
    """Rows of one file; an error becomes a row. Only the level's own work is done."""
    try:
        yield from ROWS[level](path, data, Document.load(data, password))
    except FAULTS as e:
        yield {"path": path, "error": _failed(e)} | ({"length": len(data)} if level == "meta" else {})


def read_bytes(files: DataFrame, level: str = "text", path_col: str = "path", content_col: str = "content", password_col: str | None = None) -> DataFrame:
    """Rows of the level, from rows of (path, content[, password]); one file is parsed at a time."""
    schema = T._parse_datatype_string(SCHEMAS[level])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    size = lambda row: len(row.get("text") or "") + len(row.get("raw") or b"")

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from batched(((row, size(row)) for path, content, pw in zip(*b.columns, strict=True) for row in rows_of(level, path.as_py(), content.as_py() or b"", pw.as_py() or "")), arrow)

    pw = F.col(password_col) if password_col else F.lit("")
    bounded(files.sparkSession)
    return files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).alias("content"), pw.alias("password")).mapInArrow(fn, schema)


def read_pdf(spark: SparkSession, path: str, level: str = "text", password: str = "") -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return read_bytes(files.withColumn("password", F.lit(password)), level, password_col="password")


def _outputs(files: DataFrame, made: Callable[..., Iterable], path_col: str, content_col: str, password: str, password_col: str | None, args: tuple[str, ...]) -> DataFrame:
    """(path, part, content, error): what `made(document, *args)` gives of each file, args being its row's values."""
    schema = "path string, part int, content binary, error struct<code:string,message:string>"
    arrow = pa.schema([("path", pa.string()), ("part", pa.int32()), ("content", pa.binary()), ("error", pa.struct([("code", pa.string()), ("message", pa.string())]))])

    def rows(path: pa.Scalar, content: pa.Scalar, pw: pa.Scalar, own: list[pa.Scalar]) -> Iterator[tuple[dict, int]]:
        k = 0
        try:
            for done in made(Document.load(content.as_py() or b"", pw.as_py() or ""), *(x.as_py() for x in own)):
                out = done if isinstance(done, bytes) else done.to_bytes()
                yield {"path": path.as_py(), "part": k, "content": out}, len(out)
                k += 1
        except FAULTS as e:
            yield {"path": path.as_py(), "part": k, "error": _failed(e)}, 0

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from batched((row for path, content, pw, *own in zip(*b.columns, strict=True) for row in rows(path, content, pw, own)), arrow)

    bounded(files.sparkSession)
    pw = F.col(password_col).cast("string") if password_col else F.lit(password)
    return files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).alias("content"), pw.alias("password"), *(F.col(c).alias(f"arg{k}") for k, c in enumerate(args))).mapInArrow(fn, schema)


def transform_bytes(files: DataFrame, change: Callable[..., Document], path_col: str = "path", content_col: str = "content", password: str = "", password_col: str | None = None, args: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, error): each file changed and written anew; files that fail have no content.

    Passwords come from a column, if one is named, and so do further arguments of `change`: each row's own page spec,
    angle, box or metadata.
    """
    return _outputs(files, lambda doc, *own: [change(doc, *own)], path_col, content_col, password, password_col, args).drop("part")


def split_bytes(files: DataFrame, path_col: str = "path", content_col: str = "content", password: str = "", password_col: str | None = None) -> DataFrame:
    """(path, part, content, error): a file of one page for each page, made one after the other."""
    pages = lambda doc: (edit.extract(doc, [k]) for k in range(len(doc.page_refs())))
    return _outputs(files, pages, path_col, content_col, password, password_col, ())


def merge_bytes(files: DataFrame, group_col: str, order_col: str, content_col: str = "content") -> DataFrame:
    """(group, content, error): the files of each group, merged in order. A group is one output file, so it fits one task."""
    kind = dict(files.dtypes)[group_col]
    rows = files.groupBy(F.col(group_col).alias("grp")).agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(content_col).alias("c")))).alias("parts"))
    error = pa.struct([("code", pa.string()), ("message", pa.string())])

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[tuple[bytes | None, dict | None]] = []

            def sizes(b: pa.RecordBatch = b, made: list = made) -> Iterator[int]:
                for group in b.column(1):
                    try:
                        made.append((edit.merge([Document.load(p["c"].as_py()) for p in group]).to_bytes(), None))
                    except FAULTS as e:
                        made.append((None, _failed(e)))
                    yield len(made[-1][0] or b"")

            for s in parts(sizes()):
                out, err = zip(*made, strict=True)
                made.clear()
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.array(out, pa.binary()), pa.array(err, error)], ["grp", "content", "error"])

    bounded(files.sparkSession)
    return rows.mapInArrow(fn, f"grp {kind}, content binary, error struct<code:string,message:string>").withColumnRenamed("grp", group_col)


def write_text_pdfs(pages: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """(doc, content): a file for each document, from its pages' texts."""
    docs = pages.groupBy(F.col(doc_col).alias("doc")).agg(F.sort_array(F.collect_list(F.struct(F.col(page_col).alias("p"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))).alias("pages"))
    return _written(docs, doc_col)


def write_texts(docs: DataFrame, doc_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, content, *keep): a file of one page for each row, with these of its columns; the rows are dealt out anew.
    Repeated ids give several files."""
    rows = spread(docs.select(F.col(doc_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *keep))
    return _written(rows.select("doc", F.array(F.struct(F.lit(0).alias("p"), "t")).alias("pages"), *keep), doc_col)


def _written(docs: DataFrame, doc_col: str) -> DataFrame:
    kinds = docs.select("doc", F.lit(b"").alias("content"), *docs.columns[2:]).schema

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[bytes] = []

            def sizes(b: pa.RecordBatch = b, made: list = made) -> Iterator[int]:
                for pages in b.column(1):
                    made.append(edit.text_document([x["t"] for x in pages.as_py()]).to_bytes())
                    yield len(made[-1])

            for s in parts(sizes()):
                done = pa.array(made, pa.binary())
                made.clear()
                yield b[s].set_column(1, "content", done)

    bounded(docs.sparkSession)
    return docs.mapInArrow(fn, kinds).withColumnRenamed("doc", doc_col)


def _tupled(v: object) -> object:
    if isinstance(v, list):
        return [_tupled(x) for x in v]
    return tuple(v.values()) if isinstance(v, dict) else v


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.options, self.names = options, names

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(f"{path}/*.pdf")) if os.path.isdir(path) else sorted(glob.glob(path))
        return [_Part(p) for p in found]

    def read(self, part: _Part) -> Iterator[tuple]:
        level = self.options.get("level", "text")
        with open(part.path, "rb") as f:
            data = f.read()
        for row in rows_of(level, part.path, data, self.options.get("password", "")):
            yield tuple(_tupled(row.get(n)) for n in self.names)


class _Message(WriterCommitMessage):
    def __init__(self, written: list[tuple[str, str]]) -> None:
        self.written = written


class _Writer(DataSourceWriter):
    """Writes rows (path, content) as files below the target folder; rows without content are passed over.

    A relative path stays as it is, of others the last part counts. Files appear when the whole job has succeeded. Two
    rows of one name, or a file that is there already (unless the mode is overwrite, which removes all files first),
    are an error.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"].removeprefix("file://"), overwrite
        self.held = f"{self.folder}/.parchlake-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.held, exist_ok=True)
        written = []
        for path, content, *_ in rows:
            if content is None:
                continue
            name = str(path).rstrip("/")
            if name.startswith("/") or "://" in name or name.startswith("file:") or ".." in name.split("/"):
                name = os.path.basename(name)
            name = name if name.endswith(".pdf") else f"{name}.pdf"
            tmp = f"{self.held}/{uuid.uuid4().hex}"
            with open(tmp, "wb") as f:
                f.write(bytes(content))
            written.append((tmp, name))
        return _Message(written)

    def commit(self, messages: list) -> None:
        written = [x for m in messages if m is not None for x in m.written]
        names = sorted(n for _, n in written)
        twice = [a for a, b in zip(names, names[1:], strict=False) if a == b]
        there = [] if self.overwrite else [n for n in names if os.path.exists(f"{self.folder}/{n}")]
        if twice or there:
            self.abort(messages)
            raise ValueError(f"files of one name: {(twice + there)[:5]}")
        if self.overwrite:
            for old in glob.glob(f"{glob.escape(self.folder)}/**/*.pdf", recursive=True):
                os.remove(old)
        for tmp, name in written:
            os.makedirs(os.path.dirname(f"{self.folder}/{name}"), exist_ok=True)
            os.replace(tmp, f"{self.folder}/{name}")
        shutil.rmtree(self.held, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.held, ignore_errors=True)


class PdfDataSource(DataSource):
    """`spark.read.format("pdf").option("level", ...)` and `df.write.format("pdf")`, for paths that all machines mount."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("level", "text")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema.names)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfDataSource)


def pretty(column: Column) -> Column:
    return F.to_json(column, {"pretty": "true", "ignoreNullFields": "false"})



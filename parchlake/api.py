"""The user operations on single files, and the same on tables of files.

The functions on bytes are what a table's tasks run for each file; `sources.pdf.transform_bytes` maps any of them over
a table. Page numbers are 1-based here, as in range specs.
"""

from __future__ import annotations

import json

from .functions.chunking import chunked, options
from .kernel import crypt, edit, text
from .kernel.document import Document
from .kernel.model import PdfError
from .operators.export import SCHEMA_TAG

VERSION = "0.1.0"

__all__ = ["PdfError", "VERSION", "crop", "decrypt", "delete_pages", "encrypt", "export", "extract_pages", "extract_text", "get_metadata", "inspect", "merge", "merge_list", "page_count", "reorder_pages", "rewrite", "rotate_pages", "roundtrip", "set_metadata", "split"]


def page_count(data: bytes, password: str = "") -> int:
    return Document.load(data, password).page_count()


def inspect(data: bytes, password: str = "") -> dict:
    i = Document.load(data, password).inspect()
    return {"version": i.version, "encrypted": i.encrypted, "objectCount": i.object_count, "pageCount": i.page_count, "root": f"{i.root.num} {i.root.gen}" if i.root else None, "trailerKeys": i.trailer_keys}


def get_metadata(data: bytes, password: str = "") -> dict[str, str | None]:
    return edit.metadata(Document.load(data, password))


def set_metadata(data: bytes, update: dict[str, str | None] | str, password: str = "") -> bytes:
    return edit.set_metadata(Document.load(data, password), json.loads(update) if isinstance(update, str) else update).to_bytes()


def _with_pages(data: bytes, spec: str, password: str) -> tuple[Document, list[int]]:
    doc = Document.load(data, password)
    return doc, edit.ranges(spec, doc.page_count())


def extract_pages(data: bytes, spec: str, password: str = "") -> bytes:
    return edit.extract(*_with_pages(data, spec, password)).to_bytes()


def delete_pages(data: bytes, spec: str, password: str = "") -> bytes:
    return edit.delete(*_with_pages(data, spec, password)).to_bytes()


def reorder_pages(data: bytes, spec: str, password: str = "") -> bytes:
    return edit.reorder(*_with_pages(data, spec, password)).to_bytes()


def rotate_pages(data: bytes, spec: str, degrees: int, password: str = "") -> bytes:
    return edit.rotate(*_with_pages(data, spec, password), degrees).to_bytes()


def split(data: bytes, password: str = "") -> list[bytes]:
    return [d.to_bytes() for d in edit.split(Document.load(data, password))]


def merge(files: list[bytes]) -> bytes:
    return edit.merge([Document.load(x) for x in files]).to_bytes()


def crop(data: bytes, page: int, x0: float, y0: float, x1: float, y1: float, password: str = "") -> bytes:
    if page < 1:
        raise PdfError("ERROR", "pages start at 1")
    return edit.set_box(Document.load(data, password), page - 1, x0, y0, x1, y1).to_bytes()


def extract_text(data: bytes, page: int = 0, password: str = "") -> str:
    return text.document_text(Document.load(data, password), page)


def export(data: bytes, max_chars: int | None = None, overlap: int | None = None, lines: bool = False, password: str = "") -> str:
    doc = Document.load(data, password)
    pages = [text.page_text(doc, r) for r in doc.page_refs()]
    chunks = [{"id": k, "page_start": s, "page_end": e, "text": t, "char_count": len(t)} for k, (s, e, t) in enumerate(chunked(enumerate(pages), *options(max_chars, overlap)))]
    head = {"schema": SCHEMA_TAG, "metadata": edit.metadata(doc), "page_count": len(pages)}
    if lines:
        first = {"schema": SCHEMA_TAG, "kind": "document"} | head | {"chunk_count": len(chunks)}
        return "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in (first, *({"kind": "chunk"} | c for c in chunks)))
    return json.dumps(head | {"pages": [{"page": k, "text": t, "char_count": len(t)} for k, t in enumerate(pages)], "chunks": chunks}, ensure_ascii=False, indent=2)


def encrypt(data: bytes, user: str, owner: str = "", password: str = "") -> bytes:
    return crypt.encrypt(Document.load(data, password), user, owner)


def decrypt(data: bytes, password: str) -> bytes:
    return Document.load(data, password).to_bytes()


def merge_list(paths: str) -> bytes:
    """Merges the files that a list names, one on a line; blank lines and white space around a path don't count."""
    names = [x.strip() for x in paths.split("\n") if x.strip()]
    if not names:
        raise PdfError("ERROR", "no input files")
    return merge([open(x, "rb").read() for x in names])


def roundtrip(data: bytes, password: str = "") -> tuple[int, int]:
    """Objects and pages of what writing and parsing again gives."""
    again = Document.load(Document.load(data, password).to_bytes())
    return len(again.objects), again.inspect().page_count or 0


def rewrite(data: bytes, password: str = "") -> bytes:
    return Document.load(data, password).to_bytes()

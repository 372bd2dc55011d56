"""Page selection, merging, geometry and metadata of single documents."""

from __future__ import annotations

import re

from .document import Document, new_document
from .model import Name, PdfError, Ref, Stream, edges, rewritten

INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
INFO = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "creation_date": "CreationDate", "mod_date": "ModDate"}


def ranges(spec: str, count: int, blank_is_all: bool = True) -> list[int]:
    """0-based indices of a 1-based spec like `1-3,5`; order and repeats are kept."""
    if not spec.strip():
        if blank_is_all:
            return list(range(count))
        raise PdfError("ERROR", "no pages given")
    out: list[int] = []
    for part in filter(None, map(str.strip, spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part, re.A)
        lo, hi = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
        if lo < 1 or hi < lo:
            raise PdfError("ERROR", f"bad page range {part}")
        if hi > count:
            raise PdfError("PAGE_OUT_OF_RANGE", f"page {hi} of {count}")
        out += range(lo - 1, hi)
    if not out:
        raise PdfError("ERROR", "no pages given")
    return out


def effective(doc: Document, ref: Ref) -> dict:
    """The page's dictionary with what it inherits."""
    page = dict(doc.dict_of(ref) or {})
    parent = doc.dict_of(page.get("Parent"))
    for _ in range(256):
        if parent is None:
            break
        for k in INHERITED:
            if k in parent:
                page.setdefault(k, parent[k])
        parent = doc.dict_of(parent.get("Parent"))
    return page


def _at(refs: list[Ref], index: int) -> Ref:
    if not 0 <= index < len(refs):
        raise PdfError("PAGE_OUT_OF_RANGE", f"page {index + 1} of {len(refs)}")
    return refs[index]


def copy_objects(source: Document, target: Document, roots: list[tuple[Ref, object]]) -> list[Ref]:
    """Copies the roots (own value given) and all they reach, numbered in order of discovery."""
    own = dict(roots)
    names: dict[Ref, Ref] = {}
    start = max((r.num for r in target.objects), default=0)
    order = [r for r, _ in roots]
    for k, r in enumerate(order):
        names[r] = Ref(start + 1 + k)
    at = 0
    while at < len(order):
        r = order[at]
        at += 1
        for e in edges(own.get(r, source.objects.get(r))):
            if e in source.objects and e not in names:
                names[e] = Ref(start + 1 + len(order))
                order.append(e)
    for r in order:
        target.objects[names[r]] = rewritten(own.get(r, source.objects.get(r)), names)
    return [names[r] for r, _ in roots]


def rebuild(doc: Document, refs: list[Ref]) -> None:
    """A flat page tree of these pages, inherited attributes written out."""
    full = {r: effective(doc, r) for r in refs}
    root = doc.trailer.get("Root")
    catalog = doc.catalog()
    pages = catalog.get("Pages") if isinstance(catalog.get("Pages"), Ref) else doc.add({})
    for r, d in full.items():
        doc.objects[r] = d | {"Type": Name("Page"), "Parent": pages}
    doc.objects[pages] = {"Type": Name("Pages"), "Kids": list(refs), "Count": len(refs)}
    doc.objects[doc.resolve_ref(root)] = catalog | {"Type": Name("Catalog"), "Pages": pages}


def _carry_info(source: Document, target: Document) -> None:
    info = source.trailer.get("Info")
    if isinstance(info, Ref) and info in source.objects:
        target.trailer["Info"] = copy_objects(source, target, [(info, source.objects[info])])[0]


def _copied(source: Document, target: Document, index: list[int], together: bool) -> list[Ref]:
    refs = source.page_refs()
    roots = [(r := _at(refs, i), {k: v for k, v in effective(source, r).items() if k != "Parent"}) for i in index]
    if together:
        return copy_objects(source, target, roots)
    return [copy_objects(source, target, [x])[0] for x in roots]


def extract(doc: Document, index: list[int]) -> Document:
    """A new document of these pages; a repeated index gives the page again."""
    if not index:
        raise PdfError("ERROR", "no pages given")
    out = new_document(doc.version)
    rebuild(out, _copied(doc, out, index, together=False))
    _carry_info(doc, out)
    return out


def split(doc: Document) -> list[Document]:
    return [extract(doc, [i]) for i in range(len(doc.page_refs()))]


def delete(doc: Document, index: list[int]) -> Document:
    refs = doc.page_refs()
    gone = {_at(refs, i) for i in index}
    left = [r for r in refs if r not in gone]
    if not left:
        raise PdfError("ERROR", "all pages would be deleted")
    rebuild(doc, left)
    doc.collect_garbage()
    return doc


def reorder(doc: Document, order: list[int]) -> Document:
    refs = doc.page_refs()
    if sorted(order) != list(range(len(refs))):
        raise PdfError("ERROR", "the order is no permutation of the pages")
    rebuild(doc, [refs[i] for i in order])
    return doc


def merge(docs: list[Document]) -> Document:
    if not docs:
        raise PdfError("ERROR", "nothing to merge")
    out = new_document(max(d.version for d in docs))
    rebuild(out, [r for d in docs for r in _copied(d, out, list(range(len(d.page_refs()))), together=True)])
    if (first := next((d for d in docs if isinstance(r := d.trailer.get("Info"), Ref) and d.resolve(r) is not None), None)) is not None:
        _carry_info(first, out)
    return out


def rotation(doc: Document, index: int) -> int:
    v = doc.inherited(doc.dict_of(_at(doc.page_refs(), index)), "Rotate")
    return v % 360 if type(v) is int else 0


def _set(doc: Document, index: int, key: str, value: object) -> None:
    ref = _at(doc.page_refs(), index)
    doc.objects[ref] = (doc.dict_of(ref) or {}) | {key: value}


def set_rotation(doc: Document, index: int, degrees: int) -> None:
    if degrees % 90:
        raise PdfError("ERROR", "a rotation is a multiple of 90")
    _set(doc, index, "Rotate", degrees % 360)


def rotate(doc: Document, index: list[int], delta: int) -> Document:
    """Turns each page; a repeated index turns it again."""
    for i in index:
        set_rotation(doc, i, rotation(doc, i) + delta)
    return doc


def _box(v: object, doc: Document) -> tuple[float, ...] | None:
    v = [doc.resolve(x) for x in v] if isinstance(v, list) and len(v) == 4 else None
    return tuple(map(float, v)) if v and all(type(x) in (int, float) for x in v) else None


def media_box(doc: Document, index: int) -> tuple[float, ...]:
    return _box(doc.inherited(doc.dict_of(_at(doc.page_refs(), index)), "MediaBox"), doc) or (0.0, 0.0, 612.0, 792.0)


def crop_box(doc: Document, index: int) -> tuple[float, ...]:
    return _box(doc.inherited(doc.dict_of(_at(doc.page_refs(), index)), "CropBox"), doc) or media_box(doc, index)


def set_box(doc: Document, index: int, x0: float, y0: float, x1: float, y1: float, key: str = "CropBox") -> Document:
    if x1 <= x0 or y1 <= y0:
        raise PdfError("ERROR", "an empty box")
    _set(doc, index, key, [float(x) for x in (x0, y0, x1, y1)])
    return doc


def decode_text(raw: bytes) -> str:
    if raw[:2] == b"\xfe\xff":
        return raw[2 : len(raw) - len(raw) % 2].decode("utf-16-be", "replace")
    return raw.decode("latin-1")


def encode_text(text: str) -> bytes:
    return text.encode() if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be")


def metadata(doc: Document) -> dict[str, str | None]:
    info = doc.dict_of(doc.trailer.get("Info")) or {}
    values = {k: doc.resolve(info.get(name)) for k, name in INFO.items()}
    return {k: decode_text(bytes(v)) if isinstance(v, bytes) else None for k, v in values.items()}


def set_metadata(doc: Document, update: dict[str, str | None]) -> Document:
    """Null or missing keeps, empty deletes, anything else sets; unknown keys are ignored."""
    info = dict(doc.dict_of(doc.trailer.get("Info")) or {})
    for k, name in INFO.items():
        if (v := update.get(k)) == "":
            info.pop(name, None)
        elif v is not None:
            info[name] = encode_text(v)
    ref = doc.trailer.get("Info")
    if isinstance(ref, Ref) and ref in doc.objects:
        doc.objects[ref] = info
    else:
        doc.trailer["Info"] = doc.add(info)
    return doc


#: What the plain font of `text_document` doesn't show as itself.
_ODD = re.compile("[^\x20-\x7e\xa0-\xff]")


def unicode_font(doc: Document, codes: dict[str, int]) -> dict:
    """A font of two-byte codes that shows these characters (at most 65,535 of them)."""
    if len(codes) > 0xFFFF:
        raise PdfError("ERROR", "too many different characters for a font")
    rows = [b"<%04x> <%s>" % (n, c.encode("utf-16-be").hex().encode()) for c, n in codes.items()]
    cmap = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(part), b"\n".join(part)) for part in (rows[k : k + 100] for k in range(0, len(rows), 100)))
    kid = {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Unicode"), "DW": 1000, "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}}
    return {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Unicode"), "Encoding": Name("Identity-H"), "DescendantFonts": [doc.add(kid)], "ToUnicode": doc.add(Stream({}, cmap))}


def text_document(pages: list[str], title: str | None = None) -> Document:
    """A document with the texts' lines, a line per `Td`. Lines with characters that are not in the plain font have a
    font of two-byte codes of their own, with a map to Unicode."""
    doc = new_document("1.4")
    fonts = {"F1": doc.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})}
    codes: dict[str, int] = {}

    def line(x: str) -> bytes:
        if not _ODD.search(x):
            return b"/F1 12 Tf 0 -14 Td (" + re.sub(rb"([()\\])", rb"\\\1", x.encode("latin-1")) + b") Tj"
        return b"/F2 12 Tf 0 -14 Td <" + b"".join(b"%04x" % codes.setdefault(c, len(codes) + 1) for c in x) + b"> Tj"

    bodies = [doc.add(Stream({}, b"BT 72 800 Td " + b"\n".join(map(line, text.split("\n"))) + b" ET")) for text in pages]
    if codes:
        fonts["F2"] = doc.add(unicode_font(doc, codes))
    refs = [doc.add({"Type": Name("Page"), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": dict(fonts)}, "Contents": b}) for b in bodies]
    rebuild(doc, refs)
    return set_metadata(doc, {"title": title}) if title else doc

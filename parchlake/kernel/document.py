"""Loading, inspecting and writing documents."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import crypt
from .filters import decode_stream
from .model import Inspect, Name, Parser, PdfError, Ref, Stream, edges, serialize

_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,18})[\x00\t\n\x0c\r ]+(\d{1,18})[\x00\t\n\x0c\r ]+([nf])(?=[\x00\t\n\x0c\r ])")
MAX_SECTIONS, MAX_DEPTH, MAX_HOPS = 64, 256, 32
#: Trailer keys that describe an old file's layout.
LAYOUT = ("Length", "Filter", "DecodeParms", "DP", "W", "Index", "Type")
BOOKKEEPING = (*LAYOUT, "Prev", "XRefStm", "Size", "Encrypt")


def _structure(what: str) -> PdfError:
    return PdfError("ERROR", what)


def _classic(data: bytes, at: int) -> tuple[dict[int, tuple], dict]:
    p = Parser(data, at)
    if p.value() != "xref":
        raise _structure("no cross-reference table")
    entries: dict[int, tuple] = {}
    while (v := p.value()) != "trailer":
        n = p.value()
        if type(v) is not int or type(n) is not int:
            raise _structure("bad cross-reference subsection")
        for k in range(v, v + n):
            if m := _ENTRY.match(data, p.at):
                p.at, offset, gen, kind = m.end(), int(m[1]), int(m[2]), m[3].decode()
            else:
                offset, gen, kind = p.value(), p.value(), p.value()
            if kind not in ("n", "f"):
                raise _structure("bad cross-reference entry")
            entries.setdefault(k, ("file", offset, gen) if kind == "n" else ("free",))
    trailer = p.value()
    if not isinstance(trailer, dict):
        raise _structure("no trailer dictionary")
    return entries, trailer


def _stream_table(data: bytes, at: int) -> tuple[dict[int, tuple], dict]:
    _, s = Parser(data, at).indirect()
    if not isinstance(s, Stream):
        raise _structure("no cross-reference stream")
    w = s.dict.get("W")
    if not isinstance(w, list) or len(w) < 3 or any(type(x) is not int or x < 0 for x in w):
        raise _structure("bad /W")
    size = s.dict.get("Size")
    index = s.dict.get("Index") or [0, size if type(size) is int else 0]
    rows, step, entries, at = decode_stream(s.dict, s.data), sum(w), {}, 0
    for first, n in zip(index[::2], index[1::2], strict=False):
        for k in range(first, first + n):
            row = rows[at : at + step]
            if len(row) < step or not step:
                break
            at += step
            f, i = [], 0
            for x in w[:3]:
                f.append(int.from_bytes(row[i : i + x], "big"))
                i += x
            kind = f[0] if w[0] else 1
            if kind in (0, 1, 2):
                entries.setdefault(k, (("free",), ("file", f[1], f[2]), ("stream", f[1], f[2]))[kind])
    return entries, {k: v for k, v in s.dict.items() if k not in LAYOUT}


def read_xref(data: bytes) -> tuple[dict[int, tuple], dict]:
    """Entries and trailer of all revisions; the newest wins, a hybrid section's stream before the section itself."""
    m = None
    for m in re.finditer(rb"startxref[\x00\t\n\x0c\r ]*(\d+)", data):  # noqa: B007
        pass
    if m is None:
        raise _structure("no startxref")
    entries: dict[int, tuple] = {}
    trailer: dict = {}
    at, seen = int(m[1]), set()
    while at is not None and at not in seen and len(seen) < MAX_SECTIONS:
        seen.add(at)
        p = Parser(data, at)
        p.skip()
        section = _classic(data, at) if data.startswith(b"xref", p.at) else _stream_table(data, at)
        parts = [section]
        if type(hybrid := section[1].get("XRefStm")) is int:
            try:
                parts.insert(0, (_stream_table(data, hybrid)[0], {}))
            except PdfError:
                pass
        for own, t in parts:
            for k, e in own.items():
                entries.setdefault(k, e)
            for k, v in t.items():
                trailer.setdefault(k, v)
        at = prev if type(prev := section[1].get("Prev")) is int else None
    return entries, trailer


@dataclass
class Document:
    version: str = "1.7"
    trailer: dict = field(default_factory=dict)
    objects: dict[Ref, object] = field(default_factory=dict)
    encrypted: bool = False

    @classmethod
    def load(cls, data: bytes, password: str = "") -> Document:
        m = re.search(rb"%PDF-([0-9.]*)", data[: 1024 + 16])
        if not m or m.start() + 5 > 1024:
            raise PdfError("NOT_A_PDF", "no header")
        entries, trailer = read_xref(data)
        doc = cls(m[1].decode(), trailer)
        for num, e in sorted(entries.items()):
            if num and e[0] == "file":
                ref, v = Parser(data, e[1]).indirect()
                if ref.num != num:
                    raise _structure(f"object {num} is not where the table says")
                doc.objects[ref] = v
        if (enc := trailer.get("Encrypt")) is not None:
            d = doc.resolve(enc)
            if not isinstance(d, dict):
                raise _structure("no encryption dictionary")
            ids = doc.resolve(trailer.get("ID"))
            first = ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""
            crypt.Decryptor({k: doc.resolve(v) for k, v in d.items()}, bytes(first), password).apply(doc.objects, enc if isinstance(enc, Ref) else None)
            doc.encrypted = True
        opened: dict[int, dict[int, object]] = {}
        for num, e in sorted(entries.items()):
            if num and e[0] == "stream":
                if e[1] not in opened:
                    opened[e[1]] = {n: v for n, v in reversed(doc._inside(e[1])) if isinstance(n, (int, float))}  # of equal numbers the first counts
                if num in opened[e[1]]:
                    doc.objects.setdefault(Ref(num), opened[e[1]][num])
        return doc

    def _inside(self, container: int) -> list[tuple[int, object]]:
        s = self.objects.get(Ref(container))
        if not isinstance(s, Stream):
            raise _structure(f"no object stream {container}")
        n, first = s.dict.get("N"), s.dict.get("First")
        if type(n) is not int or type(first) is not int:
            raise _structure("bad object stream")
        data = decode_stream(s.dict, s.data)
        head = Parser(data, 0, references=False)
        pairs = [(head.value(), head.value()) for _ in range(n)]
        return [(num, Parser(data, first + at).value()) for num, at in pairs]

    def resolve(self, v: object) -> object:
        """Follows references, up to MAX_HOPS; what is missing is null."""
        for _ in range(MAX_HOPS):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(v)
        return None if isinstance(v, Ref) else v

    def resolve_ref(self, v: object) -> Ref:
        """The last reference of a chain; a direct value becomes an object of its own."""
        for _ in range(MAX_HOPS):
            if isinstance(v, Ref) and isinstance(self.objects.get(v), Ref):
                v = self.objects[v]
        return v if isinstance(v, Ref) else self.add(v)

    def dict_of(self, v: object) -> dict | None:
        v = self.resolve(v)
        return v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else None

    def data_of(self, s: Stream) -> bytes:
        return decode_stream(s.dict, s.data)

    def catalog(self) -> dict:
        return self.dict_of(self.trailer.get("Root")) or {}

    def page_refs(self) -> list[Ref]:
        out: list[Ref] = []
        seen: set[Ref] = set()
        stack = [(self.catalog().get("Pages"), 0)]
        while stack:
            ref, depth = stack.pop()
            if not isinstance(ref, Ref) or ref in seen or depth > MAX_DEPTH:
                continue
            seen.add(ref)
            d = self.dict_of(ref)
            if d is None:
                continue
            kids = self.resolve(d.get("Kids"))
            if d.get("Type") == "Pages" or "Type" not in d and "Kids" in d:
                stack += [(k, depth + 1) for k in reversed(kids if isinstance(kids, list) else [])]
            else:
                out.append(ref)
        return out

    def page_count(self) -> int:
        pages = self.catalog().get("Pages")
        if not isinstance(pages, Ref):
            n = (self.dict_of(pages) or {}).get("Count")
            if type(n) is not int:
                raise _structure("no page tree")
            return n
        return len(self.page_refs())

    def inherited(self, page: dict, key: str) -> object:
        for _ in range(MAX_DEPTH):
            if page is None:
                return None
            if key in page:
                return self.resolve(page[key])
            page = self.dict_of(page.get("Parent"))
        return None

    def inspect(self) -> Inspect:
        try:
            n = self.page_count()
        except PdfError:
            n = None
        root = self.trailer.get("Root")
        return Inspect(self.version, self.encrypted, len(self.objects), n, sorted(self.trailer), root if isinstance(root, Ref) else None)

    def add(self, v: object) -> Ref:
        ref = Ref(max((r.num for r in self.objects), default=0) + 1)
        self.objects[ref] = v
        return ref

    def collect_garbage(self) -> None:
        seen: set[Ref] = set()
        todo = [r for k in ("Root", "Info") for r in edges(self.trailer.get(k))]
        while todo:
            r = todo.pop()
            if r in self.objects and r not in seen:
                seen.add(r)
                todo += edges(self.objects[r])
        self.objects = {r: v for r, v in self.objects.items() if r in seen}

    def to_bytes(self, trailer: dict | None = None) -> bytes:
        if "Root" not in self.trailer:
            raise _structure("no /Root")
        out = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % self.version.encode())
        offsets: dict[int, tuple[int, int]] = {}
        for ref in sorted(self.objects):
            if ref.num in offsets:
                raise _structure(f"two generations of object {ref.num}")
            offsets[ref.num] = len(out), ref.gen
            out += b"%d %d obj\n%s\nendobj\n" % (ref.num, ref.gen, serialize(self.objects[ref]))
        size, start = max(offsets, default=0) + 1, len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        for k in range(1, size):
            out += b"%010d %05d n \n" % offsets[k] if k in offsets else b"0000000000 00000 f \n"
        last = {k: v for k, v in self.trailer.items() if k not in BOOKKEEPING} | (trailer or {}) | {"Size": size}
        return bytes(out + b"trailer\n" + serialize(last) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def new_document(version: str = "1.7") -> Document:
    doc = Document(version)
    pages = doc.add({"Type": Name("Pages"), "Kids": [], "Count": 0})
    doc.trailer["Root"] = doc.add({"Type": Name("Catalog"), "Pages": pages})
    return doc

"""Files in forms that this engine reads but doesn't write, for queries and tests."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from ..kernel import crypt, edit, filters
from ..kernel.document import Document
from ..kernel.model import HexBytes, Name, Ref, Stream, serialize


def png_encoded(data: bytes, columns: int, unit: int = 1, tags: tuple[int, ...] = (0, 1, 2, 3, 4)) -> bytes:
    """PNG prediction of rows of `columns` bytes, with the tags in turn; the last row may be short."""
    if not data:
        return b""
    n = -(-len(data) // columns)
    held = np.zeros((n + 1, columns + unit), np.int16)  # a row above and pixels to the left are 0
    held[1:, unit:].flat[: len(data)] = np.frombuffer(data, np.uint8)
    x, a, b, c = held[1:, unit:], held[1:, :-unit], held[:-1, unit:], held[:-1, :-unit]
    tag = np.resize(np.array(tags, np.int16), n)
    out = np.empty((n, columns + 1), np.uint8)
    out[:, 0] = tag
    for t in set(tags):
        at = tag == t
        xs, left, up, corner = x[at], a[at], b[at], c[at]
        if t == 4:
            p, q, r = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            near = np.where((p <= q) & (p <= r), left, np.where(q <= r, up, corner))
        out[at, 1:] = xs - (0, left, up, (left + up) // 2, near if t == 4 else 0)[t] & 255
    return out.tobytes()[: len(data) + n]


def tiff_encoded(data: bytes, columns: int, colors: int = 1) -> bytes:
    if not data:
        return b""
    n = -(-len(data) // columns)
    held = np.zeros((n, columns), np.uint8)
    held.flat[: len(data)] = np.frombuffer(data, np.uint8)
    out = held.copy()
    out[:, colors:] -= held[:, :-colors]
    return out.tobytes()[: len(data)]


def compact(doc: Document) -> bytes:
    """The document with all but streams in an object stream, and a cross-reference stream behind a predictor."""
    top = max(r.num for r in doc.objects)
    inside = {r: serialize(v) for r, v in sorted(doc.objects.items()) if not isinstance(v, Stream)}
    head, body = b"", b""
    for r, v in inside.items():
        head += b"%d %d " % (r.num, len(body))
        body += v + b" "
    objects = {r: v for r, v in doc.objects.items() if isinstance(v, Stream)}
    objects[Ref(top + 1)] = Stream({"Type": Name("ObjStm"), "N": len(inside), "First": len(head), "Filter": Name("FlateDecode")}, filters.deflate(head + body))
    out, entries = bytearray(b"%PDF-1.5\n"), {r.num: (2, top + 1, k) for k, r in enumerate(inside)}
    for r, v in sorted(objects.items()):
        entries[r.num] = 1, len(out), r.gen
        out += b"%d %d obj\n%s\nendobj\n" % (r.num, r.gen, serialize(v))
    entries[top + 2] = 1, len(out), 0
    rows = b"".join(bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for kind, a, b in (entries.get(n, (0, 0, 0)) for n in range(top + 3)))
    d = {"Type": Name("XRef"), "Size": top + 3, "W": [1, 4, 2], "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 7}}
    d |= {k: v for k, v in doc.trailer.items() if k in ("Root", "Info")}
    start = len(out)
    out += b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (top + 2, serialize(Stream(d, filters.deflate(png_encoded(rows, 7, tags=(2,))))), start)
    return bytes(out)


def legacy_encrypted(doc: Document, user: str, owner: str, version: int) -> bytes:
    """The document under the older handlers: RC4 of 40 bits (version 1) or 128 (2), or AES-128 (4)."""
    r, n = {1: (2, 5), 2: (3, 16), 4: (4, 16)}[version]
    pad = lambda s: (s.encode("latin-1") + crypt.PAD)[:32]
    turns = range(1, 20) if r >= 3 else ()
    first = hashlib.md5(user.encode()).digest()
    h = hashlib.md5(pad(owner)).digest()
    for _ in range(50 if r >= 3 else 0):
        h = hashlib.md5(h).digest()
    o = crypt.rc4(h[:n], pad(user))
    for k in turns:
        o = crypt.rc4(bytes(c ^ k for c in h[:n]), o)
    key = hashlib.md5(pad(user) + o + b"\xfc\xff\xff\xff" + first).digest()
    for _ in range(50 if r >= 3 else 0):
        key = hashlib.md5(key[:n]).digest()
    key = key[:n]
    u = crypt.rc4(key, hashlib.md5(crypt.PAD + first).digest() if turns else crypt.PAD)
    for k in turns:
        u = crypt.rc4(bytes(c ^ k for c in key), u)
    d = {"Filter": Name("Standard"), "V": version, "R": r, "Length": 8 * n, "P": -4, "O": HexBytes(o), "U": HexBytes(u.ljust(32, b"\0"))}
    if version == 4:
        d |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def sealed(ref: Ref, v: object) -> object:
        own = hashlib.md5(key + ref.num.to_bytes(4, "little")[:3] + ref.gen.to_bytes(2, "little") + (b"sAlT" if version == 4 else b"")).digest()[: min(n + 5, 16)]
        hide = (lambda x: crypt.aes_encrypt(own, x)) if version == 4 else (lambda x: crypt.rc4(own, x))
        if isinstance(v, bytes):
            return HexBytes(hide(bytes(v)))
        if isinstance(v, list):
            return [sealed(ref, x) for x in v]
        if isinstance(v, dict):
            return {k: sealed(ref, x) for k, x in v.items()}
        return Stream(sealed(ref, v.dict), hide(v.data)) if isinstance(v, Stream) else v

    out = Document("1.6", dict(doc.trailer), {ref: sealed(ref, v) for ref, v in doc.objects.items()})
    return out.to_bytes({"Encrypt": out.add(d), "ID": [HexBytes(first), HexBytes(first)]})


def many_fonts(a: str, b: str, c: str, d: str, e: str) -> Document:
    """A page with a line of each text: by a standard font; with Differences, by pieces; under a changed graphics state,
    by the quote operators; from a form in a form with a two-byte font; and behind a ToUnicode that can't be decoded.
    """
    doc = edit.text_document([""])
    page = doc.dict_of(doc.page_refs()[0])
    text = lambda s: b"(" + re.sub(rb"([()\\])", rb"\\\1", s.encode("latin-1", "replace")) + b")"
    names = {"A": "uni0041", "B": "B", "!": "exclam"}
    differences = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("X"), "Encoding": {"BaseEncoding": Name("WinAnsiEncoding"), "Differences": [1, *(Name(x) for x in names.values())]}}
    broken = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Y"), "ToUnicode": doc.add(Stream({"Filter": Name("LZWDecode")}, b"\x80"))}
    codes = {x: k for k, x in enumerate(dict.fromkeys(d), 1)}
    fonts = {"P": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}, "D": doc.add(differences), "U": doc.add(edit.unicode_font(doc, codes)), "B": doc.add(broken)}
    inner = doc.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Resources": {"Font": {"U": fonts["U"]}}}, b"BT /U 12 Tf 72 400 Td <" + b"".join(b"%04x" % codes[x] for x in d) + b"> Tj ET"))
    outer = doc.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 0, 50], "Resources": {"XObject": {"I": inner}}}, b"q /I Do Q"))
    coded = b"".join(b"%02x" % ([*names].index(x) + 1 if x in names else ord(x) if ord(x) < 256 else 63) for x in b)
    body = [
        b"BT /P 12 Tf 72 800 Td " + text(a) + b" Tj ET",
        b"BT /D 12 Tf 14 TL 72 760 TD [<" + coded[: len(coded) // 4 * 2] + b"> -30 <" + coded[len(coded) // 4 * 2 :] + b">] TJ ET",
        b"q 1 0 0 1 0 -20 cm BT /P 12 Tf 14 TL 90 Tz 1 Tc 1 0 0 1 72 740 Tm 2 1 " + text(c) + b' " T* ET Q',
        b"BI /W 1 /H 1 ID xx EI q /F Do Q",
        b"BT /B 12 Tf 1 0 0 1 72 300 Tm " + text(e) + b" Tj ET",
    ]
    halves = doc.add(Stream({}, b" ".join(body[:2]))), doc.add(Stream({"Filter": Name("FlateDecode")}, filters.deflate(b" ".join(body[2:]))))
    page["Contents"], page["Resources"] = list(halves), {"Font": fonts, "XObject": {"F": outer}}
    return doc

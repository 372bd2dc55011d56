"""Content streams, fonts and text extraction."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from operator import add

from .document import Document
from .model import HexBytes, Keyword, Name, Parser, PdfError, Ref, Stream, unescaped

MAX_FORMS = 8
#: Characters of 0x80 to 0x9F in WinAnsi, by code (others are Latin-1).
WIN = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}
#: Glyph names that are no single letter or digit.
GLYPHS = {"space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "ﬁ", "fl": "ﬂ", "dagger": "†", "daggerdbl": "‡", "Euro": "€", "trademark": "™", "copyright": "©", "registered": "®", "degree": "°", "eacute": "é", "egrave": "è", "agrave": "à", "ccedilla": "ç", "ntilde": "ñ", "udieresis": "ü", "odieresis": "ö", "adieresis": "ä"}
#: The characters of the standard encoding above ASCII, by code.
STANDARD = {0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xAE: "ﬁ", 0xAF: "ﬂ", 0xB1: "–", 0xB4: "·", 0xB7: "•", 0xBC: "…", 0xD0: "—", 0xD1: "‘", 0xD2: "’"}


@lru_cache(maxsize=4)
def _base(name: str | None) -> dict[int, str]:
    out = {c: chr(c) for c in range(32, 127)}
    if name == "WinAnsiEncoding":
        return out | {c: chr(c) for c in range(0xA0, 256)} | WIN
    if name == "MacRomanEncoding":
        return out | {c: bytes([c]).decode("mac_roman") for c in range(128, 256)}
    return out | STANDARD


def base_encoding(name: str | None) -> dict[int, str]:
    return dict(_base(name if name in ("WinAnsiEncoding", "MacRomanEncoding") else None))


def glyph(name: str) -> str:
    if name in GLYPHS:
        return GLYPHS[name]
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4}).*|u([0-9A-Fa-f]{4,6})", name, re.S):  # of a longer uni name the first four
        n = int(m[1] or m[2], 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else ""
    return name if len(name) == 1 and name.isalnum() else ""


def read_cmap(data: bytes) -> dict[int, str]:
    """Code to text: bfchar and bfrange, with arrays as destinations too."""
    p, out, held = Parser(data, references=False), {}, []
    text = lambda b, add=0: (b[:-2] + ((int.from_bytes(b[-2:], "big") + add) & 0xFFFF).to_bytes(2, "big")).decode("utf-16-be", "replace") if len(b) >= 2 else chr(b[0] + add) if b else ""
    try:
        while not p.done():
            v = p.value()
            if not isinstance(v, Keyword):
                held.append(v)
                continue
            if v == "endbfchar":
                for a, b in zip(held[::2], held[1::2], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        out[int.from_bytes(a, "big")] = text(b)
            elif v == "endbfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        lo = int.from_bytes(a, "big")
                        for k in range(min(int.from_bytes(b, "big") - lo, 65535) + 1):
                            if isinstance(c, bytes):
                                out[lo + k] = text(c, k)
                            elif isinstance(c, list) and k < len(c) and isinstance(c[k], bytes):
                                out[lo + k] = text(c[k])
            held = []
    except PdfError:
        pass
    return out


class _Known(dict):
    """Values by code, each worked out once."""

    def __init__(self, of: Callable[[int], object]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, code: int) -> object:
        v = self[code] = self.of(code)
        return v


def _shown(two_bytes: bool, to_unicode: dict[int, str], encoding: dict[int, str]) -> Callable[[int], str]:
    def shown(code: int) -> str:
        if (t := to_unicode.get(code, encoding.get(code))) is not None:
            return t
        return chr(code) if not two_bytes and 0x20 <= code <= 0xFF else ""

    return shown


@dataclass
class Font:
    two_bytes: bool = False
    to_unicode: dict[int, str] = field(default_factory=dict)
    encoding: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    default_width: float = 0.0

    def __post_init__(self) -> None:
        self.texts = self.moves = self.state = None

    def drawn(self, data: bytes, size: float, tc: float, tw: float, tz: float) -> tuple[str, float]:
        """What the codes show and how far they move, the moves added one after the other."""
        if self.state != (size, tc, tw, tz):  # what is known refers to parts of the font only, so that no cycle holds it
            self.state, self.texts = (size, tc, tw, tz), self.texts or _Known(_shown(self.two_bytes, self.to_unicode, self.encoding))
            widths, default, blank = self.widths, self.default_width, None if self.two_bytes else 32
            self.moves = _Known(lambda code: (widths.get(code, default) / 1000 * size + tc + (tw if code == blank else 0.0)) * tz)
        if not self.two_bytes:
            return data.decode("latin-1").translate(self.texts), reduce(add, map(self.moves.__getitem__, data), 0.0)
        codes = struct.unpack(f">{len(data) // 2}H", data[: len(data) // 2 * 2])
        text, moved = "".join(map(self.texts.__getitem__, codes)), reduce(add, map(self.moves.__getitem__, codes), 0.0)
        if len(data) % 2:
            code = data[-1]
            text += self.texts[code]
            moved += (self.widths.get(code, self.default_width) / 1000 * size + tc + (tw if code == 32 else 0.0)) * tz
        return text, moved


def cid_widths(w: list) -> dict[int, float]:
    """Widths by code, from groups `first [widths]` and `first last width`; what is neither is passed over."""
    out: dict[int, float] = {}
    held: list = []
    for x in w:
        if isinstance(x, list) and len(held) == 1:
            out |= {max(held[0] + k, 0): float(v) for k, v in enumerate(x) if type(v) in (int, float)}
            held = []
        elif len(held) == 2:
            if type(x) in (int, float):
                out |= dict.fromkeys(range(max(held[0], 0), min(held[1], held[0] + 65535) + 1), float(x))
            held = []
        elif type(x) is int:
            held.append(x)
        else:  # drops a first number before it
            held = []
    return out


def load_font(doc: Document, d: dict) -> Font:
    f = Font()
    if isinstance(s := doc.resolve(d.get("ToUnicode")), Stream):
        try:
            f.to_unicode = read_cmap(doc.data_of(s))
        except PdfError:  # what can't be decoded is as if it weren't there
            pass
    enc = doc.resolve(d.get("Encoding"))
    if d.get("Subtype") == "Type0":
        f.two_bytes = not isinstance(enc, Name) or enc in ("Identity-H", "Identity-V")
        kids = doc.resolve(d.get("DescendantFonts"))
        cid = (doc.dict_of(kids[0]) if isinstance(kids, list) and kids else None) or {}
        f.default_width = float(dw) if type(dw := doc.resolve(cid.get("DW"))) is int else 1000.0
        if isinstance(w := doc.resolve(cid.get("W")), list):
            f.widths = cid_widths([doc.resolve(x) for x in w])
        return f
    f.default_width = 500.0
    f.encoding = base_encoding(enc if isinstance(enc, Name) else (enc or {}).get("BaseEncoding") if isinstance(enc, dict) else None)
    if isinstance(enc, dict) and isinstance(diffs := doc.resolve(enc.get("Differences")), list):
        at = 0
        for x in diffs:
            if type(x) is int:
                at = x
            elif isinstance(x, Name):
                if g := glyph(x):
                    f.encoding[at] = g
                at += 1
    first, w = doc.resolve(d.get("FirstChar")), doc.resolve(d.get("Widths"))
    if type(first) is int and isinstance(w, list):
        f.widths = {first + k: float(v) for k, x in enumerate(w) if type(v := doc.resolve(x)) in (int, float)}
    return f


#: Numbers, names, strings and words in their plainest forms; all else is the parser's.
_TOKEN = re.compile(rb"""[\x00\t\n\x0c\r ]*(?:([+-]?\d{1,18})(?=[\x00\t\n\x0c\r ])|/([A-Za-z0-9]+)(?=[\x00\t\n\x0c\r ])|\(((?:[^()\\]++|\\[()\\])*+)\)|<([0-9A-Fa-f]*)>|([A-Za-z]+\*?|['"])(?=[\x00\t\n\x0c\r ]|\Z))""")
_WORDS = {"true": True, "false": False, "null": None}


def operations(data: bytes) -> list[tuple[str, list]]:
    """(operator, operands) of a content stream; inline images are passed over."""
    p, out, held = Parser(data, references=False), [], []
    while True:
        if m := _TOKEN.match(data, p.at):
            p.at = m.end()
            kind = m.lastindex
            if kind == 5:
                v = m[5].decode()
                if v in _WORDS:
                    held.append(_WORDS[v])
                    continue
            else:
                held.append(int(m[1]) if kind == 1 else Name(m[2].decode()) if kind == 2 else unescaped(m[3]) if kind == 3 else HexBytes.fromhex((m[4] + b"0" * (len(m[4]) % 2)).decode()))
                continue
        elif p.done():
            break
        elif not isinstance(v := p.value(), Keyword):
            held.append(v)
            continue
        if v == "BI":
            m = re.compile(rb"[\x00\t\n\x0c\r ]ID[\x00\t\n\x0c\r ].*?[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)", re.S).search(data, p.at - 1)
            if not m:
                raise p.fail("an inline image without end")
            p.at = m.end()
        else:
            out.append((str(v), held))
        held = []
    return out


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: tuple, n: tuple) -> tuple:
    """First m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l


def _numbers(v: list, n: int) -> list[float]:
    out = [float(x) if type(x) in (int, float) else 0.0 for x in v[:n]]
    return out + [0.0] * (n - len(out))


class _Page:
    def __init__(self, doc: Document) -> None:
        self.doc, self.fonts, self.out = doc, {}, []
        self.tail = ""
        self.last: tuple[float, float] | None = None
        self.last_size = 12.0

    def emit(self, text: str) -> None:
        if text:
            self.out.append(text)
            self.tail = text[-1]

    def font(self, resources: dict, key: str) -> Font:
        at = (id(resources), key)
        if at not in self.fonts:
            d = self.doc.dict_of((self.doc.dict_of(resources.get("Font")) or {}).get(key))
            self.fonts[at] = (load_font(self.doc, d) if d is not None else Font(), resources)
        return self.fonts[at][0]

    def run(self, data: bytes, resources: dict, ctm: tuple, depth: int) -> None:
        try:
            ops = operations(data)
        except PdfError:
            return
        state = {"Tc": 0.0, "Tw": 0.0, "Tz": 1.0, "TL": 0.0, "size": 0.0, "font": None}
        stack: list[tuple] = []
        tm = line = IDENTITY
        inside = False

        def move(x: float, y: float) -> None:
            nonlocal tm, line
            tm = line = times((1.0, 0.0, 0.0, 1.0, x, y), line)

        def show(raw: object) -> None:
            nonlocal tm
            if not isinstance(raw, bytes) or not inside:
                return
            font = self.font(resources, state["font"]) if state["font"] is not None else Font()
            x, y = times(tm, ctm)[4:]
            shown, moved = font.drawn(raw, state["size"], state["Tc"], state["Tw"], state["Tz"])
            tm = times((1.0, 0.0, 0.0, 1.0, moved, 0.0), tm)
            end = times(tm, ctm)[4]
            size = max(state["size"], 1.0)
            if self.last is not None:
                dy = abs(self.last[1] - y)
                if dy > 0.5 * min(size, self.last_size):
                    self.emit("\n\n" if dy > 1.8 * self.last_size else "\n")
                elif x - self.last[0] > 0.25 * size and self.tail not in ("", " ", "\n"):
                    self.emit(" ")
            self.emit(shown)
            self.last, self.last_size = (end, y), size

        for op, v in ops:
            if op == "q":
                stack.append((ctm, dict(state)))
            elif op == "Q":
                if stack:
                    ctm, state = stack.pop()
            elif op == "cm":
                if len(v) >= 6:
                    ctm = times(tuple(_numbers(v, 6)), ctm)
            elif op == "BT":
                inside, tm, line = True, IDENTITY, IDENTITY
            elif op == "ET":
                inside = False
            elif op in ("Tc", "Tw", "TL"):
                state[op] = _numbers(v, 1)[0]
            elif op == "Tz":
                state["Tz"] = _numbers(v, 1)[0] / 100
            elif op == "Tf":
                state["font"] = str(v[0]) if v and isinstance(v[0], Name) else None
                state["size"] = _numbers(v[1:], 1)[0]
            elif op in ("Td", "TD"):
                x, y = _numbers(v, 2)
                if op == "TD":
                    state["TL"] = -y
                move(x, y)
            elif op == "Tm":
                if len(v) >= 6:
                    tm = line = tuple(_numbers(v, 6))
            elif op == "T*":
                move(0.0, -state["TL"])
            elif op == "Tj":
                show(v[0] if v else None)
            elif op == "'":
                move(0.0, -state["TL"])
                show(v[0] if v else None)
            elif op == '"':
                state["Tw"], state["Tc"] = _numbers(v, 2)
                move(0.0, -state["TL"])
                show(v[2] if len(v) > 2 else None)
            elif op == "TJ":
                for x in v[0] if v and isinstance(v[0], list) else []:
                    if isinstance(x, bytes):
                        show(x)
                    elif type(x) in (int, float):
                        tm = times((1.0, 0.0, 0.0, 1.0, -x / 1000 * state["size"] * state["Tz"], 0.0), tm)
            elif op == "Do" and v and isinstance(v[0], Name) and depth < MAX_FORMS:
                form = self.doc.resolve((self.doc.dict_of(resources.get("XObject")) or {}).get(str(v[0])))
                if isinstance(form, Stream) and form.dict.get("Subtype") == "Form":
                    own = self.doc.dict_of(form.dict.get("Resources")) or resources
                    m = form.dict.get("Matrix")
                    m = tuple(_numbers(m, 6)) if isinstance(m, list) and len(m) >= 6 else IDENTITY
                    self.run(self.doc.data_of(form), own, times(m, ctm), depth + 1)


def page_content(doc: Document, page: dict) -> bytes:
    c = doc.resolve(page.get("Contents"))
    if isinstance(c, Stream):
        return doc.data_of(c)
    parts = [s for x in c if isinstance(s := doc.resolve(x), Stream)] if isinstance(c, list) else []
    return b"".join(doc.data_of(s) + b"\n" for s in parts)


def page_text(doc: Document, ref: Ref) -> str:
    page = doc.dict_of(ref) or {}
    resources = doc.inherited(page, "Resources")
    p = _Page(doc)
    p.run(page_content(doc, page), resources if isinstance(resources, dict) else {}, IDENTITY, 0)
    return "".join(p.out).rstrip("\n ")


def document_text(doc: Document, page: int = 0) -> str:
    """A page's text (1-based), or with 0 or less that of all pages, joined by form feeds."""
    refs = doc.page_refs()
    if page > len(refs):
        raise PdfError("PAGE_OUT_OF_RANGE", f"page {page} of {len(refs)}")
    return page_text(doc, refs[page - 1]) if page > 0 else "\f".join(page_text(doc, r) for r in refs)

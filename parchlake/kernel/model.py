"""Object values, tokens, parsing and serialization of PDF objects."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import NamedTuple


class PdfError(Exception):
    """An error with the code that users see."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code, self.message = code, message


class Name(str):
    __slots__ = ()


class HexBytes(bytes):
    """A string that was written in hexadecimal form."""


class Ref(NamedTuple):
    num: int
    gen: int = 0


@dataclass
class Stream:
    dict: dict
    data: bytes = b""  # as stored, still encoded


class Keyword(str):
    __slots__ = ()


WHITE = b"\x00\t\n\x0c\r "
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_NUMBER = re.compile(rb"[+-]?\d*(?:\.\d*)?")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_ESCAPES = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
_HEX = frozenset(b"0123456789abcdefABCDEF")
_SIMPLE = re.compile(rb"\(((?:[^()\\]++|\\[()\\])*+)\)")
_ESCAPED = re.compile(rb"\\(.)", re.S)
_PLAIN = re.compile(rb"[^()\\]*")
_HEAD = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,18})[\x00\t\n\x0c\r ]+(\d{1,18})[\x00\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_END = re.compile(rb"[\x00\t\n\x0c\r ]{0,4}endstream")
_IN_NAME = re.compile(rb"[^!-~]|[()<>\[\]{}/%#]")
_IN_STRING = re.compile(rb"[^ -'*-\[\]-~]")


def unescaped(raw: bytes) -> bytes:
    """What is in a string that escapes parentheses and backslashes only."""
    return _ESCAPED.sub(rb"\1", raw) if b"\\" in raw else raw


class Parser:
    """A cursor over bytes. Every call moves on or raises, so no input keeps it for ever."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True) -> None:
        self.data, self.at, self.references = data, at, references

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def done(self) -> bool:
        self.skip()
        return self.at >= len(self.data)

    def fail(self, what: str) -> PdfError:
        return PdfError("ERROR", f"{what} at byte {self.at}")

    def value(self, depth: int = 0) -> object:
        if depth > 200:
            raise self.fail("too deep nesting")
        self.skip()
        d, i = self.data, self.at
        if i >= len(d):
            raise self.fail("unexpected end")
        c = d[i]
        if c == 0x2F:
            return self._name()
        if c == 0x28:
            return self._literal()
        if c == 0x3C:
            return self._dict(depth) if d[i + 1 : i + 2] == b"<" else self._hex()
        if c == 0x5B:
            self.at += 1
            out = []
            while True:
                self.skip()
                if d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self._plain(self.value(depth + 1)))
        if c in b"+-.0123456789":
            if self.references and (m := _REF.match(d, i)):
                self.at = m.end()
                return Ref(int(m[1]) & 0xFFFFFFFF, int(m[2]) & 0xFFFF)
            return self._number()
        word = _REGULAR.match(d, i).group()
        if not word:
            raise self.fail("stray delimiter")
        self.at += len(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Keyword(word.decode("latin-1")))

    def _plain(self, v: object) -> object:
        if isinstance(v, Keyword):
            raise self.fail(f"unexpected keyword {v}")
        return v

    def _number(self) -> int | float:
        text = _NUMBER.match(self.data, self.at).group()
        if not text.strip(b"+-") or not text.strip(b"+-."):
            if b"." in text:
                self.at += len(text)
                return 0.0
            raise self.fail("bad number")
        self.at += len(text)
        if b"." in text:
            return float(text)
        v = int(text)
        if not -(1 << 63) <= v < 1 << 63:
            raise self.fail("integer out of range")
        return v

    def _name(self) -> Name:
        raw = _REGULAR.match(self.data, self.at + 1).group()
        self.at += 1 + len(raw)
        if b"#" in raw:
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)
        return Name(raw.decode("utf-8", "replace"))

    def _literal(self) -> bytes:
        if m := _SIMPLE.match(self.data, self.at):
            self.at = m.end()
            return unescaped(m[1])
        d, i, depth, out = self.data, self.at + 1, 1, bytearray()
        while True:
            m = _PLAIN.match(d, i)
            out += m.group()
            i = m.end()
            if i >= len(d):
                raise self.fail("unterminated string")
            c = d[i]
            i += 1
            if c == 0x5C:
                if i >= len(d):
                    raise self.fail("unterminated string")
                c = d[i]
                i += 1
                if c in b"01234567":
                    n, k = c - 48, 1
                    while k < 3 and i < len(d) and d[i] in b"01234567":
                        n, i, k = n * 8 + d[i] - 48, i + 1, k + 1
                    out.append(n & 255)
                elif c == 13:
                    i += d[i : i + 1] == b"\n"
                elif c != 10:
                    out.append(_ESCAPES.get(c, c))
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                self.at = i
                return bytes(out)
            out.append(c)

    def _hex(self) -> HexBytes:
        end = self.data.find(b">", self.at)
        if end < 0:
            raise self.fail("unterminated hexadecimal string")
        digits = self.data[self.at + 1 : end].translate(None, WHITE)
        if not _HEX.issuperset(digits):
            raise self.fail("bad hexadecimal digit")
        self.at = end + 1
        return HexBytes(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))

    def _dict(self, depth: int) -> dict:
        self.at += 2
        out: dict[str, object] = {}
        while True:
            self.skip()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.value(depth + 1)
            if not isinstance(key, Name):
                raise self.fail("a dictionary key is no name")
            out[str(key)] = self._plain(self.value(depth + 1))

    def indirect(self) -> tuple[Ref, object]:
        """`n g obj ... endobj`, with a stream if one follows the dictionary."""
        if m := _HEAD.match(self.data, self.at):
            self.at = m.end()
            num, gen, word = int(m[1]), int(m[2]), "obj"
        else:
            num, gen, word = self.value(), self.value(), self.value()
        if not isinstance(num, int) or not isinstance(gen, int) or word != "obj":
            raise self.fail("an object should start")
        v = self._plain(self.value())
        word = self.value()
        if word == "stream":
            if not isinstance(v, dict):
                raise self.fail("a stream without a dictionary")
            v = Stream(v, self._payload(v.get("Length")))
            word = self.value()
        if word != "endobj":
            raise self.fail("endobj is missing")
        return Ref(num, gen), v

    def _payload(self, length: object) -> bytes:
        d, i = self.data, self.at
        i += 2 if d[i : i + 2] == b"\r\n" else d[i : i + 1] in (b"\n", b"\r")
        if type(length) is int and length >= 0 and (m := _END.match(d, i + length)):
            self.at = m.end()
            return d[i : i + length]
        end = d.find(b"endstream", i)
        if end < 0:
            raise self.fail("endstream is missing")
        self.at = end + 9
        body = d[i:end]
        return body[:-2] if body.endswith(b"\r\n") else body[:-1] if body[-1:] in (b"\n", b"\r") else body


def _real(v: float) -> bytes:
    if not math.isfinite(v):
        raise PdfError("ERROR", "a real number is not finite")
    text = format(v, ".17g") if "e" in repr(v) else repr(v)
    if "e" in text:
        text = format(v, "f")
    return (text if "." in text else f"{text}.0").encode()


def _name(v: str) -> bytes:
    if v.isascii() and v.isalnum():
        return b"/" + v.encode()
    return b"/" + _IN_NAME.sub(lambda m: b"#%02X" % ord(m[0]), v.encode())


def serialize(v: object) -> bytes:
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Name):
        return _name(v)
    if isinstance(v, int):
        return str(v).encode()
    if isinstance(v, float):
        return _real(v)
    if isinstance(v, HexBytes):
        return b"<" + v.hex().upper().encode() + b">"
    if isinstance(v, bytes):
        return b"(" + _IN_STRING.sub(lambda m: b"\\" + m[0] if m[0] in b"()\\" else b"\\%03o" % ord(m[0]), v) + b")"
    if isinstance(v, Ref):
        return b"%d %d R" % (v.num, v.gen)
    if isinstance(v, list):
        return b"[" + b" ".join(map(serialize, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(_name(k) + b" " + serialize(v[k]) for k in sorted(v)) + b">>"
    if isinstance(v, Stream):
        own = {k: x for k, x in v.dict.items() if k != "Length"}
        head = serialize(own)[:-2] + (b" " if own else b"") + b"/Length %d>>" % len(v.data)
        return head + b"\nstream\n" + v.data + b"\nendstream"
    raise PdfError("ERROR", f"no form for {type(v).__name__}")


def edges(v: object) -> list[Ref]:
    """References inside a value, dictionary keys in sorted order."""
    if isinstance(v, Ref):
        return [v]
    if isinstance(v, list):
        return [r for x in v for r in edges(x)]
    if isinstance(v, Stream):
        v = v.dict
    return [r for k in sorted(v) for r in edges(v[k])] if isinstance(v, dict) else []


def rewritten(v: object, of: dict[Ref, Ref]) -> object:
    """The value with references renamed; those without a new name become null."""
    if isinstance(v, Ref):
        return of.get(v)
    if isinstance(v, list):
        return [rewritten(x, of) for x in v]
    if isinstance(v, dict):
        return {k: rewritten(x, of) for k, x in v.items()}
    return Stream(rewritten(v.dict, of), v.data) if isinstance(v, Stream) else v


@dataclass
class Inspect:
    version: str
    encrypted: bool
    object_count: int
    page_count: int | None
    trailer_keys: list[str] = field(default_factory=list)
    root: Ref | None = None

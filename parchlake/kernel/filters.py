"""Decoders of stream data."""

from __future__ import annotations

import zlib

import numpy as np

from .model import WHITE, Name, PdfError

NAMES = {"FlateDecode": "flate", "Fl": "flate", "ASCIIHexDecode": "hex", "AHx": "hex", "ASCII85Decode": "a85", "A85": "a85"}


def decode_stream(d: dict, data: bytes) -> bytes:
    """Applies the filters in order. An indirect /Filter counts as none."""
    names = d.get("Filter")
    names = [names] if isinstance(names, Name) else [x for x in names if isinstance(x, Name)] if isinstance(names, list) else []
    parms = d.get("DecodeParms", d.get("DP"))
    parms = parms if isinstance(parms, list) else [parms]
    for k, name in enumerate(names):
        kind = NAMES.get(name)
        p = parms[k] if k < len(parms) and isinstance(parms[k], dict) else {}
        if kind == "flate":
            data = unpredicted(inflate(data), p)
        elif kind == "hex":
            data = ascii_hex(data)
        elif kind == "a85":
            data = ascii85(data)
        else:
            raise PdfError("ERROR", f"unsupported filter {name}")
    return data


def inflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error as e:
        raise PdfError("ERROR", f"flate: {e}") from None


def deflate(data: bytes) -> bytes:
    return zlib.compress(data)


def ascii_hex(data: bytes) -> bytes:
    digits = data.partition(b">")[0].translate(None, WHITE)
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    except ValueError:
        raise PdfError("ERROR", "bad byte in hexadecimal data") from None


def ascii85(data: bytes) -> bytes:
    body = data.translate(None, WHITE).removeprefix(b"<~").partition(b"~")[0]
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _word(group)
                group = []
        else:
            raise PdfError("ERROR", "bad byte in base-85 data")
    if len(group) == 1:
        raise PdfError("ERROR", "a base-85 group of one character")
    if group:
        out += _word(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _word(group: list[int]) -> bytes:
    n = 0
    for x in group:
        n = n * 85 + x
    return (n & 0xFFFFFFFF).to_bytes(4, "big")


def _int(p: dict, key: str, default: int) -> int:
    return v if type(v := p.get(key)) is int else default


def unpredicted(data: bytes, p: dict) -> bytes:
    kind = min(max(_int(p, "Predictor", 1), 1), 15)
    if kind == 1:
        return data
    colors, bits, columns = max(1, _int(p, "Colors", 1)), max(1, _int(p, "BitsPerComponent", 8)), max(1, _int(p, "Columns", 1))
    row, unit = (columns * colors * bits + 7) // 8, max(1, colors * bits // 8)
    if kind == 2:
        if bits != 8:
            raise PdfError("ERROR", "the TIFF predictor needs 8 bits")
        whole = len(data) // row * row
        sums = np.cumsum(np.frombuffer(data, np.uint8, whole).reshape(-1, columns, colors), 1, np.uint8).tobytes() if whole else b""
        return sums + _left_sums(data[whole:], colors)
    if kind < 10:
        raise PdfError("ERROR", f"unknown predictor {kind}")
    out, before = [], bytes(min(row, len(data)))
    for i in range(0, len(data), row + 1):
        before = _png_row(data[i], data[i + 1 : i + 1 + row], before, unit)
        out.append(before)
    return b"".join(out)


def _left_sums(data: bytes, unit: int) -> bytes:
    """Each byte and those before it by multiples of the unit, summed."""
    n = len(data)
    if n <= unit:
        return data
    padded = np.zeros(-(-n // unit) * unit, np.uint8)
    padded[:n] = np.frombuffer(data, np.uint8)
    return np.cumsum(padded.reshape(-1, unit), 0, np.uint8).tobytes()[:n]


def _png_row(tag: int, x: bytes, up: bytes, unit: int) -> bytes:
    """A row undone; only the last row of a stream can be shorter than the one above it."""
    n = len(x)
    if tag == 0 or not n and tag in (1, 2, 3, 4):
        return x
    if tag == 1:
        return _left_sums(x, unit)
    if tag == 2:
        return (np.frombuffer(x, np.uint8) + np.frombuffer(up, np.uint8, n)).tobytes()
    if tag not in (3, 4):
        raise PdfError("ERROR", f"unknown PNG row tag {tag}")
    out = bytearray(n)
    for k in range(min(unit, n)):
        own, a, c = [], 0, 0
        if tag == 3:
            for v, b in zip(x[k::unit], up[k:n:unit], strict=True):
                a = v + (a + b >> 1) & 255
                own.append(a)
        else:
            for v, b in zip(x[k::unit], up[k:n:unit], strict=True):
                p, q = b - c, a - c
                r = abs(p + q)
                p, q = abs(p), abs(q)
                a = v + (a if p <= q and p <= r else b if q <= r else c) & 255
                c = b
                own.append(a)
        out[k::unit] = bytes(own)
    return bytes(out)

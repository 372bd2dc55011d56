"""The standard security handler: keys, authentication, decryption and AES-256 encryption of documents."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os

from .model import HexBytes, Name, PdfError, Ref, Stream

#: Fixed value: the padding of passwords in revisions 2 to 4.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a * (b & 1)
        a, b = (a << 1) ^ (0x11B if a & 128 else 0), b >> 1
    return out


@functools.cache
def _boxes() -> tuple[bytes, bytes, dict[int, bytes]]:
    box = bytearray(256)
    for x in range(256):
        inv = next((y for y in range(256) if _times(x, y) == 1), 0)
        box[x] = functools.reduce(lambda a, k: a ^ ((inv << k | inv >> (8 - k)) & 255), range(5), 0x63)
    back = bytearray(256)
    for x, y in enumerate(box):
        back[y] = x
    return bytes(box), bytes(back), {k: bytes(_times(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}


class _Aes:
    """Plain AES on single blocks, used only where libcrypto is absent."""

    def __init__(self, key: bytes) -> None:
        box = _boxes()[0]
        n = len(key) // 4
        w, rcon = [key[4 * i : 4 * i + 4] for i in range(n)], 1
        self.rounds = n + 6
        for i in range(n, 4 * (self.rounds + 1)):
            t = w[-1]
            if i % n == 0:
                t = bytes([box[t[1]] ^ rcon, box[t[2]], box[t[3]], box[t[0]]])
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                t = t.translate(box)
            w.append(bytes(a ^ b for a, b in zip(w[i - n], t, strict=True)))
        self.keys = [b"".join(w[4 * r : 4 * r + 4]) for r in range(self.rounds + 1)]

    def encrypt(self, b: bytes) -> bytes:
        box, _, m = _boxes()
        x = bytes(p ^ q for p, q in zip(b, self.keys[0], strict=True))
        for r in range(1, self.rounds + 1):
            x = bytes(x[(i + 4 * (i % 4)) % 16] for i in range(16)).translate(box)
            if r < self.rounds:
                x = bytes(m[2][x[i]] ^ m[3][x[i - i % 4 + (i + 1) % 4]] ^ x[i - i % 4 + (i + 2) % 4] ^ x[i - i % 4 + (i + 3) % 4] for i in range(16))
            x = bytes(p ^ q for p, q in zip(x, self.keys[r], strict=True))
        return x

    def decrypt(self, b: bytes) -> bytes:
        _, back, m = _boxes()
        x = b
        for r in range(self.rounds, 0, -1):
            x = bytes(p ^ q for p, q in zip(x, self.keys[r], strict=True))
            if r < self.rounds:
                x = bytes(m[14][x[i]] ^ m[11][x[i - i % 4 + (i + 1) % 4]] ^ m[13][x[i - i % 4 + (i + 2) % 4]] ^ m[9][x[i - i % 4 + (i + 3) % 4]] for i in range(16))
            x = bytes(x[(i - 4 * (i % 4)) % 16] for i in range(16)).translate(back)
        return bytes(p ^ q for p, q in zip(x, self.keys[0], strict=True))


@functools.cache
def _library():  # noqa: ANN202
    try:
        lib = ctypes.CDLL("libcrypto.so.3")
        for f in ("EVP_CIPHER_CTX_new", "EVP_aes_128_cbc", "EVP_aes_256_cbc"):
            getattr(lib, f).restype = ctypes.c_void_p
        return lib
    except OSError:
        return None


def cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
    """AES-CBC without padding; data is aligned."""
    if not data:
        return b""
    if (lib := _library()) is not None:
        ctx = ctypes.c_void_p(lib.EVP_CIPHER_CTX_new())
        try:
            kind = ctypes.c_void_p(lib.EVP_aes_128_cbc() if len(key) == 16 else lib.EVP_aes_256_cbc())
            out, n = ctypes.create_string_buffer(len(data) + 16), ctypes.c_int()
            ok = lib.EVP_CipherInit_ex(ctx, kind, None, key, iv, int(encrypt)) == 1
            ok = ok and lib.EVP_CIPHER_CTX_set_padding(ctx, 0) == 1 and lib.EVP_CipherUpdate(ctx, out, ctypes.byref(n), data, len(data)) == 1
            if not ok or n.value != len(data):
                raise PdfError("ERROR", "the cipher failed")
            return out.raw[: n.value]
        finally:
            lib.EVP_CIPHER_CTX_free(ctx)
    aes, out, last = _Aes(key), [], iv
    for i in range(0, len(data), 16):
        block = data[i : i + 16]
        if encrypt:
            last = aes.encrypt(bytes(a ^ b for a, b in zip(block, last, strict=True)))
            out.append(last)
        else:
            out.append(bytes(a ^ b for a, b in zip(aes.decrypt(block), last, strict=True)))
            last = block
    return b"".join(out)


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    """The IV comes first; data that is short, unaligned or badly padded gives nothing."""
    if len(data) < 32 or len(data) % 16:
        return b""
    plain = cbc(key, data[:16], data[16:], False)
    n = plain[-1]
    return plain[:-n] if 1 <= n <= 16 and plain.endswith(bytes([n]) * n) else b""


def aes_encrypt(key: bytes, data: bytes, iv: bytes | None = None) -> bytes:
    iv = iv or os.urandom(16)
    n = 16 - len(data) % 16
    return iv + cbc(key, iv, data + bytes([n]) * n, True)


def hash_r6(password: bytes, salt: bytes, user: bytes) -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    n = 0
    while True:
        e = cbc(k[:16], k[16:32], (password + k + user) * 64, True)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[int.from_bytes(e[:16], "big") % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


def _bytes(d: dict, key: str) -> bytes:
    v = d.get(key)
    if not isinstance(v, bytes):
        raise PdfError("ERROR", f"no /{key} in the encryption dictionary")
    return bytes(v)


class Decryptor:
    """Authenticates a password and decrypts objects."""

    def __init__(self, d: dict, first_id: bytes, password: str) -> None:
        if d.get("Filter") != "Standard":
            raise PdfError("ERROR", "unsupported security handler")
        v, self.r = d.get("V", 0), d.get("R", 0)
        if v not in (1, 2, 4, 5):
            raise PdfError("ERROR", f"unsupported encryption version {v}")
        self.o, self.u, self.p, self.id = _bytes(d, "O"), _bytes(d, "U"), d.get("P", 0), first_id
        bits = d.get("Length", 40)
        self.n = 5 if v == 1 or type(bits) is not int else min(max(bits // 8, 5), 16)
        self.meta = d.get("EncryptMetadata") is not False
        self.method = {5: "aes256"}.get(v, "rc4")
        if v in (4, 5):
            name = d.get("StmF", "Identity")
            own = (d.get("CF") or {}).get(name) or {}
            self.method = "none" if name == "Identity" else {"V2": "rc4", "AESV2": "aes128", "AESV3": "aes256", "None": "none"}.get(own.get("CFM"), "rc4")
            self.n = 16
        key = self._new_key(d, password) if v == 5 else self._old_key(password)
        if key is None:
            raise PdfError("ENCRYPTED", "a password is needed") if not password else PdfError("WRONG_PASSWORD", "the password is wrong")
        self.key = key

    def _from_user(self, pw: bytes) -> bytes | None:
        h = hashlib.md5((pw + PAD)[:32] + self.o[:32] + (self.p & 0xFFFFFFFF).to_bytes(4, "little") + self.id + (b"\xff\xff\xff\xff" if self.r >= 4 and not self.meta else b"")).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h[: self.n]).digest()
        key = h[: self.n]
        if self.r == 2:
            return key if rc4(key, PAD) == self.u[:32] else None
        x = rc4(key, hashlib.md5(PAD + self.id).digest())
        for k in range(1, 20):
            x = rc4(bytes(c ^ k for c in key), x)
        return key if x == self.u[:16] else None

    def _old_key(self, password: str) -> bytes | None:
        pw = password.encode("latin-1", "replace")
        if (key := self._from_user(pw)) is not None:
            return key
        h = hashlib.md5((pw + PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h).digest()
        x = self.o[:32]
        for k in range(19, -1, -1) if self.r >= 3 else (0,):
            x = rc4(bytes(c ^ k for c in h[: self.n]), x)
        return self._from_user(x)

    def _new_key(self, d: dict, password: str) -> bytes | None:
        pw = password.encode()[:127]
        digest = hash_r6 if self.r >= 6 else lambda a, b, c: hashlib.sha256(a + b + c).digest()
        for own, wrapped, user in ((self.o, "OE", self.u[:48]), (self.u, "UE", b"")):
            if len(own) >= 48 and digest(pw, own[32:40], user) == own[:32]:
                return cbc(digest(pw, own[40:48], user), bytes(16), _bytes(d, wrapped)[:32], False)
        return None

    def _plain(self, ref: Ref, data: bytes) -> bytes:
        if self.method == "none":
            return data
        if self.method == "aes256":
            return aes_decrypt(self.key, data)
        salt = b"sAlT" if self.method == "aes128" else b""
        key = hashlib.md5(self.key + ref.num.to_bytes(4, "little")[:3] + ref.gen.to_bytes(2, "little") + salt).digest()[: min(self.n + 5, 16)]
        return aes_decrypt(key, data) if salt else rc4(key, data)

    def _value(self, ref: Ref, v: object) -> object:
        if isinstance(v, bytes):
            return type(v)(self._plain(ref, bytes(v)))
        if isinstance(v, list):
            return [self._value(ref, x) for x in v]
        if isinstance(v, dict):
            return {k: self._value(ref, x) for k, x in v.items()}
        if isinstance(v, Stream):
            kind = v.dict.get("Type")
            if kind == "XRef" or kind == "Metadata" and not self.meta:
                return v
            return Stream(self._value(ref, v.dict), self._plain(ref, v.data))
        return v

    def apply(self, objects: dict[Ref, object], exempt: Ref | None) -> None:
        for ref in objects:
            if ref != exempt:
                objects[ref] = self._value(ref, objects[ref])


def _hidden(v: object, key: bytes) -> object:
    if isinstance(v, bytes):
        return HexBytes(aes_encrypt(key, bytes(v)))
    if isinstance(v, list):
        return [_hidden(x, key) for x in v]
    if isinstance(v, dict):
        return {k: _hidden(x, key) for k, x in v.items()}
    return Stream(_hidden(v.dict, key), aes_encrypt(key, v.data)) if isinstance(v, Stream) else v


def encrypt(doc, user: str, owner: str = "", permissions: int = -4) -> bytes:  # noqa: ANN001
    """The document's bytes under AES-256 (revision 6); without an owner password the user's holds for both."""
    from .document import Document

    upw, opw = user.encode()[:127], (owner or user).encode()[:127]
    key, us, os_ = os.urandom(32), os.urandom(16), os.urandom(16)
    u = hash_r6(upw, us[:8], b"") + us
    ue = cbc(hash_r6(upw, us[8:], b""), bytes(16), key, True)
    o = hash_r6(opw, os_[:8], u) + os_
    oe = cbc(hash_r6(opw, os_[8:], u), bytes(16), key, True)
    perms = cbc(key, bytes(16), (permissions & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + os.urandom(4), True)
    out = Document(max(doc.version, "2.0"), dict(doc.trailer), {r: _hidden(v, key) for r, v in doc.objects.items()})
    cf = {"StdCF": {"CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}}
    d = {"Filter": Name("Standard"), "V": 5, "R": 6, "Length": 256, "P": permissions, "CF": cf, "StmF": Name("StdCF"), "StrF": Name("StdCF"), "EncryptMetadata": True}
    d |= {k: HexBytes(v) for k, v in (("O", o), ("U", u), ("OE", oe), ("UE", ue), ("Perms", perms))}
    first = os.urandom(16)
    return out.to_bytes({"Encrypt": out.add(d), "ID": [HexBytes(first), HexBytes(first)]})

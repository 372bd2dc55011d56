"""Text strings, metadata updates, digests and ciphers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA = ("title", "author", "subject", "keywords", "creator", "producer", "creation_date", "mod_date")


def encode_text(text: Column) -> Column:
    """ASCII as it is; else a byte-order mark and UTF-16BE."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.encode(text, "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))


def decode_text(raw: Column) -> Column:
    """UTF-16BE after a byte-order mark, else one character per byte."""
    marked = F.hex(F.substring(raw, 1, 2)) == "FEFF"
    even = F.substr(raw, F.lit(3), ((F.octet_length(raw) - 2) / 2).cast("int") * 2)
    return F.when(marked, F.decode(even, "UTF-16BE")).otherwise(F.decode(raw, "ISO-8859-1"))


def updated(old: Column, new: Column) -> Column:
    """Null keeps, empty deletes, anything else sets."""
    return F.when(new.isNull(), old).when(new == "", F.lit(None)).otherwise(new)


def decode_hex(digits: Column) -> Column:
    """ASCIIHex: blanks are skipped, `>` ends, an odd digit is padded by 0; null where another byte occurs."""
    body = F.regexp_replace(F.substring_index(digits, ">", 1), r"[\x00\t\n\f\r ]", "")
    return F.when(body.rlike("^[0-9A-Fa-f]*$"), F.unhex(F.when(F.length(body) % 2 == 1, F.concat(body, F.lit("0"))).otherwise(body)))


def aes_encrypt_cbc(data: Column, key: Column, iv: Column) -> Column:
    return F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv)


def aes_decrypt_cbc(data: Column, key: Column) -> Column:
    """Empty where data is too short, unaligned or does not decrypt."""
    return F.coalesce(F.when((F.octet_length(data) >= 32) & (F.octet_length(data) % 16 == 0), F.try_aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))), F.lit(b""))


def aes_encrypt_unpadded(data: Column, key: Column, iv: Column) -> Column:
    """CBC without padding, for aligned data: the last block of the padded form is dropped, and so is the IV."""
    padded = aes_encrypt_cbc(data, key, iv)
    return F.substr(padded, F.lit(17), F.octet_length(data))


def aes_decrypt_unpadded(data: Column, key: Column, iv: Column) -> Column:
    """CBC without padding: a block that decrypts to padding is appended."""
    last = F.substr(data, F.octet_length(data) - 15, F.lit(16))
    tail = F.substr(aes_encrypt_cbc(F.lit(b""), key, last), F.lit(17), F.lit(16))
    return F.try_aes_decrypt(F.concat(iv, data, tail), key, F.lit("CBC"), F.lit("PKCS"))

"""Keyed hashes and name-based ids from built-in digests, without a UDF."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of(seed: int | str, purpose: str = "log-token-key") -> bytes:
    """The key that a seed stands for; tags agree with those of another system if it hashes the same purpose."""
    return hashlib.sha256(f"{purpose}:{seed}".encode()).digest()


def _pads(key: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text, as hexadecimal digits."""
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def hmac_sha256_sql(key: bytes, message: str) -> str:
    """The same in SQL, for a text that is ASCII."""
    inner, outer = _pads(key)
    return f"sha256(from_hex('{outer.hex()}') || from_hex(sha256(from_hex('{inner.hex()}') || encode({message}))))"


def tag(key: bytes, kind: str, token: Column) -> Column:
    """Tag of a token within a subcategory."""
    return hmac_sha256(key, F.concat(F.lit(f"{kind}|"), token))


def novelty_tag(key: bytes, kind: str, value: Column) -> Column:
    return tag(key, f"benign-baseline|{kind}", value)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))

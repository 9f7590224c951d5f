"""Bytes as column expressions: obfuscation, encryption, fixed-width integers, digests and magic numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heads of obfuscated bundles, and how many bytes of a masked one are masked in its repeating pattern.
PLAIN_HEAD, MASKED_HEAD, MASKED_BYTES, MASKED_OF, PATTERN_BYTES = "20000000", "10000000", 128, 5, 8
VIDEO_MAGIC = "43524944"


def _hex(h: str) -> Column:
    return F.unhex(F.lit(h))


def complement(data: Column) -> Column:
    """All bits inverted, by way of hexadecimal digits."""
    return F.unhex(F.translate(F.hex(data), "0123456789ABCDEF", "FEDCBA9876543210"))


def deobfuscate(data: Column) -> Column:
    """A plain head goes; after a masked head, 5 of each 8 of the first 128 bytes are inverted unless the body is shorter;
    anything else stays."""
    body = F.substr(data, F.lit(5))
    blocks = []
    for at in range(1, MASKED_BYTES, PATTERN_BYTES):
        blocks += [complement(F.substring(body, at, MASKED_OF)), F.substring(body, at + MASKED_OF, PATTERN_BYTES - MASKED_OF)]
    unmasked = F.concat(*blocks, F.substr(body, F.lit(MASKED_BYTES + 1)))
    masked = F.when(F.length(body) >= MASKED_BYTES, unmasked).otherwise(body)
    return F.when(F.startswith(data, _hex(PLAIN_HEAD)), body).when(F.startswith(data, _hex(MASKED_HEAD)), masked).otherwise(data)


def little_endian(data: Column, at: int, size: int) -> Column:
    """The unsigned integer of size bytes at an offset from 0, as a decimal; null if data is too short."""
    taken = F.substring(data, at + 1, size)
    return F.when(F.length(taken) == size, F.conv(_reversed_hex(taken, size), 16, 10).cast("decimal(20,0)"))


def to_little_endian(n: Column, size: int) -> Column:
    """A number from 0 on as size bytes."""
    return F.unhex(_reversed_hex(F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0")), size))


def _reversed_hex(data: Column, size: int) -> Column:
    return F.concat(*[F.hex(F.substring(data, k, 1)) for k in range(size, 0, -1)])


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def is_video(data: Column) -> Column:
    return F.coalesce(F.startswith(data, _hex(VIDEO_MAGIC)), F.lit(False))


def check_key(key: str, iv: str) -> None:
    """ValueError unless key and iv are hexadecimal and of lengths that AES takes."""
    if not re.fullmatch("[0-9a-fA-F]*", key + iv) or len(key) % 2 or len(iv) % 2:
        raise ValueError("key and iv must be hexadecimal")
    if len(iv) != 32:
        raise ValueError("the iv must have 16 bytes")
    if len(key) not in (32, 48, 64):
        raise ValueError("the key must have 16, 24 or 32 bytes")


def decrypt(content: Column, key: str, iv: str, strict: bool = True) -> Column:
    """AES-CBC with PKCS#7 padding. Not strict: null for what does not decrypt; strict: the query fails."""
    check_key(key, iv)
    ok = (F.length(content) > 0) & (F.length(content) % 16 == 0)
    whole = F.concat(_hex(iv), content)
    out = (F.aes_decrypt if strict else F.try_aes_decrypt)(whole, _hex(key), F.lit("CBC"), F.lit("PKCS"))
    bad = F.raise_error(F.lit("encrypted content must be a positive multiple of 16 bytes")).cast("binary") if strict else F.lit(None).cast("binary")
    return F.when(ok, out).otherwise(bad)

"""Keyed column functions (K1-K5)."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

ERASED = "[WIPED]"
UNREADABLE = "[UNREADABLE]"
_BLOCK = 64


def derive_key(master: bytes, purpose: bytes, salt: bytes = b"", length: int = 32) -> bytes:
    """K2: HKDF-SHA256; one sub-key per purpose.  Runs once on the driver."""
    secret = hmac.new(salt or bytes(32), master, hashlib.sha256).digest()
    out, block, n = b"", b"", 1
    while len(out) < length:
        block = hmac.new(secret, block + purpose + bytes([n]), hashlib.sha256).digest()
        out, n = out + block, n + 1
    return out[:length]


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer HMAC pad of ``key``."""
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def blind_index(identifier: Column, key: bytes) -> Column:
    """K1: HMAC-SHA256 hex of the decimal id, from built-ins only.

    The key is a plan literal: redact it with ``spark.sql.redaction.string.regex``
    wherever plans are logged.
    """
    inner, outer = (F.unhex(F.lit(p.hex())) for p in pads(key))
    message = identifier.cast("string").cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def encrypt(c: Column, key: bytes) -> Column:
    """K3: authenticated encryption with a random IV; null stays null."""
    return F.base64(F.aes_encrypt(c.cast("string"), F.unhex(F.lit(key.hex())), F.lit("GCM")))


def decrypt(token: Column, key: bytes) -> Column:
    """K4: empty becomes null, the erased mark passes, a bad token becomes a marker."""
    bytes_ = F.try_to_binary(token, F.lit("base64"))
    plain = F.try_aes_decrypt(bytes_, F.unhex(F.lit(key.hex())), F.lit("GCM")).cast("string")
    return (
        F.when(F.coalesce(token, F.lit("")) == "", F.lit(None))
        .when(token == ERASED, token)
        .otherwise(F.coalesce(plain, F.lit(UNREADABLE)))
    )


def decrypt_int(token: Column, key: bytes) -> Column:
    """K5."""
    return decrypt(token, key).try_cast("bigint")

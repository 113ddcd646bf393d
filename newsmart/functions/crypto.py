"""Text encryption with a key that is handed in, never stored here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt_text(c: Column, key: Column) -> Column:
    """Base64 of AES-GCM; NULL and empty text pass through."""
    return F.when(c.isNull() | (c == ""), c).otherwise(F.base64(F.aes_encrypt(c, key)))


def decrypt_text(c: Column, key: Column) -> Column:
    """Plain text; what cannot be decrypted (older plain rows) is returned as it is."""
    shape = c.rlike(r"^[A-Za-z0-9+/\r\n]+={0,2}$")
    raw = F.when(shape, F.try_to_binary(c, F.lit("base64")))
    return F.coalesce(F.try_aes_decrypt(raw, key).cast("string"), c)

"""SHA-256 and HMAC-SHA256 from built-in expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import canonical_json

_BLOCK = 64


def payload_digest(json_text: Column) -> Column:
    """SHA-256 hex of the canonical form; null for invalid JSON."""
    return F.sha2(canonical_json(json_text), 256)


def call_signature(tool: Column, arguments: Column) -> Column:
    """Equal for the same tool with the same arguments in any key order. The length
    prefix keeps (tool, arguments) pairs apart; text that is not JSON is hashed as is."""
    args = F.coalesce(canonical_json(arguments), arguments, F.lit("null"))
    return F.sha2(F.concat_ws("|", F.length(tool).cast("string"), tool, args), 256)


def hmac_pads(spark: SparkSession, secrets: dict[str, bytes]) -> DataFrame:
    """One row per configured key with the two padded keys of HMAC-SHA256."""
    rows = []
    for key_id, secret in secrets.items():
        key = hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret
        key = key.ljust(_BLOCK, b"\0")
        rows.append((key_id, bytearray(b ^ 0x36 for b in key), bytearray(b ^ 0x5C for b in key)))
    return spark.createDataFrame(rows, "key_id string, ipad binary, opad binary")


def hmac_sha256(ipad: Column, opad: Column, message: Column) -> Column:
    inner = F.unhex(F.sha2(F.concat(ipad, message.cast("binary")), 256))
    return F.sha2(F.concat(opad, inner), 256)

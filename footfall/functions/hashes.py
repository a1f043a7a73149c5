"""Keyed hashes made of `sha2`; the key pads are literals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.addresses import mask_address
from footfall.functions.text import as_column
from footfall.schema import HASH_LENGTH


def key_pads(secret: str) -> tuple[str, str]:
    """Inner and outer HMAC-SHA256 pads as hex text."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(message, secret: str) -> Column:
    inner, outer = key_pads(secret)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(as_column(message), "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def hash_address(address, agent, secret: str, salt) -> Column:
    """Daily hash of an address: 39 hex digits over salt|address|agent."""
    message = F.concat_ws("|", as_column(salt), as_column(address), F.coalesce(as_column(agent), F.lit("")))
    return F.substring(hmac_sha256(message, secret), 1, HASH_LENGTH)


def visitor_hash(address, agent, dt, secret: str) -> Column:
    """Daily visitor hash over the masked address, agent and day."""
    day = F.date_format(F.timestamp_seconds(as_column(dt)), "yyyyMMdd")
    agent = F.substring(F.coalesce(as_column(agent), F.lit("")), 1, 512)
    return hmac_sha256(F.concat_ws("|", mask_address(address), agent, day), secret)


def anonymous_visit_id(fingerprint, address, agent, dt, secret: str, salt) -> Column:
    """Cookie-less visit number: the first 32 bits of a keyed hash.

    With a fingerprint it is stable for the salt; without one it covers
    address, agent and a five-minute slot.
    """
    salt = as_column(salt)
    slot = (F.floor(as_column(dt) / 300) * 300).cast("string")
    agent = F.coalesce(as_column(agent), F.lit(""))
    message = F.when(
        F.nullif(as_column(fingerprint), F.lit("")).isNotNull(), F.concat_ws("|", salt, as_column(fingerprint))
    ).otherwise(F.concat_ws("|", salt, as_column(address), agent, slot))
    return F.conv(F.substring(hmac_sha256(message, secret), 1, 8), 16, 10).cast("bigint")

"""Content digests: base32 of SHA-1, as crawl logs write them.

Spark has no base32; the 160-bit SHA-1 (40 hex digits) is cut into eight
20-bit groups of 5 hex digits, each giving four 5-bit base32 letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col_of

# Fixed value: the RFC 4648 base32 alphabet.
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_sha1_hex(hex40) -> Column:
    h = col_of(hex40)

    def one(i):
        start = (F.floor(i / 4) * 5 + 1).cast("int")
        twenty_bits = F.conv(F.substr(h, start, F.lit(5)), 16, 10).cast("int")
        shift = F.lit(15) - (i % 4) * 5
        five_bits = F.floor(twenty_bits / F.pow(F.lit(2), shift)).cast("int") % 32
        return F.substr(F.lit(BASE32_ALPHABET), (five_bits + 1).cast("int"), F.lit(1))

    return F.when(h.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), one), ""))


def content_digest(body) -> Column:
    """base32(SHA-1(bytes)), 32 characters, no prefix."""
    return base32_of_sha1_hex(F.sha1(col_of(body).cast("binary")))

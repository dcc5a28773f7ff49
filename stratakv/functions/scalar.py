"""Sizes, digests and formats of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LARGE_BYTES


def n_bytes(value: Column) -> Column:
    return F.octet_length(value).cast("long")


def is_large(value: Column) -> Column:
    return F.coalesce(n_bytes(value) > LARGE_BYTES, F.lit(False))


def state(value: Column, tomb: Column) -> Column:
    """nil, empty, inline, large or tombstone."""
    return F.when(tomb, "tombstone").when(value.isNull(), "nil").when(n_bytes(value) == 0, "empty").when(is_large(value), "large").otherwise("inline")


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def varint_bytes(n: Column) -> Column:
    """Bytes of a base-128 number."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("long")


def record_bytes(key: Column, value: Column, tomb: Column) -> Column:
    """Encoded size of a log record: two varints, key, value or pointer, clock, checksum."""
    k, v = n_bytes(key), n_bytes(value)
    large = is_large(value)
    raw = F.when(tomb | large, F.lit(10)).when(value.isNull(), F.lit(1)).otherwise(varint_bytes(v + 2))
    body = F.when(tomb | large, F.lit(16)).when(value.isNull(), F.lit(0)).otherwise(v)
    return (varint_bytes(k) + raw + k + body + 12).cast("long")


def approximate_bytes(key: Column, value: Column) -> Column:
    return F.lit(24).cast("long") + n_bytes(key) + F.coalesce(n_bytes(value), F.lit(0))


def underscored(n: Column) -> Column:
    """1234567 as 1_234_567."""
    return F.translate(F.format_number(n, 0), ",", "_")


def hex_key(n: Column, length: int) -> Column:
    return F.rpad(F.lpad(F.lower(F.hex(n)), 16, "0"), max(length, 16), "!")


def letters_value(length: int) -> Column:
    """ABC...Z repeated to length."""
    return F.lit(("ABCDEFGHIJKLMNOPQRSTUVWXYZ" * (length // 26 + 1))[:length])


#: The reversed polynomial of CRC-32C.
CASTAGNOLI = 0x82F63B78


def _crc_row(byte: int) -> int:
    for _ in range(8):
        byte = (byte >> 1) ^ (CASTAGNOLI if byte & 1 else 0)
    return byte


def crc32c(text: Column) -> Column:
    """CRC-32C of the UTF-8 bytes, by a table that follows from the polynomial; null for null."""
    table = F.split(F.lit(",".join(str(_crc_row(i)) for i in range(256))), ",").cast("array<bigint>")
    hexed = F.hex(text.cast("binary"))
    octets = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.conv(F.substring(hexed, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    octets = F.when(F.octet_length(text) > 0, octets).otherwise(F.array().cast("array<bigint>"))
    step = lambda c, b: F.shiftright(c, 8).bitwiseXOR(F.get(table, c.bitwiseXOR(b).bitwiseAND(F.lit(255)).cast("int")))
    value = F.aggregate(octets, F.lit(0xFFFFFFFF).cast("long"), step).bitwiseXOR(F.lit(0xFFFFFFFF))
    return F.when(text.isNotNull(), value)


def fingerprint(crc: Column) -> Column:
    """The two halves of a checksum on each other, never 0."""
    return F.greatest(crc.bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.shiftright(crc, 16)), F.lit(1))


def partition(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit(1023))

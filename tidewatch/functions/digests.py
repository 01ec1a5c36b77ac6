"""Digests and fingerprints as column expressions; byte layouts are length-prefixed, big-endian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column) -> Column:
    """A column as UTF-8 bytes."""
    return value.cast("string").cast("binary")


def length_prefix(data: Column) -> Column:
    """Four big-endian bytes with the length of `data`."""
    return F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0"))


def prefixed(data: Column) -> Column:
    return F.concat(length_prefix(data), data)


def domain_digest(domain: str, parts: list[Column]) -> Column:
    """SHA-256 (hex) of a domain name, a zero byte and length-prefixed parts."""
    return F.sha2(F.concat(F.lit(domain.encode() + b"\0"), *[prefixed(text(p)) for p in parts]), 256)


def id_set_digest(domain: str, head: list[Column], ids: Column) -> Column:
    """As domain_digest, with an array of ids in ascending order after the head parts."""
    tail = F.aggregate(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), F.lit(b""), lambda acc, x: F.concat(acc, prefixed(x.cast("binary"))))
    return F.sha2(F.concat(F.lit(domain.encode() + b"\0"), *[prefixed(text(p)) for p in head], tail), 256)


def record_fingerprint(domain: str, columns: list[str]) -> Column:
    """SHA-256 (hex) over length-prefixed names and values of a record; nulls differ from empty texts."""
    parts = []
    for name in columns:
        value = F.col(name).cast("string")
        parts += [F.lit(name), F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), value))]
    return domain_digest(domain, parts)


def normal_token(value: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed; null as empty."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), r"\s+", " ")


def simhash64(tokens: list[Column]) -> Column:
    """Signed 64-bit SimHash of at most 7 position-tagged tokens; empty ones are skipped, ties set the bit.

    The ones of all 64 positions are counted at once in three bit planes (half adders over longs)
    and compared with half the number of tokens.
    """
    if len(tokens) > 7:
        raise ValueError("three bit planes count at most 7 tokens")
    hashes = F.array_compact(
        F.array(*[F.when(t != "", F.conv(F.substring(F.sha2(F.concat(F.lit(f"{i}:"), t), 256), 1, 16), 16, -10).cast("long")) for i, t in enumerate(tokens)])
    )
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("a"), zero.alias("b"), zero.alias("c"), F.lit(0).alias("n"))

    def add(acc: Column, h: Column) -> Column:
        carry = acc.a.bitwiseAND(h)
        return F.struct(acc.a.bitwiseXOR(h).alias("a"), acc.b.bitwiseXOR(carry).alias("b"), acc.c.bitwiseXOR(acc.b.bitwiseAND(carry)).alias("c"), (acc.n + 1).alias("n"))

    def majority(acc: Column) -> Column:
        one = acc.a.bitwiseOR(acc.b).bitwiseOR(acc.c)
        three = acc.c.bitwiseOR(acc.a.bitwiseAND(acc.b))
        return F.when(acc.n == 0, F.lit(-1).cast("long")).when(acc.n <= 2, one).when(acc.n <= 4, acc.b.bitwiseOR(acc.c)).when(acc.n <= 6, three).otherwise(acc.c)

    return F.aggregate(hashes, start, add, majority)


def as_hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def share_of_hash(hex_digest: Column) -> Column:
    """The first 52 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(hex_digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))

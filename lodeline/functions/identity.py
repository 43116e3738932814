"""Stable identifiers of files and commits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 32-bit FNV-1a: the prime and the two bases (fixed values).
PRIME = 0x01000193
BASES = (0x811C9DC5, 0x7F4A7C15)


def _fnv(bytes_: Column, basis: int) -> Column:
    """FNV-1a over an array of byte values; a step fits into 64 bits, so nothing overflows."""
    return F.aggregate(bytes_, F.lit(basis).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def node_id(path: Column | str) -> Column:
    """``n:`` and twelve hex digits of the path's first known name: two digests over its UTF-16 code units, low byte first."""
    raw = F.hex(F.encode(F.col(path) if isinstance(path, str) else path, "UTF-16LE"))
    n = F.length(raw)
    values = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long"))
    bytes_ = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(values)
    digest = F.concat(*[F.lpad(F.lower(F.hex(_fnv(bytes_, b))), 8, "0") for b in BASES])
    return F.concat(F.lit("n:"), F.substring(digest, 1, 12))


def commit_id(sha: Column | str) -> Column:
    return F.concat(F.lit("c:"), F.substring(F.col(sha) if isinstance(sha, str) else sha, 1, 12))

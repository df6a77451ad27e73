"""Byte-exact hashes as composed built-ins: little-endian words, chunk digests, rendezvous scores, Bloom positions, cluster hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..units import U64


def text_bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def swap_hex(h: Column, size: int = 8) -> Column:
    """Hex of `size` bytes with the bytes in reverse order."""
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def le8(n: Column) -> Column:
    """A non-negative bigint as 8 bytes, least first (BINARY)."""
    return F.unhex(swap_hex(F.lpad(F.hex(n), 16, "0")))


ZERO = b"\x00"


def chunk_digest(mount: Column, blob: Column, offset: Column) -> Column:
    """SHA-256 over mount, 0, blob, 0, offset as 64 bits little-endian; lower-case hex."""
    return F.sha2(F.concat(text_bytes(mount), F.lit(ZERO), text_bytes(blob), F.lit(ZERO), le8(offset)), 256)


def hrw_score(peer: Column, digest_hex: Column) -> Column:
    """First 8 bytes of SHA-256(peer, digest) read little-endian, as 16 hex digits: their order as text is the unsigned order."""
    return swap_hex(F.substring(F.sha2(F.concat(text_bytes(peer), F.unhex(digest_hex)), 256), 1, 16))


def u64(hex16: Column) -> Column:
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def bloom_positions(digest_hex: Column, m_bits: int, k: int = 4) -> Column:
    """array<bigint>: (h1 + i * h2 mod 2^64) mod m for i < k, of the digest's first two little-endian words."""
    if m_bits & (m_bits - 1) == 0 and m_bits <= 1 << 32:
        # A power of two: the words' low halves, their first four bytes, decide alone.
        low1, low2 = (F.conv(swap_hex(F.substring(digest_hex, at, 8), 4), 16, 10).cast("bigint") for at in (1, 17))
        return F.array(*[(low1 + low2 * F.lit(i)).bitwiseAND(F.lit(m_bits - 1).cast("bigint")) for i in range(k)])
    h1, h2 = u64(swap_hex(F.substring(digest_hex, 1, 16))), u64(swap_hex(F.substring(digest_hex, 17, 16)))
    turn = F.lit(str(U64)).cast("decimal(20,0)")
    return F.array(*[(((h1 + h2 * F.lit(i).cast("decimal(1,0)")) % turn) % F.lit(m_bits).cast("decimal(20,0)")).cast("bigint") for i in range(k)])


def bloom_fp_theory(n: Column, m_bits: int, k: int = 4) -> Column:
    return F.pow(F.lit(1.0) - F.exp(-F.lit(float(k)) * n / F.lit(float(m_bits))), F.lit(float(k)))


def cluster_hash(chunk_size: Column, kind: Column, mounts: Column) -> Column:
    """SHA-256 over chunk size, transport kind, 0, and of each mount, by name: name, account, container, prefix, each followed by 0."""
    parts = F.transform(F.array_sort(mounts), lambda m: F.concat(*[F.concat(F.coalesce(m[f], F.lit("")), F.lit("\x00")) for f in ("name", "account", "container", "prefix")]))
    return F.sha2(F.concat(le8(chunk_size), text_bytes(kind), F.lit(ZERO), text_bytes(F.array_join(parts, ""))), 256)

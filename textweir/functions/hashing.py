"""Integer hashes as column expressions, safe under ANSI arithmetic (masked 64-bit)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 4294967295


def _lit(x) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x


def imul(x, y) -> Column:
    """Product of two 32-bit numbers modulo 2**32, without overflow."""
    x, y = _lit(x), _lit(y)
    low = x.bitwiseAND(F.lit(65535)) * y
    high = (F.shiftright(x, 16).bitwiseAND(F.lit(65535)) * y.bitwiseAND(F.lit(65535))).bitwiseAND(F.lit(65535))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(M32))


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-16 units of a string of the basic plane."""
    unit = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(unit, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(M32)))


def mix(base: Column, seed) -> Column:
    """A 32-bit finaliser of base and seed."""
    h = base.bitwiseXOR(imul(seed, 0x9E3779B1))
    h = imul(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), 0x21F0AAAD)
    h = imul(h.bitwiseXOR(F.shiftrightunsigned(h, 15)), 0x735A2D97)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 15))


def mulberry(seed: int, i: Column) -> Column:
    """Draw i (from 0) of the seeded generator, in [0, 1): its state is a counter."""
    a = (F.lit(seed).cast("long") + imul(F.lit(0x6D2B79F5).cast("long"), (i.cast("long") + 1).bitwiseAND(F.lit(M32)))).bitwiseAND(F.lit(M32))
    t = imul(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + imul(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(M32)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def mulberry_array(seed: int, i: np.ndarray) -> np.ndarray:
    """``mulberry`` of many places at once; as a column its expression is too large to be compiled beside others."""
    m32 = np.uint64(M32)
    a = np.uint64(seed & M32) + np.uint64(0x6D2B79F5) * (i.astype(np.uint64) + np.uint64(1) & m32) & m32
    t = (a ^ a >> np.uint64(15)) * (a | np.uint64(1)) & m32
    t ^= t + ((t ^ t >> np.uint64(7)) * (t | np.uint64(61)) & m32) & m32
    return (t ^ t >> np.uint64(14)) / 4294967296.0


class Mulberry:
    """The same generator on the driver, for shuffles that are sequential by nature."""

    def __init__(self, seed: int):
        self.a = seed & M32

    def __call__(self) -> float:
        self.a = (self.a + 0x6D2B79F5) & M32
        t = (self.a ^ self.a >> 15) * (self.a | 1) & M32
        t ^= t + ((t ^ t >> 7) * (t | 61) & M32) & M32
        return (t ^ t >> 14) / 4294967296


def gram_key(hashes: Column) -> Column:
    """53-bit key of a window of token hashes: two polynomial lanes."""
    a = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (imul(acc, 0x01000193) + h).bitwiseAND(F.lit(M32)))
    b = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (imul(acc, 0x85EBCA6B) + h).bitwiseAND(F.lit(M32)))
    return a * F.lit(2097152) + F.shiftrightunsigned(b, 11)


def portable_hash(parts) -> str:
    """128 bits in hex from four FNV lanes over the parts, each closed by a separator."""
    lanes = [0x811C9DC5, 0x01000193, 0x9E3779B9, 0x85EBCA6B]
    for part in parts:
        raw = part.encode("utf-16-le", "surrogatepass")
        units = [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]
        for u in units:
            lanes = [((h ^ u + k) * 16777619) & M32 for k, h in enumerate(lanes)]
        lanes = [((h ^ 0xFF) * 16777619) & M32 for h in lanes]
    return "".join(f"{h:08x}" for h in lanes)


def sampled_digest(lines, size: int) -> str:
    """SHA-256 (32 hex digits) of the first 64 lines, every 1,000th, and the totals."""
    kept, n = [], 0
    for line in lines:
        if n < 64 or n % 1000 == 0:
            kept.append(line)
        n += 1
    return hashlib.sha256("\n".join([*kept, f"lines:{n}", f"bytes:{size}"]).encode()).hexdigest()[:32]


def full_digest(lines) -> str:
    """SHA-256 over trimmed lines that aren't empty; sequential, so on the driver."""
    h = hashlib.sha256()
    for line in lines:
        if line := line.strip():
            h.update(line.encode() + b"\n")
    return h.hexdigest()

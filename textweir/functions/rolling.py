"""The scan tokenizer and its n-grams over Arrow batches, vectorised over whole chunks of text.

Same tokens as ``text.scan_tokens``: letters, numbers and the apostrophe of the
basic plane, each character lower-cased alone unless that changes its length.
Characters go through a table of random words; a token's hash is a difference of
prefix sums of table[c] * M**place, and a gram's the same over its tokens.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Characters that are hashed together; a longer text is a chunk of its own.
CHUNK = 1 << 18


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a character of the basic plane belongs to a token, and its word."""
    chars = [chr(c) for c in range(1 << 16)]
    inside = np.array([unicodedata.category(c)[0] in "LN" or c == "'" for c in chars])
    low = np.array([ord(l) if len(l := c.lower()) == 1 and ord(l) < 1 << 16 else i for i, c in enumerate(chars)])
    return inside, np.random.default_rng(11).integers(0, 1 << 64, 1 << 16, U64)[low]


@functools.cache
def _lower() -> np.ndarray:
    """The lower-case unit of each unit of the basic plane."""
    return np.array([ord(l) if len(l := chr(c).lower()) == 1 and ord(l) < 1 << 16 else c for c in range(1 << 16)], U64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1024)
        with np.errstate(over="ignore"):
            have = tuple(np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size - 1, U64(b))])) for b in (base, pow(base, -1, 1 << 64)))
        if size > 4 * CHUNK:
            return have
        _POWERS[base] = have
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> U64(32)) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ x >> U64(29)) * U64(0xC4CEB9FE1A85EC53)
        return x ^ x >> U64(32)


def _spans(x: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of x[start:end] for all pairs."""
    up, down = _powers(base, len(x) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U64(0)], np.cumsum(x * up[: len(x)])])
        return _mix((sums[ends] - sums[starts]) * down[starts])


def _tokens(texts: list[str]):
    """Characters of all texts, where tokens start and end, and how many each text has."""
    inside, _ = _tables()
    joined = "\n".join(texts)
    cp = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if cp.dtype == np.uint32:
        cp = np.where(cp < 1 << 16, cp, 10)
    edge = np.flatnonzero(np.diff(inside[cp].astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes + 1) - sizes - 1
    return cp, starts, ends, np.diff(np.append(np.searchsorted(starts, begin), len(starts)))


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and how many each text has."""
    cp, starts, ends, counts = _tokens(texts)
    return _spans(_tables()[1][cp], _M, starts, ends), counts


_U32 = U64(0xFFFFFFFF)


def fnv(units: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """FNV-1a of many stretches of 16-bit units at once, longest first so that the live ones are a prefix."""
    order = np.argsort(-lens, kind="stable")
    at, size = starts[order], lens[order]
    h = np.full(len(at), 2166136261, U64)
    live = len(at) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), side="right")
    for j, n in enumerate(live.tolist()):
        x = h[:n]
        x ^= units[at[:n] + j]
        x *= U64(16777619)
        x &= _U32
    out = np.empty_like(h)
    out[order] = h
    return out


def file_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, offset, key) of every window of n tokens, with the 53-bit keys of index files; and the number of tokens."""
    cp, starts, ends, counts = _tokens(texts)
    h = fnv(_lower()[cp], starts, ends - starts)
    text, off, at = windows(counts, n)
    a, b = np.zeros(len(at), U64), np.zeros(len(at), U64)
    for j in range(n):
        a = (a * U64(0x01000193) + h[at + j]) & _U32
        b = (b * U64(0x85EBCA6B) + h[at + j]) & _U32
    return text, off, (a * U64(1 << 21) + (b >> U64(11))).view(np.int64), len(h)


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, offset, key) of every window of n tokens; and the number of tokens."""
    tokens, counts = token_hashes(texts)
    return *gram_keys(tokens, counts, n), len(tokens)


def windows(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, place among all tokens) of windows; they never cross texts."""
    size = np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), size)
    off = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    return text, off, off + np.repeat(np.cumsum(counts) - counts, size)


def gram_keys(tokens: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, key) of every window of n token hashes."""
    text, off, at = windows(counts, n)
    return text, off, _spans(tokens, _Q, at, at + n).view(np.int64)


def chunks(column: pa.Array):
    """(first row, texts) pieces of a string column; null is empty."""
    held, size, at = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        held.append(t or "")
        size += len(held[-1]) + 1
        if size >= CHUNK:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


class Lookup:
    """Sorted keys with their owners, probed in bulk behind a bitmap."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray):
        order = np.lexsort((owners, keys))
        keys, self.owners = keys[order], owners[order]
        self.keys, self.first, self.count = np.unique(keys, return_index=True, return_counts=True)
        self.shift = U64(64 - max(10, min(26, int(len(self.keys)).bit_length() + 4)))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.keys.view(U64) >> self.shift] = True

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` that are known, once per owner, and the owners."""
        at = np.flatnonzero(self.maybe[keys.view(U64) >> self.shift])
        if not len(at) or not len(self.keys):
            return at[:0], self.owners[:0]
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[place] == keys[at]
        at, place = at[hit], place[hit]
        n = self.count[place]
        ends = np.cumsum(n)
        inner = np.arange(int(n.sum())) - np.repeat(ends - n, n)
        return np.repeat(at, n), self.owners[np.repeat(self.first[place], n) + inner]

"""Shared plumbing of the training-data operators.

* ``RepeatFilter`` is a pair of Bloom filters (once seen / twice seen), built by
  hash range on the executors; only the bounded "twice" filter is broadcast.
* ``arrow_map`` runs a batch function over Arrow batches.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweir.storage import materialize, shared_dir, small_batches

__all__ = ["materialize", "shared_dir", "small_batches"]

#: ASCII white space: the six bytes that bytes.split() and bytes.strip() use.
WS = b" \t\n\r\x0b\x0c"
_CONT = bytes(range(0x80, 0xC0))
U64 = np.uint64


def code_points(b: bytes) -> int:
    """Number of code points in UTF-8 bytes."""
    return len(b.translate(None, _CONT))


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; unknown sizes come back as 2**62 at most."""
    stats = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(int(str(stats)), 1 << 62)


def n_shards(df: DataFrame, per_shard: int = 16 << 20, least: int = 8, most: int = 1 << 20) -> int:
    """Hash ranges so that each covers about ``per_shard`` bytes of input (95 MB of 100 TB)."""
    size = size_in_bytes(df)
    if size >= 1 << 50:  # not a table scan: Spark knows no size
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = least
    while n * per_shard < size and n < most:
        n *= 2
    return n


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(pyarrow.RecordBatch iterator) -> RecordBatch iterator`` over each partition."""
    return df.mapInArrow(fn, schema)


def schema_of(fields, ddl: str) -> T.StructType:
    """Fields as they are, and those of a DDL string after them."""
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


def normalized(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``doc_id`` (long), ``text`` (binary, null becomes empty) and ``keep``."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        *keep,
    )


def explode_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start+length) for all pairs."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around by design."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


class Bits:
    """A Bloom filter slice: ``k`` bits of 2**log2 for each 64-bit hash."""

    def __init__(self, log2: int, data: bytes | None = None, k: int = 4):
        self.log2, self.k = log2, k
        self.words = np.zeros(1 << max(0, log2 - 6), U64) if data is None else np.frombuffer(data, U64)

    @staticmethod
    def log2_for(n: int, per_key: int = 16, least: int = 9, most: int = 34) -> int:
        return min(most, max(least, int(np.ceil(np.log2(max(1, n * per_key))))))

    def _positions(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            a, b = mix64(h), mix64(h ^ U64(0x9E3779B97F4A7C15)) | U64(1)
            for i in range(self.k):
                yield (a + U64(i) * b) >> U64(64 - self.log2)

    def add(self, h: np.ndarray) -> None:
        for p in self._positions(h):
            np.bitwise_or.at(self.words, (p >> U64(6)).astype(np.int64), U64(1) << (p & U64(63)))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self._positions(h):
            out &= ((self.words[(p >> U64(6)).astype(np.int64)] >> (p & U64(63))) & U64(1)).astype(bool)
        return out


class RepeatFilter:
    """The bounded "seen twice" filter of all hash ranges, for workers to probe in bulk."""

    def __init__(self, shards: int, slices: dict[int, tuple[int, bytes]], k: int = 4):
        self.bits_of_shard, self.k = shards.bit_length() - 1, k
        self.log2, self.base = np.zeros(shards, np.uint64), np.zeros(shards, np.int64)
        self.words = np.frombuffer(b"".join(slices[s][1] for s in sorted(slices)), U64) if slices else np.zeros(1, U64)
        at = 0
        for s in sorted(slices):
            self.log2[s], self.base[s] = slices[s][0], at
            at += len(slices[s][1]) // 8

    def has(self, h: np.ndarray) -> np.ndarray:
        shard = shard_of(h, self.bits_of_shard)
        log2, base = self.log2[shard], self.base[shard]
        out = log2 > 0
        with np.errstate(over="ignore"):
            a, b = mix64(h), mix64(h ^ U64(0x9E3779B97F4A7C15)) | U64(1)
            for i in range(self.k):
                p = (a + U64(i) * b) >> (U64(64) - np.maximum(log2, U64(1)))
                out &= (self.words[base + np.where(out, p >> U64(6), U64(0)).astype(np.int64)] >> (p & U64(63)) & U64(1)).astype(bool)
        return out


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def trim() -> None:
    """Give freed memory back to the system, as an executor's Python workers share its limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def emit_hashes(h: np.ndarray, bits: int, many: int = 256):
    """One packed row a hash range: the sorted distinct hashes of this task, the ones
    it met twice already, and those it met ``many`` times with their number."""
    if not len(h):
        return
    u, c = np.unique(h, return_counts=True)
    cut = np.searchsorted(shard_of(u, bits), np.arange((1 << bits) + 1))
    rows = []
    for s in np.flatnonzero(np.diff(cut)).tolist():
        k, n = u[cut[s] : cut[s + 1]], c[cut[s] : cut[s + 1]]
        often = n >= many
        rows.append((s, k.tobytes(), k[n > 1].tobytes(), np.stack([k[often], n[often].astype(U64)]).T.tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["shard", "hashes", "twice", "often"])
    trim()


HASH_SCHEMA = "shard int, hashes binary, twice binary, often binary"


def repeat_filter(hashes: DataFrame, shards: int, max_bits: int = 1 << 31, per_key: int = 24, hot: int = 1 << 62, most_hot: int = 1 << 16):
    """Build the once/twice filter pair from packed rows and broadcast the second,
    with the sorted hashes that tasks met often, ``hot`` times in all or more (the
    most frequent ``most_hot / shards`` of a range, one at least).

    Each reducer owns a hash range. It adds each task's hashes to its once-seen
    filter and those already in there (or met twice inside the task) to its
    twice-seen one. A false positive only makes an item suspect; what is
    suspect is confirmed exactly later. ``max_bits`` bounds the broadcast: a
    slice never has more than ``max_bits / shards`` bits, however many keys.
    """
    most = max(9, (max_bits // shards).bit_length() - 1)

    def build(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), U64) for x in table["hashes"]]
        once = Bits(Bits.log2_for(sum(map(len, parts)), 16))
        twice = [np.frombuffer(x.as_py(), U64) for x in table["twice"]]
        for p in parts:
            twice.append(p[once.has(p)])
            once.add(p)
        t = np.unique(np.concatenate(twice))
        out = Bits(Bits.log2_for(len(t), per_key, most=most))
        out.add(t)
        empty = not len(t)
        often = np.concatenate([np.frombuffer(x.as_py(), U64) for x in table["often"]]).reshape(-1, 2)
        k, at = np.unique(often[:, 0], return_inverse=True)
        n = np.bincount(at, often[:, 1].astype(np.float64), len(k))
        best = np.argsort(-n, kind="stable")[: max(1, most_hot // shards)]
        heavy = k[best][n[best] >= hot]
        return pa.table({"shard": pa.array([] if empty else [table["shard"][0].as_py()], pa.int32()), "log2": pa.array([] if empty else [out.log2], pa.int32()), "bits": pa.array([] if empty else [out.words.tobytes()], pa.binary()), "heavy": pa.array([] if empty else [heavy.tobytes()], pa.binary())})

    rows = hashes.groupBy("shard").applyInArrow(build, "shard int, log2 int, bits binary, heavy binary").collect()
    spark = hashes.sparkSession
    found = RepeatFilter(shards, {r.shard: (r.log2, bytes(r.bits)) for r in rows})
    found.hot = np.sort(np.concatenate([np.empty(0, U64), *(np.frombuffer(bytes(r.heavy), U64) for r in rows)]))
    return spark.sparkContext.broadcast(found)


def concat(arrays, dtype=U64) -> np.ndarray:
    arrays = [a for a in arrays if len(a)]
    return np.concatenate(arrays) if arrays else np.empty(0, dtype)


@contextlib.contextmanager
def conf(spark: SparkSession, **settings):
    """Session settings (``__`` stands for a dot) for the time of a block."""
    old = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

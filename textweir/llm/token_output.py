"""Token-id output: binary shards with Elias-Fano document boundaries.

A shard holds the concatenated ids of its documents (16-bit where the
vocabulary allows it, else 32), then two Elias-Fano sequences, the ends of the
documents in the id array and the document ids; sampled select gives any offset
without a 64-bit table. Ids are written as they come and read a block of
documents at a time, between offsets that select returns, so neither side ever
holds a shard. Shards are range partitions of ``doc_id``; each task writes one
file under a name of its attempt, so a retried task leaves no harm, and only
files named in the returned manifest count.

Defined results
---------------
* null or empty text: the end id alone. Texts of any length are encoded whole.
* null ``doc_id``: written before all ids. Rows that share an id follow one
  another, ordered by a hash of the text; rows alike in both spread over shards.
  Extra columns, whatever their names, are ignored. Empty table: no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.llm.bpe import encoder, in_batches
from textweir.llm.common import shared_dir, size_in_bytes, small_batches

MAGIC = b"TXWTOK01"
SAMPLE = 512


class EliasFano:
    """A non-decreasing sequence of n values below 2**63 in about n * (2 + log2(max/n)) bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.l, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, v: np.ndarray) -> EliasFano:
        v = np.asarray(v, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0
        lows = (v & np.uint64((1 << l) - 1))[:, None] >> np.arange(l, dtype=np.uint64) & np.uint64(1) if l else np.zeros((n, 0))
        pos = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> l) + n + 1, np.uint8)
        high[pos] = 1
        return cls(n, l, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), pos[::SAMPLE].astype(np.uint32 if len(high) < 1 << 32 else np.uint64))

    def _low(self, i: int) -> int:
        a = i * self.l
        raw = int.from_bytes(self.low[a >> 3 : (a + self.l + 7) >> 3].tobytes(), "little")
        return raw >> (a & 7) & ((1 << self.l) - 1)

    def select(self, i: int) -> int:
        """Value i: from the nearest sample, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        pos = byte * 8 + (word & -word).bit_length() - 1
        return (pos - i) << self.l | (self._low(i) if self.l else 0)

    def slice(self, a: int, z: int) -> np.ndarray:
        """Values a .. z - 1: selects the first and reads on up to the sample after the last."""
        if a >= z:
            return np.empty(0, np.uint64)
        k = (z - 1) // SAMPLE + 1
        first = int(self.samples[a // SAMPLE])
        stop = int(self.samples[k]) + 1 if k < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first >> 3 : (stop + 7) >> 3], bitorder="little")
        pos = np.flatnonzero(bits[first & 7 :])[a % SAMPLE : a % SAMPLE + z - a] + first
        v = (pos - np.arange(a, z)).astype(np.uint64) << np.uint64(self.l)
        if self.l:
            lo = a * self.l
            bits = np.unpackbits(self.low[lo >> 3 : (z * self.l + 7) >> 3], bitorder="little")[lo & 7 :]
            bits = bits[: (z - a) * self.l].reshape(z - a, self.l).astype(np.uint64)
            v |= (bits << np.arange(self.l, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return v

    def decode(self) -> np.ndarray:
        return self.slice(0, self.n)

    def dump(self) -> bytes:
        wide = self.samples.dtype.itemsize
        return struct.pack("<QBB6xQQQ", self.n, self.l, wide, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, b: memoryview, at: int) -> tuple[EliasFano, int]:
        n, l, wide, a, h, s = struct.unpack_from("<QBB6xQQQ", b, at)
        at += 40
        low, high = np.frombuffer(b, np.uint8, a, at), np.frombuffer(b, np.uint8, h, at + a)
        samples = np.frombuffer(b[at + a + h : at + a + h + s * wide], np.uint32 if wide == 4 else np.uint64)
        return cls(n, l, low, high, samples), at + a + h + s * wide


class ShardWriter:
    """Appends ids to a stream; ``close`` writes the boundaries and a footer behind them. Ids of documents ascend, nulls first."""

    def __init__(self, f, wide: int):
        self.f, self.wide, self.n_ids, self.doc_ids, self.lengths = f, wide, 0, [], []
        f.write(MAGIC)

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lengths.append(lengths)
        self.n_ids += len(ids)
        self.f.write(ids.astype(f"<u{self.wide}").tobytes())

    def close(self) -> None:
        nulls = sum(d is None for d in self.doc_ids)
        known = np.array(self.doc_ids[nulls:], np.int64)
        base = int(known[0]) if len(known) else 0
        ends = np.cumsum(np.concatenate(self.lengths)) if self.lengths else np.empty(0, np.int64)
        self.f.write(EliasFano.encode(ends).dump() + EliasFano.encode(known - base).dump())
        self.f.write(struct.pack("<QQQqQ", len(self.doc_ids), self.n_ids, nulls, base, self.wide) + MAGIC)


class Shard:
    """A shard read back through a random-access file: boundaries at once, ids where asked."""

    FOOTER = 48

    def __init__(self, f):
        self.f, size = f, f.size()
        f.seek(max(0, size - self.FOOTER))
        tail = f.read(self.FOOTER)
        if len(tail) < self.FOOTER or tail[40:] != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.n_ids, self.nulls, self.base, self.wide = struct.unpack_from("<QQQqQ", tail)
        f.seek(len(MAGIC) + self.n_ids * self.wide)
        b = memoryview(f.read(size - self.FOOTER - f.tell()))
        self.ends, at = EliasFano.load(b, 0)
        self.docs, _ = EliasFano.load(b, at)

    def span(self, i: int) -> tuple[int, int]:
        """Where document i's ids start and end."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, start: int, stop: int) -> np.ndarray:
        self.f.seek(len(MAGIC) + start * self.wide)
        return np.frombuffer(self.f.read((stop - start) * self.wide), f"<u{self.wide}").astype("<u4")

    def blocks(self, docs: int = 4096, most: int = 1 << 22):
        """(document ids, starts, ends, ids) of a few documents at a time; more than ``most`` ids only for a single one."""
        a = 0
        while a < self.n:
            z, start = min(self.n, a + docs), self.span(a)[0]
            while z > a + 1 and self.span(z - 1)[1] - start > most:
                z = a + (z - a) // 2
            ends = self.ends.slice(a, z).astype(np.int64)
            k = max(0, min(z, self.nulls) - a)
            known = self.docs.slice(a + k - self.nulls, z - self.nulls).astype(np.int64) + self.base if a + k < z else np.empty(0, np.int64)
            yield [None] * k + known.tolist(), np.concatenate([[start], ends[:-1]]), ends, self.ids(start, int(ends[-1]))
            a = z


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 0, per_shard: int = 8 << 20) -> list[dict]:
    """Write the shards and return their manifest in document order: path, n_docs, n_ids, first."""
    spark = docs.sparkSession
    out = out or shared_dir(spark)
    small_batches(docs.sparkSession)
    size = size_in_bytes(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 17, size // per_shard) if size < 1 << 50 else 1)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    base = base.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    base = base.repartitionByRange(n, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie")

    def write(batches):
        enc = encoder(tokenizer, end_id)
        wide = 2 if enc.tok.get_vocab_size() <= 1 << 16 else 4
        out_file = None
        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i, j in in_batches(texts):
                if out_file is None:
                    ctx = TaskContext.get()
                    fs, root = _filesystem(out)
                    fs.create_dir(root, recursive=True)
                    name = f"part-{ctx.partitionId():07d}-{ctx.taskAttemptId()}.twt"
                    f = fs.open_output_stream(f"{root}/{name}")
                    out_file = ShardWriter(f, wide)
                ids, lengths = enc.encode(texts[i:j])
                out_file.add(doc_ids[i:j], lengths, ids)
        if out_file is None:
            return
        out_file.close()
        f.close()
        yield pa.RecordBatch.from_pydict({"part": [ctx.partitionId()], "path": [name], "n_docs": [len(out_file.doc_ids)], "n_ids": [out_file.n_ids]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = base.select("doc_id", "text").mapInArrow(write, "part int, path string, n_docs long, n_ids long").collect()
    manifest, first = [], 0
    for r in sorted(rows, key=lambda r: r.part):
        manifest.append({"path": f"{out}/{r.path}", "n_docs": r.n_docs, "n_ids": r.n_ids, "first": first})
        first += r.n_ids
    return manifest


def read_tokens(spark, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, read from the shards."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(m["path"], m["first"]) for m in manifest], "path string, first long")

    def read(batches):
        for b in batches:
            for uri, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist()):
                fs, path = _filesystem(uri)
                with fs.open_input_file(path) as f:
                    for doc_ids, starts, ends, ids in Shard(f).blocks():
                        at = starts - starts[0]
                        stop = ends - starts[0]
                        crc = [zlib.crc32(ids[a:z]) for a, z in zip(at.tolist(), stop.tolist())]
                        cols = [pa.array(doc_ids, pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, stop[-1]), pa.int32()), pa.array(ids.astype(np.int64))))
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return files.repartition(len(manifest)).mapInArrow(read, schema)


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(spark, write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))

"""MinHash signatures, the near tier, and the near-duplicate signal.

Signatures are made by one Arrow function (vectorised over the shingles of many texts).
Bands meet by an equi-join; buckets outside 2..``BUCKET`` records are left out, as
the signal defines. The result is one row per record, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweir.functions.rolling import fnv
from textweir.storage import materialize, small_batches

HASHES, BAND_ROWS, SHINGLE, MOST_SHINGLES, DUPLICATE, BUCKET = 64, 4, 5, 400, 0.7, 200
NEAR = 0.55
_U32 = np.uint64(0xFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    """HASHES rows of mixed values."""
    seeds = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B1)) & _U32
    x = h[None, :] ^ seeds[:, None]
    x = ((x ^ x >> np.uint64(16)) * np.uint64(0x21F0AAAD)) & _U32
    x = ((x ^ x >> np.uint64(15)) * np.uint64(0x735A2D97)) & _U32
    return x ^ x >> np.uint64(15)


_WORD = regex.compile(r"[\p{L}\p{N}']+")


def signature_rows(texts: list[str], most_units: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts that have a token, and their signatures (rows of HASHES)."""
    places, parts, held, size = [], [], [], 0

    def flush():
        units = np.frombuffer("".join(x for x, _, _ in held).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
        sizes = np.array([u for _, u, _ in held])
        base = np.cumsum(sizes) - sizes
        starts = np.concatenate([b + s[:, 0] for b, (_, _, s) in zip(base, held)])
        lens = np.concatenate([s[:, 1] for _, _, s in held])
        h = _mixed(fnv(units, starts, lens))
        n = np.array([len(s) for _, _, s in held])
        parts.append(np.minimum.reduceat(h, np.cumsum(n) - n, axis=1).T)
        held.clear()

    for i, t in enumerate(texts):
        tokens = _WORD.findall((t or "").lower())
        if not tokens:
            continue
        joined = " ".join(tokens)
        units = np.fromiter(map(len, tokens), np.int64, len(tokens))
        if not joined.isascii():
            units = np.fromiter((len(x) + sum(c > "\uffff" for c in x) for x in tokens), np.int64, len(tokens))
        ends = np.cumsum(units + 1) - 1
        starts = ends - units
        n = max(1, len(tokens) - SHINGLE + 1)
        pick = np.arange(n)
        if n > MOST_SHINGLES:  # evenly spread; the step is added up, as its rounding decides the places
            steps = np.cumsum(np.concatenate([[0.0], np.full(MOST_SHINGLES, n / MOST_SHINGLES)]))
            pick = steps[steps < n].astype(np.int64)
        last = np.minimum(pick + SHINGLE - 1, len(tokens) - 1)
        places.append(i)
        held.append((joined, int(ends[-1]), np.stack([starts[pick], ends[last] - starts[pick]], axis=1)))
        size += int(ends[-1])
        if size >= most_units or len(held) >= 64:
            flush()
            size = 0
    if held:
        flush()
    return np.array(places, np.int64), (np.concatenate(parts) if parts else np.empty((0, HASHES), np.uint64)).astype(np.int64)


def signature(text: str) -> list[int] | None:
    rows = signature_rows([text])[1]
    return rows[0].tolist() if len(rows) else None


def _batches(column: pa.Array, rows: int = 256):
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows).to_pylist()


def signatures(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sig (array of 64; records without a token are left out)."""
    small_batches(records.sparkSession)

    def run(batches):
        for b in batches:
            for at, texts in _batches(b.column(1)):
                place, sig = signature_rows(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place + at)), pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * HASHES, pa.int32()), pa.array(sig.ravel()))], [key, "sig"])

    return records.select(key, "text").mapInArrow(run, T.StructType([records.schema[key], *T.StructType.fromDDL("sig array<long>").fields]))


def estimate(a, b):
    """Share of equal positions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(HASHES)


def near_duplicate_records(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_near (partners at the threshold), nearest: one row per record with a signature."""
    sig = materialize(signatures(records, key))
    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND_ROWS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * BAND_ROWS + 1, BAND_ROWS)))
    rows = sig.select(key, F.posexplode(bands).alias("band", "bucket"))
    sizes = rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter(F.col("n").between(2, BUCKET)).drop("n")
    rows = rows.join(sizes, ["band", "bucket"], "left_semi")  # nothing over BUCKET meets itself
    a = rows.select("band", "bucket", F.col(key).alias("a"))
    b = rows.select("band", "bucket", F.col(key).alias("b"))
    pairs = a.join(b, ["band", "bucket"]).filter("a < b").select("a", "b").distinct()
    s = sig.select(F.col(key).alias("k"), "sig")
    pairs = pairs.join(s.select(F.col("k").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("k").alias("b"), F.col("sig").alias("sb")), "b")
    close = pairs.withColumn("e", estimate(F.col("sa"), F.col("sb"))).filter(F.col("e") >= DUPLICATE).select("a", "b")
    both = close.union(close.select("b", "a")).groupBy(F.col("a").alias("k")).agg(F.count("*").alias("n_near"), F.min("b").alias("nearest"))
    return sig.select(key).join(both, F.col(key) == F.col("k"), "left").select(key, F.coalesce("n_near", F.lit(0)).alias("n_near"), "nearest")


class _Items:
    """Item signatures with an index that misses none at the threshold: of HASHES places a
    match agrees on ``least``, so on one of any HASHES - least + 1."""

    def __init__(self, ids: list, sigs: np.ndarray, threshold: float):
        self.ids, self.sigs = ids, sigs
        self.least = max(1, int(np.ceil(threshold * HASHES - 1e-9)))
        self.order = [np.argsort(sigs[:, p], kind="stable") for p in range(HASHES - self.least + 1)]
        self.values = [sigs[o, p] for p, o in enumerate(self.order)]

    def matches(self, sigs: np.ndarray):
        """(row, item, equal places) of all pairs at the threshold, in order."""
        found = []
        for p, (values, order) in enumerate(zip(self.values, self.order)):
            lo, hi = np.searchsorted(values, sigs[:, p]), np.searchsorted(values, sigs[:, p], side="right")
            n = hi - lo
            if n.any():
                ends = np.cumsum(n)
                inner = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
                found.append(np.repeat(np.arange(len(sigs)), n) * len(self.ids) + order[np.repeat(lo, n) + inner])
        row, item = np.divmod(np.unique(np.concatenate(found)) if found else np.empty(0, np.int64), max(1, len(self.ids)))
        equal = (sigs[row] == self.sigs[item]).sum(axis=1)
        ok = equal >= self.least
        return row[ok], item[ok], equal[ok]


def near_tier(docs: DataFrame, items: DataFrame, exact_runs: DataFrame, threshold: float = NEAR, item_block: int = 100_000) -> DataFrame:
    """Documents without a run that could survive at arrival, against all item signatures.

    doc_id, item_id, score at the threshold or over, sample (240 characters). Items
    are taken in blocks, each broadcast as signatures of 512 bytes; every pair at the
    threshold is found, as with a comparison of all.
    """
    spark = docs.sparkSession
    open_runs = exact_runs.filter("early_rare or truncated").select("doc_id").distinct()
    gated = docs.select("doc_id", "text").join(open_runs, "doc_id", "left_anti")
    small_batches(spark)
    sig = signatures(items, "item_id").withColumn("block", F.floor((F.row_number().over(Window.orderBy("item_id")) - 1) / item_block).cast("int")).cache()
    schema = T.StructType([docs.schema["doc_id"], items.schema["item_id"], *T.StructType.fromDDL("score double, sample string").fields])
    out = None
    for block in range(-(-sig.count() // item_block)):
        t = sig.filter(F.col("block") == block).select("item_id", "sig").toArrow().combine_chunks()
        flat = t["sig"].combine_chunks().values.to_numpy().reshape(-1, HASHES)
        shared = spark.sparkContext.broadcast((t["item_id"].combine_chunks(), _Items(range(len(flat)), flat, threshold)))

        def compare(batches, shared=shared):
            ids, known = shared.value
            for b in batches:
                for at, texts in _batches(b.column("text")):
                    place, sigs = signature_rows(texts)
                    row, item, equal = known.matches(sigs)
                    here = place[row]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(here + at)), ids.take(pa.array(item)), pa.array(equal / HASHES), pa.array([texts[i][:240] for i in here.tolist()], pa.string())], ["doc_id", "item_id", "score", "sample"])

        got = gated.mapInArrow(compare, schema)
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out

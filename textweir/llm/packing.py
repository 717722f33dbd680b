"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to
groups, each group packs its own by best-fit decreasing, and dual-feasible
functions give a lower bound on the bins it needs. Groups whose count equals
their bound are certified; the others (and, where those
hold too few bins for the distance to the bound of all pieces, the certified ones too) give up the
documents of their unfilled bins, which are dealt again to fewer, larger groups
(never over ``most_group`` pieces) and packed anew. A new packing counts only where it needs fewer bins.

Defined results
---------------
* null or empty text: one piece that is the end id.
* null ids and repeated rows: each row is packed by itself.
* ties in length: any order; the number of sequences doesn't depend on it.
* texts of any length are encoded whole and cut only where they exceed ``capacity``.
* empty table: no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.llm.bpe import encoder, in_batches
from textweir.llm.common import materialize, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the first piece takes what is left over."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches):
        enc = encoder(tokenizer, end_id)
        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i, j in in_batches(texts):
                ids, n = enc.encode(texts[i:j])
                ids, at, rows = ids.astype("<u4"), 0, []
                for d, size in zip(doc_ids[i:j], n.tolist()):
                    a, stop = 0, (size - 1) % capacity + 1
                    k = 0
                    while a < size:
                        part = ids[at + a : at + stop]
                        rows.append((d, k, a, stop - a, zlib.crc32(part), *([part] * with_ids)))
                        a, stop, k = stop, stop + capacity, k + 1
                    at += size
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return base.mapInArrow(cut, PIECES + ", ids array<long>" * with_ids)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that pieces with ``counts[length]`` need at least, by dual-feasible functions.

    Identity; u_eps (long ones count whole, short ones not at all) for every
    eps; and the rounding functions u_k for k up to 20. All in integers.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    n, mass = counts.astype(np.int64), counts.astype(np.int64) * x
    best = -(-int(mass.sum()) // capacity)
    upto, weight = np.cumsum(n), np.cumsum(mass)
    for eps in range(1, capacity // 2 + 1):
        whole = int(upto[-1] - upto[capacity - eps])
        between = int(weight[capacity - eps] - weight[eps - 1])
        best = max(best, whole - (-between // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int):
    """Bin and offset of each piece, and the fill of each bin."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        m = mask >> size
        if m:
            r = size + (m & -m).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = r - size
        if left:
            if not room[left]:
                mask |= 1 << left
            room[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, loose int"


def _pack_groups(pieces: DataFrame, groups: int, capacity: int, tag: int) -> DataFrame:
    """Pack each group; loose is 0 in full bins, 1 in others of a certified group, 2 in those of one with a gap."""

    def pack(t: pa.Table) -> pa.Table:
        lengths = t["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        certified = len(fill) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        loose = np.where(fill < capacity, 1 if certified else 2, 0)
        g = int(t["g"][0].as_py())
        ids = ((np.int64(g) << np.int64(24)) + bins) * 16 + tag  # a group has fewer than 2**24 bins
        t = t.drop_columns(["g"])
        return t.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).append_column("loose", pa.array(loose[bins], pa.int32()))

    dealt = pieces.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(pack, _PACKED)


def _bins(df: DataFrame) -> int:
    """Every sequence has exactly one piece at offset 0."""
    return df.filter("offset = 0").count()


def pack(pieces: DataFrame, capacity: int = 2048, per_group: int = 1 << 18, max_rounds: int = 8, most_group: int = 1 << 22) -> DataFrame:
    """Add sequence_id and offset to pieces (columns of ``PIECES``)."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == capacity).select(*cols, (F.monotonically_increasing_id() * 16 + 15).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).select(*cols)
    hist = {r.length: r.n for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in hist.items():
        counts[k] = n
    left, bound = int(counts.sum()), lower_bound(counts, capacity)
    done, closed, pool = [full], 0, rest
    before, before_bins, last = None, 0, 0  # the pool as it is packed now, and in how many groups
    for step in range(max_rounds):
        size = min(most_group, per_group * 4**step)
        groups = max(1, -(-left // size))
        if not left or step and groups >= last:
            break
        last = groups
        new = materialize(_pack_groups(pool, groups, capacity, step))
        n_new = _bins(new)
        if before is not None and n_new >= before_bins:
            continue  # the packing there is stays; fewer groups may do better
        # With gaps alone to blame, only they exchange; else every unfilled bin does.
        gaps = new.filter("loose = 2")
        least = 2 if closed + n_new - bound <= _bins(gaps) // 4 else 1
        loose = new.filter(F.col("loose") >= least)
        done.append(new.filter(F.col("loose") < least).drop("loose"))
        before, before_bins = loose, _bins(loose)
        closed += n_new - before_bins
        if closed + before_bins <= bound:
            break
        left = loose.count()
        pool = loose.select(*cols)
    if before is not None:
        done.append(before.drop("loose"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(materialize(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))))

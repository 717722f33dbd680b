"""SimHash near-duplicates with bit-sliced comparison.

Distinct 64-bit fingerprints (copies are counted, not compared) are cut into
``blocks`` bit fields. Two that differ in at most ``radius`` bits agree on at
least ``blocks - radius`` fields, so they meet in the bucket of some choice of
that many fields; a pair counts only in the first such choice, so nothing has to
be made distinct. ``blocks`` grows with the number of fingerprints only when buckets
would hold more than ``target`` on average (as comparing is cheap beside shuffling:
5 copies of a fingerprint up to 1.5e7 of them, 15 up to 5e9, 35 up to 3e11). Inside a
bucket the fingerprints lie as 64 vertical bit planes; a block of queries adds
the differences plane by plane into carry-save counters and stops as soon as all
its pairs are over the radius. A bucket over ``max_block`` members is spread
over tasks as pairs of member blocks; each task returns a count of neighbours
and a spanning forest of its links per fingerprint, never the pairs.

Defined results
---------------
* null, empty or white-space text: fingerprint zero, linked like any other.
* fewer words than a shingle: the whole word sequence is the one shingle.
* null ``doc_id``: a row like any other; it never becomes a component id unless
  all ids of the component are null (then null). Repeated rows count as rows.
* ties: of a component's documents the smallest id is its id. Texts of any length
  are fingerprinted whole.
* empty table: no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.llm.common import U64, materialize, normalized

ALL = U64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    n = len(h)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):  # bit b of byte k of a little-endian word is bit 8k + b
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return normalized(docs).mapInArrow(run, "doc_id long, fp long")


def fields(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each bit field."""
    cut = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of bit planes, 64 fingerprints a word."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T  # 64 x n
    out = np.zeros((64, -(-n // 64) * 64), np.uint8)
    out[:, :n] = bits
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def close_pairs(queries: np.ndarray, members: np.ndarray, radius: int):
    """Index pairs (q, m) at most ``radius`` bits apart; yields them by block of queries."""
    vertical = planes(members)
    words = vertical.shape[1]
    step = max(1, (1 << 16) // words)
    levels = (radius + 1).bit_length()
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        over = np.zeros((len(q), words), np.uint64)
        counter = [np.zeros((len(q), words), np.uint64) for _ in range(levels)]
        live = True
        for p in range(64):
            mask = (np.uint64(0) - ((q >> U64(p)) & U64(1)))[:, None]
            carry = vertical[p][None, :] ^ mask
            for c in counter:  # carry-save: add one bit to each lane's counter
                c ^= carry
                carry &= ~c
            over |= carry
            if p & 3 == 3 and p > radius:
                over |= _beyond(counter, radius)
                if (over == ALL).all():
                    live = False
                    break
        if not live:
            continue
        near = ~(over | _beyond(counter, radius))
        hit = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little", count=len(members))
        i, j = np.nonzero(hit)
        if len(i):
            yield i + at, j


def _beyond(counter, radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    gt, eq = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            eq &= counter[k]
        else:
            gt |= eq & counter[k]
            eq &= ~counter[k]
    return gt


def _field_equal(x: np.ndarray, blocks: int) -> np.ndarray:
    """Which fields of the differences are zero: one row a field."""
    return np.array([(x >> U64(s)) & U64((1 << w) - 1) == 0 for s, w in fields(blocks)])


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, i: int) -> int:
        p = self.p
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.p[max(a, b)] = min(a, b)


def links(distinct: DataFrame, radius: int = 4, max_block: int = 1 << 14, target: int = 2048) -> DataFrame:
    """fp, n (rows at other fingerprints within the radius), root (a linked fingerprint, or fp).

    ``distinct`` has fp and copies. A fingerprint may come back several times.
    """
    total = distinct.count()
    blocks = radius + 1
    while blocks < radius + 5 and total >> (64 * (blocks - radius) // blocks) > target:
        blocks += 1
    need = blocks - radius
    choices = list(combinations(range(blocks), need))
    span = fields(blocks)

    def key_of(choice):
        out = F.lit(0).cast("long")
        for f in choice:
            s, w = span[f]
            out = F.shiftleft(out, w).bitwiseOR(F.shiftrightunsigned(F.col("fp"), s).bitwiseAND(F.lit((1 << w) - 1)))
        return out

    spread = distinct.select("fp", "copies", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), key_of(c).alias("key")) for i, c in enumerate(choices)])).alias("b")).select("fp", "copies", "b.choice", "b.key")
    # Buckets too large for one task: there are at most len(choices) * total / max_block of them.
    hot = spread.groupBy("choice", "key").count().filter(F.col("count") > max_block).withColumn("parts", F.ceil(F.col("count") / max_block).cast("int")).select("choice", "key", "parts")
    # A member's block is a hash of it; it goes to every pair of blocks that has its own, as query (side 0), member (1) or both (2).
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, part).alias("i"), F.greatest(o, part).alias("j"), F.when(o == part, 2).when(part < o, 0).otherwise(1).alias("side")))
    dealt = spread.join(hot, ["choice", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).select("fp", "copies", "choice", "key", F.explode(pairs).alias("p")).select("fp", "copies", "choice", "key", "p.i", "p.j", "p.side")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j")
    choice_array = np.array(choices)

    def compare(fp, copies, choice, group, side):
        """Pairs of one or several whole buckets (rows are sorted by group)."""
        weight = np.zeros(len(fp), np.int64)
        forest = _Forest(len(fp))
        for i, j in close_pairs(fp, fp, radius):
            ok = (i < j) & (group[i] == group[j]) & ((side[i] == 2) & (side[j] == 2) | (side[i] + side[j] == 1))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            equal = _field_equal(fp[i] ^ fp[j], blocks)
            first = np.cumsum(equal, axis=0) <= need
            mine = np.zeros_like(equal)
            mine[choice_array[choice[i]].T, np.arange(len(i))] = True
            ok = ((equal & first) == mine).all(axis=0)
            i, j = i[ok], j[ok]
            np.add.at(weight, i, copies[j])
            np.add.at(weight, j, copies[i])
            for a, b in zip(i.tolist(), j.tolist()):
                forest.join(a, b)
        got = np.flatnonzero(weight)
        root = np.array([forest.find(k) for k in got.tolist()], np.int64)
        return fp[got], weight[got], fp[root] if len(root) else fp[:0]

    def run(batches):
        """Whole buckets are compared together until they fill the lanes of a word block."""
        held: list[np.ndarray] = []
        size = 0

        def flush(rows):
            keys = rows[:, 2:6]
            group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            fp, w, root = compare(rows[:, 0].copy().view(np.uint64), rows[:, 1], rows[:, 2], group, rows[:, 6])
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(w), pa.array(root.view(np.int64))], ["fp", "n", "root"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(7)], axis=1)
            rows = np.concatenate([*held, rows]) if held else rows
            keys = rows[:, 2:6]
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            at = 0
            for e in ends.tolist():
                if e - at >= 256:
                    yield flush(rows[at:e])
                    at = e
            held = [rows[at:]]
        if held and len(held[0]):
            yield flush(held[0])

    return dealt.select("fp", "copies", F.col("choice").cast("long"), "key", F.col("i").cast("long"), F.col("j").cast("long"), F.col("side").cast("long")).mapInArrow(run, "fp long, n long, root long")


def components(edges: DataFrame, max_local: int = 2_000_000) -> DataFrame:
    """node, root (the least node reachable by signed value) for the nodes of ``edges`` (u, v).

    Up to ``max_local`` edges (16 bytes each) are joined on the driver; more by
    large-star / small-star rounds, each a materialised table.
    """
    spark = edges.sparkSession
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    count = edges.count()
    if count <= max_local:
        if not count:
            return spark.createDataFrame([], "node long, root long")
        t = edges.toArrow()
        u, v = t["u"].to_numpy(), t["v"].to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = _Forest(len(nodes))
        for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
            forest.join(a, b)
        root = nodes[np.array([forest.find(i) for i in range(len(nodes))], np.int64)]
        return spark.createDataFrame(pa.table({"node": nodes, "root": root}))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v")))
        new = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, radius: int = 4, max_block: int = 1 << 14, max_local: int = 2_000_000) -> DataFrame:
    """doc_id, fingerprint, n_near, component_id of each row."""
    fps = materialize(fingerprints(docs, shingle, seed))
    distinct = materialize(fps.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")))
    whole, near = _grouped(distinct, radius, max_block, max_local)
    ids = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    table = materialize(whole.join(ids, "root").join(near, "fp", "left").select("fp", "copies", F.coalesce("n", F.lit(0)).alias("n"), "component_id"))
    # Fingerprints of over 0.1 % of the rows, so fewer than 1,000, join by broadcast; no other is a hot key.
    total = table.agg(F.sum("copies")).collect()[0][0] or 0
    often = F.col("copies") > max(1000, total // 1000)
    hot = table.filter(often)
    out = fps.join(F.broadcast(hot), "fp").unionByName(fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(table.filter(~often), "fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), (F.col("n") + F.col("copies") - 1).alias("n_near"), "component_id")


def _grouped(distinct: DataFrame, radius: int, max_block: int, max_local: int):
    """``distinct`` with the root of each fingerprint's component, and each one's neighbours."""
    found = materialize(links(distinct.select("fp", "copies"), radius, max_block))
    comp = components(found.select(F.col("fp").alias("u"), F.col("root").alias("v")), max_local)
    whole = distinct.join(comp, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    return whole, found.groupBy("fp").agg(F.sum("n").alias("n"))


def keep_one(docs: DataFrame, shingle: int = 4, seed: int = 42, radius: int = 4, max_block: int = 1 << 14, max_local: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` (a table: scans must agree on row order) that stay: the
    one with the smallest doc_id of each component, of repeated ids the first row."""
    row = F.monotonically_increasing_id()
    marked = docs.withColumn("row__", row)
    fps = materialize(fingerprints(marked.select(F.col("row__").alias("doc_id"), "text"), shingle, seed).withColumnRenamed("doc_id", "row__"))
    fps = fps.join(marked.select("row__", F.col("doc_id").cast("long").alias("id__")), "row__")
    rank = F.struct(F.col("id__").isNull().alias("a"), F.coalesce("id__", F.lit(0)).alias("b"), F.col("row__").alias("c"))
    distinct = materialize(fps.groupBy("fp").agg(F.count("*").alias("copies"), F.min(rank).alias("least")))
    whole, _ = _grouped(distinct, radius, max_block, max_local)
    stay = whole.groupBy("root").agg(F.min("least").alias("m")).select(F.col("m.c").alias("row__"))
    return marked.join(stay, "row__", "left_semi").drop("row__")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

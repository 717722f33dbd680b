"""Benchmark decontamination by latent semantic retrieval.

1. Every passage of the corpus (blocks of ``window`` words) is a TF-IDF row over
   the benchmark's terms, whose number the benchmark bounds. One pass over all
   texts sums document frequencies and the sketch C'C Omega of a randomised SVD;
   the driver finishes the decomposition from that (single-pass Nystroem form).
   The benchmark's own passages are rows too, weighted so that together they
   count as much as the corpus.
2. Overlapping passages of every text are candidates for an item unless their
   words rule it out: of an item's n words at least ``need`` are matched, so of
   its ``n - need + k`` rarest ones at least k, each by a word of its own in the
   text. Passages with fewer are left out, and nothing else is: every pair that
   step 3 can accept gets there, whatever the number of items and axes.
3. Each candidate is checked on the passage with half a passage around it: the
   longest common subsequence with the item must cover ``min_lcs`` of it, and
   below ``sure_lcs`` the item's answer (its last quarter, at least three words)
   must be there in half too. Passages have ``window`` words and double until
   an item has at most 5/4 of that, so the checked words hold it whole.
4. Accepted passages are projected; their latent cosine with the item ranks them.

Items are taken in blocks of at most ``item_block`` items and ``block_words``
words (a longer item is a block of its own), so any number works, the driver holds
one block at a time, and no broadcast outgrows ``block_words`` x ``rank`` floats.
The tasks' sketches are summed by a tree of ``fan`` branches.

Defined results
---------------
* null or empty texts and items match nothing; items of fewer than ``min_words``
  words match where all their words follow each other in the text.
* null and repeated document ids, and item ids of any type, nulls too: a row a
  matched item for each row.
* texts and items of any length are searched whole.
* of several passages, the one with the greatest subsequence, then cosine, then
  the first, is returned. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textweir.llm.common import explode_ranges, normalized

_TABLE = bytes(32 if 33 <= b < 48 and b != 39 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 else b + 32 if 65 <= b < 91 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; ASCII punctuation but the apostrophe separates."""
    return text.translate(_TABLE).split()


class Item:
    """An item ready for the subsequence check."""

    def __init__(self, item_id, words: list[bytes]):
        self.id, self.words, self.n = item_id, words, len(words)
        self.masks: dict[bytes, int] = {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.answer = max(3, self.n // 4)

    def inside(self, words) -> bool:
        """Whether the item's words follow each other somewhere."""
        return any(words[i : i + self.n] == self.words for i in range(len(words) - self.n + 1))

    def lcs(self, words) -> tuple[int, int]:
        """Longest common subsequence with the item, and with its answer alone (bit-parallel)."""
        whole = v = (1 << self.n) - 1
        tail = a = (1 << min(self.n, self.answer)) - 1
        shift = max(0, self.n - self.answer)
        get = self.masks.get
        for w in words:
            m = get(w)
            if m:
                u = v & m
                v = (v + u | v - u) & whole
                m >>= shift
                if m:
                    u = a & m
                    a = (a + u | a - u) & tail
        return self.n - v.bit_count(), min(self.n, self.answer) - a.bit_count()


def _word_batches(texts, vocabulary: dict, limit: int = 1 << 19):
    """(first text, words of each, term numbers of all with -1 for others, lens)."""
    held, size, at = [], 0, 0
    get = vocabulary.get
    for i, t in enumerate(texts):
        held.append(words_of(t))
        size += len(t)
        if size >= limit or i == len(texts) - 1:
            lens = np.fromiter(map(len, held), np.int64, len(held))
            ids = np.fromiter(map(get, chain.from_iterable(held), repeat(-1)), np.int64, int(lens.sum()))
            yield at, held, ids, lens
            at, held, size = i + 1, [], 0


def _random(terms: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((terms, width)).astype(np.float32)


class _Sums:
    """Passages, document frequencies and the sketch of one task."""

    def __init__(self, omega: np.ndarray):
        self.omega, self.n, self.df, self.sketch = omega, 0, np.zeros(len(omega), np.int64), np.zeros(omega.shape, np.float32)

    def add(self, ids: np.ndarray, block: np.ndarray, n_blocks: int) -> None:
        self.n += n_blocks
        known = ids >= 0
        t, b = ids[known], block[known]
        if not len(t):
            return
        y = np.zeros((n_blocks, self.omega.shape[1]), np.float32)
        _add_rows(y, b, self.omega, t)
        order = np.argsort(t.astype(np.uint16) if len(self.omega) <= 1 << 16 else t, kind="stable")
        t, b = t[order], b[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (b[1:] != b[:-1])])
        self.df += np.bincount(t[new], minlength=len(self.omega))
        _add_rows(self.sketch, t, y, b)


def _add_rows(out: np.ndarray, to: np.ndarray, table: np.ndarray, rows: np.ndarray, chunk: int = 2048) -> None:
    """Add ``table[rows]`` to the rows ``to`` (ascending) of ``out``, in pieces that stay in the cache."""
    for i in range(0, len(to), chunk):
        k = to[i : i + chunk]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out[k[first]] += np.add.reduceat(table[rows[i : i + chunk]], first)


def fit(docs: DataFrame, items: list[Item], window: int, rank: int, seed: int = 7, extra: int = 10, fan: int = 64):
    """Term numbers, document frequencies, inverse document frequencies and the latent axes (terms x rank)."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for it in items for w in it.words}))}
    terms, width, chunk = len(vocabulary), rank + extra, 1024
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # the benchmark's terms only

    def run(batches):
        sums = _Sums(_random(terms, width, seed))
        for b in batches:
            for _, _, ids, lens in _word_batches([t.as_py() for t in b.column(0)], shared.value):
                blocks = -(-lens // window)
                base = np.cumsum(blocks) - blocks
                block = np.repeat(base, lens) + explode_ranges(np.zeros(len(lens), np.int64), lens) // window
                sums.add(ids, block, int(blocks.sum()))
        task = TaskContext.get().partitionId()
        for k in range(0, terms, chunk):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([k], [task], [sums.n], [sums.df[k : k + chunk].tobytes()], [sums.sketch[k : k + chunk].tobytes()]), kinds)], names)

    names, kinds = ["chunk", "branch", "n", "df", "sketch"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def total(t: pa.Table) -> pa.Table:
        df = sum(np.frombuffer(x.as_py(), np.int64) for x in t["df"])
        wide = {4: np.float32, 8: np.float64}[len(t["sketch"][0].as_py()) // (len(df) * width)]  # tasks send single precision
        sketch = sum(np.frombuffer(x.as_py(), wide).astype(np.float64) for x in t["sketch"])
        return pa.table([pa.array(x, k) for x, k in zip(([t["chunk"][0].as_py()], [t["branch"][0].as_py() // fan], [sum(t["n"].to_pylist())], [df.tobytes()], [sketch.tobytes()]), kinds)], names)

    schema = "chunk int, branch int, n long, df binary, sketch binary"
    sums = docs.select("text").mapInArrow(run, schema)
    left = docs.rdd.getNumPartitions()
    while left > 1:
        sums = sums.groupBy("chunk", F.floor(F.col("branch") / fan).alias("b")).applyInArrow(total, schema)
        left = -(-left // fan)
    rows = sorted(sums.collect(), key=lambda r: r.chunk)
    omega = _random(terms, width, seed)
    n = rows[0].n if rows else 0
    df = np.concatenate([np.frombuffer(r.df, np.int64) for r in rows]) if rows else np.zeros(terms, np.int64)
    sketch = np.concatenate([np.frombuffer(r.sketch, np.float64 if len(r.sketch) == len(r.df) * width else np.float32) for r in rows]).reshape(terms, width).astype(np.float64) if rows else np.zeros((terms, width))
    own = _Sums(omega)
    for i in range(0, len(items), 1024):
        part = items[i : i + 1024]
        own.add(np.array([vocabulary[w] for it in part for w in it.words]), np.repeat(np.arange(len(part)), [it.n for it in part]), len(part))
    idf = np.log((n + 1) / (df + 1)) + 1
    sketch = idf[:, None] * (sketch + own.sketch * max(1, n / len(items)))  # A'A (D^-1 Omega)
    b = (omega / idf[:, None]).T @ sketch
    w, q = np.linalg.eigh((b + b.T) / 2)
    good = w > w[-1] * 1e-7
    u, _, _ = np.linalg.svd((sketch @ q[:, good]) / np.sqrt(w[good]), full_matrices=False)
    return vocabulary, df, idf, u[:, :rank]


class _Signatures:
    """Each item's rarest words as postings, how many of them a passage needs, and its passages' step."""

    def __init__(self, items: list[Item], vocabulary: dict, df: np.ndarray, window: int, least: float, min_words: int):
        self.k, self.step = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
        terms, owners = [], []
        for i, it in enumerate(items):
            it.short = it.n < min_words
            it.need = it.n if it.short else min(it.n, max(1, int(np.ceil(least * it.n - 1e-9))))
            self.k[i] = k = max(1, it.need // 4)
            rare = sorted((int(df[t]), t) for t in map(vocabulary.get, it.words))[: it.n - it.need + k]
            mine = {t for _, t in rare}
            terms.extend(mine)
            owners.extend([i] * len(mine))
            wide = window
            while 4 * it.n > 5 * wide:
                wide *= 2
            self.step[i] = wide // 2
        order = np.argsort(np.array(terms), kind="stable")
        self.items = np.array(owners)[order]
        self.counts = np.append(np.bincount(terms, minlength=len(vocabulary)), 0)  # the last for words outside the benchmark
        self.first = np.cumsum(self.counts) - self.counts

    def candidates(self, ids: np.ndarray, lens: np.ndarray):
        """Text, item and passage number wherever k words of the item's signature lie within the checked words."""
        gap = int(4 * self.step.max())
        begin = np.cumsum(lens + gap) - (lens + gap)
        place = explode_ranges(begin, lens)
        n = self.counts[ids]
        size = int((lens + gap).sum())
        key = np.sort(self.items[explode_ranges(self.first[ids], n)] * size + np.repeat(place, n))
        item, at = np.divmod(key, size)
        other = np.arange(len(key)) + self.k[item] - 1
        last = np.minimum(other, len(key) - 1)
        ok = np.flatnonzero((other < len(key)) & (item[last] == item) & (at[last] - at < 4 * self.step[item]))
        item, at, end = item[ok], at[ok], at[last[ok]]
        doc = np.searchsorted(begin, at, side="right") - 1
        step, length = self.step[item], lens[doc]
        most = np.maximum(0, -(-(length - 2 * step) // step))  # a text's last passage
        lo = np.maximum(0, (end - begin[doc]) // step - 2)
        hi = np.minimum(most, (at - begin[doc]) // step + 1)
        n = np.maximum(0, hi - lo + 1)
        rows = np.stack([np.repeat(doc, n), np.repeat(item, n), explode_ranges(lo, n)], axis=1)
        return np.unique(rows, axis=0).tolist() if len(rows) else []


def _blocks(benchmark: DataFrame, item_block: int, block_words: int):
    """Items with a word, in blocks; the driver holds one at a time."""
    held, words = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        w = words_of((r.text or "").encode())
        if held and w and (len(held) >= item_block or words + len(w) > block_words):
            yield held
            held, words = [], 0
        if w:
            held.append(Item(r.item_id, w))
            words += len(w)
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 48, rank: int = 192, min_lcs: float = 0.6, sure_lcs: float = 0.8, min_words: int = 8, item_block: int = 20_000, block_words: int = 1 << 17) -> DataFrame:
    """doc_id, item_id, cosine, lcs, item_words, start and stop (word numbers of the checked passage)."""
    out, base = None, normalized(docs)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", benchmark.schema["item_id"].dataType), *T.StructType.fromDDL("cosine double, lcs long, item_words long, start long, stop long").fields])
    for items in _blocks(benchmark, item_block, block_words):
        got = _find_block(base, items, schema, window, rank, min_lcs, sure_lcs, min_words)
        out = got if out is None else out.unionByName(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _find_block(base: DataFrame, items: list[Item], schema: T.StructType, window: int, rank: int, min_lcs: float, sure_lcs: float, min_words: int) -> DataFrame:
    spark = base.sparkSession
    vocabulary, df, idf, axes = fit(base, items, window, min(rank, len({w for it in items for w in it.words})))
    weighted = (idf[:, None] * axes).astype(np.float32)
    signatures = _Signatures(items, vocabulary, df, window, min(min_lcs, sure_lcs), min_words)
    latent = np.array([_unit(weighted, [vocabulary[w] for w in it.words]) for it in items], np.float32)
    shared = spark.sparkContext.broadcast((vocabulary, weighted, latent, signatures, items))
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def search(batches):
        vocabulary, weighted, latent, signatures, items = shared.value
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            best: dict = {}
            for at, words, ids, lens in _word_batches([t.as_py() for t in b.column("text")], vocabulary):
                first = np.cumsum(lens) - lens
                for d, k, q in signatures.candidates(ids, lens):
                    it, ws, step = items[k], words[d], int(signatures.step[k])
                    s = q * step
                    lo, hi = max(0, s - step), min(len(ws), s + 3 * step)
                    span = ws[lo:hi]
                    if sum(map(it.masks.__contains__, span)) < it.need:
                        continue
                    if it.short:
                        if not it.inside(span):
                            continue
                        lcs = it.n
                    else:
                        lcs, answer = it.lcs(span)
                        if not (lcs >= sure_lcs * it.n or lcs >= min_lcs * it.n and 2 * answer >= min(it.n, it.answer)):
                            continue
                    if lcs >= best.get((at + d, k), (0,))[0]:
                        t = ids[first[d] + s : first[d] + min(len(ws), s + 2 * step)]
                        row = (lcs, float(_unit(weighted, t[t >= 0]) @ latent[k]), -lo, hi)
                        best[at + d, k] = max(row, best.get((at + d, k), row))
            rows = [(doc_ids[d], items[k].id, cos, lcs, items[k].n, -lo, hi) for (d, k), (lcs, cos, lo, hi) in best.items()]
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], schema.names)

    return base.mapInArrow(search, schema)


def _unit(weighted: np.ndarray, terms) -> np.ndarray:
    """A passage's direction in the latent space."""
    x = weighted[terms].sum(axis=0)
    return x / max(float(np.linalg.norm(x)), 1e-12)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, items)

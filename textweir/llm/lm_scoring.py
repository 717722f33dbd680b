"""N-gram LM scoring with a log-frequency Bloom filter.

Training packs words and word pairs with their counts by hash range (aggregated
inside each task first, so a frequent word leaves a task once; a pair is two
32-bit word hashes). Reducers sum their range and write slices of the filter: a
count is inserted with the levels 1 .. level(count), levels being two a doubling,
and found again by probing level after level until one is missing. Pairs are kept
from a count of two on, all of them; what a context's other pairs held together,
its loose mass, is kept beside its count. The filter grows with the corpus. Up to
``max_bits`` bits workers get it by broadcast. A larger one stays where it is:
batches of texts send the packed remainders of their distinct n-grams to the
slices of their hash ranges, and the levels found come back to the batch.

    p(w | v) = (c(v w) + (k + loose(v)) * p(w)) / (c(v) + k),    p(w) = (c(w) + 1) / (N + V + 1)

Counts of pairs and words and the loose mass are read as the least value of their
level, the count of the context as the greatest, so the probabilities of all words
after v never add up to more than one. The base score uses exact unigram counts:
the most frequent of each hash range (``max_exact`` in all) are broadcast, the
rest meet the texts' rare words in a join, which therefore has no hot key.

Defined results
---------------
* null or empty text: the end token alone, after the start of a text.
* null ``doc_id``: its number's text is empty (crc32 0), so it is trained on.
* rows with the same id and text get the same result, each its own row.
* no training rows: N = V = 0, every count 0. Empty table: no rows.
* texts of any length are counted and scored whole; ties don't arise. Extra
  columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.llm.common import U64, Bits, RepeatFilter, materialize, mix64, n_shards, shard_of, small_batches, trim

END, START = U64(xxhash.xxh3_64_intdigest(b"")), U64(xxhash.xxh3_64_intdigest(b"\n"))
_LEVEL, _LOOSE, _PAIR = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(1 << 63)
#: The least count of each level: 1, 2, 3, 4, 6, 8, 12, 16, ...
LEAST = np.array(sorted({1, *(x << k for x in (2, 3) for k in range(60))}), np.int64)


def level_of(c: np.ndarray) -> np.ndarray:
    """0 for none, then one more at each count of ``LEAST``."""
    return np.searchsorted(LEAST, c, side="right")


def least_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.where(level > 0, LEAST[np.maximum(level, 1) - 1], 0)


def most_of(level: np.ndarray) -> np.ndarray:
    """The greatest count of a level."""
    return np.where(level > 0, LEAST[np.minimum(level, len(LEAST) - 1)] - 1, 0)


def at_level(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys + U64(level) * _LEVEL)


def token_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def tokens_of(texts: list[bytes]):
    """Token hashes of all texts, the number of each text's, and where it starts."""
    parts = [token_hashes(t) for t in texts]
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts), lens, np.cumsum(lens) - lens


def pairs_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(word before, word) as two 32-bit hashes; ``first`` are the places where a text starts."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first] = START
    return before & ~U64(0xFFFFFFFF) | h >> U64(32)


def word_keys(h: np.ndarray) -> np.ndarray:
    """Filter keys of words: the first bit is 0, the hash range that of the word."""
    return h >> U64(1)


def loose_keys(h: np.ndarray, bits: int) -> np.ndarray:
    """Filter keys of the words' loose masses, in the ranges of the words."""
    return in_shard(word_keys(h), mix64(h ^ _LOOSE), bits)


def pair_keys(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Filter keys of pairs: the first bit is 1, then the hash range and 32 bits more."""
    return mix64(pairs) >> U64(1) & ~U64((1 << (63 - 32 - (bits - 1))) - 1) | _PAIR


class CountFilter:
    """Levels of any keys, by probes. Ranges of words come first, then as many of pairs."""

    def __init__(self, ranges: int, slices: dict, most: int):
        self.bits, self.filter, self.most = ranges.bit_length() - 1, RepeatFilter(ranges, slices), most

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for level in range(1, self.most + 1):
            # A key's levels lie in its own slice: the top bits stay those of the key.
            alive = alive[self.filter.has(in_shard(keys[alive], at_level(keys[alive], level), self.bits))]
            if not len(alive):
                break
            out[alive] = level
        return out


def in_shard(keys: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return h
    low = U64((1 << (64 - bits)) - 1)
    return keys & ~low | h & low


def fill(keys: list[np.ndarray], levels: list[np.ndarray], bits: int, per_key: int) -> Bits:
    """A filter slice with every level of its keys."""
    k, n = np.concatenate(keys), np.concatenate(levels)
    out = Bits(Bits.log2_for(int(n.sum()), per_key))
    k, n, step = k[n > 0], n[n > 0], 1
    while len(k):
        out.add(in_shard(k, at_level(k, step), bits))
        more = n > step
        k, n, step = k[more], n[more], step + 1
    return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums."""
    k = np.concatenate([np.empty(0, U64), *keys])
    if not len(k):
        return k, np.empty(0, np.int64)
    c = np.concatenate(counts).astype(np.int64)
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c[order], first)


#: kind 0: words with counts; 1: pairs met once in a batch; 2: pairs with counts; 3: contexts with the mass of their kept pairs; 4: words summed by range
_COUNTS = "shard int, kind int, keys binary, counts binary"
_PAIRS = "shard int, log2 int, bits binary, most int, words binary, counts binary, contexts binary, kept binary"
_SLICE = "shard int, total long, distinct long, log2 int, bits binary, most int, top_keys binary, top_counts binary, rest_keys binary, rest_counts binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _batches(batches, limit: int = 6 << 20):
    """Rows of several Arrow batches (text last) as columns of about ``limit`` bytes of text."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            held.append(row)
            size += len(row[-1])
            if size >= limit:
                yield [list(c) for c in zip(*held)]
                held, size = [], 0
    if held:
        yield [list(c) for c in zip(*held)]


def packed(keys: np.ndarray, counts: np.ndarray | None, kind: int, shard: np.ndarray, shards: int) -> list[tuple]:
    """Rows of ``_COUNTS``; keys come sorted by their range."""
    cut = np.searchsorted(shard, np.arange(shards + 1))
    return [(s, kind, keys[cut[s] : cut[s + 1]].tobytes(), b"" if counts is None else counts[cut[s] : cut[s + 1]].tobytes()) for s in np.flatnonzero(np.diff(cut)).tolist()]


class Model:
    """What training gathered: the filter (broadcast if small) and its slices, exact counts of frequent words, and the table of the rest."""

    def __init__(self, total, distinct, counts, slices, shards, most, top, rest):
        self.total, self.distinct, self.counts, self.slices, self.shards, self.most, self.top, self.rest = total, distinct, counts, slices, shards, most, top, rest


def train(docs: DataFrame, min_count: int = 2, max_bits: int = 1 << 26, max_exact: int = 1 << 20, per_key: int = 14) -> Model:
    """Count all words and word pairs of ``docs.text`` (binary)."""
    spark = docs.sparkSession
    shards = n_shards(docs, per_shard=8 << 20)
    bits = shards.bit_length() - 1

    def count(batches):
        for (texts,) in _batches(batches):
            h, _, first = tokens_of(texts)
            w, n = np.unique(np.concatenate([h, np.full(len(texts), START)]), return_counts=True)
            rows = packed(w, n.astype(np.uint32), 0, shard_of(w, bits), shards)
            p, n = np.unique(pairs_of(h, first), return_counts=True)
            shard = shard_of(mix64(p), bits)
            order = np.argsort(shard, kind="stable")
            p, n, shard = p[order], n[order].astype(np.uint32), shard[order]
            once = n == 1
            rows += packed(p[once], None, 1, shard[once], shards) + packed(p[~once], n[~once], 2, shard[~once], shards)
            yield _batch(_COUNTS, rows)
            trim()

    def of_kind(t, kind, key=U64):
        held = [(k.as_py(), c.as_py()) for k, c, x in zip(t["keys"], t["counts"], t["kind"].to_pylist()) if x == kind]
        keys = [np.frombuffer(k, key) for k, _ in held]
        return keys, [np.frombuffer(c, np.uint32 if kind < 3 else np.int64) if c else np.ones(len(k), np.uint32) for k, (_, c) in zip(keys, held)]

    def count_pairs(t: pa.Table) -> pa.Table:
        """The slice of a range of pairs, and what its kept pairs are to their contexts."""
        shard = t["shard"][0].as_py()
        words, n = summed(*of_kind(t, 0))
        (a, x), (b, y) = of_kind(t, 1), of_kind(t, 2)
        pairs, m = summed(a + b, x + y)
        keep = m >= min_count
        pairs, m = pairs[keep], m[keep]
        level = level_of(m)
        out = fill([pair_keys(pairs, bits + 1)], [level], bits + 1, per_key)
        contexts, kept = summed([pairs >> U64(32)], [m])
        return pa.Table.from_batches([_batch(_PAIRS, [(shard, out.log2, out.words.tobytes(), int(level.max(initial=0)), words.tobytes(), n.tobytes(), contexts.astype(np.uint32).tobytes(), kept.tobytes())])])

    table = materialize(docs.select("text").mapInArrow(count, _COUNTS).groupBy("shard").applyInArrow(count_pairs, _PAIRS))

    def to_words(batches):
        """Counts of words as they are, and the mass of contexts by the words' ranges, summed in each task first."""
        held: list[tuple] = []

        def flush():
            contexts, kept = summed([np.concatenate([k for k, _ in held])], [np.concatenate([c for _, c in held])])
            held.clear()
            return packed(contexts.astype(np.uint32), kept, 3, shard_of(contexts << U64(32), bits), shards)

        for b in batches:
            for shard, words, n, contexts, kept in zip(*(b.column(c).to_pylist() for c in ("shard", "words", "counts", "contexts", "kept"))):
                yield _batch(_COUNTS, [(shard, 4, words, n)])
                held.append((np.frombuffer(contexts, np.uint32).astype(U64), np.frombuffer(kept, np.int64)))
                if sum(len(k) for k, _ in held) >= 1 << 21:
                    yield _batch(_COUNTS, flush())
        if held and (rows := flush()):
            yield _batch(_COUNTS, rows)

    def count_words(t: pa.Table) -> pa.Table:
        """The slice of a range of words: counts and loose masses."""
        shard = t["shard"][0].as_py()
        words, n = summed(*of_kind(t, 4))
        contexts, kept = summed(*(lambda k, c: ([x.astype(U64) for x in k], c))(*of_kind(t, 3, np.uint32)))
        # Words of one 32-bit hash are one context.
        of, at = np.unique(words >> U64(32), return_inverse=True)
        mass = np.zeros(len(of), np.int64)
        np.add.at(mass, at, n)
        if len(contexts) and len(of):
            place = np.minimum(np.searchsorted(of, contexts), len(of) - 1)
            hit = of[place] == contexts
            np.subtract.at(mass, place[hit], kept[hit])
        level, loose = level_of(n), level_of(np.maximum(mass, 0))[at]
        out = fill([word_keys(words), loose_keys(words, bits + 1)], [level, loose], bits + 1, per_key)
        n = np.where(words == START, 0, n)  # a context, but no token
        words, n = words[n > 0], n[n > 0]
        top = np.zeros(len(words), bool)
        most_exact = max(1, max_exact // shards)
        top[np.argpartition(-n, min(most_exact, len(n) - 1))[:most_exact] if len(n) else []] = True
        row = (shard, int(n.sum()), len(words), out.log2, out.words.tobytes(), int(max(level.max(initial=0), loose.max(initial=0))), words[top].tobytes(), n[top].tobytes(), words[~top].tobytes(), n[~top].tobytes())
        return pa.Table.from_batches([_batch(_SLICE, [row])])

    words = materialize(table.drop("log2", "bits", "most").mapInArrow(to_words, _COUNTS).groupBy("shard").applyInArrow(count_words, _SLICE))
    rows = words.drop("rest_keys", "rest_counts", "bits").collect()
    total, distinct = sum(r.total for r in rows), sum(r.distinct for r in rows)
    slices = words.select("shard", "log2", "bits", "most").unionByName(table.select((F.col("shard") + shards).alias("shard"), "log2", "bits", "most"))
    size, most = slices.agg(F.sum(F.octet_length("bits")), F.max("most")).collect()[0]
    counts = None
    if (size or 0) * 8 <= max_bits:
        counts = spark.sparkContext.broadcast(CountFilter(2 * shards, {r.shard: (r.log2, bytes(r.bits)) for r in slices.collect()}, most or 0))
    keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r.top_keys, np.uint64) for r in rows)])
    c = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r.top_counts, np.int64) for r in rows)])
    order = np.argsort(keys)
    top = spark.sparkContext.broadcast((keys[order], c[order]))

    def rest(batches):
        for b in batches:
            for k, n in zip(b.column("rest_keys"), b.column("rest_counts")):
                k, n = np.frombuffer(k.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64)
                for i in range(0, len(k), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], ["word", "c"])

    return Model(total, distinct, counts, slices, shards, most or 0, top, words.select("rest_keys", "rest_counts").mapInArrow(rest, "word long, c long"))


def score(docs: DataFrame, model: Model, strength: float = 4.0) -> DataFrame:
    """doc_id, th, n_tokens, n_known, base_score, score of each distinct row of ``docs`` (doc_id, th, text), and its copies."""
    total, distinct = model.total, model.distinct
    denominator = total + distinct + 1
    counts, top, bits, most = model.counts, model.top, model.shards.bit_length(), model.most  # bits of a range of words or pairs

    def measure(ids, ths, texts, look_up):
        """Results of some texts; ``look_up`` gives levels: of words, of their loose masses, and of pair keys."""
        known_words, exact = top.value
        n_rows = len(texts)
        h, lens, first = tokens_of(texts)
        doc = np.repeat(np.arange(n_rows), lens)
        u, inv = np.unique(np.append(h, START), return_inverse=True)
        inv, start = inv[:-1], int(inv[-1])
        place = np.minimum(np.searchsorted(known_words, u), max(0, len(known_words) - 1))
        known = known_words[place] == u if len(known_words) else np.zeros(len(u), bool)
        c = np.where(known, exact[place], 0) if len(known_words) else np.zeros(len(u), np.int64)
        part = np.where(known, np.log10((c + 1) / denominator), 0.0)
        base = np.bincount(doc, part[inv], n_rows)
        n_known = np.bincount(doc, known[inv], n_rows).astype(np.int64)
        # The model: probes for words, contexts and pairs.
        pairs, inv2 = np.unique(pair_keys(pairs_of(h, first), bits), return_inverse=True)
        of_word, of_loose, of_pair = look_up(u, pairs)
        before = np.empty(len(h), np.int64)
        before[1:] = inv[:-1]
        before[first] = start
        single = ((least_of(of_word) + 1) / denominator)[inv]
        loose, mass = least_of(of_loose)[before], most_of(of_word)[before]
        p = (least_of(of_pair)[inv2] + (strength + loose) * single) / (mass + strength)
        logs = np.bincount(doc, np.log10(p), n_rows)
        rare = np.flatnonzero(~known[inv])
        order = np.lexsort((h[rare], doc[rare]))
        r_doc, r_word = doc[rare][order], h[rare][order]
        new = np.flatnonzero(np.concatenate([[True], (r_doc[1:] != r_doc[:-1]) | (r_word[1:] != r_word[:-1])])) if len(rare) else np.empty(0, np.int64)
        tf = np.diff(np.append(new, len(r_doc)))
        r_doc, r_word = r_doc[new], r_word[new].view(np.int64)
        edge = np.searchsorted(r_doc, np.arange(n_rows + 1))
        kind = pa.ListArray.from_arrays
        return pa.RecordBatch.from_arrays(
            [ids, ths, pa.array(lens), pa.array(n_known), pa.array(base), pa.array(logs), kind(pa.array(edge, pa.int32()), pa.array(r_word)), kind(pa.array(edge, pa.int32()), pa.array(tf))],
            ["doc_id", "th", "n_tokens", "n_known", "base_score", "score", "words", "tfs"],
        )

    def probe(words, pairs):
        return tuple(map(counts.value.levels, (word_keys(words), loose_keys(words, bits), pairs)))

    def run(batches):
        for ids, ths, texts in _batches(batches, 4 << 20):
            yield measure(pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), texts, probe)

    def named(batches):
        """Batches with names that both passes over the texts give them: task, number, checksum."""
        for k, (ids, ths, texts) in enumerate(_batches(batches)):
            whole = b"".join(texts)
            yield f"{TaskContext.get().partitionId()}-{k}-{zlib.crc32(whole):08x}", ids, ths, texts, whole

    def hold(batches):
        for name, ids, ths, texts, whole in named(batches):
            cols = [[name], [ids], [ths], [[len(t) for t in texts]], [len(whole)], [pa.compress(whole, "zstd", asbytes=True)]]
            kinds = [pa.string(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["batch", "ids", "ths", "lens", "size", "texts"])

    def unpack(lens, size, data):
        whole = pa.decompress(data, size, "zstd", asbytes=True) if size else b""
        ends = np.cumsum(lens)
        return [whole[z - n : z] for z, n in zip(ends.tolist(), lens)]

    def by_range(keys, offset):
        """Sorted filter keys by their ranges: (range, from, to)."""
        cut = np.searchsorted(shard_of(keys, bits), np.arange(offset, offset + (1 << (bits - 1)) + 1))
        return [(offset + k, int(cut[k]), int(cut[k + 1])) for k in np.flatnonzero(np.diff(cut)).tolist()]

    def ask(batches):
        """The distinct words (whole) and pairs (32 bits beside their range) of each batch, for the ranges that know them."""
        for name, _, _, texts, _ in named(batches):
            h, _, first = tokens_of(texts)
            words, pairs = np.unique(np.append(h, START)), np.unique(pair_keys(pairs_of(h, first), bits))
            short = (pairs >> U64(32 - bits)).astype(np.uint32)
            rows = [(s, words[a:z].tobytes()) for s, a, z in by_range(word_keys(words), 0)] + [(s, short[a:z].tobytes()) for s, a, z in by_range(pairs, 1 << (bits - 1))]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["batch", "shard", "keys"])

    def answer(asks: pa.Table, part: pa.Table) -> pa.Table:
        """Levels of the keys asked for; those of words are followed by those of their loose masses."""
        if not asks.num_rows:
            return pa.table({"batch": pa.array([], pa.string()), "shard": pa.array([], pa.int32()), "levels": pa.array([], pa.binary())})
        shard = asks["shard"][0].as_py()
        of_words = not shard >> (bits - 1)
        parts = [np.frombuffer(k.as_py(), U64 if of_words else np.uint32) for k in asks["keys"]]
        whole, lens = np.concatenate(parts), list(map(len, parts))
        keys = [word_keys(whole), loose_keys(whole, bits)] if of_words else [whole.astype(U64) << U64(32 - bits) | U64(shard) << U64(64 - bits)]
        f = CountFilter(1 << bits, {shard: (part["log2"][0].as_py(), part["bits"][0].as_py())} if part.num_rows else {}, most if part.num_rows else 0)
        found = [np.split(f.levels(k).astype(np.uint8), np.cumsum(lens)[:-1]) for k in keys]
        return pa.table({"batch": asks["batch"], "shard": asks["shard"], "levels": pa.array([b"".join(x.tobytes() for x in xs) for xs in zip(*found)], pa.binary())})

    def finish(held: pa.Table, answers: pa.Table) -> pa.Table:
        if held.num_rows != 1 or not answers.num_rows:
            raise ValueError("the texts came in another order the second time: write them as a table first")
        (row,) = held.to_pylist()
        levels = {s: np.frombuffer(x, np.uint8).astype(np.int64) for s, x in zip(answers["shard"].to_pylist(), answers["levels"].to_pylist())}

        def look_up(words, pairs):
            both = [levels[s].reshape(2, -1) for s, _, _ in by_range(word_keys(words), 0)]
            of_word, of_loose = np.concatenate(both, axis=1)
            return of_word, of_loose, np.concatenate([levels[s] for s, _, _ in by_range(pairs, 1 << (bits - 1))])

        return pa.Table.from_batches([measure(pa.array(row["ids"], pa.int64()), pa.array(row["ths"], pa.int64()), unpack(row["lens"], row["size"], row["texts"]), look_up)])

    schema = "doc_id long, th long, n_tokens long, n_known long, base_score double, score double, words array<long>, tfs array<long>"
    texts = docs.select("doc_id", "th", "text")
    if counts is not None:
        scored = materialize(texts.mapInArrow(run, schema))
    else:
        held = texts.mapInArrow(hold, "batch string, ids array<long>, ths array<long>, lens array<long>, size long, texts binary")
        asks = texts.mapInArrow(ask, "batch string, shard int, keys binary")
        answers = asks.groupBy("shard").cogroup(model.slices.groupBy("shard")).applyInArrow(answer, "batch string, shard int, levels binary")
        scored = materialize(held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, schema))
    rare = scored.select("doc_id", "th", F.explode(F.arrays_zip("words", "tfs")).alias("x")).select("doc_id", "th", F.col("x.words").alias("word"), F.col("x.tfs").alias("tf"))
    met = rare.join(model.rest, "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(denominator)))
    sums = met.select("doc_id", "th", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("long").alias("n_tokens"), F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0).alias("n_known"), (F.col("tf") * log).alias("base_score"), F.lit(None).cast("double").alias("score"))
    whole = scored.select("doc_id", "th", F.lit(1).cast("long").alias("copies"), "n_tokens", "n_known", "base_score", "score").unionByName(sums)
    out = whole.groupBy("doc_id", "th").agg(F.sum("copies").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.max("score").alias("score"))
    return out.select("doc_id", "th", "n_tokens", (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"), (F.col("base_score") / F.col("copies")).alias("base_score"), "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, strength: float = 4.0, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds) == held
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"), held_out.alias("held_out"))
    model = train(base.filter(~F.col("held_out")).select("text"), **options)
    out = score(base.select("doc_id", "th", "text"), model, strength)
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds) == held
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Removal of repeated substrings with a distributed sparse suffix array.

A byte goes if it is covered by a string of ``length`` bytes that also starts
earlier (smaller document, or same document and earlier start). Every such
string holds an anchor: the ``gram`` bytes whose hash is the least among all
grams of the string, a choice that depends on the string alone. So:

1. one pass packs anchor hashes for a once/twice filter; only suspect anchors go
   on, with up to ``length - gram`` bytes to the left and ``length`` to the right;
2. a task keeps one occurrence of each identical context (the first) and answers
   the others itself, so a text copied a million times is shuffled once a task;
3. a reducer owns a hash range of anchors. It sorts the right contexts, and the
   left ones turned round, as suffixes: deep-shallow, multikey quicksort on
   words to a shallow depth, then blind tries for the groups that still agree.
   With the arrays of common prefixes, equal windows are equal pairs of a left
   class and a right class, at any group size, without comparing pairs;
   an anchor met ``hot`` times or more doesn't go to one reducer: its contexts are
   cut into windows where they are, each distinct window of a flush goes on as a
   128-bit hash with its first place, and reducers own hash ranges of windows;
4. spans meet their texts by document; texts without spans are not shuffled.

Defined results
---------------
* null or empty text, and texts under ``length`` bytes: nothing is removed.
* null ``doc_id``: a document before all ids. Rows with the same id and text are
  one document, so all keep the same bytes; rows with the same id and other
  texts count as documents ordered by a hash of the text.
* ties: of equal strings the one in the smallest document, then at the least
  place, stays. Texts of any length up to 2**31 - 1 bytes are read whole.
* empty table: no rows. Columns in ``keep`` pass through (any name but those of
  the result); others, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.llm.common import HASH_SCHEMA, U64, Bits, RepeatFilter, concat, emit_hashes, explode_ranges, materialize, mix64, n_shards, repeat_filter, schema_of, shard_of, small_batches, trim

MAX = U64(0xFFFFFFFFFFFFFFFF)
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_MUL = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _window(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for all i."""
    m = 1
    while 2 * m <= w:
        x = op(x[:-m], x[m:])
        m *= 2
    return op(x[: len(x) - (w - m)], x[w - m :]) if w > m else x


def anchors(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, length: int, gram: int):
    """Positions in ``buf`` and hashes of the anchors of texts that lie one after another."""
    if len(buf) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h, m, i = _TABLE[buf], 1, 0
        while m < gram:
            h = h[:-m] * _MUL[i] + h[m:]
            m, i = 2 * m, i + 1
        h ^= h >> U64(31)
        h *= _MUL[5]
        h ^= h >> U64(29)
    ends = starts + lens
    cut = np.minimum(lens, gram - 1)
    off = explode_ranges(ends - cut, cut)
    h[off[off < len(h)]] = MAX
    w = length - gram + 1
    low = _window(h, w, np.minimum)
    cut = np.minimum(lens, length - 1)
    off = explode_ranges(ends - cut, cut)
    low[off[off < len(low)]] = 0
    low = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    high = _window(low, w, np.maximum)[: len(h)]
    at = np.flatnonzero((h == high) & (h != MAX))
    return at, mix64(h[at])  # least hashes crowd the low ranges


def _chunks(texts: list[bytes], length: int, size: int = 1 << 18):
    """(indexes of the texts, buffer, starts, lens) of about ``size`` bytes."""
    ids, total = [], 0
    for i, t in enumerate(texts):
        if len(t) >= length:
            ids.append(i)
            total += len(t)
        if total >= size or ids and i == len(texts) - 1:
            lens = np.array([len(texts[k]) for k in ids], np.int64)
            yield np.array(ids), np.frombuffer(b"".join([texts[k] for k in ids]), np.uint8), np.cumsum(lens) - lens, lens
            ids, total = [], 0


def _all_chunks(column, length: int, rows: int = 512):
    """Chunks of a column, a few rows at a time, so that few texts are held twice."""
    for at in range(0, len(column), rows):
        for ids, *chunk in _chunks(column.slice(at, rows).to_pylist(), length):
            yield (ids + at, *chunk)


class _Leaf:
    __slots__ = ("ids", "text")

    def __init__(self, i: int, text: bytes):
        self.ids, self.text = [i], text


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict):
        self.depth, self.kids = depth, kids


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return n if not x else (x & -x).bit_length() - 1 >> 3


def blind_trie_order(texts: list[bytes]) -> list[int]:
    """Sorted order of ``texts`` by a trie that stores only branching depths."""
    root = _Leaf(0, texts[0])
    for i in range(1, len(texts)):
        s = texts[i]
        node = root
        while type(node) is _Node:  # blind: skipped characters aren't compared
            node = node.kids.get(s[node.depth] if node.depth < len(s) else -1) or next(iter(node.kids.values()))
        l = _common(s, node.text)
        mine = s[l] if l < len(s) else -1
        other = node.text[l] if l < len(node.text) else -1
        if mine == other:
            node.ids.append(i)
            continue
        above, here = None, root
        while type(here) is _Node and here.depth < l:
            above, c = here, s[here.depth]
            here = here.kids[c]
        if type(here) is _Node and here.depth == l:
            here.kids[mine] = _Leaf(i, s)
            continue
        split = _Node(l, {other: here, mine: _Leaf(i, s)})
        if above is None:
            root = split
        else:
            above.kids[c] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is _Leaf:
            out += node.ids
        else:
            stack += [node.kids[c] for c in sorted(node.kids, reverse=True)]
    return out


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words``, and (start, stop) of the groups that agree in every word.

    Three-way partitioning on one word around a pivot (the median of three): the
    smaller and the greater go on at the same depth, the equal at the next. All
    groups of a round are partitioned together.
    """
    n, depth_of_all = words.shape
    order, ties = np.arange(n), []
    start, size, depth = np.array([0] * (n > 1)), np.array([n] * (n > 1)), np.zeros(int(n > 1), np.int64)
    while len(start):
        at = explode_ranges(start, size)
        rows, group = order[at], np.repeat(np.arange(len(start)), size)
        first = np.cumsum(size) - size
        w = words[rows, depth[group]]
        trio = w[np.stack([first, first + size // 2, first + size - 1])]
        pivot = np.sort(trio, axis=0)[1][group]
        less, more = w < pivot, w > pivot
        same = ~(less | more)
        n_less, n_same = np.add.reduceat(less.astype(np.int64), first), np.add.reduceat(same.astype(np.int64), first)
        place = np.empty(len(rows), np.int64)
        for side, shift in ((less, 0 * size), (same, n_less), (more, n_less + n_same)):
            rank = np.cumsum(side) - 1
            before = (rank - side + 1)[first]  # of this side in earlier groups
            place[side] = (start + shift - before)[group[side]] + rank[side]
        order[place] = rows
        done = depth + 1 == depth_of_all
        tied = done & (n_same > 1)
        ties.append(np.stack([(start + n_less)[tied], (start + n_less + n_same)[tied]], axis=1))
        parts = [(start, n_less, depth), ((start + n_less)[~done], n_same[~done], depth[~done] + 1), (start + n_less + n_same, size - n_less - n_same, depth)]
        start, size, depth = (np.concatenate(x) for x in zip(*parts))
        big = size > 1
        start, size, depth = start[big], size[big], depth[big]
    return order, np.concatenate(ties) if ties else np.empty((0, 2), np.int64)


def deep_shallow_order(rows: np.ndarray, lens: np.ndarray, shallow: int) -> np.ndarray:
    """Order of byte strings (rows padded with zeros): multikey quicksort on words of
    eight bytes to the depth ``shallow``, then blind tries for what still agrees."""
    words = np.ascontiguousarray(rows[:, :shallow]).view(">u8").astype(np.uint64)
    order, ties = multikey_quicksort(words)
    width = rows.shape[1]
    raw = rows.tobytes()
    for a, b in ties.tolist():
        group = order[a:b]
        texts = [raw[i * width : i * width + k] for i, k in zip(group.tolist(), lens[group].tolist())]
        order[a:b] = group[blind_trie_order(texts)]
    return order


def _classes(rows: np.ndarray, lens: np.ndarray, shallow: int):
    """Sorted order and the common prefix of each with the one before it."""
    order = deep_shallow_order(rows, lens, shallow)
    if len(order) < 2:
        return order, np.zeros(len(order), np.int64)
    lcp = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        first = differ.argmax(axis=1)
        first[~differ.any(axis=1)] = rows.shape[1]
        lcp[a:b] = np.minimum(first, np.minimum(lens[order[a:b]], lens[order[a - 1 : b - 1]]))
    return order, lcp


def repeated_windows(right, r_len, left, l_len, length: int, gram: int):
    """For contexts in order of occurrence: least and greatest offset to the left of the
    anchor at which a window starts that an earlier context also has (-1: none)."""
    n = len(right)
    lo, hi = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    r_order, r_lcp = _classes(right, r_len, 40)
    l_order, l_lcp = _classes(left, l_len, 16)
    rc, lc = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(length - gram + 1):
        d = length - o
        valid = (l_len >= o) & (r_len >= d)
        if not valid.any():
            continue
        rc[r_order] = np.cumsum(r_lcp < d)
        valid &= np.bincount(rc[valid], minlength=n + 2)[rc] > 1
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        if o:
            lc[l_order] = np.cumsum(l_lcp < o)
            key = rc[at] * (n + 1) + lc[at]
        else:
            key = rc[at]
        order = np.argsort(key, kind="stable")
        k = key[order]
        again = at[order[1:][k[1:] == k[:-1]]]
        lo[again] = np.where(lo[again] < 0, o, lo[again])
        hi[again] = o
    return lo, hi


def window_hashes(body: np.ndarray, l_len: np.ndarray, r_len: np.ndarray, length: int):
    """(row, bytes before the anchor, two hashes) of every whole window in contexts (right, then left turned round)."""
    reach = body.shape[1] - length
    whole = np.concatenate([body[:, length:][:, ::-1], body[:, :length]], axis=1)
    o = np.arange(reach + 1)
    row, before = np.nonzero((l_len[:, None] >= o) & (r_len[:, None] >= length - o))
    a, z = reach - before, reach - before + length
    out = []
    with np.errstate(over="ignore"):
        for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            up, down = (np.multiply.accumulate(np.concatenate([[U64(1)], np.full(whole.shape[1], U64(m))])) for m in (base, pow(base, -1, 1 << 64)))
            sums = np.concatenate([np.zeros((len(whole), 1), U64), np.cumsum(_TABLE[whole] * up[:-1], axis=1, dtype=U64)], axis=1)
            out.append(mix64((sums[row, z] - sums[row, a]) * down[a]))
    return row, before, *out


def first_windows(w: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows (two hashes, rid, th, start): the first of each, and the spans of the others."""
    if not len(w):
        return w, np.empty((0, 4), np.int64)
    w = w[np.lexsort((w[:, 4], w[:, 3], w[:, 2], w[:, 1], w[:, 0]))]
    new = np.concatenate([[True], (w[1:, :2] != w[:-1, :2]).any(axis=1)])
    group = np.cumsum(new) - 1
    first = w[new]
    again = (w[:, 2:] != first[group, 2:]).any(axis=1)  # a row that is there twice is one document
    gone = w[again, 2:]
    return first, np.concatenate([gone, gone[:, 2:] + length], axis=1)


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (rid, th, start, stop) with those of one document that touch made one, by counting what is open."""
    n = len(spans)
    if not n:
        return spans
    rid, th = np.tile(spans[:, 0], 2), np.tile(spans[:, 1], 2)
    at, end = np.concatenate([spans[:, 2], spans[:, 3]]), np.repeat([0, 1], n)
    order = np.lexsort((end, at, th, rid))
    open_now = np.cumsum(1 - 2 * end[order])
    stop = order[open_now == 0]
    start = order[np.concatenate([[True], open_now[:-1] == 0])]
    return np.stack([rid[start], th[start], at[start], at[stop]], axis=1)


_PACK = "shard int, n int, hash binary, rid binary, th binary, pos binary, l_len binary, r_len binary, body binary, spans binary, windows binary"
SPANS = "rid long, th long, start int, stop int"


def _two_hashes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row of words."""
    rng = np.random.default_rng(m.shape[1])
    with np.errstate(over="ignore"):
        a, b = (((m ^ (m >> U64(32))) * rng.integers(1, 1 << 63, m.shape[1], np.uint64)).sum(axis=1, dtype=np.uint64) for _ in range(2))
    return a, b


def _gather(buf: np.ndarray, at: np.ndarray, lens: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of bytes at, at + step, ... padded with zeros."""
    idx = at[:, None] + step * np.arange(width)
    ok = np.arange(width) < lens[:, None]
    return np.where(ok, buf[np.where(ok, idx, 0)], 0).astype(np.uint8)


def _first_of_equal(key_cols) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by the columns (the last ones break ties): order, and where the first two change."""
    order = np.lexsort(key_cols[::-1])
    a, b = key_cols[0][order], key_cols[1][order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return order, new


def _repeats(order, new, rid, th, pos) -> np.ndarray:
    """Occurrences that are the one before: the same place of a row that is there twice."""
    a, b = order[1:], order[:-1]
    return np.concatenate([[False], ~new[1:] & (rid[a] == rid[b]) & (th[a] == th[b]) & (pos[a] == pos[b])])


def repeated_spans(base: DataFrame, length: int = 100, gram: int = 32, max_filter_bits: int = 1 << 31, hot: int = 1 << 16) -> DataFrame:
    """(rid, th, start, stop) spans to remove from rows (rid, th, text)."""
    if gram not in (2, 4, 8, 16, 32) or gram > length:
        raise ValueError("gram must be a power of two up to 32 and at most length")
    shards = n_shards(base, per_shard=2 << 20)
    bits = shards.bit_length() - 1
    reach = length - gram

    def hashes(batches):
        got = []
        for b in batches:
            for _, buf, starts, lens in _all_chunks(b.column(0), length):
                got.append(anchors(buf, starts, lens, length, gram)[1])
        yield from emit_hashes(concat(got), bits, min(hot, 64))

    twice = repeat_filter(base.select("text").mapInArrow(hashes, HASH_SCHEMA), shards, max_filter_bits, per_key=16, hot=hot)

    def ship(held):
        """Contexts of one flush: one of each kind, packed by hash range; the others' spans."""
        h, rid, th, pos, l_len, r_len, left, right = (np.concatenate(x) for x in zip(*held))
        body = np.concatenate([right, left, np.zeros((len(h), -(length + reach) % 8), np.uint8)], axis=1)
        m = np.concatenate([body.view(np.uint64), (l_len * 256 + r_len).astype(np.uint64)[:, None]], axis=1)
        a, b = _two_hashes(m)
        order, new = _first_of_equal([a, b, rid, th, pos])
        rows = body[order]
        same = np.concatenate([[False], (rows[1:] == rows[:-1]).all(axis=1)]) & ~new
        once = ~_repeats(order, new, rid, th, pos)
        again, keep = order[same & once], order[~same & once]
        covers = again[l_len[again] + r_len[again] >= length]
        spans = np.stack([rid[covers], th[covers], pos[covers] - l_len[covers], pos[covers] + r_len[covers]], axis=1)
        span_of = h[covers]
        # Contexts of hot anchors go on as windows, in pieces of bounded size.
        busy = np.isin(h[keep], twice.value.hot)
        windows = np.empty((0, 5), np.int64)
        for at in np.array_split(keep[busy], 1 + busy.sum() // 2000) if busy.any() else ():
            row, before, x, y = window_hashes(body[at, : length + reach], l_len[at], r_len[at], length)
            k = at[row]
            windows, gone = first_windows(np.concatenate([windows, np.stack([x.view(np.int64), y.view(np.int64), rid[k], th[k], pos[k] - before], axis=1)]), length)
            gone = merged(gone)
            spans, span_of = np.concatenate([spans, gone]), np.concatenate([span_of, mix64(gone[:, 1].view(U64))])
        keep = keep[~busy]
        keep = keep[np.argsort(shard_of(h[keep], bits), kind="stable")]
        spans = spans[np.argsort(shard_of(span_of, bits), kind="stable")]
        windows = windows[np.argsort(windows[:, 0].view(U64), kind="stable")]
        edges = np.arange(shards + 1)
        cut, cut2, cut3 = (np.searchsorted(np.sort(shard_of(x, bits)), edges) for x in (h[keep], span_of, windows[:, 0].copy().view(U64)))
        out = []
        for s in np.flatnonzero(np.diff(cut) + np.diff(cut2) + np.diff(cut3)).tolist():
            k = keep[cut[s] : cut[s + 1]]
            out.append((s, len(k), *(x[k].tobytes() for x in (h, rid, th, pos, l_len, r_len)), body[k, : length + reach].tobytes(), spans[cut2[s] : cut2[s + 1]].tobytes(), windows[cut3[s] : cut3[s + 1]].tobytes()))
        cols = list(zip(*out))
        names = [x.split()[0] for x in _PACK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, c in enumerate(cols)], names)

    def contexts(batches):
        held, size = [], 0
        for b in batches:
            rid_of, th_of = b.column("rid").to_numpy(), b.column("th").to_numpy()
            for ids, buf, starts, lens in _all_chunks(b.column("text"), length):
                at, h = anchors(buf, starts, lens, length, gram)
                hit = twice.value.has(h)
                at, h = at[hit], h[hit]
                if not len(at):
                    continue
                doc = np.searchsorted(starts, at, side="right") - 1
                pos = at - starts[doc]
                l_len, r_len = np.minimum(pos, reach), np.minimum(lens[doc] - pos, length)
                held.append((h, rid_of[ids[doc]], th_of[ids[doc]], pos, l_len, r_len, _gather(buf, at - 1, l_len, reach, -1), _gather(buf, at, r_len, length, 1)))
                size += len(h)
                if size >= 24_000:
                    yield ship(held)
                    held, size = [], 0
                    trim()
        if held:
            yield ship(held)

    def solve(t: pa.Table) -> pa.Table:
        def col(name, kind=np.int64):
            return np.concatenate([np.frombuffer(x.as_py(), kind) for x in t[name]])

        h, rid, th, pos, l_len, r_len = col("hash", np.uint64), col("rid"), col("th"), col("pos"), col("l_len"), col("r_len")
        ready = col("spans").reshape(-1, 4)
        body = col("body", np.uint8).reshape(-1, length + reach)
        out = [ready, first_windows(col("windows").reshape(-1, 5), length)[1]]
        if len(h):
            pad = np.zeros((len(h), -(length + reach) % 8), np.uint8)
            m = np.concatenate([np.concatenate([body, pad], axis=1).view(np.uint64), (l_len * 256 + r_len).astype(np.uint64)[:, None]], axis=1)
            a, b = _two_hashes(m)
            order, new = _first_of_equal([a, b, rid, th, pos])
            same = np.concatenate([[False], (body[order[1:]] == body[order[:-1]]).all(axis=1)]) & ~new
            once = ~_repeats(order, new, rid, th, pos)
            again, keep = order[same & once], order[~same & once]
            again = again[l_len[again] + r_len[again] >= length]
            out.append(np.stack([rid[again], th[again], pos[again] - l_len[again], pos[again] + r_len[again]], axis=1))
            # Anchors with two contexts or more are left; order of occurrence.
            _, back, n = np.unique(h[keep], return_inverse=True, return_counts=True)
            keep = keep[n[back] > 1]
            keep = keep[np.lexsort((pos[keep], th[keep], rid[keep]))]
            lo, hi = repeated_windows(body[keep, :length], r_len[keep], body[keep, length:], l_len[keep], length, gram)
            hit = hi >= 0
            k = keep[hit]
            out.append(np.stack([rid[k], th[k], pos[k] - hi[hit], pos[k] - lo[hit] + length], axis=1))
        got = merged(np.concatenate(out))
        trim()
        return pa.table({"rid": got[:, 0], "th": got[:, 1], "start": got[:, 2].astype(np.int32), "stop": got[:, 3].astype(np.int32)})

    return base.mapInArrow(contexts, _PACK).groupBy("shard").applyInArrow(solve, SPANS)


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32, keep: tuple[str, ...] = (), max_filter_bits: int = 1 << 31, hot: int = 1 << 16) -> DataFrame:
    """doc_id, ``keep``, n_bytes, n_removed, n_spans, text (bytes that are left, binary)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("rid"), F.xxhash64(text).alias("th"), *keep)
    spans = materialize(repeated_spans(base.select("rid", "th", "text"), length, gram, max_filter_bits, hot))
    per_doc = spans.groupBy("rid", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    # A filter of the documents that lose something; a false positive only costs its text's shuffle.
    docs_hit = spans.select(F.xxhash64("rid", "th").alias("h")).distinct()
    shards = 64
    packed = docs_hit.mapInArrow(lambda it: emit_hashes(concat([b.column(0).to_numpy().view(np.uint64) for b in it]), 6), HASH_SCHEMA)
    touched = _members(packed, shards, max_filter_bits // 4)

    def members(batches, want: bool):
        for b in batches:
            hit = touched.value.has(b.column("h").to_numpy().view(np.uint64))
            b = b.filter(pa.array(hit == want))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([c for c, n in zip(b.columns, b.schema.names) if n != "h"], [n for n in b.schema.names if n != "h"])

    schema = schema_of([f for f in base.schema if f.name not in ("rid", "th", "text")], "n_bytes long, n_removed long, n_spans long, text binary")

    def cut(batches):
        for b in batches:
            size, removed, runs, left = [], [], [], []
            for t, s in zip(b.column("text"), b.column("spans")):
                t = t.as_py()
                s = sorted((x["start"], x["stop"]) for x in s.as_py() or ())
                out, at, n, gone = [], 0, 0, 0
                last = -1
                for a, z in s:
                    if a > last:
                        n += 1
                    if z > max(at, a):
                        out.append(t[at : max(at, a)])
                        gone += z - max(at, a)
                        at = z
                    last = max(last, z)
                out.append(t[at:])
                size.append(len(t))
                removed.append(gone)
                runs.append(n)
                left.append(b"".join(out))
            yield result(b, size, removed, runs, left)

    def result(b, size, removed, runs, left):
        others = [(c, n) for c, n in zip(b.columns, b.schema.names) if n not in ("rid", "th", "text", "spans")]
        return pa.RecordBatch.from_arrays([*(c for c, _ in others), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(left, pa.binary())], [*(n for _, n in others), "n_bytes", "n_removed", "n_spans", "text"])

    def whole(batches):
        """Texts that lose nothing."""
        for b in members(batches, False):
            texts = b.column("text").to_pylist()
            zeros = [0] * len(texts)
            yield result(b, [len(t) for t in texts], zeros, zeros, texts)

    probed = base.withColumn("h", F.xxhash64("rid", "th"))
    some = probed.mapInArrow(lambda it: members(it, True), base.schema).join(per_doc.hint("shuffle_hash"), ["rid", "th"], "left")
    return some.mapInArrow(cut, schema).unionByName(probed.mapInArrow(whole, schema))


def _members(packed: DataFrame, shards: int, max_bits: int):
    """A broadcast filter of all hashes in packed rows."""
    most = max(9, (max_bits // shards).bit_length() - 1)

    def build(t: pa.Table) -> pa.Table:
        h = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t["hashes"]]))
        out = Bits(Bits.log2_for(len(h), 16, most=most))
        out.add(h)
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), "log2": pa.array([out.log2], pa.int32()), "bits": pa.array([out.words.tobytes()], pa.binary())})

    rows = packed.groupBy("shard").applyInArrow(build, "shard int, log2 int, bits binary").collect()
    return packed.sparkSession.sparkContext.broadcast(RepeatFilter(shards, {r.shard: (r.log2, bytes(r.bits)) for r in rows}))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))

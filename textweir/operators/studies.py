"""Study pipelines: canonicality, triage, train-split check, cleaning simulation, membership size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textweir.errors import MissingDocumentError
from textweir.functions import rolling
from textweir.functions.text import squeeze, triage_tokens, word_count
from textweir.storage import materialize, small_batches

LEAKED, PARTIAL = (0.5, 5), (0.25, 2)
TERMINAL = "[.!?\"'”’]\\s*$"
NOT_CONTENT = r"(?i)^/(robots\.txt|sitemap[^/]*|favicon\.ico|feeds?|rss|atom)(/|$)"
#: Text of items that may be broadcast.
MOST_ITEM_BYTES = 256 << 20
#: Input bytes that a hash range of grams covers, and grams that a task packs at once.
SHARD_BYTES, FLUSH = 8 << 20, 1 << 21
#: A small list to reject pages by; callers bring their own.
BLOCKLIST = ("idiot", "moron", "worthless", "clown")


def registry(found: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """One row per (corpus, n) from exact summaries."""
    out = None
    for (corpus, n), row in found.items():
        r = row.select(F.lit(corpus).alias("corpus"), F.lit(n).cast("long").alias("n"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def pretraining_scan(docs: DataFrame, benchmarks: dict[str, DataFrame], out: str, ns=(10, 13), max_df: int = 5) -> DataFrame:
    """One pass per benchmark and n, never merged indexes; each pass's flagged items are written before the next begins.

    A pass whose result is there is not run again, so a long scan goes on where it
    stopped. Returns benchmark, n, item_id, docs (those that hold it) of all passes.
    """
    from textweir.operators.exact import raw_hits, runs, with_item_ids
    from textweir.operators.index import build_index

    spark = docs.sparkSession
    jvm = spark._jvm
    done = None
    for name, items in benchmarks.items():
        for n in ns:
            path = jvm.org.apache.hadoop.fs.Path(f"{out}/benchmark={name}/n={n}")
            if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                i = build_index(items, n)
                live = with_item_ids(runs(raw_hits(docs, i), i, max_df=max_df).filter("survives"), i)
                live.groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs")).write.mode("overwrite").parquet(path.toString())
            got = spark.read.parquet(path.toString()).select(F.lit(name).alias("benchmark"), F.lit(n).cast("long").alias("n"), "item_id", "docs")
            done = got if done is None else done.unionByName(got)
    return done


def recall_sweep(docs: DataFrame, items: DataFrame, ns=(8, 10, 13), strides=(1, 2, 4), **options) -> list[dict]:
    """Planted recall, verbatim and edited, over n (stride 1) and over strides (n 10), with and without the filter of common grams."""
    grid = [(n, 1, True) for n in ns] + [(10, s, True) for s in strides if s > 1] + [(10, 1, False)]
    return [planted_recall(docs, items, n, s, edited, discriminative=keep, **options) | {"edited": edited, "discriminative": keep} for n, s, keep in grid for edited in (False, True)]


def canonical(hits: DataFrame, least: int = 2) -> DataFrame:
    """item_id and the number of corpora (``source``) that hold it, from ``least`` on."""
    return hits.groupBy("item_id").agg(F.count_distinct("source").alias("sources"), F.count_distinct("doc_id").alias("docs")).filter(F.col("sources") >= least)


def flagged_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """item_id and whether both corpora, or only the first or second, flag it."""
    both = a.intersect(b).select("item_id", F.lit("both").alias("side"))
    return both.unionByName(a.exceptAll(b).select("item_id", F.lit("first").alias("side"))).unionByName(b.exceptAll(a).select("item_id", F.lit("second").alias("side")))


def longest_runs(pairs: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_tokens, run: the longest common run of triage tokens.

    Equal tokens meet on (pair, token) and are grouped by diagonal; no table of
    all positions against all positions is made.
    """
    p = materialize(pairs.select("doc_id", "item_id").distinct())
    held = docs.select("doc_id", "text").join(p.select("doc_id").distinct(), "doc_id", "left_semi")
    held = materialize(held.select("doc_id", triage_tokens("text").alias("t")))
    d = held.select("doc_id", F.posexplode("t").alias("dp", "tok"))
    i = items.select("item_id", F.posexplode(triage_tokens("text")).alias("ip", "tok"))
    n = items.select("item_id", F.size(triage_tokens("text")).cast("long").alias("item_tokens"))
    if not p.join(held.select("doc_id"), "doc_id", "left_anti").isEmpty():
        raise MissingDocumentError("evidence names a document that the corpus does not hold")
    m = p.join(i, "item_id").join(d, ["doc_id", "tok"])
    w = Window.partitionBy("doc_id", "item_id", (F.col("dp") - F.col("ip"))).orderBy("ip")
    m = m.withColumn("island", F.col("ip") - F.row_number().over(w)).withColumn("diag", F.col("dp") - F.col("ip"))
    best = m.groupBy("doc_id", "item_id", "diag", "island").agg(F.count("*").alias("run")).groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))
    return p.join(best, ["doc_id", "item_id"], "left").join(n, "item_id").select("doc_id", "item_id", "item_tokens", F.coalesce("run", F.lit(0)).alias("run"))


def triage(longest: DataFrame, n: int) -> DataFrame:
    """item_id, doc_id of the longest run, coverage, excess over the flagging gram, verdict."""
    best = longest.groupBy("item_id").agg(F.max(F.struct("run", (-F.col("doc_id")).alias("d"))).alias("b"), F.max("item_tokens").alias("item_tokens"))
    x = best.select("item_id", (-F.col("b.d")).alias("doc_id"), F.col("b.run").alias("run"), "item_tokens")
    cover, excess = F.col("run") / F.col("item_tokens"), F.col("run") - n
    verdict = F.when((cover >= LEAKED[0]) & (excess >= LEAKED[1]), "leaked").when((cover >= PARTIAL[0]) & (excess >= PARTIAL[1]), "partial").otherwise("phrase")
    return x.select("item_id", "doc_id", "run", "item_tokens", cover.alias("coverage"), excess.alias("excess"), verdict.alias("verdict"))


def contains_items(evidence: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) whose squeezed text holds the whole squeezed item; documents of the evidence only."""
    docs_seen = docs.select("doc_id", "text").join(evidence.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = items.select("item_id", squeeze("text").alias("i")).filter(F.length("i") > 0)
    whole = rows.select(F.sum(F.octet_length("i"))).collect()[0][0] or 0
    d = docs_seen.select("doc_id", squeeze("text").alias("d"))
    rows = F.broadcast(rows) if whole <= MOST_ITEM_BYTES else rows
    return d.join(rows, F.contains("d", "i")).select("doc_id", "item_id")


def cleaning(docs: DataFrame, blocklist=BLOCKLIST) -> DataFrame:
    """doc_id, reason (kept if none applies), usable_lines, words: first reason that holds."""
    low = F.lower("text")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(TERMINAL) & (word_count(x) >= 3) & ~F.contains(F.lower(x), F.lit("javascript")))
    bad = "(?<![a-z])(?:" + "|".join(sorted(blocklist, key=lambda w: (-len(w), w))) + ")(?![a-z])"
    reason = F.when(F.contains("text", F.lit("{")), "curly brace").when(F.contains(low, F.lit("lorem ipsum")), "lorem ipsum").when(low.rlike(bad), "blocklisted word").when(F.size(lines) < 5, "too few usable lines").otherwise("kept")
    return docs.select("doc_id", reason.alias("reason"), F.size(lines).cast("long").alias("usable_lines"), word_count("text").cast("long").alias("words"))


def is_content(url, status, mime):
    """A capture of a page someone wrote: 200, HTML, a path that is neither protocol nor root."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return (status == "200") & F.coalesce(mime, F.lit("")).rlike("(?i)^text/html") & ~path.rlike(NOT_CONTENT) & (F.regexp_replace(path, "/+$", "") != "")


def outcome(mode, source_content, newest_content):
    domain = F.when((source_content > 0) | (newest_content > 0), "screen-urls").otherwise("skip-platform")
    exact = F.when(source_content > 0, "recruit").when(newest_content > 0, "recruit-with-caveat").otherwise("do-not-recruit")
    return F.when(mode == "domain", domain).otherwise(exact)


def _first_marks(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, each with its least mark."""
    if not len(keys) or marks.min() == marks.max():
        u = np.unique(keys)
        return u, np.full(len(u), marks[0] if len(marks) else 0, np.uint8)
    order = np.lexsort((marks, keys))
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return keys[new], marks[order][new]


def gram_cells(docs: DataFrame, n: int, mark, tally) -> DataFrame:
    """cell, total, distinct_grams: ``tally`` (an array of counts) of all grams and of the distinct ones.

    ``mark(ids)`` gives a byte for each document, a distinct gram has the least of its
    documents'. Distinct keys travel packed by hash range, one row a range and flush;
    a range covers about SHARD_BYTES of input, so one fits a worker at any size.
    """
    small_batches(docs.sparkSession)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = size // SHARD_BYTES if size < 1 << 50 else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(20, max(3, ranges.bit_length()))
    names = ["shard", "keys", "marks"]

    def pack(batches):
        held, size, totals = [], 0, tally(np.empty(0, np.int64), np.empty(0, np.uint8))

        def flush():
            keys, marks = (np.concatenate(x) for x in zip(*held))
            held.clear()
            counts = tally(keys.view(np.int64), marks)
            keys, marks = _first_marks(keys, marks)
            cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            at = np.flatnonzero(np.diff(cut)).tolist()
            rows = [(s, keys[cut[s] : cut[s + 1]].tobytes(), marks[cut[s] : cut[s + 1]].tobytes()) for s in at]
            return counts, rows

        def out(rows):
            rows = rows or [(-1, np.zeros(len(totals), np.int64).tobytes(), b"")]  # no text was long enough
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names)

        for b in batches:
            of = mark(b.column(0))
            for at, texts in rolling.chunks(b.column(1)):
                text, _, keys, _ = rolling.grams(texts, n)
                held.append((keys.view(np.uint64), of[text + at]))
                size += len(keys)
                if size >= FLUSH:
                    counts, rows = flush()
                    totals, size = totals + counts, 0
                    yield out(rows)
        if held:
            counts, rows = flush()
            totals = totals + counts
            yield out(rows)
        yield out([(-1, np.asarray(totals, np.int64).tobytes(), b"")])

    def count(table):
        if table["shard"][0].as_py() < 0:
            total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["keys"])
            each = np.zeros(len(total), np.int64)
        else:
            keys, marks = _first_marks(*(np.concatenate([np.frombuffer(x.as_py(), t) for x in table[c]]) for c, t in (("keys", np.uint64), ("marks", np.uint8))))
            each = np.asarray(tally(keys.view(np.int64), marks), np.int64)
            total = np.zeros(len(each), np.int64)
        return pa.table({"cell": pa.array(np.arange(len(each)), pa.int32()), "total": pa.array(total), "distinct_grams": pa.array(each)})

    packed = docs.select("doc_id", "text").mapInArrow(pack, "shard int, keys binary, marks binary")
    return packed.groupBy("shard").applyInArrow(count, "cell int, total long, distinct_grams long").groupBy("cell").agg(F.sum("total").alias("total"), F.sum("distinct_grams").alias("distinct_grams"))


def heaps_points(docs: DataFrame, n: int, checkpoints: list[int]) -> DataFrame:
    """checkpoint, total, distinct grams among the documents of lesser id; both are counted per bucket of ids before anything is cumulated."""
    bounds = np.array(checkpoints, np.int64)

    def mark(ids):
        return np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), side="right").astype(np.uint8)

    def tally(keys, marks):
        return np.bincount(marks, minlength=len(bounds))

    spark = docs.sparkSession
    points = spark.createDataFrame(list(enumerate(checkpoints)), "cell int, checkpoint long")
    x = points.join(gram_cells(docs.filter("doc_id is not null"), n, mark, tally), "cell", "left")
    w = Window.orderBy("cell")
    return x.select("checkpoint", *[F.sum(F.coalesce(c, F.lit(0))).over(w).alias(c) for c in ("total", "distinct_grams")])


def heaps_fit(points: DataFrame) -> DataFrame:
    """k and beta of distinct = k * total ** beta, by least squares on logarithms."""
    x, y = F.log("total"), F.log("distinct_grams")
    return points.filter("distinct_grams > 0").agg(F.regr_slope(y, x).alias("beta"), F.exp(F.regr_intercept(y, x)).alias("k"))


def winnowed(keys: DataFrame, rates=(1, 16, 64, 256)) -> DataFrame:
    """rate, grams, distinct grams whose key is a multiple of the rate."""
    per = keys.groupBy("key").agg(F.count("*").alias("c"))
    cells = [F.struct(F.lit(r).cast("long").alias("rate"), F.count_if(F.pmod("key", F.lit(r)) == 0).alias("distinct_grams"), F.coalesce(F.sum(F.when(F.pmod("key", F.lit(r)) == 0, F.col("c"))), F.lit(0)).alias("grams")) for r in rates]
    return per.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def winnow_sizes(docs: DataFrame, n: int, rates=(1, 16, 64, 256)) -> DataFrame:
    """``winnowed`` of all grams of the documents."""

    def mark(ids):
        return np.zeros(len(ids), np.uint8)

    def tally(keys, marks):
        return np.array([np.count_nonzero(keys % r == 0) for r in rates], np.int64)

    names = docs.sparkSession.createDataFrame(list(enumerate(rates)), "cell int, rate long")
    x = names.join(gram_cells(docs, n, mark, tally), "cell", "left")
    return x.select("rate", *[F.coalesce(c, F.lit(0)).alias(k) for c, k in (("distinct_grams", "distinct_grams"), ("total", "grams"))])


def bloom_bits(distinct: float, rate: float) -> int:
    """Bits of a Bloom filter at a false-positive rate."""
    return math.ceil(distinct * math.log2(1 / rate) / math.log(2))


def detection_probability(words: int, rate: int, n: int = 10) -> float:
    """Chance that a copied passage of so many words keeps a gram after winnowing."""
    grams = max(0, words - n + 1)
    return float(grams > 0) if rate == 1 else 1 - (1 - 1 / rate) ** grams


def straight_quotes(docs: DataFrame) -> DataFrame:
    """Typographic apostrophes made plain, as a study of what the tokenizer misses."""
    return docs.withColumn("text", F.translate("text", "’‘", "''"))


def perturb(text: str, draw, drop: float = 1 / 11, insert: float = 1 / 17) -> str:
    """Words dropped and filler put in, by independent draws."""
    out = []
    for w in text.split():
        if draw() < drop:
            continue
        out.append(w)
        if draw() < insert:
            out.append("really" if draw() < 0.5 else "actually")
    return " ".join(out)


def planted_recall(docs: DataFrame, items: DataFrame, n: int, stride: int = 1, edited: bool = False, seed: int = 3085, **options) -> dict:
    """Plant every item in a host document and report the share found again."""
    from textweir.functions.hashing import Mulberry
    from textweir.operators.exact import raw_hits, runs
    from textweir.operators.index import build_index

    spark = docs.sparkSession
    hosts = [r.text for r in docs.orderBy("doc_id").limit(50).collect()]
    rows = items.select("item_id", "text").orderBy("item_id").collect()
    planted = [(i, f"{hosts[i % len(hosts)]} {perturb(r.text, Mulberry(seed + i)) if edited else r.text} {hosts[(i + 7) % len(hosts)]}") for i, r in enumerate(rows)]
    index = build_index(items, n, stride, **options)
    corpus = spark.createDataFrame(planted, "doc_id long, text string")
    got = runs(raw_hits(corpus, index), index, stride).filter("survives").select("item_idx").distinct().count()
    checkable = index.rows.select("item_idx").distinct().count()
    return {"n": n, "stride": stride, "planted": len(rows), "checkable": checkable, "found": got, "recall": got / checkable if checkable else None}

"""Exact tier: verbatim overlaps, merged to runs and judged by document frequency.

The corpus is read once: an Arrow function tokenises it and probes the broadcast
index, and the hits, which are few, are written. Everything after works on hits.
No gram is a hot key: frequencies are partial counts, and of a gram's documents
only the first ``max_df`` matter, which a group limit keeps on the map side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweir.functions import rolling
from textweir.functions.text import scan_tokens
from textweir.operators.index import BROADCAST_ROWS, Index, grams
from textweir.storage import materialize, small_batches

MAX_DOC_FREQUENCY = 5
KEYS_PER_RUN = 256
CONTEXT = 12


_HITS = "item_idx int, off int, key long"


def _probe(docs: DataFrame, index: Index, totals: bool) -> DataFrame:
    """Hits, and with ``totals`` a row a batch without an item: documents in ``off``, tokens in ``key``."""
    shared, n, make = index.broadcast(), index.n, index.make
    small_batches(docs.sparkSession)
    names = ["doc_id", *(x.split()[0] for x in _HITS.split(", "))]

    def run(batches):
        for b in batches:
            kind = b.schema.field(0).type
            for at, texts in rolling.chunks(b.column(1)):
                text, off, keys, tokens = make(texts, n)
                place, owner = shared.value.probe(keys)
                if len(place):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text[place] + at)), pa.array(owner), pa.array(off[place].astype("int32")), pa.array(keys[place])], names)
                if totals:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.array([len(texts)], pa.int32()), pa.array([tokens])], names)

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(_HITS).fields]))


def raw_hits(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, item_idx, off, key of every corpus gram in the index; ``doc_id`` is also the document's place."""
    if index.broadcast() is None:
        return grams(docs, index.n, make=index.make).join(index.rows, "key").select("doc_id", "item_idx", "off", "key")
    return _probe(docs, index, False)


def scan(docs: DataFrame, index: Index) -> tuple[DataFrame, dict]:
    """Written hits and the totals (documents, tokens) of the corpus, from one pass over it."""
    if index.broadcast() is None:
        n = docs.select(F.lit(1).alias("d"), F.size(scan_tokens(F.coalesce("text", F.lit("")))).alias("t")).agg(F.sum("d").alias("documents"), F.sum("t").alias("tokens"))
        return materialize(raw_hits(docs, index)), n.na.fill(0).collect()[0].asDict()
    found = materialize(_probe(docs, index, True))
    total = found.filter("item_idx is null").agg(F.coalesce(F.sum("off"), F.lit(0)).alias("documents"), F.coalesce(F.sum("key"), F.lit(0)).alias("tokens"))
    return found.filter("item_idx is not null"), total.collect()[0].asDict()


def document_frequency(hits: DataFrame) -> DataFrame:
    """key and the number of documents that hold it; distinct pairs first, so no key is hot."""
    return hits.select("key", "doc_id").distinct().groupBy("key").agg(F.count("*").alias("df"))


def frequencies(hits: DataFrame, max_df: int) -> DataFrame:
    """key, df, and the last document at whose arrival the key was still rare (documents arrive in the order of doc_id)."""
    pairs = hits.select("key", "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    first = pairs.withColumn("place", place).filter(F.col("place") <= max_df).groupBy("key").agg(F.max("doc_id").alias("last_rare"))
    return document_frequency(hits).join(first, "key")


def runs(hits: DataFrame, index: Index, stride: int = 1, max_df: int = MAX_DOC_FREQUENCY, order_free: bool = False) -> DataFrame:
    """One row per maximal run: doc_id, item_idx, start, stop (tokens), grams, min_df, truncated, early_rare, survives.

    A run goes on while the next gram starts at most ``stride`` tokens later. It
    lives if some retained gram occurs in at most ``max_df`` documents, or if it
    had more than ``KEYS_PER_RUN`` distinct grams that were still rare when the
    document arrived. ``order_free`` judges by final frequencies alone.
    """
    hits = materialize(hits)
    return judged(hits, frequencies(hits, max_df), index, stride, max_df, order_free)


def judged(hits: DataFrame, seen: DataFrame, index: Index, stride: int, max_df: int, order_free: bool = False) -> DataFrame:
    """``runs`` for frequencies that are known: key, df, last_rare, one row a key of the index at most."""
    h = hits.join(F.broadcast(seen) if index.rows.count() <= BROADCAST_ROWS else seen, "key").withColumn("rare", F.col("doc_id") <= F.col("last_rare"))
    w = Window.partitionBy("doc_id", "item_idx").orderBy("off")
    gap = F.coalesce((F.col("off") > F.lag("off").over(w) + stride).cast("int"), F.lit(0))
    h = h.withColumn("gap", gap).withColumn("run", F.sum("gap").over(w))
    in_run = Window.partitionBy("doc_id", "item_idx", "run")
    first = F.row_number().over(Window.partitionBy("doc_id", "item_idx", "run", "key").orderBy("off")) == 1
    h = h.withColumn("fresh", (first & F.col("rare")).cast("int"))
    before = F.coalesce(F.sum("fresh").over(in_run.orderBy("off").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = h.withColumn("full", before >= KEYS_PER_RUN)
    kept = F.when(F.col("rare") & ~F.col("full"), F.col("df"))
    out = h.groupBy("doc_id", "item_idx", "run").agg(
        F.min("off").cast("long").alias("start"),
        (F.max("off") + index.n).cast("long").alias("stop"),
        F.count("*").alias("grams"),
        F.min("df").alias("min_df"),
        F.min(kept).alias("kept_df"),
        F.bool_or(F.col("rare") & F.col("full")).alias("truncated"),
        F.bool_or("rare").alias("early_rare"),
    )
    alive = F.col("min_df") <= max_df if order_free else F.col("truncated") | F.coalesce(F.col("kept_df") <= max_df, F.lit(False))
    return out.withColumn("survives", alive).drop("run", "kept_df")


def dropped(all_runs: DataFrame) -> DataFrame:
    """Runs judged ordinary language, with the frequency that condemned each: its rarest gram's."""
    return all_runs.filter("not survives").select("doc_id", "item_idx", "start", "stop", "grams", F.col("min_df").alias("condemned_by"), (~F.col("early_rare")).alias("certain_on_arrival"))


def evidence(survivors: DataFrame, docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Matched text and ``context`` tokens on either side, cut from the original text of surviving documents only."""
    rx = r"[\p{L}\p{N}'&&[\x{0}-\x{FFFF}]]+"
    d = docs.join(survivors.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.regexp_extract_all("text", F.lit(rx), F.lit(0)).alias("t"), F.split("text", rx, -1).alias("s"))
    x = survivors.join(d, "doc_id")

    def words(a, z):
        """Tokens a..z-1 (from 0) with the separators between them."""
        return F.array_join(F.transform(F.sequence(a, z - 1), lambda i: F.concat(F.when(i == a, F.lit("")).otherwise(F.get("s", i)), F.get("t", i))), "")

    start, stop, size = F.col("start").cast("int"), F.col("stop").cast("int"), F.size("t")
    lo, hi = F.greatest(start - context, F.lit(0)), F.least(stop + context, size)
    before = F.when(lo < start, F.concat(words(lo, start), F.get("s", start))).otherwise("")
    after = F.when(stop < hi, F.concat(F.get("s", stop), words(stop, hi))).otherwise("")
    return x.select("doc_id", "item_idx", "start", "stop", "min_df", words(start, stop).alias("matched"), before.alias("before"), after.alias("after"))


def summary(all_runs: DataFrame, index: Index) -> DataFrame:
    """items_hit, items_total, hits, dropped_generic, docs_hit in one row."""
    live = F.col("survives")
    return all_runs.agg(F.count_distinct(F.when(live, F.col("item_idx"))).alias("items_hit"), F.count_if(live).alias("hits"), F.count_if(~live).alias("dropped_generic"), F.count_distinct(F.when(live, F.col("doc_id"))).alias("docs_hit")).crossJoin(index.items.agg(F.count("*").alias("items_total")))


def with_item_ids(df: DataFrame, index: Index) -> DataFrame:
    return df.join(F.broadcast(index.items.select("item_idx", "item_id")), "item_idx").drop("item_idx")

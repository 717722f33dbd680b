"""N-gram index of a benchmark: which items own which gram.

The benchmark is small by definition and the corpus is not, so the index is what
gets broadcast, as sorted arrays. Its size is checked: above ``BROADCAST_ROWS`` the
corpus's grams meet it in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweir.errors import EmptyBenchmarkError, ThresholdError
from textweir.functions import rolling
from textweir.functions.text import scan_tokens, unsegmented_share
from textweir.storage import small_batches

N_DEFAULT, N_LEAST, N_MOST = 10, 8, 13
MAX_ITEMS = 3
STOP_SIZE, STOP_SHARE, STOP_ITEMS = 200, 0.5, 4
#: Index rows (about 20 bytes each) that may be broadcast.
BROADCAST_ROWS = 5_000_000


def grams(df: DataFrame, n: int, key: str = "doc_id", make=rolling.grams) -> DataFrame:
    """(``key``, off, key): one row per window of n scan tokens of ``text``. Narrow; texts don't travel with the grams."""
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            for at, texts in rolling.chunks(b.column(1)):
                text, off, keys, _ = make(texts, n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text + at)), pa.array(off.astype(np.int32)), pa.array(keys)], [key, "off", "key"])

    return df.select(key, "text").mapInArrow(run, T.StructType([df.schema[key], *T.StructType.fromDDL("off int, key long").fields]))


def tokenised_items(items: DataFrame) -> DataFrame:
    """item_idx (order of item_id), item_id, text, tokens."""
    x = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return x.withColumn("tokens", scan_tokens("text")).withColumn("item_idx", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("int"))


def stoplist(tokenised: DataFrame) -> DataFrame:
    """token, uses, items: in at least half of the items, the 200 most used; ties by first use."""
    t = tokenised.select("item_idx", F.posexplode("tokens").alias("pos", "token"))
    total = tokenised.agg(F.count("*").alias("total"))
    by = t.groupBy("token").agg(F.count("*").alias("uses"), F.count_distinct("item_idx").alias("items"), F.min(F.struct("item_idx", "pos")).alias("first"))
    return by.crossJoin(F.broadcast(total)).filter((F.col("total") >= STOP_ITEMS) & (F.col("items") >= STOP_SHARE * F.col("total"))).orderBy(F.desc("uses"), "first").limit(STOP_SIZE).select("token", "uses", "items")


class Index:
    """``rows`` (key, item_idx), ``items``, and the counters of what was left out; ``make`` gives the keys of texts' grams."""

    def __init__(self, items, rows, n, stats, stop, make=rolling.grams, stride=1):
        self.items, self.rows, self.n, self.stats, self.stop, self.make, self.stride = items, rows, n, stats, stop, make, stride
        self._shared = None

    @classmethod
    def from_file(cls, spark, meta: dict, owners: dict[int, list[int]]) -> "Index":
        """An index read from a file: ids without texts, and the file's own gram keys."""
        ids = list(enumerate(meta["itemIds"]))
        items = spark.createDataFrame([(i, str(x)) for i, x in ids], "item_idx int, item_id string")
        rows = spark.createDataFrame(pa.table({"key": pa.array([k for k, o in owners.items() for _ in o], pa.int64()), "item_idx": pa.array([i for o in owners.values() for i in o], pa.int32())}))
        stats = spark.createDataFrame([tuple(meta["stats"].values())], ", ".join(f"{k} long" for k in meta["stats"]))
        out = cls(items, rows, meta["n"], stats, None, rolling.file_grams, meta.get("stride", 1))
        blind, unsegmented = meta.get("uncheckableItemIds", []), set(meta.get("unsegmentedItemIds", []))
        out._blind = spark.createDataFrame([(str(x), None, x in unsegmented) for x in blind], "item_id string, n_tokens long, unsegmented boolean")
        return out

    def uncheckable(self) -> DataFrame:
        """Items without any gram in the index, and whether that is for want of word separators."""
        if hasattr(self, "_blind"):
            return self._blind
        missing = self.items.join(self.rows.select("item_idx").distinct(), "item_idx", "left_anti")
        return missing.select("item_id", F.size("tokens").cast("long").alias("n_tokens"), (unsegmented_share("text") >= 0.5).alias("unsegmented"))

    def broadcast(self):
        """The whole index as sorted arrays on every worker, or None if it is too large for that."""
        if self._shared is None and self.rows.count() <= BROADCAST_ROWS:
            t = self.rows.select("key", "item_idx").toArrow()
            self._shared = self.items.sparkSession.sparkContext.broadcast(rolling.Lookup(t["key"].to_numpy(), t["item_idx"].to_numpy()))
        return self._shared


def _item_grams(t: DataFrame, n: int, stop: list[str]) -> DataFrame:
    """item_idx, off, key, dull (stop words alone)."""

    def run(batches):
        known = np.sort(rolling.token_hashes(stop)[0])
        for b in batches:
            for at, texts in rolling.chunks(b.column(1)):
                tokens, counts = rolling.token_hashes(texts)
                text, off, keys = rolling.gram_keys(tokens, counts, n)
                plain = np.concatenate([[0], np.cumsum(~np.isin(tokens, known))])
                first = off + (np.cumsum(counts) - counts)[text]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text + at)), pa.array(off.astype(np.int32)), pa.array(keys), pa.array(plain[first + n] == plain[first])], ["item_idx", "off", "key", "dull"])

    return t.select("item_idx", "text").mapInArrow(run, "item_idx int, off int, key long, dull boolean")


def build_index(items: DataFrame, n: int = N_DEFAULT, stride: int = 1, max_items: int | None = MAX_ITEMS, stop_filter: bool = True, discriminative: bool = True) -> Index:
    """Grams of all items, one row per gram and owner, in the order: stride, stopwords, owners."""
    if not N_LEAST <= n <= N_MOST or stride < 1:
        raise ThresholdError(f"n must be {N_LEAST}..{N_MOST} and stride at least 1")
    t = tokenised_items(items).cache()
    if t.isEmpty():
        raise EmptyBenchmarkError("no item to index")
    stop = stoplist(t).cache()
    g = _item_grams(t, n, [r.token for r in stop.collect()]).cache()  # at most STOP_SIZE stop words
    strided = g.filter(F.col("off") % stride == 0)
    good = strided.filter(~F.col("dull")) if stop_filter else strided
    own = good.select("item_idx", "key").distinct()
    owners = own.groupBy("key").agg(F.count("*").alias("owners"))
    kept = owners.filter(F.col("owners") <= max_items) if discriminative and max_items else owners
    rows = own.join(kept.select("key"), "key").cache()
    stats = (
        t.agg(F.count("*").alias("item_count"))
        .crossJoin(g.agg(F.count("*").alias("grams_seen"), F.count_if(F.col("off") % stride != 0).alias("dropped_stride")))
        .crossJoin(strided.agg((F.count_if("dull") if stop_filter else F.lit(0).cast("long")).alias("dropped_stop")))
        .crossJoin(owners.agg(F.count("*").alias("distinct_grams")))
        .crossJoin(kept.agg(F.count("*").alias("grams_kept")))
        .crossJoin(own.agg(F.count("*").alias("item_grams")))
        .select("item_count", "grams_seen", "dropped_stride", "dropped_stop", "item_grams", "distinct_grams", "grams_kept", (F.col("distinct_grams") - F.col("grams_kept")).alias("dropped_common"))
    )
    return Index(t, rows, n, stats, stop, stride=stride)


def serialise(index: Index) -> DataFrame:
    """key and its owners, as a sorted array; at most ``max_items`` owners a key."""
    return index.rows.groupBy("key").agg(F.array_sort(F.collect_list("item_idx")).alias("owners"))

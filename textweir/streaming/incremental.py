"""Incremental scan of a growing corpus with Structured Streaming.

A later document can retract an earlier finding (its grams become common), so no
verdict is final. State is one row a gram that was met (its document frequency and
first ``max_df`` documents), so the benchmark bounds it. A micro-batch merges its
own counts into that, and judges again only the documents it brought and those
among the first of its grams: others can't change. Hits, states and findings are
written by epoch; an epoch counts once its mark is there, so readers never see
half of it, and a batch that is replayed overwrites its own partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textweir.operators.exact import MAX_DOC_FREQUENCY, judged, raw_hits
from textweir.operators.index import Index


def _done(spark: SparkSession, out: str) -> list[int]:
    """Epochs that are complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/done")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName().removeprefix("epoch=")) for x in fs.listStatus(path)) if fs.exists(path) else []


def _state(pairs: DataFrame, max_df: int) -> DataFrame:
    """key, df and the first documents of distinct (key, doc_id)."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    first = pairs.withColumn("place", place).filter(F.col("place") <= max_df).groupBy("key").agg(F.array_sort(F.collect_list("doc_id")).alias("first"))
    return pairs.groupBy("key").agg(F.count("*").alias("df")).join(first, "key")


def findings(spark: SparkSession, out: str) -> DataFrame:
    """The runs of all documents as last judged; frequencies of runs dropped long ago are those of that time."""
    epochs = _done(spark, out)
    runs = spark.read.parquet(f"{out}/runs").filter(F.col("epoch").isin(epochs))
    last = spark.read.parquet(f"{out}/judged").filter(F.col("epoch").isin(epochs)).groupBy("doc_id").agg(F.max("epoch").alias("epoch"))
    return runs.join(last, ["doc_id", "epoch"]).drop("epoch")


def watch(documents: DataFrame, index: Index, out: str, checkpoint: str, max_df: int = MAX_DOC_FREQUENCY, trigger: dict | None = None):
    """Start the query: ``documents`` streams (doc_id, text), each document once; ``findings`` reads what it found so far."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession

        def put(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
            return spark.read.schema(df.schema).parquet(f"{out}/{name}/epoch={epoch}")

        before = [e for e in _done(spark, out) if e < epoch]
        hits = put(raw_hits(batch, index), "hits")
        mine = _state(hits.select("key", "doc_id").distinct(), max_df)
        if before:
            old = spark.read.parquet(f"{out}/state/epoch={before[-1]}").select("key", F.col("df").alias("df0"), F.col("first").alias("first0"))
            none = F.array().cast(mine.schema["first"].dataType)
            both = mine.join(old, "key", "full")
            touched = F.col("df").isNotNull()
            state = both.select("key", (F.coalesce("df", F.lit(0)) + F.coalesce("df0", F.lit(0))).alias("df"), F.slice(F.array_sort(F.concat(F.coalesce("first", none), F.coalesce("first0", none))), 1, max_df).alias("first"), F.when(touched, F.coalesce("first0", none)).otherwise(none).alias("again"))
        else:
            state = mine.select("key", "df", "first", F.array().cast(mine.schema["first"].dataType).alias("again"))
        state = put(state, "state")
        docs = put(hits.select("doc_id").union(state.select(F.explode("again"))).distinct(), "judged")
        known = spark.read.schema(hits.schema).parquet(*[f"{out}/hits/epoch={e}" for e in [*before, epoch]])
        seen = state.select("key", "df", F.element_at("first", -1).alias("last_rare"))
        put(judged(known.join(docs, "doc_id", "left_semi"), seen, index, index.stride, max_df), "runs")
        put(spark.range(1), "done")

    writer = documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

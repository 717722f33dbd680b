"""Baselines from seeded subsamples, and the position of a batch between two of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.errors import BatchTooSmallError, NotFiniteError
from textweir.functions.hashing import Mulberry
from textweir.storage import materialize, numbered

SPLIT_SEED, DRAW_SEED, CHUNK, DRAWS = 0x5B117, 0xBA5E0000, 1000, 20
LEAST_RECORDS, LEAST_SEPARATION, MARGIN, MOST_WEIGHT = 30, 0.25, 0.5, 6.0
SIZE_SENSITIVE = ("lexical_cluster", "lexical_variety", "near_dup")


def shuffled(n: int, seed: int) -> np.ndarray:
    """Seeded Fisher-Yates over places; sequential by nature, so over numbers on the driver (8 bytes each)."""
    draw, x = Mulberry(seed), np.arange(n)
    for i in range(n - 1, 0, -1):
        j = int(draw() * (i + 1))
        x[i], x[j] = x[j], x[i]
    return x


def drawn(n: int, size: int, seed: int) -> list[int]:
    """``size`` distinct places out of n; only places that were moved are held."""
    draw, moved, out = Mulberry(seed), {}, []
    for i in range(size):
        j = i + int(draw() * (n - i))
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return out


def split_corpus(records: DataFrame, seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """Calibration and held-out halves; a sampling operator for reference corpora of up to a few million records."""
    x = numbered(records, "id").cache()
    n = x.count()
    first = records.sparkSession.createDataFrame([(int(k),) for k in shuffled(n, seed)[: n // 2]], "k long")
    return x.join(first, "k", "left_semi").drop("k"), x.join(first, "k", "left_anti").drop("k")


def build_baseline(records: DataFrame, signals, chunk: int = CHUNK, draws: int = DRAWS) -> DataFrame:
    """key, mean, sd, n of each signal over seeded subsamples; ``signals`` maps records to (key, value)."""
    x = numbered(records, "id").cache()
    n = x.count()
    if n < 1.5 * chunk:
        raise BatchTooSmallError(f"{n} records, {int(1.5 * chunk)} are needed")
    spark, out = records.sparkSession, None
    for d in range(draws):
        pick = spark.createDataFrame([(k,) for k in drawn(n, chunk, DRAW_SEED + d)], "k long")
        got = materialize(signals(x.join(F.broadcast(pick), "k", "left_semi").drop("k")).select("key", "value"))
        out = got if out is None else out.unionByName(got)
    return summarise(out)


def summarise(values: DataFrame) -> DataFrame:
    g = values.filter("value is not null").groupBy("key").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    return g.filter("n >= 3")


def score_signals(values: DataFrame, human: DataFrame, machine: DataFrame, records: int, chunk: int = CHUNK) -> DataFrame:
    """Each signal with z, separation, likeness, weight, and why it is left out (first reason that holds)."""
    x = values.join(human.select("key", F.col("mean").alias("h"), F.col("sd").alias("h_sd")), "key", "left").join(machine.select("key", F.col("mean").alias("m"), F.col("sd").alias("m_sd")), "key", "left")
    ratio = records / chunk
    delta = F.col("m") - F.col("h")
    sep = F.abs(delta) / F.nullif("h_sd", F.lit(0.0))
    like = (F.col("value") - F.col("h")) / F.nullif(delta, F.lit(0.0))
    reason = (
        F.when(F.col("value").isNull(), "unavailable")
        .when(F.col("h").isNull() | F.col("m").isNull(), "no baseline")
        .when(F.col("key").isin(*SIZE_SENSITIVE) & F.lit(ratio > 2 or ratio < 0.5), "batch size")
        .when((F.col("h_sd") <= 0) | (F.col("m_sd") <= 0), "zero variance")
        .when(sep.isNull() | (sep < LEAST_SEPARATION), "too close")
        .when(like.isNull(), "not finite")
        .when((like < -MARGIN) | (like > 1 + MARGIN), "out of range")
    )
    z = (F.col("value") - F.col("h")) / F.nullif("h_sd", F.lit(0.0))
    return x.select("key", "value", z.alias("z"), sep.alias("separation"), like.alias("likeness"), F.least(sep, F.lit(MOST_WEIGHT)).alias("weight"), reason.alias("skip_reason"), reason.isNull().alias("used"))


def score(scored: DataFrame, records: int) -> DataFrame:
    """purity, confidence, verdict and the number of signals used, in one row."""
    if records < LEAST_RECORDS:
        raise BatchTooSmallError(f"{records} records, {LEAST_RECORDS} are needed")
    used = F.when(F.col("used"), F.col("weight"))
    one = scored.agg(F.count_if("used").alias("n_used"), (F.sum(used * F.least(F.greatest("likeness", F.lit(0.0)), F.lit(1.0))) / F.sum(used)).alias("like"), F.coalesce(F.sum(F.when(F.col("used"), F.col("separation"))), F.lit(0.0)).alias("separation"))
    purity = F.floor((1 - F.col("like")) * 100 + 0.5)
    level = F.when((F.col("n_used") >= 3) & (F.col("separation") >= 4) & F.lit(records >= 200), "high").when((F.col("n_used") >= 2) & (F.col("separation") >= 2) & F.lit(records >= 60), "medium").otherwise("low")
    verdict = F.when(F.col("n_used") == 0, "not comparable").when(purity >= 85, "human").when(purity >= 65, "mostly human").when(purity >= 40, "between").otherwise("machine")
    return one.select(F.when(F.col("n_used") > 0, purity).alias("purity"), level.alias("confidence"), verdict.alias("verdict"), "n_used", "separation")


def spike(pool_human: DataFrame, pool_machine: DataFrame, signals, human, machine, size: int = CHUNK, ratios=(0, 0.05, 0.1, 0.25, 0.5), draws: int = 5) -> list[dict]:
    """Purity of batches with a known share of machine records."""
    h, m = numbered(pool_human, "id").cache(), numbered(pool_machine, "id").cache()
    nh, nm, out = h.count(), m.count(), []
    spark = pool_human.sparkSession
    for ratio in ratios:
        for d in range(draws):
            k = round(size * ratio)
            a = spark.createDataFrame([(x,) for x in drawn(nh, size - k, DRAW_SEED + 100 + d)], "k long")
            batch = h.join(F.broadcast(a), "k", "left_semi").drop("k")
            if k:
                b = spark.createDataFrame([(x,) for x in drawn(nm, k, DRAW_SEED + 200 + d)], "k long")
                batch = batch.unionByName(m.join(F.broadcast(b), "k", "left_semi").drop("k"))
            row = score(score_signals(signals(batch), human, machine, size, size), size).collect()[0]
            if row.purity is not None and row.purity != row.purity:
                raise NotFiniteError("purity")
            out.append({"ratio": ratio, "draw": d, "purity": row.purity})
    return out


def spike_summary(rows: list[dict], least_drop: float = 2.0, cut: int = 85) -> dict:
    """Mean and deviation per ratio, the detection floor, the false-positive rate of clean batches, and whether purity only falls.

    The floor is the first ratio whose mean lies ``least_drop`` deviations of the
    clean batches below their mean.
    """
    by: dict = {}
    for r in rows:
        if r["purity"] is not None:
            by.setdefault(r["ratio"], []).append(float(r["purity"]))
    points = [{"ratio": k, "mean": float(np.mean(v)), "sd": float(np.std(v, ddof=1)) if len(v) > 1 else 0.0, "n": len(v)} for k, v in sorted(by.items())]
    clean = next((p for p in points if p["ratio"] == 0), None)
    floor = clean and next((p["ratio"] for p in points if p["ratio"] > 0 and p["mean"] < clean["mean"] - least_drop * clean["sd"]), None)
    means = [p["mean"] for p in points]
    return {"points": points, "floor": floor, "false_positives": clean and float(np.mean([x < cut for x in by[0]])), "monotonic": all(a >= b for a, b in zip(means, means[1:]))}


def resolution_sweep(pool_human: DataFrame, pool_machine: DataFrame, signals, baselines, sizes=(250, 500, 1000, 2000), **options) -> list[dict]:
    """Detection floor by batch size; ``baselines(size)`` gives the two baselines of a size."""
    out = []
    for size in sizes:
        human, machine = baselines(size)
        got = spike_summary(spike(pool_human, pool_machine, signals, human, machine, size, **options))
        out.append({"size": size, "floor": got["floor"], "false_positives": got["false_positives"]})
    return out


def score_batch(records: DataFrame, human: DataFrame, machine: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """All signals of a batch between two baselines: (one row a signal, purity and verdict in one row)."""
    from textweir.operators.signals import run_signals

    n = records.count()
    if n < LEAST_RECORDS:
        raise BatchTooSmallError(f"{n} records, {LEAST_RECORDS} are needed")
    scored = score_signals(run_signals(records).select("key", "value"), human, machine, n, chunk).cache()
    return scored, score(scored, n)


def author_stats(records: DataFrame, author: str = "author_id", least: int = 30) -> DataFrame:
    """authors and those with enough records, in one row."""
    c = records.filter(F.col(author).isNotNull() & (F.col(author) != "")).groupBy(author).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("authors"), F.count_if(F.col("n") >= least).alias("with_enough"))

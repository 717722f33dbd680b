"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder of this process;
    a cluster gets a refusal, as its executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="textweir-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/textweir-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; losing an executor never loses its rows."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_repeats(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key occurs once, and the others (None without any). Only keys are shuffled,
    so that what is counted within a key can be counted within a row; null is a key."""
    again = materialize(df.select(*[F.col(k).alias(f"{k}__") for k in keys]).groupBy(*[f"{k}__" for k in keys]).agg(F.count("*").alias("n__")).filter("n__ > 1").drop("n__"))
    if again.isEmpty():
        return df, None
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys])
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8MB") -> None:
    """Arrow batches of whole texts are large: bound them by rows and bytes, so that a
    Python worker holds little. A smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def numbered(df: DataFrame, *order: str, name: str = "k") -> DataFrame:
    """``df`` with each row's place, from 0, in the order of some columns: ranges are sorted
    apart, and their sizes, one row a partition, make the offsets. Written, so that it holds still."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("m__", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("m__", 33)
    at, rows = 0, []
    for r in t.groupBy(part.alias("p__")).agg(F.count("*").alias("n")).orderBy("p__").collect():
        rows.append((r.p__, at))
        at += r.n
    offsets = spark.createDataFrame(rows, "p__ long, at__ long")
    placed = t.withColumn("p__", part).join(F.broadcast(offsets), "p__")
    return placed.withColumn(name, F.col("at__") + F.col("m__").bitwiseAND(F.lit((1 << 33) - 1))).drop("p__", "m__", "at__")

"""URL filters as a sort-merge range join.

A host turned round label by label (``a.example.org`` -> ``org.example.a.``)
makes "this host and all its subdomains" an interval of sorted keys. Pages are
range-partitioned and sorted on that key (and on their id, so that one hot host
spreads over many tasks); each task sweeps its pages beside the sorted rules
with a stack of the active nested host rules, and tests their path prefixes.
The longest rule (host and path together) wins; of two as long, the one with
the longer host, then ``block``.

Rules (a list, or a DataFrame of r_host, r_path, r_verdict) are broadcast only up to
``max_broadcast_rules``; beyond that every page meets its host suffixes' rules by
an equi-join with the same result, the suffixes of many pages spread by salts.

Defined results
---------------
* null url, or one without ``://``: host and path empty, so no rule fits.
* null page ids, repeated rows and extra columns: each row is judged alone.
* hosts and paths of any length are judged whole; ties as above.
* no fitting rule: rule null, verdict ``default``. Empty tables: no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_path(url):
    """Columns host and path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def turned(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Sweep:
    """Rules sorted by turned host; pages must come in that order."""

    def __init__(self, rules):
        by: dict[str, list] = {}
        for host, path, verdict in rules:
            by.setdefault(turned(host), []).append((len(host) + len(path), len(host), verdict == "block", path, host + path, verdict))
        self.keys = sorted(by)
        self.rules = [sorted(by[k], reverse=True) for k in self.keys]
        self.stack: list[int] = []
        self.at = -1

    def _start(self, key: str) -> None:
        """Stack of the host rules around the first key of a partition."""
        labels, prefix = key.split(".")[:-1], ""
        self.stack = []
        for label in labels:
            prefix += label + "."
            i = bisect_left(self.keys, prefix)
            if i < len(self.keys) and self.keys[i] == prefix:
                self.stack.append(i)
        self.at = bisect_left(self.keys, key + "\0")

    def move(self, key: str) -> None:
        if self.at < 0:
            return self._start(key)
        while True:
            more = self.at < len(self.keys) and self.keys[self.at] <= key
            upto = self.keys[self.at] if more else key
            while self.stack and not upto.startswith(self.keys[self.stack[-1]]):
                self.stack.pop()
            if not more:
                return None
            self.stack.append(self.at)
            self.at += 1

    def best(self, path: str):
        found = [next((r for r in self.rules[i] if path.startswith(r[3])), None) for i in self.stack]
        return max((r for r in found if r), default=None)


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow", max_broadcast_rules: int = 2_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict of each row."""
    host, path = host_path(F.col("url"))
    p = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        table = rules.select("r_host", "r_path", "r_verdict")
        rules = None if table.count() > max_broadcast_rules else [tuple(r) for r in table.collect()]
    else:
        rules = list(rules)
        table = pages.sparkSession.createDataFrame(rules, RULE) if len(rules) > max_broadcast_rules else None
    if rules is None or table is not None and len(rules) > max_broadcast_rules:
        return judge_by_join(p, table, default)
    p = p.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(rules)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = p.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key")
    id_type = p.schema["page_id"].dataType.simpleString()

    def sweep(batches):
        s, last = Sweep(shared.value), None
        for b in batches:
            names, verdicts = [], []
            for key, pth in zip(b.column("key").to_pylist(), b.column("path").to_pylist()):
                if key != last:
                    s.move(key)
                    last = key
                r = s.best(pth)
                names.append(r[4] if r else None)
                verdicts.append(r[5] if r else default)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return p.mapInArrow(sweep, f"page_id {id_type}, host string, path string, rule string, verdict string")


RULE = "r_host string, r_path string, r_verdict string"


def judge_by_join(p: DataFrame, table: DataFrame, default: str, hot: int = 100_000, salts: int = 64) -> DataFrame:
    """The same for any number of rules: pages meet the rules of their host's suffixes.

    A suffix of more than ``hot`` pages and 0.1 % of all suffixes (so fewer than
    1,000 of them) is spread over ``salts`` tasks, its rules going to each.
    """
    q = materialize(p.withColumn("row", F.monotonically_increasing_id()))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = q.select("row", "path", F.explode(suffixes).alias("r_host"))
    uses = materialize(each.groupBy("r_host").agg(F.count("*").alias("n")))
    least = max(hot, (uses.agg(F.sum("n")).collect()[0][0] or 0) // 1000)
    many = F.broadcast(uses.filter(F.col("n") > least).select("r_host", F.lit(salts).alias("salts")))
    left = each.join(many, "r_host", "left").withColumn("salt", F.pmod("row", F.coalesce("salts", F.lit(1)))).drop("salts")
    right = table.join(many, "r_host", "left").select("r_host", "r_path", "r_verdict", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)).alias("salt"))
    hit = left.join(right, ["r_host", "salt"]).filter(F.expr("startswith(path, r_path)"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("l"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("v"))
    best = hit.groupBy("row").agg(F.max(rank).alias("m"))
    return q.join(best, "row", "left").select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.v", F.lit(default)).alias("verdict"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_CASES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
OP9_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for h, p, _ in _CASES)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _CASES)} ELSE 'allow' END AS verdict FROM p
"""

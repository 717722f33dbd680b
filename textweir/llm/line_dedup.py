"""Line dedup with two Bloom filters (once seen, twice seen).

Only lines that the twice-seen filter suspects are shuffled, as SHA-256 digests
with their document ids; exact counts over those decide. A line's key is the
line without the six ASCII white-space bytes at both ends, A-Z lower-cased.

Defined results
---------------
* null or empty text: one empty line, never dropped.
* null ``doc_id``: all such rows are one document for counting, which ranks below
  every id; rows that share an id are one document too, and each row is returned.
  Rows without an id are told apart by their place, so ``docs`` is a table, whose
  scans agree on the order of rows.
* ties: rows that share the largest id all keep the key's lines. Texts and lines of
  any length are judged whole.
* keys shorter than ``min_chars`` code points are never dropped.
* empty table: no rows. Other columns of the input are ignored, or kept where
  named in ``keep`` (any name but those of the result).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.llm.common import HASH_SCHEMA, concat, code_points, emit_hashes, materialize, n_shards, normalized, repeat_filter, schema_of

#: Rank of a document without an id.
NO_ID = -(2**63)


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line."""
    return [line.strip() for line in text.lower().split(b"\n")]


def _long(keys, min_chars: int):
    return [k for k in keys if len(k) >= min_chars and (len(k) >= 4 * min_chars or code_points(k) >= min_chars)]


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: tuple[str, ...] = (), max_filter_bits: int = 1 << 31) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, text (what is left) and ``keep``.

    Plan: (1) one narrow pass packs line hashes for the filters; (2) a second
    pass tags suspects; their (digest, doc_id) pairs, at most ``min_docs`` a
    digest and task, are counted exactly; (3) digests that hold over 0.1 % of
    the suspect rows (so fewer than 1,000) join by broadcast, the rest by
    shuffle; (4) texts with suspects meet their dropped digests by id, texts
    without any are never shuffled.
    """
    spark = docs.sparkSession
    base = normalized(docs, *keep).withColumn("rid", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0))
    shards = n_shards(docs)
    bits = shards.bit_length() - 1

    def hashes(batches):
        got = []
        for b in batches:
            for t in b.column(0):
                ks = set(_long(line_keys(t.as_py()), min_chars))
                got.append(np.fromiter(map(xxhash.xxh3_64_intdigest, ks), np.uint64, len(ks)))
        yield from emit_hashes(concat(got), bits)

    twice = repeat_filter(base.select("text").mapInArrow(hashes, HASH_SCHEMA), shards, max_filter_bits)

    def suspects_of(texts) -> list[list[bytes]]:
        """Digests of the suspect keys of each text; the filter is probed once for all."""
        keys = [list(dict.fromkeys(_long(line_keys(t.as_py()), min_chars))) for t in texts]
        flat = [k for ks in keys for k in ks]
        hit = twice.value.has(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))).tolist()
        out, at = [], 0
        for ks in keys:
            out.append([hashlib.sha256(k).digest() for k, x in zip(ks, hit[at : at + len(ks)]) if x])
            at += len(ks)
        return out

    def flag(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(suspects_of(b.column("text")), pa.list_(pa.binary()))], [*b.schema.names, "suspects"])

    flagged = base.mapInArrow(flag, schema_of(base.schema, "suspects array<binary>"))

    def occurrences(batches):
        """Distinct (digest, rid, row) of this task."""
        seen = set()
        for b in batches:
            for found, rid, row in zip(suspects_of(b.column("text")), b.column("rid").to_pylist(), b.column("row").to_pylist()):
                seen.update((d, rid, row) for d in found)
        pairs = list(seen)
        for i in range(0, len(pairs), 1 << 16):
            part = list(zip(*pairs[i : i + (1 << 16)]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.binary()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], ["digest", "rid", "row"])

    pairs = base.select("text", "rid", "row").mapInArrow(occurrences, "digest binary, rid long, row long").distinct()
    pairs = materialize(pairs)
    known = pairs.select("digest", "rid").distinct().groupBy("digest").agg(F.count("*").alias("n"), F.max("rid").alias("last")).filter(F.col("n") >= min_docs)
    known = materialize(known)
    total = pairs.count()
    heavy = known.filter(F.col("n") > F.lit(max(1000, total // 1000)))
    light = known.filter(F.col("n") <= F.lit(max(1000, total // 1000))).select("digest", "last")
    rest = pairs.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    drops = rest.join(light, "digest").union(pairs.join(F.broadcast(heavy.select("digest", "last")), "digest")).filter(F.col("rid") < F.col("last"))
    drops = drops.groupBy(F.col("rid").alias("drop_rid"), F.col("row").alias("drop_row")).agg(F.collect_set("digest").alias("drop"))

    schema = schema_of([f for f in base.schema if f.name not in ("text", "rid", "row")], "n_lines long, n_dropped long, text binary")

    def batch(b, lines, dropped, texts):
        others = [(c, n) for c, n in zip(b.columns, b.schema.names) if n not in ("text", "rid", "row", "drop")]
        return pa.RecordBatch.from_arrays([*(c for c, _ in others), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary())], [*(n for _, n in others), "n_lines", "n_dropped", "text"])

    def clean(batches):
        for b in batches:
            out, lines, dropped = [], [], []
            for t, drop in zip(b.column("text"), b.column("drop")):
                text = t.as_py()
                parts = text.split(b"\n")
                drop = set(drop.as_py() or ())
                left = [p for p, k in zip(parts, line_keys(text)) if not (len(k) >= min_chars and hashlib.sha256(k).digest() in drop)] if drop else parts
                out.append(b"\n".join(left))
                lines.append(len(parts))
                dropped.append(len(parts) - len(left))
            yield batch(b, lines, dropped, out)

    def untouched(batches):
        """Texts without a suspect line, as they are."""
        for b in batches:
            b = b.filter(pa.array([not x for x in suspects_of(b.column("text"))]))
            texts = b.column("text").to_pylist()
            yield batch(b, [t.count(b"\n") + 1 for t in texts], [0] * len(texts), texts)

    touched = flagged.filter(F.size("suspects") > 0).drop("suspects").join(drops.hint("shuffle_hash"), (F.col("rid") == F.col("drop_rid")) & (F.col("row") == F.col("drop_row")), "left").drop("rid", "row", "drop_rid", "drop_row")
    return touched.mapInArrow(clean, schema).unionByName(base.mapInArrow(untouched, schema)).withColumn("text", F.col("text").cast("string"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
g AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE g.k IS NOT NULL AND l.doc_id <> g.last)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.k IS NULL OR l.doc_id = g.last), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.k = g.k GROUP BY l.doc_id
"""

"""Line sources, record parsing and the accounting of what was skipped.

Only ``\\n`` ends a line. Lines keep their order in ``doc_seq`` (file order, then
line), computed from partition offsets, never by sorting the corpus in one task.
"""

from __future__ import annotations

import gzip
import itertools
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textweir.errors import EmptyBatchError, EmptyCorpusError, SchemaMismatchError
from textweir.functions.text import is_blank, normalise, slug, word_count
from textweir.storage import materialize

TEXT_FIELDS = ("text", "response", "output", "completion", "content", "answer")
ID_FIELDS = ("id", "_id", "record_id", "uuid")
AUTHOR_FIELDS = ("annotator_id", "annotatorId", "author_id", "authorId", "worker_id", "contributor")
PROMPT_FIELDS = ("prompt", "instruction", "question", "input")


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, line, value) of text files, in the order given; line counts from 1 in each file.

    gzip is known by its extension, and in local files by its first bytes too. A
    line's number is its place in its split plus the lines of the splits before,
    counted in one pass; no row leaves the JVM and nothing is shuffled.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for rank, path in enumerate(paths):
        if _hidden_gzip(path):
            df = _unzipped(spark, path).select(F.lit(rank).alias("file"), "line", "value")
        else:
            meta = [F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("start")]
            lines = spark.read.option("lineSep", "\n").text(path).select("value", *meta, F.monotonically_increasing_id().alias("m"))
            splits = lines.groupBy("f", "start").agg(F.count("*").alias("n"), F.min("m").alias("least"), F.min("name").alias("name"))
            before = Window.orderBy("name", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
            splits = materialize(splits.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))).select("f", "start", "least", "at")
            df = lines.join(F.broadcast(splits), ["f", "start"]).select(F.lit(rank).alias("file"), (F.col("at") + F.col("m") - F.col("least") + 1).alias("line"), "value")
        out = df if out is None else out.unionByName(df)
    return out


def _hidden_gzip(path: str) -> bool:
    """A local file that is gzip without saying so in its name."""
    local = path.removeprefix("file://")
    if "://" in local or not os.path.isfile(local) or local.endswith(".gz"):
        return False
    with open(local, "rb") as f:
        return f.read(2) == b"\x1f\x8b"


def _unzipped(spark: SparkSession, path: str, rows: int = 1000) -> DataFrame:
    """line, value of a gzip file whatever its name, read as a stream by one task, as gzip can't be split."""
    local = os.path.abspath(path.removeprefix("file://"))

    def read(batches):
        for _ in batches:
            with gzip.open(local, "rt", encoding="utf-8", errors="replace", newline="\n") as f:
                at = 1
                while part := [x.removesuffix("\n") for x in itertools.islice(f, rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], ["line", "value"])
                    at += len(part)

    return spark.range(1, numPartitions=1).mapInArrow(read, "line long, value string")


def corpus_bytes(lines: DataFrame, paths) -> int:
    """The size of one plain local file, else the bytes of all lines with their ends, uncompressed."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    local = paths[0].removeprefix("file://")
    if len(paths) == 1 and os.path.isfile(local) and not local.endswith(".gz") and not _hidden_gzip(local):
        return os.path.getsize(local)
    return lines.agg(F.sum(F.octet_length("value") + 1)).collect()[0][0] or 0


def _field(v, name: str):
    """A field's text if it is a string that isn't blank."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    s = F.try_variant_get(v, f"$.{name}", "string")
    return F.when((kind == "STRING") & ~is_blank(s), s)


def parse_corpus(lines: DataFrame, text_field: str | None = None, id_field: str = "id") -> DataFrame:
    """(doc_seq, doc_id, text, skip_reason) of each line that isn't empty.

    The text field is found anew in every line, in the order of ``TEXT_FIELDS``.
    A document without an id is ``doc{n}``, n counting accepted documents.
    """
    x = lines.filter(~is_blank(F.col("value"))).withColumn("v", F.try_parse_json("value"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    text = _field(F.col("v"), text_field) if text_field else F.coalesce(*[_field(F.col("v"), f) for f in TEXT_FIELDS])
    reason = F.when(F.col("v").isNull(), "unparseable").when(~is_object, "not an object").when(F.col("text").isNull(), "no usable text")
    x = x.withColumn("text", F.when(is_object, text)).withColumn("skip_reason", reason)
    known = F.when(is_object, F.try_variant_get("v", f"$.{id_field}", "string"))
    x = x.select("file", "line", "text", "skip_reason", known.alias("given"))
    # Number of accepted lines before this one: running count inside each block of lines, plus the blocks before.
    block = F.struct("file", F.floor(F.col("line") / 65536).alias("b"))
    x = x.withColumn("block", block).withColumn("ok", F.col("skip_reason").isNull().cast("long"))
    sums = x.groupBy("block").agg(F.sum("ok").alias("n"), F.count("*").alias("m"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"))
    inner = Window.partitionBy("block").orderBy("line")
    x = x.join(sums, "block").withColumn("n", F.col("n0") + F.sum("ok").over(inner)).withColumn("doc_seq", F.col("m0") + F.row_number().over(inner))
    return x.select("doc_seq", F.coalesce("given", F.when(F.col("ok") == 1, F.concat(F.lit("doc"), F.col("n")))).alias("doc_id"), "text", "skip_reason")


def accounting(parsed: DataFrame) -> DataFrame:
    """lines, accepted, skipped by reason, in one row."""
    return parsed.agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("skip_reason").isNull()).alias("accepted"),
        F.count_if(F.col("skip_reason") == "unparseable").alias("unparseable"),
        F.count_if(F.col("skip_reason") == "not an object").alias("not_an_object"),
        F.count_if(F.col("skip_reason") == "no usable text").alias("no_usable_text"),
    )


def require_documents(parsed: DataFrame) -> DataFrame:
    """Refuse a corpus without a readable document."""
    if parsed.filter("skip_reason is null").isEmpty():
        raise EmptyCorpusError("no readable document, so nothing was checked")
    return parsed


def load_batch(lines: DataFrame, text_field=None, id_field=None, author_field=None, prompt_field=None):
    """Records (id, text, prompt, author_id) and skipped lines (line, reason) of a batch file.

    Fields are chosen once, on the first line whose text is usable; a repeated id
    stays, with its line as a suffix, and is reported among the skipped.
    """
    x = lines.select("line", F.trim(normalise("value")).alias("value")).filter(~is_blank(F.col("value"))).withColumn("v", F.try_parse_json("value"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    good = x.filter(is_object)
    names = [text_field] if text_field else list(TEXT_FIELDS)
    usable = good.select("line", "v", *[_field(F.col("v"), n).alias(f"t{i}") for i, n in enumerate(names)])
    first = usable.filter(F.coalesce(*[f"t{i}" for i in range(len(names))]).isNotNull()).orderBy("line").limit(1).collect()
    if not first:
        if good.isEmpty():
            raise EmptyBatchError("no JSON object in the file")
        raise SchemaMismatchError(f"no record holds usable text in {text_field or ', '.join(TEXT_FIELDS)}")
    start = first[0].line
    text_name = next(n for i, n in enumerate(names) if first[0][f"t{i}"] is not None)

    def pick(given, candidates):
        if given:
            return given
        row = good.filter(F.col("line") == start).select(*[_field(F.col("v"), n).alias(n) for n in candidates]).collect()[0]
        return next((n for n in candidates if row[n] is not None), None)

    id_name, author_name, prompt_name = pick(id_field, ID_FIELDS), pick(author_field, AUTHOR_FIELDS), pick(prompt_field, PROMPT_FIELDS)

    def get(name):
        return F.try_variant_get("v", f"$.{name}", "string") if name else F.lit(None).cast("string")

    reason = F.when(F.col("v").isNull(), "unparseable JSON").when(~is_object, "not a JSON object").when(F.col("line") < start, "no field holding usable text").when(_field(F.col("v"), text_name).isNull(), f'empty or non-string "{text_name}"')
    x = x.withColumn("reason", reason)
    ok = x.filter("reason is null").select("line", F.coalesce(F.nullif(get(id_name), F.lit("")), F.concat(F.lit("r"), "line")).alias("id"), _field(F.col("v"), text_name).alias("text"), F.nullif(get(prompt_name), F.lit("")).alias("prompt"), F.nullif(get(author_name), F.lit("")).alias("author_id"))
    ok = ok.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("line")))
    records = ok.select(F.when(F.col("k") > 1, F.concat("id", F.lit("#"), "line")).otherwise(F.col("id")).alias("id"), "text", "prompt", "author_id", "line")
    again = ok.filter("k > 1").select("line", F.lit("duplicate id, suffixed").alias("reason"))
    return records, x.filter("reason is not null").select("line", "reason").unionByName(again)


def flatten_chat(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: turns in order, blank ones out, joined by an empty line."""
    t = turns.filter(F.length("text") > 0).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return t.select("conv_id", F.size("x").cast("long").alias("n_turns"), F.array_join(F.transform("x", lambda r: r["text"]), "\n\n").alias("text"))


def reference_subset(docs: DataFrame, dropped: list[str]) -> DataFrame:
    """Documents outside the dropped subsets, numbered inside each subset."""
    w = Window.partitionBy("source").orderBy("doc_id")
    kept = docs.filter(~F.col("source").isin(dropped)).withColumn("k", F.row_number().over(w).cast("long"))
    return kept.select(F.concat(slug("source"), F.lit("-"), F.col("k")).alias("ref_id"), "doc_id", "source")


def category_subset(docs: DataFrame, categories: list[str], min_words: int = 10) -> DataFrame:
    """Documents of the categories with enough words, no context (where they have that column), and a running number."""
    alone = is_blank(F.coalesce("context", F.lit(""))) if "context" in docs.columns else F.lit(True)
    kept = docs.filter(F.col("lang").isin(categories) & (word_count("text") >= min_words) & alone).select("doc_id", "lang", word_count("text").cast("long").alias("n_words"))
    w = Window.partitionBy("lang").orderBy("doc_id")
    return kept.withColumn("k", F.row_number().over(w).cast("long")).select("doc_id", "lang", "n_words", F.concat(F.col("lang"), F.lit("-"), F.col("k")).alias("run_id"))


def normalise_benchmark(items: DataFrame, name: str = "bench") -> DataFrame:
    """item_id as {name}-{position}, text in normal form, length and content hash."""
    return items.select(F.concat(F.lit(f"{name}-"), F.col("item_id")).alias("id"), normalise("text").alias("text"), F.length(normalise("text")).cast("long").alias("n_chars"), F.sha2(normalise("text"), 256).alias("sha256"))


def crawl_slice(pages: DataFrame, text_col, min_chars: int = 200) -> DataFrame:
    """One row per distinct page text of at least ``min_chars``: the smallest page id."""
    x = pages.select("page_id", text_col.alias("body")).filter(F.length("body") >= min_chars)
    return x.groupBy(F.sha2("body", 256).alias("digest")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_pages"), F.min(F.length("body")).cast("long").alias("n_chars"))

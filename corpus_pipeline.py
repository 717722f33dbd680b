"""Corpus pipeline: five stages over the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``docs``; ``n_chars`` follows the text. Whatever else the table
carries passes through unread, under any name.

Defined results, beside those of the operators
----------------------------------------------
* null texts: quality rules reject them as empty; the later stages, called alone,
  take them as empty. Null ids pass through every stage; rows of equal ids are
  rows of their own, but in line dedup, where an id is a document.
* ties: of near duplicates with one id the first row stays.
* empty tables (documents or benchmark): empty results, or all documents kept.
* texts of any length are judged, compared and packed whole.
"""

from pyspark.sql import functions as F

from textweir.llm.common import materialize
from textweir.llm.decontaminate import find_leaks
from textweir.llm.line_dedup import dedup_lines
from textweir.llm.packing import pack, token_pieces
from textweir.llm.quality_rules import line_first_rules
from textweir.llm.simhash import keep_one


def _carry(docs):
    """doc_id, text, and all other columns in one struct."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("nothing__"), *[F.col(f"`{c}`") for c in others]).alias("carried__"))


def _restore(df, docs):
    """The columns of ``docs`` in their order, with the new text."""
    kind = docs.schema["doc_id"].dataType
    new = {"doc_id": F.col("doc_id").cast(kind), "text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return df.select(*[new.get(c, F.col(f"carried__.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark, docs, sf_dir):
    """Operator 3: failing lines go, and documents that lose too much or break a whole-text rule."""
    return _restore(line_first_rules(_carry(docs), keep=("carried__",)).filter("kept"), docs)


def line_dedup(spark, docs, sf_dir):
    """Operator 4: repeated lines stay in one document only."""
    return _restore(dedup_lines(_carry(docs), keep=("carried__",)), docs)


def near_duplicates(spark, docs, sf_dir):
    """Operator 7: one document of each group of near duplicates stays."""
    return keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Operator 6: documents that hold a benchmark item go."""
    marked = docs.withColumn("row__", F.monotonically_increasing_id())
    leaks = find_leaks(marked.select(F.col("row__").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.join(leaks.select(F.col("doc_id").alias("row__")).distinct(), "row__", "left_anti").drop("row__")


def packing(spark, docs, sf_dir):
    """Operator 5: what is left as sequences of at most 2,048 tokens."""
    import public_tokenizers

    return pack(materialize(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fingerprints, latent retrieval and token ids have no SQL form; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Edit-aware token counts.

A document is cut into segments of about ``segment`` characters at places where
a token always ends: before a space that a visible character follows. A segment
tree over them holds characters and tokens of every subtree. An edit finds the
segments it touches, with two characters of context on either side (the
boundary rule looks that far), re-encodes only those, and updates the sums on
the way up. A region that has outgrown its segments is cut anew and the tree built
again from the counts there are, without encoding more. The count is always that
of encoding the whole new text.

Defined results
---------------
* null or empty text: no segments but one empty, no tokens.
* null, empty or overlong edits: an edit is clipped to the text; null edit
  lists, and edits with a null bound, do nothing; a null replacement is empty.
* overlapping edits apply in the order given, each to the text as it is then.
* texts of any length are counted whole. Ties don't arise.
* null ids, repeated rows, extra columns named in ``keep``: each row by itself.
* empty table: no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.llm.bpe import WordEncoder, encoder, in_batches
from textweir.llm.common import schema_of, small_batches

CONTEXT = 2
_CUT = re.compile(r" (?=\S)")


def segments(text: str, size: int = 256) -> list[str]:
    """Pieces of ``text`` that encode independently of one another."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m or m.start() == at:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class TokenTree:
    """Segment tree of characters and tokens; leaves hold the text."""

    def __init__(self, leaves: list[str], counts, enc: WordEncoder, segment: int = 256):
        self.enc, self.encoded, self.segment = enc, 0, segment
        self._build(list(leaves), counts)

    def _build(self, leaves: list[str], counts) -> None:
        self.leaves, self.base = leaves, 1
        while self.base < len(leaves):
            self.base *= 2
        self.chars = [0] * (2 * self.base)
        self.tokens = [0] * (2 * self.base)
        for i, (s, n) in enumerate(zip(leaves, counts)):
            self.chars[self.base + i], self.tokens[self.base + i] = len(s), int(n)
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def size(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one at the end), and its first character."""
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.base, start

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = self.base + leaf
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace [start, end) by ``new``; returns the new token count."""
        start = min(max(start, 0), self.size)
        end = min(max(end, start), self.size)
        a, a_at = self._find(max(0, start - CONTEXT))
        z, z_at = self._find(min(self.size, end + CONTEXT))
        old = "".join(self.leaves[a : z + 1])
        region = old[: start - a_at] + new + old[end - a_at :]
        parts = segments(region, self.segment)
        counts = self.enc.counts(parts)
        self.encoded += len(region)
        room = z - a + 1
        if len(parts) > room:
            held = self.tokens[self.base : self.base + len(self.leaves)]
            self._build(self.leaves[:a] + parts + self.leaves[z + 1 :], [*held[:a], *counts.tolist(), *held[z + 1 :]])
            return self.count
        for k in range(room):
            t = parts[k] if k < len(parts) else ""
            if t or self.leaves[a + k]:
                self._set(a + k, t, int(counts[k]) if k < len(parts) else 0)
        return self.count


def edit_counts(docs: DataFrame, tokenizer: str, edits: str = "edits", keep: tuple[str, ...] = (), segment: int = 256, with_text: bool = False) -> DataFrame:
    """doc_id, ``keep``, n_tokens, n_edits, n_tokens_after, n_chars, n_reencoded (characters), and the text.

    ``edits`` is an array<struct<start:int, stop:int, new:string>> column, in
    code points. One narrow pass: no shuffle, nothing collected.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col(edits).alias("edits"), *keep)
    schema = schema_of([f for f in base.schema if f.name not in ("text", "edits")], "n_tokens long, n_edits long, n_tokens_after long, n_chars long, n_reencoded long" + ", text string" * with_text)

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            texts, edit_lists = b.column("text").to_pylist(), b.column("edits").to_pylist()
            for i, j in in_batches(texts):
                cut = [segments(t, segment) for t in texts[i:j]]
                counts = enc.counts([s for c in cut for s in c])
                rows, at = [], 0
                for c, edits_of in zip(cut, edit_lists[i:j]):
                    n = counts[at : at + len(c)]
                    at += len(c)
                    todo = [e for e in edits_of or () if e and e["start"] is not None and e["stop"] is not None]
                    before = int(n.sum())
                    if not todo:
                        size = sum(map(len, c))
                        rows.append((before, 0, before, size, 0, "".join(c)))
                        continue
                    tree = TokenTree(c, n, enc, segment)
                    for e in todo:
                        tree.edit(e["start"], e["stop"], e["new"] or "")
                    rows.append((before, len(todo), tree.count, tree.size, tree.encoded, tree.text()))
                cols = [pa.array(x, pa.int64()) for x in list(zip(*rows))[:5]] + [pa.array([r[5] for r in rows], pa.string())] * with_text
                kept = [(c.slice(i, j - i), n) for c, n in zip(b.columns, b.schema.names) if n not in ("text", "edits")]
                yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), *cols], [*(n for _, n in kept), "n_tokens", "n_edits", "n_tokens_after", "n_chars", "n_reencoded", *["text"] * with_text])

    return base.mapInArrow(run, schema)


#: What a redaction replaces: mail addresses, long hexadecimal keys, addresses of hosts, card and phone numbers.
REDACTIONS = r"(?<![\w.+-])[\w.+-]++@[\w-]+\.[\w.]+|\b[0-9a-f]{32,}+\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d(?:[ -]?\d){6,}\b"
#: One of these is in every text that ``REDACTIONS`` matches somewhere.
_NEEDED = tuple(map(re.compile, ("@", r"\d", "[a-f]{32}")))


def redaction_edits(docs: DataFrame, pattern: str = REDACTIONS, new: str = "[redacted]", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, ``keep`` and the edits that redact it, last match first so that places stay valid."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    schema = schema_of(base.schema, "edits array<struct<start:int,stop:int,new:string>>")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())]))

    def find(batches):
        rx, needed = re.compile(pattern), _NEEDED if pattern == REDACTIONS else (re.compile(""),)
        for b in batches:
            out = [[{"start": m.start(), "stop": m.end(), "new": new} for m in rx.finditer(t)][::-1] if any(x.search(t) for x in needed) else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, "edits"])

    return base.mapInArrow(find, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return edit_counts(redaction_edits(docs), public_tokenizers.path("byte_bpe_50k.json"))

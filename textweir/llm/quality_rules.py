"""Line-first quality rules.

Every line is judged before its document, lines that fail are removed, and a
document is rejected if the removed lines held more than ``max_lost`` percent of
its word characters, or if a whole-text rule (too few words, too many repeated
words) fails. One narrow pass; no shuffle. A line fails by

* punctuation: at least two symbols of ``SYMBOLS`` and more than one to four
  words; more ``!`` than one to two words, from four words on; or ``LIST_WORDS``
  words and more without any of the marks in ``MARKS``;
* navigation: at most ``MENU_WORDS`` words, no closing mark, and half of the words
  or more (two at least) from ``NAVIGATION``; or being one of ``LABELS`` lines or
  more in a row of at most three words without a closing mark (lines without a word
  don't break a row);
* boilerplate: a phrase of ``BOILERPLATE`` for each 25 words of the line or fewer,
  so that a phrase quoted in a long paragraph doesn't cost the paragraph.

Defined results
---------------
* null or empty text: no words, so rejected; its cleaned text is empty.
* lines without a word never fail (and count as no duplicate).
* repeated rows, null ids and clashing column names change nothing: each row is
  judged alone. Texts of any length are judged whole. Empty table: no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.llm.common import _CONT, WS, normalized, schema_of

SYMBOLS = b"#*$%&|<>"
BOILERPLATE = (b"all rights reserved", b"licensed under", b"released under the", b"privacy policy", b"terms of use", b"terms of service", b"enable javascript", b"use of cookies", b"lorem ipsum", b"subscribe to our newsletter")
NAVIGATION = frozenset(b"about account archive archives back blog careers cart categories category checkout contact contacts download downloads faq feed feedback forum gallery help home imprint index jobs links login logout main menu news newsletter next page prev previous print privacy products register rss search services share shop sign sitemap subscribe support tags terms top us".split())
CLOSING, MARKS = ".!?:;,\"')]}{(…”’»。！？；：，、", ".!?:;,…。！？；：，、"
MENU_WORDS, LIST_WORDS, LABELS = 12, 25, 4
_CLOSING, _MARKS = (tuple(c.encode() for c in x) for x in (CLOSING, MARKS))
_NOT_LETTER = bytes(b for b in range(256) if not 97 <= b <= 122)
_NOT_MARK = bytes(b for b in range(128) if chr(b) not in MARKS)


def line_fails(line: bytes, boilerplate=BOILERPLATE) -> bool:
    """Whether a line breaks a rule that looks at it alone."""
    words = line.split()
    n = len(words)
    if not n:
        return False
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols >= 2 and 4 * symbols > n or n >= 4 and 2 * line.count(b"!") > n:
        return True
    if n >= LIST_WORDS and not _any_mark(line):
        return True
    low = line.lower()
    if 2 <= n <= MENU_WORDS and not words[-1].endswith(_CLOSING):
        named = sum(w.translate(None, _NOT_LETTER) in NAVIGATION for w in low.split())
        if named >= 2 and 2 * named >= n:
            return True
    return n <= 25 * sum(p in low for p in boilerplate)


def _any_mark(line: bytes) -> bool:
    left = line.translate(None, _NOT_MARK)  # ASCII marks, and whatever isn't ASCII
    return bool(left) and (left[0] < 128 or any(m in left for m in _MARKS))


def failing_lines(lines: list[bytes], boilerplate=BOILERPLATE) -> list[bool]:
    """Which lines fail, alone or as part of a row of labels."""
    out = [line_fails(x, boilerplate) for x in lines]
    row: list[int] = []
    for i, line in enumerate(lines):
        words = line.split(None, 3)
        if not words:
            continue
        if len(words) <= 3 and not words[-1].endswith(_CLOSING):
            row.append(i)
            continue
        if len(row) >= LABELS:
            for k in row:
                out[k] = True
        row = []
    if len(row) >= LABELS:
        for k in row:
            out[k] = True
    return out


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside a window of ``window`` words that occurs at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == n:
        return 0
    count, total, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            total += i + window - max(end, i)
            end = i + window
    return total


def judge(text: bytes, min_words: int, max_repeat: int, max_lost: int, boilerplate=BOILERPLATE):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines that stay."""
    words = text.split()
    word_chars = len(text.translate(None, WS + _CONT))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                dup += bool(line.split())
            seen.add(line)
    repeat = repeated_words(words)
    failed = len(words) < min_words or 100 * repeat > max_repeat * len(words)
    left, lost = [], 0
    for line, fails in zip(lines, failing_lines(lines, boilerplate)):
        if fails:
            lost += len(line.translate(None, WS + _CONT))
        else:
            left.append(line)
    return len(words), word_chars, n_symbols, dup, repeat, failed, not failed and 100 * lost <= max_lost * word_chars, left


def line_first_rules(docs: DataFrame, min_words: int = 10, max_repeat: int = 20, max_lost: int = 40, keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, ``keep``, the counts, base_failed, kept and the cleaned text."""
    base = normalized(docs, *keep)
    schema = schema_of([f for f in base.schema if f.name != "text"], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean" + ", text binary" * with_text)

    def run(batches):
        for b in batches:
            rows = [judge(t.as_py(), min_words, max_repeat, max_lost) for t in b.column("text")]
            cols = [pa.array([r[i] for r in rows], pa.int64() if i < 5 else pa.bool_()) for i in range(7)]
            if with_text:
                cols.append(pa.array([b"\n".join(r[7]) for r in rows], pa.binary()))
            kept = [(c, n) for c, n in zip(b.columns, b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), *cols], [*(n for _, n in kept), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *["text"] * with_text])

    out = base.mapInArrow(run, schema)
    return out.withColumn("text", F.col("text").cast("string")) if with_text else out


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return line_first_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


_PHRASES = " + ".join(f"contains(low, '{p.decode()}')::INT" for p in BOILERPLATE)
_NAMES = ", ".join(f"'{w}'" for w in sorted(x.decode() for x in NAVIGATION))


def _class(marks: str) -> str:
    return "[" + "".join("\\" + c if c in "[]{}()" else c for c in marks).replace("'", "''") + "]"


OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
x AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT r, i, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS s, length(line) - length(replace(line, '!', '')) AS e, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS c,
  regexp_matches(line, '{_class(CLOSING)}[\x20\x09-\x0D]*$') AS closed, regexp_matches(line, '{_class(MARKS)}') AS marked FROM x),
f AS (SELECT *, len(list_filter(regexp_extract_all(low, '[^\x20\x09-\x0D]+'), lambda v: list_contains([{_NAMES}], regexp_replace(v, '[^a-z]', '', 'g')))) AS named, n <= 3 AND NOT closed AS label FROM l WHERE n > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) - row_number() OVER (PARTITION BY r, label ORDER BY i) AS island FROM f),
h AS (SELECT *, count(*) OVER (PARTITION BY r, label, island) AS in_row FROM g),
ln AS (SELECT r, sum(CASE WHEN (s >= 2 AND 4 * s > n) OR (n >= 4 AND 2 * e > n) OR (n >= {LIST_WORDS} AND NOT marked) OR (n BETWEEN 2 AND {MENU_WORDS} AND NOT closed AND named >= 2 AND 2 * named >= n)
  OR (label AND in_row >= {LABELS}) OR n <= 25 * ({_PHRASES}) THEN c ELSE 0 END) AS lost FROM h GROUP BY r),
dup AS (SELECT r, sum(k - 1) AS n FROM (SELECT r, line, count(*) AS k FROM l WHERE n > 0 GROUP BY r, line) GROUP BY r),
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN ln USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 40 * word_chars AS kept FROM a
"""

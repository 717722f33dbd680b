"""Column expressions for text: three tokenizers, shingles, sentences, rates, page text.

All but ``shingle_sizes`` and ``counted_marks`` are built-in expressions, so they stay in the JVM. The three tokenizers are
kept apart on purpose: the *scan* tokenizer works on UTF-16 units (letters
outside the basic plane separate), the *signal* tokenizer on code points, and
the *triage* tokenizer treats the apostrophe as a separator.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweir.storage import small_batches

#: The 116 words whose rates make a style vector.
FUNCTION_WORDS = (
    "a i be he me we if of am an in on do no so to up or as is at it by my had did and she the are off "
    "all him can own who too her for nor our has was his its not but out you few how now why any once "
    "same some here were more have each such with both will them whom from than been then when down also "
    "into over your does this hers that what most just they only very could would while there where these "
    "those above being doing which until again under other after their about below should before itself "
    "during having because through between further "
).split()
#: Letters of scripts written without spaces.
UNSEGMENTED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
PUNCTUATION = {"apostrophe": "'", "colon": ":", "comma": ",", "dash": "[-–—]", "exclaim": "!", "paren": "[()]", "period": r"\.", "question": r"\?", "quote": "[\"'“”]", "semicolon": ";"}
#: The marks of each class; together the only characters that the classes count.
MARKS = {"apostrophe": "'", "colon": ":", "comma": ",", "dash": "-–—", "exclaim": "!", "paren": "()", "period": ".", "question": "?", "quote": "\"'“”", "semicolon": ";"}

#: Signal tokens of ASCII: letters in lower case, digits and apostrophes stay, all else is a space.
_ASCII = bytes(ord(chr(i).lower()) if chr(i).isascii() and (chr(i).isalnum() or chr(i) == "'") else 32 for i in range(256))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scan_lower(c) -> Column:
    """Each character lower-cased alone, unless that would change its length."""
    c = _col(c)
    odd = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.length(F.lower(x)) == 1, F.lower(x)).otherwise(x)), "")
    return F.when(c.rlike("[İΣ]"), odd).otherwise(F.lower(c))


def scan_tokens(c) -> Column:
    return F.regexp_extract_all(scan_lower(c), F.lit(r"[\p{L}\p{N}'&&[\x{0}-\x{FFFF}]]+"), F.lit(0))


def signal_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))


def token_line(c) -> Column:
    """The signal tokens in one string, one space apart, perhaps with one at either end; no token holds white space."""
    return F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}']+", " ")


def rough_line(c) -> Column:
    """What ``rough_tokens`` takes: an ASCII text as it is, of any other the ``token_line``."""
    c = _col(c)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(token_line(c)).alias("line")


def rough_tokens(line: str) -> list[str]:
    """The signal tokens of a ``rough_line``."""
    return (line.encode().translate(_ASCII).decode() if line.isascii() else line).split()


def triage_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sentences(c) -> Column:
    """Split after . ! ? and white space, or at line feeds; trimmed, none empty."""
    parts = F.transform(F.split(_col(c), r"(?<=[.!?])\s+|\n+"), F.trim)
    return F.filter(parts, lambda x: F.length(x) > 0)


def windows(tokens: Column, n: int) -> Column:
    """All windows of n items, as arrays."""
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))


def shingles(tokens: Column, k: int) -> Column:
    """Windows of k tokens as text; fewer tokens make one shingle, none make none."""
    size = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(many)


def shingle_sizes(df, key: str, k: int):
    """``key``, n_shingles, n_distinct of each row with a token; ``shingles`` are counted where the row is."""
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            places, n, distinct = [], [], []
            for i, line in enumerate(b.column(1)):
                t = (line.as_py() or "").split()
                if t:
                    places.append(i)
                    n.append(max(1, len(t) - k + 1))
                    distinct.append(len(set(zip(*[t[j : len(t) - k + 1 + j] for j in range(k)]))) if len(t) > k else 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places, pa.int64())), pa.array(n, pa.int64()), pa.array(distinct, pa.int64())], [key, "n_shingles", "n_distinct"])

    return df.select(key, token_line("text").alias("line")).mapInArrow(run, T.StructType([df.schema[key], *T.StructType.fromDDL("n_shingles long, n_distinct long").fields]))


def word_count(c) -> Column:
    return F.regexp_count(_col(c), F.lit(r"\S+"))


def normalise(c) -> Column:
    """Without a byte-order mark; CRLF and CR become LF."""
    return F.regexp_replace(F.regexp_replace(_col(c), "^﻿", ""), "\r\n?", "\n")


def is_blank(c) -> Column:
    return _col(c).rlike(r"^[\s\p{Z}\x{FEFF}]*$")


def squeeze(c) -> Column:
    """Lower case, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"\s+", " "))


def unsegmented_share(c) -> Column:
    """Share of letters in scripts without word separators; 0 without letters."""
    letters = F.regexp_count(_col(c), F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(_col(c), F.lit(UNSEGMENTED)) / letters).otherwise(F.lit(0.0))


def punctuation_rates(c, n_tokens: Column) -> dict[str, Column]:
    """Occurrences per 1,000 tokens of ten classes."""
    return {k: F.when(n_tokens > 0, F.regexp_count(_col(c), F.lit(p)) * 1000.0 / n_tokens).otherwise(F.lit(0.0)) for k, p in PUNCTUATION.items()}


def mark_counts(t: str | None) -> list[int | None]:
    """Occurrences of the ten classes; unknown for null."""
    return [None if t is None else sum(map(t.count, chars)) for chars in MARKS.values()]


def counted_marks(df, *keep: str):
    """``keep`` and the occurrences of each class of punctuation in ``text``, one column a class."""
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            counts = zip(*[mark_counts(t.as_py()) for t in b.column(0)]) if len(b) else [()] * len(MARKS)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(x, pa.int64()) for x in counts)], [*keep, *MARKS])

    fields = [df.schema[k] for k in keep] + [T.StructField(k, T.LongType()) for k in MARKS]
    return df.select("text", *keep).mapInArrow(run, T.StructType(fields))


_NAMED = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "mdash": "—", "ndash": "–", "hellip": "…", "amp": "&"}
_BLOCKS = "h[1-6]|blockquote|article|section|div|tr|li|br|p"


def _entity(mark: str, base: int):
    """A step that replaces one numeric entity by its character."""

    def put(s, d):
        n = F.conv(d, base, 10).cast("int")
        wide = F.concat(F.lpad(F.hex(F.lit(55296) + F.shiftright(n - 65536, 10)), 4, "0"), F.lpad(F.hex(F.lit(56320) + (n - 65536).bitwiseAND(F.lit(1023))), 4, "0"))
        char = F.decode(F.unhex(F.when(n < 65536, F.lpad(F.hex(n), 4, "0")).otherwise(wide)), "UTF-16BE")
        plain = (n > 0) & (n < 1114112) & ~n.between(55296, 57343)
        done = F.replace(F.replace(s, F.concat(F.lit(mark), d, F.lit(";")), char), F.concat(F.lit(mark.upper()), d, F.lit(";")), char)
        return F.when(plain, done).otherwise(s)

    return put


def html_text(c) -> Column:
    """Visible text of a page: scripts, styles and comments go, blocks become lines, other tags spaces."""
    x = F.regexp_replace(_col(c), r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = F.aggregate(F.array_distinct(F.regexp_extract_all(x, F.lit(r"&#(\d{1,7});"), F.lit(1))), x, _entity("&#", 10))
    x = F.aggregate(F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?i)&#x([0-9a-f]{1,6});"), F.lit(1))), x, _entity("&#x", 16))
    for name, char in _NAMED.items():
        x = F.regexp_replace(x, f"(?i)&{name};", char.replace("$", r"\$"))
    x = F.regexp_replace(x, "[ \t\u00a0]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r"\n\s*\n\s*", "\n"), r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def warc_body(c) -> Column:
    """What follows the second blank line of a response record."""
    return F.element_at(F.split(_col(c), "\r\n\r\n", 3), 3)


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def suggest_flag(given: str, known: list[str]) -> str | None:
    """The nearest known flag within max(2, a third of its length) edits."""
    best = None
    for k in known:
        row = list(range(len(k) + 1))
        for i, a in enumerate(given, 1):
            row, left = [i], row
            for j, b in enumerate(k, 1):
                row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (a != b)))
        if row[-1] <= max(2, len(k) // 3) and (best is None or row[-1] < best[0]):
            best = (row[-1], k)
    return best and best[1]

"""Byte-level BPE ids of whole texts, by the tokenizers library, at corpus speed.

The vocabulary's splitting pattern always ends a token before a space that is
followed by a visible character and around a line feed between visible
characters, whatever else the text holds. So the space-separated chunks of such
a text encode independently: each distinct chunk goes through the library once
and its ids are kept in a bounded table of the worker; a text is then a gather.
Texts in which that does not hold (runs of white space, unprintable characters,
a special token's string) go through the library whole.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textweir.llm.common import explode_ranges, trim

_HERE: dict = {}
#: Runs of white space, unprintable characters, and any white space but the space and the line feed.
_ODD = r"[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f-\x{a0}]|[\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2060}\x{3000}\x{feff}]"
#: A line feed, a word and punctuation: the usual chunk, split as the vocabulary's pattern does.
_USUAL = re.compile("(\n?)( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Codes(dict):
    """chunk -> code; an unknown chunk gets the next code and waits to be encoded."""

    def __init__(self, owner):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = self.owner.wait(chunk[1:] if chunk[:1] == "\r" else chunk if chunk[:1] == "\n" else " " + chunk)
        return code


class WordEncoder:
    """``end_id`` closes each document. ``max_chunks`` bounds the table (about 150 bytes each)."""

    def __init__(self, path: str, end_id: int = 0, max_chunks: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())
        self.odd = _ODD + ("|" + self.special if self.special else "")
        self.end_id, self.max_chunks = end_id, max_chunks
        self.model, self.letters = self.tok.model, _byte_letters()
        self.feed = self.tok.encode("\n", add_special_tokens=False).ids
        self._reset()

    def _reset(self) -> None:
        self.table = _Codes(self)
        self.marks: dict[str, list[int]] = {"": []}
        self.pending: list[str] = []
        self.next = self.filled = self.used = 0
        self.off, self.cnt, self.val = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.again = np.zeros(1 << 16, bool)  # met in a later batch than the one that brought it
        self.next = 1  # code 0: the end
        self._store([[self.end_id]])

    def wait(self, text: str) -> int:
        self.pending.append(text)
        self.next += 1
        return self.next - 1

    def _store(self, ids: list[list[int]]) -> None:
        n = self.filled + len(ids)
        while n > len(self.off):
            self.off, self.cnt = np.resize(self.off, 2 * len(self.off)), np.resize(self.cnt, 2 * len(self.cnt))
            self.again = np.concatenate([self.again, np.zeros(len(self.again), bool)])
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lens.sum())
        while self.used + total > len(self.val):
            self.val = np.resize(self.val, 2 * len(self.val))
        self.val[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
        ends = self.used + np.cumsum(lens)
        self.off[self.filled : n], self.cnt[self.filled : n] = ends - lens, lens
        self.filled, self.used = n, self.used + total

    def _shrink(self) -> None:
        """Keep the chunks met again; if those fill half the table, start anew."""
        kept = [(chunk, code) for chunk, code in self.table.items() if self.again[code]]
        off, cnt, val = self.off, self.cnt, self.val
        self._reset()
        if 2 * len(kept) < self.max_chunks:
            codes = np.fromiter((code for _, code in kept), np.int64, len(kept))
            n = cnt[codes].astype(np.int64)
            ids = val[explode_ranges(off[codes], n)]
            for chunk, _ in kept:
                dict.__setitem__(self.table, chunk, self.next)
                self.next += 1
            while 1 + len(kept) > len(self.off):
                self.off, self.cnt, self.again = np.resize(self.off, 2 * len(self.off)), np.resize(self.cnt, 2 * len(self.cnt)), np.zeros(2 * len(self.again), bool)
            while self.used + len(ids) > len(self.val):
                self.val = np.resize(self.val, 2 * len(self.val))
            self.val[self.used : self.used + len(ids)] = ids
            ends = self.used + np.cumsum(n)
            self.off[1 : 1 + len(kept)], self.cnt[1 : 1 + len(kept)] = ends - n, n
            self.filled, self.used = 1 + len(kept), self.used + len(ids)
        trim()

    def _model(self, s: str) -> list[int]:
        s = s.replace(" ", "\u0120") if s.isascii() else s.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(s)]

    def _ids(self, s: str) -> list[int]:
        m = _USUAL(s)
        if not m:
            return self.tok.encode(s, add_special_tokens=False).ids
        feed, word, mark = m.groups()
        if mark not in self.marks:
            self.marks[mark] = self._model(mark)
        ids = self._model(word) + self.marks[mark]
        return self.feed + ids if feed else ids

    def codes(self, texts: list[str], end: bool):
        """Chunk codes of all texts, and where each text's codes stop."""
        if self.next > self.max_chunks:
            self._shrink()
        if not texts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        odd = np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), self.odd).to_numpy(zero_copy_only=False)).tolist()
        usual = texts
        if odd:
            usual = list(texts)
            for i in odd:
                usual[i] = ""
        joined = ("\r" + " \r".join(usual)).replace("\n", " \n")
        chunks = pc.split_pattern(pa.array([joined], pa.large_string()), " ").values.dictionary_encode()
        keys = chunks.dictionary.to_numpy(zero_copy_only=False)
        at = chunks.indices.to_numpy()
        known = self.filled
        codes = np.fromiter(map(self.table.__getitem__, keys), np.int64, len(keys))
        self.again[codes[codes < known]] = True
        seq = codes[at]
        first = np.flatnonzero(np.fromiter((k[:1] == "\r" for k in keys), bool, len(keys))[at])
        for i in odd:  # the whole text is one chunk, and not kept by name
            seq[first[i]] = self.wait(texts[i])
        stops = np.append(first[1:], len(seq))
        if end:
            seq = np.insert(seq, stops, 0)
            stops = stops + np.arange(1, len(stops) + 1)
        self._store([self._ids(s) for s in self.pending])
        self.pending = []
        return seq, stops

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text, without an end."""
        c, stops = self.codes(texts, False)
        total = np.concatenate([[0], np.cumsum(self.cnt[c], dtype=np.int64)])
        return np.diff(total[np.concatenate([[0], stops])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), each text's followed by the end id, and the number of each."""
        c, stops = self.codes(texts, True)
        n = self.cnt[c].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        return self.val[explode_ranges(self.off[c], n)], np.diff(total[np.concatenate([[0], stops])])


def encoder(path: str, end_id: int = 0) -> WordEncoder:
    """This worker's encoder; its table lives as long as the worker."""
    key = (path, end_id)
    if key not in _HERE:
        _HERE[key] = WordEncoder(path, end_id)
    return _HERE[key]


def in_batches(texts, limit: int = 1 << 21):
    """(from, to) ranges of about ``limit`` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)

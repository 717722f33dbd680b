"""Binary form of an n-gram index: sorted keys as delta varints, owners beside them.

Layout: magic, then six little-endian u32 (codec version, sizes of metadata,
keys, flags, key stream, owner stream), then those parts. A flag bit marks a key
with several owners. The index is small by design, so this runs on the driver.
"""

from __future__ import annotations

import gzip
import json
import os
import struct
import zlib

from textweir.errors import IndexMissingError, IndexTruncatedError, IndexUnreadableError, IndexVersionError

MAGIC, CODEC, FORMAT = b"TXWEIRIX", 1, 3


def _varint(v: int, out: bytearray) -> None:
    while v >= 128:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)


class _Reader:
    def __init__(self, raw: bytes, at: int, stop: int):
        self.raw, self.at, self.stop = raw, at, stop

    def varint(self) -> int:
        v = shift = 0
        while True:
            if self.at >= self.stop:
                raise IndexTruncatedError("a stream ends inside a number")
            b = self.raw[self.at]
            self.at += 1
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                return v


def encode_index(meta: dict, owners: dict[int, list[int]], magic: bytes = MAGIC) -> bytes:
    keys, own, flags = bytearray(), bytearray(), bytearray(-(-len(owners) // 8))
    last = 0
    for i, key in enumerate(sorted(owners)):
        _varint(key - last, keys)
        last = key
        first, *rest = sorted(owners[key])
        _varint(first, own)
        if rest:
            flags[i >> 3] |= 1 << (i & 7)
            _varint(len(rest), own)
            for o in rest:
                _varint(o - first, own)
                first = o
    head = json.dumps({"formatVersion": FORMAT} | meta, ensure_ascii=False, separators=(",", ":")).encode()
    return magic + struct.pack("<6I", CODEC, len(head), len(owners), len(flags), len(keys), len(own)) + head + bytes(flags) + bytes(keys) + bytes(own)


def decode_index(raw: bytes, magic: bytes = MAGIC) -> tuple[dict, dict[int, list[int]]]:
    """Metadata and owners of each key; gzip is found by its first bytes."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if raw[: len(magic)] != magic:
        raise IndexUnreadableError("not an index file")
    at = len(magic)
    if len(raw) < at + 24:
        raise IndexTruncatedError("no whole header")
    codec, n_meta, n, n_flags, n_keys, n_own = struct.unpack_from("<6I", raw, at)
    if codec != CODEC:
        raise IndexVersionError(f"codec {codec}, this reads {CODEC}")
    at += 24
    if len(raw) != at + n_meta + n_flags + n_keys + n_own:
        raise IndexTruncatedError("the parts do not have the promised sizes")
    meta = json.loads(raw[at : at + n_meta])
    if meta.get("formatVersion") != FORMAT:
        raise IndexVersionError(f"format {meta.get('formatVersion')}, this reads {FORMAT}")
    flags = raw[at + n_meta : at + n_meta + n_flags]
    at += n_meta + n_flags
    keys, own = _Reader(raw, at, at + n_keys), _Reader(raw, at + n_keys, at + n_keys + n_own)
    out, last = {}, 0
    for i in range(n):
        last += keys.varint()
        o = [own.varint()]
        if flags[i >> 3] >> (i & 7) & 1:
            for _ in range(own.varint()):
                o.append(o[-1] + own.varint())
        out[last] = o
    if keys.at != keys.stop or own.at != own.stop:
        raise IndexTruncatedError("a stream is longer than its keys")
    return meta, out


def portable_owners(index) -> dict[int, list[int]]:
    """53-bit keys of a built index with their owners, for the file form."""
    from pyspark.sql import functions as F

    from textweir.functions.hashing import fnv1a, gram_key
    from textweir.operators.index import grams

    n, size = index.n, F.size("tokens")
    h = index.items.filter(size >= n).withColumn("h", F.transform("tokens", fnv1a))
    spans = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: gram_key(F.slice("h", i, n)))
    files = h.select("item_idx", F.posexplode(spans).alias("off", "file_key"))
    g = grams(index.items, n, "item_idx").join(index.rows, ["item_idx", "key"], "left_semi").join(files, ["item_idx", "off"])
    rows = g.groupBy("file_key").agg(F.collect_set("item_idx").alias("o")).collect()
    return {r.file_key: sorted(r.o) for r in rows}


def load_json(raw: bytes) -> tuple[dict, dict[int, list[int]]]:
    """The plain form: ``keys`` and ``items`` side by side among the metadata."""
    meta = json.loads(raw)
    if not isinstance(meta, dict) or "keys" not in meta or "items" not in meta:
        raise IndexUnreadableError("no keys and items")
    if meta.get("formatVersion") != FORMAT:
        raise IndexVersionError(f"format {meta.get('formatVersion')}, this reads {FORMAT}")
    keys, items = meta.pop("keys"), meta.pop("items")
    if len(keys) != len(items):
        raise IndexTruncatedError(f"{len(keys)} keys, {len(items)} lists of items")
    return meta, {int(k): sorted(o) for k, o in zip(keys, items)}


def resolve_index(value: str, folder: str | None = None) -> str:
    """A path, or the name of an index in ``folder``."""
    if os.path.isdir(value):
        raise IndexUnreadableError(f"{value} is a folder, not an index file")
    if os.path.exists(value):
        return value
    known = sorted(f.removesuffix(SUFFIX) for f in (os.listdir(folder) if folder and os.path.isdir(folder) else ()) if f.endswith(SUFFIX))
    if value in known:
        return os.path.join(folder, value + SUFFIX)
    raise IndexMissingError(f"no index {value}" + (f"; there are {', '.join(known)}" if known else ""))


#: Index files are found by their name with this behind it.
SUFFIX = ".idx.bin.gz"


def read_index(path: str, magic: bytes = MAGIC) -> tuple[dict, dict[int, list[int]]]:
    """Metadata and owners from a file, JSON by its name, else binary; gzip by its first bytes."""
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except OSError as e:
        raise IndexUnreadableError(f"{path}: {e}") from e
    try:
        if path.endswith(".json"):
            return load_json(raw)
        return decode_index(raw, magic)
    except (EOFError, zlib.error, gzip.BadGzipFile) as e:
        raise IndexTruncatedError(f"{path}: the gzip data is cut short or broken ({len(raw)} bytes were read)") from e
    except (json.JSONDecodeError, UnicodeDecodeError) as e:
        raise IndexUnreadableError(f"{path}: {e}") from e


def index_meta(index, benchmark: str, identity: str, noun: tuple[str, str] = ("item", "items")) -> dict:
    """Metadata of a built index, as files carry it."""
    blind = index.uncheckable().collect()
    stats = index.stats.collect()[0].asDict()
    return {
        "benchmark": benchmark, "benchmarkHash": identity, "n": index.n, "stride": index.stride, "itemNoun": {"one": noun[0], "many": noun[1]}, "stats": stats,
        "itemIds": [str(r.item_id) for r in index.items.select("item_idx", "item_id").orderBy("item_idx").collect()],
        "uncheckableItemIds": sorted(str(r.item_id) for r in blind), "unsegmentedItemIds": sorted(str(r.item_id) for r in blind if r.unsegmented),
    }


def write_index(index, path: str, benchmark: str, identity: str, noun: tuple[str, str] = ("item", "items")) -> dict:
    """Write a built index: JSON if the name says so, else the binary form, gzipped if the name ends in .gz. Returns the metadata."""
    meta, owners = index_meta(index, benchmark, identity, noun), portable_owners(index)
    if path.endswith(".json"):
        raw = json.dumps({"formatVersion": FORMAT} | meta | {"keys": sorted(owners), "items": [owners[k] for k in sorted(owners)]}, ensure_ascii=False).encode()
    else:
        raw = encode_index(meta, owners)
        raw = gzip.compress(raw, 9, mtime=0) if path.endswith(".gz") else raw
    with open(path, "wb") as f:
        f.write(raw)
    return meta

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import bigrams, fingerprint, groups, lines, substrings, unigrams

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "The quick brown fox jumps over the lazy dog, says line "


def texts(n=60, seed=1):
    """Random texts with shared lines, near copies, nulls, empty and long ones, ties and repeated rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "of", "and"] * 40
    out = []
    for i in range(n):
        body = "\n".join(" ".join(r.choices(words, k=r.randint(1, 30))) + "." for _ in range(r.randint(1, 6)))
        if i % 4 == 0:
            body += f"\n  {LONG}{i % 3} \t"
        if i % 7 == 0 and out:
            body = (out[-1][1] or "x") + (" tail" if i % 2 else "")
        out.append((i, body))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, LONG + "0\nsecond"), (n + 3, "é " * 3000 + "\n" + LONG + "1"), (n + 4, "a" * 700)]
    return out + [out[4], out[8]]


SCHEMA = "doc_id long, text string, source string, n_words long, rid string, th string, kept string, h string, suspects int"


def frame(spark, rows):
    """With other columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, "s", 1, "r", "t", "k", "h", 1) for d, t in rows], SCHEMA).repartition(3)


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, rows, empty):
    from textweir.llm.line_dedup import dedup_lines

    got = [(d, n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, k, t in by_id(dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "text")]
    assert sorted(got, key=repr) == sorted(lines(rows), key=repr)
    assert sum(g[2] for g in got) > 0
    assert dedup_lines(empty).count() == 0


def test_line_dedup_of_many_rows_without_an_id(spark):
    """They are one document for counting, and each loses what it must."""
    from textweir.llm.line_dedup import dedup_lines

    rows = [(None, f"{LONG}{k % 4}\nown line of row number {k}") for k in range(30)] + [(k, f"{LONG}{k % 3}") for k in range(9)] + [(None, None)]
    got = [(d, n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, k, t in by_id(dedup_lines(frame(spark, rows)), "doc_id", "n_lines", "n_dropped", "text")]
    assert sorted(got, key=repr) == sorted(lines(rows), key=repr)


def test_line_dedup_with_a_full_filter(docs, rows):
    """A filter too small for its keys only makes more lines suspect."""
    from textweir.llm.line_dedup import dedup_lines

    got = [(d, n, k) for d, n, k in by_id(dedup_lines(docs, max_filter_bits=8 * 512), "doc_id", "n_lines", "n_dropped")]
    assert got == sorted(((d, n, k) for d, n, k, _ in lines(rows)), key=repr)


def test_quality_rules(docs, rows, empty):
    from textweir.llm.quality_rules import failing_lines, line_fails, line_first_rules, repeated_words

    assert line_fails(b"a | b | c | d") and line_fails(b"BUY!! NOW!! HERE!! OK!!") and line_fails(b"Released under the MIT License.")
    assert not line_fails(b"A plain sentence with words, and more.") and not line_fails(b" \t")
    assert line_fails(b"Home | About | Contact") and line_fails(b"  Home About Us Contact ") and line_fails(b"Next Previous >>") and not line_fails(b"We went home to search for help.")
    assert line_fails(" ".join(["Wörter"] * 25).encode()) and not line_fails((" ".join(["wörter"] * 30) + "。").encode()) and not line_fails(b"word " * 24)
    long = b"word, " * 30
    assert line_fails(b"all rights reserved, " + b"x " * 20) and not line_fails(b"all rights reserved " + long) and line_fails(b"all rights reserved, privacy policy " + b"x, " * 30)
    labels = [b"Red shoes", b"", b"Blue shoes", b"Hats", b"Coats and gloves"]
    assert failing_lines(labels) == [True, False, True, True, True] and failing_lines([*labels[:4], b"So we left."]) == [False] * 5
    assert failing_lines([b"Prose, with marks."] * 5) == [False] * 5 and failing_lines([b"x", *labels]) == [True, True, False, True, True, True]
    assert repeated_words(b"a b c d e a b c d e".split()) == 10 and repeated_words(b"a a a a a a".split()) == 6 and repeated_words(b"a b c d e".split()) == 0
    out = line_first_rules(docs)
    assert out.count() == len(rows)
    for r in out.collect():
        if r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words:
            assert r.base_failed and not r.kept
    assert line_first_rules(empty).count() == 0


def test_quality_rules_against_sql(spark, tmp_path):
    """Lines of every rule, in texts that also have nulls, ties and repeated rows."""
    import duckdb

    from textweir.llm.quality_rules import OP3_SQL, op3_quality_rules

    r = random.Random(31)
    pool = ["Home About Contact", "Login Register Search |", "Red shoes", "Hats", "", " \t", "A sentence of prose, closed.", "all rights reserved", "Licensed under X " * 9, "w " * 26, "BUY!! NOW!! IT!! IS!!", "# a | b", "é … d’une “chose”", "文章です。", "{ x }", "word " * 12 + "terms of use", "Terms of use privacy policy " + "y, " * 40, "back to top", "Next Page", "Sign in", "tail\u00a0nbsp", "x y z w"]
    table = [(i, "\n".join(r.choices(pool, k=r.randint(0, 14)))) for i in range(400)] + [(None, None), (7, "Hats\nHats\nHats\nHats")]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(OP3_SQL).fetchall()
    names = [c[0] for c in con.sql(OP3_SQL).description]
    got = op3_quality_rules(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {g.kept for g in got if not g.base_failed} == {True, False}


def test_url_filters(spark):
    from textweir.llm.url_filters import RULE, RULES, host_path, judge_by_join, judge_urls

    urls = ["https://example.org/es/1", "https://a.b.Example.org/en/12?x", "http://example.org", "http://x.org/a#b", "ftp://com/fr/", "http://www.com/de/x/fr/", "http://acom/fr/", None, "", "no scheme", "http://", "://org/", "http://forg/", "http://example.org/en/1", "http://example.org/e", "http://u:p@org:8/x"]
    pages = spark.createDataFrame([(i % 12, u, "x", "y") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, key string")
    a = by_id(judge_urls(pages), "page_id", "host", "path", "rule", "verdict")
    assert a == by_id(judge_urls(pages, max_broadcast_rules=1), "page_id", "host", "path", "rule", "verdict")
    want = {"https://example.org/es/1": "example.org/es/", "https://a.b.Example.org/en/12?x": "example.org/en/1", "http://example.org": None, "http://x.org/a#b": "org/", "ftp://com/fr/": "com/fr/", "http://www.com/de/x/fr/": "com/de/", "http://acom/fr/": None, None: None, "://org/": "org/", "http://forg/": None}
    one = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    got = {r.page_id: r.rule for r in judge_urls(one).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    table = spark.createDataFrame(RULES, RULE)
    for rules, bound in ((table, 1), (table, 10)):
        assert by_id(judge_urls(pages, rules, max_broadcast_rules=bound), "page_id", "host", "path", "rule", "verdict") == a
    host, path = host_path(pages.url)
    salted = judge_by_join(pages.select("page_id", host.alias("host"), path.alias("path")), table, "allow", hot=1, salts=3)
    assert by_id(salted, "page_id", "host", "path", "rule", "verdict") == a


def test_url_filters_against_every_rule(spark):
    """The longest fitting rule by a plain search, for many nested rules and hosts."""
    from textweir.llm.url_filters import judge_urls

    r = random.Random(51)
    host = lambda: ".".join(r.choices(["a", "b", "co", "uk", "org"], k=r.randint(1, 4)))
    path = lambda: "".join(r.choices(["/", "x", "y", "/x"], k=r.randint(0, 4)))
    rules = sorted({(host(), "/" + path()): r.choice(["allow", "block"]) for _ in range(80)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{host()}/{path()}{r.choice(['', '?q=/x', '#y'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    want = []
    for i, u in enumerate(urls):
        h, _, p = u[7:].partition("/")
        p = "/" + p.split("?")[0].split("#")[0]
        fits = [(len(a) + len(b), len(a), v == "block", a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, default=None)
        want.append((i, h, p, best and best[3], best[4] if best else "block"))
    for bound in (1000, 1):
        assert by_id(judge_urls(pages, rules, "block", bound), "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)


ODD = ["a  b", "\n\nx", " x ", "x\n", "", "a\tb c", "é ñ x <|endoftext|> y", "don't I'll  \n  z", "x\n y", "日本 語", "a ​z", "🙂 🙂🙂x", "1 2\n3", "a\nb\nc.", "\n", "'tis a.b,c !!x", "Ünî.", "x²", "ª", " a", "\r", "a \x00 b"]


def test_encoder_is_exact(rows):
    from textweir.llm.bpe import WordEncoder

    enc = WordEncoder(PATH, max_chunks=50)
    every = ODD + [t or "" for _, t in rows]
    for batch in (every, every[::-1], every):
        ids, n = enc.encode(batch)
        want = [enc.tok.encode(t, add_special_tokens=False).ids + [0] for t in batch]
        assert ids.tolist() == [x for w in want for x in w] and n.tolist() == list(map(len, want))
        assert enc.counts(batch).tolist() == [len(w) - 1 for w in want]


def test_elias_fano():
    from textweir.llm.token_output import EliasFano

    r = np.random.default_rng(3)
    for v in ([], [0], [7], [5, 5, 5], np.sort(r.integers(0, 1 << 40, 3000)), np.cumsum(r.integers(0, 3, 5000))):
        e = EliasFano.encode(np.array(v, np.int64))
        f, _ = EliasFano.load(memoryview(e.dump()), 0)
        assert f.decode().tolist() == list(map(int, v))
        assert [f.select(i) for i in range(0, len(v), 37)] == [int(x) for x in list(v)[::37]]
        for a, z in ((0, len(v)), (3, 4), (511, 513), (512, 1024), (1000, 2900), (len(v) - 1, len(v))):
            if 0 <= a < z <= len(v):
                assert f.slice(a, z).tolist() == list(map(int, v[a:z]))
    big = EliasFano.encode(np.sort(r.integers(0, 1 << 30, 10000)))
    assert len(big.dump()) * 8 < 10000 * (2 + 17 + 2)


def test_token_output_round_trip(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    from textweir.llm.token_output import read_tokens, write_tokens

    tok = Tokenizer.from_file(PATH)
    got = sorted(read_tokens(spark, write_tokens(docs, PATH), with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    by = {}
    for d, t in rows:
        by.setdefault(d, []).append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    at = 0
    for r in got:
        assert list(r.ids) in by[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert read_tokens(spark, write_tokens(empty, PATH)).count() == 0


def test_token_shards_are_read_by_offsets(tmp_path):
    """Blocks of any size, documents longer than a block, nulls, and a file that is cut."""
    from pyarrow import fs

    from textweir.llm.token_output import Shard, ShardWriter

    r = random.Random(21)
    lengths = [r.choice([1, 2, 7, 900, 40_000]) for _ in range(700)]
    doc_ids = [None, None, *sorted(r.randrange(-(10**12), 10**12) for _ in range(698))]
    ids = np.random.default_rng(1).integers(0, 50_000, sum(lengths))
    cut = np.cumsum([0, *lengths])
    local = fs.LocalFileSystem()
    with local.open_output_stream(f"{tmp_path}/a") as f:
        w = ShardWriter(f, 2)
        for a in range(0, 700, 90):
            z = min(700, a + 90)
            w.add(doc_ids[a:z], np.array(lengths[a:z]), ids[cut[a] : cut[z]])
        w.close()
    with local.open_input_file(f"{tmp_path}/a") as f:
        s = Shard(f)
        assert [s.span(i) for i in range(0, 700, 31)] == [(cut[i], cut[i + 1]) for i in range(0, 700, 31)]
        for docs, most in ((4096, 1 << 22), (13, 1000), (1, 1)):
            got = list(s.blocks(docs, most))
            assert [d for b in got for d in b[0]] == doc_ids and np.concatenate([b[3] for b in got]).tolist() == ids.tolist()
            assert np.concatenate([b[1] for b in got]).tolist() == cut[:-1].tolist() and np.concatenate([b[2] for b in got]).tolist() == cut[1:].tolist()
    raw = (tmp_path / "a").read_bytes()
    (tmp_path / "b").write_bytes(raw[:-5])
    with local.open_input_file(f"{tmp_path}/b") as f, pytest.raises(ValueError):
        Shard(f)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    from textweir.llm.common import materialize
    from textweir.llm.packing import lower_bound, pack, token_pieces

    tok, want = Tokenizer.from_file(PATH), {}
    for d, t in rows:  # pieces from the end, so that only the first may be shorter; rows that share an id all count
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        want.setdefault(d, []).extend((k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:])))
    want = {d: sorted(x) for d, x in want.items()}
    pieces = materialize(token_pieces(docs, PATH, 64))
    for r in materialize(token_pieces(docs, PATH, 64, with_ids=True)).collect():
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for size in (7, 1 << 18):
        got = pack(pieces, 64, per_group=size).collect()
        assert len(got) == pieces.count()
        by, docs_of = {}, {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
            docs_of.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        for seq in by.values():
            at = 0
            for offset, length in sorted(seq):
                assert offset == at
                at += length
            assert at <= 64
        assert {d: sorted(x) for d, x in docs_of.items()} == want
        counts = np.bincount([r.length for r in got if r.length < 64], minlength=65)
        bound = lower_bound(counts, 64) + sum(r.length == 64 for r in got)
        assert bound <= len(by) <= 1.02 * bound  # groups of seven pieces, too
    assert pack(materialize(token_pieces(empty, PATH))).count() == 0


def test_lower_bound_holds():
    from textweir.llm.packing import best_fit_decreasing, lower_bound

    r = np.random.default_rng(5)
    assert lower_bound(np.bincount([6] * 9, minlength=11), 10) == 9
    for _ in range(200):
        x = r.integers(1, 20, r.integers(1, 30))
        bins, offsets, fill = best_fit_decreasing(x, 20)
        assert lower_bound(np.bincount(x, minlength=21), 20) <= len(fill) and fill.max() <= 20 and fill.sum() == x.sum()


def test_edit_counts(spark, rows):
    from tokenizers import Tokenizer

    from textweir.llm.token_counts import edit_counts, redaction_edits, segments

    tok = Tokenizer.from_file(PATH)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    r, table = random.Random(4), []
    for i, (d, t) in enumerate(rows + [(1000 + i, o * 9) for i, o in enumerate(ODD)]):
        size = len(t or "")
        edits = [(r.randint(0, size + 3), r.randint(0, size + 9), r.choice(["", " ", "\n", "new words", None, "’x ", " a  b"])) for _ in range(r.randint(0, 5))]
        table.append((d, t, edits if i % 6 else None))
    df = spark.createDataFrame(table, "doc_id long, text string, edits array<struct<start:int,stop:int,new:string>>").repartition(2)
    want = []
    for d, t, edits in table:
        old = new = t or ""
        for a, z, x in edits or ():
            a = min(a, len(new))
            z = min(max(z, a), len(new))
            new = new[:a] + (x or "") + new[z:]
        want.append((d, count(old), count(new), new))
    assert by_id(edit_counts(df, PATH, segment=16, with_text=True), "doc_id", "n_tokens", "n_tokens_after", "text") == sorted(want, key=repr)
    assert "".join(segments("a b  c " * 99, 16)) == "a b  c " * 99
    found = redaction_edits(spark.createDataFrame([(1, "mail a.b@c.org or 10.0.0.1, 5555-123456 end")], "doc_id long, text string")).collect()[0]
    assert len(found.edits) == 3


def test_op2_redacts_and_counts_whole_documents(spark, tmp_path):
    """The query itself against the substitution of every match and the encoding of whole texts."""
    import re

    from tokenizers import Tokenizer

    from textweir.llm.token_counts import op2_token_counts

    plain = r"[\w.+-]+@[\w-]+\.[\w.]+|\b[0-9a-f]{32,}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d(?:[ -]?\d){6,}\b"
    r = random.Random(41)
    odd = ["a.b@c.org", "@@x", "+a-b.@d-e.f.g", "abcdef" * 6, "0" * 31, "f" * 32 + "g", "f" * 40, "10.0.0.1", "1.2.3", "٣٤٥٦٧٨٩", "4111 1111 1111 1111", "555-1234", "x@y", "word", "\n", "é@ü.de", "a" * 300 + "@b.c"]
    table = [(i, " ".join(r.choices(odd, k=r.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "x" * 20_000 + " " + "f" * 36), (None, "a@b.c"), (62, "a@b.cd " * 900)]
    spark.createDataFrame(table, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    want = [(d, count(t or ""), len(re.findall(plain, t or "")), count(re.sub(plain, "[redacted]", t or "")), len(re.sub(plain, "[redacted]", t or ""))) for d, t in table]
    got = by_id(op2_token_counts(spark, str(tmp_path)), "doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars")
    assert got == sorted(want, key=repr) and sum(w[2] for w in want) > 200


def test_a_segment_that_grows_is_cut_anew():
    from textweir.llm.bpe import WordEncoder
    from textweir.llm.token_counts import TokenTree, segments

    enc, r = WordEncoder(PATH), random.Random(42)
    cut = segments("one two three " * 40, 64)
    tree, text = TokenTree(cut, enc.counts(cut), enc, 64), "one two three " * 40
    for _ in range(400):  # all at one place
        word = r.choice(["alpha ", "beta, ", "gamma\n", " "])
        at = 100 + r.randint(0, 3)
        text = text[:at] + word + text[at:]
        assert tree.edit(at, at, word) == enc.counts([text])[0]
    assert tree.text() == text and tree.size == len(text)
    assert max(map(len, tree.leaves)) < 400 and tree.encoded < 400 * 400


def test_simhash(spark, docs, rows, empty):
    from textweir.llm.simhash import near_duplicates

    ids = [d for d, _ in rows]
    fps = [fingerprint(t) for _, t in rows]
    near, low = groups(fps)
    members = {}
    for i, k in enumerate(low):
        members.setdefault(k, []).append(ids[i])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    want = sorted(((d, f"{f:016x}", n, least[k]) for d, f, n, k in zip(ids, fps, near, low)), key=repr)
    for options in ({}, {"max_block": 5, "max_local": 0}):
        assert by_id(near_duplicates(docs, **options), "doc_id", "fingerprint", "n_near", "component_id") == want
    assert near_duplicates(empty).count() == 0


def test_close_pairs():
    from textweir.llm.simhash import close_pairs

    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 40, np.uint64)
    x = np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 64, 40, np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40, np.uint64)) for _ in range(3)])
    for radius in (0, 1, 3, 4, 7):
        got = {(int(a), int(b)) for i, j in close_pairs(x, x, radius) for a, b in zip(i, j)}
        assert got == {(i, j) for i in range(len(x)) for j in range(len(x)) if int(x[i] ^ x[j]).bit_count() <= radius}


def test_suffix_dedup(docs, rows, empty):
    from pyspark.sql import functions as F

    from textweir.llm.suffix_dedup import remove_repeats

    got = {}
    th = {(r.doc_id, r.text): r.th for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    once = {}
    for d, t in rows:
        once[d, th[d, t]] = (t or "").encode()
    order = sorted(once, key=lambda k: (-(2**63) if k[0] is None else k[0], k[1]))
    want = dict(zip(order, substrings([once[k] for k in order], 40)))
    for hot in (1 << 16, 1, 3):  # no anchor, all, and some are split by windows
        got = {}
        for r in remove_repeats(docs, 40, 16, hot=hot).collect():
            got.setdefault((r.doc_id, r.n_bytes), set()).add((r.n_bytes, r.n_removed, r.n_spans, bytes(r.text)))
        for (d, k), w in want.items():
            assert w in got[d, w[0]]
    assert sum(w[1] for w in want.values()) > 1000
    assert remove_repeats(empty).count() == 0


def test_suffix_dedup_at_full_length(spark):
    """100-byte windows, texts of one boilerplate in different surroundings, a very long text, rows that are there twice."""
    from textweir.llm.suffix_dedup import remove_repeats

    r = random.Random(22)
    junk = lambda n: "".join(r.choices("abcdefgh é\n", k=n))
    block, other = junk(180), junk(400)
    texts = [junk(r.randint(0, 300)) + block + junk(r.randint(0, 300)) for _ in range(40)]
    texts += [other[:250] + junk(5) + other[200:], other, block * 3, "", junk(60_000) + other + junk(60_000), block[:100], block[:99]]
    want = substrings([t.encode() for t in texts], 100)
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").repartition(5)
    for hot in (1 << 16, 2, 20):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.text)) for x in remove_repeats(df, hot=hot).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_merged_spans():
    from textweir.llm.suffix_dedup import merged

    r = random.Random(23)
    big = 2**63 - 1
    ids = [-big - 1, 0, 5, 1 << 40, big]
    spans = [(r.choice(ids), r.choice([0, big]), a := r.randrange(2000), a + r.randint(1, 60)) for _ in range(600)]
    want = {}
    for d, k, a, z in sorted(spans):
        runs = want.setdefault((d, k), [])
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    assert merged(np.array(spans)).tolist() == [[d, k, a, z] for (d, k), runs in sorted(want.items()) for a, z in runs]
    n = (1 << 23) + 3  # documents of one task
    many = np.stack([np.arange(n), np.zeros(n, np.int64), np.full(n, 7), np.full(n, 2**31 - 1)], axis=1)
    assert (merged(many) == many).all()


def test_blind_trie_and_deep_shallow():
    from textweir.llm.suffix_dedup import blind_trie_order, deep_shallow_order, multikey_quicksort

    r = random.Random(9)
    for _ in range(100):
        s = [bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(r.randint(1, 40))]
        assert [s[i] for i in blind_trie_order(s)] == sorted(s)
        lens = np.array([len(x) for x in s])
        grid = np.zeros((len(s), 16), np.uint8)
        for i, x in enumerate(s):
            grid[i, : len(x)] = np.frombuffer(x, np.uint8)
        assert [s[i] for i in deep_shallow_order(grid, lens, 8)] == sorted(s)
    x = np.random.default_rng(4).integers(0, 3, (5000, 4)).astype(np.uint64)
    order, ties = multikey_quicksort(x)
    rows = x[order].tolist()
    assert rows == sorted(x.tolist()) and sorted(order.tolist()) == list(range(5000))
    equal = [i for i in range(1, 5000) if rows[i] == rows[i - 1]]
    assert sorted(i for a, b in ties.tolist() for i in range(a + 1, b)) == equal


def test_lm_scores(docs, rows, empty):
    from textweir.llm.lm_scoring import LEAST, least_of, level_of, lm_scores, most_of

    n, want = unigrams(rows)
    scores = [x for _, x in sorted(zip(want, (x for _, x in bigrams(rows)[0])), key=lambda x: repr(x[0]))]
    for options in ({}, {"max_exact": 8}, {"max_bits": 1 << 13}, {"per_key": 4000}):
        got = by_id(lm_scores(docs, **options), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        assert [g[:4] for g in got] == sorted((w[:4] for w in want), key=repr)
        assert all(g[4] == n for g in got)
        for g, w, x in zip(got, sorted(want, key=repr), scores):
            assert g[5] == pytest.approx(w[4])
            assert g[6] == pytest.approx(x, rel=1e-9 if "per_key" in options else 0.02)  # false positives are rare, or ruled out
    assert lm_scores(empty).count() == 0
    c = np.arange(0, 5000)
    assert (least_of(level_of(c)) <= c).all() and (most_of(level_of(c)) >= c).all() and (most_of(level_of(c)) <= 1.5 * c).all()
    assert (np.diff(LEAST) > 0).all()


def test_lm_probabilities_sum_to_one_at_most(rows):
    _, p, word = bigrams(rows)
    for v in [None, *list(word)[:80], b"never seen"]:
        assert 0.3 < sum(p(v, w) for w in word) <= 1 + 1e-12


def test_lm_scores_do_not_depend_on_the_broadcast_bound(docs):
    from textweir.llm.lm_scoring import lm_scores

    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want, got = (by_id(lm_scores(docs, max_bits=m), *columns) for m in (1 << 26, 1))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5:] == pytest.approx(w[5:]) for g, w in zip(got, want))


def test_lm_beats_unigrams_on_held_out_text(spark):
    from textweir.llm.lm_scoring import lm_scores

    r = random.Random(8)
    follow = {f"w{i}": [f"w{r.randrange(300)}" for _ in range(3)] for i in range(300)}
    table = []
    for d in range(700):
        w = ["w0"]
        for _ in range(60):
            w.append(r.choice(follow[w[-1]]))
        table.append((d, " ".join(w)))
    out = lm_scores(spark.createDataFrame(table, "doc_id long, text string")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).collect()[0]
    assert out["sum(score)"] > out["sum(base_score)"] * 0.45  # three followers a word, of 300


def test_decontamination(spark):
    from textweir.llm.decontaminate import Item, find_leaks, words_of

    r = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    item = lambda: " ".join(r.choice(common) if r.random() < 0.4 else f"x{r.randrange(10**6)}" for _ in range(r.randint(12, 50)))
    items = [(i, item()) for i in range(40)] + [(40, None), (41, ""), (42, "too short")]
    filler = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else f"y{r.randrange(10**6)}" for _ in range(n))
    table, want = [], set()
    for d in range(200):
        t = filler(r.randint(0, 400))
        if d % 4 == 0:
            i = r.randrange(40)
            w = items[i][1].split()
            if d % 8:  # a paraphrase: every seventh word another
                w = [f"z{k}" if k % 7 == 3 else x for k, x in enumerate(w)]
            t = f"{t} {' '.join(w).upper()}. {filler(r.randint(0, 200))}"
            want.add((d, i))
        table.append((d, t))
    table += [(None, items[0][1]), (900, None), (901, "")]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in table], "doc_id long, text string, cosine double").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in find_leaks(docs, bench).collect()}
    brute = set()
    known = [Item(i, words_of(t.encode())) for i, t in items[:40]]
    for d, t in table:
        ws = words_of((t or "").encode())
        for it in known:
            for s in range(0, max(1, len(ws) - 24), 24):
                lcs, answer = it.lcs(ws[max(0, s - 24) : s + 72])
                if lcs >= 0.8 * it.n or lcs >= 0.6 * it.n and 2 * answer >= it.answer:
                    brute.add((d, it.id))
    assert want | {(None, 0)} <= brute and got <= brute
    assert len(got) >= 0.9 * len(brute)
    assert {(x.doc_id, x.item_id) for x in find_leaks(docs, bench, item_block=15).collect()} <= brute
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def planted(seed, n_items, sizes, n_docs):
    """Items that share words, and texts of which every other one holds one of them verbatim."""
    r = random.Random(seed)
    words, weights = [f"v{i}" for i in range(3000)], [1 / (i + 3) for i in range(3000)]
    prose = lambda n: " ".join(r.choices(words, weights, k=n))
    items = [(i, prose(r.choice(sizes))) for i in range(n_items)]
    table, want = [], set()
    for d in range(n_docs):
        t = prose(r.randint(40, 200))
        if d % 2:
            i = d // 2 % n_items
            t += f" {items[i][1]}. {prose(r.randint(40, 200))}"
            want.add((d, i))
        table.append((d, t))
    return items, table, want


def test_decontamination_with_more_items_than_axes(spark):
    from textweir.llm.decontaminate import find_leaks

    items, table, want = planted(61, 400, range(15, 60), 800)
    got = find_leaks(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want <= {(x.doc_id, x.item_id) for x in got}
    assert all(x.lcs >= 0.6 * x.item_words and -1.001 <= x.cosine <= 1.001 for x in got)


def test_decontamination_of_long_and_short_items(spark):
    from textweir.llm.decontaminate import find_leaks, words_of

    items, table, want = planted(62, 12, (61, 97, 121, 161, 400, 1500), 48)
    items += [(100, "Zero, one two"), (101, "lone")]
    table += [(900, "x zero one two y"), (901, "zero one x two"), (902, "two one zero"), (903, "a LONE b"), (904, items[0][1]), (905, "")]
    want |= {(900, 100), (903, 101), (904, 0)}
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert all(x.lcs == x.item_words == len(words_of(dict(items)[x.item_id].encode())) for x in got)


def test_decontamination_of_any_ids_in_small_blocks(spark):
    """Null and textual item ids, blocks of few words, and a tree of few branches give the same rows."""
    from textweir.llm import decontaminate

    items, table, want = planted(64, 30, (9, 20, 45, 200), 120)
    items = [(None if i == 0 else f"q{i}", t) for i, t in items]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(9)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = [{(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench, **o).collect()} for o in ({}, {"block_words": 64}, {"item_block": 7})]
    assert got[0] == got[1] == got[2] >= {(d, items[i][0]) for d, i in want}
    known = [decontaminate.Item(i, decontaminate.words_of(t.encode())) for i, t in items]
    one, tree = (decontaminate.fit(docs.select(docs.text.cast("binary").alias("text")), known, 48, 16, fan=f) for f in (64, 2))
    assert one[0] == tree[0] and (one[1] == tree[1]).all() and np.allclose(one[2], tree[2])
    assert decontaminate.find_leaks(docs.limit(0), bench).schema == decontaminate.find_leaks(docs, bench).schema == decontaminate.find_leaks(docs, bench.limit(0)).schema


def test_pipeline_removes_every_holder_of_an_item(spark, tmp_path):
    import corpus_pipeline

    items, table, want = planted(63, 400, (4, *range(15, 60), 300), 800)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(table, "doc_id long, text string")
    left = {x.doc_id for x in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    assert not left & {d for d, _ in want}
    assert len(left) >= 0.9 * (len(table) - len(want))


def test_pipeline(spark, rows, tmp_path):
    """run() against the stages' plain versions, on a table with more columns than documents has."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from textweir.llm.decontaminate import Item, words_of
    from textweir.llm.quality_rules import judge

    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, LONG + "0"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    table = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = f"{tmp_path}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
        if name == "quality_rules":
            judged = [(d, judge((t or "").encode(), 10, 20, 40)) for d, t in table]
            want = [(d, b"\n".join(j[7]).decode()) for d, j in judged if j[6]]
            assert got == sorted(want, key=repr)
        elif name == "line_dedup":
            want = [(d, h) for d, _, _, h in lines(table)]
            assert sorted(((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in got), key=repr) == sorted(want, key=repr)
        elif name == "near_duplicates":
            _, low = groups([fingerprint(t) for _, t in table])
            assert len(got) == len(set(low)) and {fingerprint(t) for _, t in got} <= {fingerprint(t) for _, t in table}
        elif name == "decontamination":
            it = Item(0, words_of(f"{LONG}0".encode()))

            def holds(text):
                ws = words_of(text.encode())
                for at in range(0, max(1, len(ws) - 24), 24):
                    lcs, answer = it.lcs(ws[max(0, at - 24) : at + 72])
                    if lcs >= 0.8 * it.n or lcs >= 0.6 * it.n and 2 * answer >= it.answer:
                        return True
                return False

            assert got == sorted(((d, t) for d, t in table if not holds(t)), key=repr)
        table = got
    tok, want = Tokenizer.from_file(PATH), []
    for d, t in table:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(d, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    for sequences in (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        got, by = sequences.collect(), {}
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for seq in map(sorted, by.values()):
            assert [o for o, _ in seq] == [sum(n for _, n in seq[:k]) for k in range(len(seq))] and sum(n for _, n in seq) <= 2048

import random

import pytest
from pyspark.sql.functions import max as F_max

from textweir import errors
from textweir.functions import hashing, text
from textweir.operators import exact, near, scoring, signals, studies
from textweir.operators.index import build_index
from textweir.report import benchmark_identity, html_page, scan_report, text_summary
from textweir.sources import corpus
from textweir.sources.index_codec import decode_index, encode_index, portable_owners


def words(r, n, size=100_000):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def frame(spark, docs):
    return spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")


def items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def scan(spark, docs, bench, n=10, **options):
    i = build_index(items(spark, bench), n)
    return i, exact.runs(exact.raw_hits(frame(spark, docs), i), i, **options)


def test_planted_items_are_found_and_clean_text_is_not(spark):
    r = random.Random(1)
    bench = [words(r, 30) for _ in range(10)]
    docs = [f"{words(r, 25)} {b} {words(r, 25)}" for b in bench] + [words(r, 80) for _ in range(30)]
    _, runs = scan(spark, docs, bench, 13)
    got = runs.filter("survives").collect()
    assert sorted((x.doc_id, x.item_idx, x.start, x.stop) for x in got) == [(i, i, 25, 55) for i in range(10)]


def test_common_text_is_dropped(spark):
    r = random.Random(2)
    item = words(r, 20)
    _, runs = scan(spark, [f"{words(r, 5)} {item}" for _ in range(12)], [item])
    assert runs.filter("survives").count() == 0 and runs.count() == 12


def test_rare_tail_keeps_a_run(spark):
    r = random.Random(3)
    head, tail = words(r, 40), words(r, 20)
    docs = [f"{words(r, 3)} {head}" for _ in range(10)] + [f"{words(r, 3)} {head} {tail}"]
    _, runs = scan(spark, docs, [f"{head} {tail}"])
    assert [x.doc_id for x in runs.filter("survives").collect()] == [10]


def test_truncated_run_survives_in_order_of_arrival(spark):
    r = random.Random(4)
    item = words(r, 300)
    _, runs = scan(spark, [item] * 7, [item])
    got = {x.doc_id: (x.survives, x.truncated) for x in runs.collect()}
    assert got[0] == (True, True) and got[6] == (False, False)
    _, free = scan(spark, [item] * 7, [item], order_free=True)
    assert free.filter("survives").count() == 0


def test_one_changed_word_splits_a_run(spark):
    """Runs end where no gram matches: a copy with one word changed is two runs, and text between isn't shown as matched."""
    r = random.Random(14)
    item = words(r, 40).split()
    doc = [*item[:20], "changed", *item[21:]]
    _, runs = scan(spark, [" ".join(doc)], [" ".join(item)])
    assert sorted((x.start, x.stop, x.grams) for x in runs.collect()) == [(0, 20, 11), (21, 40, 10)]
    # A rare half doesn't rescue a common one.
    half = " ".join(item[:20])
    docs = [f"{half} q{i}" for i in range(8)] + [" ".join(doc)]
    _, runs = scan(spark, docs, [" ".join(item)])
    last = {x.start: x for x in runs.filter("doc_id = 8").collect()}
    assert not last[0].survives and last[21].survives
    assert {x.condemned_by for x in exact.dropped(runs).collect()} == {9}


def test_runs_follow_the_stride(spark):
    r = random.Random(15)
    item = words(r, 60)
    i = build_index(items(spark, [item]), 10, stride=4)
    got = exact.runs(exact.raw_hits(frame(spark, [f"{words(r, 7)} {item}"]), i), i, 4).collect()
    assert [(x.start, x.stop, x.grams) for x in got] == [(7, 65, 13)]


def sequential(docs, bench, n, max_df=5):
    """The exact tier as one pass over documents in order, from its definition."""
    import regex

    def tok(t):
        return regex.findall(r"[\p{L}\p{N}']+", t.lower())

    own = {}
    for k, b in enumerate(bench):
        t = tok(b)
        for o in range(len(t) - n + 1):
            own.setdefault(tuple(t[o : o + n]), set()).add(k)
    own = {g: o for g, o in own.items() if len(o) <= 3}
    df, out = {}, []
    for d, text in enumerate(docs):
        t = tok(text)
        hits = sorted((k, o, g) for o in range(len(t) - n + 1) if (g := tuple(t[o : o + n])) in own for k in own[g])
        for g in {g for _, _, g in hits}:
            df[g] = df.get(g, 0) + 1
        now, last = dict(df), None
        for k, o, g in hits:
            if not last or last["k"] != k or o > last["end"] + 1:
                last = {"d": d, "k": k, "start": o, "kept": set(), "cut": False}
                out.append(last)
            last["end"] = o
            if now[g] <= max_df:
                if len(last["kept"]) >= 256:
                    last["cut"] = True
                else:
                    last["kept"].add(g)
    return sorted((x["d"], x["k"], x["start"], x["end"] + n, x["cut"] or min((df[g] for g in x["kept"]), default=99) <= max_df) for x in out)


def test_exact_tier_against_one_sequential_pass(spark):
    r = random.Random(16)
    bench = [words(r, r.randint(8, 40)) for _ in range(12)] + [words(r, 400)]
    bench.append(bench[0] + " " + words(r, 20))
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            t = r.choice(bench).split()
            a = r.randrange(len(t))
            t = t[a : a + r.randint(5, 300)]
            if t and r.random() < 0.3:
                t[r.randrange(len(t))] = "odd"
            parts += [" ".join(t), words(r, r.randint(0, 3))]
        docs.append(r.choice([" ", "\n", " -- "]).join(parts).upper() if r.random() < 0.3 else " ".join(parts))
    _, runs = scan(spark, docs, bench)
    got = sorted((x.doc_id, x.item_idx, x.start, x.stop, x.survives) for x in runs.collect())
    assert got == sequential(docs, bench, 10) and {x[4] for x in got} == {True, False}


def test_vectorised_tokens_are_the_scan_tokens(spark):
    from pyspark.sql import functions as F

    from textweir.functions import rolling

    odd = ["İstanbul ΟΔΟΣ don't 𝔸b 12", "", "ａＢ x\ny 'q' ½ ٣ 日本語。テスト", "a" * 70_000 + " b", "ǅ ẞ Ⅷ", "\x00 a\tb"] + ["plain ascii text here"] * 3
    want = [x.t for x in frame(spark, odd).orderBy("doc_id").select(text.scan_tokens("text").alias("t")).collect()]
    hashes, counts = rolling.token_hashes(odd)
    assert counts.tolist() == [len(t) for t in want]
    flat = [w for t in want for w in t]
    assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist())))
    t, off, keys = rolling.gram_keys(hashes, counts, 3)
    grams = [(i, o, tuple(w[o : o + 3])) for i, w in enumerate(want) for o in range(len(w) - 2)]
    assert [(i, o) for i, o, _ in grams] == list(zip(t.tolist(), off.tolist()))
    assert len({g for _, _, g in grams}) == len(set(keys.tolist())) == len(set(zip((g for _, _, g in grams), keys.tolist())))


def test_an_index_too_large_to_broadcast(spark, monkeypatch):
    from textweir.operators import index

    r = random.Random(17)
    bench = [words(r, 30) for _ in range(5)]
    docs = [f"{words(r, 25)} {b} {words(r, 25)}" for b in bench]
    _, want = scan(spark, docs, bench)
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(index, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 1)
    _, got = scan(spark, docs, bench)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 5


def test_boilerplate_and_stopwords_stay_out_of_the_index(spark):
    r = random.Random(5)
    prefix = words(r, 40)
    i = build_index(items(spark, [f"{prefix} {words(r, 20)}" for _ in range(10)] + [words(r, 30) for _ in range(50)]))
    assert i.stats.collect()[0].dropped_common == 31
    filler = " ".join(f"s{k % 15}" for k in range(60))
    i = build_index(items(spark, [f"{filler} {words(r, 20)}" for _ in range(6)]), max_items=None)
    assert i.stats.collect()[0].dropped_stop == 6 * 51 and i.stop.count() == 15


def test_uncheckable_and_refusals(spark):
    i = build_index(items(spark, ["短い日本語の文章です。" * 4, "too short", " ".join(f"a{k}" for k in range(20))]))
    assert {(x.item_id, x.unsegmented) for x in i.uncheckable().collect()} == {(0, True), (1, False)}
    with pytest.raises(errors.EmptyBenchmarkError):
        build_index(items(spark, []))
    with pytest.raises(errors.ThresholdError):
        build_index(items(spark, ["x"]), n=7)


def test_evidence_is_cut_from_the_text(spark):
    r = random.Random(6)
    item = "Alpha, beta; gamma delta -- epsilon zeta. Eta theta iota kappa lambda mu!"
    doc = f"{words(r, 20)}. {item} {words(r, 20)}"
    i, runs = scan(spark, [doc], [item])
    e = exact.evidence(runs, frame(spark, [doc])).collect()[0]
    assert e.matched == item[:-1] and doc.endswith(e.after + " " + " ".join(doc.split()[-8:])) and e.before + e.matched + e.after in doc


def test_scan_and_signal_tokenizers(spark):
    t = "İstanbul ΟΔΟΣ don't 𝔸b 12"
    row = spark.createDataFrame([(t,)], "t string").select(text.scan_tokens("t").alias("a"), text.signal_tokens("t").alias("b"), text.triage_tokens("t").alias("c")).collect()[0]
    assert row.a == ["İstanbul", "οδοσ", "don't", "b", "12"] and "𝔸b" in row.b and row.c[-4:-2] == ["don", "t"]


def test_page_text(spark):
    page = "<p>a&amp;b</p><script>var x='<p>';</script><style>p{}</style><!-- no --><div>caf&#233; &#x1F600; &rsquo;</div><b>x</b>"
    got = spark.createDataFrame([(page,)], "h string").select(text.html_text("h").alias("x")).collect()[0].x
    assert got == "a&b\n café 😀 ’\n x" or got.split() == ["a&b", "café", "😀", "’", "x"]


def test_hashes(spark):
    from pyspark.sql import functions as F

    rows = spark.range(50).select(hashing.mulberry(0x1CE07, F.col("id")).alias("x")).collect()
    draw = hashing.Mulberry(0x1CE07)
    assert [r.x for r in rows] == [draw() for _ in range(50)]
    assert hashing.portable_hash(["ab", "c"]) != hashing.portable_hash(["a", "bc"]) and len(hashing.portable_hash([])) == 32


def test_signature_matches_the_expressions(spark):
    from pyspark.sql import functions as F

    tokens = "one two three four five six seven".split()
    shingles = [" ".join(tokens[i : i + 5]) for i in range(3)]
    seeds = spark.range(1, 65).select(F.col("id").alias("s"))
    h = spark.createDataFrame([(s,) for s in shingles], "s string").select(hashing.fnv1a(F.col("s")).alias("h"))
    want = [r.v for r in seeds.crossJoin(h).groupBy("s").agg(F.min(hashing.mix(F.col("h"), F.col("s"))).alias("v")).orderBy("s").collect()]
    assert near.signature("One two, three four -- five SIX seven!") == want
    assert near.signature(" .") is None


def test_lines_and_records(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_bytes('{"id":"x","text":"one two"}\n\n[1]\n{"response":"r","text":"  "}\nbad\n{"text":5}\n{"id":"x","text":"again"}'.encode())
    lines = corpus.read_lines(spark, str(p))
    parsed = corpus.parse_corpus(lines)
    assert [(r.doc_id, r.text) for r in parsed.filter("skip_reason is null").orderBy("doc_seq").collect()] == [("x", "one two"), ("doc2", "r"), ("x", "again")]
    a = corpus.accounting(parsed).collect()[0]
    assert (a.lines, a.accepted, a.unparseable, a.not_an_object, a.no_usable_text) == (6, 3, 1, 1, 1)
    records, skipped = corpus.load_batch(lines)
    assert sorted(r.id for r in records.collect()) == ["x", "x#7"] and skipped.count() == 5
    with pytest.raises(errors.SchemaMismatchError):
        corpus.load_batch(lines, text_field="nope")
    with pytest.raises(errors.EmptyCorpusError):
        corpus.require_documents(parsed.filter("skip_reason is not null"))


def test_index_file_round_trip(spark):
    r = random.Random(7)
    i = build_index(items(spark, [words(r, 25) for _ in range(5)] + ["same " * 3 + words(r, 12)]))
    own = portable_owners(i)
    raw = encode_index({"benchmark": "b", "n": 10}, own)
    assert decode_index(raw)[1] == own and sum(map(len, own.values())) == i.rows.count() and max(own) < 1 << 53
    with pytest.raises(errors.IndexTruncatedError):
        decode_index(raw[:-1])
    with pytest.raises(errors.IndexUnreadableError):
        decode_index(b"<html>" + raw)
    with pytest.raises(errors.IndexVersionError):
        decode_index(raw[:8] + b"\x09" + raw[9:])


def test_index_files_scan_like_the_built_index(spark, tmp_path):
    from textweir.operators.index import Index
    from textweir.sources.index_codec import read_index, resolve_index, write_index

    r = random.Random(18)
    bench = [words(r, 30) for _ in range(6)] + ["short one", "短い日本語の文章です。" * 4]
    bench[1] = "İx ÉCOLE " + bench[1]
    docs = [f"{words(r, 20)} {b.upper() if k % 2 else b} {words(r, 20)}" for k, b in enumerate(bench)]
    i, want = scan(spark, docs, bench)
    want = sorted(map(tuple, want.collect()))
    for name in ("a.idx.bin", "a.idx.bin.gz", "a.json"):
        path = f"{tmp_path}/{name}"
        meta = write_index(i, path, "b", benchmark_identity(items(spark, bench)))
        loaded = Index.from_file(spark, *read_index(path))
        got = exact.runs(exact.raw_hits(frame(spark, docs), loaded), loaded)
        assert sorted(map(tuple, got.collect())) == want and meta["uncheckableItemIds"] == ["6", "7"]
        assert {(x.item_id, x.unsegmented) for x in loaded.uncheckable().collect()} == {("6", False), ("7", True)}
    assert resolve_index("a", str(tmp_path)) == f"{tmp_path}/a.idx.bin.gz"
    with pytest.raises(errors.IndexMissingError, match="there are a"):
        resolve_index("b", str(tmp_path))
    with pytest.raises(errors.IndexUnreadableError):
        resolve_index(str(tmp_path))
    raw = (tmp_path / "a.idx.bin.gz").read_bytes()
    for name, data, error in (("c.gz", raw[:-20], errors.IndexTruncatedError), ("d", b"<html>", errors.IndexUnreadableError), ("e.json", b"{", errors.IndexUnreadableError), ("f.json", b'{"formatVersion": 2, "keys": [], "items": []}', errors.IndexVersionError), ("g.json", b'{"formatVersion": 3, "keys": [1], "items": []}', errors.IndexTruncatedError)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(error):
            read_index(f"{tmp_path}/{name}")


def test_report(spark):
    r = random.Random(8)
    item, common = "<b> " + words(r, 20), words(r, 15)
    texts = [f"x {item} y"] + [f"{words(r, 3)} {common}" for _ in range(7)]
    docs, bench = frame(spark, texts), items(spark, [item, "short", common])
    i = build_index(bench)
    hits, totals = exact.scan(docs, i)
    assert totals == {"documents": 8, "tokens": 23 + 7 * 18}
    runs = exact.runs(hits, i)
    close = near.near_tier(docs, bench, runs)
    report = scan_report(i, runs, docs, benchmark_identity(bench), totals, near=close)
    assert report["exact"]["items_hit"] == 1 and report["uncheckable"]["items"] == 1
    assert {x["condemned_by"] for x in report["dropped"]} == {7} and report["dropped"][0]["matched"] == common
    assert report["near"]["hits"] == 2 and report["near"]["shown"][0]["sample"] == texts[6] and report["contaminated_items"] == ["0", "2"]
    assert "1 of 3 items" in text_summary(report) and "<mark>" in html_page(report) and "<b> " not in html_page(report).split("<h2>Matches")[1].split("<h2>")[0].replace("&lt;b&gt;", "")
    alone = scan_report(i, runs, docs, "x", totals)
    assert not alone["near"]["available"] and alone["contaminated_items"] == ["0"] and "hashes only" in html_page(alone)


def test_triage_rules(spark):
    docs = frame(spark, ["a b c d e f g h i j k l", "x y a b c d"])
    got = {x.item_id: (x.run, x.verdict) for x in studies.triage(studies.longest_runs(spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, item_id long"), docs, items(spark, ["b c d e f g h i z", "a b c d q q q q q q q q q q q q"])), 3).collect()}
    assert got == {0: (8, "leaked"), 1: (4, "phrase")}
    with pytest.raises(errors.MissingDocumentError):
        studies.longest_runs(spark.createDataFrame([(9, 0)], "doc_id long, item_id long"), docs, items(spark, ["a"]))


def test_scoring(spark):
    def base(mean, sd):
        return spark.createDataFrame([("template", mean, sd, 20), ("length_shape", mean, sd, 20), ("stylometry", mean, sd, 20)], "key string, mean double, sd double, n long")

    values = spark.createDataFrame([("template", 0.0), ("length_shape", 0.1), ("stylometry", None)], "key string, value double")
    s = scoring.score_signals(values, base(0.0, 0.1), base(1.0, 0.1), 1000)
    row = scoring.score(s, 1000).collect()[0]
    assert (row.purity, row.n_used, row.verdict, row.confidence) == (95, 2, "human", "medium")
    far = scoring.score_signals(values, base(5.0, 0.1), base(6.0, 0.1), 1000)
    assert {r.skip_reason for r in far.collect()} == {"out of range", "unavailable"} and scoring.score(far, 1000).collect()[0].purity is None
    with pytest.raises(errors.BatchTooSmallError):
        scoring.score(s, 5)
    assert sorted(scoring.shuffled(20, 3).tolist()) == list(range(20)) and scoring.drawn(20, 20, 3) != list(range(20)) and len(set(scoring.drawn(20, 8, 3))) == 8


def test_baseline_and_split(spark):
    records = spark.createDataFrame([(i, f"some words here {i % 7} and more text. Another one {i}!") for i in range(60)], "id long, text string")
    a, b = scoring.split_corpus(records)
    assert a.count() == b.count() == 30 and a.intersect(b).count() == 0
    got = scoring.build_baseline(records, signals.template, chunk=20, draws=3).collect()
    assert [r.key for r in got] == ["template"] and got[0].n == 3
    with pytest.raises(errors.BatchTooSmallError):
        scoring.build_baseline(records, signals.template, chunk=50)


def test_near_duplicate_records(spark):
    r = random.Random(10)
    t = words(r, 200)
    docs = frame(spark, [t, t + " more", words(r, 200), "", None])
    got = {x.doc_id: x.n_near for x in near.near_duplicate_records(docs).collect()}
    assert got == {0: 1, 1: 1, 2: 0}


def test_near_tier_finds_edited_copies(spark):
    r = random.Random(12)
    item = words(r, 60).split()
    edited = " ".join(w if k % 29 else "zzz" for k, w in enumerate(item))
    docs, bench = frame(spark, [edited, words(r, 60)]), items(spark, [" ".join(item)])
    i = build_index(bench)
    none = exact.runs(exact.raw_hits(docs, i), i).limit(0)
    got = near.near_tier(docs, bench, none).collect()
    assert [x.doc_id for x in got] == [0] and got[0].sample == edited[:240] and near.near_tier(docs, bench.limit(0), none).count() == 0
    found = spark.createDataFrame([(0, True, False)], "doc_id long, early_rare boolean, truncated boolean")
    assert near.near_tier(docs, bench, found).count() == 0


def test_near_tier_misses_no_pair(spark):
    """Against a comparison of all signatures, in blocks and in one."""
    r = random.Random(13)
    bench = [words(r, r.randint(3, 80)) for _ in range(30)] + ["", "..."]
    docs = []
    for _ in range(60):
        t = r.choice(bench).split()
        docs.append(" ".join(w if r.random() > 0.04 else "zzz" for w in t) + r.choice(["", " tail words"]))
    sig = lambda t: near.signature(t)
    want = set()
    for d, t in enumerate(docs):
        for k, b in enumerate(bench):
            if sig(t) and sig(b):
                s = sum(x == y for x, y in zip(sig(t), sig(b))) / 64
                if s >= 0.55:
                    want.add((d, k, s))
    df, it = frame(spark, docs), items(spark, bench)
    none = spark.createDataFrame([], "doc_id long, early_rare boolean, truncated boolean")
    for block in (100_000, 7):
        assert {(x.doc_id, x.item_id, x.score) for x in near.near_tier(df, it, none, item_block=block).collect()} == want
    assert len(want) > 20


def test_planted_recall(spark):
    r = random.Random(11)
    docs, bench = frame(spark, [words(r, 40) for _ in range(12)]), items(spark, [words(r, 30) for _ in range(15)])
    assert studies.planted_recall(docs, bench, 10)["recall"] == 1.0
    assert studies.planted_recall(docs, bench, 10, stride=4)["recall"] == 1.0
    assert studies.planted_recall(docs, bench, 13, edited=True)["recall"] < 1.0
    assert studies.bloom_bits(1000, 0.01) == 9586 and studies.detection_probability(5, 1) == 0.0
    assert text.suggest_flag("--treshold", ["--threshold", "--out"]) == "--threshold"


def test_lexical_cluster_against_a_plain_version(spark):
    import math
    from collections import Counter

    r = random.Random(31)
    vocab = [f"t{k}" for k in range(150)]
    texts = [" ".join(r.choices(vocab, k=r.randint(5, 60))) for _ in range(80)]
    tokens = [t.split() for t in texts]
    df = Counter(w for t in tokens for w in set(t))
    first = {}
    for d, t in enumerate(tokens):
        for k, w in enumerate(t):
            first.setdefault(w, (d, k))
    terms = sorted((w for w in df if 3 <= df[w] <= max(3, int(80 * 0.6))), key=lambda w: (-df[w], first[w]))[:4000]
    vecs = []
    for t in tokens:
        v = {w: (1 + math.log(c)) * math.log(80 / df[w]) for w, c in Counter(t).items() if w in set(terms)}
        n = math.sqrt(sum(x * x for x in v.values()))
        vecs.append({w: x / n for w, x in v.items()} if n else {})
    full = [d for d, v in enumerate(vecs) if v]
    draw, sims = hashing.Mulberry(signals.PAIR_SEED), []
    for _ in range(min(40_000, len(full) * (len(full) - 1) // 2)):
        i, j = int(draw() * len(full)), int(draw() * len(full))
        j = (j + 1) % len(full) if i == j else j
        a, b = vecs[full[i]], vecs[full[j]]
        sims.append(sum(x * b.get(w, 0) for w, x in a.items()))
    value, near50 = signals.lexical_cluster(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3))
    row = value.collect()[0]
    assert row.available and row.n == len(sims) and row.value == pytest.approx(sum(sims) / len(sims)) and near50.count() == 50


def test_lexical_cluster_makes_vectors_of_drawn_records_only(spark, monkeypatch):
    """Ids that come again are one record, a null id is drawn but met by none, and what isn't drawn gets no vector."""
    import math
    import re
    from collections import Counter, defaultdict

    r = random.Random(34)
    vocab = [f"t{k}" for k in range(110)] + [f"É{k}'s" for k in range(40)]
    rows = [(k if k % 9 else k // 18, " ".join(r.choices(vocab, k=r.randint(3, 60)))) for k in range(120)]
    rows += [(None, " ".join(vocab[:9])), (None, "T1 t2-T3"), (500, None), (501, "..."), (502, "alone"), (503, ". " * 300 + "t5"), (504, "x " * 199 + "t55555"), (505, "x " * 199 + "yt5 É5'S")]
    tokens, uses, first = defaultdict(Counter), defaultdict(set), {}
    for d, t in rows:
        for k, w in enumerate(re.findall(r"[^\W_']+(?:'s)?", (t or "").lower())):
            tokens[d][w] += 1
            uses[w] |= {d} - {None}
            first[w] = min(first.get(w, (True, 1 << 40, 0)), (d is not None, d or 0, k))
    df = {w: len(x) for w, x in uses.items()}
    terms = sorted((w for w in df if 3 <= df[w] <= max(3, int(len(rows) * 0.6))), key=lambda w: (-df[w], first[w], w))
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = signals.vocabulary(frame).orderBy("term_idx").collect()
    assert [(x.term, x.df, x.term_idx) for x in got] == [(w, df[w], k) for k, w in enumerate(terms)]
    vecs = {}
    for d, c in tokens.items():
        if v := {w: (1 + math.log(n)) * math.log(len(rows) / df[w]) for w, n in c.items() if w in set(terms)}:
            n = math.sqrt(sum(x * x for x in v.values()))
            vecs[d] = {w: x / n for w, x in v.items()}
    full = sorted(vecs, key=lambda d: (d is not None, d or 0))
    assert None in full and 505 in full and 503 in full and 504 not in full and 502 not in full
    made, tfidf = [], signals.tfidf
    monkeypatch.setattr(signals, "tfidf", lambda *a: made.append(tfidf(*a)) or made[-1])
    for pairs in (5, 3000):
        draw, sims, drawn = hashing.Mulberry(signals.PAIR_SEED), [], set()
        for _ in range(pairs):
            i, j = int(draw() * len(full)), int(draw() * len(full))
            j = (j + 1) % len(full) if i == j else j
            a, b = full[i], full[j]
            drawn |= {a, b} - {None}
            if None not in (a, b):
                sims.append(sum(x * vecs[b].get(w, 0) for w, x in vecs[a].items()))
        row = signals.lexical_cluster(frame, pairs)[0].collect()[0]
        assert row.n == len(sims) and row.value == pytest.approx(sum(sims) / len(sims))
        assert {x.id for x in made[-1].select("id").distinct().collect()} == drawn


def styled(r, n, authors=4):
    pools = [["the", "of", "and", "x", "y"], ["i", "you", "we", "x", "z"], ["on", "in", "at", "q"], ["but", "so", "x"]]
    return [(k, " ".join(r.choices(pools[k % authors], k=20)) + r.choice([".", "!", "; ok", ", yes. No?"]), f"a{k % authors}") for k in range(n)]


def test_author_distances_and_dispersion(spark):
    import math

    rows = styled(random.Random(32), 130)
    df = spark.createDataFrame(rows, "id long, text string, author_id string")
    vec = {x.author_id: list(x.vector) for x in signals.style_vectors(df, "author_id").collect()}
    one = {x.id: list(x.vector) for x in signals.style_vectors(df, "author_id", "id").collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    got = {x.author_id: x.mean_distance for x in signals.author_distances(df).collect()}
    for a in vec:
        assert got[a] == pytest.approx(sum(1 - cos(vec[a], vec[b]) for b in vec if b != a) / 3)
    spread = {x.author_id: (x.n_records, x.dispersion) for x in signals.author_dispersion(df).collect()}
    for a in vec:
        mine = [1 - cos(one[k], vec[a]) for k, _, b in rows if b == a]
        assert spread[a] == (len(mine), pytest.approx(sum(mine) / len(mine)))
    lens = [len(t.replace(".", " ").replace(",", " ").replace("!", " ").replace(";", " ").replace("?", " ").split()) for _, t, _ in rows]
    mean = sum(lens) / len(lens)
    sd = math.sqrt(sum((x - mean) ** 2 for x in lens) / (len(lens) - 1))
    assert signals.length_variation(df).collect()[0].variation == pytest.approx(sd / mean)


def test_winnow_crawl_and_run_signals(spark):
    from pyspark.sql import functions as F

    keys = [5, 16, 16, 64, -64, 256, 7]
    got = {x.rate: (x.grams, x.distinct_grams) for x in studies.winnowed(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
    assert got == {1: (7, 6), 16: (5, 4), 64: (3, 3), 256: (1, 1)}
    pages = spark.createDataFrame([(3, "x" * 250), (1, "x" * 250), (2, "short"), (4, "y" * 200), (5, None)], "page_id long, html string")
    assert sorted((x.page_id, x.n_pages, x.n_chars) for x in corpus.crawl_slice(pages, F.col("html")).collect()) == [(1, 2, 250), (4, 1, 200)]
    df = spark.createDataFrame(styled(random.Random(33), 130), "id long, text string, author_id string")
    rows = signals.run_signals(df).orderBy("place").collect()
    assert [x.key for x in rows] == ["near_dup", "lexical_cluster", "stylometry", "template", "length_shape", "lexical_variety"]
    assert {x.key for x in rows if not x.available} == {"lexical_cluster"} and all((x.value is None) != x.available for x in rows)
    with pytest.raises(errors.TooFewTextsError):
        signals.run_signals(df.limit(1))


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    import gzip

    lines = [f"line {k} é" * (1 + k % 3) for k in range(5000)] + ["", "last\r"]
    raw = "\n".join(lines).encode()
    (tmp_path / "p").mkdir()
    for name, data in (("a.txt", raw), ("b.txt.gz", gzip.compress(raw)), ("c.bin", gzip.compress(raw))):
        (tmp_path / name).write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = corpus.read_lines(spark, [f"{tmp_path}/{n}" for n in ("a.txt", "b.txt.gz", "c.bin")])
        for rank in range(3):
            assert [x.value for x in got.filter(f"file = {rank}").orderBy("line").collect()] == lines
            assert got.filter(f"file = {rank}").agg(F_max("line")).collect()[0][0] == len(lines)
        assert corpus.corpus_bytes(got.filter("file = 0"), f"{tmp_path}/a.txt") == len(raw)
        assert corpus.corpus_bytes(got.filter("file = 1"), f"{tmp_path}/b.txt.gz") == len(raw) + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_numbered_places(spark):
    from textweir.storage import numbered

    r = random.Random(34)
    ids = [r.randrange(10**6) for _ in range(500)]
    got = numbered(spark.createDataFrame([(i,) for i in ids], "id long").repartition(7), "id").orderBy("k").collect()
    assert [x.k for x in got] == list(range(500)) and [x.id for x in got] == sorted(ids)


def test_spike_summary():
    rows = [{"ratio": a, "draw": d, "purity": p} for a, ps in ((0, [90, 92, 80]), (0.1, [88, 86, 90]), (0.5, [50, 40, 45])) for d, p in enumerate(ps)]
    got = scoring.spike_summary(rows)
    assert got["floor"] == 0.5 and got["false_positives"] == pytest.approx(1 / 3) and not got["monotonic"]


def test_pretraining_scan_goes_on_where_it_stopped(spark, tmp_path):
    r = random.Random(19)
    bench = {name: items(spark, [words(r, 30) for _ in range(3)]) for name in ("a", "b")}
    texts = [f"{words(r, 5)} {x.text}" for b in bench.values() for x in b.collect()[:2]]
    got = studies.pretraining_scan(frame(spark, texts), bench, f"file://{tmp_path}/out", ns=(10,)).collect()
    assert {(x.benchmark, x.n, x.item_id, x.docs) for x in got} == {(b, 10, i, 1) for b in bench for i in (0, 1)}
    again = studies.pretraining_scan(frame(spark, ["nothing"]), bench, f"file://{tmp_path}/out", ns=(10,)).collect()
    assert sorted(again) == sorted(got)


def test_capture_rules(spark):
    from pyspark.sql import functions as F

    rows = [("https://a.org/x", "200", "text/html", True), ("https://a.org/", "200", "text/html", False), ("https://a.org/robots.txt", "200", "text/html", False), ("https://a.org/x", "301", "text/html", False), ("https://a.org/x", "200", None, False), ("not a url", "200", "text/html", False)]
    df = spark.createDataFrame(rows, "u string, s string, m string, want boolean").select("want", studies.is_content(F.col("u"), F.col("s"), F.col("m")).alias("got"))
    assert all(r.want == r.got for r in df.collect())

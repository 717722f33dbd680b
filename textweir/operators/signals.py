"""Six batch signals that place records between two reference corpora.

Each takes records (id, text, author_id) and returns one row (key, value,
available, reason, n), and where the signal flags records, a second frame.
``draw`` columns let one pass compute a signal for many subsamples at once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweir.errors import NotFiniteError, TooFewTextsError
from textweir.functions.hashing import mulberry_array
from textweir.functions.text import FUNCTION_WORDS, MARKS, mark_counts, rough_line, rough_tokens, sentences, signal_tokens, token_line
from textweir.operators.near import near_duplicate_records
from textweir.storage import materialize, numbered, small_batches, split_repeats

EDGE, EDGE_SHARE = 4, 0.01
SCAFFOLD = r"^\s*(?:[-*•]|\d+[.)]|#{1,6}\s|\*\*)"
VOCABULARY, LEAST_DF, DF_SHARE, PAIRS, PAIR_SEED, LEAST_TERMS = 4000, 3, 0.6, 40_000, 0x1CE07, 50
AUTHOR_RECORDS = 30
#: Words and groups that a task holds before it hands on their counts.
STYLE_HELD = 300_000
#: Characters of a text that are looked at before all of it is.
START = 400


def _row(df: DataFrame, key: str, value, available, reason, n) -> DataFrame:
    return df.select(F.lit(key).alias("key"), F.when(available, value).alias("value"), available.alias("available"), F.when(~available, F.lit(reason)).alias("reason"), n.cast("long").alias("n"))


def near_dup(records: DataFrame) -> DataFrame:
    r = near_duplicate_records(records, "id").agg(F.count("*").alias("n"), F.count_if(F.col("n_near") > 0).alias("d"))
    return _row(r, "near_dup", F.try_divide("d", "n"), F.col("n") >= 2, "too few records with shingles", F.col("n"))


def _term_uses(records: DataFrame) -> DataFrame:
    """term, df, first (id, pos): in how many rows a task met a term, and its first use there; ids differ, a null one counts for no row."""
    small_batches(records.sparkSession)
    kind = records.schema["id"]

    def run(batches):
        df, first, id_type = Counter(), {}, None

        def flush():
            places = first.values()
            return pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array([df[w] for w in first], pa.int64()), pa.array([k for (_, k), _ in places], id_type), pa.array([n for _, n in places], pa.int64())], ["term", "df", "id", "pos"])

        for b in batches:
            id_type = b.column(0).type
            rows = sorted(((k is not None, k), line) for k, line in zip(*(c.to_pylist() for c in b.columns)) if line)
            own = {}
            for at in reversed(range(len(rows))):  # the last first: earlier uses replace later ones
                tokens, base = rough_tokens(rows[at][1]), at << 32
                uses = dict(zip(reversed(tokens), range(base + len(tokens) - 1, base - 1, -1)))
                if rows[at][0][0]:
                    df.update(uses.keys())
                own.update(uses)
            for w, code in own.items():
                place = rows[code >> 32][0], code & 0xFFFFFFFF
                if w not in first or place < first[w]:
                    first[w] = place
            if len(first) > STYLE_HELD:
                yield flush()
                df, first = Counter(), {}
        if first:
            yield flush()

    schema = T.StructType([*T.StructType.fromDDL("term string, df long").fields, kind, *T.StructType.fromDDL("pos long").fields])
    return records.select("id", rough_line("text")).mapInArrow(run, schema).select("term", "df", F.struct("id", "pos").alias("first"))


def vocabulary(records: DataFrame) -> DataFrame:
    """term, df, idf, term_idx: the 4,000 most frequent terms in 3 documents to 60 % of them; ties by first use, then (rows of one id) by term.

    Tasks hand on counts of terms. Only the terms of ids that come again are told apart by id in a shuffle.
    """
    total = records.agg(F.count("*").alias("n_records"))
    once, again = split_repeats(records.select("id", "text"), "id")
    uses = _term_uses(once)
    if again is not None:
        t = again.select("id", F.posexplode(signal_tokens("text")).alias("pos", "term")).groupBy("term", "id").agg(F.min(F.col("pos").cast("long")).alias("pos"))
        uses = uses.unionByName(t.select("term", F.when(F.col("id").isNull(), 0).otherwise(1).cast("long").alias("df"), F.struct("id", "pos").alias("first")))
    df = uses.repartition("term").groupBy("term").agg(F.sum("df").alias("df"), F.min("first").alias("first"))
    ok = df.crossJoin(F.broadcast(total)).filter((F.col("df") >= LEAST_DF) & (F.col("df") <= F.greatest(F.lit(LEAST_DF), F.floor(F.col("n_records") * DF_SHARE))))
    top = ok.orderBy(F.desc("df"), "first", "term").limit(VOCABULARY)
    return top.select("term", "df", F.log(F.col("n_records") / F.col("df")).alias("idf"), (F.row_number().over(Window.orderBy(F.desc("df"), "first", "term")) - 1).alias("term_idx"))


def holds_any(c, words: list[str]):
    """Whether a text has one of the tokens. Mostly its start tells, by whole tokens of plain letters, whose case hangs on nothing behind them."""
    start = F.regexp_extract_all(F.lower(F.substring(c, 1, START)), F.lit(r"([\p{L}\p{N}']++)[^\p{L}\p{N}']"), F.lit(1))
    plain = [w for w in words if w.isascii()]
    return F.when(F.exists(start, lambda x: x.isin(plain)), True).otherwise(F.exists(signal_tokens(c), lambda x: x.isin(words)))


def tfidf(records: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term_idx, w: L2-normalised (1 + ln tf) * idf. Words are counted within the row; ``terms``, few, are held by each task."""
    small_batches(records.sparkSession)
    place = {r.term: r.term_idx for r in terms.select("term", "term_idx").collect()}

    def run(batches):
        for b in batches:
            rows, term, tf = [], [], []
            for i, line in enumerate(b.column(1).to_pylist()):
                c = Counter(place[w] for w in rough_tokens(line or "") if w in place)
                rows += [i] * len(c)
                term += c.keys()
                tf += c.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(term, pa.int32()), pa.array(tf, pa.int64())], ["id", "term_idx", "tf"])

    schema = T.StructType([records.schema["id"], *T.StructType.fromDDL("term_idx int, tf long").fields])
    tf = records.select("id", rough_line("text")).mapInArrow(run, schema).repartition("id").groupBy("id", "term_idx").agg(F.sum("tf").alias("tf"))
    w = tf.join(F.broadcast(terms.select("term_idx", "idf")), "term_idx").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select("id", "term_idx", F.when(norm > 0, F.col("w") / norm).otherwise(0.0).alias("w"))


def lexical_cluster(records: DataFrame, pairs: int = PAIRS):
    """Mean cosine of seeded pairs of records, and the 50 records nearest to all others.

    All records make the vocabulary and the places that pairs are drawn from; vectors are made of the records drawn, at most twice ``pairs``.
    """
    spark = records.sparkSession
    terms = materialize(vocabulary(records))
    words = [r.term for r in terms.select("term").collect()]
    place = numbered(materialize(records.filter(holds_any("text", words)).select("id").distinct()), "id")
    m, n_terms = place.count(), len(words)
    if m < 2 or n_terms < LEAST_TERMS:
        one = spark.range(1).select(F.lit(m).alias("m"))
        return _row(one, "lexical_cluster", F.lit(None).cast("double"), F.lit(False), f"{n_terms} usable terms, {m} records", F.col("m")), None
    sampled = min(pairs, m * (m - 1) // 2)

    def draw(batches):
        for b in batches:
            n = b.column(0).to_numpy()
            i, j = (np.floor(mulberry_array(PAIR_SEED, n * 2 + side) * m).astype(np.int64) for side in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(i), pa.array(np.where(i == j, (j + 1) % m, j))], ["p", "i", "j"])

    p = materialize(spark.range(sampled).mapInArrow(draw, "p long, i long, j long"))
    drawn = materialize(place.join(F.broadcast(p.select(F.explode(F.array("i", "j")).alias("k")).distinct()), "k"))
    vec = tfidf(records.join(F.broadcast(drawn.select("id")), "id"), terms).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term_idx", "w"))).alias("v"))
    v = materialize(vec.join(F.broadcast(drawn), "id"))
    p = p.join(v.select(F.col("k").alias("i"), F.col("id").alias("a"), F.col("v").alias("va")), "i").join(v.select(F.col("k").alias("j"), F.col("id").alias("b"), F.col("v").alias("vb")), "j")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at("vb", e["key"]), F.lit(0.0)))
    p = p.select("p", "a", "b", dot.alias("sim")).cache()
    value = _row(p.agg(F.avg("sim").alias("x"), F.count("*").alias("n")), "lexical_cluster", F.col("x"), F.lit(True), "", F.col("n"))
    each = p.select(F.col("a").alias("id"), "sim").union(p.select("b", "sim")).groupBy("id").agg(F.avg("sim").alias("mean_sim"))
    return value, each.orderBy(F.desc("mean_sim"), "id").limit(50)


def _style_input(records: DataFrame, *by: str) -> DataFrame:
    small_batches(records.sparkSession)
    return records.select("text", token_line("text").alias("line"), F.size(sentences("text")).cast("long").alias("s_n"), *by)


def _style_rows(b: pa.RecordBatch):
    """(tokens, sentences, rates of the ten classes) of each record; None for a null text.

    Sentences are cut at white space, which no token holds, so the tokens of a text are those of its sentences.
    """
    for t, line, s_n in zip(*(c.to_pylist() for c in b.columns[:3])):
        if t is None:
            yield None
        else:
            tokens = line.split()
            yield tokens, s_n, [c * 1000.0 / max(len(tokens), 1) for c in mark_counts(t)]


def style_vectors(records: DataFrame, *by: str) -> DataFrame:
    """by..., n_records, vector of 128: function words and punctuation per 1,000 tokens, sentence length, type-token ratio.

    Each task adds up the words and totals of a group; a row without a word holds the totals.
    """
    marks = [f"p_{k}" for k in MARKS]
    sums = ["c", "n_records", "n_tokens", "s_n", "p_n", *marks]
    schema = T.StructType([*(records.schema[k] for k in by), *T.StructType.fromDDL("w string, " + ", ".join(f"{k} {'double' if k in marks else 'long'}" for k in sums)).fields])
    kinds = [pa.string(), *[pa.int64()] * 5, *[pa.float64()] * len(marks)]

    def flush(held, types):
        for key, (totals, rates, words) in held.items():
            w = [None, *words]
            cells = [[None, *words.values()], *([x] + [None] * len(words) for x in [*totals, *rates])]
            keys = [pa.array([k], t).take(pa.array(np.zeros(len(w), np.int64))) for k, t in zip(key, types)]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, t) for x, t in zip([w, *cells], kinds))], schema.names)

    def run(batches):
        held, size, types = {}, 0, None
        for b in batches:
            types = [c.type for c in b.columns[3:]]
            for key, row in zip(zip(*(c.to_pylist() for c in b.columns[3:])), _style_rows(b)):
                have = held.get(key)
                if have is None:
                    have = held[key] = ([0] * 4, [0.0] * len(marks), Counter())
                    size += 1
                totals, rates, words = have
                totals[0] += 1
                if row is not None:
                    tokens, s_n, each = row
                    for i, x in enumerate((len(tokens), s_n, 1), 1):
                        totals[i] += x
                    for i, x in enumerate(each):
                        rates[i] += x
                    size -= len(words)
                    words.update(tokens)
                    size += len(words)
            if size > STYLE_HELD:
                yield from flush(held, types)
                held, size = {}, 0
        yield from flush(held, types)

    words = _style_input(records, *by).mapInArrow(run, schema).groupBy(*by, "w").agg(*[F.sum(k).alias(k) for k in sums])
    x = words.groupBy(*by).agg(*[F.sum(k).alias(k) for k in sums[1:]], F.count("w").alias("types"), F.map_from_entries(F.collect_list(F.when(F.col("w").isin(FUNCTION_WORDS), F.struct("w", "c")))).alias("uses"))
    per = 1000.0 / F.greatest(F.col("n_tokens"), F.lit(1))
    rates_of = F.transform(F.array(*[F.lit(w) for w in FUNCTION_WORDS]), lambda w: F.coalesce(F.try_element_at("uses", w), F.lit(0)) * per)
    cells = [F.try_divide(F.col(k), F.col("p_n")) for k in marks] + [F.coalesce(F.try_divide("n_tokens", "s_n"), F.lit(0.0)), F.col("types") / F.greatest(F.col("n_tokens"), F.lit(1))]
    return x.select(*by, "n_records", F.concat(rates_of, F.array(*cells)).alias("vector"))


def record_vectors(records: DataFrame, author: str) -> DataFrame:
    """author, vector: the ``style_vectors`` of single records, made where the record is."""

    def vector(row):
        if row is None:
            return [0.0] * len(FUNCTION_WORDS) + [None] * len(MARKS) + [0.0, 0.0]
        tokens, s_n, rates = row
        n, c = max(len(tokens), 1), Counter(tokens)
        per = 1000.0 / n
        return [*(c[w] * per for w in FUNCTION_WORDS), *rates, len(tokens) / s_n if s_n else 0.0, len(c) / n]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(map(vector, _style_rows(b)), pa.list_(pa.float64()))], [author, "vector"])

    return _style_input(records, author).mapInArrow(run, T.StructType([records.schema[author], *T.StructType.fromDDL("vector array<double>").fields]))


def cosine(a, b):
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def author_distances(records: DataFrame, author: str = "author_id", least: int = AUTHOR_RECORDS) -> DataFrame:
    """author, n_records, mean_distance to the other authors with enough records.

    Mean cosine distance needs no pairs: it follows from the sum of unit vectors.
    """
    v = style_vectors(records.filter(F.col(author).isNotNull()), author).filter(F.col("n_records") >= least)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = v.select(author, "n_records", F.transform("vector", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("u")).cache()
    cells = unit.select(author, F.posexplode("u").alias("i", "x"))
    total = cells.groupBy("i").agg(F.sum("x").alias("s"))
    m = unit.agg(F.count("*").alias("m"))
    dots = cells.join(F.broadcast(total), "i").groupBy(author).agg(F.sum(F.col("x") * (F.col("s") - F.col("x"))).alias("d"))
    return unit.select(author, "n_records").join(dots, author).crossJoin(F.broadcast(m)).filter("m >= 2").select(author, "n_records", (1 - F.col("d") / (F.col("m") - 1)).alias("mean_distance"))


def author_dispersion(records: DataFrame, author: str = "author_id", least: int = AUTHOR_RECORDS) -> DataFrame:
    """author, n_records, dispersion: mean cosine distance of an author's records to the author's own vector."""
    r = records.filter(F.col(author).isNotNull())
    whole = style_vectors(r, author).filter(F.col("n_records") >= least).select(author, "n_records", F.col("vector").alias("centre"))
    whole = materialize(whole)  # its size is known then
    once, again = split_repeats(r.select(author, "id", "text"), author, "id")
    one = record_vectors(once, author)
    if again is not None:
        one = one.unionByName(style_vectors(again, author, "id").select(author, "vector"))
    return one.join(whole, author).groupBy(author).agg(F.max("n_records").alias("n_records"), F.avg(1 - cosine(F.col("vector"), F.col("centre"))).alias("dispersion"))


def stylometry(records: DataFrame, author: str = "author_id"):
    """Mean distance between authors, and the ten authors closest to all others."""
    d = author_distances(records, author).cache()
    one = d.agg(F.avg("mean_distance").alias("x"), F.count("*").alias("n"))
    return _row(one, "stylometry", F.col("x"), F.col("n") >= 2, f"fewer than two authors with {AUTHOR_RECORDS} records", F.col("n")), d.orderBy("mean_distance", author).limit(10)


def edge_groups(records: DataFrame, edge: str, *by: str) -> DataFrame:
    """by..., gram, uses: the first or last four tokens shared by at least max(2, 1 %) of the records that have them."""
    t = signal_tokens("text")
    gram = F.slice(t, 1, EDGE) if edge == "start" else F.slice(t, -EDGE, EDGE)
    g = records.filter(F.size(t) >= EDGE).select(*by, F.array_join(gram, " ").alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias("uses"))
    total = F.sum("uses").over(Window.partitionBy(*by)) if by else None
    if not by:
        g = g.crossJoin(F.broadcast(g.agg(F.sum("uses").alias("counted"))))
    else:
        g = g.withColumn("counted", total)
    return g.withColumn("shared", F.col("uses") >= F.greatest(F.lit(2), F.ceil(F.col("counted") * EDGE_SHARE)))


def template_parts(records: DataFrame) -> DataFrame:
    """records, opener_rate, closer_rate, scaffold_rate, score in one row, from one scan and one count by gram."""
    t = records.select(signal_tokens("text").alias("t"), F.exists(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(SCAFFOLD)).alias("s"))
    long = F.size("t") >= EDGE

    def edge(name, gram):
        return F.struct(F.lit(name).alias("edge"), F.array_join(gram, " ").alias("gram"))

    cells = F.array(F.when(long, edge("start", F.slice("t", 1, EDGE))), F.when(long, edge("end", F.slice("t", -EDGE, EDGE))), F.when(F.col("s"), edge("scaffold", F.array().cast("array<string>"))), edge("all", F.array().cast("array<string>")))
    g = t.select(F.explode(F.array_compact(cells)).alias("x")).groupBy("x.edge", "x.gram").agg(F.count("*").alias("uses"))
    counted = g.groupBy("edge").agg(F.sum("uses").alias("counted"))  # four rows, from the same exchange
    x = g.join(F.broadcast(counted), "edge")
    shared = F.col("uses") >= F.greatest(F.lit(2), F.ceil(F.col("counted") * EDGE_SHARE))

    def total(name, which=F.lit(True)):
        return F.coalesce(F.sum(F.when((F.col("edge") == name) & which, F.col("uses"))), F.lit(0))

    out = x.agg(total("all").alias("records"), *[F.coalesce(F.try_divide(total(e, shared), total(e)), F.lit(0.0)).alias(f"{e}_rate") for e in ("start", "end")], F.coalesce(F.try_divide(total("scaffold"), total("all")), F.lit(0.0)).alias("scaffold_rate"))
    return out.select("records", F.col("start_rate").alias("opener_rate"), F.col("end_rate").alias("closer_rate"), "scaffold_rate", (0.5 * F.col("start_rate") + 0.3 * F.col("end_rate") + 0.2 * F.col("scaffold_rate")).alias("score"))


def template(records: DataFrame) -> DataFrame:
    return _row(template_parts(records), "template", F.col("score"), F.col("records") > 0, "no records", F.col("records"))


def burstiness(records: DataFrame) -> DataFrame:
    """id, n_sentences, n_tokens, burst (sample deviation over mean of sentence lengths; null under two sentences)."""
    lens = F.filter(F.transform(sentences("text"), lambda s: F.size(signal_tokens(s)).cast("double")), lambda n: n > 0)
    x = records.select("id", lens.alias("lens"), F.size(signal_tokens("text")).cast("long").alias("n_tokens"))
    n, total = F.size("lens"), F.aggregate("lens", F.lit(0.0), lambda s, v: s + v)
    mean = total / n
    var = F.aggregate("lens", F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (n - 1)
    return x.select("id", n.cast("long").alias("n_sentences"), "n_tokens", F.when(n >= 2, F.sqrt(var) / mean).alias("burst"))


def length_variation(records: DataFrame) -> DataFrame:
    """records and the variation (sample deviation over mean) of their lengths in tokens, in one row."""
    n = records.select(F.size(signal_tokens(F.coalesce("text", F.lit("")))).alias("n")).agg(F.count("*").alias("records"), F.avg("n").alias("m"), F.stddev_samp("n").alias("sd"))
    return n.select("records", F.coalesce(F.try_divide("sd", "m"), F.lit(0.0)).alias("variation"))


def length_shape(records: DataFrame) -> DataFrame:
    b = burstiness(records).agg(F.avg("burst").alias("x"), F.count("burst").alias("n"))
    return _row(b, "length_shape", F.col("x"), F.col("n") >= 10, "fewer than ten records with two sentences", F.col("n"))


def variety_parts(records: DataFrame) -> DataFrame:
    """tokens, types, ratio, rare_rate (mean share of tokens used at most twice in the batch) in one row.

    One scan, one count by word: a word used at most twice adds the reciprocal
    lengths of its records, which are the least and the greatest it met.
    """
    t = records.select(signal_tokens("text").alias("t"))
    w = t.select(F.explode("t").alias("w"), F.size("t").alias("n")).groupBy("w").agg(F.count("*").alias("uses"), F.min("n").alias("a"), F.max("n").alias("z"), F.sum(1.0 / F.col("n")).alias("share"))
    rare = F.when(F.col("uses") == 1, 1.0 / F.col("a")).when(F.col("uses") == 2, 1.0 / F.col("a") + 1.0 / F.col("z")).otherwise(0.0)
    out = w.agg(F.sum("uses").alias("tokens"), F.count("*").alias("types"), F.sum(rare).alias("r"), F.round(F.sum("share")).alias("records"))  # each record's shares add up to one
    return out.select("tokens", "types", F.try_divide("types", "tokens").alias("ratio"), F.try_divide("r", "records").alias("rare_rate"))


def lexical_variety(records: DataFrame) -> DataFrame:
    return _row(variety_parts(records), "lexical_variety", F.col("ratio"), F.coalesce(F.col("tokens") >= 500, F.lit(False)), "fewer than 500 tokens", F.coalesce("tokens", F.lit(0)))


def flagged(records: DataFrame, most: int = 200) -> dict[str, list]:
    """Ids (or authors) that each signal points at: near copies (``most`` at most), the 50 most central, the ten closest authors."""
    near = near_duplicate_records(records, "id").filter("n_near > 0").orderBy("id").limit(most)
    _, central = lexical_cluster(records)
    out = {"near_dup": [r.id for r in near.collect()], "lexical_cluster": [r.id for r in central.collect()] if central is not None else []}
    if "author_id" in records.columns:
        out["stylometry"] = [r.author_id for r in stylometry(records)[1].collect()]
    return out


def run_signals(records: DataFrame) -> DataFrame:
    """All six in their fixed order: place, key, value, available, reason, n."""
    if records.select("text").distinct().limit(2).count() < 2:
        raise TooFewTextsError("fewer than two distinct texts")
    has_author = "author_id" in records.columns
    authored = records if has_author else records.withColumn("author_id", F.lit(None).cast("string"))
    parts = [near_dup(records), lexical_cluster(records)[0], stylometry(authored)[0], template(records), length_shape(records), lexical_variety(records)]
    out = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("place"), "*")
        out = p if out is None else out.unionByName(p)
    if not out.filter(F.col("value").isNotNull() & (F.isnan("value") | (F.abs("value") == float("inf")))).isEmpty():
        raise NotFiniteError("a signal is not a finite number")
    return out

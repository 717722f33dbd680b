"""Every registered query with SQL must return the rows its SQL returns; the others hold what they promise."""

import os

import duckdb
import pytest

from textweir.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("None" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(con.sql(ORACLES[name]).df())


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_queries_without_sql(spark, con):
    """What operators' own tests hold against models is checked here for its shape on the tables."""
    from textweir.functions.hashing import Mulberry

    n, pages, sources = (con.sql(f"select count({x}) from {t}").fetchall()[0][0] for x, t in (("*", "documents"), ("*", "pages"), ("distinct source", "documents")))
    draw = Mulberry(0x1CE07)
    draws = [draw() for _ in range(n)]
    assert [r.draw for r in sorted(rows(spark, "seeded_draws"))] == draws  # ids run from 0
    bodies = rows(spark, "page_text")
    assert len(bodies) == pages and not any("<script" in r.body for r in bodies)
    assert sum(r.n_pages for r in rows(spark, "crawl_slice")) == sum(len(r.body) >= 200 for r in bodies)
    text = dict(con.sql("select doc_id, text from documents").fetchall())
    found = {(r.doc_id, r.item_id, r.start) for r in rows(spark, "exact_runs") if r.survives}
    evidence = rows(spark, "exact_evidence")
    assert {(r.doc_id, r.item_id, r.start) for r in evidence} == found and all(r.before + r.matched + r.after in text[r.doc_id] for r in evidence)
    gated = {r.doc_id for r in rows(spark, "near_gated_docs")}
    assert all(r.doc_id in gated and 0.55 <= r.score <= 1 for r in rows(spark, "near_hits"))
    near = rows(spark, "near_duplicate_records")
    assert len(near) == sum(any(c.isalnum() for c in t) for t in text.values()) and sum(r.n_near for r in near) % 2 == 0
    (cluster,) = rows(spark, "lexical_cluster")
    assert cluster.available and 0 < cluster.value < 1
    assert all(0 <= r.mean_distance <= 2 for r in rows(spark, "author_distances")) and len(rows(spark, "author_dispersion")) <= sources
    sizes = {r.rate: r.grams for r in rows(spark, "winnow_sizes")}
    assert sizes[1] > sizes[16] > sizes[64] > sizes[256] > 0
    assert set(QUERIES) - set(ORACLES) == {"seeded_draws", "page_text", "crawl_slice", "exact_evidence", "near_hits", "near_duplicate_records", "lexical_cluster", "author_distances", "author_dispersion", "winnow_sizes"}


def tables(folder, **rows):
    """A folder with tables of a few rows, and a connection to it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    c = duckdb.connect()
    for name, columns in rows.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
        c.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return c


def agree(spark, folder, con, *names):
    for name in names:
        assert plain(QUERIES[name](spark, str(folder)).toPandas()) == plain(con.sql(ORACLES[name]).df()), name


def test_documents_of_dropped_runs_are_not_gated(spark, tmp_path):
    """Eight documents hold one item: the last three runs were no longer rare, but are runs."""
    items = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(5)]
    con = tables(tmp_path, benchmark={"item_id": [0, 1, 2, 3, 4], "text": items}, documents={"doc_id": list(range(10)), "source": ["a"] * 10, "text": [f"{items[0]} tail{i}" for i in range(8)] + ["no run", None]})
    agree(spark, tmp_path, con, "near_gated_docs")
    assert sorted(r.doc_id for r in QUERIES["near_gated_docs"](spark, str(tmp_path)).collect()) == [8, 9]


ODD = ["a b c d e f a b c d e f", "a b c d e a b c d e", "One, two: 'three' -- (four)! five? six; seven. \u2013 eight \u2014 \u201cnine\u201d \"ten\"", "", None, "?!", "x", "Istanbul \u03a3\u0391\u03a3 \u00e9t\u00e9 na\u00efve \u6f22\u5b57 \U00010400x \u0661\u0662 a_b  c\u00a0d", "no.\n\nyes!  maybe? \t so it's;\n \n"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shingles_are_counted_where_the_text_is(spark, tmp_path):
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8]
    con = tables(tmp_path, documents={"doc_id": ids, "text": ODD})
    agree(spark, tmp_path, con, "shingle_counts")
    assert "Exchange" not in plan(QUERIES["shingle_counts"](spark, str(tmp_path)))


def test_shingles_of_repeated_ids(spark, tmp_path):
    con = tables(tmp_path, documents={"doc_id": [0, 0, 1, None, None, 2, 3, 4, 4], "text": ODD})
    agree(spark, tmp_path, con, "shingle_counts")


def test_punctuation_is_counted_without_ten_regexes(spark, tmp_path):
    con = tables(tmp_path, documents={"doc_id": list(range(len(ODD))), "text": ODD})
    agree(spark, tmp_path, con, "punctuation_rates")
    assert plan(QUERIES["punctuation_rates"](spark, str(tmp_path))).count("regexp_extract_all") <= 2


def authored(folder, repeat=1):
    """Two authors of 32 records and one of a single record; with ``repeat`` ids come that often."""
    texts = [f"{t or ''} the of and {i}." if t is not None else None for i in range(8) for t in ODD[:8]] + ["alone here."]
    authors = ["a", "b"] * 32 + ["c"]
    return tables(folder, documents={"doc_id": [i // 2 // repeat * 2 + i % 2 for i in range(65)], "source": authors, "text": texts})


def test_styles_are_counted_where_the_text_is(spark, tmp_path):
    agree(spark, tmp_path, authored(tmp_path), "style_features")
    made = plan(QUERIES["style_features"](spark, str(tmp_path)))
    assert made.count("Scan parquet") == 1 and "Generate explode(tokens" not in made


def test_dispersion_of_records_and_of_repeated_ids(spark, tmp_path):
    """Held against style vectors of (author, id) groups, which is what a record's own vector must be."""
    from textweir.operators import signals

    for repeat in (1, 2):
        folder = tmp_path / str(repeat)
        folder.mkdir()
        authored(folder, repeat)
        r = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id id", "text", "source author_id")
        found = {x.author_id: (x.n_records, round(x.dispersion, 9)) for x in QUERIES["author_dispersion"](spark, str(folder)).collect()}
        centre = {x.author_id: x for x in signals.style_vectors(r, "author_id").collect() if x.n_records >= 30}
        each = {}
        for x in signals.style_vectors(r, "author_id", "id").collect():
            if x.author_id in centre:  # a record without a text has cosine 0
                a, b = x.vector, centre[x.author_id].vector
                each.setdefault(x.author_id, []).append(1 if None in a else 1 - sum(p * q for p, q in zip(a, b)) / ((sum(p * p for p in a) * sum(q * q for q in b)) ** 0.5 or 1))
        assert found == {k: (centre[k].n_records, round(sum(v) / len(v), 9)) for k, v in each.items()}
    assert plan(QUERIES["author_dispersion"](spark, str(tmp_path / "1"))).count("explode") == 0


def test_distinct_grams_travel_packed(spark, tmp_path, monkeypatch):
    """Flushes of few grams, so that grams meet across flushes, ranges and checkpoints; against SQL and counts by key."""
    from textweir.operators import index, studies

    monkeypatch.setattr(studies, "FLUSH", 50)
    body = [" ".join(f"w{(i * 7 + j) % 97}" for j in range(40)) for i in range(150)]
    con = tables(tmp_path, documents={"doc_id": [(i * 37) % 997 for i in range(300)], "text": [*body, *body[::-1]]})
    agree(spark, tmp_path, con, "heaps_points", "heaps_fit")
    keys = index.grams(spark.read.parquet(f"{tmp_path}/documents.parquet"), 10)
    assert sorted(QUERIES["winnow_sizes"](spark, str(tmp_path)).select("rate", "distinct_grams", "grams").collect()) == sorted(studies.winnowed(keys).select("rate", "distinct_grams", "grams").collect())
    for name in ("heaps_points", "winnow_sizes"):
        assert "hashpartitioning(key" not in plan(QUERIES[name](spark, str(tmp_path)))


def test_entry_imports():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

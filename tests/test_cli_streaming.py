import json

import pytest

from textweir import cli, errors
from textweir.operators.index import build_index
from textweir.streaming.incremental import watch

ITEM = " ".join(f"alpha{k}" for k in range(20))


def test_arguments():
    assert cli.parse(["contaminate", "--corpus=a", "--n", "10"]) == ("contaminate", {"--corpus": "a", "--n": "10"})
    for bad in (["nothing"], ["contaminate", "--corpsu", "x"]):
        with pytest.raises(errors.UnknownFlagError):
            cli.parse(bad)
    with pytest.raises(errors.MissingValueError):
        cli.parse(["contaminate", "--corpus", "--n"])
    with pytest.raises(errors.ThresholdError):
        cli.positive({"--n": "0"}, "--n", 3)


def test_contaminate_from_files(spark, tmp_path, capsys):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": str(i), "text": t}) + "\n" for i, t in enumerate(["clean text", f"x {ITEM} y"])))
    (tmp_path / "b.jsonl").write_text(json.dumps({"id": "q", "text": ITEM}) + "\n")
    flags = {"--corpus": f"{tmp_path}/c.jsonl", "--bench": f"{tmp_path}/b.jsonl", "--out": f"{tmp_path}/r.json", "--html": f"{tmp_path}/r.html", "--fail-over": "0"}
    assert cli.contaminate(spark, flags) == 1
    assert json.loads((tmp_path / "r.json").read_text())["exact"]["items_hit"] == 1
    with pytest.raises(errors.InputMissingError):
        cli.contaminate(spark, flags | {"--corpus": "/nowhere"})


def test_index_files_and_the_guard(spark, tmp_path, capsys):
    other = " ".join(f"beta{k}" for k in range(20))
    edited = " ".join(w if k % 9 else "zzz" for k, w in enumerate((" ".join(f"gamma{k}" for k in range(60))).split()))
    rows = [("q", ITEM), ("e", " ".join(f"gamma{k}" for k in range(60)))]
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"id": i, "text": t}) + "\n" for i, t in rows))
    (tmp_path / "other.jsonl").write_text(json.dumps({"id": "q", "text": other}) + "\n")
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": str(i), "text": t}) + "\n" for i, t in enumerate(["clean text", f"x {ITEM} y", edited])))
    assert cli.build(spark, {"--bench": f"{tmp_path}/b.jsonl", "--out": f"{tmp_path}/mine.idx.bin.gz", "--item-noun": "task"}) == 0
    flags = {"--corpus": f"{tmp_path}/c.jsonl", "--index": "mine", "--index-dir": str(tmp_path), "--out": f"{tmp_path}/r.json"}
    assert cli.contaminate(spark, flags) == 0
    r = json.loads((tmp_path / "r.json").read_text())
    assert r["exact"]["items_hit"] == 1 and not r["near"]["available"] and r["receipt"]["item_noun"] == {"one": "task", "many": "tasks"}
    assert r["receipt"]["corpus"]["tokens"] == 2 + 22 + 60 and r["receipt"]["corpus"]["bytes"] == (tmp_path / "c.jsonl").stat().st_size
    assert cli.contaminate(spark, flags | {"--bench": f"{tmp_path}/b.jsonl"}) == 0
    with pytest.raises(errors.BenchmarkMismatchError):
        cli.contaminate(spark, flags | {"--bench": f"{tmp_path}/other.jsonl"})
    with pytest.raises(errors.IndexMissingError):
        cli.contaminate(spark, flags | {"--index": "nothing"})
    with pytest.raises(errors.MissingValueError):
        cli.contaminate(spark, {"--corpus": f"{tmp_path}/c.jsonl"})


def test_baselines_and_score(spark, tmp_path, capsys, monkeypatch):
    """The commands over two of the six signals, so that draws are quick."""
    import random

    from textweir.operators import signals

    two = lambda records: signals.template(records).unionByName(signals.length_shape(records))
    monkeypatch.setattr(signals, "run_signals", two)
    monkeypatch.setattr(signals, "flagged", lambda records: {"near_dup": ["a<b"]})
    r = random.Random(5)
    pools = {"human": [f"h{k}" for k in range(400)], "machine": [f"m{k}" for k in range(60)]}

    def text(side):
        n = (3, 25) if side == "human" else (9, 11)
        return " ".join(" ".join(r.choices(pools[side], k=r.randint(*n))) + "." for _ in range(4))

    for side in pools:
        (tmp_path / f"{side}.jsonl").write_text("".join(json.dumps({"id": f"{side}{k}", "text": text(side)}) + "\n" for k in range(320)))
        flags = {"--corpus": f"{tmp_path}/{side}.jsonl", "--label": side, "--chunk": "100", "--draws": "3", "--out": f"{tmp_path}/{side}.json"}
        assert cli.baseline(spark, flags) == 0
    (tmp_path / "batch.jsonl").write_text("".join(json.dumps({"text": text("human")}) + "\n" for _ in range(100)) + "not json\n")
    flags = {"--batch": f"{tmp_path}/batch.jsonl", "--human": f"{tmp_path}/human.json", "--machine": f"{tmp_path}/machine.json", "--out": f"{tmp_path}/s.json", "--html": f"{tmp_path}/s.html"}
    assert cli.score(spark, flags) == 0
    s = json.loads((tmp_path / "s.json").read_text())
    assert s["purity"] >= 85 and s["verdict"] == "human" and s["records"] == 100 and s["skipped"] == 1
    page = (tmp_path / "s.html").read_text()
    assert len(s["signals"]) == 2 and "<meter" in page and "a&lt;b" in page
    with pytest.raises(errors.InputMissingError):
        cli.score(spark, flags | {"--human": "/nowhere"})


def test_streaming_retracts_what_became_common(spark, tmp_path):
    """After every batch the findings are those of one scan of all documents so far, whatever their order."""
    from textweir.operators import exact
    from textweir.streaming.incremental import findings

    other = " ".join(f"beta{k}" for k in range(30))
    index = build_index(spark.createDataFrame([(0, ITEM), (1, other)], "item_id long, text string"))
    src, so_far = f"{tmp_path}/in", []
    batches = ([(10, f"z {ITEM}"), (11, f"{ITEM} {other}"), (12, "clean")], [(k, f"z {ITEM}") for k in (1, 20, 21)] + [(22, other)], [(k, f"q {ITEM} {k}") for k in range(30, 36)])
    for part in batches:
        so_far += part
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        q = watch(spark.readStream.schema("doc_id long, text string").parquet(src), index, f"file://{tmp_path}/out", f"{tmp_path}/cp", trigger={"availableNow": True})
        q.awaitTermination(120)
        assert q.exception() is None
        columns = ["doc_id", "item_idx", "start", "stop", "grams", "early_rare", "survives"]
        want = exact.runs(exact.raw_hits(spark.createDataFrame(so_far, "doc_id long, text string"), index), index).select(columns)
        got = findings(spark, f"file://{tmp_path}/out").select(columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("survives").count() == 2  # the other item, in two documents

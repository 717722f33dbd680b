"""Command line: build an index, scan a corpus for a benchmark, build baselines, place or score a batch."""

from __future__ import annotations

import json
import os
import sys

from textweir import errors
from textweir.functions.text import suggest_flag

FLAGS = {
    "index": {"--bench", "--out", "--n", "--stride", "--name", "--item-noun"},
    "contaminate": {"--corpus", "--bench", "--index", "--index-dir", "--n", "--max-doc-frequency", "--text-field", "--out", "--html", "--fail-over"},
    "signals": {"--batch", "--text-field", "--author-field", "--out"},
    "baseline": {"--corpus", "--label", "--chunk", "--draws", "--text-field", "--author-field", "--out"},
    "score": {"--batch", "--human", "--machine", "--text-field", "--author-field", "--out", "--html"},
}


def parse(argv: list[str]) -> tuple[str, dict[str, str]]:
    if not argv or argv[0] not in FLAGS:
        raise errors.UnknownFlagError(f"commands: {', '.join(FLAGS)}")
    command, rest, out = argv[0], argv[1:], {}
    while rest:
        flag, *rest = rest
        name, eq, value = flag.partition("=")
        if name not in FLAGS[command]:
            near = suggest_flag(name, sorted(FLAGS[command]))
            raise errors.UnknownFlagError(f"no flag {name}" + (f"; did you mean {near}?" if near else ""))
        if not eq:
            if not rest or rest[0].startswith("--"):
                raise errors.MissingValueError(f"{name} needs a value")
            value, *rest = rest
        out[name] = value
    return command, out


def positive(flags: dict, name: str, default: int) -> int:
    value = flags.get(name, str(default))
    if not value.isdigit() or int(value) < 1:
        raise errors.ThresholdError(f"{name} must be a positive integer, not {value}")
    return int(value)


def _needed(flags: dict, *names: str) -> list[str]:
    for n in names:
        if n not in flags:
            raise errors.MissingValueError(f"{n} is needed")
    return [flags[n] for n in names]


def _there(*paths: str) -> None:
    for p in paths:
        if "://" not in p and not os.path.exists(p):
            raise errors.InputMissingError(p)


def _items(spark, path: str):
    from pyspark.sql import functions as F

    from textweir.sources import corpus

    _there(path)
    records, _ = corpus.load_batch(corpus.read_lines(spark, path))
    return records.select(F.col("id").alias("item_id"), "text")


def _save(text: str, flags: dict, name: str) -> None:
    if name in flags:
        with open(flags[name], "w", encoding="utf-8") as f:
            f.write(text)


def build(spark, flags: dict) -> int:
    """Write an index file of a benchmark."""
    from textweir.operators.index import build_index
    from textweir.report import benchmark_identity
    from textweir.sources.index_codec import write_index

    bench, out = _needed(flags, "--bench", "--out")
    items = _items(spark, bench)
    index = build_index(items, positive(flags, "--n", 10), positive(flags, "--stride", 1))
    one, _, many = flags.get("--item-noun", "item,items").partition(",")
    meta = write_index(index, out, flags.get("--name", os.path.basename(bench).split(".")[0]), benchmark_identity(items), (one, many or one + "s"))
    print(f"{meta['stats']['grams_kept']} grams of {len(meta['itemIds'])} {meta['itemNoun']['many']} in {out}")
    return 0


def contaminate(spark, flags: dict) -> int:
    """Scan a corpus; the index comes from a file, or is built from the benchmark."""
    from pyspark.sql import functions as F

    from textweir.operators import exact, near
    from textweir.operators.index import Index, build_index
    from textweir.report import benchmark_identity, html_page, scan_report, text_summary, write_json
    from textweir.sources import corpus
    from textweir.sources.index_codec import read_index, resolve_index

    paths = _needed(flags, "--corpus")[0].split(",")
    _there(*paths)
    most = positive(flags, "--max-doc-frequency", exact.MAX_DOC_FREQUENCY)
    items = _items(spark, flags["--bench"]) if "--bench" in flags else None
    identity, named = benchmark_identity(items) if items is not None else None, {}
    if "--index" in flags:
        meta, owners = read_index(resolve_index(flags["--index"], flags.get("--index-dir")))
        if identity not in (None, meta["benchmarkHash"]):
            raise errors.BenchmarkMismatchError(f"--bench is not what the index was built from (index {meta['benchmarkHash']}, --bench {identity})")
        index, identity = Index.from_file(spark, meta, owners), meta["benchmarkHash"]
        named = {"benchmark": meta["benchmark"], "item_noun": meta["itemNoun"]}
    elif items is None:
        raise errors.MissingValueError("--bench or --index is needed")
    else:
        index = build_index(items, positive(flags, "--n", 10))
    lines = corpus.read_lines(spark, paths)
    parsed = corpus.require_documents(corpus.parse_corpus(lines, flags.get("--text-field")))
    docs = parsed.filter("skip_reason is null").select(F.col("doc_seq").alias("doc_id"), "text")
    hits, totals = exact.scan(docs, index)
    runs = exact.runs(hits, index, index.stride, most).cache()
    close = near.near_tier(docs, items, runs).cache() if items is not None else None
    accounting = corpus.accounting(parsed).collect()[0].asDict() | totals | {"bytes": corpus.corpus_bytes(lines, paths)}
    report = scan_report(index, runs, docs, identity, accounting, most, close, named)
    if "--out" in flags:
        write_json(report, flags["--out"])
    _save(html_page(report), flags, "--html")
    print(text_summary(report))
    return int("--fail-over" in flags and len(report["contaminated_items"]) > int(flags["--fail-over"]))


def _batch(spark, path: str, flags: dict):
    from textweir.sources import corpus

    _there(path)
    return corpus.load_batch(corpus.read_lines(spark, path), flags.get("--text-field"), author_field=flags.get("--author-field"))


def place(spark, flags: dict) -> int:
    """The six signals of a batch."""
    from textweir.operators.signals import run_signals

    records, skipped = _batch(spark, _needed(flags, "--batch")[0], flags)
    rows = [r.asDict() for r in run_signals(records).orderBy("place").collect()]
    text = json.dumps({"signals": rows, "skipped": skipped.count()}, ensure_ascii=False, indent=1)
    _save(text, flags, "--out")
    print(text)
    return 0


def baseline(spark, flags: dict) -> int:
    """Means and deviations of the signals over seeded draws from the calibration half of a reference corpus."""
    from textweir.operators import scoring
    from textweir.operators.signals import run_signals

    path, out = _needed(flags, "--corpus", "--out")
    records, _ = _batch(spark, path, flags)
    half, _ = scoring.split_corpus(records)
    chunk = positive(flags, "--chunk", scoring.CHUNK)
    rows = scoring.build_baseline(half, run_signals, chunk, positive(flags, "--draws", scoring.DRAWS)).collect()
    found = {"label": flags.get("--label", "reference"), "corpus": os.path.basename(path), "records": half.count(), "chunkSize": chunk, "signals": {r.key: {"mean": r["mean"], "sd": r.sd, "n": r.n} for r in rows}}
    _save(json.dumps(found, indent=1), flags, "--out")
    print(f"{len(rows)} signals of {found['records']} records in {out}")
    return 0


def _baseline(spark, path: str):
    _there(path)
    with open(path, encoding="utf-8") as f:
        b = json.load(f)
    return spark.createDataFrame([(k, v["mean"], v["sd"], v["n"]) for k, v in b["signals"].items()], "key string, mean double, sd double, n long"), b["chunkSize"]


def score(spark, flags: dict) -> int:
    """A batch between a human and a machine baseline: purity, confidence and verdict."""
    from textweir.operators import scoring, signals
    from textweir.report import batch_page, batch_report, batch_summary, write_json

    path, human, machine = _needed(flags, "--batch", "--human", "--machine")
    records, skipped = _batch(spark, path, flags)
    (h, chunk), (m, _) = _baseline(spark, human), _baseline(spark, machine)
    scored, verdict = scoring.score_batch(records, h, m, chunk)
    report = batch_report(records, scored, verdict, skipped, signals.flagged(records), os.path.basename(path))
    if "--out" in flags:
        write_json(report, flags["--out"])
    _save(batch_page(report), flags, "--html")
    print(batch_summary(report))
    return 0


COMMANDS = {"index": build, "contaminate": contaminate, "signals": place, "baseline": baseline, "score": score}


def main(argv: list[str]) -> int:
    try:
        command, flags = parse(argv)
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("textweir").getOrCreate()
        return COMMANDS[command](spark, flags)
    except errors.TextweirError as e:
        print(f"refused: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

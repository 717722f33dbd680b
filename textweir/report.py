"""Receipt and reports of a scan or a batch: JSON for machines, one escaped HTML page for people, text for a terminal."""

from __future__ import annotations

import hashlib
import html
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.functions.hashing import portable_hash

#: Matches, discards, blind items and ids that a report lists; totals always count all.
SHOWN = 200


def benchmark_identity(items: DataFrame) -> str:
    """Hash of all items' ids and texts, in the order of ids (streamed through the driver)."""
    rows = items.select("item_id", "text").orderBy("item_id").toLocalIterator()
    return portable_hash(f"{r.item_id}\x01{r.text or ''}" for r in rows)


def scan_report(index, runs: DataFrame, docs: DataFrame, identity: str, accounting: dict | None = None, max_df: int = 5, near: DataFrame | None = None, meta: dict | None = None) -> dict:
    """What was found, what was dropped and why, and what could not be checked. ``near`` None: that tier had no texts of items."""
    from textweir.operators.exact import dropped, evidence, summary

    tier = summary(runs, index).collect()[0].asDict()
    names = index.items.select("item_idx", "item_id")
    order = ["doc_id", "item_idx", "start"]

    def shown(some: DataFrame) -> list[dict]:
        first = some.orderBy(*order).limit(SHOWN)
        texts = evidence(first, docs).join(first.select("doc_id", "item_idx", "start", *[c for c in first.columns if c == "condemned_by"]), order)
        return [r.asDict() for r in texts.join(names, "item_idx").orderBy(*order).collect()]

    blind = index.uncheckable()
    counts = blind.agg(F.count("*").alias("items"), F.count_if("unsegmented").alias("unsegmented")).collect()[0].asDict()
    flagged = runs.filter("survives").select("item_idx").distinct().join(names, "item_idx").select(F.col("item_id").cast("string").alias("item_id"))
    near_part = {"available": False, "reason": "needs the texts of the items; an index file carries hashes only"}
    if near is not None:
        hits = near.agg(F.count("*").alias("hits"), F.count_distinct("item_id").alias("items_hit")).collect()[0].asDict()
        near_part = {"available": True} | hits | {"shown": [r.asDict() for r in near.orderBy("doc_id", "item_id").limit(SHOWN).collect()]}
        flagged = flagged.unionByName(near.select(F.col("item_id").cast("string").alias("item_id"))).distinct()
    return {
        "receipt": {"benchmark_hash": identity, "n": index.n, "stride": index.stride, "max_document_frequency": max_df, "stats": index.stats.collect()[0].asDict(), "corpus": accounting or {}} | (meta or {}),
        "exact": tier | {"rate": tier["items_hit"] / tier["items_total"] if tier["items_total"] else 0.0},
        "near": near_part,
        "semantic": {"available": False, "reason": "no embedding provider"},
        "uncheckable": counts | {"shown": [r.asDict() for r in blind.orderBy("item_id").limit(SHOWN).collect()]},
        "contaminated_items": [r.item_id for r in flagged.orderBy("item_id").collect()],  # at most the benchmark's
        "hits": shown(runs.filter("survives")),
        "dropped": shown(dropped(runs).withColumn("min_df", F.col("condemned_by"))),
    }


def batch_report(records: DataFrame, scored: DataFrame, verdict: DataFrame, skipped: DataFrame, flagged: dict[str, list], name: str = "batch") -> dict:
    """The signals of a batch beside two references, its purity, and the records the signals point at."""
    from textweir.operators.scoring import author_stats

    authors = author_stats(records).collect()[0].asDict() if "author_id" in records.columns else {"authors": 0, "with_enough": 0}
    ids = list(dict.fromkeys(str(x) for v in flagged.values() for x in v))
    return {"batch": name, "records": records.count(), "skipped": skipped.count(), "authors": authors, "signals": [r.asDict() for r in scored.collect()], **verdict.collect()[0].asDict(), "flagged": ids}


def write_json(report: dict, path: str) -> str:
    """Write a report and return its SHA-256."""
    raw = json.dumps(report, ensure_ascii=False, indent=1, default=str)
    with open(path, "w", encoding="utf-8") as f:
        f.write(raw)
    return hashlib.sha256(raw.encode()).hexdigest()


def safe_name(text: str, most: int = 40) -> str:
    """Letters, digits, dots and dashes for a file's name."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", text)[:most].strip("-") or "report"


def _e(x) -> str:
    return html.escape(str(x), quote=True)


def _page(title: str, body: str) -> str:
    return f"<!doctype html><meta charset=utf-8><title>{_e(title)}</title><style>body{{font:15px/1.5 sans-serif;max-width:60rem;margin:2rem auto}}td,th{{text-align:left;padding:.3rem .6rem;border-bottom:1px solid #ccc}}meter{{width:7rem}}</style>{body}"


def _list(facts: dict) -> str:
    return "<ul>" + "".join(f"<li>{_e(k)}: {_e(v)}</li>" for k, v in facts.items()) + "</ul>"


def _matches(rows: list[dict], last: str) -> str:
    return "<table>" + "".join(f"<tr><td>{_e(h['doc_id'])}<td>{_e(h['item_id'])}<td>{_e(h['before'])}<mark>{_e(h['matched'])}</mark>{_e(h['after'])}<td>{_e(h[last])}" for h in rows) + "</table>"


def html_page(report: dict) -> str:
    """A self-contained page; all text from data is escaped."""
    t, u, near = report["exact"], report["uncheckable"], report["near"]
    blind = "".join(f"<li>{_e(b['item_id'])}{' (script without word separators)' if b['unsegmented'] else ''}</li>" for b in u["shown"])
    close = "<table>" + "".join(f"<tr><td>{_e(h['doc_id'])}<td>{_e(h['item_id'])}<td>{_e(h['sample'])}<td>{h['score']:.2f}" for h in near["shown"]) + "</table>" if near["available"] else f"<p>{_e(near['reason'])}"
    body = f"<h1>{_e(t['items_hit'])} of {_e(t['items_total'])} items found</h1>{_list({**t, **report['receipt']['stats'], **report['receipt']['corpus']})}<h2>Not checkable: {u['items']}</h2><ul>{blind}</ul><h2>Matches</h2>{_matches(report['hits'], 'min_df')}<h2>Edited copies</h2>{close}<h2>Dropped as common: {_e(t['dropped_generic'])}</h2>{_matches(report['dropped'], 'condemned_by')}"
    return _page("Overlap report", body)


def batch_page(report: dict) -> str:
    """The batch report as a page: one row a signal with its place between the references, then the flagged ids."""

    def number(x, digits=4):
        return "-" if x is None else f"{x:.{digits}f}"

    def row(s: dict) -> str:
        place = f"<meter min=0 max=1 value={min(1.0, max(0.0, s['likeness'])):.3f}></meter>" if s["likeness"] is not None else "not compared"
        return f"<tr><td>{_e(s['key'])}<td>{number(s['value'])}<td>{number(s['z'], 2)}<td>{number(s['separation'], 2)}<td>{place}<td>{_e('compared' if s['used'] else s['skip_reason'])}"

    ids = report["flagged"]
    some = "".join(f"<code>{_e(x)}</code> " for x in ids[:50]) if ids else "No record is flagged."
    purity = "no score" if report["purity"] is None else report["purity"]
    head = f"<h1>{_e(report['batch'])}</h1><p>{report['records']} records, {report['skipped']} lines skipped, {report['authors']['authors']} authors ({report['authors']['with_enough']} with enough records)<p><b>{_e(purity)}</b> {_e(report['verdict'])}, confidence {_e(report['confidence'])}, {report['n_used']} signals compared"
    return _page(f"Batch report: {report['batch']}", f"{head}<table><tr><th>signal<th>value<th>z<th>separation<th>place<th>{''.join(map(row, report['signals']))}</table><h2>Flagged records: {len(ids)}</h2><p>{some}")


def text_summary(report: dict) -> str:
    """What a terminal shows of a scan: what was found, what was not checked, and how to repeat it."""
    t, u, near, r = report["exact"], report["uncheckable"], report["near"], report["receipt"]
    lines = [f"{t['items_hit']} of {t['items_total']} items found in {t['docs_hit']} documents ({t['hits']} matches; {t['dropped_generic']} dropped as common; {u['items']} items not checkable)"]
    lines += [f"  {h['item_id']} in {h['doc_id']}: {h['before']}[[{h['matched']}]]{h['after']}" for h in report["hits"][:10]]
    if u["unsegmented"]:
        lines.append(f"  {u['unsegmented']} items are in a script that can't be split into words: nothing was looked for there")
    lines.append(f"  edited copies: {near['hits']} of {near['items_hit']} items" if near["available"] else f"  edited copies: {near['reason']}")
    lines.append(f"  benchmark {r['benchmark_hash']}, n {r['n']}, stride {r['stride']}, at most {r['max_document_frequency']} documents a gram")
    return "\n".join(lines)


def batch_summary(report: dict) -> str:
    """What a terminal shows of a batch."""
    lines = [f"{report['batch']}: purity {'none' if report['purity'] is None else report['purity']}, {report['verdict']} (confidence {report['confidence']}, {report['n_used']} signals)"]
    for s in report["signals"]:
        value = "-" if s["value"] is None else f"{s['value']:.4f}"
        lines.append(f"  {s['key']:16} {value:>10}  {'compared' if s['used'] else s['skip_reason']}")
    return "\n".join(lines)

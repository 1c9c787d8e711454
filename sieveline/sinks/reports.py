"""Reports of results: JSON, console table and HTML.

``save_json`` and ``save_html`` are written by tasks (see ``document``), on any
store; ``write_json`` and ``write_html`` take rows that the driver has, one after
the other.  ``write_rows`` writes JSON lines.
"""

from __future__ import annotations

import html
import json
import shlex
from collections import Counter
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .document import write_document

HEADERS = ("Path", "Severity", "Score", "Issues")
#: Shade of each band and of each finding's severity in the page; others are like the last.
SHADES = {"High": "s3", "Suspicious": "s2", "Caution": "s1", "Safe": "s0", "high": "s3", "medium": "s2", "low": "s1"}


def utc_now() -> str:
    return datetime.now(UTC).replace(tzinfo=None).isoformat() + "Z"


def to_json(results: DataFrame) -> DataFrame:
    """One JSON text per result; fields without a value are left out."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("json"))


def dicts(results: DataFrame) -> Iterator[dict]:
    for row in to_json(results).toLocalIterator():
        yield json.loads(row["json"])


def write_rows(results: DataFrame, path: str) -> None:
    """JSON lines, written by the executors."""
    results.write.mode("overwrite").json(path)


def write_json(results: Iterable[dict], path: str) -> None:
    """One document, written row by row."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{\n  "generated_at": {json.dumps(utc_now())},\n  "files": [')
        before = "\n"
        for r in results:
            f.write(before + json.dumps(r, indent=2))
            before = ",\n"
        f.write("\n  ]\n}\n")


def save_json(results: DataFrame, path: str) -> None:
    """The same document, written by tasks in the order of the results."""
    head = f'{{\n  "generated_at": {json.dumps(utc_now())},\n  "files": [\n'
    write_document(results, path, head, partial(json.dumps, indent=2), ",\n", lambda _: "\n  ]\n}\n")


def console_columns(results: DataFrame) -> DataFrame:
    """The table's cells as text."""
    codes = F.array_join(F.transform("issues", lambda i: i["code"]), ", ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return results.select(text("path").alias("path"), text("severity").alias("severity"), text("score").alias("score"), F.coalesce(F.nullif(codes, F.lit("")), F.lit("-")).alias("issues"))


def console_lines(results: DataFrame) -> Iterator[str]:
    """The table line by line: one pass for the widths, one for the rows."""
    cells = console_columns(results)
    widest = cells.agg(*(F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in cells.columns)).first()
    widths = [max(len(h), w) for h, w in zip(HEADERS, widest, strict=True)]
    line = lambda row: " | ".join(x.ljust(w) for x, w in zip(row, widths, strict=True))
    yield line(HEADERS)
    yield "-+-".join("-" * w for w in widths)
    for row in cells.toLocalIterator():
        yield line(row)


STYLE = """
:root { color-scheme: light dark; } main { display: flex; flex-direction: column; max-width: 76rem; margin: auto; font: 1rem/1.45 sans-serif; }
#totals { order: -1; } table { border-spacing: 0; } tbody > tr:first-child > * { border-top: 1px solid gray; padding-top: .5rem; }
th, td { text-align: start; vertical-align: top; padding: .15rem .8rem .15rem 0; } kbd, samp { overflow-wrap: anywhere; }
.s0, .s1, .s2, .s3 { border-inline-start: .5rem solid; padding-inline-start: .4rem; } .s0 { border-color: seagreen; } .s1 { border-color: goldenrod; } .s2 { border-color: darkorange; } .s3 { border-color: crimson; }
"""


def _shaded(label: str) -> str:
    return f'<span class="{SHADES.get(label, "s0")}">{html.escape(label)}</span>'


def _finding(issue: dict) -> str:
    evidence = f" <samp>{html.escape(issue['evidence'])}</samp>" if issue.get("evidence") else ""
    return f"<tr><td>{_shaded(issue.get('severity') or 'low')}<td><b>{html.escape(issue.get('code', ''))}</b><td>{html.escape(issue.get('description', ''))}{evidence}\n"


HTML_HEAD = f'<!DOCTYPE html>\n<html lang="en"><meta charset="utf-8"><title>Findings by file</title><style>{STYLE}</style>\n<main><table>\n'


def band_of(r: dict) -> str:
    return r.get("severity") or "Safe"


def html_rows(r: dict) -> str:
    """A file's group of rows: band, score and name, findings, what to run next."""
    path, issues = r.get("path", ""), r.get("issues") or ()
    out = [f"<tbody><tr><th>{_shaded(band_of(r))}<th>{html.escape(str(r.get('score', 0)))}<th>{html.escape(path)}\n"]
    if r.get("error"):
        out.append(f"<tr><td><td>not read<td>{html.escape(r['error'])}\n")
    out.append("".join(map(_finding, issues)) or "<tr><td><td><td>nothing found\n")
    if issues:
        out.append(f"<tr><td><td>to set it aside<td><kbd>{html.escape(f'python -m sieveline quarantine {shlex.quote(path)} --dest quarantine')}</kbd>\n")
    return "".join(out)


def html_tail(totals: Counter[str]) -> str:
    counts = ", ".join(f"{_shaded(band)} {n}" for band, n in sorted(totals.items()))
    return f"</table>\n<section id=totals><h1>Findings by file</h1><p>Contents were only inspected. Files: {counts or 'none'}</section></main>\n"


def html_parts(results: Iterable[dict]) -> Iterator[str]:
    """A page with one table, then how many files each band has."""
    yield HTML_HEAD
    totals: Counter[str] = Counter()
    for r in results:
        totals[band_of(r)] += 1
        yield html_rows(r)
    yield html_tail(totals)


def save_html(results: DataFrame, path: str) -> None:
    """The same page, written by tasks in the order of the results."""
    write_document(results, path, HTML_HEAD, html_rows, "", html_tail, band_of)


def write_html(results: Iterable[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(html_parts(results))

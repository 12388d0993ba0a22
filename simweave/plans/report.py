"""Reports: order, pages, text, HTML and files."""

from __future__ import annotations

import html
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = 100
SHOWN = 100


def ranked(pairs: DataFrame) -> DataFrame:
    """By similarity, descending; ties by id."""
    return pairs.orderBy(F.desc("similarity"), "id")


def top(pairs: DataFrame, n: int = SHOWN) -> DataFrame:
    return ranked(pairs).limit(n)


def page(pairs: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    return ranked(pairs).offset(max(0, offset)).limit(max(1, limit))


def with_rank(top_pairs: DataFrame) -> DataFrame:
    """Display ranks of a report's bounded list of pairs."""
    return top_pairs.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))


def latest(reports: DataFrame) -> DataFrame:
    """The report (run_id, generated_at, ...) generated last."""
    return reports.orderBy(F.desc("generated_at"), F.desc("run_id")).limit(1)


def by_short_id(pairs: DataFrame, short: str) -> DataFrame:
    """The pair (short_id, ...) of that short id."""
    return pairs.where(F.col("short_id") == short)


def summary_rows(pairs: DataFrame) -> DataFrame:
    """(id, similarity, lines) for display: per cent with one digit, lines of both sides with separators."""
    lines = lambda s: F.col(f"{s}.end_line") - F.col(f"{s}.start_line") + 1
    return pairs.select("id", F.concat(F.format_number(F.col("similarity") * 100, 1), F.lit("%")).alias("similarity"), F.format_number(lines("left") + lines("right"), 0).alias("lines"))


def file_name(at: datetime) -> str:
    stamp = at.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return "dupes-" + stamp.replace(":", "-").replace(".", "-") + ".json"


def counted_page(pairs: DataFrame, offset: int = 0, limit: int = PAGE) -> dict:
    """{total, offset, limit, rows}: a page and the number of all pairs."""
    rows = [r.asDict(recursive=True) for r in page(pairs, offset, limit).collect()]
    return {"total": pairs.count(), "offset": max(0, offset), "limit": max(1, limit), "rows": rows}


def document(pairs: DataFrame, score: DataFrame, threshold: float, at: datetime, metrics: DataFrame | None = None, shown: int = SHOWN) -> dict:
    """The report as one object, with its best ``shown`` pairs and the number of all; the others stay in their table."""
    s = score.first().asDict()
    first = counted_page(pairs, 0, shown)
    out = {"version": 1, "generatedAt": at.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "threshold": threshold, "grade": s["grade"], "score": s, "pairs": first["total"], "duplicates": first["rows"]}
    if metrics is not None:
        out["metrics"] = metrics.first().asDict()
    return out


def write_json(pairs: DataFrame, path: str) -> None:
    """All pairs, best first, as JSON lines below ``path``."""
    pairs.orderBy(F.desc("similarity"), "id").write.json(path)


def as_json(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2)


def _head(code: str, lines: int = 15) -> str:
    parts = code.split("\n")
    shown = "\n".join(f"  {i:>3} | {x}" for i, x in enumerate(parts[:lines], 1))
    return shown + (f"\n  ... | ({len(parts) - lines} more lines)" if len(parts) > lines else "")


def as_text(report: dict) -> str:
    s = report["score"]
    out = [f"Score {s['score']:.2f}% ({s['grade']})", f"{s['duplicate_lines']:,} of {s['total_lines']:,} lines in {s['duplicate_groups']:,} pairs", ""]
    for n, p in enumerate(report["duplicates"], 1):
        out.append(f"[{n}] {p['similarity'] * 100:.1f}% {p['unit_type']}")
        for side in ("left", "right"):
            m = p[side]
            out += [f"  {m['file_path']}:{m['start_line']}-{m['end_line']} {m['name']}", _head(m["code"])]
        out.append("")
    more = report.get("pairs", 0) - len(report["duplicates"])
    return "\n".join(out + [f"... and {more:,} more pairs"] * (more > 0))


def as_html(report: dict, shown: int = SHOWN) -> str:
    rows = "".join(f"<tr><td>{p['similarity'] * 100:.1f}%</td>" + "".join(f"<td><code>{html.escape(p[s]['file_path'])}:{p[s]['start_line']}</code><pre>{html.escape(p[s]['code'])}</pre></td>" for s in ("left", "right")) + "</tr>" for p in report["duplicates"][:shown])
    s = report["score"]
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Duplicates</title></head><body><h1>{s['grade']}: {s['score']:.2f}%</h1><p>{report.get('pairs', len(report['duplicates']))} pairs, {min(shown, len(report['duplicates']))} shown</p><table>{rows}</table></body></html>"

"""Sinks: JSON lines, CSV, canonical JSON with checksums, reports, figures."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources import store


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines with sorted fields; nulls are kept. An existing folder is an error unless it is to be overwritten."""
    df.select(*sorted(df.columns)).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, files: int = 1, overwrite: bool = False) -> None:
    """CSV with a header; columns sorted unless given, nested values as JSON text, nulls empty. Reports are small: one file."""
    nested = {n for n, t in df.dtypes if t.startswith(("array", "map", "struct", "variant"))}
    shown = [F.to_json(c).alias(c) if c in nested else F.col(c) for c in (columns or sorted(df.columns))]
    df.select(*shown).coalesce(files).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def canonical_json(value: Any) -> bytes:
    """Sorted keys, two spaces, a line feed at the end: equal values are equal bytes."""
    return (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()


def write_json(value: Any, path: str, sidecar: bool = False) -> str:
    """A small result as canonical JSON; returns its SHA-256, which ``sidecar`` also puts beside it."""
    raw = canonical_json(value)
    digest = hashlib.sha256(raw).hexdigest()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(raw)
    if sidecar:
        Path(f"{path}.sha256").write_text(f"{digest}  {Path(path).name}\n", encoding="utf-8")
    return digest


def put_json(spark: SparkSession, value: Any, path: str) -> str:
    """As :func:`write_json`, to any store that Spark reaches."""
    raw = canonical_json(value)
    store.write_bytes(spark, path, raw)
    return hashlib.sha256(raw).hexdigest()


def fresh_directory(path: str) -> Path:
    """A new folder; one that exists is never written over."""
    made = Path(path)
    made.mkdir(parents=True, exist_ok=False)
    return made


def percent(v: float | None) -> str:
    return "n/a" if v is None else f"{100 * v:.1f}%"


def points(v: float | None) -> str:
    return "n/a" if v is None else f"{100 * v:+.1f} pp"


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None, most: int = 500) -> str:
    """A small result as a Markdown table; more rows than ``most`` is an error, not a cut."""
    names = list(columns or df.columns)
    rows = df.select(*names).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]) + "\n"


def frontier_svg(rows: Sequence[dict], title: str, x: str = "mean_latency_ms", y: str = "mean_rr", names: tuple[str, str] = ("Mean latency (ms)", "Mean reliance retention"), size: tuple[int, int] = (900, 540), margin: int = 70) -> str:
    """A scatter plot of a few points (method, budget and two measures): both axes with their ends and names, y upwards, a colour for each method; points without a value are left out."""
    width, height = size
    shown = [r for r in rows if r.get(x) is not None and r.get(y) is not None]
    text = lambda at, down, what, more="": f'<text x="{at:.1f}" y="{down:.1f}" font-family="sans-serif" font-size="12"{more}>{escape(str(what))}</text>'
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">', '<rect width="100%" height="100%" fill="white"/>', text(width / 2, 30, title, ' text-anchor="middle"')]
    if not shown:
        return "".join([*parts, text(width / 2, height / 2, "no points", ' text-anchor="middle"'), "</svg>"])

    def scale(name: str, low: float, high: float):
        values = [float(r[name]) for r in shown]
        a, b = min(values), max(values)
        return a, b, lambda v: low + (float(v) - a) / ((b - a) or 1.0) * (high - low)

    left, right, at_x = scale(x, margin, width - margin)
    low, top, at_y = scale(y, height - margin, margin)
    axis = lambda x1, y1, x2, y2: f'<line x1="{x1}" y1="{y1}" x2="{x2}" y2="{y2}" stroke="black"/>'
    parts += [axis(margin, height - margin, width - margin, height - margin), axis(margin, margin, margin, height - margin)]
    parts += [text(width / 2, height - 20, names[0], ' text-anchor="middle"'), text(20, height / 2, names[1], f' text-anchor="middle" transform="rotate(-90 20 {height / 2:.0f})"')]
    parts += [text(margin, height - margin + 20, f"{left:.2f}"), text(width - margin, height - margin + 20, f"{right:.2f}", ' text-anchor="end"'), text(margin - 8, height - margin, f"{low:.2f}", ' text-anchor="end"'), text(margin - 8, margin, f"{top:.2f}", ' text-anchor="end"')]
    methods = sorted({str(r.get("method", "")) for r in shown})
    for r in shown:
        hue = 360 * methods.index(str(r.get("method", ""))) // len(methods)
        label = ":".join(str(r[k]) for k in ("method", "budget") if r.get(k) is not None)
        parts.append(f'<circle cx="{at_x(r[x]):.1f}" cy="{at_y(r[y]):.1f}" r="6" fill="hsl({hue} 60% 45%)"/>' + text(at_x(r[x]) + 9, at_y(r[y]) - 7, label))
    return "".join([*parts, "</svg>"])


def write_report(folder: str, tables: dict[str, DataFrame], title: str) -> list[str]:
    """Every table as CSV and one Markdown file over all; returns what was written."""
    root = fresh_directory(folder)
    parts, written = [f"# {title}\n"], []
    for name, df in tables.items():
        write_csv(df, str(root / name))
        parts.append(f"## {name}\n\n{markdown_table(df)}")
        written.append(name)
    (root / "report.md").write_text("\n".join(parts), encoding="utf-8")
    return [*written, "report.md"]

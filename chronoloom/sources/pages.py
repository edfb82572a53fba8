"""Pages and figures from small frames: a browser holds what they show, so the driver can too."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

#: Rows that a page takes at most; more are an error, not a cut.
ROWS = 50_000


def payload(frames: dict[str, DataFrame], rows: int = ROWS) -> str:
    """{"name": [rows]} as JSON that is safe within a script element."""
    data = {}
    for name, df in frames.items():
        found = df.limit(rows + 1).collect()
        if len(found) > rows:
            raise ValueError(f"{name} has more than {rows} rows; a page needs a summary")
        data[name] = [r.asDict(recursive=True) for r in found]
    return json.dumps(data, ensure_ascii=False, default=str).replace("</", "<\\/")


def page(template: str, frames: dict[str, DataFrame]) -> str:
    """The template with __DATA__ replaced."""
    return template.replace("__DATA__", payload(frames))


def scaled(value: float, low: float, high: float, start: float, end: float) -> float:
    return start if high == low else start + (end - start) * (value - low) / (high - low)


def line_figure(df: DataFrame, x: str, y: str, width: int = 640, height: int = 240, margin: int = 30) -> str:
    """An inline SVG with one line."""
    found = df.select(x, y).dropna().limit(ROWS + 1).collect()
    if len(found) > ROWS:
        raise ValueError(f"a figure has more than {ROWS} points; it needs a summary")
    points = sorted((float(r[x]), float(r[y])) for r in found)
    if not points:
        return f'<svg viewBox="0 0 {width} {height}"></svg>'
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    path = " ".join(f"{scaled(a, min(xs), max(xs), margin, width - margin):.1f},{scaled(b, min(ys), max(ys), height - margin, margin):.1f}" for a, b in points)
    return f'<svg viewBox="0 0 {width} {height}"><polyline fill="none" stroke="currentColor" points="{path}"/></svg>'

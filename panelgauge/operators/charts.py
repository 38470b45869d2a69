"""Standalone SVG of result tables: coefficient bars, decision-study lines, coverage heat maps. Each takes bounded, collected rows."""

from __future__ import annotations

from html import escape

from ..spec import SpecError

MAX_MARKS = 2000
_SHADES = ("#f2f2f2", "#1f4e79")  # least and most coverage


def _checked(rows: list[dict]) -> list[dict]:
    if len(rows) > MAX_MARKS:
        raise SpecError(f"a chart takes at most {MAX_MARKS} rows")
    return rows


def _svg(width: int, height: int, body: str, label: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" role="img" aria-label="{escape(label)}" font-family="sans-serif" font-size="11">{body}</svg>'


def bars(rows: list[dict], name: str, value: str = "Erho2", lower: str | None = None, upper: str | None = None) -> str:
    """One bar per row from 0 to 1, with its interval where there is one."""
    out = []
    for i, r in enumerate(_checked(rows)):
        y, v = 20 * i + 4, r[value]
        out.append(f'<text x="0" y="{y + 10}">{escape(str(r[name]))}</text>')
        if v is None:
            out.append(f'<text x="160" y="{y + 10}">not available</text>')
            continue
        out.append(f'<rect x="160" y="{y}" width="{300 * min(1.0, max(0.0, v)):.1f}" height="12" fill="{_SHADES[1]}"/><text x="470" y="{y + 10}">{v:.3f}</text>')
        if lower and upper and r.get(lower) is not None and r.get(upper) is not None:
            a, b = 160 + 300 * max(0.0, r[lower]), 160 + 300 * min(1.0, r[upper])
            out.append(f'<line x1="{a:.1f}" x2="{b:.1f}" y1="{y + 6}" y2="{y + 6}" stroke="black"/>')
    return _svg(520, 20 * len(rows) + 8, "".join(out), value)


def lines(rows: list[dict], x: str, value: str = "Erho2", by: str | None = None) -> str:
    """A decision study: the coefficient against one facet's count, one line for each value of another column."""
    groups: dict = {}
    for r in _checked(rows):
        if r[value] is not None:
            groups.setdefault(r[by] if by else "", []).append((r[x], r[value]))
    top = max((p[0] for g in groups.values() for p in g), default=1)
    at = lambda p: f"{40 + 380 * p[0] / top:.1f},{210 - 200 * min(1.0, max(0.0, p[1])):.1f}"
    out = ['<line x1="40" x2="420" y1="210" y2="210" stroke="black"/><line x1="40" x2="40" y1="10" y2="210" stroke="black"/>', f'<text x="200" y="228">{escape(x)}</text><text x="0" y="14">1</text><text x="0" y="214">0</text>']
    for k, (g, points) in enumerate(sorted(groups.items(), key=lambda kv: str(kv[0]))):
        dash = "" if not k else f' stroke-dasharray="{2 + 2 * k},3"'
        points.sort()
        out.append(f'<polyline points="{" ".join(map(at, points))}" fill="none" stroke="{_SHADES[1]}"{dash}/><text x="426" y="{20 + 14 * k}">{escape(str(g))}</text>')
    return _svg(520, 236, "".join(out), value)


def heat_map(rows: list[dict], row: str, column: str, value: str = "coverage") -> str:
    """Coverage of each category (column) within the groups of each variable (row), from 0 to 1."""
    _checked(rows)
    ys, xs = sorted({str(r[row]) for r in rows}), sorted({str(r[column]) for r in rows})
    known = {(str(r[row]), str(r[column])): r[value] for r in rows}
    out = [f'<text x="{130 + 60 * j}" y="12">{escape(x)}</text>' for j, x in enumerate(xs)]
    for i, y in enumerate(ys):
        out.append(f'<text x="0" y="{34 + 22 * i}">{escape(y)}</text>')
        for j, x in enumerate(xs):
            v = known.get((y, x)) or 0.0
            out.append(f'<rect x="{130 + 60 * j}" y="{20 + 22 * i}" width="56" height="18" fill="{_SHADES[1]}" fill-opacity="{max(0.05, min(1.0, v)):.2f}"/><text x="{140 + 60 * j}" y="{33 + 22 * i}">{v:.2f}</text>')
    return _svg(140 + 60 * len(xs), 28 + 22 * len(ys), "".join(out), value)

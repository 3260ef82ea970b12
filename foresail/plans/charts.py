"""Line charts of score tables as SVG text: no plotting library is needed, and a report can hold them beside its tables."""

from __future__ import annotations

from html import escape

WIDTH, HEIGHT, LEFT, TOP = 640, 320, 56, 28
# Line colours that stay apart for readers who do not tell red from green.
COLOURS = ("#0072b2", "#d55e00", "#009e73", "#cc79a7", "#e69f00", "#56b4e9", "#000000")


def _steps(lo: float, hi: float, n: int = 5) -> list[float]:
    return [lo + (hi - lo) * k / (n - 1) for k in range(n)]


def line_chart(title: str, lines: dict[str, list[tuple[float, float]]], x_name: str, y_name: str, level: float | None = None) -> str:
    """An SVG of named lines of (x, y), with a dashed line at ``level`` if there is one. Without points it says so."""
    points = [p for line in lines.values() for p in line if p[1] is not None]
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT + 20 * -(-len(lines) // 3)}" font-family="sans-serif" font-size="12">', f'<text x="{LEFT}" y="18" font-size="14">{escape(title)}</text>']
    if not points:
        return "\n".join([*out, f'<text x="{LEFT}" y="60">no data</text>', "</svg>"])
    xs, ys = [p[0] for p in points], [p[1] for p in points] + ([level] if level is not None else [])
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    x1, y1 = (x1 if x1 > x0 else x0 + 1), (y1 if y1 > y0 else y0 + 1)
    right, bottom = WIDTH - 12, HEIGHT - 40

    def at(x: float, y: float) -> str:
        return f"{LEFT + (x - x0) / (x1 - x0) * (right - LEFT):.1f},{bottom - (y - y0) / (y1 - y0) * (bottom - TOP):.1f}"

    for y in _steps(y0, y1):
        px = at(x0, y).split(",")[1]
        out += [f'<line x1="{LEFT}" x2="{right}" y1="{px}" y2="{px}" stroke="#ddd"/>', f'<text x="{LEFT - 6}" y="{px}" text-anchor="end">{y:.3g}</text>']
    for x in sorted({round(v) for v in _steps(x0, x1)}):
        out.append(f'<text x="{at(x, y0).split(",")[0]}" y="{bottom + 16}" text-anchor="middle">{x:g}</text>')
    out += [f'<text x="{(LEFT + right) / 2}" y="{bottom + 34}" text-anchor="middle">{escape(x_name)}</text>', f'<text x="4" y="{TOP}">{escape(y_name)}</text>']
    if level is not None:
        a, b = at(x0, level), at(x1, level)
        out.append(f'<polyline points="{a} {b}" fill="none" stroke="#888" stroke-dasharray="4 4"/>')
    for k, (name, line) in enumerate(lines.items()):
        colour = COLOURS[k % len(COLOURS)]
        path = " ".join(at(x, y) for x, y in sorted(p for p in line if p[1] is not None))
        out.append(f'<polyline points="{path}" fill="none" stroke="{colour}" stroke-width="2"/>')
        out.append(f'<text x="{LEFT + (k % 3) * 190}" y="{HEIGHT + 12 + 20 * (k // 3)}" fill="{colour}">{escape(name)}</text>')
    return "\n".join([*out, "</svg>"])

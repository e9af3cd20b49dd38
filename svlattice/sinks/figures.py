"""Figures as SVG text: a donut of types, bars, and sets with their intersections. They take small tables, already collected."""

from __future__ import annotations

import math
from html import escape

PALETTE = ("#4c72b0", "#dd8452", "#55a868", "#c44e52", "#8172b3", "#937860", "#da8bc3", "#8c8c8c")


def _page(width: float, height: float, parts: list[str]) -> str:
    style = "<style>text{font-family:sans-serif;font-size:12px}.t{font-size:16px}.n{fill:#666;font-size:10px}</style>"
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}" width="{width:g}" height="{height:g}">{style}<rect width="100%" height="100%" fill="#fff"/>{"".join(parts)}</svg>\n'


def _text(x: float, y: float, value: object, anchor: str = "start", kind: str = "", turn: float = 0) -> str:
    turned = f' transform="rotate({turn:g} {x:.1f} {y:.1f})"' if turn else ""
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" class="{kind}"{turned}>{escape(str(value))}</text>'


def _bar(x: float, y: float, width: float, height: float, color: str) -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{width:.1f}" height="{height:.1f}" fill="{color}"/>'


def donut(title: str, counts: list[tuple[str, int]]) -> str:
    """A ring of shares with the total inside; entries of 0 are left out."""
    counts = [(k, n) for k, n in counts if n > 0]
    total = sum(n for _, n in counts)
    parts, at, mid, out, inn = [_text(230, 28, title, "middle", "t"), _text(230, 236, f"{total:,}", "middle", "t")], 0.0, 230, 150, 90
    for i, (name, n) in enumerate(counts):
        share, color = n / total, PALETTE[i % len(PALETTE)]
        if len(counts) == 1:
            parts.append(f'<circle cx="{mid}" cy="{mid}" r="{(out + inn) / 2}" fill="none" stroke="{color}" stroke-width="{out - inn}"/>')
        else:
            a, b = (2 * math.pi * x - math.pi / 2 for x in (at, at + share))
            (ax, ay), (bx, by) = ((math.cos(x), math.sin(x)) for x in (a, b))
            large = int(share > 0.5)
            parts.append(
                f'<path fill="{color}" d="M{mid + out * ax:.2f} {mid + out * ay:.2f}A{out} {out} 0 {large} 1 {mid + out * bx:.2f} {mid + out * by:.2f}'
                f'L{mid + inn * bx:.2f} {mid + inn * by:.2f}A{inn} {inn} 0 {large} 0 {mid + inn * ax:.2f} {mid + inn * ay:.2f}Z"/>'
            )
        at += share
        parts += [_bar(420, 100 + 24 * i, 14, 14, color), _text(442, 112 + 24 * i, f"{name}: {n:,} ({100 * share:.1f}%)")]
    return _page(640, 410, parts)


def bars(title: str, values: list[tuple[str, float]], unit: str = "") -> str:
    """Upright bars in the given order with their numbers."""
    step, high = 30, 240
    most = max((v for _, v in values), default=0) or 1
    parts = [_text(50 + step * len(values) / 2, 26, title, "middle", "t"), _text(16, 60 + high / 2, unit, "middle", "", -90)]
    for i, (name, v) in enumerate(values):
        tall, x = high * v / most, 40 + step * i
        parts += [_bar(x, 60 + high - tall, step * 0.7, tall, PALETTE[0]), _text(x + 10, 56 + high - tall, f"{v:g}", "middle", "n"), _text(x + 14, 74 + high, name, "end", "", -45)]
    return _page(80 + step * max(len(values), 8), 400, parts)


def upset(totals: list[tuple[str, int]], intersections: list[tuple[list[str], int]]) -> str:
    """Sets with their totals as rows, their intersections with their sizes as columns of dots."""
    left, top, row, column = 330, 200, 24, 22
    widest, tallest = (max((n for _, n in x), default=0) or 1 for x in (totals, intersections))
    parts, place = [], {}
    for i, (name, n) in enumerate(totals):
        y = top + 20 + row * i
        place[name] = y
        parts += [_bar(150 - 130 * n / widest, y - 7, 130 * n / widest, 14, PALETTE[0]), _text(156, y + 4, f"{name} ({n})")]
    for j, (names, n) in enumerate(intersections):
        x, tall = left + column * j, 150 * n / tallest
        held = sorted(place[name] for name in names if name in place)
        parts += [_bar(x - 6, top - tall, 12, tall, PALETTE[1]), _text(x, top - tall - 4, n, "middle", "n")]
        parts += [f'<circle cx="{x}" cy="{y}" r="5" fill="{"#333" if y in held else "#ddd"}"/>' for y in place.values()]
        if len(held) > 1:
            parts.append(f'<line x1="{x}" x2="{x}" y1="{held[0]}" y2="{held[-1]}" stroke="#333" stroke-width="2"/>')
    return _page(left + column * len(intersections) + 30, top + row * len(totals) + 40, parts)

"""Candlestick patterns: boolean conditions on the current and up to four earlier bars, giving -100, 0 or 100.

Conditions use these names, with k bars back as a suffix 0..4: o, h, l, c (bar), b (signed body), ab (body size),
r (range), us / ls (upper / lower shadow), top / bot (body ends), ma (mean body of the ten bars before).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.operators.ordered import Panel

DEPTH = 5
MEAN_BODY = 10

_LONG = {k: f"ab{k} > ma{k}" for k in range(DEPTH)}
_SHORT = {k: f"ab{k} < ma{k}" for k in range(DEPTH)}
_DOJI = {k: f"(r{k} > 0 AND ab{k} <= 0.1 * r{k})" for k in range(DEPTH)}
_INSIDE = "top{0} < top{1} AND bot{0} > bot{1}"


def _flip(cond: str) -> str:
    """The bearish mirror of a bullish condition: prices change sign, highs and lows swap."""
    import re

    swap = {"h": "l", "l": "h", "top": "bot", "bot": "top", "us": "ls", "ls": "us"}

    def mirror(m):
        name, k = m.group(1), m.group(2)
        if name in ("ab", "r", "ma"):
            return m.group(0)
        return f"(-{swap.get(name, name)}{k})" if name not in ("us", "ls") else f"{swap[name]}{k}"

    return re.sub(r"\b(ab|ma|top|bot|us|ls|o|h|l|c|b|r)(\d)\b", mirror, cond)


_STAR = "b2 < 0 AND {long2} AND top1 < bot2 AND b0 > 0 AND c0 > c2 + 0.3 * ab2".format(long2=_LONG[2])

# name -> (bullish condition or None, bearish condition or None); "mirror" flips the bullish one.
PATTERNS: dict[str, tuple[str | None, str | None]] = {
    "two_crows": (None, f"b2 > 0 AND {_LONG[2]} AND b1 < 0 AND bot1 > c2 AND b0 < 0 AND o0 < o1 AND o0 > c1 AND c0 > o2 AND c0 < c2"),
    "three_black_crows": (None, "b2 < 0 AND b1 < 0 AND b0 < 0 AND c1 < c2 AND c0 < c1 AND o1 < o2 AND o1 > c2 AND o0 < o1 AND o0 > c1 AND ls2 < 0.3 * ab2 AND ls1 < 0.3 * ab1 AND ls0 < 0.3 * ab0"),
    "three_inside": (f"b2 < 0 AND {_LONG[2]} AND {_INSIDE.format(1, 2)} AND b0 > 0 AND c0 > o2", "mirror"),
    "three_line_strike": ("b3 > 0 AND b2 > 0 AND b1 > 0 AND c2 > c3 AND c1 > c2 AND b0 < 0 AND o0 > c1 AND c0 < o3", "mirror"),
    "three_outside": ("b2 < 0 AND b1 > 0 AND c1 > o2 AND o1 < c2 AND b0 > 0 AND c0 > c1", "mirror"),
    "three_stars_in_south": (f"b2 < 0 AND {_LONG[2]} AND ls2 > ab2 AND b1 < 0 AND ab1 < ab2 AND l1 > l2 AND o1 <= h2 AND b0 < 0 AND {_SHORT[0]} AND h0 < h1 AND l0 > l1", None),
    "three_white_soldiers": ("b2 > 0 AND b1 > 0 AND b0 > 0 AND c1 > c2 AND c0 > c1 AND o1 > o2 AND o1 < c2 AND o0 > o1 AND o0 < c1 AND us2 < 0.3 * ab2 AND us1 < 0.3 * ab1 AND us0 < 0.3 * ab0", None),
    "abandoned_baby": (f"b2 < 0 AND {_LONG[2]} AND {_DOJI[1]} AND h1 < l2 AND b0 > 0 AND l0 > h1 AND c0 > c2 + 0.3 * ab2", "mirror"),
    "advance_block": (None, "b2 > 0 AND b1 > 0 AND b0 > 0 AND c1 > c2 AND c0 > c1 AND o1 > o2 AND o1 <= c2 AND o0 > o1 AND o0 <= c1 AND ab1 < ab2 AND ab0 < ab1 AND us0 > us1"),
    "belt_hold": (f"b0 > 0 AND {_LONG[0]} AND ls0 < 0.05 * r0", "mirror"),
    "breakaway": (f"b4 < 0 AND {_LONG[4]} AND b3 < 0 AND top3 < bot4 AND h2 < h3 AND l2 < l3 AND b1 < 0 AND h1 < h2 AND l1 < l2 AND b0 > 0 AND c0 > o3 AND c0 < c4", "mirror"),
    "closing_marubozu": (f"b0 > 0 AND {_LONG[0]} AND us0 < 0.05 * r0", "mirror"),
    "concealing_baby_swallow": ("b3 < 0 AND us3 < 0.05 * r3 AND ls3 < 0.05 * r3 AND b2 < 0 AND us2 < 0.05 * r2 AND ls2 < 0.05 * r2 AND b1 < 0 AND top1 < bot2 AND us1 > 0.1 * r1 AND h1 > c2 AND b0 < 0 AND h0 > h1 AND l0 < l1", None),
    "counterattack": (f"b1 < 0 AND {_LONG[1]} AND b0 > 0 AND {_LONG[0]} AND abs(c0 - c1) <= 0.05 * r1", "mirror"),
    "dark_cloud_cover": (None, f"b1 > 0 AND {_LONG[1]} AND b0 < 0 AND o0 > h1 AND c0 > o1 AND c0 < c1 - 0.5 * ab1"),
    "doji": (_DOJI[0], None),
    "doji_star": (f"b1 < 0 AND {_LONG[1]} AND {_DOJI[0]} AND top0 < bot1", "mirror"),
    "dragonfly_doji": (f"{_DOJI[0]} AND us0 < 0.1 * r0 AND ls0 > 0.1 * r0", None),
    "engulfing": ("b1 < 0 AND b0 > 0 AND c0 >= o1 AND o0 <= c1 AND ab0 > ab1", "mirror"),
    "evening_doji_star": (None, _flip(f"{_STAR} AND {_DOJI[1]}")),
    "evening_star": (None, _flip(f"{_STAR} AND {_SHORT[1]}")),
    "gap_side_by_side_white": ("b1 > 0 AND b0 > 0 AND bot1 > top2 AND bot0 > top2 AND abs(ab0 - ab1) <= 0.2 * ab1 AND abs(o0 - o1) <= 0.05 * r1",
                               "b1 > 0 AND b0 > 0 AND top1 < bot2 AND top0 < bot2 AND abs(ab0 - ab1) <= 0.2 * ab1 AND abs(o0 - o1) <= 0.05 * r1"),
    "gravestone_doji": (f"{_DOJI[0]} AND ls0 < 0.1 * r0 AND us0 > 0.1 * r0", None),
    "hammer": (f"{_SHORT[0]} AND ls0 > 2 * ab0 AND us0 < 0.1 * r0 AND bot0 <= l1 + 0.2 * r1", None),
    "hanging_man": (None, f"{_SHORT[0]} AND ls0 > 2 * ab0 AND us0 < 0.1 * r0 AND bot0 >= h1 - 0.2 * r1"),
    "harami": (f"b1 < 0 AND {_LONG[1]} AND {_SHORT[0]} AND {_INSIDE.format(0, 1)}", "mirror"),
    "harami_cross": (f"b1 < 0 AND {_LONG[1]} AND {_DOJI[0]} AND {_INSIDE.format(0, 1)}", "mirror"),
    "high_wave": (f"b0 >= 0 AND {_SHORT[0]} AND us0 > 2 * ab0 AND ls0 > 2 * ab0", f"b0 < 0 AND {_SHORT[0]} AND us0 > 2 * ab0 AND ls0 > 2 * ab0"),
    "hikkake": ("h1 < h2 AND l1 > l2 AND h0 < h1 AND l0 < l1", "mirror"),
    "hikkake_modified": ("h2 < h3 AND l2 > l3 AND h1 < h2 AND l1 > l2 AND c2 <= l2 + 0.2 * r2 AND h0 < h1 AND l0 < l1", "mirror"),
    "homing_pigeon": (f"b1 < 0 AND {_LONG[1]} AND b0 < 0 AND {_SHORT[0]} AND {_INSIDE.format(0, 1)}", None),
    "identical_three_crows": (None, "b2 < 0 AND b1 < 0 AND b0 < 0 AND c1 < c2 AND c0 < c1 AND abs(o1 - c2) <= 0.05 * r2 AND abs(o0 - c1) <= 0.05 * r1"),
    "in_neck": (None, f"b1 < 0 AND {_LONG[1]} AND b0 > 0 AND o0 < l1 AND c0 >= c1 AND c0 <= c1 + 0.05 * r1"),
    "inverted_hammer": (f"{_SHORT[0]} AND us0 > 2 * ab0 AND ls0 < 0.1 * r0 AND top0 < bot1", None),
    "kicking": ("b1 < 0 AND us1 < 0.05 * r1 AND ls1 < 0.05 * r1 AND b0 > 0 AND us0 < 0.05 * r0 AND ls0 < 0.05 * r0 AND l0 > h1", "mirror"),
    "kicking_by_length": ("b1 < 0 AND us1 < 0.05 * r1 AND ls1 < 0.05 * r1 AND b0 > 0 AND us0 < 0.05 * r0 AND ls0 < 0.05 * r0 AND l0 > h1 AND ab0 > ab1", "mirror"),
    "ladder_bottom": ("b4 < 0 AND b3 < 0 AND b2 < 0 AND o3 < o4 AND o2 < o3 AND c3 < c4 AND c2 < c3 AND b1 < 0 AND us1 > 0.1 * r1 AND b0 > 0 AND o0 > o1 AND c0 > h1", None),
    "long_legged_doji": (f"{_DOJI[0]} AND (us0 > ab0 OR ls0 > ab0)", None),
    "long_line": (f"b0 > 0 AND {_LONG[0]} AND us0 < ab0 AND ls0 < ab0", f"b0 < 0 AND {_LONG[0]} AND us0 < ab0 AND ls0 < ab0"),
    "marubozu": (f"b0 > 0 AND {_LONG[0]} AND us0 < 0.05 * r0 AND ls0 < 0.05 * r0", f"b0 < 0 AND {_LONG[0]} AND us0 < 0.05 * r0 AND ls0 < 0.05 * r0"),
    "matching_low": ("b1 < 0 AND b0 < 0 AND abs(c0 - c1) <= 0.05 * r1", None),
    "mat_hold": (f"b4 > 0 AND {_LONG[4]} AND {_SHORT[3]} AND {_SHORT[2]} AND {_SHORT[1]} AND b3 < 0 AND bot3 > top4 AND bot2 < top4 AND bot2 > o4 AND bot1 > o4 AND top2 < top3 AND top1 < top2 AND b0 > 0 AND o0 > c1 AND c0 > h3 AND c0 > h2 AND c0 > h1", None),
    "morning_doji_star": (f"{_STAR} AND {_DOJI[1]}", None),
    "morning_star": (f"{_STAR} AND {_SHORT[1]}", None),
    "on_neck": (None, f"b1 < 0 AND {_LONG[1]} AND b0 > 0 AND o0 < l1 AND abs(c0 - l1) <= 0.05 * r1"),
    "piercing": (f"b1 < 0 AND {_LONG[1]} AND b0 > 0 AND o0 < l1 AND c0 < o1 AND c0 > c1 + 0.5 * ab1", None),
    "rickshaw_man": (f"{_DOJI[0]} AND us0 > ab0 AND ls0 > ab0 AND abs((top0 + bot0) / 2 - (h0 + l0) / 2) < 0.1 * r0", None),
    "rise_fall_three_methods": (f"b4 > 0 AND {_LONG[4]} AND b3 < 0 AND b2 < 0 AND b1 < 0 AND {_SHORT[3]} AND {_SHORT[2]} AND {_SHORT[1]} AND h3 < h4 AND l1 > l4 AND c2 < c3 AND c1 < c2 AND b0 > 0 AND {_LONG[0]} AND o0 > c1 AND c0 > c4", "mirror"),
    "separating_lines": (f"b1 < 0 AND b0 > 0 AND {_LONG[0]} AND abs(o0 - o1) <= 0.05 * r1 AND ls0 < 0.05 * r0", "mirror"),
    "shooting_star": (None, f"{_SHORT[0]} AND us0 > 2 * ab0 AND ls0 < 0.1 * r0 AND bot0 > top1"),
    "short_line": (f"b0 > 0 AND {_SHORT[0]} AND us0 < ab0 AND ls0 < ab0", f"b0 < 0 AND {_SHORT[0]} AND us0 < ab0 AND ls0 < ab0"),
    "spinning_top": (f"b0 >= 0 AND {_SHORT[0]} AND us0 > ab0 AND ls0 > ab0", f"b0 < 0 AND {_SHORT[0]} AND us0 > ab0 AND ls0 > ab0"),
    "stalled": (None, f"b2 > 0 AND {_LONG[2]} AND b1 > 0 AND {_LONG[1]} AND c1 > c2 AND us1 < 0.1 * r1 AND o1 > o2 AND b0 > 0 AND {_SHORT[0]} AND c0 > c1 AND o0 >= c1 - ab0 - 0.2 * r1"),
    "stick_sandwich": ("b2 < 0 AND b1 > 0 AND l1 > c2 AND b0 < 0 AND abs(c0 - c2) <= 0.05 * r2", None),
    "takuri": (f"{_DOJI[0]} AND us0 < 0.1 * r0 AND ls0 > 3 * ab0", None),
    "tasuki_gap": ("b2 > 0 AND b1 > 0 AND bot1 > top2 AND b0 < 0 AND o0 < c1 AND o0 > o1 AND c0 < o1 AND c0 > c2", "mirror"),
    "thrusting": (None, f"b1 < 0 AND {_LONG[1]} AND b0 > 0 AND o0 < l1 AND c0 > c1 + 0.05 * r1 AND c0 <= c1 + 0.5 * ab1"),
    "tristar": (f"{_DOJI[2]} AND {_DOJI[1]} AND {_DOJI[0]} AND top1 < bot2 AND bot0 > bot1", "mirror"),
    "unique_three_river": (f"b2 < 0 AND {_LONG[2]} AND b1 < 0 AND c1 > c2 AND o1 <= o2 AND l1 < l2 AND {_SHORT[0]} AND b0 > 0 AND o0 > l1", None),
    "upside_gap_two_crows": (None, f"b2 > 0 AND {_LONG[2]} AND b1 < 0 AND {_SHORT[1]} AND bot1 > top2 AND b0 < 0 AND o0 > o1 AND c0 < c1 AND c0 > c2"),
    "side_gap_three_methods": ("b2 > 0 AND b1 > 0 AND bot1 > top2 AND b0 < 0 AND o0 < c1 AND o0 > o1 AND c0 > o2 AND c0 < c2", "mirror"),
}


def _conditions(name: str) -> tuple[str, str]:
    bull, bear = PATTERNS[name]
    if bear == "mirror":
        bear = _flip(bull)
    return bull or "false", bear or "false"


def value_sql(name: str) -> str:
    """-100 / 0 / 100 as a CASE expression over the names above."""
    bull, bear = _conditions(name)
    return f"CASE WHEN {bull} THEN 100 WHEN {bear} THEN -100 ELSE 0 END"


def bar_names(p: Panel) -> list[str]:
    """Hidden columns o0..ma4 on the panel."""
    shape = {"o": "open", "h": "high", "l": "low", "c": "close", "b": "close - open", "ab": "abs(close - open)", "r": "high - low",
             "us": "high - greatest(open, close)", "ls": "least(open, close) - low",
             "top": "greatest(open, close)", "bot": "least(open, close)"}
    names = [*shape, "ma"]
    if "ma0" not in p.depth:
        for x, e in shape.items():
            p.temp(f"{x}0", F.expr(e))
        p.temp("ma0", F.expr(f"avg(ab0) OVER ({p.order_sql} ROWS BETWEEN {MEAN_BODY} PRECEDING AND 1 PRECEDING)"), ["ab0"], back=MEAN_BODY)
        for x in names:
            for k in range(1, DEPTH):
                p.temp(f"{x}{k}", F.expr(f"lag({x}0, {k}) OVER ({p.order_sql})"), [f"{x}0"], back=k)
    return [f"{x}{k}" for x in names for k in range(DEPTH)]


def pattern(p: Panel, name: str, out: str | None = None) -> str:
    return p.add(out or f"cdl_{name}", F.expr(value_sql(name)), bar_names(p))

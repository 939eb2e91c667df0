"""Technical indicators on open/high/low/close/volume rows.

Every function adds columns to a ``Panel``.  Finite windows and linear recurrences share the panel's one
shuffle; indicators with running totals (``obv`` and friends) are separate functions on a DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators import rolling as X
from quotemill.operators.ordered import Panel, Series, cumulative, index_rows
from quotemill.session import materialize

c = F.col


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.try_divide(a, b) * scale


def _lag(p: Panel, col: str, k: int = 1) -> str:
    return p.temp(f"_lag_{col}_{k}", F.lag(col, k).over(p.w), [col], back=k)


def _gain_loss(p: Panel, col: str) -> tuple[str, str]:
    prev = _lag(p, col)
    d = c(col) - c(prev)
    up = p.temp(f"_gain_{col}", F.coalesce(F.greatest(d, F.lit(0.0)), F.lit(0.0)), [col, prev])
    down = p.temp(f"_loss_{col}", F.coalesce(F.greatest(-d, F.lit(0.0)), F.lit(0.0)), [col, prev])
    return up, down


def ema(p: Panel, span: int, col: str = "close", out: str | None = None) -> str:
    return p.ema(out or f"ema_{span}", col, span=span)


def rsi(p: Panel, n: int = 14, col: str = "close", out: str | None = None, method: str = "simple") -> str:
    """Relative strength index from plain means, or Wilder averages seeded with the mean of n changes.

    A change to or from a missing price counts as none.  The Wilder form is 100 with gains only and 50 in a flat market.
    """
    up, down = _gain_loss(p, col)
    if method == "simple":
        a, b = p.mean(f"_up_{col}_{n}", up, n), p.mean(f"_dn_{col}_{n}", down, n)
        p.hide(a, b)
        return p.add(out or f"rsi_{n}", 100 - 100 / (1 + c(a) / (c(b) + 1e-10)), [a, b])
    a, b = p.wilder(f"_wup_{col}_{n}", up, n, n, whole=True), p.wilder(f"_wdn_{col}_{n}", down, n, n, whole=True)
    p.hide(a, b)
    moved = F.when(c(b) == 0, F.when(c(a) == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide(c(a), c(b))))
    return p.add(out or f"rsi_wilder_{n}", moved, [a, b])


def macd(p: Panel, fast: int = 12, slow: int = 26, signal: int = 9, col: str = "close", tag: str = "") -> list[str]:
    a, b = p.ema(f"_ema_{col}_{fast}", col, span=fast), p.ema(f"_ema_{col}_{slow}", col, span=slow)
    p.hide(a, b)
    line = p.add(f"macd{tag}", c(a) - c(b), [a, b])
    sig = p.ema(f"macd_signal{tag}", line, span=signal)
    return [line, sig, p.add(f"macd_hist{tag}", c(line) - c(sig), [line, sig])]


def bollinger(p: Panel, n: int = 20, k: float = 2.0, col: str = "close", ddof: int = 1) -> list[str]:
    mid = p.mean("bb_middle", col, n)
    sd = p.std(f"_bb_sd_{n}", col, n, ddof)
    p.hide(sd)
    up = p.add("bb_upper", c(mid) + k * c(sd), [mid, sd])
    lo = p.add("bb_lower", c(mid) - k * c(sd), [mid, sd])
    pb = p.add("bb_percent", ratio(c(col) - c(lo), c(up) - c(lo)), [up, lo, col])
    return [mid, up, lo, pb, p.add("bb_width", ratio(c(up) - c(lo), c(mid)), [up, lo])]


def true_range(p: Panel, out: str = "true_range") -> str:
    prev = _lag(p, "close")
    tr = F.greatest(c("high") - c("low"), F.abs(c("high") - c(prev)), F.abs(c("low") - c(prev)))
    return p.add(out, tr, [prev])


def _tr(p: Panel) -> str:
    p.hide("_tr")
    return true_range(p, "_tr")


def atr(p: Panel, n: int = 14, method: str = "simple", out: str | None = None) -> str:
    tr = _tr(p)
    if method == "simple":
        return p.mean(out or f"atr_{n}", tr, n)
    return p.wilder(out or f"atr_wilder_{n}", tr, n, start=n - 1)


def _range_of(p: Panel, n: int, high: str = "high", low: str = "low") -> tuple[str, str]:
    h, lo = p.high(f"_max_{high}_{n}", high, n), p.low(f"_min_{low}_{n}", low, n)
    p.hide(h, lo)
    return h, lo


def stochastic(p: Panel, n: int = 14, smooth: int = 3) -> list[str]:
    h, lo = _range_of(p, n)
    raw = p.temp(f"_k_{n}", ratio(c("close") - c(lo), c(h) - c(lo), 100), [h, lo])
    k = p.mean("stochastic_k", raw, smooth)
    return [k, p.mean("stochastic_d", k, 3)]


def stoch_rsi(p: Panel, n: int = 14) -> str:
    r = rsi(p, n, method="wilder", out=f"_srsi_{n}")
    p.hide(r)
    h, lo = _range_of(p, n, r, r)
    return p.add("stoch_rsi", ratio(c(r) - c(lo), c(h) - c(lo)), [r, h, lo])


def cmo(p: Panel, n: int = 14) -> str:
    up, down = _gain_loss(p, "close")
    a, b = p.total(f"_sup_{n}", up, n), p.total(f"_sdn_{n}", down, n)
    p.hide(a, b)
    return p.add("cmo", ratio(c(a) - c(b), c(a) + c(b), 100), [a, b])


def ppo(p: Panel, fast: int = 12, slow: int = 26, signal: int = 9, col: str = "close", name: str = "ppo") -> list[str]:
    """Percentage oscillator of two averages; on volume this is the PVO."""
    a, b = p.ema(f"_ema_{col}_{fast}", col, span=fast), p.ema(f"_ema_{col}_{slow}", col, span=slow)
    p.hide(a, b)
    line = p.add(name, F.coalesce(ratio(c(a) - c(b), c(b), 100), F.lit(0.0)), [a, b])
    sig = p.ema(f"{name}_signal", line, span=signal)
    return [line, sig, p.add(f"{name}_hist", c(line) - c(sig), [line, sig])]


def roc(p: Panel, n: int = 10, col: str = "close", out: str | None = None) -> str:
    prev = _lag(p, col, n)
    return p.add(out or f"roc_{n}", (F.try_divide(c(col), c(prev)) - 1) * 100, [col, prev])


def williams_r(p: Panel, n: int = 14) -> str:
    h, lo = _range_of(p, n)
    return p.add(f"willr_{n}", ratio(c(h) - c("close"), c(h) - c(lo), -100), [h, lo])


def tsi(p: Panel, fast: int = 13, slow: int = 25) -> str:
    """Twice-smoothed change over twice-smoothed absolute change."""
    prev = _lag(p, "close")
    d = p.temp("_d1", F.coalesce(c("close") - c(prev), F.lit(0.0)), [prev])
    a = p.temp("_d1abs", F.abs(c(d)), [d])
    parts = []
    for x in (d, a):
        inner = p.ema(f"_tsi_{x}_{slow}", x, span=slow, start=1)
        inner0 = p.temp(f"{inner}0", F.coalesce(c(inner), F.lit(0.0)), [inner])
        outer = p.ema(f"_tsi_{x}_{slow}_{fast}", inner0, span=fast, start=1)
        p.hide(inner, outer)
        parts.append(outer)
    return p.add("tsi", ratio(c(parts[0]), c(parts[1]), 100), parts)


def adx(p: Panel, n: int = 14) -> list[str]:
    """Directional movement with Wilder averages; ADX is the Wilder average of DX."""
    ph, pl, tr = _lag(p, "high"), _lag(p, "low"), _tr(p)
    up, down = c("high") - c(ph), c(pl) - c("low")
    plus = p.temp("_dm_plus", F.when((up > down) & (up > 0), up).otherwise(0.0), [ph, pl])
    minus = p.temp("_dm_minus", F.when((down > up) & (down > 0), down).otherwise(0.0), [ph, pl])
    sp, sm, st = (p.wilder(f"_w{x}_{n}", x, n, start=n, whole=x != tr) for x in (plus, minus, tr))
    p.hide(sp, sm, st)
    dp = p.add("di_plus", ratio(c(sp), c(st), 100), [sp, st])
    dm = p.add("di_minus", ratio(c(sm), c(st), 100), [sm, st])
    dx = p.temp("_dx", F.coalesce(ratio(F.abs(c(dp) - c(dm)), c(dp) + c(dm), 100), F.lit(0.0)), [dp, dm])
    return [p.wilder(f"adx_{n}", dx, n, start=2 * n - 1, whole=True), dp, dm]


def typical(p: Panel) -> str:
    return p.temp("_typical", (c("high") + c("low") + c("close")) / 3)


def cci(p: Panel, n: int = 20, k: float = 0.015) -> str:
    tp = typical(p)
    mu = p.mean(f"_tp_mean_{n}", tp, n)
    p.hide(mu)
    window = p.temp(f"_tp_{n}", F.collect_list(tp).over(p.rows(n)), [tp], back=n - 1)
    dev = F.aggregate(F.col(window), F.lit(0.0), lambda a, x: a + F.abs(x - c(mu))) / n
    return p.add(f"cci_{n}", ratio(c(tp) - c(mu), dev * k), [tp, mu, window])


def dpo(p: Panel, n: int = 20) -> str:
    prev, mu = _lag(p, "close", n // 2 + 1), p.mean(f"sma_{n}", "close", n)
    return p.add(f"dpo_{n}", c(prev) - c(mu), [prev, mu])


def kst(p: Panel) -> list[str]:
    parts = []
    for weight, (n, m) in enumerate(((10, 10), (15, 10), (20, 10), (30, 15)), start=1):
        r = roc(p, n, out=f"_roc_{n}")
        s = p.mean(f"_roc_{n}_{m}", r, m)
        p.hide(r, s)
        parts.append((weight, s))
    line = p.add("kst", sum((w * c(s) for w, s in parts), F.lit(0.0)), [s for _, s in parts])
    return [line, p.mean("kst_signal", line, 9)]


def ichimoku(p: Panel, a: int = 9, b: int = 26, d: int = 52) -> list[str]:
    def mid(n: int, out: str) -> str:
        h, lo = _range_of(p, n)
        return p.add(out, (c(h) + c(lo)) / 2, [h, lo])

    conv, base, slow = mid(a, "ichimoku_conversion"), mid(b, "ichimoku_base"), mid(d, "_ichimoku_slow")
    p.hide(slow)
    lead = p.temp("_ichimoku_lead", (c(conv) + c(base)) / 2, [conv, base])
    return [
        conv,
        base,
        p.lag("ichimoku_span_a", lead, b),
        p.lag("ichimoku_span_b", slow, b),
        p.lead("ichimoku_lagging", "close", b),
    ]


def vortex(p: Panel, n: int = 14) -> list[str]:
    ph, pl, tr = _lag(p, "high"), _lag(p, "low"), _tr(p)
    plus = p.temp("_vm_plus", F.abs(c("high") - c(pl)), [pl])
    minus = p.temp("_vm_minus", F.abs(c("low") - c(ph)), [ph])
    a, b, t = (p.total(f"{x}_{n}", x, n) for x in (plus, minus, tr))
    p.hide(a, b, t)
    return [p.add("vortex_plus", ratio(c(a), c(t)), [a, t]), p.add("vortex_minus", ratio(c(b), c(t)), [b, t])]


def aroon(p: Panel, n: int = 14) -> list[str]:
    """Rows since the highest high and lowest low of the last n + 1 rows; the latest row wins ties."""
    rows = p.rows(n + 1)
    full = F.count("high").over(rows) >= n + 1
    up = F.max(F.struct(c("high"), c("_i"))).over(rows)["_i"]
    down = F.max(F.struct((-c("low")).alias("low"), c("_i"))).over(rows)["_i"]
    return [
        p.add("aroon_up", F.when(full, (n - (c("_i") - up)) * 100.0 / n), back=n),
        p.add("aroon_down", F.when(full, (n - (c("_i") - down)) * 100.0 / n), back=n),
    ]


def keltner(p: Panel, n: int = 20, k: float = 2.0) -> list[str]:
    """EMA of the close plus and minus k times the EMA of the true range."""
    tr = _tr(p)
    mid, width = p.ema("keltner_middle", "close", span=n), p.ema(f"_keltner_{n}", tr, span=n)
    p.hide(width)
    return [
        mid,
        p.add("keltner_upper", c(mid) + k * c(width), [mid, width]),
        p.add("keltner_lower", c(mid) - k * c(width), [mid, width]),
    ]


def donchian(p: Panel, n: int = 20) -> list[str]:
    h, lo = p.high("donchian_high", "high", n), p.low("donchian_low", "low", n)
    return [h, lo, p.add("donchian_mid", (c(h) + c(lo)) / 2, [h, lo])]


def money_flow_multiplier() -> Column:
    """((c - l) - (h - c)) / (h - l); 0 for a bar without range."""
    return F.coalesce(F.try_divide(2 * c("close") - c("low") - c("high"), c("high") - c("low")), F.lit(0.0))


def mfi(p: Panel, n: int = 14) -> str:
    tp = typical(p)
    prev = _lag(p, tp)
    flow = c(tp) * c("volume")
    pos = p.temp("_flow_pos", F.when(c(tp) > c(prev), flow).otherwise(0.0), [tp, prev])
    neg = p.temp("_flow_neg", F.when(c(tp) < c(prev), flow).otherwise(0.0), [tp, prev])
    a, b = p.total(f"_pos_{n}", pos, n), p.total(f"_neg_{n}", neg, n)
    p.hide(a, b)
    return p.add(f"mfi_{n}", ratio(c(a), c(a) + c(b), 100), [a, b])


def cmf(p: Panel, n: int = 20) -> str:
    flow = p.temp("_mfv", money_flow_multiplier() * c("volume"))
    a, v = p.total(f"_mfv_{n}", flow, n), p.total(f"_vol_{n}", "volume", n)
    p.hide(a, v)
    return p.add(f"cmf_{n}", ratio(c(a), c(v)), [a, v])


def ease_of_movement(p: Panel, n: int = 14) -> list[str]:
    ph, pl = _lag(p, "high"), _lag(p, "low")
    move = (c("high") + c("low") - c(ph) - c(pl)) / 2
    e = p.add("eom", ratio(move * (c("high") - c("low")), c("volume"), 1e8), [ph, pl])
    return [e, p.mean(f"eom_sma_{n}", e, n, min_periods=1)]


def wma(p: Panel, n: int, col: str = "close", out: str | None = None) -> str:
    """Linearly weighted mean, newest row heaviest."""
    lags = [col] + [_lag(p, col, k) for k in range(1, n)]
    total = sum(((n - k) * c(x) for k, x in enumerate(lags)), F.lit(0.0))
    return p.add(out or f"wma_{n}", total / (n * (n + 1) / 2), lags)


def hma(p: Panel, n: int = 9, col: str = "close") -> str:
    half, full = wma(p, n // 2, col, f"_wma_{col}_{n // 2}"), wma(p, n, col, f"_wma_{col}_{n}")
    p.hide(half, full)
    raw = p.temp(f"_hull_{n}", 2 * c(half) - c(full), [half, full])
    return wma(p, int(math.sqrt(n)), raw, f"hma_{n}")


def _emas(p: Panel, col: str, n: int, depth: int) -> list[str]:
    out, x = [], col
    for k in range(1, depth + 1):
        x = p.ema(f"_e{k}_{col}_{n}", x, span=n)
        p.hide(x)
        out.append(x)
    return out


def dema(p: Panel, n: int = 10, col: str = "close") -> str:
    a, b = _emas(p, col, n, 2)
    return p.add(f"dema_{n}", 2 * c(a) - c(b), [a, b])


def tema(p: Panel, n: int = 9, col: str = "close") -> str:
    a, b, d = _emas(p, col, n, 3)
    return p.add(f"tema_{n}", 3 * c(a) - 3 * c(b) + c(d), [a, b, d])


def trix(p: Panel, n: int = 15, col: str = "close") -> str:
    d = _emas(p, col, n, 3)[-1]
    return roc(p, 1, d, f"trix_{n}")


def zlma(p: Panel, n: int = 10, col: str = "close") -> str:
    """EMA of 2x - x[(n-1)/2], starting where the lag exists."""
    k = (n - 1) // 2
    prev = _lag(p, col, k)
    raw = p.temp(f"_zl_{n}", F.coalesce(2 * c(col) - c(prev), F.lit(0.0)), [col, prev])
    return p.ema(f"zlma_{n}", raw, span=n, start=k)


def vwma(p: Panel, n: int = 20) -> str:
    return X.rolling_vwap(p, n, "close", out=f"vwma_{n}")


def pivots(p: Panel, fib: int = 20) -> list[str]:
    """Pivot of the previous bar, three supports and resistances, and the 61.8 % level of the range."""
    h, lo, cl = (_lag(p, x) for x in ("high", "low", "close"))
    pv = p.add("pivot_point", (c(h) + c(lo) + c(cl)) / 3, [h, lo, cl])
    uses, rng = [pv, h, lo], c(h) - c(lo)
    top, bottom = _range_of(p, fib)
    return [
        pv,
        p.add("resistance_1", 2 * c(pv) - c(lo), uses),
        p.add("support_1", 2 * c(pv) - c(h), uses),
        p.add("resistance_2", c(pv) + rng, uses),
        p.add("support_2", c(pv) - rng, uses),
        p.add("resistance_3", c(h) + 2 * (c(pv) - c(lo)), uses),
        p.add("support_3", c(lo) - 2 * (c(h) - c(pv)), uses),
        p.add("fib_retracement", c(top) - 0.618 * (c(top) - c(bottom)), [top, bottom]),
    ]


def doji(p: Panel, share: float = 0.1) -> str:
    return p.add("doji", F.coalesce(ratio(F.abs(c("open") - c("close")), c("high") - c("low")) < share, F.lit(False)))


def ewma_variance(p: Panel, decay: float = 0.94, out: str = "ewma_vol") -> str:
    """Exponentially weighted volatility of returns (stands in for a declared conditional-variance model)."""
    prev = _lag(p, "close")
    r = F.try_divide(c("close"), c(prev)) - 1
    sq = p.temp("_ret2", F.coalesce(r * r, F.lit(0.0)), [prev])
    v = p.ema("_ewma_var", sq, alpha=1 - decay, start=1, whole=True)
    p.hide(v)
    return p.add(out, F.sqrt(v), [v])


def mass_index(p: Panel, fast: int = 9, n: int = 25) -> str:
    rng = p.temp("_hl", c("high") - c("low"))
    a, b = _emas(p, rng, fast, 2)
    share = p.temp("_mass", ratio(c(a), c(b)), [a, b])
    return p.total("mass_index", share, n)


def ultimate_oscillator(p: Panel, a: int = 7, b: int = 14, d: int = 28) -> str:
    prev, tr = _lag(p, "close"), _tr(p)
    bp = p.temp("_bp", c("close") - F.least("low", prev), [prev])
    parts = []
    for n in (a, b, d):
        x, t = p.total(f"_bp_{n}", bp, n), p.total(f"_tr_{n}", tr, n)
        p.hide(x, t)
        parts.append(p.temp(f"_uo_{n}", ratio(c(x), c(t)), [x, t]))
    return p.add("ultimate_oscillator", 100 * (4 * c(parts[0]) + 2 * c(parts[1]) + c(parts[2])) / 7, parts)


def awesome_oscillator(p: Panel, fast: int = 5, slow: int = 34) -> str:
    mid = p.temp("_mid", (c("high") + c("low")) / 2)
    a, b = p.mean(f"_mid_{fast}", mid, fast), p.mean(f"_mid_{slow}", mid, slow)
    p.hide(a, b)
    return p.add("awesome_oscillator", c(a) - c(b), [a, b])


def ulcer_index(p: Panel, n: int = 14) -> str:
    top = p.high(f"_max_close_{n}", "close", n)
    p.hide(top)
    sq = p.temp("_ulcer2", F.pow(ratio(c("close") - c(top), c(top), 100), F.lit(2.0)), [top])
    mean = p.mean("_ulcer", sq, n)
    p.hide(mean)
    return p.add("ulcer_index", F.sqrt(mean), [mean])


def force_index(p: Panel, n: int = 13) -> str:
    prev = _lag(p, "close")
    raw = p.temp("_force", F.coalesce((c("close") - c(prev)) * c("volume"), F.lit(0.0)), [prev])
    return p.ema(f"force_index_{n}", raw, span=n, start=1)


def stc(p: Panel, fast: int = 23, slow: int = 50, n: int = 10, smooth: int = 3) -> str:
    """Schaff trend cycle: the MACD put twice through a smoothed stochastic; 0 where the window is flat."""
    a, b = p.ema(f"_ema_close_{fast}", "close", span=fast), p.ema(f"_ema_close_{slow}", "close", span=slow)
    p.hide(a, b)
    x, start = p.temp("_stc_macd", c(a) - c(b), [a, b]), 0
    for step in (1, 2):
        h, lo = _range_of(p, n, x, x)
        start += n - 1
        k = p.temp(f"_stc_k{step}", F.coalesce(ratio(c(x) - c(lo), c(h) - c(lo), 100), F.lit(0.0)), [x, h, lo])
        x = p.ema("stc" if step == 2 else "_stc_d1", k, span=smooth, start=start, whole=True)
        if step == 1:
            p.hide(x)
    return x


# -- running totals --------------------------------------------------------------------------------------


def running_totals_of_volume(df: DataFrame, s: Series, indexed: bool = False) -> DataFrame:
    """obv, accumulation/distribution, price-volume trend and negative volume index in one pass.

    Rows that come with their positions keep them.
    """
    p = Panel(df, s, indexed=indexed)
    prev, pv = p.temp("_pc", F.lag("close").over(p.w), back=1), p.temp("_pvol", F.lag("volume").over(p.w), back=1)
    ret = F.try_divide(c("close"), c(prev)) - 1  # none after a price of zero
    p.add("_obv", F.coalesce(F.signum(c("close") - c(prev)) * c("volume"), F.lit(0.0)), [prev])
    p.add("_ad", money_flow_multiplier() * c("volume"))
    p.add("_pvt", F.coalesce(ret * c("volume"), F.lit(0.0)), [prev])
    p.add("_nvi", F.coalesce(F.when(c("volume") < c(pv), F.log1p(ret)), F.lit(0.0)), [prev, pv])
    out = cumulative(p.done(keep_index=True), s, {
        "obv": ("sum", "_obv"), "ad": ("sum", "_ad"), "pvt": ("sum", "_pvt"), "_lnvi": ("sum", "_nvi")}, indexed=True)
    return out.withColumn("nvi", 1000 * F.exp("_lnvi")).drop("_obv", "_ad", "_pvt", "_nvi", "_lnvi", *([] if indexed else ["_i"]))


def ad_lines(p: Panel, fast: int = 3, slow: int = 10) -> None:
    """Fast minus slow EMA of the accumulation/distribution line ``ad``."""
    a, b = p.ema("_ad_fast", "ad", span=fast), p.ema("_ad_slow", "ad", span=slow)
    p.hide(a, b)
    p.add("ad_oscillator", c(a) - c(b), [a, b])


def ad_oscillator(df: DataFrame, s: Series, fast: int = 3, slow: int = 10) -> DataFrame:
    """The line and the difference of its averages."""
    flow = df.withColumn("_flow", money_flow_multiplier() * c("volume"))
    line = cumulative(index_rows(flow, s), s, {"ad": ("sum", "_flow")}, indexed=True).drop("_flow")
    p = Panel(line, s, indexed=True)
    ad_lines(p, fast, slow)
    return p.done()


def kama(df: DataFrame, s: Series, n: int = 10, fast: int = 2, slow: int = 30, stretch: int = 256, indexed: bool = False) -> DataFrame:
    """Adaptive average y = y' + w(x - y'), w from the efficiency ratio, seeded at row n - 1.

    A recurrence with a changing decay: the log of the decay is summed inside stretches, and the value at a
    stretch end follows from the stretches before it, as many as the slowest decay still remembers.
    """
    from pyspark.sql import Window

    p = Panel(df, s, indexed=indexed)
    prev, past = _lag(p, "close"), _lag(p, "close", n)
    step = p.temp("_step", F.abs(c("close") - c(prev)), [prev])
    noise = p.total("_noise", step, n)
    p.hide(noise)
    er = F.coalesce(F.try_divide(F.abs(c("close") - c(past)), c(noise)), F.lit(0.0))
    hi, lo = 2.0 / (fast + 1), 2.0 / (slow + 1)
    p.add("_w", F.pow(er * (hi - lo) + lo, F.lit(2.0)), [past, noise])
    d = p.done(keep_index=True)
    i, seed = c("_i"), n - 1
    decay = F.when(i <= seed, 1.0).otherwise(1 - c("_w"))
    input_ = F.when(i < seed, 0.0).when(i == seed, c("close")).otherwise(c("_w") * c("close"))
    d = d.withColumns({"_ld": F.log(decay), "_u": input_, "_st": F.floor(i / stretch)})
    here = Window.partitionBy(*s.keys, "_st").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_cd", F.sum("_ld").over(here)).withColumn(
        "_z", F.exp("_cd") * F.sum(c("_u") * F.exp(-c("_cd"))).over(here))
    ends = d.groupBy(*s.keys, c("_st").alias("_i")).agg(
        F.exp(F.max_by("_cd", "_i")).alias("_a"), F.max_by("_z", "_i").alias("_b"))
    keep = math.ceil(math.log(1e-17) / (stretch * math.log(1 - lo * lo)))
    q = Panel(ends, s, indexed=True)
    past_ends = F.collect_list(F.struct("_a", "_b")).over(q.w.rowsBetween(-keep, -1))
    q.add("_carry", F.aggregate(past_ends, F.lit(0.0), lambda y, e: y * e["_a"] + e["_b"]), back=keep)
    carry = q.done(keep_index=True).select(*s.keys, c("_i").alias("_st"), "_carry")
    out = d.join(carry, [*s.keys, "_st"])
    out = out.withColumn("kama", F.when(i >= seed, c("_z") + F.exp("_cd") * c("_carry")))
    return out.drop("_w", "_ld", "_u", "_st", "_cd", "_z", "_carry", *([] if indexed else ["_i"]))


# -- bundles ---------------------------------------------------------------------------------------------

# The columns of the baseline feature set, in order.
BASELINE_COLUMNS = [
    "returns", "log_returns", "sma_5", "sma_20", "sma_50", "volatility_20", "momentum_5", "momentum_10",
    "rsi_14", "macd", "signal", "histogram", "upper_band", "lower_band", "adx_14", "willr_14", "cci_20",
    "obv", "atr_14", "stochastic_k", "stochastic_d", "roc_10", "ema_12", "ema_26", "tema_9", "wma_10",
    "hma_9", "dema_10", "trix_15", "vwma_20", "zscore_20", "keltner_upper", "keltner_lower",
    "donchian_high", "donchian_low", "psar", "fib_retracement", "pivot_point", "support_1", "support_2",
    "support_3", "resistance_1", "resistance_2", "resistance_3", "volume_change", "volume_ma_5", "volume_ratio",
]


def baseline_panel(p: Panel) -> None:
    """Everything in the baseline set that a window or linear recurrence gives (obv and psar come apart)."""
    X.pct_change(p, out="returns")
    X.log_return(p, out="log_returns")
    for n in (5, 20, 50):
        p.mean(f"sma_{n}", "close", n)
    p.std("volatility_20", "close", 20)
    X.momentum(p, 5)
    X.momentum(p, 10)
    rsi(p)
    macd(p)
    bollinger(p)
    adx(p)
    williams_r(p)
    cci(p)
    atr(p)
    stochastic(p)
    roc(p)
    for n in (12, 26):
        ema(p, n)
    tema(p)
    wma(p, 10)
    hma(p)
    dema(p)
    trix(p)
    vwma(p)
    X.zscore(p, "close", 20, "zscore_20")
    keltner(p)
    donchian(p)
    pivots(p)
    X.pct_change(p, "volume", out="volume_change")
    X.volume_ratio(p, 5, "volume_ratio")
    for new, old in {"signal": "macd_signal", "histogram": "macd_hist", "upper_band": "bb_upper",
                     "lower_band": "bb_lower"}.items():
        p.add(new, c(old), [old])


def oscillator_panel(p: Panel) -> None:
    """The members of the full bundle that the baseline set does not have."""
    for n in (7, 14, 21):
        rsi(p, n, method="wilder")
    macd(p, 5, 35, 5, tag="_5_35_5")
    atr(p, method="wilder")
    stoch_rsi(p)
    cmo(p)
    ppo(p)
    ppo(p, col="volume", name="pvo")
    tsi(p)
    dpo(p)
    kst(p)
    ichimoku(p)
    vortex(p)
    aroon(p)
    mfi(p)
    cmf(p)
    ease_of_movement(p)
    zlma(p)
    mass_index(p)
    ultimate_oscillator(p)
    awesome_oscillator(p)
    ulcer_index(p)
    force_index(p)
    stc(p)
    ewma_variance(p)
    roc(p, 20)
    X.sma_cross(p)
    X.log_return(p)
    X.volatility(p, 20, "log_returns_1", "realized_vol")
    X.weighted_range(p)
    p.high("resistance", "high", 20)
    p.low("support", "low", 20)
    for n in (9, 21, 50):
        ema(p, n)
    doji(p)


def tick_panel(p: Panel, col: str = "price") -> list[str]:
    """SMA 20/50/200, RSI, MACD and Bollinger bands on a tick price."""
    out = [p.mean(f"sma_{n}", col, n) for n in (20, 50, 200)]
    return [*out, rsi(p, 14, col), *macd(p, col=col), *bollinger(p, col=col)[:3]]


def fallback_panel(p: Panel, windows: Sequence[int] = (5, 10, 20, 50, 100, 200)) -> None:
    """The reduced set: returns, SMA/EMA, RSI, MACD, Bollinger, volume mean, ATR, doji, engulfing."""
    from quotemill.operators.patterns import pattern

    X.pct_change(p, out="returns")
    for n in windows:
        p.mean(f"sma_{n}", "close", n)
        ema(p, n)
    rsi(p)
    macd(p)
    bollinger(p)
    p.mean("volume_ma_20", "volume", 20)
    atr(p)
    doji(p)
    pattern(p, "engulfing")


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls, NaN and infinities become 0."""
    def clean(x: str) -> Column:
        return F.when(c(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(c(x))

    return df.withColumns({x: clean(x) for x in cols})


def baseline_features(df: DataFrame, s: Series) -> DataFrame:
    """The 47 named feature columns, zero-filled; rows are put in order once."""
    from quotemill.operators.scans import parabolic_sar

    on = [*s.keys, s.ts, *s.tie]
    d = materialize(index_rows(df, s), "indexed-bars")
    d = running_totals_of_volume(d, s, indexed=True).join(parabolic_sar(d, s, indexed=True).select(*on, "psar"), on)
    p = Panel(d, s, indexed=True)
    baseline_panel(p)
    return zero_fill(p.done().select(*on, *BASELINE_COLUMNS), BASELINE_COLUMNS)


def all_indicators(df: DataFrame, s: Series) -> DataFrame:
    """Every indicator in one wide table.

    Rows are put in order once.  What is no window (running totals, the adaptive average, the two scans) is added to the
    narrow bars first; one panel then adds everything else.
    """
    from quotemill.operators.patterns import PATTERNS, pattern
    from quotemill.operators.scans import parabolic_sar, supertrend

    on = [*s.keys, s.ts, *s.tie]
    bars = materialize(index_rows(df, s), "indexed-bars")
    d = kama(running_totals_of_volume(bars, s, indexed=True), s, indexed=True)
    d = d.join(parabolic_sar(bars, s, indexed=True).select(*on, "psar"), on)
    d = d.join(supertrend(bars, s, indexed=True).select(*on, "supertrend", "supertrend_direction"), on)
    p = Panel(d, s, indexed=True)
    baseline_panel(p)
    oscillator_panel(p)
    ad_lines(p)
    for name in PATTERNS:
        pattern(p, name)
    return p.done()

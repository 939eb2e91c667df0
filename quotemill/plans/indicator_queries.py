"""Technical indicators on hourly bars; recurrences are checked against folds over the whole history."""

from pyspark.sql import functions as F

from quotemill.operators import indicators as I
from quotemill.operators.ordered import Panel
from quotemill.plans.market import BAR_SERIES, BARS, TICK_SERIES, TICKS
from quotemill.plans.registry import R, query, rounded
from quotemill.plans.rolling_queries import BW, TW, roll

BASE = BARS + f""", b AS (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
    lag(volume) OVER w AS pvol, (high + low + close) / 3 AS tp FROM bars WINDOW w AS ({BW})),
d AS (SELECT *, coalesce(greatest(close - pc, 0), 0) AS gain, coalesce(greatest(pc - close, 0), 0) AS loss,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, lag(tp) OVER ({BW}) AS ptp FROM b)"""


def r(agg: str, arg: str, n: int) -> str:
    return roll(agg, arg, n, BW)


def fold(x: str, alpha: float, start: int = 0, w: str = BW) -> str:
    return f"list_reduce(list({x}) FILTER (rn > {start}) OVER ({w}), lambda a, v: a + {alpha:.17e} * (v - a))"


def ema(x: str, span: int, start: int = 0, w: str = BW) -> str:
    return fold(x, 2 / (span + 1), start, w)


def seeded(x: str, n: int, start: int, w: str = BW) -> str:
    return f"CASE WHEN rn = {start + 1} THEN avg({x}) OVER ({w} ROWS {n - 1} PRECEDING) ELSE {x} END"


def steps(*levels: dict[str, str], base: str = BASE, source: str = "d") -> str:
    """Stack projections: each level adds columns computed from the level before."""
    sql, prev = "WITH " + base, source
    for k, cols in enumerate(levels):
        sql += f", l{k} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + f" FROM {prev})"
        prev = f"l{k}"
    return sql + f" SELECT {{out}} FROM {prev}"


def indicator(name: str, cols: list[str], *levels: dict[str, str], digits: int = 6):
    out = "symbol, ts, " + ", ".join(f"{R(c, digits)} AS {c}" for c in cols)

    def register(fn):
        def plan(t):
            p = Panel(t.bars, BAR_SERIES)
            fn(p)
            return rounded(p.done().select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in cols]), digits)

        return query(name, steps(*levels).format(out=out))(plan)

    return register


SPANS = (5, 9, 12, 20, 21, 26, 50, 100, 200)


@indicator("ema", [f"ema_{n}" for n in SPANS], {f"ema_{n}": ema("close", n) for n in SPANS})
def _ema(p):
    for n in SPANS:
        I.ema(p, n)


@query("ema_ticks", f"""WITH {TICKS}, d AS (SELECT *, row_number() OVER ({TW}) AS rn FROM ticks)
SELECT symbol, tie, {R(ema('price', 12, w=TW))} AS ema_12, {R(ema('price', 26, w=TW))} AS ema_26 FROM d""")
def _ema_ticks(t):
    p = Panel(t.ticks, TICK_SERIES)
    I.ema(p, 12, "price")
    I.ema(p, 26, "price")
    return rounded(p.done().select("symbol", "tie", "ema_12", "ema_26"))


def gapped(x: str, alpha: float, w: str = BW) -> str:
    """Exponential weights by absolute position, over the whole history; a null has no weight."""
    first = f"CASE WHEN rn = 1 THEN 1.0 ELSE {alpha:.17e} END"
    part = lambda u: f"list_reduce(list({u}) OVER ({w}), lambda a, v: a * {1 - alpha:.17e} + v)"
    return f"({part(f'coalesce({x}, 0) * {first}')} / nullif({part(f'CASE WHEN {x} IS NULL THEN 0.0 ELSE {first} END')}, 0))"


GAP = "CASE WHEN trade_count % 3 = 0 THEN NULL ELSE close END"


@indicator("ema_with_gaps", ["ema_3", "ema_12", "ema_26"], {"gap": GAP}, {f"ema_{n}": gapped("gap", 2 / (n + 1)) for n in (3, 12, 26)})
def _ema_gaps(p):
    p.df = p.df.withColumn("gap", F.when(F.col("trade_count") % 3 != 0, F.col("close")))
    for n in (3, 12, 26):
        I.ema(p, n, "gap")


@indicator("ema_fast", ["ema_1", "fast_90", "fast_99"], {"ema_1": "close", "fast_90": fold("close", 0.9), "fast_99": fold("close", 0.99)})
def _ema_fast(p):
    I.ema(p, 1)
    p.ema("fast_90", "close", alpha=0.9)
    p.ema("fast_99", "close", alpha=0.99)


@indicator("ema_adjusted", ["ema_adj_20"], {
    "num": fold("close", 2 / 21).replace("a + 9.52380952380952328e-02 * (v - a)", f"a * {1 - 2 / 21:.17e} + v"),
    "den": f"list_reduce(list(1.0::DOUBLE) OVER ({BW}), lambda a, v: a * {1 - 2 / 21:.17e} + v)"},
    {"ema_adj_20": "num / den"})
def _ema_adj(p):
    """Ratio of two recurrences: the finite-history weighting."""
    p.temp("_one", F.lit(1.0))
    p.recur("_num", "close", 1 - 2 / 21)
    p.recur("_den", "_one", 1 - 2 / 21)
    p.hide("_num", "_den")
    p.add("ema_adj_20", F.col("_num") / F.col("_den"), ["_num", "_den"])


@indicator("rsi_simple", ["rsi_7", "rsi_14", "rsi_21"],
           {f"rsi_{n}": f"100 - 100 / (1 + {r('avg', 'gain', n)} / ({r('avg', 'loss', n)} + 1e-10))" for n in (7, 14, 21)})
def _rsi(p):
    for n in (7, 14, 21):
        I.rsi(p, n)


@indicator("rsi_wilder", ["rsi_wilder_14"], {"g": seeded("gain", 14, 14), "l": seeded("loss", 14, 14)},
           {"ag": fold("g", 1 / 14, 14), "al": fold("l", 1 / 14, 14)},
           {"rsi_wilder_14": "100 - 100 / (1 + CASE WHEN al = 0 THEN 100 ELSE ag / al END)"})
def _rsi_w(p):
    I.rsi(p, 14, method="wilder")


def _macd_levels(f, s, g, x="close", tag=""):
    return ({"ef": ema(x, f), "es": ema(x, s)}, {f"macd{tag}": "ef - es"}, {f"macd_signal{tag}": ema(f"macd{tag}", g)},
            {f"macd_hist{tag}": f"macd{tag} - macd_signal{tag}"})


@indicator("macd", ["macd", "macd_signal", "macd_hist"], *_macd_levels(12, 26, 9))
def _macd(p):
    I.macd(p)


@indicator("macd_5_35_5", ["macd_5", "macd_signal_5", "macd_hist_5"], *_macd_levels(5, 35, 5, tag="_5"))
def _macd535(p):
    I.macd(p, 5, 35, 5, tag="_5")


for _ddof, _agg in ((1, "stddev_samp"), (0, "stddev_pop")):
    @indicator(f"bollinger_{'sample' if _ddof else 'population'}", ["bb_middle", "bb_upper", "bb_lower", "bb_percent", "bb_width"],
               {"bb_middle": r("avg", "close", 20), "sd": r(_agg, "close", 20)},
               {"bb_upper": "bb_middle + 2 * sd", "bb_lower": "bb_middle - 2 * sd"},
               {"bb_percent": "(close - bb_lower) / nullif(bb_upper - bb_lower, 0)", "bb_width": "(bb_upper - bb_lower) / nullif(bb_middle, 0)"})
    def _bb(p, ddof=_ddof):
        I.bollinger(p, ddof=ddof)


@indicator("atr_simple", ["true_range", "atr_14"], {"true_range": "tr", "atr_14": r("avg", "tr", 14)})
def _atr(p):
    I.true_range(p)
    I.atr(p)


@indicator("atr_wilder", ["atr_wilder_14"], {"x": seeded("tr", 14, 13)}, {"atr_wilder_14": fold("x", 1 / 14, 13)})
def _atrw(p):
    I.atr(p, method="wilder")


H14, L14 = r("max", "high", 14), r("min", "low", 14)


@indicator("stochastic", ["stochastic_k", "stochastic_d"], {"raw": f"100 * (close - {L14}) / nullif({H14} - {L14}, 0)"},
           {"stochastic_k": r("avg", "raw", 3)}, {"stochastic_d": r("avg", "stochastic_k", 3)})
def _stoch(p):
    I.stochastic(p)


@indicator("stochastic_rsi", ["stoch_rsi"], {"g": seeded("gain", 14, 14), "l": seeded("loss", 14, 14)},
           {"ag": fold("g", 1 / 14, 14), "al": fold("l", 1 / 14, 14)},
           {"x": "100 - 100 / (1 + CASE WHEN al = 0 THEN 100 ELSE ag / al END)"},
           {"stoch_rsi": f"(x - {r('min', 'x', 14)}) / nullif({r('max', 'x', 14)} - {r('min', 'x', 14)}, 0)"})
def _srsi(p):
    I.stoch_rsi(p)


@indicator("cmo", ["cmo"], {"u": r("sum", "gain", 14), "v": r("sum", "loss", 14)}, {"cmo": "100 * (u - v) / nullif(u + v, 0)"})
def _cmo(p):
    I.cmo(p)


def _ppo_levels(x, name):
    return ({"ef": ema(x, 12), "es": ema(x, 26)}, {name: "coalesce(100 * (ef - es) / nullif(es, 0), 0)"},
            {f"{name}_signal": ema(name, 9)}, {f"{name}_hist": f"{name} - {name}_signal"})


@indicator("ppo", ["ppo", "ppo_signal", "ppo_hist"], *_ppo_levels("close", "ppo"))
def _ppo(p):
    I.ppo(p)


@indicator("pvo", ["pvo", "pvo_signal", "pvo_hist"], *_ppo_levels("volume", "pvo"))
def _pvo(p):
    I.ppo(p, col="volume", name="pvo")


@indicator("roc", ["roc_10", "roc_20"], {f"roc_{n}": f"100 * (close / nullif(lag(close, {n}) OVER ({BW}), 0) - 1)" for n in (10, 20)})
def _roc(p):
    I.roc(p, 10)
    I.roc(p, 20)


@indicator("williams_r", ["willr_14"], {"willr_14": f"-100 * ({H14} - close) / nullif({H14} - {L14}, 0)"})
def _willr(p):
    I.williams_r(p)


@indicator("tsi", ["tsi"], {"a0": "close - pc", "b0": "abs(close - pc)"}, {"a1": ema("a0", 25, 1), "b1": ema("b0", 25, 1)},
           {"a2": ema("a1", 13, 1), "b2": ema("b1", 13, 1)}, {"tsi": "100 * a2 / nullif(b2, 0)"})
def _tsi(p):
    I.tsi(p)


@indicator("adx", ["adx_14", "di_plus", "di_minus"],
           {"up": "high - ph", "dn": "pl - low"},
           {"dmp": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "dmm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END"},
           {"sp": seeded("dmp", 14, 14), "sm": seeded("dmm", 14, 14), "st": seeded("tr", 14, 14)},
           {"wp": fold("sp", 1 / 14, 14), "wm": fold("sm", 1 / 14, 14), "wt": fold("st", 1 / 14, 14)},
           {"di_plus": "100 * wp / nullif(wt, 0)", "di_minus": "100 * wm / nullif(wt, 0)"},
           {"dx": "coalesce(100 * abs(di_plus - di_minus) / nullif(di_plus + di_minus, 0), 0)"},
           {"sdx": seeded("dx", 14, 27)}, {"adx_14": fold("sdx", 1 / 14, 27)})
def _adx(p):
    I.adx(p)


@indicator("cci", ["cci_20"], {"mu": r("avg", "tp", 20), "xs": f"list(tp) OVER ({BW} ROWS 19 PRECEDING)"},
           {"cci_20": "(tp - mu) / nullif(0.015 * list_avg(list_transform(xs, lambda x: abs(x - mu))), 0)"}, digits=4)
def _cci(p):
    I.cci(p)


@indicator("dpo", ["dpo_20"], {"dpo_20": f"lag(close, 11) OVER ({BW}) - {r('avg', 'close', 20)}"})
def _dpo(p):
    I.dpo(p)


@indicator("kst", ["kst", "kst_signal"],
           {f"r{n}": f"100 * (close / nullif(lag(close, {n}) OVER ({BW}), 0) - 1)" for n in (10, 15, 20, 30)},
           {"kst": f"{r('avg', 'r10', 10)} + 2 * {r('avg', 'r15', 10)} + 3 * {r('avg', 'r20', 10)} + 4 * {r('avg', 'r30', 15)}"},
           {"kst_signal": r("avg", "kst", 9)}, digits=5)
def _kst(p):
    I.kst(p)


@indicator("ichimoku", ["ichimoku_conversion", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b", "ichimoku_lagging"],
           {"ichimoku_conversion": f"({r('max', 'high', 9)} + {r('min', 'low', 9)}) / 2",
            "ichimoku_base": f"({r('max', 'high', 26)} + {r('min', 'low', 26)}) / 2",
            "slow": f"({r('max', 'high', 52)} + {r('min', 'low', 52)}) / 2"},
           {"ichimoku_span_a": f"lag((ichimoku_conversion + ichimoku_base) / 2, 26) OVER ({BW})",
            "ichimoku_span_b": f"lag(slow, 26) OVER ({BW})", "ichimoku_lagging": f"lead(close, 26) OVER ({BW})"})
def _ichi(p):
    I.ichimoku(p)


@indicator("vortex", ["vortex_plus", "vortex_minus"], {"vp": "abs(high - pl)", "vm": "abs(low - ph)"},
           {"vortex_plus": f"{r('sum', 'vp', 14)} / nullif({r('sum', 'tr', 14)}, 0)",
            "vortex_minus": f"{r('sum', 'vm', 14)} / nullif({r('sum', 'tr', 14)}, 0)"})
def _vortex(p):
    I.vortex(p)


@indicator("aroon", ["aroon_up", "aroon_down"],
           {"up": f"CASE WHEN rn >= 15 THEN arg_max(rn, (high, rn)) OVER ({BW} ROWS 14 PRECEDING) END",
            "dn": f"CASE WHEN rn >= 15 THEN arg_min(rn, (low, -rn)) OVER ({BW} ROWS 14 PRECEDING) END"},
           {"aroon_up": "100.0 * (14 - (rn - up)) / 14", "aroon_down": "100.0 * (14 - (rn - dn)) / 14"})
def _aroon(p):
    I.aroon(p)


@indicator("keltner", ["keltner_middle", "keltner_upper", "keltner_lower"], {"keltner_middle": ema("close", 20), "w": ema("tr", 20)},
           {"keltner_upper": "keltner_middle + 2 * w", "keltner_lower": "keltner_middle - 2 * w"})
def _keltner(p):
    I.keltner(p)


@indicator("donchian", ["donchian_high", "donchian_low", "donchian_mid"],
           {"donchian_high": r("max", "high", 20), "donchian_low": r("min", "low", 20)},
           {"donchian_mid": "(donchian_high + donchian_low) / 2"})
def _donchian(p):
    I.donchian(p)


MFM = "coalesce((2 * close - low - high) / nullif(high - low, 0), 0)"


@query("volume_running_totals", steps(
    {"o": "coalesce(sign(close - pc) * volume, 0)", "a": f"{MFM} * volume", "v": "coalesce((close / pc - 1) * volume, 0)",
     "n": "coalesce(CASE WHEN volume < pvol THEN ln(close / pc) END, 0)"}).format(
    out=f"""symbol, ts, {R(f'sum(o) OVER ({BW})', 4)} AS obv, {R(f'sum(a) OVER ({BW})', 4)} AS ad,
  {R(f'sum(v) OVER ({BW})', 4)} AS pvt, {R(f'sum(n) OVER ({BW})', 4)} AS log_nvi"""))
def _totals(t):
    out = I.running_totals_of_volume(t.bars, BAR_SERIES)
    return rounded(out.select("symbol", "ts", "obv", "ad", "pvt", F.log(F.col("nvi") / 1000).alias("log_nvi")), 4)


@query("ad_oscillator", steps({"a": f"{MFM} * volume"}, {"ad": f"sum(a) OVER ({BW})"},
                              {"f": ema("ad", 3), "s": ema("ad", 10)}).format(
    out=f"symbol, ts, {R('f - s', 4)} AS ad_oscillator"))
def _ado(t):
    return rounded(I.ad_oscillator(t.bars, BAR_SERIES).select("symbol", "ts", "ad_oscillator"), 4)


@indicator("mfi", ["mfi_14"], {"p": "CASE WHEN tp > ptp THEN tp * volume ELSE 0 END", "n": "CASE WHEN tp < ptp THEN tp * volume ELSE 0 END"},
           {"mfi_14": f"100 * {r('sum', 'p', 14)} / nullif({r('sum', 'p', 14)} + {r('sum', 'n', 14)}, 0)"})
def _mfi(p):
    I.mfi(p)


@indicator("chaikin_money_flow", ["cmf_20"], {"m": f"{MFM} * volume"},
           {"cmf_20": f"{r('sum', 'm', 20)} / nullif({r('sum', 'volume', 20)}, 0)"})
def _cmf(p):
    I.cmf(p)


@indicator("ease_of_movement", ["eom", "eom_sma_14"],
           {"eom": "1e8 * ((high + low - ph - pl) / 2 * (high - low)) / nullif(volume, 0)"},
           {"eom_sma_14": f"avg(eom) OVER ({BW} ROWS 13 PRECEDING)"}, digits=1)
def _eom(p):
    I.ease_of_movement(p)


def _wma_sql(x, n):
    return "(" + " + ".join(f"{n - k} * lag({x}, {k}) OVER ({BW})" if k else f"{n} * {x}" for k in range(n)) + f") / {n * (n + 1) / 2}"


@indicator("weighted_moving_averages", ["wma_10", "hma_9"], {"wma_10": _wma_sql("close", 10), "h": f"2 * {_wma_sql('close', 4)} - {_wma_sql('close', 9)}"},
           {"hma_9": _wma_sql("h", 3)})
def _wma(p):
    I.wma(p, 10)
    I.hma(p)


@indicator("chained_averages", ["dema_10", "tema_9", "trix_15", "zlma_10"],
           {"a1": ema("close", 10), "b1": ema("close", 9), "c1": ema("close", 15), "z": f"2 * close - lag(close, 4) OVER ({BW})"},
           {"a2": ema("a1", 10), "b2": ema("b1", 9), "c2": ema("c1", 15), "zlma_10": ema("z", 10, 4)},
           {"b3": ema("b2", 9), "c3": ema("c2", 15)},
           {"dema_10": "2 * a1 - a2", "tema_9": "3 * b1 - 3 * b2 + b3", "trix_15": f"100 * (c3 / lag(c3) OVER ({BW}) - 1)"})
def _chained(p):
    I.dema(p)
    I.tema(p)
    I.trix(p)
    I.zlma(p)


@indicator("vwma", ["vwma_20"], {"vwma_20": f"{r('sum', 'close * volume', 20)} / nullif({r('sum', 'volume', 20)}, 0)"})
def _vwma(p):
    I.vwma(p)


@indicator("pivots", ["pivot_point", "resistance_1", "support_1", "resistance_2", "support_2", "resistance_3", "support_3", "fib_retracement"],
           {"pivot_point": "(ph + pl + pc) / 3", "h20": r("max", "high", 20), "l20": r("min", "low", 20)},
           {"resistance_1": "2 * pivot_point - pl", "support_1": "2 * pivot_point - ph", "resistance_2": "pivot_point + (ph - pl)",
            "support_2": "pivot_point - (ph - pl)", "resistance_3": "ph + 2 * (pivot_point - pl)",
            "support_3": "pl - 2 * (ph - pivot_point)", "fib_retracement": "h20 - 0.618 * (h20 - l20)"})
def _pivots(p):
    I.pivots(p)


@query("doji", f"WITH {BARS} SELECT symbol, ts, coalesce(abs(open - close) / nullif(high - low, 0) < 0.1, false) AS doji FROM bars")
def _doji(t):
    p = Panel(t.bars, BAR_SERIES)
    I.doji(p)
    return p.done().select("symbol", "ts", "doji")


@indicator("ewma_volatility", ["ewma_vol"], {"x": "pow(close / pc - 1, 2)"}, {"v": fold("x", 1 - 0.94, 1)}, {"ewma_vol": "sqrt(v)"})
def _ewma(p):
    I.ewma_variance(p)


@indicator("mass_index", ["mass_index"], {"h": "high - low"}, {"e1": ema("h", 9)}, {"e2": ema("e1", 9)},
           {"s": "e1 / nullif(e2, 0)"}, {"mass_index": r("sum", "s", 25)})
def _mass(p):
    I.mass_index(p)


@indicator("ultimate_oscillator", ["ultimate_oscillator"], {"bp": "close - least(low, pc)"},
           {"ultimate_oscillator": "100 * (" + " + ".join(
               f"{w} * {r('sum', 'bp', n)} / nullif({r('sum', 'tr', n)}, 0)" for w, n in ((4, 7), (2, 14), (1, 28))) + ") / 7"})
def _uo(p):
    I.ultimate_oscillator(p)


@indicator("awesome_oscillator", ["awesome_oscillator"], {"m": "(high + low) / 2"},
           {"awesome_oscillator": f"{r('avg', 'm', 5)} - {r('avg', 'm', 34)}"})
def _ao(p):
    I.awesome_oscillator(p)


@indicator("ulcer_index", ["ulcer_index"], {"s": f"pow(100 * (close - {r('max', 'close', 14)}) / {r('max', 'close', 14)}, 2)"},
           {"ulcer_index": f"sqrt({r('avg', 's', 14)})"})
def _ulcer(p):
    I.ulcer_index(p)


@indicator("force_index", ["force_index_13"], {"f": "(close - pc) * volume"}, {"force_index_13": ema("f", 13, 1)}, digits=4)
def _force(p):
    I.force_index(p)


def _st(x):
    return f"coalesce(100 * ({x} - {r('min', x, 10)}) / nullif({r('max', x, 10)} - {r('min', x, 10)}, 0), 0)"


@indicator("schaff_trend_cycle", ["stc"], {"a": ema("close", 23), "e": ema("close", 50)}, {"m": "a - e"}, {"k1": _st("m")},
           {"d1": ema("k1", 3, 9)}, {"k2": _st("d1")}, {"stc": ema("k2", 3, 18)}, digits=4)
def _stc(p):
    I.stc(p)


@query("kama", f"""WITH RECURSIVE {BASE}, e AS (SELECT *, abs(close - lag(close, 10) OVER ({BW})) AS mv,
   {r('sum', 'abs(close - pc)', 10)} AS noise FROM d),
w AS MATERIALIZED (SELECT symbol, ts, rn, close, pow(coalesce(mv / nullif(noise, 0), 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS w FROM e),
k AS (SELECT symbol, ts, rn, close AS kama FROM w WHERE rn = 10
  UNION ALL SELECT w.symbol, w.ts, w.rn, k.kama + w.w * (w.close - k.kama) FROM k JOIN w ON w.symbol = k.symbol AND w.rn = k.rn + 1)
SELECT b.symbol, b.ts, {R('kama')} AS kama FROM bars b LEFT JOIN k USING (symbol, ts)""")
def _kama(t):
    return rounded(I.kama(t.bars, BAR_SERIES).select("symbol", "ts", "kama"))


@query("tick_indicator_set", f"""WITH {TICKS}, d AS (SELECT *, row_number() OVER ({TW}) AS rn,
    price - lag(price) OVER ({TW}) AS dp FROM ticks),
g AS (SELECT *, coalesce(greatest(dp, 0), 0) AS gain, coalesce(greatest(-dp, 0), 0) AS loss,
  {ema('price', 12, w=TW)} - {ema('price', 26, w=TW)} AS macd FROM d)
SELECT symbol, tie, {', '.join(f"{R(roll('avg', 'price', n, TW))} AS sma_{n}" for n in (20, 50, 200))},
  {R(f"100 - 100 / (1 + {roll('avg', 'gain', 14, TW)} / ({roll('avg', 'loss', 14, TW)} + 1e-10))")} AS rsi_14,
  {R('macd')} AS macd, {R(ema('macd', 9, w=TW))} AS macd_signal, {R(f"macd - {ema('macd', 9, w=TW)}")} AS macd_hist,
  {R(roll('avg', 'price', 20, TW))} AS bb_middle,
  {R(f"{roll('avg', 'price', 20, TW)} + 2 * {roll('stddev_samp', 'price', 20, TW)}")} AS bb_upper,
  {R(f"{roll('avg', 'price', 20, TW)} - 2 * {roll('stddev_samp', 'price', 20, TW)}")} AS bb_lower FROM g""")
def _tickset(t):
    p = Panel(t.ticks, TICK_SERIES)
    cols = I.tick_panel(p)
    return rounded(p.done().select("symbol", "tie", *cols))


@query("parabolic_sar", f"""WITH RECURSIVE {BASE}, w AS MATERIALIZED (SELECT symbol, ts, rn, high, low,
    coalesce(lag(high, 2) OVER ({BW}), ph) AS ph2, coalesce(lag(low, 2) OVER ({BW}), pl) AS pl2, ph, pl FROM d),
k AS (SELECT symbol, ts, rn, 1 AS trend, low AS sar, high AS ep, 0.02::DOUBLE AS af FROM w WHERE rn = 1
  UNION ALL
  SELECT symbol, ts, rn, CASE WHEN trend = 1 THEN CASE WHEN low < s THEN -1 ELSE 1 END ELSE CASE WHEN high > s THEN 1 ELSE -1 END END,
    CASE WHEN (trend = 1 AND low < s) OR (trend = -1 AND high > s) THEN ep ELSE s END,
    CASE WHEN trend = 1 THEN CASE WHEN low < s THEN low ELSE greatest(ep, high) END
         ELSE CASE WHEN high > s THEN high ELSE least(ep, low) END END,
    CASE WHEN (trend = 1 AND low < s) OR (trend = -1 AND high > s) THEN 0.02::DOUBLE
         WHEN (trend = 1 AND high > ep) OR (trend = -1 AND low < ep) THEN least(af + 0.02, 0.2)::DOUBLE ELSE af END
  FROM (SELECT w.*, k.trend, k.ep, k.af, CASE WHEN k.trend = 1 THEN least(k.sar + k.af * (k.ep - k.sar), w.pl, w.pl2)
          ELSE greatest(k.sar + k.af * (k.ep - k.sar), w.ph, w.ph2) END AS s
        FROM k JOIN w ON w.symbol = k.symbol AND w.rn = k.rn + 1))
SELECT symbol, ts, CASE WHEN rn > 1 THEN {R('sar')} END AS psar FROM k""")
def _psar(t):
    from quotemill.operators.scans import parabolic_sar

    return rounded(parabolic_sar(t.bars, BAR_SERIES).select("symbol", "ts", "psar"))


@query("supertrend", f"""WITH RECURSIVE {BASE}, s AS (SELECT *, {seeded('tr', 7, 6)} AS x FROM d),
a AS (SELECT *, {fold('x', 1 / 7, 6)} AS atr FROM s),
w AS MATERIALIZED (SELECT symbol, ts, rn, close, pc, (high + low) / 2 + 3 * atr AS up, (high + low) / 2 - 3 * atr AS lo FROM a),
k AS (SELECT symbol, ts, rn, 1 AS trend, up AS fu, lo AS fl FROM w WHERE rn = 7
  UNION ALL
  SELECT w.symbol, w.ts, w.rn, CASE WHEN w.close > k.fu THEN 1 WHEN w.close < k.fl THEN -1 ELSE k.trend END,
    CASE WHEN w.up < k.fu OR w.pc > k.fu THEN w.up ELSE k.fu END,
    CASE WHEN w.lo > k.fl OR w.pc < k.fl THEN w.lo ELSE k.fl END
  FROM k JOIN w ON w.symbol = k.symbol AND w.rn = k.rn + 1)
SELECT b.symbol, b.ts, {R('CASE WHEN trend = 1 THEN fl ELSE fu END')} AS supertrend, CAST(trend AS DOUBLE) AS supertrend_direction
FROM bars b LEFT JOIN k USING (symbol, ts)""")
def _supertrend(t):
    from quotemill.operators.scans import supertrend

    out = supertrend(t.bars, BAR_SERIES).select("symbol", "ts", "supertrend", "supertrend_direction")
    return rounded(out, 6, "supertrend")


def _bar_names_sql() -> str:
    shape = {"o": "open", "h": "high", "l": "low", "c": "close", "b": "close - open", "ab": "abs(close - open)",
             "r": "high - low", "us": "high - greatest(open, close)", "ls": "least(open, close) - low",
             "top": "greatest(open, close)", "bot": "least(open, close)"}
    zero = ", ".join(f"{e} AS {x}0" for x, e in shape.items())
    past = ", ".join(f"lag({x}0, {k}) OVER ({BW}) AS {x}{k}" for x in [*shape, "ma"] for k in range(1, 5))
    return f""", n0 AS (SELECT *, {zero} FROM bars), n1 AS (SELECT *, avg(ab0) OVER ({BW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ma0 FROM n0),
n2 AS (SELECT *, {past} FROM n1)"""


def _register_patterns():
    from quotemill.operators.patterns import PATTERNS, pattern, value_sql

    cols = [f"cdl_{n}" for n in PATTERNS]

    @query("candlestick_patterns", f"WITH {BARS}{_bar_names_sql()} SELECT symbol, ts, "
           + ", ".join(f"{value_sql(n)} AS cdl_{n}" for n in PATTERNS) + " FROM n2")
    def _patterns(t):
        p = Panel(t.bars, BAR_SERIES)
        for n in PATTERNS:
            pattern(p, n)
        return p.done().select("symbol", "ts", *cols)


_register_patterns()


@query("reduced_indicator_set", steps(
    {"returns": "close / pc - 1", "ef": ema("close", 12), "es": ema("close", 26), "bb_middle": r("avg", "close", 20),
     "sd": r("stddev_samp", "close", 20), "po": f"lag(open) OVER ({BW})"}
    | {f"sma_{n}": r("avg", "close", n) for n in (5, 10, 20, 50, 100, 200)}
    | {f"ema_{n}": ema("close", n) for n in (5, 10, 20, 50, 100, 200)}
    | {"rsi_14": f"100 - 100 / (1 + {r('avg', 'gain', 14)} / ({r('avg', 'loss', 14)} + 1e-10))",
       "volume_ma_20": r("avg", "volume", 20), "atr_14": r("avg", "tr", 14)},
    {"macd": "ef - es"}, {"macd_signal": ema("macd", 9), "bb_width": "4 * sd / nullif(bb_middle, 0)"}).format(
    out="symbol, ts, " + ", ".join(f"{R(x)} AS {x}" for x in (
        "returns", *[f"{k}_{n}" for n in (5, 10, 20, 50, 100, 200) for k in ("sma", "ema")], "rsi_14", "macd", "macd_signal",
        "bb_width", "volume_ma_20", "atr_14")) + ", coalesce(abs(open - close) / nullif(high - low, 0) < 0.1, false) AS doji, "
    "CASE WHEN pc < po AND close > open AND close >= po AND open <= pc AND abs(close - open) > abs(pc - po) THEN 100 "
    "WHEN pc > po AND close < open AND close <= po AND open >= pc AND abs(close - open) > abs(pc - po) THEN -100 ELSE 0 END AS cdl_engulfing"))
def _fallback(t):
    p = Panel(t.bars, BAR_SERIES)
    I.fallback_panel(p)
    nums = [f"{k}_{n}" for n in (5, 10, 20, 50, 100, 200) for k in ("sma", "ema")]
    nums = ["returns", *nums, "rsi_14", "macd", "macd_signal", "bb_width", "volume_ma_20", "atr_14"]
    return rounded(p.done().select("symbol", "ts", *nums, "doji", "cdl_engulfing"), 6, *nums)


@query("baseline_feature_set")
def _baseline(t):
    return rounded(I.baseline_features(t.bars, BAR_SERIES))


@query("all_indicators")
def _all(t):
    return rounded(I.all_indicators(t.bars, BAR_SERIES))

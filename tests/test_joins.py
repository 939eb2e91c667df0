import numpy as np
import pandas as pd
import pytest

from quotemill.operators import joins as J
from quotemill.operators.ordered import Series

S = Series(keys=("symbol",), ts="ts", tie=("tie",), slices=4, block_rows=8)


def frame(spark, pdf, extra):
    return spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, tie long, " + extra)


def test_asof_takes_the_row_at_the_same_time(spark):
    t = pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:00:00"])
    left = frame(spark, pd.DataFrame({"symbol": ["a", "a", "b"], "ts": t, "tie": [1, 2, 3], "x": [1.0, 2.0, 3.0]}), "x double")
    right = frame(spark, pd.DataFrame({"symbol": ["a", "a"], "ts": t[:2], "tie": [9, 8], "v": [10.0, 20.0]}), "v double")
    got = {r["tie"]: r["v"] for r in J.asof_join(left, right, S, ["v"]).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: None}


@pytest.mark.parametrize("block", [2, 16, 16384])
def test_first_trigger_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    n = 300
    q = pd.DataFrame({"symbol": np.where(rng.random(n) < 0.8, "hot", "cold"), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "s"), "tie": np.arange(n), "px": np.round(rng.uniform(0, 100, n), 1)})
    o = pd.DataFrame({"symbol": rng.choice(["hot", "cold"], 80), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, n, 80), "s"), "oid": np.arange(80), "lim": np.round(rng.uniform(0, 20, 80), 1)})
    orders = spark.createDataFrame(o, "symbol string, ts timestamp_ntz, oid long, lim double")
    for below in (True, False):
        got = {r["oid"]: r["trigger_ts"] for r in J.first_trigger(orders, frame(spark, q, "px double"), S.with_(block_rows=block), "oid", "lim", J.F.col("px"), below).collect()}
        want = {}
        for r in o.itertuples():
            m = q[(q["symbol"] == r.symbol) & (q["ts"] >= r.ts) & ((q["px"] <= r.lim) if below else (q["px"] >= r.lim))]
            if len(m):
                want[r.oid] = m["ts"].min().to_pydatetime()
        assert got == want


@pytest.mark.parametrize("block", [4, 16384])
def test_order_triggers_write_each_quote_once(spark, monkeypatch, block):
    """All kinds of orders against brute force, with equal times, missing prices and levels; no frame that is written holds a quote per line."""
    seen = {}

    def kept(df, label, inner=J.materialize):
        out = inner(df, label)
        seen[label] = max(seen.get(label, 0), out.count())
        return out

    monkeypatch.setattr(J, "materialize", kept)
    rng = np.random.default_rng(3)
    n, m = 240, 90
    at = lambda k: pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60, k), "s")
    price = lambda k: np.where(rng.random(k) < 0.1, None, np.round(rng.uniform(0, 100, k), 1))
    q = pd.DataFrame({"symbol": rng.choice(["a", "b"], n), "ts": at(n), "tie": np.arange(n), "bid": price(n), "ask": price(n)})
    o = pd.DataFrame({"order_id": np.arange(m), "symbol": rng.choice(["a", "b", "c"], m), "ts": at(m), "type": rng.choice(["limit", "stop", "stop_limit"], m),
                      "side": rng.choice(["buy", "sell"], m), "price": price(m), "stop_price": price(m)})
    orders = spark.createDataFrame(o, "order_id long, symbol string, ts timestamp_ntz, type string, side string, price double, stop_price double")
    got = {r["order_id"]: r["trigger_ts"] for r in J.order_triggers(orders, frame(spark, q, "bid double, ask double"), S.with_(block_rows=block)).collect()}

    def first(r, kind, level, since):
        col, sign = J.TRIGGER_LINES[(kind, r.side)]
        if level is None or since is None:
            return None
        hit = q[(q["symbol"] == r.symbol) & (q["ts"] >= since) & (q[col].astype(float) * sign <= level * sign)]
        return hit["ts"].min() if len(hit) else None

    want = {}
    for r in o.itertuples():
        t = first(r, "limit", r.price, r.ts) if r.type == "limit" else first(r, "stop", r.stop_price, r.ts)
        t = first(r, "limit", r.price, t) if r.type == "stop_limit" else t
        if t is not None:
            want[r.order_id] = t.to_pydatetime()
    assert got == want and len({o["type"][k] for k in got}) == 3
    assert max(v for k, v in seen.items() if k.startswith("trigger")) <= n + m

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import regimes as R
from quotemill.operators.ordered import Series

S = Series(keys=("key",), ts="ts", tie=("tie",))
CHAIN = R.Chain(np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.08, 0.02], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]]), np.array([-1.0, 0.0, 1.5]), np.array([0.5, 0.3, 0.7]))


def walk(chain, n, rng):
    states = [rng.choice(len(chain.start), p=chain.start)]
    for _ in range(n - 1):
        states.append(rng.choice(len(chain.start), p=chain.move[states[-1]]))
    states = np.array(states)
    return states, rng.normal(chain.mean[states], chain.sd[states])


def frame(spark, series):
    parts = [pd.DataFrame({"key": k, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(x)) // 2, "min"), "tie": np.arange(len(x)), "x": x}) for k, x in series.items()]
    pdf = pd.concat(parts).sample(frac=1, random_state=1)
    rows = [(k, t.to_pydatetime(), int(i), None if np.isnan(x) else float(x)) for k, t, i, x in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, tie long, x double").repartition(3)


def viterbi(chain, x):
    b = chain.likelihoods(x)
    d, back = np.log(chain.start) + b[0], []
    for t in range(1, len(x)):
        z = d[:, None] + np.log(chain.move)
        back.append(z.argmax(0))
        d = z.max(0) + b[t]
    path = [int(d.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return path[::-1]


def smoothed(chain, x):
    b = np.exp(chain.likelihoods(x))
    f, g = np.empty((len(x), 3)), np.ones((len(x), 3))
    f[0] = chain.start * b[0]
    for t in range(1, len(x)):
        f[t] = f[t - 1] / f[t - 1].sum() @ chain.move * b[t]
    for t in range(len(x) - 2, -1, -1):
        g[t] = chain.move @ (b[t + 1] * g[t + 1])
        g[t] /= g[t].sum()
    p = f * g
    return p / p.sum(1, keepdims=True)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    out = {"hot": walk(CHAIN, 1500, rng)[1], "b": walk(CHAIN, 40, rng)[1], "one": np.array([0.3])}
    out["hot"][[5, 700]] = np.nan
    return out


@pytest.mark.parametrize("block", [1, 64, 4096])
def test_best_path_equals_plain_search(spark, series, block):
    got = R.likeliest_path(frame(spark, {k: x[:200] for k, x in series.items()} if block == 1 else series), S, "x", CHAIN, block).toPandas()
    for k, x in series.items():
        mine = got[got.key == k].sort_values(["ts", "tie"])
        assert mine.state.tolist() == viterbi(CHAIN, x[:200] if block == 1 else x), k


def test_probabilities_equal_forward_and_backward(spark, series):
    got = R.state_probabilities(frame(spark, series), S, "x", CHAIN, 100).toPandas()
    for k, x in series.items():
        mine = np.array(got[got.key == k].sort_values(["ts", "tie"]).p.tolist())
        assert np.allclose(mine, smoothed(CHAIN, x), atol=1e-9), k


def test_planted_chain_is_recovered(spark):
    rng = np.random.default_rng(11)
    planted = R.Chain(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([-1.0, 1.0]), np.array([0.6, 0.9]))
    states, x = walk(planted, 4000, rng)
    more = walk(planted, 500, rng)[1]
    data = frame(spark, {"hot": x, "b": more})
    chain, fits = R.fit_chain(data, S, "x", 2, rounds=8, block=512)
    assert np.abs(chain.move - planted.move).max() < 0.03 and np.abs(chain.mean - planted.mean).max() < 0.1 and np.abs(chain.sd - planted.sd).max() < 0.1
    assert all(b >= a - 1e-6 for a, b in zip(fits, fits[1:]))  # each round fits at least as well
    path = R.likeliest_path(data.filter("key = 'hot'"), S, "x", chain).toPandas().sort_values(["ts", "tie"])
    assert (path.state.to_numpy() == states).mean() > 0.9


def test_a_hot_key_is_split(spark, series):
    packed = R._packed(frame(spark, series), S, "x", 100)
    sizes = {(r.key, r.n) for r in packed.select("key", F.size("_rows").alias("n")).collect()}
    assert ("hot", 100) in sizes and max(n for _, n in sizes) == 100


def test_empty_and_flat(spark):
    empty = spark.createDataFrame([], "key string, ts timestamp_ntz, tie long, x double")
    assert R.likeliest_path(empty, S, "x", CHAIN).count() == 0
    with pytest.raises(ValueError):
        R.fit_chain(empty, S, "x")
    with pytest.raises(ValueError):
        R.fit_chain(frame(spark, {"a": np.ones(5)}), S, "x")

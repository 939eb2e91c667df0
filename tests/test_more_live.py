"""Message log, capped join, JSON texts, user folds, tail means, reference summaries."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.functions import user as U
from quotemill.operators import drift as D
from quotemill.operators import portfolio as PF
from quotemill.operators import quality as Q
from quotemill.operators.risk import expected_shortfall
from quotemill.session import remove_path, scratch
from quotemill.sources import log
from quotemill.streaming import jobs
from quotemill.streaming.joins import capped_join

START = pd.Timestamp("2024-01-01")
SIDE = "key string, ts timestamp_ntz, tie long, note string"


def at(seconds):
    return (START + pd.Timedelta(seconds=seconds)).to_pydatetime()


# -- message log -----------------------------------------------------------------------------------------


def messages(spark, rows):
    return spark.createDataFrame([(k, v, at(s), [("h", b"1")] if k else None) for k, v, s in rows],
                                 "key string, value string, timestamp timestamp_ntz, headers array<struct<key: string, value: binary>>")


def test_log_gives_every_message_one_offset_and_survives_replays(spark):
    path = scratch(spark, "log-test")
    sink = log.log_sink(f"{path}/log", "t", partitions=3)
    first, second = [("a", f"v{i}", i) for i in range(50)] + [(None, "null key", 3)], [("b", f"w{i}", 100 + i) for i in range(20)] + [("a", "v0", 0)]
    assert log.ends(spark, f"{path}/log") == {}
    sink(messages(spark, first), 0)
    sink(messages(spark, second), 1)
    sink(messages(spark, second), 1)  # a replay of a batch that was finished
    remove_path(spark, f"{path}/log/index/batch=1")  # and of one that was cut off before its index
    sink(messages(spark, second), 1)
    got = log.read_log(spark, f"{path}/log", stream=False).toPandas()
    assert sorted(got.value.map(bytes.decode)) == sorted(v for _, v, _ in first + second)
    for _, part in got.groupby("partition"):
        assert sorted(part.offset) == list(range(len(part)))
    ends = log.ends(spark, f"{path}/log")
    assert sum(ends.values()) == len(got) and set(got.topic) == {"t"}
    assert got[got.value == b"v7"].headers.iloc[0][0]["key"] == "h" and got[got.value == b"v7"].timestamp.iloc[0] == at(7)
    assert len(set(got[got.value.isin([b"v1", b"v2", b"v3"])].partition)) == 1  # one key, one partition, in order of time
    a = got[got.value.map(lambda v: v.startswith(b"v"))].sort_values("offset")
    assert a.value.tolist()[:50] == [f"v{i}".encode() for i in range(50)]


def test_stream_restarts_without_loss_or_doubling(spark):
    path = scratch(spark, "log-stream")
    sink = log.log_sink(f"{path}/log", "t", partitions=2)
    seen = []
    for batch in range(3):
        sink(messages(spark, [(f"k{i % 5}", f"{batch}-{i}", 100 * batch + i) for i in range(30)]), batch)
        for _ in range(2):  # the second run finds nothing new
            stream = log.read_log(spark, f"{path}/log", "t")
            jobs.append_sink(stream.select("partition", "offset", F.col("value").cast("string").alias("value")), f"{path}/table", f"{path}/cp", every=None).awaitTermination()
            seen.append(spark.read.parquet(f"{path}/table").count())
    assert seen == [30, 30, 60, 60, 90, 90]
    assert spark.read.parquet(f"{path}/table").dropDuplicates(["partition", "offset"]).count() == 90
    assert log.read_log(spark, f"{path}/log", "other", stream=False).count() == 0


# -- capped join -----------------------------------------------------------------------------------------


def plain_join(batches, cap, expire, how):
    """The rows one by one, with the lists they are held in."""
    held, out = {}, []
    for batch in batches:
        for t, tie, side, key in sorted((t, tie, side, key) for side, rows in enumerate(batch) for key, t, tie in rows if key is not None):
            mine, other = held.setdefault((key, side), []), held.setdefault((key, 1 - side), [])
            met = [x for x in other[-cap:] if expire is None or x[0] >= t - expire]
            out += [(key, *((tie, x[1]) if side == 0 else (x[1], tie))) for x in met]
            if not met and how in (("left", "full") if side == 0 else ("right", "full")):
                out.append((key, *((tie, None) if side == 0 else (None, tie))))
            mine.append((t, tie))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how,expire", [("inner", None), ("right", 60.0), ("full", 25.0)])
def test_capped_join_equals_replay(spark, how, expire):
    rng, tie = np.random.default_rng(5), iter(range(10_000))
    batches = [tuple([(str(rng.choice(["hot", "hot", "a", "b"])), int(100 * k + rng.integers(0, 100)), next(tie)) for _ in range(n)] for n in (30, 18)) for k in range(3)]
    batches[1][0].append((None, 120, next(tie)))
    path, schema = scratch(spark, "capped"), SIDE
    for k, sides in enumerate(batches):
        for name, rows in zip(("l", "r"), sides):
            spark.createDataFrame([(key, at(t), i, f"{name}{i}") for key, t, i in rows], schema).repartition(2).write.mode("append").parquet(f"{path}/{name}")
        if k == 0:
            joined = capped_join(*[spark.readStream.schema(schema).parquet(f"{path}/{name}") for name in ("l", "r")], ["key"], cap=4, expire=expire, how=how)
        jobs.start(joined, jobs.batch_writer(f"{path}/out"), f"{path}/cp", "update").awaitTermination()
    got = spark.read.parquet(f"{path}/out").collect()
    assert sorted(((r.key, r.l and r.l.tie, r.r and r.r.tie) for r in got), key=repr) == plain_join(batches, 4, expire, how)
    assert all(r.l is None or (r.l.note == f"l{r.l.tie}" and r.l.key == r.key) for r in got)
    full = plain_join(batches, 10**9, expire, how)
    assert full != plain_join(batches, 4, expire, how)  # the cap has evicted


# -- JSON texts ------------------------------------------------------------------------------------------


def test_json_checks(spark):
    schema = {"type": "object", "required": ["id", "extra"], "properties": {
        "id": {"type": "integer"}, "name": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}, "ratio": {"type": "number", "minimum": 0, "maximum": 1},
        "kind": {"enum": ["a", 2]}, "note": {"type": ["string", "null"]}, "deep": {"type": "object", "required": ["x"], "properties": {"x": {"type": "boolean"}}},
        "list": {"type": "array", "items": {"type": "integer", "maximum": 5}}}}
    rows = {
        '{"id": 1, "extra": 0, "name": "ab", "ratio": 0.5, "kind": 2, "note": null, "deep": {"x": true}, "list": [1, 5]}': [],
        '{"id": 1.0, "extra": null, "name": "ab", "note": "text", "list": []}': [],
        '{"id": 1.5, "extra": 1}': ["id:type"], '{"id": "1", "extra": 1}': ["id:type"], '{"extra": 1}': ["id:missing"], '{"id": 1}': ["extra:missing"],
        '{"id": 1, "extra": 1, "name": 12}': ["name:type"], '{"id": 1, "extra": 1, "name": "A"}': ["name:length", "name:pattern"],
        '{"id": 1, "extra": 1, "ratio": 1.01}': ["ratio:range"], '{"id": 1, "extra": 1, "kind": "b"}': ["kind:enum"], '{"id": 1, "extra": 1, "kind": "2"}': ["kind:enum"],
        '{"id": 1, "extra": 1, "note": 3}': ["note:type"], '{"id": 1, "extra": 1, "deep": {}}': ["deep.x:missing"], '{"id": 1, "extra": 1, "deep": {"x": 1}}': ["deep.x:type"],
        '{"id": 1, "extra": 1, "list": [1, "2"]}': ["list:items"], '{"id": 1, "extra": 1, "list": [6]}': ["list:items"], '{"id": 1, "extra": 1, "list": 6}': ["list:type"],
        "[]": ["payload:type"], "12": ["payload:type"], '{"id": 1': ["payload:json"], "": ["payload:json"], None: ["payload:missing"]}
    d = spark.createDataFrame([(t,) for t in rows], "payload string")
    found = {r.payload: sorted(f"{i.field}:{i.issue}" for i in r.issues) for r in Q.validate(d, Q.json_checks(schema)).collect()}
    assert found == rows


# -- folds -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("table_keys", [2, 100_000])
def test_folds_merge_over_tasks_and_full_tables(spark, table_keys):
    """Range times count: smallest, largest and number of values in one state."""
    def merge(a, b):
        return np.column_stack([np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 1], b[:, 1]), a[:, 2] + b[:, 2]])

    rng = np.random.default_rng(3)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.1 else f"k{rng.integers(0, 40)}", int(rng.integers(0, 3)), None if rng.random() < 0.1 else float(rng.normal())) for _ in range(3000)]
    d = spark.createDataFrame(rows, "k string, j int, v double").repartition(7)
    out = U.fold(d, ["k", "j"], "v", lambda x: np.column_stack([x, x, np.ones_like(x)]), merge, 3, lambda s: (s[:, 1] - s[:, 0]) * s[:, 2], table_keys=table_keys)
    want, got = {}, out.collect()
    for k, j, v in rows:
        if v is not None:
            want.setdefault((k, j), []).append(v)
    assert len(got) == len(want)
    for r in got:
        v = want[r.k, r.j]
        assert r.folded == pytest.approx((max(v) - min(v)) * len(v))


def test_one_state_per_key_and_task():
    keys = pd.DataFrame({"k": ["a", "b", "a", "a", None, "b", "a", None]})
    at_, states = U._reduced(keys, np.arange(8.0)[:, None], lambda a, b: a + b)
    assert at_["k"].tolist()[:2] == ["a", "b"] and states[:, 0].tolist() == [0 + 2 + 3 + 6, 1 + 5, 4 + 7]


# -- tails and references --------------------------------------------------------------------------------


@pytest.mark.parametrize("n,kind", [(1, "normal"), (7, "normal"), (3000, "normal"), (3000, "ties"), (500, "flat")])
def test_tail_means_equal_sorting(spark, n, kind):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, (n, 3)) if kind == "normal" else rng.integers(-2, 3, (n, 3)).astype(float) if kind == "ties" else np.ones((n, 3))
    w = np.array([[1.0, 0, 0], [0.5, 0.25, 0.25], [0, 0, 1.0], [0.2, 0.3, 0.5]])
    draws = pd.DataFrame(w, columns=["a", "b", "c"]).assign(draw=range(4))
    wide = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])).repartition(3)
    got = PF.tail_means(wide, ["a", "b", "c"], draws)
    for d, mine in zip(got["draw"], got["cvar_5"]):
        r = x @ w[d]
        q = np.quantile(r, 0.05)
        assert mine == pytest.approx(r[r <= q + 1e-12].mean(), abs=1e-9)
    if kind == "normal" and n > 1000:
        rows = spark.createDataFrame([(int(d), float(v)) for d in range(4) for v in x @ w[d]], "draw long, ret double")
        old = {r.draw: r.cvar_5 for r in expected_shortfall(rows, ["draw"], (0.05,)).collect()}
        assert all(old[d] == pytest.approx(v, abs=1e-9) for d, v in zip(got["draw"], got["cvar_5"]))


def test_a_reference_is_read_once(spark):
    path = scratch(spark, "reference")
    rng = np.random.default_rng(2)
    ref = pd.DataFrame({"x": rng.normal(0, 1, 300).round(2), "y": rng.integers(0, 5, 300).astype(float)})
    cur = pd.DataFrame({"x": rng.normal(0.3, 1, 200).round(2), "y": rng.integers(0, 6, 200).astype(float)})
    spark.createDataFrame(ref).write.parquet(path)
    stored, current = spark.read.parquet(path), spark.createDataFrame(cur)
    want = [f(stored, current, ["x", "y"]).orderBy("feature").toPandas() for f in (D.order_statistics, D.mean_tests, D.shared_histogram)]
    summary = D.summarize_reference(stored, ["x", "y"])
    remove_path(spark, path)  # whatever is compared from here on reads the summary
    got = [f(summary, current, ["x", "y"]).orderBy("feature").toPandas() for f in (D.order_statistics, D.mean_tests, D.shared_histogram)]
    for a, b in zip(want, got):
        keys = [c for c in ("feature", "bin") if c in a]
        a, b = (d.sort_values(keys).reset_index(drop=True) for d in (a, b))
        pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)
    assert math.isfinite(got[0]["ks"].max())


# -- retention, alerts, errors, choice of method ----------------------------------------------------------


def test_registered_retention_actions(spark):
    from quotemill.operators import governance as G

    path = scratch(spark, "actions")
    spark.range(10).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(int(id)) AS ts", "id % 2 AS part", "'x' AS name").write.partitionBy("part").parquet(path)
    seen = []
    G.register_action("count", lambda spark, path, condition, label: seen.append(label) or spark.read.parquet(path).filter(condition).count())
    now = F.lit("2024-01-11").cast("timestamp_ntz")
    try:
        done = G.apply_policies(spark, path, [("count", "5d", {"label": "old"}), ("blank", "7d", {"columns": ["name"]}), ("delete", "9d", {}), ("count", "INF", {"label": "never"})], now)
        with pytest.raises(ValueError):
            G.apply_policies(spark, path, [("unknown", "1d", {})], now)
    finally:
        G.ACTIONS.pop("count")
    assert done == [("count", "5d", 5), ("blank", "7d", 3), ("delete", "9d", 1), ("count", "INF", 0)] and seen == ["old"]
    left = {r.id: r.name for r in spark.read.parquet(path).collect()}
    assert left == {1: None, 2: None, **{i: "x" for i in range(3, 10)}}


def test_failing_rows_are_found_by_halving():
    from quotemill.operators.project import _tried

    calls = []

    def fn(b):
        calls.append(len(b))
        if (b["v"] < 0).any():
            raise ValueError("negative")
        return b["v"] * 2

    values, errors = _tried(fn, pd.DataFrame({"v": [*range(500), -1, *range(499)]}))
    assert values.count(None) == 1 and errors[500] == "ValueError: negative" and values[499] == 998 and len(calls) < 25


def test_choice_of_method(spark):
    assert [D.choose_method(k, f) for k, f in [("covariate", ["a"]), ("covariate", ["a", "b"]), ("concept", ["a"]), ("label", ["a"]), ("other", ["a"])]] == ["ks", "mahalanobis", "js", "chi2", "mahalanobis"]
    rng = np.random.default_rng(1)
    ref, cur = (spark.createDataFrame(pd.DataFrame({"a": rng.normal(m, 1, 400), "b": rng.normal(0, 1, 400)})) for m in (0, 5))
    for kind, features in [("covariate", ["a"]), ("covariate", ["a", "b"]), ("concept", ["a"])]:
        assert all(r.drift for r in D.detect(ref, cur, features, kind).collect()) and not any(r.drift for r in D.detect(ref, ref, features, kind).collect())
    with pytest.raises(ValueError):
        D.detect(ref, cur, ["a"], method="nothing")


def test_trades(spark):
    from quotemill.operators.ordered import Series

    prices, signals = [10.0, 11.0, 12.0, 9.0, 8.0, 8.0, 12.0, 15.0], [0, 1, 1, -1, -1, 0, 1, 1]
    rows = [("a", at(60 * i), i, p, s) for i, (p, s) in enumerate(zip(prices, signals))]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, tie long, close double, sig int")
    got = PF.backtest_trades(d, Series(keys=("symbol",), ts="ts", tie=("tie",)), "sig", fee=0.01, slippage=0.0).orderBy("entry_ts").collect()
    assert [(r.side, r.entry_price, r.exit_price, r.rows, r.status) for r in got] == [(1, 11, 9, 2, "closed"), (-1, 9, 8, 2, "closed"), (1, 12, 15, 2, "open")]
    assert [r.return_pct for r in got] == pytest.approx([(9 / 11 - 1 - 0.02) * 100, (-(8 / 9 - 1) - 0.02) * 100, (15 / 12 - 1 - 0.01) * 100])


def test_equal_failing_rows_are_asked_once():  # F12
    from quotemill.operators.project import _asker

    calls = []

    def fn(b):
        calls.append(len(b))
        assert list(b.columns) == ["v"]
        if (b["v"] < 10).any():
            raise ValueError(f"low {b['v'].iloc[0]}")
        return 1 / b["v"]

    ask, rng = _asker(fn, ["v"]), np.random.default_rng(2)
    for k in range(4):
        v = np.append(rng.integers(0, 50, 4000).astype(float), [np.nan, np.inf, -0.0, 0.0])
        values, errors = ask(pd.DataFrame({"id": range(len(v)), "v": v}))
        assert errors == [f"ValueError: low {x}" if x < 10 else None for x in v]
        assert all(a is None if x < 10 else np.isnan(a) if np.isnan(x) else a == 1 / x for a, x in zip(values, v))
        assert len(calls) < 60 + 4 * k


def test_capped_join_needs_little_per_key(monkeypatch):  # F11
    """A key of few rows costs no frame per step: one for what comes out, none for what is held."""
    from quotemill.streaming import joins

    class Held:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def put(self, value):
            self.value = value

        def clear(self):
            self.value = None

    made, frame = [], pd.DataFrame
    p = joins.CappedJoin(2, None, "right", ["key"])
    p.sides = [Held(), Held()]
    rows = [frame({"at_us": [3, 1], "tie": [3, 1], "side": [1, 0], "row": ["r3", "l1"]}), frame({"at_us": [2], "tie": [2], "side": [0], "row": ["l2"]})]
    monkeypatch.setattr(joins.pd, "DataFrame", lambda *a, **k: made.append(1) or frame(*a, **k))
    got = [x for out in p.handleInputRows(("a",), iter(rows), None) for x in out[["key", "l", "r"]].itertuples(index=False, name=None)]
    assert sorted(got) == [("a", "l1", "r3"), ("a", "l2", "r3")] and len(made) == 1
    assert p.sides[0].value == [(1, "l1"), (2, "l2")] and p.sides[1].value == [(3, "r3")]
    got = [x for out in p.handleInputRows(("a",), iter([frame({"at_us": [4], "tie": [4], "side": [0], "row": ["l4"]})]), None) for x in out[["key", "l", "r"]].itertuples(index=False, name=None)]
    assert got == [("a", "l4", "r3")] and p.sides[0].value == [(2, "l2"), (4, "l4")] and len(made) == 2

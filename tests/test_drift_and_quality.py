import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import drift as D
from quotemill.operators import quality as Q
from quotemill.operators.ordered import Series


@pytest.fixture(scope="module")
def levels(spark):
    rng = np.random.default_rng(0)

    def make(m1, s1, m2, s2, cats, p):
        return spark.createDataFrame(pd.DataFrame({"feature1": rng.normal(m1, s1, 1000), "feature2": rng.normal(m2, s2, 1000), "cat": rng.choice(cats, 1000, p=p)}))

    ref = make(0, 1, 5, 2, ["A", "B", "C"], [0.6, 0.3, 0.1])
    return {"ref": ref, "none": make(0, 1, 5, 2, ["A", "B", "C"], [0.6, 0.3, 0.1]), "mild": make(0.2, 1.1, 5.5, 2.1, ["A", "B", "C", "D"], [0.5, 0.3, 0.1, 0.1]),
            "severe": make(1.5, 2, 8, 3, ["D", "E", "F"], [0.4, 0.3, 0.3])}


F1 = ["feature1", "feature2"]


def test_levels_of_drift(levels):
    flags = {k: {r["feature"]: r["drift"] for r in D.ks_test(levels["ref"], levels[k], F1, 0.01).collect()} for k in ("none", "severe")}
    assert not any(flags["none"].values()) and all(flags["severe"].values())
    psi = [max(r["psi"] for r in D.binned_measures(D.shared_histogram(levels["ref"], levels[k], F1)).collect()) for k in ("none", "mild", "severe")]
    assert psi[0] < psi[1] < psi[2] and psi[2] >= 0.2
    cat = {k: D.chi_squared(D.category_measures(levels["ref"], levels[k], ["cat"])).first()["drift"] for k in ("none", "severe")}
    assert cat == {"none": False, "severe": True}


def test_divergence_bounds(levels):
    for k in ("none", "severe"):
        for r in D.binned_measures(D.shared_histogram(levels["ref"], levels[k], F1)).collect():
            assert 0 <= r["js_divergence"] <= np.log(2) + 1e-6 and r["js_distance"] == pytest.approx(np.sqrt(r["js_divergence"]))


def test_order_statistics_against_numpy(levels):
    a, b = (levels[k].select("feature1").toPandas()["feature1"].to_numpy() for k in ("ref", "mild"))
    r = D.order_statistics(levels["ref"], levels["mild"], ["feature1"]).first()
    grid = np.sort(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(x), grid, side="right") / len(x) for x in (a, b))
    assert r["ks"] == pytest.approx(np.abs(fa - fb).max())
    assert r["wasserstein"] == pytest.approx((np.abs(fa - fb)[:-1] * np.diff(grid)).sum())
    assert r["u"] == pytest.approx((a[:, None] > b[None, :]).sum())


def test_constant_series(spark):
    d = spark.createDataFrame([(1.0,)] * 20, "x double")
    r = D.order_statistics(d, d, ["x"]).first()
    assert r["ks"] == 0 and r["u_z"] is None
    assert D.binned_measures(D.shared_histogram(d, d, ["x"])).first()["psi"] == pytest.approx(0)
    assert D.mean_tests(d, d, ["x"]).first()["z"] is None


def test_multivariate(levels):
    near, far = (D.mean_distance(levels["ref"], levels[k], F1).first()[0] for k in ("none", "severe"))
    assert near < 0.2 < 1 < far
    ratio = {k: D.anomaly_ratio(levels["ref"], levels[k], F1, trees=20).first()["ratio"] for k in ("none", "severe")}
    assert ratio["none"] < 0.12 < ratio["severe"]
    mmd = {k: D.sample_mmd(levels["ref"], levels[k], F1).first()[0] for k in ("none", "severe")}
    assert mmd["none"] < 0.1 < mmd["severe"]


def test_severity_and_overall(spark):
    t = spark.createDataFrame([("a", 0.0004), ("b", 0.2)], "feature string, p_value double")
    r = D.overall(t).first()
    assert (r["feature"], r["severity"], r["drift"]) == ("a", "critical", True) and r["p_value"] == pytest.approx(0.0008)


def test_validation(spark):
    d = spark.createDataFrame([(1, "x", 5.0), (2, None, 50.0), (3, "y", -1.0), (4, "z", 95.0)], "id int, name string, v double")
    v = Q.validate(d, [Q.required("name"), *Q.limits("v", 0, 100, 1, 90)])
    assert [r["id"] for r in v.filter("valid").orderBy("id").collect()] == [1, 4]
    kinds = {(r["id"], r["issue"], r["severity"]) for r in Q.issue_rows(v, ["id"]).collect()}
    assert kinds == {(2, "missing", "error"), (3, "range", "error"), (4, "range", "warning")}


def test_rules_can_be_added(spark):
    Q.register_rule("even", lambda col: F.count_if(F.col(col) % 2 != 0))
    r = Q.check_rules(spark.range(5), [("even", "id"), ("unique", "id")]).collect()
    assert [(x["rule"], x["failures"], x["passed"]) for x in r] == [("even", 2, False), ("unique", 0, True)]
    assert Q.missing_columns(spark.range(1), ["id", "x"]) == ["x"]


@pytest.mark.parametrize("block", [2, 16384])
def test_alert_needs_time(spark, block):
    pdf = pd.DataFrame({"metric": "m", "ts": pd.date_range("2024-01-01", periods=7, freq="min"), "value": [0, 9, 9, 9, 0, 9, 9]})
    h = spark.createDataFrame(pdf, "metric string, ts timestamp_ntz, value double")
    s = Series(keys=("metric",), ts="ts", tie=(), slices=3, block_rows=block)
    got = [r["state"] for r in Q.alert_states(h, s, F.col("value") > 5, 120).orderBy("ts").collect()]
    assert got == ["ok", "pending", "pending", "triggered", "ok", "pending", "pending"]


def test_domain_classifier_fits_cells_of_equal_rows(spark, monkeypatch):
    """Rows count once per fold and combination of bins, however many there are; no row is lost and the verdict stays."""
    seen = {}

    def kept(df, label, inner=D.materialize):
        seen[label] = inner(df, label)
        return seen[label]

    monkeypatch.setattr(D, "materialize", kept)
    rows = spark.range(40_000).select((F.col("id") % 7).alias("x"), (F.col("id") % 1000 / 10).alias("y"))
    other = spark.range(10_000).select((F.col("id") % 7).alias("x"), (F.col("id") % 1000 / 10 + 50).alias("y"))
    same = D.domain_classifier(rows, rows.limit(20_000), ["x", "y"]).first()
    cells = seen["domain-cells"]
    assert cells.agg(F.sum("n")).first()[0] == 60_000 and cells.count() <= 5 * 2 * 7 * D.TREE_BINS
    apart = D.domain_classifier(rows, other, ["x", "y"]).first()
    assert abs(same["accuracy"] - 0.5) < 0.03 and not same["drift"] and abs(apart["accuracy"] - 0.75) < 0.03 and apart["drift"]


def test_bins_keep_every_value_of_a_column_with_few(spark):
    """A value that is rarer than a quantile step keeps a bin of its own; a constant has one bin."""
    df = spark.createDataFrame([(float(v), 1.0, float(k)) for k, v in enumerate([0] * 990 + [1] * 9 + [7])], "few double, one double, many double")
    got = D.binned(df, ["few", "one", "many"])
    n = {r["few"]: r["count"] for r in got.groupBy("few").count().collect()}
    assert n == {0.0: 990, 1.0: 9, 2.0: 1} and got.select("one").distinct().count() == 1
    sizes = [r["count"] for r in got.groupBy("many").count().collect()]
    assert len(sizes) == D.TREE_BINS and max(sizes) <= 40


def test_anomaly_ratio_scores_a_cell_once(spark, monkeypatch):
    """The share equals that of all rows' scores, with repeated, missing and undefined values; a value that repeats is scored once."""
    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"x": rng.integers(0, 9, n).astype(float), "y": rng.normal(0, 1, n).round(1), "cur": rng.random(n) < 0.4})
    pdf.loc[pdf["cur"] & (rng.random(n) < 0.1), "y"] += 3
    df = spark.createDataFrame(pdf).withColumn("x", F.expr("CASE WHEN cur AND y = 0.1 THEN NULL WHEN cur AND y = 0.2 THEN DOUBLE('NaN') ELSE x END")).repartition(1)
    ref, cur = df.filter("NOT cur").select("x", "y"), df.filter("cur").select("x", "y")
    base = D.isolation_scores(ref, ref, ["x", "y"], trees=10).toPandas()["anomaly_score"]
    mine = D.isolation_scores(ref, cur, ["x", "y"], trees=10).toPandas()["anomaly_score"]
    rows = []

    def scored(d, cols, forest, inner=D._scored):
        rows.append((d.count(), d.agg(F.sum("n")).first()[0]))
        return inner(d, cols, forest)

    monkeypatch.setattr(D, "_scored", scored)
    got = D.anomaly_ratio(ref, cur, ["x", "y"], trees=10).first()
    above = int((mine > np.quantile(base, 0.95)).sum())
    assert (got["outliers"], got["rows"]) == (above, len(mine)) and got["ratio"] == above / len(mine) and above > 0
    assert rows == [(rows[0][0], n)] and rows[0][0] <= df.distinct().count() < n / 2
    none = D.anomaly_ratio(ref, cur.limit(0), ["x", "y"], trees=2).first()
    assert (none["ratio"], none["outliers"], none["rows"]) == (None, 0, 0)

import math

import pytest

from quotemill.functions import scalars as S
from quotemill.functions import special as P


def test_distributions_match_published_tables():
    assert P.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert P.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert P.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert P.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert P.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)
    assert P.t_quantile(0.05, 1e6) == pytest.approx(-1.6448541, abs=1e-4)
    assert P.kolmogorov_sf(1.3580986393225505) == pytest.approx(0.05, abs=1e-6)
    assert P.binomial_upper(8, 10, 0.5) == pytest.approx(56 / 1024)
    assert P.unit_root_p(-2.86, 1) == pytest.approx(0.05, abs=2e-3)
    assert P.unit_root_p(-3.34, 2) == pytest.approx(0.05, abs=2e-3)


def test_durations():
    assert S.duration_seconds("1h30m") == 5400
    assert S.duration_seconds("2w") == 14 * 86400
    assert S.duration_seconds("INF") is None
    with pytest.raises(ValueError):
        S.duration_seconds("soon")


def test_scalar_columns(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("BTC-USD", 1704067200000.0, "50%_x", float("nan"))], "s string, ms double, t string, x double")
    r = d.select(S.normalize_symbol("s").alias("s"), S.parse_time("ms").alias("ts"), S.wildcard("t", "50%_?").alias("w"), S.wildcard("t", "*9*").alias("n"), S.clean_number("x").alias("x"),
                 S.message("{s} at {ms}", ms=F.col("ms").cast("long")).alias("m")).first()
    assert (r["s"], str(r["ts"]), r["w"], r["n"], r["x"], r["m"]) == ("BTC/USD", "2024-01-01 00:00:00", True, False, 0.0, "BTC-USD at 1704067200000")
    assert math.isfinite(r["x"])

"""Drift statistics: order prices and line-item measures before against after a date."""

from pyspark.sql import functions as F

from quotemill.operators import drift as D
from quotemill.plans.market import TICK_SERIES
from quotemill.plans.registry import R, chi_squared_tail, kolmogorov, normal_tails, query, rounded, student_tails

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUT = "1996-01-01"


def samples(t, *cols):
    li = t.lineitem.select("l_shipdate", *cols)
    return li.filter(f"l_shipdate < DATE'{CUT}'").select(*cols), li.filter(f"l_shipdate >= DATE'{CUT}'").select(*cols)


CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS feature, {x} AS v, (l_shipdate < DATE '{CUT}')::INT AS r, (l_shipdate >= DATE '{CUT}')::INT AS c FROM lineitem" for x in NUMS) + ")"
MERGED = CELLS + """, k AS (SELECT feature, v, sum(r) AS nr, sum(c) AS nc FROM cells GROUP BY 1, 2),
m AS (SELECT *, sum(nr) OVER w AS cr, sum(nc) OVER w AS cc, sum(nr) OVER (PARTITION BY feature) AS n, sum(nc) OVER (PARTITION BY feature) AS m, lead(v) OVER w AS nv FROM k WINDOW w AS (PARTITION BY feature ORDER BY v))"""


@query("ks_statistics", f"WITH {MERGED} SELECT feature, {R('max(abs(cr / n - cc / m))', 9)} AS ks FROM m GROUP BY 1")
def _ks(t):
    return rounded(D.order_statistics(*samples(t, *NUMS), NUMS).select("feature", "ks"), 9)


@query("ks_test", f"""WITH {MERGED}, s AS (SELECT feature, max(abs(cr / n - cc / m)) AS d, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m FROM m GROUP BY 1),
p AS (SELECT *, {kolmogorov('d * sqrt(n * m / (n + m))')} AS p FROM s)
SELECT feature, {R('d', 9)} AS statistic, n, m, {R('p', 9)} AS p_value, p < 0.05 AS drift FROM p""")
def _ks_test(t):
    return rounded(D.ks_test(*samples(t, *NUMS), NUMS), 9, "statistic", "p_value")


@query("wasserstein_and_energy", f"WITH {MERGED} SELECT feature, {R('sum(abs(cr / n - cc / m) * coalesce(nv - v, 0))')} AS wasserstein, {R('sqrt(2 * sum(pow(cr / n - cc / m, 2) * coalesce(nv - v, 0)))')} AS energy FROM m GROUP BY 1")
def _w1(t):
    return rounded(D.order_statistics(*samples(t, *NUMS), NUMS).select("feature", "wasserstein", "energy"))


@query("mann_whitney_statistics", f"""WITH {MERGED}, u AS (SELECT feature, sum(nr * (cc - nc / 2.0)) AS u, sum(pow(nr + nc, 3) - (nr + nc)) AS ties, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m FROM m GROUP BY 1)
SELECT feature, {R('u', 1)} AS u, {R('(u - n * m / 2) / sqrt(n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1))))')} AS u_z FROM u""")
def _mw(t):
    s = D.order_statistics(*samples(t, *NUMS), NUMS).select("feature", "u", "u_z")
    return rounded(rounded(s, 1, "u"), 6, "u_z")


@query("mann_whitney_test", f"""WITH {MERGED}, u AS (SELECT feature, sum(nr * (cc - nc / 2.0)) AS u, sum(pow(nr + nc, 3) - (nr + nc)) AS ties, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m FROM m GROUP BY 1),
z AS (SELECT *, (u - n * m / 2) / sqrt(n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1)))) AS z FROM u), p AS (SELECT *, {normal_tails('z')} AS p FROM z)
SELECT feature, {R('u', 1)} AS statistic, {R('z')} AS u_z, {R('p')} AS p_value, p < 0.05 AS drift FROM p""")
def _mwt(t):
    return rounded(rounded(D.mann_whitney(*samples(t, *NUMS), NUMS), 1, "statistic"), 6, "u_z", "p_value")


@query("anderson_darling", f"""WITH {MERGED}, a AS (SELECT feature, n::DOUBLE AS n, m::DOUBLE AS m, (nr + nc)::DOUBLE AS l, (cr + cc)::DOUBLE AS b, cr, cc FROM m)
SELECT feature, {R('sum(CASE WHEN b < n + m THEN l * (pow((n + m) * cr - n * b, 2) / n + pow((n + m) * cc - m * b, 2) / m) / (b * (n + m - b)) ELSE 0 END) / max(n + m)', 5)} AS anderson FROM a GROUP BY 1""")
def _ad(t):
    return rounded(D.order_statistics(*samples(t, *NUMS), NUMS).select("feature", "anderson"), 5)


HIST = CELLS + """, l AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM cells GROUP BY 1),
h0 AS (SELECT feature, CAST(least(floor((v - lo) / (hi - lo) * 10), 9) AS INT) AS bin, sum(r) AS nr, sum(c) AS nc FROM cells JOIN l USING (feature) GROUP BY 1, 2),
h AS (SELECT g.feature, g.bin, coalesce(nr, 0)::DOUBLE AS nr, coalesce(nc, 0)::DOUBLE AS nc FROM (SELECT feature, CAST(unnest(range(10)) AS INT) AS bin FROM l) g LEFT JOIN h0 USING (feature, bin)),
t AS (SELECT *, sum(nr) OVER (PARTITION BY feature) AS n, sum(nc) OVER (PARTITION BY feature) AS m FROM h),
pq AS (SELECT *, nr / n + 1e-10 AS p, nc / m + 1e-10 AS q, (nr + nc) * n / (n + m) AS er, (nr + nc) * m / (n + m) AS ec FROM t)"""


@query("binned_drift_measures", f"""WITH {HIST}, s AS (SELECT feature, (sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2 AS js, sum(p * ln(p / q)) AS kl, sum((p - q) * ln(p / q)) AS psi,
  sum(CASE WHEN nr + nc > 0 THEN pow(nr - er, 2) / er + pow(nc - ec, 2) / ec ELSE 0 END) AS chi2, count(*) FILTER (nr + nc > 0) - 1 AS dof FROM pq GROUP BY 1)
SELECT feature, {R('js', 9)} AS js_divergence, {R('sqrt(greatest(js, 0))', 8)} AS js_distance, {R('kl', 9)} AS kl, {R('psi', 9)} AS psi, {R('chi2')} AS chi2, CAST(dof AS BIGINT) AS dof,
  CASE WHEN psi >= 0.2 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS band FROM s""")
def _binned(t):
    m = D.binned_measures(D.shared_histogram(*samples(t, *NUMS), NUMS)).withColumn("band", D.stability_band())
    return rounded(rounded(rounded(m, 9, "js_divergence", "kl", "psi"), 8, "js_distance"), 6, "chi2")


@query("chi_squared_test", f"""WITH {HIST}, s AS (SELECT feature, sum(CASE WHEN nr + nc > 0 THEN pow(nr - er, 2) / er + pow(nc - ec, 2) / ec ELSE 0 END) AS chi2,
  count(*) FILTER (nr + nc > 0) - 1 AS dof FROM pq GROUP BY 1), p AS (SELECT *, {chi_squared_tail('chi2', 'dof')} AS p FROM s)
SELECT feature, {R('chi2')} AS chi2, CAST(dof AS BIGINT) AS dof, {R('p', 5)} AS p_value, p < 0.05 AS drift FROM p""")
def _chi_test(t):
    out = D.chi_squared(D.binned_measures(D.shared_histogram(*samples(t, *NUMS), NUMS))).select("feature", "chi2", "dof", "p_value", "drift")
    return rounded(rounded(out, 6, "chi2"), 5, "p_value")


CAT = f"""k AS (SELECT l_returnflag AS category, count(*) FILTER (l_shipdate < DATE '{CUT}')::DOUBLE AS nr, count(*) FILTER (l_shipdate >= DATE '{CUT}')::DOUBLE AS nc FROM lineitem GROUP BY 1),
t AS (SELECT *, sum(nr) OVER () AS n, sum(nc) OVER () AS m FROM k)"""


@query("category_chi_squared", f"WITH {CAT} SELECT 'l_returnflag' AS feature, {R('sum(pow(nr - (nr + nc) * n / (n + m), 2) / ((nr + nc) * n / (n + m)) + pow(nc - (nr + nc) * m / (n + m), 2) / ((nr + nc) * m / (n + m)))')} AS chi2, CAST(count(*) - 1 AS BIGINT) AS dof FROM t")
def _cat(t):
    return rounded(D.category_measures(*samples(t, "l_returnflag"), ["l_returnflag"]).select("feature", "chi2", "dof"))


@query("goodness_of_fit", f"WITH {CAT}, e AS (SELECT *, nr / n * m AS e FROM t) SELECT 'l_returnflag' AS feature, {R('sum(pow(nc - e, 2) / e)')} AS chi2, CAST(count(*) - 1 AS BIGINT) AS dof FROM e WHERE e >= 5")
def _gof(t):
    return rounded(D.goodness_of_fit(*samples(t, "l_returnflag"), "l_returnflag").select("feature", "chi2", "dof"))


MEANS = CELLS + """, s AS (SELECT feature, avg(v) FILTER (r = 1) AS mr, avg(v) FILTER (c = 1) AS mc, stddev_samp(v) FILTER (r = 1) AS sr, stddev_samp(v) FILTER (c = 1) AS sc, sum(r) AS n, sum(c) AS m FROM cells GROUP BY 1)"""


@query("mean_tests", f"""WITH {MEANS} SELECT feature, {R('(mc - mr) / (sr / sqrt(m))')} AS z, {R('(mc - mr) / sqrt(sr * sr / n + sc * sc / m)')} AS t,
  {R('pow(sr * sr / n + sc * sc / m, 2) / (pow(sr * sr / n, 2) / (n - 1) + pow(sc * sc / m, 2) / (m - 1))', 3)} AS t_dof, {R('abs(mc - mr) / sr')} AS mean_shift, {R('sc / sr')} AS std_ratio FROM s""")
def _means(t):
    s = D.mean_tests(*samples(t, *NUMS), NUMS).select("feature", "z", "t", "t_dof", "mean_shift", "std_ratio")
    return rounded(rounded(s, 3, "t_dof"), 6, "z", "t", "mean_shift", "std_ratio")


@query("mean_test_p_values", f"""WITH {MEANS}, z AS (SELECT feature, (mc - mr) / (sr / sqrt(m)) AS z, (mc - mr) / sqrt(sr * sr / n + sc * sc / m) AS t,
  pow(sr * sr / n + sc * sc / m, 2) / (pow(sr * sr / n, 2) / (n - 1) + pow(sc * sc / m, 2) / (m - 1)) AS v FROM s), p AS (SELECT feature, {normal_tails('z')} AS zp, {student_tails('t', 'v')} AS tp FROM z)
SELECT feature, {R('zp')} AS z_p, {R('tp')} AS t_p, CASE WHEN tp < 0.001 THEN 'critical' WHEN tp < 0.01 THEN 'high' WHEN tp < 0.05 THEN 'medium' WHEN tp < 0.1 THEN 'low' ELSE 'none' END AS severity FROM p""")
def _mean_p(t):
    m = D.mean_test_p(D.mean_tests(*samples(t, *NUMS), NUMS))
    return rounded(m.select("feature", "z_p", "t_p", D.severity("t_p").alias("severity")), 6)


@query("overall_drift", f"""WITH {MERGED}, s AS (SELECT feature, max(abs(cr / n - cc / m)) * sqrt(max(n) * max(m) / (max(n) + max(m))) AS x FROM m GROUP BY 1), p AS (SELECT feature, {kolmogorov('x')} AS p FROM s),
o AS (SELECT least(min(p) * count(p), 1.0) AS p, arg_min(feature, p) AS feature FROM p)
SELECT {R('p', 9)} AS p_value, feature, CASE WHEN p < 0.001 THEN 'critical' WHEN p < 0.01 THEN 'high' WHEN p < 0.05 THEN 'medium' WHEN p < 0.1 THEN 'low' ELSE 'none' END AS severity, p < 0.05 AS drift FROM o""")
def _overall(t):
    return rounded(D.overall(D.ks_test(*samples(t, *NUMS), NUMS)), 9, "p_value")


@query("mean_distance", f"""WITH a AS (SELECT avg(l_quantity) AS x, avg(l_discount) AS y, var_samp(l_quantity) AS sxx, var_samp(l_discount) AS syy, covar_samp(l_quantity, l_discount) AS sxy FROM lineitem WHERE l_shipdate < DATE '{CUT}'),
b AS (SELECT avg(l_quantity) AS x, avg(l_discount) AS y FROM lineitem WHERE l_shipdate >= DATE '{CUT}')
SELECT {R('sqrt((pow(b.x - a.x, 2) * syy - 2 * (b.x - a.x) * (b.y - a.y) * sxy + pow(b.y - a.y, 2) * sxx) / (sxx * syy - sxy * sxy))', 8)} AS distance FROM a, b""")
def _mdist(t):
    return rounded(D.mean_distance(*samples(t, "l_quantity", "l_discount"), ["l_quantity", "l_discount"]), 8)


_CHOSEN_KS = CELLS + """, kc AS (SELECT v, sum(r) AS nr, sum(c) AS nc FROM cells WHERE feature = 'l_quantity' GROUP BY 1),
kr AS (SELECT sum(nr) OVER (ORDER BY v) AS cr, sum(nc) OVER (ORDER BY v) AS cc, sum(nr) OVER () AS n, sum(nc) OVER () AS m FROM kc),
ks AS (SELECT max(abs(cr / n - cc / m)) AS d, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m FROM kr)"""


@query("chosen_method", f"""WITH {_CHOSEN_KS}, {CAT}, x AS (SELECT sum(pow(nr - (nr + nc) * n / (n + m), 2) / ((nr + nc) * n / (n + m)) + pow(nc - (nr + nc) * m / (n + m), 2) / ((nr + nc) * m / (n + m))) AS chi2, count(*) - 1 AS dof FROM t),
a AS (SELECT avg(l_quantity) AS x, avg(l_discount) AS y, var_samp(l_quantity) AS sxx, var_samp(l_discount) AS syy, covar_samp(l_quantity, l_discount) AS sxy FROM lineitem WHERE l_shipdate < DATE '{CUT}'),
b AS (SELECT avg(l_quantity) AS x, avg(l_discount) AS y FROM lineitem WHERE l_shipdate >= DATE '{CUT}'),
o AS (SELECT 'covariate' AS kind, 'l_quantity' AS feature, 'ks' AS method, d AS statistic, {kolmogorov('d * sqrt(n * m / (n + m))')} AS p FROM ks
UNION ALL SELECT 'covariate', 'l_quantity,l_discount', 'mahalanobis', sqrt((pow(b.x - a.x, 2) * syy - 2 * (b.x - a.x) * (b.y - a.y) * sxy + pow(b.y - a.y, 2) * sxx) / (sxx * syy - sxy * sxy)), NULL FROM a, b
UNION ALL SELECT 'label', 'l_returnflag', 'chi2', chi2, {chi_squared_tail('chi2', 'dof')} FROM x)
SELECT kind, feature, method, {R('statistic', 5)} AS statistic, {R('p', 5)} AS p_value, CASE method WHEN 'mahalanobis' THEN statistic > 3 ELSE p < 0.05 END AS drift FROM o""")
def _chosen(t):
    """Drift of one feature, of two together and of a label, each by the method chosen for it."""
    asked = [("covariate", ["l_quantity"]), ("covariate", ["l_quantity", "l_discount"]), ("label", ["l_returnflag"])]
    parts = [D.detect(*samples(t, *f), f, kind).withColumn("kind", F.lit(kind)) for kind, f in asked]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 5, "statistic", "p_value")


@query("mahalanobis_outliers", f"""WITH a AS (SELECT avg(l_quantity) AS x, avg(l_discount) AS y, var_samp(l_quantity) AS sxx, var_samp(l_discount) AS syy, covar_samp(l_quantity, l_discount) AS sxy FROM lineitem WHERE l_shipdate < DATE '{CUT}'),
d AS (SELECT l_shipdate >= DATE '{CUT}' AS cur, sqrt((pow(l_quantity - x, 2) * syy - 2 * (l_quantity - x) * (l_discount - y) * sxy + pow(l_discount - y, 2) * sxx) / (sxx * syy - sxy * sxy)) AS d FROM lineitem, a),
q AS (SELECT quantile_cont(d, 0.95) AS th FROM d WHERE NOT cur)
SELECT {R('max(th)')} AS threshold, {R('avg((d > th + 1e-9)::INT)', 4)} AS ratio FROM d, q WHERE cur""")
def _outliers(t):
    return rounded(rounded(D.outlier_ratio(*samples(t, "l_quantity", "l_discount"), ["l_quantity", "l_discount"]).select("threshold", "ratio"), 6, "threshold"), 4, "ratio")


@query("outlier_excess")
def _excess(t):
    return D.outlier_excess(D.outlier_ratio(*samples(t, *NUMS), NUMS))


@query("isolation_scores")
def _iso(t):
    ref, cur = samples(t, *NUMS)
    return D.isolation_scores(ref, cur, NUMS).agg(F.count(F.lit(1)).alias("rows"), F.avg("anomaly_score").alias("mean_score"), F.max("anomaly_score").alias("max_score"))


@query("anomaly_ratio")
def _ratio(t):
    return D.anomaly_ratio(*samples(t, *NUMS), NUMS)


@query("domain_classifier")
def _domain(t):
    return D.domain_classifier(*samples(t, *NUMS), NUMS, folds=5)


@query("accuracy_drop")
def _accuracy(t):
    return D.accuracy_drop(*samples(t, *NUMS, "l_returnflag"), NUMS, "l_returnflag")


@query("column_roles", "SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_totalprice', 'numeric'), ('o_orderstatus', 'categorical'), ('o_orderpriority', 'categorical')) v(\"column\", role)")
def _roles(t):
    return D.infer_roles(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"))


REPORT = f"""{MERGED}{HIST[len(CELLS):]}{MEANS[len(CELLS):]}, ck AS ({CAT.split('AS (', 1)[1].split('),', 1)[0]}), ct AS (SELECT *, sum(nr) OVER () AS n, sum(nc) OVER () AS m FROM ck),
o AS (SELECT feature, max(abs(cr / n - cc / m)) AS ks, sum(abs(cr / n - cc / m) * coalesce(nv - v, 0)) AS w, sum(nr * (cc - nc / 2.0)) AS u, sum(pow(nr + nc, 3) - (nr + nc)) AS ties, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m FROM m GROUP BY 1),
oz AS (SELECT *, (u - n * m / 2) / sqrt(n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1)))) AS z, ks * sqrt(n * m / (n + m)) AS x FROM o),
bm AS (SELECT feature, sqrt(greatest((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 0)) AS js, sum(p * ln(p / q)) AS kl, sum((p - q) * ln(p / q)) AS psi FROM pq GROUP BY 1),
mt AS (SELECT feature, (mc - mr) / sqrt(sr * sr / n + sc * sc / m) AS t, pow(sr * sr / n + sc * sc / m, 2) / (pow(sr * sr / n, 2) / (n - 1) + pow(sc * sc / m, 2) / (m - 1)) AS v FROM s),
cq AS (SELECT sum(pow(nr - (nr + nc) * n / (n + m), 2) / ((nr + nc) * n / (n + m)) + pow(nc - (nr + nc) * m / (n + m), 2) / ((nr + nc) * m / (n + m))) AS chi2, count(*) - 1 AS dof FROM ct),
rep AS (SELECT feature, 'ks' AS method, ks AS statistic, {kolmogorov('x')} < 0.05 AS drift FROM oz UNION ALL SELECT feature, 'wasserstein', w, w > 0.1 FROM oz
 UNION ALL SELECT feature, 'mann_whitney', u, {normal_tails('z')} < 0.05 FROM oz UNION ALL SELECT feature, 'js', js, js > 0.1 FROM bm UNION ALL SELECT feature, 'psi', psi, psi >= 0.2 FROM bm
 UNION ALL SELECT feature, 'kl', kl, kl > 0.1 FROM bm UNION ALL SELECT feature, 'welch', t, {student_tails('t', 'v')} < 0.05 FROM mt UNION ALL SELECT 'l_returnflag', 'chi2', chi2, {chi_squared_tail('chi2', 'dof')} < 0.05 FROM cq)"""


@query("drift_report", f"WITH {REPORT} SELECT feature, method, {R('statistic', 5)} AS statistic, drift FROM rep")
def _report(t):
    return rounded(D.drift_report(*samples(t, *NUMS, "l_returnflag"), NUMS, ["l_returnflag"]), 5, "statistic")


@query("drift_report_summary", f"WITH {REPORT} SELECT feature, count(*) AS methods, count(*) FILTER (drift) AS flags, avg(drift::INT) AS ratio FROM rep GROUP BY 1")
def _summary(t):
    return D.report_summary(D.drift_report(*samples(t, *NUMS, "l_returnflag"), NUMS, ["l_returnflag"]))


@query("kernel_discrepancy")
def _mmd(t):
    return D.sample_mmd(*samples(t, *NUMS), NUMS)


@query("reference_window", "SELECT event_type AS symbol, event_id AS tie, value AS price FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 300")
def _window(t):
    return D.reference_window(t.ticks, TICK_SERIES, 300).select("symbol", "tie", "price")

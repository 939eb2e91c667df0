"""Distribution drift between a reference and a current sample, one result row per feature.

Order statistics (KS, Wasserstein, Mann-Whitney, energy, Anderson-Darling) come from one table of distinct
values with running counts of both samples; binned measures from one shared histogram; tests of means from
plain aggregates.  p-values are closed forms on the result rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.special import binomial_upper, chi2_sf, ks_p, normal_two_sided, on_rows, t_two_sided
from quotemill.operators.joins import category_counts
from quotemill.operators.ordered import Series, attach, quantiles, running_totals
from quotemill.operators.rolling import newest_per_key
from quotemill.operators.stats import bin_index
from quotemill.session import materialize

EPS = 1e-10
c = F.col

# P-value bounds and their severities, index bounds of the stability index.
SEVERITY_BANDS = ((0.001, "critical"), (0.01, "high"), (0.05, "medium"), (0.1, "low"))
STABILITY_BANDS = ((0.2, "significant"), (0.1, "moderate"))


@dataclass(frozen=True)
class ReferenceSummary:
    """A reference read once: its distinct values with counts, and its moments, per feature.  It stands for the reference
    wherever numeric samples are compared.
    """

    counts: DataFrame
    moments: DataFrame


def summarize_reference(ref: DataFrame, features: Sequence[str]) -> ReferenceSummary:
    """Both tables are written, so that no comparison reads the reference again."""
    counts = materialize(long_form(ref, ref.limit(0), features).groupBy("feature", "value").agg(F.sum("r").alias("n")), "reference-counts")
    return ReferenceSummary(counts, materialize(_side_moments(ref, features), "reference-moments"))


def long_form(ref: DataFrame | ReferenceSummary, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, r, c): one row per feature and record (or per value of a summary); nulls are left out."""
    def side(df: DataFrame | ReferenceSummary, r: int) -> DataFrame:
        if isinstance(df, ReferenceSummary):
            return df.counts.filter(F.col("feature").isin(list(features))).select("feature", "value", F.col("n").alias("r"), F.lit(0).alias("c"))
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
        return df.select(cells.alias("x")).select("x.*", F.lit(r).alias("r"), F.lit(1 - r).alias("c")).filter("value IS NOT NULL")

    return side(ref, 1).unionByName(side(cur, 0))


def merged_counts(ref: DataFrame | ReferenceSummary, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct values with counts and running counts of both samples, plus the sample sizes N and M."""
    counts = long_form(ref, cur, features).groupBy("feature", "value").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    counts = materialize(counts, "value-counts")  # read for totals, cuts, slices and running counts
    totals = counts.groupBy("feature").agg(F.sum("n_ref").alias("N"), F.sum("n_cur").alias("M"))
    return running_totals(counts, "value", ["n_ref", "n_cur"], ["feature"]).join(F.broadcast(totals), "feature")


def order_statistics(ref: DataFrame | ReferenceSummary, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """KS, Wasserstein-1, Mann-Whitney U with tie-corrected z, energy and Anderson-Darling statistics per feature."""
    m = merged_counts(ref, cur, features)
    # An empty sample has no distribution: every comparison with it is null.
    f1, f2, step = F.try_divide("cum_n_ref", "N"), F.try_divide("cum_n_cur", "M"), F.coalesce(c("next_value") - c("value"), F.lit(0.0))
    t = (c("n_ref") + c("n_cur")).cast("double")
    seen, total = (c("cum_n_ref") + c("cum_n_cur")).cast("double"), (c("N") + c("M")).cast("double")
    def ad(cum: str, n: str) -> Column:
        return F.when(seen < total, t * F.pow(total * c(cum) - c(n) * seen, F.lit(2.0)) / (seen * (total - seen))).otherwise(0.0) / F.nullif(c(n), F.lit(0))

    out = m.groupBy("feature").agg(
        F.max(F.abs(f1 - f2)).alias("ks"), F.sum(F.abs(f1 - f2) * step).alias("wasserstein"),
        F.sqrt(2 * F.sum((f1 - f2) * (f1 - f2) * step)).alias("energy"),
        (F.sum(ad("cum_n_ref", "N") + ad("cum_n_cur", "M")) / F.max(total)).alias("anderson"),
        F.sum(c("n_ref") * (c("cum_n_cur") - c("n_cur") / 2)).alias("u"), F.sum(t * t * t - t).alias("_ties"),
        F.max(c("N").cast("double")).alias("n"), F.max(c("M").cast("double")).alias("m"))
    size = c("n") + c("m")
    sd = F.sqrt(c("n") * c("m") / 12 * ((size + 1) - F.try_divide(c("_ties"), size * (size - 1))))
    return out.withColumn("u_z", F.try_divide(c("u") - c("n") * c("m") / 2, sd)).drop("_ties")


def ks_test(ref: DataFrame, cur: DataFrame, features: Sequence[str], alpha: float = 0.05) -> DataFrame:
    s = order_statistics(ref, cur, features).select("feature", c("ks").alias("statistic"), "n", "m")
    s = s.withColumn("p_value", on_rows(ks_p, "statistic", "n", "m"))
    return s.withColumn("drift", c("p_value") < alpha)


def mann_whitney(ref: DataFrame, cur: DataFrame, features: Sequence[str], alpha: float = 0.05) -> DataFrame:
    s = order_statistics(ref, cur, features).select("feature", c("u").alias("statistic"), "u_z")
    s = s.withColumn("p_value", on_rows(normal_two_sided, "u_z"))
    return s.withColumn("drift", c("p_value") < alpha)


# -- binned ----------------------------------------------------------------------------------------------


def shared_histogram(ref: DataFrame | ReferenceSummary, cur: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins over the joint range; every bin of every feature is present."""
    cells = long_form(ref, cur, features)
    limits = cells.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    counts = cells.join(F.broadcast(limits), "feature").groupBy("feature", bin_index("value", bins).alias("bin")).agg(
        F.sum("r").alias("_r"), F.sum("c").alias("_c"))
    grid = limits.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", F.coalesce("_r", F.lit(0)).alias("n_ref"), F.coalesce("_c", F.lit(0)).alias("n_cur"))


def binned_measures(hist: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Jensen-Shannon divergence and distance, KL divergence, population stability index, chi-squared and its dof."""
    keys = list(keys)
    totals = hist.groupBy(*keys).agg(F.sum("n_ref").alias("N"), F.sum("n_cur").alias("M"))
    h = hist.join(totals, keys)
    p, q = F.try_divide("n_ref", "N") + EPS, F.try_divide("n_cur", "M") + EPS  # null if a sample is empty
    h = h.withColumns({"_p": p, "_q": q}).withColumn("_m", (c("_p") + c("_q")) / 2)
    both, size = (c("n_ref") + c("n_cur")).cast("double"), (c("N") + c("M")).cast("double")
    er, ec = F.try_divide(both * c("N"), size), F.try_divide(both * c("M"), size)
    chi = F.when(both > 0, F.try_divide(F.pow(c("n_ref") - er, F.lit(2.0)), er) + F.try_divide(F.pow(c("n_cur") - ec, F.lit(2.0)), ec)).otherwise(0.0)
    js = (F.sum(c("_p") * F.log(c("_p") / c("_m"))) + F.sum(c("_q") * F.log(c("_q") / c("_m")))) / 2
    return h.groupBy(*keys).agg(
        js.alias("js_divergence"), F.sqrt(F.greatest(js, F.lit(0.0))).alias("js_distance"),
        F.sum(c("_p") * F.log(c("_p") / c("_q"))).alias("kl"), F.sum((c("_p") - c("_q")) * F.log(c("_p") / c("_q"))).alias("psi"),
        F.sum(chi).alias("chi2"), (F.count_if(both > 0) - 1).alias("dof"))


def stability_band(psi: str = "psi") -> Column:
    out = F.lit("stable")
    for bound, name in reversed(STABILITY_BANDS):
        out = F.when(c(psi) >= bound, name).otherwise(out)
    return out


def chi_squared(measures: DataFrame, alpha: float = 0.05) -> DataFrame:
    s = measures.withColumn("p_value", on_rows(chi2_sf, "chi2", c("dof").cast("double")))
    return s.withColumn("drift", c("p_value") < alpha)


def category_measures(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """The binned measures with categories as bins."""
    parts = None
    for f in features:
        h = category_counts(ref, cur, f).withColumn("feature", F.lit(f))
        parts = h if parts is None else parts.unionByName(h)
    return binned_measures(parts)


def goodness_of_fit(ref: DataFrame, cur: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    """Chi-squared of current counts against reference shares, over cells whose expected count is at least 5."""
    h = category_counts(ref, cur, col)
    h = attach(h, h.agg(F.sum("n_ref").alias("N"), F.sum("n_cur").alias("M")))
    e = F.try_divide("n_ref", "N") * c("M")
    out = h.withColumn("_e", e).filter("_e >= 5").agg(
        F.sum(F.pow(c("n_cur") - c("_e"), F.lit(2.0)) / c("_e")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))
    return chi_squared(out.withColumn("feature", F.lit(col)), alpha)


# -- means -----------------------------------------------------------------------------------------------


def _side_moments(side: DataFrame | ReferenceSummary, features: Sequence[str]) -> DataFrame:
    """Mean, deviation and count of each feature's values."""
    if isinstance(side, ReferenceSummary):
        return side.moments.filter(F.col("feature").isin(list(features)))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    return side.select(cells.alias("x")).filter("x.value IS NOT NULL").groupBy("x.feature").agg(
        F.avg("x.value").alias("mean"), F.stddev_samp("x.value").alias("std"), F.count("x.value").alias("size"))


def mean_tests(ref: DataFrame | ReferenceSummary, cur: DataFrame, features: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """z-test against the reference, Welch t, mean shift in reference deviations, deviation ratio."""
    a, b = _side_moments(ref, features), _side_moments(cur, features)
    s = (a.withColumnsRenamed({"mean": "mean_ref", "std": "std_ref", "size": "n"}).join(b.withColumnsRenamed({"mean": "mean_cur", "std": "std_cur", "size": "m"}), "feature", "full")
         .select("feature", "mean_ref", "mean_cur", "std_ref", "std_cur", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m")))
    d = c("mean_cur") - c("mean_ref")
    vr, vc = F.try_divide(c("std_ref") * c("std_ref"), c("n")), F.try_divide(c("std_cur") * c("std_cur"), c("m"))
    s = s.withColumns(
        {
            "z": F.try_divide(d * F.sqrt(c("m")), c("std_ref")),
            "t": F.try_divide(d, F.sqrt(vr + vc)),
            "t_dof": F.try_divide((vr + vc) * (vr + vc), F.try_divide(vr * vr, c("n") - 1) + F.try_divide(vc * vc, c("m") - 1)),
            "mean_shift": F.try_divide(F.abs(d), c("std_ref")),
            "std_ratio": F.try_divide(c("std_cur"), c("std_ref")),
        }
    )
    return s


def mean_test_p(tests: DataFrame) -> DataFrame:
    return tests.withColumns({"z_p": on_rows(normal_two_sided, "z"), "t_p": on_rows(t_two_sided, "t", "t_dof")})


def severity(p: str | Column) -> Column:
    col = c(p) if isinstance(p, str) else p
    out = F.lit("none")
    for bound, name in reversed(SEVERITY_BANDS):
        out = F.when(col < bound, name).otherwise(out)
    return out


def overall(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Smallest p-value times the number of features, and its severity."""
    a = tests.agg(F.least(F.min(p) * F.count(p), F.lit(1.0)).alias("p_value"), F.min_by("feature", p).alias("feature"))
    return a.withColumns({"severity": severity("p_value"), "drift": c("p_value") < alpha})


# -- multivariate ----------------------------------------------------------------------------------------


def _moments(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and covariance matrix from one aggregate of bounded width."""
    aggs = [F.avg(x) for x in cols] + [F.covar_samp(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = [float(v) for v in df.dropna(subset=list(cols)).agg(*aggs).first()]
    k, cov, values = len(cols), np.zeros((len(cols), len(cols))), iter(row[len(cols):])
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = next(values)
    return np.array(row[:k]), cov


def _squared_distance(cols: Sequence[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    d = [c(x) - float(m) for x, m in zip(cols, mean)]
    return sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0))


def mean_distance(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mahalanobis distance between the two mean vectors under the reference covariance."""
    mean, cov = _moments(ref, cols)
    means = cur.agg(*[F.avg(x).alias(x) for x in cols])
    return means.select(F.sqrt(_squared_distance(cols, mean, np.linalg.inv(cov))).alias("distance"))


def outlier_ratio(ref: DataFrame, cur: DataFrame, cols: Sequence[str], percentile: float = 0.95) -> DataFrame:
    """Share of current rows farther from the reference mean than the reference's own 95th percentile."""
    mean, cov = _moments(ref, cols)
    dist = F.sqrt(_squared_distance(cols, mean, np.linalg.inv(cov)))
    limit = quantiles(ref.select(dist.alias("d")), "d", [percentile], names=["threshold"])
    far = attach(cur.select(dist.alias("d")), limit)
    return far.agg(F.max("threshold").alias("threshold"), F.avg((c("d") > c("threshold")).cast("double")).alias("ratio"),
                   F.count_if(c("d") > c("threshold")).alias("outliers"), F.count("d").alias("rows"))


def outlier_excess(ratios: DataFrame, expected: float = 0.05) -> DataFrame:
    """Binomial tail of the number of outliers."""
    return ratios.withColumn("p_value", on_rows(lambda k, n: binomial_upper(k, n, expected), c("outliers").cast("double"), c("rows").cast("double")))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int):
    """An isolation tree as nested tuples: (feature, cut, left, right) or the leaf's path-length correction."""
    n = len(x)
    spread = x.max(axis=0) > x.min(axis=0) if n else np.array([False])
    if depth == 0 or n <= 1 or not spread.any():
        return _average_path(n)
    f = int(rng.choice(np.flatnonzero(spread)))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return f, cut, _grow(x[left], rng, depth - 1), _grow(x[~left], rng, depth - 1)


def _average_path(n: int) -> float:
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _flat(tree) -> tuple[np.ndarray, ...]:
    """A tree as arrays over its nodes: feature, cut, left, right and a leaf's path length; a leaf leads to itself."""
    feature, cut, left, right, length = [], [], [], [], []

    def add(node, depth: int) -> int:
        k = len(feature)
        leaf = not isinstance(node, tuple)
        for values, v in ((feature, 0 if leaf else node[0]), (cut, 0.0 if leaf else node[1]), (left, k), (right, k), (length, depth + node if leaf else 0.0)):
            values.append(v)
        if not leaf:
            left[k], right[k] = add(node[2], depth + 1), add(node[3], depth + 1)
        return k

    add(tree, 0)
    return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(length, dtype="float64")


def _path_lengths(flat: tuple[np.ndarray, ...], x: np.ndarray, depth: int) -> np.ndarray:
    """Path length of every row: all rows go down a level at a time."""
    feature, cut, left, right, length = flat
    rows, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for _ in range(depth):
        at = np.where(x[rows, feature[at]] < cut[at], left[at], right[at])
    return length[at]


@dataclass(frozen=True)
class _Forest:
    """Flattened isolation trees, their depth limit and the path length that a score is relative to."""

    trees: list
    depth: int
    norm: float

    def cuts(self, k: int) -> list[float]:
        """All values at which any tree cuts feature ``k``."""
        return sorted({float(v) for feature, cut, left, *_ in self.trees for v in cut[(feature == k) & (left != np.arange(len(left)))]})


def _isolation_forest(ref: DataFrame, cols: Sequence[str], trees: int, sample: int, seed: int) -> _Forest:
    """Every tree draws its own ``sample`` rows from all rows of the reference (seed, tree and the row's place in a written
    copy decide) and grows in a task of its own."""
    rows = materialize(ref.select(*[c(x).cast("double").alias(x) for x in cols]).dropna(), "isolation")
    n = rows.count()
    take = min(sample, n)
    depth = max(1, math.ceil(math.log2(max(take, 2))))
    bound = min(1.0, (2.0 * take + 50) / max(n, 1)) * (1 << 30)  # a thinned draw, cut to exactly ``take`` rows below
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, c("_row")), F.lit(1 << 30))
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("h")))
    placed = rows.withColumn("_row", F.monotonically_increasing_id())
    # Plain expressions find the rows that any tree draws, as most are drawn by none; the list of draws is made for those alone.
    placed = placed.filter(F.array_min(F.array(*[draw(F.lit(t)) for t in range(trees)])) <= bound)
    chosen = placed.withColumn("_d", F.explode(F.filter(draws, lambda d: d["h"] <= bound)))
    order = Window.partitionBy("tree").orderBy("h", *cols)
    chosen = chosen.select("_d.tree", "_d.h", *cols).withColumn("_rank", F.row_number().over(order)).filter(c("_rank") <= take)

    def grow(key, part):
        tree = _grow(part.sort_values(["h", *cols])[cols].to_numpy(), np.random.default_rng([seed, int(key[0])]), depth)
        return pd.DataFrame({"tree": [int(key[0])], "nodes": [pickle.dumps(tree)]})

    grown = chosen.groupBy("tree").applyInPandas(grow, "tree int, nodes binary").orderBy("tree").collect()
    return _Forest([_flat(pickle.loads(r["nodes"])) for r in grown], depth, _average_path(take) or 1.0)


def _scored(df: DataFrame, cols: Sequence[str], forest: _Forest) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(forest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", anomaly_score double"

    def score(batches):
        f = shipped.value
        for b in batches:
            x = b[cols].to_numpy(dtype="float64")
            total = np.zeros(len(x))
            for tree in f.trees:
                total += _path_lengths(tree, x, f.depth)
            yield b.assign(anomaly_score=np.power(2.0, -total / max(len(f.trees), 1) / f.norm))

    return df.mapInPandas(score, schema)


def isolation_scores(ref: DataFrame, df: DataFrame, cols: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation-forest score in (0, 1) per row of ``df``; scoring is a pass over Arrow batches with the trees (``trees`` x
    ``sample`` nodes at most) shipped to the tasks."""
    cols = list(cols)
    return _scored(df, cols, _isolation_forest(ref, cols, trees, sample, seed))


def anomaly_ratio(ref: DataFrame, cur: DataFrame, cols: Sequence[str], contamination: float = 0.05, trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """Share of current rows scoring above the reference's own (1 - contamination) quantile.

    Rows between the same cuts of all features go down the trees alike, so rows are counted per such cell, one row of a cell is
    scored, and the quantile and the share are those of the counts: the scores of all rows, each worked out once.
    """
    cols = list(cols)
    forest = _isolation_forest(ref, cols, trees, sample, seed)
    both = ref.select(*cols, F.lit(0).alias("is_current")).unionByName(cur.select(*cols, F.lit(1).alias("is_current")))
    both = both.select("is_current", *[c(x).cast("double").alias(x) for x in cols])
    points = [[-math.inf, *(forest.cuts(k) or [0.0]), math.inf] for k in range(len(cols))]
    cut = Bucketizer(splitsArray=points, inputCols=cols, outputCols=[f"_in_{x}" for x in cols], handleInvalid="keep")
    cells = cut.transform(both).groupBy("is_current", *[f"_in_{x}" for x in cols]).agg(F.count(F.lit(1)).alias("n"), *[F.min(x).alias(x) for x in cols])
    scored = _scored(cells.select("is_current", "n", *cols), cols, forest).groupBy("is_current", "anomaly_score").agg(F.sum("n").alias("n"))
    scored = materialize(scored, "anomaly-scores")
    limit = quantiles(scored.filter("is_current = 0"), "anomaly_score", [1 - contamination], names=["threshold"], count="n")
    above = attach(scored.filter("is_current = 1"), limit).withColumn("above", c("anomaly_score") > c("threshold"))
    some = lambda cond: F.sum(F.when(cond, c("n")).otherwise(0))
    return above.agg(F.try_divide(some(c("above")).cast("double"), some(c("above").isNotNull()).cast("double")).alias("ratio"),
                     F.coalesce(some(c("above")), F.lit(0)).alias("outliers"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


# Bins per feature of the domain classifier: as many as its trees look at.
TREE_BINS = 32


def binned(df: DataFrame, cols: Sequence[str], bins: int = TREE_BINS) -> DataFrame:
    """Replace each column by the number of its bin: one per value if there are no more values than bins, else by quantiles."""
    df = df.select(*[x for x in df.columns if x not in cols], *[c(x).cast("double").alias(x) for x in cols])
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    seen = df.agg(*[F.approx_count_distinct(x).alias(f"n_{x}") for x in cols], *[F.percentile_approx(x, probs, 1000).alias(f"q_{x}") for x in cols]).first()
    cuts = {x: list(seen[f"q_{x}"] or []) for x in cols}
    few = [x for x in cols if seen[f"n_{x}"] <= 2 * bins]  # a bounded number of values, so all of them may be looked at
    if few:
        values = df.agg(*[F.collect_set(x).alias(x) for x in few]).first()
        cuts.update({x: sorted(values[x])[1:] for x in few if len(values[x]) <= bins})
    points = [[-math.inf, *(sorted({v + 0.0 for v in cuts[x] if math.isfinite(v)}) or [0.0]), math.inf] for x in cols]
    cut = Bucketizer(splitsArray=points, inputCols=list(cols), outputCols=[f"_bin_{x}" for x in cols])
    return cut.transform(df).drop(*cols).withColumnsRenamed({f"_bin_{x}": x for x in cols})


def domain_classifier(ref: DataFrame, cur: DataFrame, cols: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Cross-validated accuracy of telling current from reference rows; both sides weigh the same, so 0.5 means
    no difference.

    The trees see a feature only by its bin, so rows are counted once per fold and combination of bins, and these cells, weighing
    what their rows weigh, are what every fold fits and scores: their number is bounded by the bins, not by the rows.  A tree's
    bootstrap draws cells, that is all rows of a fold that look the same to it together.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    cols = list(cols)
    data = ref.select(*cols, F.lit(0.0).alias("label")).unionByName(cur.select(*cols, F.lit(1.0).alias("label"))).dropna()
    dealt = binned(data, cols).withColumn("_fold", F.floor(F.rand(seed) * folds).cast("int"))
    cells = materialize(dealt.groupBy("_fold", "label", *cols).agg(F.count(F.lit(1)).alias("n")), "domain-cells")
    sizes = cells.agg(F.sum(F.when(c("label") == 0, c("n"))).alias("_a"), F.sum(F.when(c("label") == 1, c("n"))).alias("_b"))
    cells = attach(cells, sizes).withColumn("weight", c("n") / F.when(c("label") == 0, c("_a")).otherwise(c("_b")))
    rf = RandomForestClassifier(numTrees=10, maxDepth=4, maxBins=TREE_BINS, seed=seed, weightCol="weight")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), rf])
    right = MulticlassClassificationEvaluator(metricName="accuracy", weightCol="weight")
    found = [right.evaluate(pipe.fit(cells.filter(c("_fold") != k)).transform(cells.filter(c("_fold") == k))) for k in range(folds)]
    accuracy = float(np.mean(found))
    return ref.sparkSession.createDataFrame([(accuracy, accuracy > 0.6)], "accuracy double, drift boolean")


def accuracy_drop(ref: DataFrame, cur: DataFrame, cols: Sequence[str], label: str, limit: float = 0.1, seed: int = 42) -> DataFrame:
    """Fit on the reference, score both samples; drift when accuracy falls by more than the limit."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    pipe = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"),
        VectorAssembler(inputCols=list(cols), outputCol="features"),
        RandomForestClassifier(numTrees=10, maxDepth=4, seed=seed)])
    model = pipe.fit(ref.dropna(subset=list(cols)))
    ev = MulticlassClassificationEvaluator(metricName="accuracy")
    a, b = (float(ev.evaluate(model.transform(d.dropna(subset=list(cols))))) for d in (ref, cur))
    return ref.sparkSession.createDataFrame([(a, b, a - b, a - b > limit)], "ref_accuracy double, cur_accuracy double, drop double, drift boolean")


# -- reports ---------------------------------------------------------------------------------------------


def infer_roles(df: DataFrame, unique_ratio: float = 0.05) -> DataFrame:
    """numeric or categorical per column: text is categorical, and so is a number with few distinct values."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t in numeric).alias("num"), c(n).cast("string").alias("v")) for n, t in kinds.items()]))
    values = df.select(cells.alias("x")).select("x.*").groupBy("column", "num", "v").agg(F.count("v").alias("n"))
    ratio = F.try_divide(F.count("v"), F.sum("n"))  # exact, so roles do not change with the layout of the data
    rows = values.groupBy("column", "num").agg(ratio.alias("unique_ratio"))
    role = F.when(~c("num") | (c("unique_ratio") < unique_ratio), "categorical").otherwise("numeric")
    return rows.select("column", role.alias("role"))


def drift_report(ref: DataFrame, cur: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Long table (feature, method, statistic, drift) over every applicable method."""
    o = order_statistics(ref, cur, numeric)
    o = o.withColumns({"ks_p": on_rows(ks_p, "ks", "n", "m"), "u_p": on_rows(normal_two_sided, "u_z")})
    b = binned_measures(shared_histogram(ref, cur, numeric))
    m = mean_test_p(mean_tests(ref, cur, numeric))

    def rows(df: DataFrame, spec: dict[str, tuple[str, Column]]) -> DataFrame:
        return df.select("feature", F.explode(F.array(*[
            F.struct(F.lit(k).alias("method"), c(s).cast("double").alias("statistic"), d.alias("drift")) for k, (s, d) in spec.items()])).alias("x")
        ).select("feature", "x.*")

    out = rows(o, {"ks": ("ks", c("ks_p") < alpha), "wasserstein": ("wasserstein", c("wasserstein") > 0.1), "mann_whitney": ("u", c("u_p") < alpha)})
    out = out.unionByName(rows(b, {"js": ("js_distance", c("js_distance") > 0.1), "psi": ("psi", c("psi") >= 0.2), "kl": ("kl", c("kl") > 0.1)}))
    out = out.unionByName(rows(m, {"welch": ("t", c("t_p") < alpha)}))
    if categorical:
        k = chi_squared(category_measures(ref, cur, categorical), alpha)
        out = out.unionByName(rows(k, {"chi2": ("chi2", c("drift"))}))
    return out


# The method that a kind of drift is looked for with, for one feature and for several.
METHOD_OF = {"covariate": ("ks", "mahalanobis"), "concept": ("js", "js"), "label": ("chi2", "chi2"), "multivariate": ("mahalanobis", "mahalanobis")}


def choose_method(kind: str, features: Sequence[str]) -> str:
    """The method for a kind of drift; kinds that are not known are looked for in all features together."""
    one, several = METHOD_OF.get(kind, METHOD_OF["multivariate"])
    return one if len(features) == 1 else several


def detect(ref: DataFrame, cur: DataFrame, features: Sequence[str], kind: str = "covariate", method: str = "auto", alpha: float = 0.05,
           js_limit: float = 0.1, distance_limit: float = 3.0) -> DataFrame:
    """feature, method, statistic, p_value (null where a method has none) and drift, by the given or the chosen method."""
    method = choose_method(kind, features) if method == "auto" else method
    none = F.lit(None).cast("double")
    if method == "ks":
        out = ks_test(ref, cur, features, alpha).select("feature", "statistic", "p_value", "drift")
    elif method == "js":
        b = binned_measures(shared_histogram(ref, cur, features))
        out = b.select("feature", c("js_distance").alias("statistic"), none.alias("p_value"), (c("js_distance") > js_limit).alias("drift"))
    elif method == "chi2":
        out = chi_squared(category_measures(ref, cur, features), alpha).select("feature", c("chi2").alias("statistic"), "p_value", "drift")
    elif method == "mahalanobis":
        out = mean_distance(ref, cur, features).select(F.lit(",".join(features)).alias("feature"), c("distance").alias("statistic"), none.alias("p_value"),
                                                       (c("distance") > distance_limit).alias("drift"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.select("feature", F.lit(method).alias("method"), "statistic", "p_value", "drift")


def report_summary(report: DataFrame) -> DataFrame:
    """Methods run, methods that flag drift, and their share per feature."""
    return report.groupBy("feature").agg(F.count(F.lit(1)).alias("methods"), F.count_if(c("drift")).alias("flags"),
                                         F.avg(c("drift").cast("double")).alias("ratio"))


def reference_window(history: DataFrame, s: Series, n: int) -> DataFrame:
    """The newest n rows per feature, as the next reference."""
    return newest_per_key(history, s, n)


def sample_mmd(ref: DataFrame, cur: DataFrame, cols: Sequence[str], gamma: float = 1.0, points: int = 512, seed: int = 3) -> DataFrame:
    """Kernel mean discrepancy with random Fourier features: distance of two mean feature vectors.

    The kernel is approximated by ``points`` cosine features, so each sample is one pass and one aggregate.
    """
    cols = list(cols)
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=math.sqrt(2 * gamma), size=(len(cols), points))
    shift = rng.uniform(0, 2 * math.pi, points)
    stats = ref.agg(*[F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).alias(x) for x in cols]).first()
    mean, dev = np.array([float(stats[x]["m"]) for x in cols]), np.array([float(stats[x]["s"]) or 1.0 for x in cols])

    def sums(batches):
        for b in batches:
            x = (b[cols].to_numpy(dtype="float64") - mean) / dev
            z = math.sqrt(2.0 / points) * np.cos(x @ w + shift)
            for side in (0, 1):
                part = z[b["_side"].to_numpy() == side]
                yield pd.DataFrame({"side": side, "k": np.arange(points), "total": part.sum(axis=0), "n": len(part)})

    both = ref.select(*cols, F.lit(0).alias("_side")).unionByName(cur.select(*cols, F.lit(1).alias("_side"))).dropna()
    parts = both.mapInPandas(sums, "side int, k int, total double, n long")
    means = parts.groupBy("k").agg(*[(F.sum(F.when(c("side") == s, c("total"))) / F.sum(F.when(c("side") == s, c("n")))).alias(f"m{s}") for s in (0, 1)])
    return means.agg(F.sqrt(F.sum(F.pow(c("m0") - c("m1"), F.lit(2.0)))).alias("mmd"))

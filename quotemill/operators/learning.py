"""Scaling, labelled classifiers, thresholded signals, regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.ordered import Series, index_rows

c = F.col


def scaler(cols: Sequence[str], kind: str = "standard", out: str = "scaled") -> Pipeline:
    stage = (StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True) if kind == "standard"
             else MinMaxScaler(inputCol="_raw", outputCol=out))
    return Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="skip"), stage])


def scaled(df: DataFrame, cols: Sequence[str], kind: str = "standard") -> DataFrame:
    """Fit and apply; the scaled values replace the columns."""
    done = scaler(cols, kind).fit(df).transform(df).withColumn("_v", vector_to_array("scaled"))
    return done.withColumns({x: c("_v")[k] for k, x in enumerate(cols)}).drop("_raw", "scaled", "_v")


def time_split(df: DataFrame, s: Series, share: float = 0.8) -> DataFrame:
    """Marks the first ``share`` of each key's rows in time order as training rows."""
    idx = index_rows(df, s)
    size = idx.groupBy(*s.keys).agg((F.max("_i") + 1).alias("_n"))
    return idx.join(size, list(s.keys)).withColumn("is_train", c("_i") < F.floor(c("_n") * share)).drop("_i", "_n")


def classifier(cols: Sequence[str], label: str = "label", kind: str = "random_forest", seed: int = 42, trees: int = 20, depth: int = 5) -> Pipeline:
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    vec = VectorAssembler(inputCols=list(cols), outputCol="features")
    if kind == "random_forest":
        model = RandomForestClassifier(labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed)
    elif kind == "boosted":
        model = OneVsRest(labelCol="_label", classifier=GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed))
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    return Pipeline(stages=[index, vec, model])


def train(df: DataFrame, cols: Sequence[str], label: str = "label", **kw) -> PipelineModel:
    data = df.withColumn(label, c(label).cast("string")).dropna(subset=list(cols))
    return classifier(cols, label, **kw).fit(data)


def scores(model: PipelineModel, df: DataFrame, cols: Sequence[str], label: str = "label") -> dict[str, float]:
    data = model.transform(df.withColumn(label, c(label).cast("string")).dropna(subset=list(cols)))
    return {m: float(MulticlassClassificationEvaluator(labelCol="_label", metricName=m).evaluate(data)) for m in ("accuracy", "f1")}


def importances(model: PipelineModel, cols: Sequence[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(((n, float(v)) for n, v in zip(cols, values)), key=lambda x: -x[1])


def predict(model: PipelineModel, df: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """Adds ``prediction`` (label text) and ``probabilities`` by label."""
    labels = model.stages[0].labels
    # Rows to predict need no label; any known one satisfies the indexer.
    data = model.transform(df.dropna(subset=list(cols)).withColumn(label, F.lit(labels[0])))
    p = vector_to_array("probability")
    probs = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), p)
    names = F.array(*[F.lit(x) for x in labels])
    return data.withColumns({"probabilities": probs, "prediction": F.get(names, c("prediction").cast("int"))}).drop(
        label, "_label", "features", "rawPrediction", "probability")


def threshold_signal(probabilities: str = "probabilities", threshold: float = 0.6, up: str = "1", down: str = "-1"):
    """1 or -1 when that class reaches the threshold, else 0."""
    a, b = F.element_at(probabilities, F.lit(up)), F.element_at(probabilities, F.lit(down))
    return F.when(a >= threshold, 1).when(b >= threshold, -1).otherwise(0)


def mixture_regimes(df: DataFrame, ret: str = "ret", k: int = 3, seed: int = 42) -> DataFrame:
    """Gaussian mixture over returns; components are named by the sign of their mean."""
    vec = VectorAssembler(inputCols=[ret], outputCol="_x").transform(df.dropna(subset=[ret]))
    model = GaussianMixture(featuresCol="_x", predictionCol="component", k=k, seed=seed).fit(vec)
    means = [float(g.mean[0]) for g in model.gaussians]
    name = F.lit("sideways")
    for i, m in enumerate(means):
        name = F.when(c("component") == i, "bull" if m > 0 else "bear" if m < 0 else "sideways").otherwise(name)
    return model.transform(vec).withColumn("regime", name).drop("_x", "probability")

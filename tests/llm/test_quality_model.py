import numpy as np
import pandas as pd
from conftest import DATA
from plain import DOCS, clashing, frame
from pyspark.sql import functions as F

from quotemill.llm import quality_model as Q
from quotemill.llm.common import first_texts, plain_words, prepare


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    right = (0.9, 0.85, 0.75, 0.8)
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, -1, np.where(rng.random(len(truth)) < a, truth, ~truth)) for a in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    got = Q.estimate(patterns, counts.astype(float))
    assert abs(got["prior"] - 0.7) < 0.03
    for j, a in enumerate(right):
        assert abs(got["accuracy"][j, 1, 1] - a) < 0.04 and abs(got["accuracy"][j, 0, 0] - a) < 0.04


def test_labellers_see_planted_faults():
    clean = "The words of this text, as they are. They end in a usual way, and they differ from each other much. " * 1
    words = plain_words(clean.encode())
    assert 0 not in Q.votes(Q.shares(words * 2))
    for faulty in ([w + b"%%%" for w in words], [w.upper() + b"!!" for w in words], [w for w in words for _ in range(5)], [x for w in words for x in (w, b"|")]):
        assert Q.votes(Q.shares(faulty * 2)).count(0) >= 2
    assert Q.votes(Q.shares([])) == [-1] * (len(Q.LABELLERS) - 1) + [0]


def test_verdicts_agree_with_labels_never_seen(spark):
    docs = prepare(spark).read.parquet(DATA.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = pd.read_parquet(DATA.replace("sf0.001", "sf0.01") + "/labels.parquet")
    judged, name = Q.judge(docs, Q.train(docs))
    got = judged.selectExpr("doc_id", f"{name}.score AS score").toPandas().merge(labels, on="doc_id")
    good, bad = got[got.quality == 1].score >= 0.5, got[got.quality == 0].score < 0.5
    assert good.mean() > 0.98 and bad.mean() > 0.95


def test_awkward_rows_and_empty_table(spark):
    docs = clashing(frame(prepare(spark)))
    model = Q.train(docs)
    judged, name = Q.judge(docs, model)
    assert judged.columns == [*docs.columns, name] and name != "judged"
    scores = {repr((r.doc_id, r.text)): r[name] for r in judged.collect()}
    assert all(0 <= s.score <= 1 and len(s.votes) == len(Q.LABELLERS) for s in scores.values())
    assert scores[repr((4, None))].score == scores[repr((5, ""))].score
    assert Q.clean(docs).columns == docs.columns
    assert Q.clean(spark.createDataFrame([], DOCS)).count() == 0


def test_the_sample_is_bounded_and_stable(spark):
    docs = frame(prepare(spark))
    a, b = Q.train(docs, fit_rows=5), Q.train(docs.repartition(7), fit_rows=5)
    assert np.allclose(a["weights"], b["weights"]) and a["posterior"] == b["posterior"]


def test_copies_do_not_shrink_the_sample(spark):
    """1,000 texts, most of them many times over, one a third of all rows: all of them are fitted on, each once."""
    docs = prepare(spark).range(60_000).selectExpr("IF(id % 3 = 0, 'one text', concat('text number ', id % 1000)) AS text")
    distinct = docs.distinct().count()
    got = [r.text for r in first_texts(docs, 20_000, F.col("text")).collect()]
    assert len(got) == len(set(got)) == distinct
    few = [r.text for r in first_texts(docs, 100, F.col("text")).collect()]
    assert few == got[:100]
    assert first_texts(docs.limit(0), 100, F.col("text")).count() == 0


def test_a_fit_task_runs_one_python_worker(spark, monkeypatch):
    """Two functions in one task would start two workers for each core, which live on through all later stages."""
    plans = []

    def watched(*args):
        out = first_texts(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(Q, "first_texts", watched)
    docs = frame(prepare(spark))
    assert Q.train(docs)["weights"].any() and [p.count("ArrowEvalPython") for p in plans] == [1]

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from plain import DOCS, clashing, frame

from quotemill.llm import toxicity as T
from quotemill.llm.common import prepare

LABELS = "doc_id long, quality int, toxic int"


def planted(n=1200, seed=3):
    rnd = random.Random(seed)
    words, bad = [f"tok{i}" for i in range(300)], ["nastyone", "uglytwo", "vilethree", "uglytwelve"]
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        docs.append((i, " ".join(w), "en", "s", 1))
        if rnd.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = planted()
    d, lab = prepare(spark).createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    return docs, labels, T.score(d, T.train(d, lab)).toPandas().set_index("doc_id")


def test_held_out_accuracy(scored):
    docs, _, got = scored
    truth = pd.Series({d[0]: int(any(w[:4] in ("nast", "ugly", "vile") for w in d[1].split())) for d in docs})
    fold = got[got.held_out]
    assert set(fold.index) == {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0}
    assert (fold.predicted == truth[fold.index]).mean() > 0.97 and ((fold.score >= 0.5) == fold.predicted).all()


def test_held_out_labels_and_other_columns_do_not_matter(spark, scored):
    docs, labels, got = scored
    turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, 1 - q, t) for i, q, t in labels]
    d = clashing(spark.createDataFrame([(i, t, "zz", "other", 7) for i, t, *_ in docs], DOCS)).repartition(5)
    again = T.score(d, T.train(d, spark.createDataFrame(turned, LABELS))).toPandas().set_index("doc_id")
    assert np.allclose(again.score.sort_index(), got.score.sort_index())


def test_given_tables(spark):
    path = DATA.replace("sf0.001", "sf0.01")
    docs, labels = (prepare(spark).read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    got = T.score(docs, T.train(docs, labels)).toPandas().merge(pd.read_parquet(f"{path}/labels.parquet"), on="doc_id")
    fold = got[got.held_out]
    assert (fold.predicted == fold.toxic).mean() > 0.9


def test_awkward_rows(spark):
    docs, labels = planted(300)
    lab = [*labels, (None, 1, 1), (9999, None, None), (3, 1, 1), (3, 1, 0), (1, 1, 5)]
    d = clashing(frame(spark, [*docs, *[(r[0] + 5000 if r[0] else None, *r[1:]) for r in __import__("plain").rows()]]))
    got = T.score(d, T.train(d, spark.createDataFrame(lab, LABELS))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert by[5004].score == by[5005].score == by[5006].score


def test_empty_tables(spark):
    none, lab = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert T.score(none, T.train(none, lab)).count() == 0
    got = T.score(frame(spark), T.train(frame(spark), lab)).collect()
    assert {round(r.score, 6) for r in got} == {0.001}


def test_the_risk_estimator_stays_non_negative():
    """With flexible features, plain positive-unlabelled risk would push hidden positives down; these stay up."""
    rng = np.random.default_rng(0)
    pos = [(np.array([0, 2 + i]), np.ones(2)) for i in range(100)]
    unl = [(np.array([0, 102 + i]), np.ones(2)) if i < 100 else (np.array([1, 102 + i]), np.ones(2)) for i in range(500)]
    w = T.fit(pos, unl, 0.2, 700, steps=600)
    hidden = np.mean([w[0] + w[102 + i] + w[-1] > 0 for i in range(100)])
    clean = np.mean([w[1] + w[102 + i] + w[-1] < 0 for i in range(100, 500)])
    assert hidden > 0.9 and clean > 0.9 and rng is not None


def test_features_count_every_positive(spark):
    """Each telling word is in four of 240 toxic documents: with 20 positives for the fit, all 60 words still are features."""
    docs = [(i, " ".join([f"vile{chr(97 + i // 4 % 26)}{chr(97 + i // 104)}x"] * 3 + [f"tok{j}" for j in range(i % 7, 20)]), "en", "s", 1) for i in range(240)]
    docs += [(i, " ".join(f"tok{j}" for j in range(i % 7, 20)), "en", "s", 1) for i in range(240, 6000)]
    docs = [(i, *d) for i, d in zip((i for i in range(9000) if zlib.crc32(str(i).encode()) % 5), (d[1:] for d in docs))]
    d, lab = prepare(spark).createDataFrame(docs, DOCS), spark.createDataFrame([(r[0], 1, int(k < 240)) for k, r in enumerate(docs)], LABELS)
    at = T.train(d, lab, positives=20)["at"]
    telling = {T._slots[w.encode()][0] for r in docs[:240] for w in r[1].split() if w.startswith("vile")}
    assert len(telling) == 60 and telling <= set(at)

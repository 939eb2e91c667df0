import math
import random
from collections import Counter

import numpy as np
import pytest
from plain import ITEM, clashing, frame, rows, strict
from pyspark.sql import functions as F

from quotemill.llm import lexical as X
from quotemill.llm.common import prepare


def plain(docs, items, top):
    """All scores of all documents, ranked: (item, rank, doc id, score)."""
    terms = [(i, Counter(strict(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in terms), sum(c.total() for _, c in terms)
    df, united, out = Counter(t for _, c in terms for t in c), {}, []
    for i, t in items:
        united.setdefault(i, set()).update(strict(t))
    for item, asked in united.items():
        found = []
        for i, c in terms:
            m = 100 - 50 + (50 * c.total() * n_docs) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked & set(c))
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def made(seed, n=400):
    r = random.Random(seed)
    vocabulary = [f"t{int(r.paretovariate(0.7)) % 300}" for _ in range(600)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)]  # ties across the k-th place
    return docs, [(q, " ".join(r.choices(vocabulary, k=r.randint(1, 20)))) for q in range(25)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_scoring_everything(spark, seed):
    docs, items = made(seed)
    d = prepare(spark).createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id int, text string")
    assert got(X.search(d, q, top=10, block_postings=300)) == plain(docs, items, 10)


def test_awkward_rows(spark):
    d = clashing(frame(prepare(spark)))
    items = [(1, ITEM), (2, None), (3, ""), (4, "Über WORD1 word39 of3"), (None, "one two"), (5, "nowhere at all"), (6, "w17x3 the"), (6, "漢字 der")]
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("mine")).withColumn("score", F.lit("mine"))
    assert got(X.search(d, q)) == plain([(r[0], r[1]) for r in rows()], items, 50)


def test_several_rounds_of_items(spark):
    docs, items = made(5, 100)
    d, q = prepare(spark).createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert got(X.search(d, q, top=7, item_bytes=400)) == plain(docs, items, 7)


def test_empty_tables(spark):
    docs, items = frame(prepare(spark), []), spark.createDataFrame([], "item_id long, text string")
    assert X.search(frame(spark), items).count() == 0
    assert X.search(docs, spark.createDataFrame([(1, "one two")], "item_id long, text string")).count() == 0


def test_ids_of_any_kind(spark):
    docs, items = [("b", "one"), ("a", "one"), (None, "one two"), ("c", "three")], [(1, "one")]
    found = X.search(prepare(spark).createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert [r.doc_id for r in found.orderBy("rank").collect()] == ["a", "b", None]


def test_reading_stops_early_and_strictly():
    """One list: position k + 1 need not be read unless it ties; two lists: direct accesses move the best position on."""
    n = 4096
    ids, length = list(range(n)), np.full(n, 10)
    tf = np.arange(n, 0, -1).astype(np.int32)
    one = X.Block(ids, length, np.arange(n + 1), np.zeros(n, np.int32), tf, np.array([500]), n, 10 * n)
    best = X.Best(5)
    assert one.search(np.array([0]), best) == X.FIRST_STRIDE and [r[2] for r in best.rows] == [0, 1, 2, 3, 4]
    level = X.Block(ids, length, np.arange(n + 1), np.zeros(n, np.int32), np.ones(n, np.int32), np.array([500]), n, 10 * n)
    best = X.Best(5)
    assert level.search(np.array([0]), best) == n and [r[2] for r in best.rows] == [0, 1, 2, 3, 4]
    # Documents at the head of one list lie at the head of the other too, so both best positions pass the positions read.
    terms = np.tile(np.array([0, 1], np.int32), n)
    both = X.Block(ids, length, np.arange(0, 2 * n + 1, 2), terms, np.repeat(tf, 2), np.array([500, 400]), n, 10 * n)
    best = X.Best(5)
    assert both.search(np.array([0, 1]), best) <= 2 * X.FIRST_STRIDE and [r[2] for r in best.rows] == [0, 1, 2, 3, 4]

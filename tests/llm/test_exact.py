import hashlib

import pytest
from plain import clashing, frame, rows
from pyspark.sql import functions as F

from quotemill.llm import exact as E
from quotemill.llm.common import prepare
from quotemill.session import scratch


def plain(data):
    """Per row (id, keep id, size, text), from texts compared whole."""
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data), key=repr)


def got(df, digest=True):
    return sorted(((r.doc_id, r.keep_id, r.group_size, *([r.digest] if digest else [])) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def awkward(spark):
    return clashing(frame(prepare(spark)))


def test_equals_grouping_by_text(awkward):
    out = E.deduplicate(awkward).cache()
    data = [(r[0], r[1]) for r in rows()]
    assert got(out) == plain(data)
    assert out.filter("kept").count() == len({t or "" for _, t in data})  # one row of each text, repeated rows included
    assert out.filter("kept AND NOT doc_id <=> keep_id").count() == 0


def test_weak_digest_is_caught_by_the_bytes(awkward):
    """A digest of two values: nearly all texts collide and are told apart by their bytes."""
    out = E.deduplicate(awkward, digest=lambda t: (F.length(t) % 2).cast("string")).cache()
    assert got(out, digest=False) == sorted((r[:3] for r in plain([(r[0], r[1]) for r in rows()])), key=repr)
    assert out.filter("kept").count() == len({r[1] or "" for r in rows()})


def test_state_goes_on_with_new_files(spark):
    path = scratch(spark, "exact-test")
    parts = [[(1, "a"), (2, "b"), (3, "a")], [(9, "b"), (4, "c")], [(5, "a"), (5, "a"), (None, "d")]]
    work = E.Deduplicator(prepare(spark), path, batch_bytes=1)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        work.update()
        assert got(work.verdicts()) == plain([r for p in parts[: k + 1] for r in p])
    states = spark.read.parquet(f"{work.folder}/state")
    assert states.select("batch").distinct().count() == 3 and states.filter("batch = 2").count() == 2  # only what changed


def test_single_file(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    work = E.Deduplicator(prepare(spark), path)
    work.update()
    assert got(work.verdicts()) == plain([(r.doc_id, r.text) for r in spark.read.parquet(path).collect()])


def test_hot_text_over_many_files(spark):
    docs = prepare(spark).range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, repeat('hot ', 500), concat('t', id % 700)) AS text").repartition(16)
    out = E.deduplicate(docs, batch_bytes=2000)
    assert got(out) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert E.deduplicate(frame(prepare(spark), [])).count() == 0

import math
import zlib
from collections import Counter

import pytest
from plain import DOCS, clashing, frame, rows
from pyspark.sql import functions as F

from quotemill.llm import shards as S
from quotemill.llm.common import prepare


@pytest.fixture(scope="module")
def many(spark):
    return prepare(spark).range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")


def test_tree_of_any_size():
    for n in range(201):
        tree = S.Tree.of(n)
        assert [leaf[2] for leaf in tree.leaves] == list(range(n)) and tree.grown() == S.Tree.of(n + 1)
        racks, regions = Counter(leaf[1] for leaf in tree.leaves), Counter({leaf[:2] for leaf in tree.leaves})
        assert max(racks.values(), default=0) <= S.RACK_SHARDS and max(Counter(g for g, _ in regions).values(), default=0) <= S.REGION_RACKS


def _hash(spark, ids, shard):
    """The engine's own 64-bit hash of (key, shard), as unsigned 52 bits."""
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(shard)).alias("h")).collect()
    return {r.doc_id: (r.h % (1 << 64)) >> 12 for r in got}


def test_placement_level_by_level(spark):
    """Descending by the smallest draw below each child, recomputed in plain Python."""
    tree, ids = S.Tree.of(47).reweighted({3: 2.5, 41: 0.5, 17: 0.0}), list(range(300))
    draws = {s: {i: -math.log((h + 0.5) / 2**52) / w for i, h in _hash(spark, ids, s).items()} for _, _, s, w in tree.leaves if w > 0}
    frame_ = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for r in frame_.select("doc_id", tree.place(["doc_id"]).alias("at")).collect():
        node = ()
        for depth in range(3):
            below = {}
            for leaf in tree.leaves:
                if leaf[:depth] == node and leaf[2] in draws:
                    below[leaf[depth]] = min(below.get(leaf[depth], math.inf), draws[leaf[2]][r.doc_id])
            node += (min(below, key=below.get),)
        assert node == (r["at"]["region"], r["at"]["rack"], r["at"]["shard"])


def test_growth_takes_rows_into_the_new_shard_at_every_size(many):
    sizes = [1, 4, 5, 19, 20, 39, 59, 60]
    trees = {f"s{n}": S.Tree.of(n).place(["doc_id"])["shard"] for n in sorted({*sizes, *[n + 1 for n in sizes]})}
    got = many.limit(4000).select(*[c.alias(n) for n, c in trees.items()]).toPandas()
    for n in sizes:
        moved = got[got[f"s{n}"] != got[f"s{n + 1}"]]
        assert set(moved[f"s{n + 1}"]) == {n} and abs(len(moved) / len(got) - 1 / (n + 1)) < 0.03


def test_growth_moves_into_the_new_shard_only(many):
    got = S.assign(many, 40).toPandas()
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) == {40} and abs(len(moved) / len(got) - 1 / 41) < 0.01
    assert set(got.shard) == set(range(40)) and got.groupby("shard").size().std() < 40


def test_slots_are_gapless(many):
    for _, part in S.assign(many.repartition(6), 40).toPandas().groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_placement_follows_weights(many):
    heavy = S.Tree.of(40).reweighted({3: 4.0})
    share = Counter(r.shard for r in many.select(heavy.place(["doc_id"])["shard"].alias("shard")).collect())
    assert abs(share[3] / 20_000 - 4 / 43) < 0.02


def test_movement_is_confined_to_subtrees_whose_weight_changed(many):
    tree = S.Tree.of(40)
    heavy = tree.reweighted({3: 2.0})
    where = {leaf[2]: leaf for leaf in tree.leaves}
    pairs = many.select(tree.place(["doc_id"])["shard"].alias("a"), heavy.place(["doc_id"])["shard"].alias("b")).filter("a <> b").collect()
    assert pairs
    for r in pairs:  # a document moves only towards the subtree that became heavier
        old, new, hot = where[r.a], where[r.b], where[3]
        depth = next(d for d in range(3) if old[d] != new[d])
        assert new[: depth + 1] == hot[: depth + 1]


def test_key_and_count_alone_decide(many):
    a = S.assign(many, 40).select("doc_id", "shard")
    b = S.assign(many.withColumn("text", F.lit("other")).repartition(9), 40).select("doc_id", F.col("shard").alias("s"))
    assert a.join(b, "doc_id").filter("shard <> s").isEmpty()


def test_awkward_rows(spark):
    got = S.assign(clashing(frame(prepare(spark))), 40).collect()
    want = sorted((repr(d[0]), len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in rows())
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    by = Counter((r.shard, r.slot) for r in got)
    assert max(by.values()) == 1 and len({r.shard for r in got if r.doc_id == 12}) == 1
    assert S.assign(spark.createDataFrame([], DOCS), 40).count() == 0

import random

import numpy as np
import pytest
from plain import DOCS, clashing, frame, near_groups, rows, shingle_set

from quotemill.llm import neardup as N
from quotemill.llm.common import prepare


def variants(seed=2):
    """A family of edits around several texts: links of many similarities, chains, copies and a large near group."""
    rnd, out = random.Random(seed), []
    for family in range(6):
        base = [f"f{family}w{rnd.randint(0, 400)}" for _ in range(60)]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4, 6])):
                w[rnd.randrange(len(w))] = f"edit{rnd.randint(0, 10**6)}"
            out.append(" ".join(w))
            if rnd.random() < 0.3:
                base = w  # the family drifts
    out += [out[0]] * 5 + ["a b c", "A  B\tc", "a b", ""]
    rnd.shuffle(out)
    return out


def check(spark, texts):
    got = {r.doc_id: r for r in N.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, root in enumerate(near_groups(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingle_set(texts[i])), root, root == i)


def test_groups_equal_the_plain_ones(spark):
    check(prepare(spark), variants())


def test_pieces_of_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 2)
    check(spark, variants(7))


def test_pieces_alone_connect_all_that_is_linked(spark, monkeypatch):
    """Without any star link, comparing pieces must find the same components."""
    texts = variants(11)
    want = near_groups(texts)
    monkeypatch.setattr(N, "STAR_ONLY", 1)
    for size in (N.PIECE, 3):
        monkeypatch.setattr(N, "PIECE", size)
        monkeypatch.setattr(N, "confirm", lambda pairs, sets: pairs.select("a", "b").filter("false"))
        got = {r.doc_id: r.component_id for r in N.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_sketches_tell_near_from_far():
    rng, far = np.random.default_rng(4), {}
    for j in (0.75, 0.9, 0.3):
        same = rng.integers(0, 1 << 63, int(2000 * j), dtype=np.uint64)
        a, b = (np.concatenate([same, rng.integers(0, 1 << 63, int((2000 - len(same)) / 2), dtype=np.uint64)]) for _ in range(2))
        bits = [np.frombuffer(N.sketch(N.samples(x)), np.uint8) for x in (a, b)]
        far[j] = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
    assert far[0.9] < far[0.75] <= N.FAR_BITS < far[0.3]


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 3), (3, 9), (9, 5), (20, 21), (7, 7)], []])
def test_components(spark, edges):
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}


def test_awkward_rows(spark):
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in N.groups(clashing(frame(spark))).collect())
    data = rows()
    want = []
    for d, root in zip(data, near_groups([d[1] for d in data])):
        has = bool(shingle_set(d[1]))
        want.append((repr(d[0]), len(shingle_set(d[1])), data[root][0] if has else d[0], not has or d[0] == data[root][0]))
    assert got == sorted(want)


def test_deduplicate_keeps_one_of_each_group(spark):
    docs = clashing(frame(spark, [*rows(), (None, rows()[0][1], "x", None, 1), (None, "no id and no partner at all", None, None, 1), (None, "no id and no partner at all", None, None, 1)]))
    out = N.deduplicate(docs)
    ids = sorted(repr(r.doc_id) for r in out.collect())
    assert out.columns == docs.columns and ids == sorted(map(repr, [1, 4, 5, 6, 7, 8, None, None, 11, 12, 13, 14, 15]))


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert N.groups(none).count() == 0 and N.deduplicate(none).columns == none.columns

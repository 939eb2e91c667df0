import hashlib

from plain import DOCS, ITEM, clashing, frame, rows, strict, window_hits

from quotemill.llm import decontam as D
from quotemill.llm.common import prepare

ITEMS = [(1, ITEM), (2, "one two"), (3, None), (4, "—…"), (None, "der " * 12), (10, ITEM.upper()), (7, "w1x0 w2x0 w3x0 w4x0 w5x0 w6x0 w7x0 w8x0 w9x0 w10x0 w11x0"),
         (8, "lambda mu alpha beta gamma delta epsilon zeta eta theta unseen")]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS found", "2 AS name")


def results(docs, items, **kw):
    state, found = D.find(docs, items, **kw)
    return sorted((repr((r.doc_id, r.text)), r[found].n_words, r[found].n_hit, tuple(r[found]["items"])) for r in state.collect())


def expected(items=ITEMS):
    out = []
    for d in rows():
        hit, names = window_hits(d[1] if d[0] != 7 else " ".join((d[1] or "").split()[:40]), items)
        out.append((repr((d[0], d[1])), len(strict(d[1])), len(hit), tuple(sorted(names))))
    return sorted(out)


def test_hits_equal_the_plain_ones(spark):
    assert results(frame(prepare(spark)), benchmark(spark)) == expected()


def test_blocks_give_the_same(spark):
    assert results(clashing(frame(spark)), benchmark(spark), block_bytes=100) == expected()


def test_spans_point_into_the_original(spark):
    state, found = D.find(frame(spark).filter("doc_id = 11"), benchmark(spark, [(1, ITEM)]))
    r = state.first()
    assert [r.text[s.char_from : s.char_to] for s in r[found].spans] == [r.text[r.text.index("Alpha") :]]


def test_clean_drops_the_hit_documents_only(spark):
    docs = clashing(frame(spark))
    out = D.clean(docs, benchmark(spark, ITEMS[:1]))
    assert out.columns == docs.columns and out.count() == len(rows()) - 1


def test_empty_tables(spark):
    assert D.clean(spark.createDataFrame([], DOCS), benchmark(spark)).count() == 0
    state, found = D.find(frame(spark), benchmark(spark, []))
    assert {r[found].n_hit for r in state.collect()} == {0}


def test_query_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")

import pytest
from plain import DOCS, clashing, frame, measures, rows

from quotemill.llm import rules as R
from quotemill.llm.common import prepare


def test_measures_equal_the_plain_ones(spark):
    data = rows() + [(20, "a b c d e f a b c d e g", "en", "x", 1), (21, "a a a a a a", "en", "x", 1), (22, "p q r s t p q r s t", "en", "x", 1)]
    got = R.ledger(frame(prepare(spark), data)).collect()
    key = lambda r: repr(r)
    seen = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key)
    assert seen == sorted(((d[0], *measures(d[1])) for d in data), key=key)


def test_each_rule_sets_its_own_bit(spark):
    got = {r.doc_id: r for r in R.verdicts(R.ledger(frame(spark)), R.POLICIES["v2"]).collect() if r.doc_id}
    failed = {k: {n for i, (n, _) in enumerate(R.RULES) if r.failures >> i & 1} for k, r in got.items()}
    assert failed[4] == failed[5] == {"few_words"} and failed[1] == set()
    assert {"repeated_windows", "stutters"} <= failed[13] and got[13].base_failed and not got[13].kept
    assert got[1].kept and not got[1].base_failed


def test_apply_keeps_the_columns_and_filters(spark):
    docs = clashing(frame(spark))
    out = R.apply(docs, R.POLICIES["v2"])
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2, 3, 7, 12, None}


@pytest.mark.parametrize("version", ["v1", "v2"])
def test_ablations_equal_counting_by_hand(spark, version):
    policy, book = R.POLICIES[version], R.ledger(frame(spark))
    fails = [r.failures for r in book.collect()]
    for r in R.ablations(book, policy).collect():
        b = R.bit(r["rule"])
        assert r.failed == sum(1 for f in fails if f & b)
        assert r.kept == sum(1 for f in fails if not f & policy.mask)
        assert r.kept_without == sum(1 for f in fails if not f & policy.mask & ~b)
        assert r.rejected_alone == r.kept_without - r.kept


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert R.ledger(none).count() == 0 and R.apply(none, R.POLICIES["v2"]).columns == none.columns
    assert {r.kept for r in R.ablations(R.ledger(none), R.POLICIES["v2"]).collect()} == {0}

import hashlib

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA
from plain import DOCS, clashing, frame, near_groups, window_hits

import __spark_entry__ as entry
import corpus_pipeline as P
from quotemill.llm import decontam, neardup, quality_model, rules
from quotemill.llm.common import prepare
from quotemill.llm.queries import ORACLES, QUERIES


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_plain_versions(spark):
    docs = prepare(spark).read.parquet(f"{DATA}/documents.parquet")
    one = P.quality_classifier(spark, docs, DATA)
    judged, name = quality_model.judge(docs, quality_model.train(docs))
    assert one.columns == docs.columns and ids(one) == ids(judged.filter(f"{name}.score >= 0.5"))
    two = P.quality_rules(spark, one, DATA)
    assert two.columns == docs.columns and ids(two) == ids(rules.verdicts(rules.ledger(one), rules.POLICIES["v2"]).filter("kept"))
    kept = sorted(two.select("doc_id", "text").collect())
    roots = near_groups([r.text for r in kept])
    three = P.near_duplicates(spark, two, DATA)
    assert three.columns == docs.columns and ids(three) == [r.doc_id for i, r in enumerate(kept) if roots[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    four = P.decontamination(spark, three, DATA)
    left = [r for r in sorted(three.select("doc_id", "text").collect()) if not window_hits(r.text[:3000], items)[0]]
    assert four.columns == docs.columns and set(ids(four)) <= {r.doc_id for r in left}
    con = duckdb.connect()
    con.register("documents", three.select("doc_id", "text").toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    assert ids(four) == sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op4_decontamination']}) WHERE NOT contaminated").fetchall())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for r in four.collect():
        tokens = library.encode(r.text)
        want[r.doc_id] = (len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(library.decode(tokens).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.tokens(spark, four, DATA).collect()} == want
    assert {r.doc_id for r in P.run(spark, DATA).collect()} == set(want)


def test_labelled_good_documents_pass_the_filters(spark):
    docs = prepare(spark).read.parquet(f"{DATA}/documents.parquet")
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    passed = set(ids(P.quality_rules(spark, P.quality_classifier(spark, docs, DATA), DATA)))
    base = {r.doc_id for r in rules.verdicts(rules.ledger(docs), rules.POLICIES["v2"]).filter("NOT base_failed").collect()}
    good, bad = set(labels[labels.quality == 1].doc_id) & base, set(labels[labels.quality == 0].doc_id)
    assert len(good & passed) >= 0.98 * len(good) and len(bad & passed) <= 0.02 * len(bad) + 1


def test_awkward_and_empty_documents_pass_all_stages(spark):
    for data in (clashing(frame(prepare(spark))), spark.createDataFrame([], DOCS)):
        docs = data
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == data.columns
        assert P.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_order_and_registration():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "decontamination", "sentencepiece"]
    found = entry.queries()
    assert found["pipeline"] is P.run and all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert neardup.SHINGLE == 5 and decontam.WIDTH == 10


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    from tools.check import compare

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert compare(entry.queries()[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()) == ""

"""Registered queries of the training-data operators and, where SQL can say it, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import align, chat, decontam, exact, lexical, licenses, neardup, pieces, quality_model, rules, shards, toxicity, warc
from quotemill.llm.common import STRICT_WORD, digest_of, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.module = fn.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


RULE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS x
        FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + 4)) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%%&|<>]')) AS BIGINT) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
         CAST((length(t) - length(replace(t, '!!', ''))) // 2 AS BIGINT) AS n_exclaims,
         CAST(len(regexp_extract_all(t, '\\p{Lu}')) AS BIGINT) AS n_upper,
         len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM w LEFT JOIN rep ON rep.rid = w.rid),
f AS (SELECT *, %s AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_exclaims, n_upper, n_stutters, failures,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (failures & %d) = 0 AS kept
FROM f
""" % (
    " + ".join(f"CASE WHEN {broken} THEN CAST({1 << i} AS BIGINT) ELSE 0 END" for i, (_, broken) in enumerate(rules.RULES)),
    rules.POLICIES[rules.CURRENT].mask,
)


@query("op10_quality_rules", RULE_SQL)
def op10(spark, sf_dir):
    """The ledger of all documents under the current policy."""
    return rules.verdicts(rules.ledger(table(spark, sf_dir, "documents")), rules.POLICIES[rules.CURRENT])


def piece_model() -> str:
    """The public piece model the query uses; the file comes with an installed package on every executor."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op7_sentencepiece")
def op7(spark, sf_dir):
    """Every text encoded and decoded; digests of the ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digests(*pieces.round_trip(docs, piece_model()))


def piece_digests(coded: DataFrame, ids: str, back: str) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        digest_of(F.col(ids)).alias("ids_sha256"),
        F.sha2(F.col(back), 256).alias("decoded_sha256"),
    )


LEAK_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
        FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
              FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, pos.n AS n, i, item_id FROM pos JOIN win ON pos.n = win.n AND pos.x = win.x),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
""".format(word=STRICT_WORD)


@query("op4_decontamination", LEAK_SQL)
def op4(spark, sf_dir):
    """Hits of benchmark windows in every document."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    state, found = decontam.find(docs, items)
    f = F.col(found)
    return state.select(
        "doc_id",
        f["n_words"].alias("n_words"),
        f["n_hit"].alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        (f["n_hit"] > 0).alias("contaminated"),
    )


@query("op5_near_duplicates")
def op5(spark, sf_dir):
    """Near-duplicate group of every document."""
    return neardup.groups(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    """Score, weak-label posterior and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged, name = quality_model.judge(docs, quality_model.train(docs))
    j = F.col(name)
    return judged.select("doc_id", j["score"].alias("score"), j["posterior"].alias("posterior"),
                         F.array_join(j["votes"].cast("array<string>"), ",").alias("votes"), (j["score"] >= 0.5).alias("kept"))


@query("op3_warc")
def op3(spark, sf_dir):
    """All pages written as archives and read back through the index."""
    folder, index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(folder, index).select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


SHARDS = 40


@query("op8_sharding")
def op8(spark, sf_dir):
    """Shard and slot of every document under the key law, and its shard after one more is added."""
    return shards.assign(table(spark, sf_dir, "documents"), SHARDS)


@query("op6_toxicity")
def op6(spark, sf_dir):
    """Toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


@query("op1_chat_format")
def op1(spark, sf_dir):
    """Every turn with its repaired role, what was done to it, what that cost and its part of the rendered text."""
    return chat.repair(table(spark, sf_dir, "conversations")).drop("o", "h", "k")


@query("op9_license_scan")
def op9(spark, sf_dir):
    """The best license match of every document, if any, how many it has, and all of them, best first."""
    state, name = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    matches = F.col(name)["matches"]
    best = F.get(matches, 0)
    return state.select(
        "doc_id", F.col(name)["n_words"].alias("n_words"), F.size(matches).cast("long").alias("n_matches"),
        *[best[c].alias(c) for c in ("license", "coverage", "matched", "word_from", "word_to", "char_from", "char_to")],
        matches.alias("matches"),
    )


SEARCH_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')) AS x FROM benchmark),
s AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
t AS (SELECT rid, x, count(*) AS tf FROM (SELECT rid, unnest(w) AS x FROM d) WHERE x IN (SELECT x FROM q) GROUP BY rid, x),
f AS (SELECT x, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM s) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t GROUP BY x),
m AS (SELECT rid, doc_id, 100 - 50 + ((50 * len(w) * docs) // terms) AS m FROM d, s WHERE len(w) > 0),
scored AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM q JOIN f USING (x) JOIN t USING (x) JOIN m USING (rid) GROUP BY item_id, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
""".format(word=STRICT_WORD)


@query("op11_ranked_search", SEARCH_SQL)
def op11(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_tokenizer_alignment")
def op12(spark, sf_dir):
    """Figures, a digest of the groups and corpus-wide link counts of every document."""
    import public_tokenizers

    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), piece_model(), groups=groups)
    return found.withColumnRenamed("groups", "groups_sha256")


SAME_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op13_exact_dedup", SAME_SQL)
def op13(spark, sf_dir):
    """Every document with the one that stays of those with its text."""
    work = exact.Deduplicator(spark, f"{sf_dir}/documents.parquet")
    work.update()
    return work.verdicts().withColumnRenamed("digest", "text_sha256")

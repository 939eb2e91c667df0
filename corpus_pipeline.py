"""The training-data pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the columns of documents;
the last returns one row of token counts and digests per document.  ``run`` writes every stage's result to the shared
folder and reads it again, so a lost executor repeats work of one stage only.

Rows without id are treated as any other; repeated rows are one document for the near-duplicate stage, which keeps the
first.  Empty tables pass through all stages.  Extra columns of documents stay until the last stage.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quotemill.llm import decontam, neardup, pieces, quality_model, rules  # noqa: E402
from quotemill.llm.common import prepare  # noqa: E402
from quotemill.llm.queries import piece_digests, piece_model, table  # noqa: E402
from quotemill.session import materialize  # noqa: E402


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents' own weak labels, scores 0.5 or more."""
    prepare(spark)
    return quality_model.clean(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    prepare(spark)
    return rules.apply(docs, rules.POLICIES[rules.CURRENT])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    prepare(spark)
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    prepare(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of the ids and of the decoded text."""
    prepare(spark)
    return piece_digests(*pieces.round_trip(docs, piece_model()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

# The first stage is a fitted model, which SQL cannot express; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

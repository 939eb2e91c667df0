"""Ranked lexical search with the Best Position Algorithm over impact lists.

Terms, statistics and scores are those of ``search``.  One pass over the documents keeps, for every document, its length
and the terms of the query vocabulary that it holds; from that table come the corpus statistics, and every
task reads its part of it in blocks.  In a block each term has an impact list: the documents that hold it, by
falling impact.  A query reads its lists side by side.  A document met for the first time is looked up directly in all
lists of the query, which gives its score and its position in each of them.  Per list the best position is the end of the
gapless run of positions seen, by reading or by looking up; the sum of the impacts there bounds every document not yet
seen, and reading ends when the k-th best score lies strictly above it (an equal score could still win by its id).  The best k
carry over to the next block of the task, whose lists are then left earlier.  Per query each task hands on k rows.

The queries travel to the tasks: up to ``ITEM_BYTES`` of their text at once; more are answered in several rounds.

Defined results: a null or empty text has no terms; such a document counts in no statistic and is never found, and
such an item finds nothing.  Rows of one item id are one item with the terms of all of them.  Documents repeated under
one id are ranked each for itself; documents without id come after all others of their score.  Only score above 0 is
returned, so an item may have fewer than k rows.  Empty tables give no rows.  Other columns are left behind.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from quotemill.llm.common import only, resident, strict_words, texts
from quotemill.session import materialize

TOP = 50
BLOCK_POSTINGS = 2_000_000
ITEM_BYTES = 64 << 20
FIRST_STRIDE, LAST_STRIDE = 16, 2048

_held: dict[str, dict[bytes, int]] = {}


def _postings(shared, key: str):
    """Per document its number of terms, and the numbers and frequencies of the query terms it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("lexical", _held.clear)
        if key not in _held:
            _held.clear()  # one vocabulary at a time
            _held[key] = {t: i for i, t in enumerate(shared.value)}
        number = _held[key].get
        for batch in batches:
            n, ends, terms, tf = [], [0], [], []
            for text in texts(batch.column("text")):
                words = strict_words(text)
                n.append(len(words))
                for word, times in Counter(words).items():
                    t = number(word)
                    if t is not None:
                        terms.append(t)
                        tf.append(times)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], ["id", "n", "terms", "tf"])

    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Best:
    """The k best rows of one query so far: highest score first, then by id, rows without id last."""

    def __init__(self, k: int):
        self.k, self.rows, self.kth = k, [], 0

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows += [(-int(s), i is None, i) for s, i in zip(scores, ids)]
        self.rows.sort(key=lambda r: r[:2] if r[1] else r)
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.kth = -self.rows[-1][0]


class Block:
    """The impact lists of some documents, and the same entries by document for direct access."""

    def __init__(self, ids: list, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, docs: int, length: int):
        self.ids, self.starts, self.terms = ids, starts, terms
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(n)), sizes)
        m = 50 + (50 * n * docs) // max(length, 1)
        tf = tf.astype(np.int64)
        self.impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
        order = np.lexsort((-self.impact, terms))
        self.list_ends = np.cumsum(np.bincount(terms, minlength=len(weights)))
        self.list_starts = np.concatenate([[0], self.list_ends[:-1]])
        self.list_doc, self.list_impact = owner[order], self.impact[order]
        self.position = np.empty(len(terms), np.int64)  # of every entry in its list
        self.position[order] = np.arange(len(terms)) - self.list_starts[terms[order]]
        self.slot = np.full(len(weights), -1, np.int64)

    def search(self, query: np.ndarray, best: Best) -> int:
        """Add the block's documents to the best of a query; returns how many were looked up."""
        query = query[self.list_ends[query] > self.list_starts[query]]
        sizes = self.list_ends[query] - self.list_starts[query]
        first = np.concatenate([[0], np.cumsum(sizes)])  # where each list's positions are marked in ``seen``
        seen, met = np.zeros(first[-1], bool), np.zeros(len(self.ids), bool)
        reached = np.zeros(len(query), np.int64)  # best position, as the number of positions seen without a gap
        self.slot[query] = np.arange(len(query))
        depth, stride, looked_up = 0, FIRST_STRIDE, 0
        while len(query):
            more = np.clip(sizes - depth, 0, stride)
            read = self.list_doc[_ranges(self.list_starts[query] + np.minimum(depth, sizes), more)]
            new = np.unique(read[~met[read]])
            if len(new):
                met[new] = True
                looked_up += len(new)
                self._look_up(new, first, seen, best)
            depth, stride = depth + stride, min(2 * stride, LAST_STRIDE)
            for i in range(len(query)):
                rest = seen[first[i] + reached[i] : first[i + 1]]
                gap = int(rest.argmin()) if len(rest) else 0
                reached[i] += len(rest) if len(rest) and rest[gap] else gap
            open_ = reached < sizes  # a list that was seen to its end holds no further document
            bound = self.list_impact[self.list_starts[query[open_]] + reached[open_] - 1].sum()
            if bound < best.kth or not open_.any():
                break
        self.slot[query] = -1
        return looked_up

    def _look_up(self, docs: np.ndarray, first: np.ndarray, seen: np.ndarray, best: Best) -> None:
        """Direct access: the documents' entries in all lists of the query give positions and scores."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        entries = _ranges(self.starts[docs], sizes)
        slots = self.slot[self.terms[entries]]
        mine = slots >= 0
        seen[first[slots[mine]] + self.position[entries[mine]]] = True
        sums = np.concatenate([[0], np.cumsum(np.where(mine, self.impact[entries], 0))])
        ends = np.cumsum(sizes)
        scores = sums[ends] - sums[ends - sizes]
        good = np.flatnonzero(scores >= max(best.kth, 1))
        if len(good) > best.k:  # of many, those below the k-th best of them cannot stay
            good = good[scores[good] >= np.partition(scores[good], -best.k)[-best.k]]
        if len(good):
            best.add(scores[good], [self.ids[d] for d in docs[good]])


def _searcher(shared, k: int, block_postings: int, schema: pa.Schema):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        part, size = [], 0
        for batch in batches:
            part.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= block_postings:
                yield pa.Table.from_batches(part)
                part, size = [], 0
        if part:
            yield pa.Table.from_batches(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, docs, length = shared.value
        best = [Best(k) for _ in queries]
        for table in blocks(batches):
            table = table.combine_chunks()
            terms, tf = table.column("terms").combine_chunks(), table.column("tf").combine_chunks()
            sizes = terms.value_lengths().to_numpy()
            block = Block(table.column("id").to_pylist(), table.column("n").to_numpy(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]),
                          terms.flatten().to_numpy(), tf.flatten().to_numpy(), weights, docs, length)
            for query, b in zip(queries, best):
                block.search(query, b)
        for q, b in enumerate(best):
            rows = [(q, i, -s) for s, _, i in b.rows]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_postings: int = BLOCK_POSTINGS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``top`` documents of every item: ``item_id``, ``rank`` from 1, the document's id and its score.

    With N documents that have terms, L terms in all, n terms and tf times the term in the document, and df documents
    holding it: a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))) and adds w * (10^9 tf div (1000 tf + 20 m)) once
    per item, where m = 50 + 50 n N div L.
    """
    asked = only(items, item=item_id, text=item_text)
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = max(1, math.ceil(size / item_bytes))
    out = None
    for i in range(rounds):
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == i) if rounds > 1 else asked
        found = _round(only(docs, id=id_col, text=text_col), part, top, block_postings)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"item": item_id, "id": id_col})


def _round(docs: DataFrame, items: DataFrame, top: int, block_postings: int) -> DataFrame:
    spark = docs.sparkSession
    words: dict[object, set[bytes]] = {}
    for r in items.select("item", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).collect():  # at most ITEM_BYTES
        words.setdefault(r["item"], set()).update(strict_words(bytes(r["raw"])))
    vocabulary = sorted(set().union(*words.values()))
    number = {t: i for i, t in enumerate(vocabulary)}
    id_type = docs.schema["id"].dataType
    kept = materialize(
        docs.mapInArrow(_postings(spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex),
                        f"id {id_type.simpleString()}, n bigint, terms array<int>, tf array<int>"),
        "lexical",
    )
    docs_with_terms, length = kept.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, times in kept.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a row per query term
        df[t] = times
    weights = np.array([math.floor(1000 * math.log((2 * docs_with_terms + 2) / (2 * int(f) + 1))) for f in df], np.int64)
    # Terms that weigh nothing add nothing.
    queries = [np.array(sorted(t for t in map(number.get, terms) if weights[t] > 0), np.int64) for terms in words.values()]
    answer = StructType([StructField("q", LongType()), StructField("id", id_type), StructField("score", LongType())])
    schema = pa.schema([("q", pa.int64()), ("id", _arrow(docs)), ("score", pa.int64())])
    shared = spark.sparkContext.broadcast((queries, weights, docs_with_terms, length))
    local = kept.filter("size(terms) > 0").mapInArrow(_searcher(shared, top, block_postings, schema), answer)
    names = spark.createDataFrame(list(enumerate(words)), StructType([StructField("q", LongType()), StructField("item", items.schema["item"].dataType)]))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = local.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(names), "q").select("item", "rank", "id", "score")


def _arrow(docs: DataFrame) -> pa.DataType:
    """The Arrow type of the documents' ids."""
    return docs.select("id").limit(0).toArrow().schema.field("id").type

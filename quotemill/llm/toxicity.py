"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the training documents as a whole are the unlabelled, whatever their label says.
The class prior is the toxic share of the labelled training rows.  Hashed words and word beginnings are counted over
all training documents, those that positives hold significantly more often are the features, and a linear numpy
classifier is trained on the risk  prior * mean_P loss(+)  +  max(0, mean_U loss(-) - prior * mean_P loss(-)).
Where the second part falls below zero (the model has begun to fit unlabelled positives as negatives), its step is
reversed, as the non-negative estimator asks.

Bounds of the fit: at most ``POSITIVES`` positives and ``UNLABELLED`` unlabelled documents, taken in the order of a hash of
their text; the feature counts cover all training documents and all positives.  Labels, language, source and id never enter a score.

Defined results: null and empty texts are scored from the intercept.  Labels that are null or outside 0 and 1 are ignored;
a document labelled both ways counts as toxic.  Without any positive every score is the prior (0 if
unknown).  Repeated rows are scored each for itself.  A null id counts as the empty text when folds are formed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import first_texts, forgetting, only, strict_words, texts

FOLDS = 5
POSITIVES, UNLABELLED = 4_000, 20_000
SLOTS = 1 << 17
FEATURES = 4_096
MARKS = 1 << 20  # hash values of toxic ids that are told apart before the exact join
STARTS = (4, 5, 6, 7)  # lengths, in characters, of the word beginnings that are features


class Slots(dict):
    """Hash slots of a word and its beginnings, remembered for the frequent words."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        text = word.decode(errors="replace")
        parts = [b"=" + word, *(f"^{text[:n]}".encode() for n in STARTS if n < len(text))]
        value = self[word] = tuple(xxhash.xxh3_64_intdigest(p) % SLOTS for p in parts)
        return value


_slots = Slots()


def held_out(id_col: Column) -> Column:
    """Whether a document is in the fold that no label is learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per slot, added up for the whole partition; slot -1 counts all of them."""
    found = np.zeros(SLOTS + 1, np.int64)
    for batch in forgetting(batches, _slots):
        for text in texts(batch.column("text")):
            slots = {s for w in set(strict_words(text)) for s in _slots[w]}
            found[np.fromiter(slots, np.int64, len(slots))] += 1
            found[-1] += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(np.where(at == SLOTS, -1, at), pa.int32()), "n": pa.array(found[at])})


def _counts(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per slot and their number."""
    got = rows.select("text").mapInArrow(_count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS + 1, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def confirmed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids``, however many these are.

    Which of ``MARKS`` hash values occur is sent to every task; only rows that have one of them, few where few documents
    are toxic, go through the exact join, which may shuffle their texts.
    """
    ids = ids.select(F.col("id").cast(rows.schema["id"].dataType).alias("id"))
    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS)).cast("int").alias("mark")
    near = rows.select("*", mark).join(F.broadcast(ids.select(mark).distinct()), "mark", "left_semi").drop("mark")
    return near.join(ids, "id", "left_semi")


def _chosen(word_counts: Counter, at: dict[int, int]) -> dict[int, int]:
    """Occurrences of each chosen slot."""
    out: dict[int, int] = {}
    for w, n in word_counts.items():
        for s in _slots[w]:
            i = at.get(s)
            if i is not None:
                out[i] = out.get(i, 0) + n
    return out


def _rows(found: dict[int, int], n: int, width: int) -> tuple[list[int], list[float]]:
    """Two values for a feature: that it occurs, and the square root of its share of the words."""
    keys = list(found)
    return keys + [k + width for k in keys], [1.0] * len(keys) + [(found[k] / n) ** 0.5 * 5 for k in keys]


def _sparse(shared):
    kind = pa.struct([("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at = shared.value
        for batch in forgetting(batches, _slots):
            out = []
            for text in texts(batch):
                words = strict_words(text)
                out.append(dict(zip(("at", "x"), _rows(_chosen(Counter(words), at), len(words), len(at)))))
            yield pa.array(out, kind)

    return run


def _scores(shared):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w = shared.value
        for batch in forgetting(batches, _slots):
            out = []
            for text in texts(batch):
                words = strict_words(text)
                keys, x = _rows(_chosen(Counter(words), at), len(words), len(at))
                z = w[-1] + sum(w[k] * v for k, v in zip(keys, x))
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.array(out, pa.float64())

    return run


def select(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, most: int = FEATURES) -> np.ndarray:
    """Slots that positives hold more often than others do, by far more than chance, at most ``most`` of them."""
    if not n_p or not n_u:
        return np.empty(0, np.int64)
    rate = (p + u + 1) / (n_p + n_u + 2)
    z = (p / n_p - u / n_u) / np.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u))
    good = np.flatnonzero((z > 5) & (p >= 3))
    return good[np.argsort(-z[good], kind="stable")][:most]


def fit(pos: list, unl: list, prior: float, width: int, steps: int = 2000, seed: int = 11) -> np.ndarray:
    """Weights (last one the intercept) of a linear classifier, by Adam on the non-negative risk."""
    w, m, v = (np.zeros(2 * width + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    if not pos or not unl:
        return w
    rng, step, mean = np.random.default_rng(seed), 0, np.zeros_like(w)
    batch = min(1000, len(unl))

    def gather(rows, pick):
        n = [len(rows[i][0]) for i in pick]
        empty = not sum(n)
        at = np.empty(0, np.int64) if empty else np.concatenate([rows[i][0] for i in pick]).astype(np.int64)
        x = np.empty(0) if empty else np.concatenate([rows[i][1] for i in pick]).astype(float)
        doc = np.repeat(np.arange(len(pick)), n)
        z = np.bincount(doc, x * w[at], len(pick)) + w[-1]
        return at, x, doc, np.clip(z, -30, 30)

    def slope(part, err):
        at, x, doc, z = part
        return np.append(np.bincount(at, err[doc] * x, 2 * width), err.sum()) / len(z)

    while step < steps:
        order = rng.permutation(len(unl))
        for begin in range(0, len(order), batch):
            u = gather(unl, order[begin : begin + batch])
            p = gather(pos, rng.choice(len(pos), min(batch, len(pos)), replace=False))
            up, uu = 1 / (1 + np.exp(-p[3])), 1 / (1 + np.exp(-u[3]))
            negative = np.logaddexp(0, u[3]).mean() - prior * np.logaddexp(0, p[3]).mean()
            rest = slope(u, uu) - prior * slope(p, up)
            g = prior * slope(p, up - 1) + rest if negative >= 0 else -rest
            g[:-1] += 1e-4 * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            if step > steps // 2:  # reversed steps make the weights swing: their mean is the result
                mean += (w - mean) / (step - steps // 2)
    return mean


def _parts(sample: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    got = sample.toArrow().combine_chunks()
    if not got.num_rows:
        return []
    f = got["f"].combine_chunks()
    at, x = f.field("at"), f.field("x")
    ends, at, x = at.offsets.to_numpy(), at.values.to_numpy(), x.values.to_numpy()
    return [(at[a:b], x[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """The chosen slots, the weights and the class prior, learned outside the held-out fold."""
    spark = docs.sparkSession
    said = only(labels, id=id_col, toxic=label_col).filter(~held_out(F.col("id")) & F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    said = said.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = said.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(max(n_toxic / n if n else 0.0, 1e-3), 0.999)
    rows = only(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text")).filter(~held_out(F.col("id")))
    toxic = confirmed(rows, said.filter("toxic = 1").select("id"))
    (every, total), (p, n_p) = _counts(rows), _counts(toxic)
    chosen = select(p, every - p, n_p, total - n_p)
    at = {int(s): i for i, s in enumerate(chosen)}
    sparse = F.arrow_udf(_sparse(spark.sparkContext.broadcast(at)), "struct<at:array<int>,x:array<float>>").asNondeterministic()
    f = sparse("text").alias("f")
    pos = _parts(first_texts(toxic, positives, f))
    unl = _parts(first_texts(rows, unlabelled, f))
    return {"at": at, "prior": prior, "weights": fit(pos, unl, prior, len(at))}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast((model["at"], model["weights"]))
    judge = F.arrow_udf(_scores(shared), "double").asNondeterministic()
    rows = only(docs, id=id_col, text=text_col).select("id", judge(F.coalesce("text", F.lit(""))).alias("score"))
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Quality classifier from weak labels.

1. Heuristic labellers vote good, bad or nothing on every text; they overlap and contradict each other.
2. The votes of all documents are counted by pattern (at most 3^labellers rows leave the tasks).  Expectation-
   maximisation over these counts estimates each labeller's accuracy and how common good texts are, without labels.
3. Each pattern gets a posterior.  Posteriors of a bounded hash-ordered sample (``FIT_ROWS`` documents) are the soft labels
   of a linear scorer over hashed word shapes, which also judges texts on which no labeller voted.
4. Every text is scored; ``kept`` means a score of 0.5 or more.

Defined results: a null or empty text has no words, gets the last labeller's vote alone and is scored from the
intercept and its length feature.  Repeated rows vote and are scored each for itself (the vote counts are counts of rows).  An
empty table gives an empty result.  Other columns pass through unchanged; result columns take free names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import first_texts, forgetting, fresh, only, plain_words, texts

FIT_ROWS = 20_000
BUCKETS = 1 << 14
SYMBOLS = frozenset(b"#*$%&|<>")

# A labeller votes 1 (good), 0 (bad) or -1 (nothing) on the shares below.  Each fault of form is seen by at least two of
# them, and those that know one fault only say nothing about texts without it.
LABELLERS = ("symbols", "marks", "capitals", "stutter", "variety", "plain", "sentences", "prose")
SHARES = ("words", "symbol", "marks", "capital", "stutter", "distinct", "plain", "ends")
_DOUBLED = frozenset((b"!!", b"$$", b"%%", b"&&", b"##", b"**"))
_PLAIN = re.compile(rb"[\x22'(]?[A-Za-z0-9\x80-\xff][A-Za-z0-9\x80-\xff'/@_.-]*[.,;:?!)\x22]{0,2}").fullmatch


def shares(words: list[bytes]) -> tuple[float, ...]:
    """What the labellers look at, as shares of the words (0 without words)."""
    n = len(words)
    if not n:
        return (0.0,) * len(SHARES)
    ends = [w[-2:] for w in words]
    symbol = sum(1 for e in ends if e[-1] in SYMBOLS)
    marks = sum(1 for e in ends if e in _DOUBLED)
    closed = sum(1 for e in ends if e[-1] in b".,;:?")
    capital = sum(1 for w in words if len(w) > 1 and w.isupper())
    stutter = sum(map(bytes.__eq__, words[1:], words))
    different = set(words)
    plain = sum(1 for w in words if _PLAIN(w)) - marks
    # The variety of texts of any length: distinct words against what fits a text of so many words.
    return (float(n), symbol / n, marks / n, capital / n, stutter / n, len(different) / n**0.8, plain / n, closed / n)


def votes(s: tuple[float, ...]) -> list[int]:
    n, symbol, marks, capital, stutter, distinct, plain, ends = s
    if not n:
        return [-1] * (len(LABELLERS) - 1) + [0]
    faults = (plain < 0.75, capital > 0.25, stutter > 0.2, n >= 20 and distinct < 0.35)
    return [
        0 if symbol > 0.15 else -1,
        0 if marks > 0.15 else -1,
        0 if capital > 0.25 else -1,
        0 if stutter > 0.2 else -1,
        -1 if n < 20 else 0 if distinct < 0.35 else 1 if distinct > 0.8 else -1,
        0 if plain < 0.75 else 1 if plain > 0.95 else -1,
        -1 if n < 30 else 1 if 0.03 < ends < 0.4 else 0 if ends < 0.005 else -1,
        0 if any(faults) else 1 if plain > 0.95 and capital < 0.1 and stutter < 0.05 else -1,
    ]


class Shapes(dict):
    """Shape of a word: upper X, lower x, letter beyond ASCII l, digit 9, other bytes as they are; runs are cut to two."""

    TABLE = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 else 57 if 48 <= b <= 57 else 108 if b >= 128 else b for b in range(256))

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 100_000:
            self.clear()
        raw, out = word[:8].translate(self.TABLE) + b"~" + word[-4:].translate(self.TABLE), bytearray()
        for c in raw:
            if len(out) < 2 or not out[-1] == out[-2] == c:
                out.append(c)
        value = self[word] = bytes(out)
        return value


_shapes, _slots = Shapes(), {}


def _slot(feature: bytes) -> int:
    at = _slots.get(feature)
    if at is None:
        if len(_slots) > 100_000:
            _slots.clear()
        at = _slots[feature] = 1 + xxhash.xxh3_64_intdigest(feature) % (BUCKETS - 1)
    return at


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values: how often word shapes occur and follow each other, as square roots of shares.

    Slot 0 is the length feature.
    """
    n = len(words)
    counts: dict[bytes, int] = {}
    before, old = b"^", b""
    for w in words:
        shape = _shapes[w]
        counts[shape] = counts.get(shape, 0) + 1
        pair = b"=" if w == old else before + b" " + shape
        counts[pair] = counts.get(pair, 0) + 1
        before, old = shape, w
    slots = np.fromiter((_slot(k) for k in counts), np.int32, len(counts))
    values = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)) / max(n, 1))
    return np.append(slots, np.int32(0)), np.append(values, np.float32(np.log1p(n) / 10)).astype(np.float32)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> dict:
    """EM for two classes and conditionally independent labellers over counted vote patterns.

    ``accuracy[j, c, v]`` is the chance that labeller j, if it votes, says v (0 or 1) on a text of class c; saying nothing
    is no evidence for either class.  EM starts from labellers being right more often than not, which fixes which
    class is the good one; one pseudo-count per cell keeps estimates inside (0, 1) when a vote never occurs.
    """
    m = patterns.shape[1] if patterns.ndim == 2 else 0
    prior, accuracy = 0.8, np.empty((m, 2, 2))
    accuracy[:, 0], accuracy[:, 1] = (0.8, 0.2), (0.2, 0.8)
    posterior = np.full(len(patterns), prior)
    said = [(j, v, patterns[:, j] == v) for j in range(m) for v in (0, 1)]
    for _ in range(rounds):
        log = np.repeat(np.log([[1 - prior], [prior]]), len(patterns), axis=1)
        for j, v, at in said:
            log += np.log(accuracy[j, :, v])[:, None] * at
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        before, prior = prior, (weight[1].sum() + 1) / (counts.sum() + 2)
        for j, v, at in said:
            accuracy[j, :, v] = weight[:, at].sum(axis=1) + 1
        accuracy /= accuracy.sum(axis=2, keepdims=True)
        if abs(prior - before) < 1e-9:
            break
    return {"prior": prior, "accuracy": accuracy, "posterior": posterior}


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, rounds: int = 25, seed: int = 5) -> np.ndarray:
    """Weights (last one the intercept) of a logistic scorer on soft labels, by Adam on batches of documents."""
    w, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    if not rows:
        return w
    rng, step = np.random.default_rng(seed), 0
    size = min(512, len(rows))
    for _ in range(rounds * max(1, 4000 // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            slots = np.concatenate([rows[i][0] for i in pick])
            values = np.concatenate([rows[i][1] for i in pick])
            doc = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            z = np.bincount(doc, values * w[slots], len(pick)) + w[-1]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft[pick]) / len(pick)
            g = np.append(np.bincount(slots, err[doc] * values, BUCKETS), err.sum()) + 1e-6 * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def _vote_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in forgetting(batches):
        yield pa.array([votes(shares(plain_words(t))) for t in texts(batch)], pa.list_(pa.int8()))


def _fit_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Votes and features from one function: Spark gives each of two a worker of its own, all of which then live on."""
    kind = pa.struct([("votes", pa.list_(pa.int8())), ("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])
    for batch in forgetting(batches, _shapes, _slots):
        out = []
        for t in texts(batch):
            words = plain_words(t)
            slots, values = features(words)
            out.append({"votes": votes(shares(words)), "slots": slots, "values": values})
        yield pa.array(out, kind)


_JUDGED = pa.struct([("score", pa.float64()), ("posterior", pa.float64()), ("votes", pa.list_(pa.int8()))])


def _judge_batches(shared):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, known, prior = shared.value
        for batch in forgetting(batches, _shapes, _slots):
            out = []
            for t in texts(batch):
                words = plain_words(t)
                slots, values = features(words)
                said = votes(shares(words))
                score = 1 / (1 + np.exp(-np.clip(values @ w[slots] + w[-1], -30, 30)))
                out.append({"score": float(score), "posterior": known.get(tuple(said), prior), "votes": said})
            yield pa.array(out, _JUDGED)

    return run


def train(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> dict:
    """The label model and the scorer's weights, from one vote count over all texts and one bounded sample."""
    vote = F.arrow_udf(_vote_batches, "array<tinyint>").asNondeterministic()
    make = F.arrow_udf(_fit_batches, "struct<votes:array<tinyint>,slots:array<int>,values:array<float>>").asNondeterministic()
    rows = only(docs, text=text_col).select(F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.select(F.array_join(vote("text").cast("array<string>"), ",").alias("votes")).groupBy("votes").count().collect()
    counted.sort(key=lambda r: r["votes"])
    patterns = np.array([[int(x) for x in r["votes"].split(",")] for r in counted], np.int64).reshape(-1, len(LABELLERS))
    label = estimate(patterns, np.array([r["count"] for r in counted], float))
    known = {tuple(p): float(q) for p, q in zip(patterns.tolist(), label["posterior"])}
    got = first_texts(rows, fit_rows, make("text").alias("f")).toArrow().combine_chunks()
    data, soft = [], np.empty(0)
    if got.num_rows:
        f = got["f"].combine_chunks()
        slots, values = f.field("slots"), f.field("values")
        ends, slots, values = slots.offsets.to_numpy(), slots.values.to_numpy(), values.values.to_numpy()
        data = [(slots[a:b], values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        soft = np.array([known.get(tuple(v), label["prior"]) for v in f.field("votes").to_pylist()])
    return {"prior": float(label["prior"]), "accuracy": label["accuracy"], "posterior": known, "weights": fit_linear(data, soft).astype(np.float32)}


def judge(docs: DataFrame, model: dict, text_col: str = "text", out: str = "judged") -> tuple[DataFrame, str]:
    """Add a struct of the scorer's probability that a text is good, the label model's posterior, and the votes.

    Returns the frame and the column's name.  What is broadcast is one weight per bucket and one posterior per pattern.
    """
    name = fresh(docs, out)[0]
    shared = docs.sparkSession.sparkContext.broadcast((model["weights"], model["posterior"], model["prior"]))
    call = F.arrow_udf(_judge_batches(shared), "struct<score:double,posterior:double,votes:array<tinyint>>").asNondeterministic()
    return docs.withColumn(name, call(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))), name


def clean(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents scored 0.5 or more by a model trained on all of them, with their own columns only."""
    judged, name = judge(docs, train(docs, text_col, fit_rows), text_col)
    return judged.filter(F.col(name)["score"] >= 0.5).drop(name)

"""Alignment of two tokenizers over every text: shared cuts, groups, links and corpus-wide link counts.

A text gets the tokens of a byte-level model (A, over a space and the text) and of a piece model (B, which adds that space
itself).  Two dictionaries take the byte offset where each token ends to the token's index.  The offsets that are keys
of both, in order, cut the two id lists into groups; inside a group every A token is linked with the B tokens
whose bytes overlap it.  All groups of a text are expanded together: between two neighbouring ends of either list
lies exactly one link.

Each text is encoded once.  What is written per document are its figures and its distinct id pairs with the number of
links of each; exploding them counts, per pair, the documents that hold it, and per A id the highest of these counts.  To
give the counts back to the documents they are broadcast while they are at most ``BROADCAST_PAIRS`` rows, and joined with the
documents' pairs by shuffle beyond that; both give the same rows.

Defined results: a null or empty text, and one whose A or B tokens do not spell a space and the text, has no tokens, zeros
for all figures and an empty ``groups``.  Very long texts are encoded whole.  Repeated documents are aligned and counted
each for itself.  An empty table gives no rows.  Other columns are left behind.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm.common import only, resident
from quotemill.session import materialize

BROADCAST_PAIRS = 1_000_000

# Fixed value: the word pattern that byte-level models of this kind are defined with.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_BLANKS, _TWO_BLANKS = re.compile(r"\s{1000}"), re.compile(r"\s\s")

_RECORD = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteModel:
    """A byte-level model read from its file; special tokens' names in a text are plain text.

    Where the vocabulary's order is the order of the merges, as in most such models, ids are ranks and the faster of two
    libraries may encode; it cannot take long runs of blanks, so texts with those go to the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.raw = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.raw[i] = bytes(letters[c] for c in token)
        for token in spec["added_tokens"]:
            self.raw[token["id"]] = token["content"].encode()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        before = spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.ranked = None
        if plain and len(vocab) == 256 + len(merged) and all(i == 256 + k for k, i in enumerate(merged)):
            self.ranked = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks={self.raw[i]: i for i in vocab.values()}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        # A long run of blanks covers two of every 400th characters.
        if self.ranked is None or _TWO_BLANKS.search(text[::400]) and _LONG_BLANKS.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.ranked.encode_ordinary(text), np.int64)


class PieceModel:
    """A piece model read from its file, and the bytes of its pieces; pieces without bytes of their own spell nothing."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace("▁", " ").encode()


class Strings:
    """Byte strings by number, joined for an array of numbers."""

    def __init__(self, raw: list[bytes]):
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(raw), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)]


class Aligner:
    """The two models and what is derived from their vocabularies."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteModel(byte_path), PieceModel(piece_path)
        self.raw_a, self.raw_b = Strings(self.a.raw), Strings(self.b.raw)
        # Each id as text with what may follow it: inside its side of a group, or at the end of that side.
        words = [f"{i}{after}" for i in range(len(self.a.raw)) for after in ",|"] + [f"{i}{after}" for i in range(len(self.b.raw)) for after in ",;"]
        self.words, self.shift = np.array(words, "S").view(np.uint8).reshape(len(words), -1), 2 * len(self.a.raw)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both models, or none if either does not spell a space and the text."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        raw, a, b = np.frombuffer(f" {text}".encode(), np.uint8), self.a.encode(f" {text}"), self.b.encode(text)
        return (a, b) if np.array_equal(self.raw_a.joined(a), raw) and np.array_equal(self.raw_b.joined(b), raw) else (none, none)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the last A and B token of each group, and the linked A and B ids, one per link."""
        ends_a, ends_b = np.cumsum(self.raw_a.sizes[a]), np.cumsum(self.raw_b.sizes[b])
        index_a, index_b = dict(zip(ends_a.tolist(), range(len(a)))), dict(zip(ends_b.tolist(), range(len(b))))
        shared = sorted(index_a.keys() & index_b.keys())
        last_a, last_b = (np.fromiter(map(index.__getitem__, shared), np.int64, len(shared)) for index in (index_a, index_b))
        alone = np.ones(len(b), bool)
        alone[last_b] = False  # ends of B that no A token shares
        cuts = np.sort(np.concatenate([ends_a, ends_b[alone]]), kind="stable")
        return last_a, last_b, a[np.searchsorted(ends_a, cuts)], b[np.searchsorted(ends_b, cuts)]

    def spelled(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """The groups as text: ``a1,a2|b1;a3|b2,b3``."""
        before_a, before_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(last_b - before_b + 1, before_a)
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, before_b)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a], codes[place_b] = 2 * a, self.shift + 2 * b
        codes[place_a[last_a]] += 1
        codes[place_b[last_b]] += 1
        letters = self.words[codes].ravel()
        return letters[letters != 0].tobytes().decode("ascii")[:-1]


_models: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """The two models of a pair of paths, read once per Python worker."""
    key = byte_path, piece_path
    if key not in _models:
        _models[key] = Aligner(*key)
    return _models[key]


def _each(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("align")
        models = aligner(byte_path, piece_path)
        for batch in batches:
            figures, groups, pairs, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                a, b = models.tokens(text or "")
                if not len(a):
                    figures.append((0, 0, 0, 0))
                    groups.append("")
                    pairs.append(np.empty(0, np.int64))
                    times.append(np.empty(0, np.int64))
                    continue
                last_a, last_b, linked_a, linked_b = models.align(a, b)
                figures.append((len(a), len(b), len(last_a), len(linked_a)))
                groups.append(models.spelled(a, b, last_a, last_b))
                found, count = np.unique((linked_a << 32) | linked_b, return_counts=True)
                pairs.append(found)
                times.append(count)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(f, pa.int64()) for f in zip(*figures)], pa.array(groups, pa.string()),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(pairs), pa.int64())),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times), pa.int32()))],
                ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return run


def tokens_aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id``, figures, its groups as text, its distinct id pairs (A id * 2^32 + B id) and the links of each.

    The paths must name the model files on every executor.
    """
    mine = only(docs, id=id_col, text=text_col)
    return mine.mapInArrow(_each(byte_path, piece_path), f"id {mine.schema['id'].dataType.simpleString()}, {_RECORD}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per linked id pair: ``pair``, the number ``n`` of documents that hold it, and whether that is the highest of its A id.

    An A id has at most as many pairs as B has ids, which bounds the window.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    top = F.expr("max(n) OVER (PARTITION BY shiftright(pair, 32))")
    return counts.withColumn("best", F.col("n") == top)


def _looked_up(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            weight = times.flatten().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(weight * found[at])])[ends] for found in (best, n)]
            kept = [c for c, name in zip(batch.columns, batch.schema.names) if name not in ("pairs", "times")]
            names = [name for name in batch.schema.names if name not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(np.diff(s), pa.int64()) for s in sums]], [*names, "n_best", "count_sum"])

    return run


def with_counts(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The documents' figures with ``n_best`` and ``count_sum``; both frames are read more than once, so pass written ones."""
    spark = aligned.sparkSession
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]
    if counts.count() <= broadcast_pairs:
        table = counts.orderBy("pair").toArrow()
        columns = (table.column("pair").to_numpy(), table.column("n").to_numpy(), table.column("best").to_numpy().astype(np.int64))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(rest).schema)
        return aligned.mapInArrow(_looked_up(spark.sparkContext.broadcast(columns)), f"{fields}, n_best bigint, count_sum bigint")
    keyed = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "align-rows")  # ids alone may repeat
    linked = keyed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    links = F.col("times").cast("long")
    sums = (linked.join(counts, F.col("pairs") == F.col("pair")).groupBy("row")
            .agg(F.sum(F.when(F.col("best"), links).otherwise(0)).alias("n_best"), F.sum(links * F.col("n")).alias("count_sum")))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return keyed.join(sums, "row", "left").select(*rest, *zero)


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
          broadcast_pairs: int = BROADCAST_PAIRS, groups: Column | None = None) -> DataFrame:
    """Every document with its figures and groups, ``n_best`` (links whose pair is one of the most frequent of its A id) and
    ``count_sum`` (the counts of its links, summed).  ``groups`` may stand for the groups' text, such as a digest of it.
    """
    aligned = tokens_aligned(docs, byte_path, piece_path, id_col, text_col)
    aligned = materialize(aligned if groups is None else aligned.withColumn("groups", groups), "align")
    counts = materialize(pair_counts(aligned), "align-counts")
    return with_counts(aligned, counts, broadcast_pairs).withColumnRenamed("id", id_col)

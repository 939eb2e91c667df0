"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

A window is ``width`` consecutive words of an item (all its words if it has fewer).  A document word is hit if it
lies in an occurrence of a window.  Every window of 10 words holds one 5-word piece that starts at a multiple of 5
in its item, so the automaton holds only these pieces: about as many states as the items have characters, not
ten times that.  A match is extended word by word to both sides as far as item and document agree; runs of
at least ``width`` words are hits.  Word positions are mapped back to character offsets of the original text.

The items are measured first.  Up to ``BLOCK_BYTES`` of text make one automaton, sent to the workers once; a larger
benchmark is cut into blocks by hash and the documents are scanned once per block, with the result so far
written to the shared folder between the passes.

Defined results: a null or empty text has no words and no hits.  An item without words has no windows.  An item
without id hits words, but cannot be named.  Items repeated under one id count once.  Repeated documents are
scanned each for itself.  Other columns of the documents pass through; the result column takes a free name.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import STRICT_WORD, fresh, only, resident, strict_words, texts
from quotemill.session import materialize

WIDTH = 10
BLOCK_BYTES = 2 << 20

_SPAN = pa.struct([("word_from", pa.int32()), ("word_to", pa.int32()), ("char_from", pa.int32()), ("char_to", pa.int32())])
_FOUND = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])
_SCHEMA = "struct<n_words:bigint,items:array<string>,spans:array<struct<word_from:int,word_to:int,char_from:int,char_to:int>>>"


class Windows:
    """The automaton of some items and the search for runs of shared words."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.width = width
        step = max(1, width // 2)  # a window of this width holds an aligned piece of this many words
        self.names = [name for name, _ in items]
        self.words = [strict_words(text) for _, text in items]
        starts: dict[bytes, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            if not words:
                continue
            size = step if len(words) >= width else len(words)
            for at in range(0, len(words) - size + 1, step if len(words) >= width else len(words)):
                starts.setdefault(b" ".join(words[at : at + size]), []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, places in starts.items():
            # Latin-1 makes one character of each byte, so positions are byte positions.
            self.machine.add_word(f" {piece.decode('latin-1')} ", (len(piece) + 2, places))
        if starts:
            self.machine.make_automaton()
        self.empty = not starts

    def find(self, words: list[bytes]) -> tuple[set[int], list[tuple[int, int]]]:
        """Numbers of the items that occur in ``words``, and the merged word ranges that they hit."""
        if self.empty or not words:
            return set(), []
        joined = b" " + b" ".join(words) + b" "
        gaps, done, items, runs = None, {}, set(), []
        for end, (size, places) in self.machine.iter(joined.decode("latin-1")):
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            here = int(np.searchsorted(gaps, end + 1 - size))
            for k, at in places:
                if done.get((k, here - at), -1) > here:
                    continue  # inside a run already followed on this diagonal
                run = self._run(words, self.words[k], here, at)
                done[k, here - at] = run[1]
                if run[1] - run[0] >= min(self.width, len(self.words[k])):
                    items.add(k)
                    runs.append(run)
        return items, _merged(runs)

    @staticmethod
    def _run(words: list[bytes], item: list[bytes], here: int, at: int) -> tuple[int, int]:
        a, i = here, at
        while a > 0 and i > 0 and words[a - 1] == item[i - 1]:
            a, i = a - 1, i - 1
        b, j = here, at
        while b < len(words) and j < len(item) and words[b] == item[j]:
            b, j = b + 1, j + 1
        return a, b


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def located(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Word ranges with the character offsets they have in the original text."""
    if not runs:
        return []
    places = [m.span() for m in re.finditer(STRICT_WORD, text.decode().translate(_ASCII_LOWER))]
    return [dict(word_from=a, word_to=b, char_from=places[a][0], char_to=places[b - 1][1]) for a, b in runs]


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_built: dict[str, Windows] = {}


def _each(shared, key: str, width: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        resident("decontam", _built.clear)
        if key not in _built:
            _built.clear()  # one automaton at a time
            _built[key] = Windows(shared.value, width)
        windows = _built[key]
        for batch in batches:
            rows = []
            for text in texts(batch):
                words = strict_words(text)
                items, runs = windows.find(words)
                names = sorted({windows.names[k] for k in items if windows.names[k] is not None})
                rows.append({"n_words": len(words), "items": names, "spans": located(text, runs)})
            yield pa.array(rows, _FOUND)

    return run


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         width: int = WIDTH, block_bytes: int = BLOCK_BYTES, out: str = "found") -> tuple[DataFrame, str]:
    """Add a struct column: ``n_words``, ``n_hit``, ``items`` (ids as sorted strings) and ``spans`` of the hits.

    Returns the frame and the name of the column.
    """
    spark = docs.sparkSession
    items = only(benchmark, name=item_id, text=item_text).select(F.col("name").cast("string").alias("name"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    parts = [fresh(docs, f"_block_{i}")[0] for i in range(blocks)]
    state = docs
    for i, part in enumerate(parts):
        mine = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        rows = [(r["name"], bytes(r["raw"])) for r in mine.select("name", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).collect()]
        scan = F.arrow_udf(_each(spark.sparkContext.broadcast(rows), uuid.uuid4().hex, width), _SCHEMA).asNondeterministic()
        state = state.withColumn(part, scan(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
        if i + 1 < blocks:
            state = materialize(state, "decontam")
    name = fresh(docs, out)[0]
    return state.withColumn(name, _together([F.col(p) for p in parts])).drop(*parts), name


def _together(parts: list[Column]) -> Column:
    """One result from those of the blocks; words hit by several blocks count once."""
    spans = F.sort_array(F.flatten(F.array(*[p["spans"] for p in parts])))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[p["items"] for p in parts]))))
    places = F.flatten(F.transform(spans, lambda s: F.sequence(s["word_from"], s["word_to"] - 1)))
    n_hit = F.when(F.size(spans) > 0, F.size(F.array_distinct(places))).otherwise(0).cast("long")
    return F.struct(parts[0]["n_words"].alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), spans.alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, **named) -> DataFrame:
    """The documents that no window of the benchmark occurs in, with their own columns only."""
    state, found = find(docs, benchmark, **named)
    return state.filter(F.col(found)["n_hit"] == 0).drop(found)

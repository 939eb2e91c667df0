"""Exact encoding and decoding with a merge-type (BPE) piece model.

The model file gives the vocabulary; the library is used to read it, never to encode.  Encoding walks the text by
backtracking: an Aho-Corasick pass lists the vocabulary pieces that start at every position, the walk takes the
longest, and a piece may follow another only if merging the two pieces' text from single characters gives
exactly these two back (the compatibility check, remembered per pair).  If nothing fits, the position is marked in a
bitfield as failed and the walk returns to the piece before.  Merging is by score, then leftmost, so a sequence
whose neighbours are all compatible is the one that full merging gives.

No merge crosses two characters that are neighbours in no piece, so the text is cut where the vocabulary allows it (before
spaces, before a stop that follows a word, at line ends).  The cuts of many texts are walked side by side, a step of all of them
at a time on arrays of piece numbers; cuts of more than ``LONG_CHUNK`` characters are walked alone.  The ids of
short cuts are remembered in two generations of bounded size, a cut that is met again moving to the younger one, and the
verdicts on pairs in a table of fixed size.

Defined results: a null or empty text has no ids and decodes to the empty text.  Characters without a piece become
their UTF-8 bytes' pieces.  Repeated rows are encoded each for itself; other input columns pass through unchanged.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from quotemill.llm.common import fresh, leaving, resident

MARK = "▁"
LONG_CHUNK = 64
YOUNG_CHUNKS = 150_000  # remembered cuts of the younger generation; the older one is no larger
PAIR_SLOTS = 1 << 20  # remembered verdicts on pairs of pieces
GROUP_CHARS = 1 << 18  # characters of text that are cut and walked together


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, buf[at : at + size]
            at += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, buf[at : at + size]
            at += size


class Remembered:
    """Ids of short cuts: what is looked up stays, what was not for a generation goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def find(self, cuts: dict[str, bytes | None]) -> list[str]:
        """Fill in the ids that are known; returns the cuts that are not."""
        young, old, new = self.young.get, self.old.get, []
        for cut in cuts:
            found = young(cut)
            if found is None:
                found = old(cut)
                if found is None:
                    new.append(cut)
                    continue
                self.young[cut] = found
            cuts[cut] = found
        return new

    def keep(self, learned: dict[str, bytes]) -> None:
        self.young.update({c: ids for c, ids in learned.items() if len(c) <= LONG_CHUNK})
        if len(self.young) > self.most:
            self.young, self.old = {}, dict(itertools.islice(self.young.items(), len(self.young) - self.most, None))


class Verdicts:
    """Yes or no for pairs of piece numbers, each in the slot of its hash; a new pair takes over the slot."""

    def __init__(self, judge, pieces: int, slots: int):
        self.judge, self.pieces = judge, pieces
        self.keys, self.said, self.mask = np.full(slots, -1, np.int64), np.zeros(slots, bool), slots - 1

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left * self.pieces + right
        slots = ((pairs * 0x9E3779B97F4A7C1) >> 20) & self.mask
        out = self.said[slots]
        new = np.flatnonzero(self.keys[slots] != pairs)
        if len(new):
            unknown, place = np.unique(pairs[new], return_inverse=True)
            said = np.array([self.judge(*divmod(p, self.pieces)) for p in unknown.tolist()], bool)
            out[new] = said[place]
            self.keys[slots[new]], self.said[slots[new]] = pairs[new], out[new]
        return out


class PieceModel:
    """A piece model of the merge type, read from ``path``."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        pieces, trainer, normal = [], {}, {}
        with open(path, "rb") as f:
            raw = f.read()
        for number, value in _fields(raw):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model is not of the merge type")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only models that keep the text's characters and spaces as they are can be encoded exactly")
        self.dummy = bool(normal.get(3, 1))
        self.text = [p[1].decode() for p in pieces]
        kinds = [p.get(3, self.NORMAL) for p in pieces]
        if self.USER in kinds or self.UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.score = {t: struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for t, p, k in zip(self.text, pieces, kinds) if k == self.NORMAL}
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, kinds)) if k == self.NORMAL}
        self.unknown = kinds.index(self.UNKNOWN)
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds)) if k == self.BYTE}
        self.raw = [bytes([int(t[3:5], 16)]) if k == self.BYTE else b"" if k == self.CONTROL else t.replace(MARK, " ").encode()
                    for t, k in zip(self.text, kinds)]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.is_byte = np.array([k == self.BYTE for k in kinds])
        if any("\0" in t for t in self.id):
            raise ValueError("pieces with a zero character are not supported")
        # Pieces that merging never gives are no candidates.  The number after the last piece stands for any character without one.
        self.candidates = {t: i for t, i in self.id.items() if len(t) == 1 or self._whole(t)}
        self.other = len(self.text)
        single = {t for t in self.id if len(t) == 1}
        self.single = np.full(0x110000, self.other, np.int64)
        self.single[[ord(c) for c in single]] = [self.id[c] for c in single]
        if any(c not in single for t in self.id for c in t):
            raise ValueError("longer pieces of characters that are no pieces are not supported")
        self.machine = ahocorasick.Automaton()
        for t, i in self.candidates.items():  # single characters need no match, and would widen the automaton's root
            if len(t) > 1:
                self.machine.add_word(t, i)
        self.machine.make_automaton()
        self.length = np.ones(self.other + 1, np.int64)
        self.shorter = np.full(self.other + 1, -1, np.int64)  # the longest candidate that is a proper beginning of the piece
        for t, i in self.candidates.items():
            self.length[i] = len(t)
            self.shorter[i] = next((self.candidates[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.candidates), -1)
        self.cuts = self._cutter().findall
        self.merges: dict[int, tuple] = {}  # at most one entry per piece
        self.fits = Verdicts(self._fits, self.other + 1, PAIR_SLOTS)
        self.known = Remembered(YOUNG_CHUNKS)

    def _cutter(self) -> re.Pattern:
        """A pattern whose matches cover a text and between which no piece reaches over.

        Cuts are before space marks, around blanks that no longer piece holds, and where a character that may follow a
        letter inside a piece (or follow one that may) is followed by one that may not.
        """
        if any(MARK in t.lstrip(MARK) for t in self.id):
            return re.compile(r"(?s).+")
        follows: dict[str, set[str]] = {}
        for t in self.id:
            for a, b in zip(t, t[1:]):
                if a != MARK:
                    follows.setdefault(a, set()).add(b)
        inner = {c for t in self.id if len(t) > 1 for c in t}
        within, todo = set(), [c for c in inner if c.isalpha()]
        while todo:
            c = todo.pop()
            if c not in within and c != MARK:
                within.add(c)
                todo.extend(follows.get(c, ()))
        blank = "".join(c for c in "\n\t\r" if c not in inner)
        late = f"[{''.join(map(re.escape, sorted(within)))}]" if within else r"(?!)."
        early = f"[^{''.join(map(re.escape, sorted(within)))}{MARK}{blank}]"
        return re.compile(f"{MARK}+{early}*{late}*|{early}+{late}*|{late}+" + (f"|[{blank}]" if blank else ""))

    def _whole(self, text: str) -> bool:
        return len(self.merge(text)[0]) == 1

    def merge(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """Merge single characters by score, then leftmost, until no neighbouring pair is a piece.

        Returns the parts left, the scores of the merges in order, and the first and last part before each merge
        and at the end.
        """
        parts, get = list(text), self.score.get
        scores, first, last = [], parts[:1], parts[-1:]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            first.append(parts[0])
            last.append(parts[-1])
        return parts, scores, first, last

    def _merges(self, piece: int) -> tuple:
        if piece not in self.merges:
            self.merges[piece] = self.merge(self.text[piece])
        return self.merges[piece]

    def _fits(self, before: int, after: int) -> bool:
        """Whether merging the text of two pieces gives these two.

        As long as no merge crosses the border, either side merges as it does alone, so the recorded merges of the
        two are played against each other: the better next one goes first, and a crossing pair that is better
        than both (or as good as the right side's, which lies further right) breaks the border.
        """
        if before == self.other or after == self.other:
            return True  # no piece holds such a character
        (_, a, _, last), (_, b, first, _) = self._merges(before), self._merges(after)
        get, i, j, na, nb = self.score.get, 0, 0, len(a), len(b)
        while True:
            cross = get(last[i] + first[j])
            left, right = (a[i] if i < na else None), (b[j] if j < nb else None)
            if left is None and right is None:
                return cross is None
            if left is not None and (right is None or left >= right):
                if cross is not None and cross > left:
                    return False
                i += 1
            else:
                if cross is not None and cross >= right:
                    return False
                j += 1

    def longest(self, text: str) -> np.ndarray:
        """The number of the longest candidate that starts at each position."""
        found = self.single[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        matches = np.fromiter(itertools.chain.from_iterable(self.machine.iter(text)), np.int64).reshape(-1, 2)
        # Ends rise, so of the pieces that start at one position the longest comes last, and the last one written stays.
        found[matches[:, 0] + 1 - self.length[matches[:, 1]]] = matches[:, 1]
        return found

    def walk(self, longest: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each position of the text the piece that ends there, -1 if none does, for cuts ``begin`` to ``end``.

        All cuts take a step at a time: on to the next position, on to a shorter piece, or back to the piece before.
        """
        length, shorter = self.length, self.shorter
        path, failed = np.full(len(longest) + 1, -1, np.int64), np.zeros(len(longest) + 1, bool)
        at, start, stop = begin.copy(), begin, end
        last, piece = np.full(len(at), -1, np.int64), longest[begin]
        while len(at):
            none = piece < 0
            if none.any():
                back = np.flatnonzero(none)
                if (last[back] < 0).any():
                    raise AssertionError("no sequence of pieces covers the text")
                failed[at[back]] = True
                left = last[back]
                piece[back] = shorter[left]
                at[back] -= length[left]
                last[back] = np.where(at[back] == start[back], -1, path[at[back]])
                none = piece < 0
            goal = at + length[piece]
            good = ~none
            good[good] = ~failed[goal[good]]
            ask = np.flatnonzero(good & (last >= 0))
            good[ask] = self.fits.of(last[ask], piece[ask])
            path[goal[good]] = piece[good]
            bad = ~good & ~none
            piece[bad] = shorter[piece[bad]]
            last[good], at[good] = piece[good], goal[good]
            more = at < stop
            on = good & more
            piece[on] = longest[at[on]]
            if not more.all():
                at, start, stop, last, piece = at[more], start[more], stop[more], last[more], piece[more]
        # Positions that a walk left again hold pieces too: only those on the way back from the end count.
        kept, at, start = np.zeros(len(path), bool), end.copy(), begin
        while len(at):
            kept[at] = True
            at = at - length[path[at]]
            more = at > start
            at, start = at[more], start[more]
        path[~kept] = -1
        return path

    def walk_alone(self, longest: np.ndarray, begin: int, end: int) -> list[int]:
        """The pieces of one cut, with the same steps."""
        first, length, shorter = longest[begin:end].tolist(), self.length, self.shorter
        failed, at, out = bytearray(end - begin + 1), 0, []
        piece, one = first[0], np.empty(1, np.int64)
        heard: dict[tuple[int, int], bool] = {}
        while at < len(first):
            while piece >= 0:
                goal = at + int(length[piece])
                if not failed[goal]:
                    pair = (out[-1], piece) if out else None
                    if pair is not None and pair not in heard:
                        if len(heard) > PAIR_SLOTS:
                            heard.clear()
                        heard[pair] = bool(self.fits.of(one * 0 + pair[0], one * 0 + pair[1])[0])
                    if pair is None or heard[pair]:
                        break
                piece = int(shorter[piece])
            if piece >= 0:
                out.append(piece)
                at = goal
                piece = first[at] if at < len(first) else -1
                continue
            if not out:
                raise AssertionError("no sequence of pieces covers the text")
            failed[at] = 1
            left = out.pop()
            at -= int(length[left])
            piece = int(shorter[left])
        return out

    def learn(self, cuts: list[str]) -> dict[str, bytes]:
        """Packed ids of cuts, from one pass of the automaton over all of them."""
        text = "\0".join(cuts)  # no piece holds this character, so no match crosses two cuts
        longest = self.longest(text)
        sizes = np.array([len(c) for c in cuts], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        out, short = {}, sizes <= LONG_CHUNK
        path = self.walk(longest, begin[short], begin[short] + sizes[short])
        pieces = path[path >= 0].astype("<i4")
        upto = np.concatenate([[0], np.cumsum(path >= 0)])
        raw, odd = pieces.tobytes(), np.concatenate([[0], np.cumsum(pieces == self.other)])
        where = np.flatnonzero(short)
        first, last = upto[begin[where]], upto[begin[where] + sizes[where] + 1]
        first += path[begin[where]] >= 0  # a position may end the cut before
        for k, a, b, strange in zip(where.tolist(), first.tolist(), last.tolist(), (odd[last] > odd[first]).tolist()):
            out[cuts[k]] = self._packed(cuts[k], pieces[a:b].tolist()) if strange else raw[4 * a : 4 * b]
        for k in np.flatnonzero(~short).tolist():
            out[cuts[k]] = self._packed(cuts[k], self.walk_alone(longest, int(begin[k]), int(begin[k] + sizes[k])))
        return out

    def _packed(self, cut: str, pieces: list[int]) -> bytes:
        """Ids as bytes; a character without a piece gives those of its bytes."""
        ids, at = [], 0
        for piece in pieces:
            if piece != self.other:
                ids.append(piece)
            elif self.byte:
                ids.extend(self.byte[b] for b in cut[at].encode())
            else:
                ids.append(self.unknown)
            at += int(self.length[piece])
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; groups of bounded size are worked on together."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > GROUP_CHARS:
                yield from self._encode_group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[np.ndarray]:
        begin = MARK if self.dummy else ""
        cuts = [self.cuts(begin + t.replace(" ", MARK)) if t else [] for t in texts]
        ids: dict[str, bytes | None] = dict.fromkeys(itertools.chain.from_iterable(cuts))
        new = self.known.find(ids)
        if new:
            learned = self.learn(new)
            ids.update(learned)
            self.known.keep(learned)
        return [np.frombuffer(b"".join(map(ids.__getitem__, part)), "<i4") for part in cuts]

    def forget(self) -> None:
        """Drop what was remembered of texts, and the small objects that lie between and would hold its memory."""
        self.known = Remembered(YOUNG_CHUNKS)
        self.merges = {}

    def encode(self, text: str) -> np.ndarray:
        return next(iter(self.encode_all([text])))

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; a byte run that is no valid UTF-8 gives one U+FFFD per bad byte."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._mended(ids)
        return text[1:] if self.dummy and text[:1] == " " and self._marked(ids) else text

    def _marked(self, ids: np.ndarray) -> bool:
        """Whether the text's first character comes from a piece rather than from a byte."""
        first = next((i for i in ids.tolist() if self.raw[i]), None)
        return first is not None and not self.is_byte[first] and first != self.unknown

    def _mended(self, ids: np.ndarray) -> str:
        out, run = [], bytearray()
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.raw[i]
                continue
            while run:
                size = next((k for k in (1, 2, 3, 4) if _valid(run[:k], k)), 0)
                out.append(run[:size].decode() if size else "�")
                del run[: size or 1]
            if i is not None:
                out.append(self.raw[i].decode())
        return "".join(out)


def _valid(part: bytes, size: int) -> bool:
    try:
        return len(part) == size and len(part.decode()) == 1
    except UnicodeDecodeError:
        return False


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a path, read once per Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))


def _held(path: str) -> PieceModel:
    """The model for a task; it stays in the worker until another operator's task comes."""
    resident("pieces", _models.clear)
    return model(path)


def _encoded(m: PieceModel, texts: pa.Array) -> list[np.ndarray]:
    return list(m.encode_all([t or "" for t in texts.to_pylist()]))


def _round(m: PieceModel, texts: pa.Array) -> pa.Array:
    rows = _encoded(m, texts)
    return pa.StructArray.from_arrays([_lists(rows), pa.array([m.decode(r) for r in rows], pa.string())], ["ids", "decoded"])


def _each_text(path: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _held(path)
        for batch in leaving(batches, m.forget):
            yield _lists(_encoded(m, batch))

    return run


def _each_round(path: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _held(path)
        for batch in leaving(batches, m.forget):
            yield _round(m, batch)

    return run


def _each_ids(path: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = _held(path).decode
        for batch in batches:
            ends, values = batch.offsets.to_numpy(), batch.values.to_numpy()
            yield pa.array([decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string())

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of ``text_col`` as ``array<int>`` column ``out`` (replacing one of that name).

    ``path`` must name the model file on every executor; it is read once per worker.
    """
    by_text = F.arrow_udf(_each_text(path), ArrayType(IntegerType())).asNondeterministic()
    return docs.withColumn(out, by_text(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of the ids in ``ids_col`` as column ``out``; null ids count as none."""
    by_ids = F.arrow_udf(_each_ids(path), StringType()).asNondeterministic()
    return docs.withColumn(out, by_ids(F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """Encoded and decoded documents, and the names of the two new columns, which clash with no input column.

    Both steps run in one worker, so the model is held once and the ids do not travel back to be decoded.
    """
    ids, back, both = fresh(docs, "ids", "decoded", "_both")
    turn = F.arrow_udf(_each_round(path), "struct<ids:array<int>,decoded:string>").asNondeterministic()
    coded = docs.withColumn(both, turn(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return coded.withColumns({ids: F.col(both)["ids"], back: F.col(both)["decoded"]}).drop(both), ids, back

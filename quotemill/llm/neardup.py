"""Near-duplicate groups from MinHash bands and odd sketches, with every link confirmed on the full sets.

1. One pass makes each text's set of word shingles (64-bit hashes), its size, a digest, the band keys of its
   MinHash samples and an odd sketch: a bitmap in which every sample flips one bit, so that the population count
   of the XOR of two bitmaps estimates high similarities closely.
2. Texts with one digest are one class; only classes go on, copies never form pairs.
3. In each band bucket all classes are compared with the smallest one (a star, not all pairs).  The sketch drops
   hopeless pairs; of the rest each class first tries its likeliest partner.  Confirmed links give components.
4. What is left are pairs in one bucket but in different components.  Buckets are cut into pieces of bounded size
   and pieces are compared two by two inside tasks: sketches first, then the full sets of what they leave.  Pairs of
   one component are never looked at, and a task returns links only, so no list of pairs is ever made.
5. Components over the links by alternating large-star and small-star steps on written tables.

Two sets of similarity 0.75 share no band with probability (1 - 0.75^4)^32 = 5e-6; a true link fails the sketch test
with less than 1e-6.  No bucket, partner or candidate is capped.

Defined results: a null text, or one without words, has the empty set, is linked with nothing and kept.  Fewer words
than a shingle make one shingle.  Rows without id take part, but cannot name a component: if no row of a
group has an id, its component is null and the row with the smallest key is kept.  Repeated rows share their fate.  Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import forgetting, fresh, lower_ascii, only, plain_words, texts
from quotemill.session import materialize

SHINGLE = 5
THRESHOLD = (75, 100)  # intersection / union, compared as products
BANDS, ROWS = 32, 4
SAMPLES = 256
SKETCH_BITS = 1024
PIECE = 512  # classes of a bucket that one task compares with as many others
STAR_ONLY = 2  # a bucket of so few classes has no pair beside its star
# Most differing sketch bits of a pair of similarity 0.75: mean 113, standard deviation 12, plus five of these.
FAR_BITS = 174

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_STEP = (_rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)[:, None]
_MUL = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_FOLD = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)

_SIG = pa.struct([("n", pa.int64()), ("class", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
_SIG_SQL = "struct<n:bigint,class:bigint,bands:array<bigint>,sketch:binary>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd products, so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher(dict):
    """64-bit hashes of words, remembered for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = Hasher()


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = plain_words(lower_ascii(text))
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        return _mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64))
    total = h[: len(h) - width + 1] * _STEP[0]
    for i in range(1, width):
        total = total + h[i : len(h) - width + 1 + i] * _STEP[i]
    return np.unique(_mixed(total))


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash samples of a set: the least value under each of ``SAMPLES`` hash functions."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        part = (low[at : at + 2048][None, :] ^ _XOR) * _MUL
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(best, part.min(axis=1), out=best)
    return best


def sketch(best: np.ndarray) -> bytes:
    """Fold samples into a parity bitmap: each flips the bit that its place and value choose."""
    bit = _mixed(best.astype(np.uint64) * _FOLD + np.arange(SAMPLES, dtype=np.uint64) * _MIX) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        key = _mixed(key ^ rows[:, r])
    return key.astype(np.int64)


def _signatures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in forgetting(batches, _words):
        out = []
        for text in texts(batch):
            found = shingles(text)
            if not len(found):
                out.append({"n": 0, "class": 0, "bands": [], "sketch": b""})
                continue
            digest = np.frombuffer(xxhash.xxh3_64_digest(found.tobytes()), np.int64)
            best = samples(found)
            out.append({"n": len(found), "class": int(digest[0]), "bands": band_keys(best), "sketch": sketch(best)})
        yield pa.array(out, _SIG)


def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in forgetting(batches, _words):
        yield pa.array([shingles(t).tobytes() for t in texts(batch)], pa.binary())


def _share(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Sizes of the intersections of pairs of sets."""
    for a, b in batches:
        out = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
               for x, y in zip(a.to_pylist(), b.to_pylist())]
        yield pa.array(out, pa.int64())


def _distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Differing bits of pairs of sketches."""
    size = SKETCH_BITS // 64
    for a, b in batches:
        x = np.frombuffer(b"".join(a.to_pylist()), np.uint64).reshape(-1, size)
        y = np.frombuffer(b"".join(b.to_pylist()), np.uint64).reshape(-1, size)
        yield pa.array(np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table, one row per document: id, row key, set size, class (64 bits of the set's digest), bands, sketch.

    At 1e10 different sets three pairs of them are expected to share a class by chance.
    """
    sign = F.arrow_udf(_signatures, _SIG_SQL).asNondeterministic()
    rows = only(docs, id=id_col, text=text_col).select("id", row_key(), sign(F.coalesce("text", F.lit(""))).alias("s"))
    return materialize(rows.select("id", "row", "s.*"), "neardup-signatures")


def row_key() -> Column:
    return F.xxhash64(F.col("id").isNull(), "id", "text").alias("row")


def components(links: DataFrame) -> DataFrame:
    """Connected components as (node, root), the root being the smallest node; nodes without links do not appear.

    Large-star and small-star steps alternate until the edges no longer change; each step joins edges with one
    minimum per node, so no neighbourhood is ever gathered, and writes its edges, so lost executors repeat little.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "neardup-edges")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "neardup-edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "neardup-edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge table: its row count and the XOR of its rows' hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b) pairs of classes, those whose full sets reach the threshold.  ``sets`` is (class, n, set)."""
    share = F.arrow_udf(_share, "bigint").asNondeterministic()
    a = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    b = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(b, "b").join(a, "a").withColumn("both", share("sa", "sb"))
    return both.filter(F.col("both") * THRESHOLD[1] >= (F.col("na") + F.col("nb") - F.col("both")) * THRESHOLD[0]).select("a", "b")


def _sizes_fit(na: Column, nb: Column) -> Column:
    """The smaller set is at least the threshold's share of the larger; else no intersection suffices."""
    return F.least(na, nb) * THRESHOLD[1] >= F.greatest(na, nb) * THRESHOLD[0]


def star_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, far): every member of a bucket with the bucket's smallest class, if sizes and sketches allow a link."""
    distance = F.arrow_udf(_distance, "bigint").asNondeterministic()
    a = found.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    b = found.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    pairs = members.filter("class <> lo").select(F.col("lo").alias("a"), F.col("class").alias("b")).distinct()
    both = pairs.join(b, "b").join(a, "a").filter(_sizes_fit(F.col("na"), F.col("nb")))
    return both.select("a", "b", distance("ka", "kb").alias("far")).filter(F.col("far") <= FAR_BITS)


def rest_links(members: DataFrame, full: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links between classes of one bucket that are in different components so far.

    Pieces hold one large component or several small ones; two pieces of one component are never compared.  A task
    gets two pieces with their full sets and returns links only, at most one for any two components.
    """
    named = members.join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("key", "class", F.coalesce("root", "class").alias("root"))
    counts = materialize(named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")), "neardup-counts")
    open_keys = (
        counts.groupBy("key")
        .agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("all"), F.sum(F.when(F.col("c") <= PIECE, F.col("c")).otherwise(0)).alias("small"))
        .filter(f"roots > 1 AND all > {STAR_ONLY}")
        .select("key", "small")
    )
    large = F.col("c") > PIECE
    tags = counts.join(open_keys, "key").select(
        "key",
        "root",
        large.alias("large"),
        F.when(large, F.col("root")).otherwise(F.lit(0)).alias("of"),
        F.ceil(F.when(large, F.col("c")).otherwise(F.col("small")) / PIECE).cast("long").alias("parts"),
    )
    tags = materialize(tags, "neardup-pieces")
    if tags.isEmpty():
        return members.sparkSession.createDataFrame([], "a long, b long")
    pieces = tags.select("key", "large", "of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("no")).distinct()
    mine = F.struct("large", "of", "no")
    left, right = pieces.select("key", mine.alias("p")), pieces.select("key", mine.alias("q"))
    duels = left.join(right, "key").filter("p <= q AND NOT (p.large AND q.large AND p.of = q.of)")
    placed = named.join(tags, ["key", "root"]).select(
        "key", "class", "root", F.struct("large", "of", F.pmod(F.xxhash64("class"), "parts").alias("no")).alias("piece")
    )
    first = placed.join(duels.withColumn("piece", F.col("p")), ["key", "piece"]).withColumn("side", F.lit(0))
    second = placed.join(duels.filter("p <> q").withColumn("piece", F.col("q")), ["key", "piece"]).withColumn("side", F.lit(1))
    ring = first.union(second).select("key", F.xxhash64("p", "q").alias("duel"), "side", "class", "root")
    ring = ring.join(full.select("class", "n", "bands", "sketch", "set"), "class")
    return ring.groupBy("key", "duel").applyInPandas(_compare, "a long, b long").distinct()


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Links between two pieces (or within one) across components.

    Sizes and sketches drop most pairs, and of the bands that a pair shares only the first one looks at it; the
    others are counted on the full sets.
    """
    key = group.key.iloc[0]
    left, right = group[group.side == 0], group[group.side == 1]
    if not len(left):  # hashing may leave a piece empty
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    alone = not len(right)
    if alone:
        right = left
    c1, r1, n1, k1, b1 = _columns(left)
    c2, r2, n2, k2, b2 = _columns(right)
    band = int(np.flatnonzero(b1[0] == key)[0])
    sets = [np.frombuffer(x, np.uint64) for x in right["set"]]
    joined: dict[int, int] = {}

    def top(x):
        while x in joined:
            x = joined[x]
        return x

    out = []
    for i, own in enumerate(left["set"]):
        ok = (r2 != r1[i]) & (np.minimum(n2, n1[i]) * THRESHOLD[1] >= np.maximum(n2, n1[i]) * THRESHOLD[0])
        if alone:
            ok[: i + 1] = False
        at = np.flatnonzero(ok)
        at = at[np.bitwise_count(k2[at] ^ k1[i]).sum(axis=1) <= FAR_BITS]
        at = at[(b2[at] == b1[i]).argmax(axis=1) == band]
        at = at[[top(r) != top(r1[i]) for r in r2[at].tolist()]] if len(at) else at
        if not len(at):
            continue
        own = np.frombuffer(own, np.uint64)
        flat = np.concatenate([sets[j] for j in at])
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(n2[at])[:-1]]))
        for j in at[both * THRESHOLD[1] >= (n1[i] + n2[at] - both) * THRESHOLD[0]]:
            x, y = top(int(r1[i])), top(int(r2[j]))
            if x != y:
                joined[max(x, y)] = min(x, y)
                out.append((min(c1[i], c2[j]), max(c1[i], c2[j])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _columns(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    bits = np.frombuffer(b"".join(part.sketch), np.uint64).reshape(-1, SKETCH_BITS // 64)
    return part["class"].to_numpy(), part.root.to_numpy(), part.n.to_numpy(), bits, np.stack(part.bands.to_numpy())


def links(docs: DataFrame, signed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (a, b) of confirmed links between classes; together they connect all that is linked."""
    found = materialize(signed.filter("n > 0").dropDuplicates(["class"]).select("class", "row", "n", "bands", "sketch"), "neardup-classes")
    keyed = found.select("class", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("key", "lo")
    members = materialize(keyed.join(shared, "key"), "neardup-buckets")
    wanted = members.select("class").distinct().join(found, "class")
    source = only(docs, id=id_col, text=text_col).select(row_key(), "text")
    source = source.join(wanted, "row").dropDuplicates(["row"])
    sets = F.arrow_udf(_sets, "binary").asNondeterministic()
    full = materialize(source.select("class", "n", "bands", "sketch", sets("text").alias("set")), "neardup-sets")
    stars = materialize(star_pairs(members, full), "neardup-stars")
    likely = stars.groupBy("b").agg(F.min(F.struct("far", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    tried = materialize(likely, "neardup-tried")
    first = materialize(confirm(tried, full), "neardup-links")
    roots = components(first)
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    apart = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    left = stars.select("a", "b").join(tried, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left").filter(apart).select("a", "b")
    return materialize(first.union(confirm(left, full)).union(rest_links(members, full, roots)).distinct(), "neardup-links")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id of its group) and ``kept``."""
    return _grouped(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    signed = signatures(docs, id_col, text_col)
    roots = components(links(docs, signed, id_col, text_col))
    copies = signed.filter("n > 0").groupBy("class").agg(F.min("id").alias("first"), F.min("row").alias("lead"))
    named = copies.join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("class", "first", "lead", F.coalesce("root", "class").alias("root"))
    heads = named.groupBy("root").agg(F.min("first").alias("component_id"), F.min("lead").alias("lead"))
    of_class = named.select("class", "root").join(heads, "root").select("class", "component_id", "lead")
    rows = signed.select("id", "row", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(of_class, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    named_kept = F.col("id").eqNullSafe(F.col("component_id"))
    kept = F.when(F.col("n") == 0, True).when(F.col("component_id").isNull(), F.col("row") == F.col("lead")).otherwise(named_kept)
    return rows.select("id", "row", "n", component.alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that repeat another: one of each group stays, with its own columns only.

    Rows of one id and one text are one document; one of them stays.
    """
    found = materialize(_grouped(docs, id_col, text_col).select("row", "kept"), "neardup-groups")
    mine, gone = fresh(docs, "_row", "_gone")
    null_safe = F.xxhash64(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    left = docs.withColumn(mine, null_safe)
    out = found.filter("NOT kept").select(F.col("row").alias(gone)).distinct()
    left = left.join(out, left[mine] == out[gone], "left_anti")
    if not found.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        left = left.dropDuplicates([mine])
    return left.drop(mine)

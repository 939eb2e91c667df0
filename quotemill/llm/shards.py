"""Shard placement by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards.  A document descends from the root and at every level goes to the child with
the smallest draw.  A shard draws -ln(u) / weight with u hashed from the document's key and the shard; a rack's draw is
the smallest of its shards', a region's the smallest of its racks'.  The smallest of exponential draws is an
exponential draw of the summed weight, so every child gets weight / (sum of weights) of what reaches its parent.

A shard's draw depends on nothing but key, shard and weight, so a change of weights moves documents only into or out
of the shards, racks and regions whose weight changed, and a new shard, wherever in the tree, takes documents only
into itself: the tree of n + 1 shards is the tree of n, grown by one, for every n.

Slots number the documents of a shard without gaps: rows are numbered inside (written file, shard) and shifted by
the counts of the files before, so no task holds a whole shard.

Defined results: a null or empty text has size 16 and checksum 0.  Rows without key are one key.  Repeated rows go to
one shard and get a slot each.  Other input columns are not returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import only
from quotemill.session import materialize

ROW_BYTES = 16
REGION_RACKS, RACK_SHARDS = 4, 5  # racks of a region, shards of a rack in trees laid out by ``Tree.of``


@dataclass(frozen=True)
class Tree:
    """Leaves as (region, rack, shard, weight); racks and regions weigh what they hold."""

    leaves: tuple[tuple[int, int, int, float], ...] = ()

    @staticmethod
    def of(shards: int) -> Tree:
        """Equal shards, rack by rack and region by region."""
        return Tree().grown(shards)

    def grown(self, more: int = 1, weight: float = 1.0) -> Tree:
        """The tree with ``more`` new shards, in the last rack and region while these have room."""
        leaves = list(self.leaves)
        for _ in range(more):
            shard = 1 + max((leaf[2] for leaf in leaves), default=-1)
            rack = max((leaf[1] for leaf in leaves), default=0)
            if sum(leaf[1] == rack for leaf in leaves) >= RACK_SHARDS:
                rack += 1
            region = next((leaf[0] for leaf in leaves if leaf[1] == rack), None)
            if region is None:
                region = max((leaf[0] for leaf in leaves), default=0)
                if len({leaf[1] for leaf in leaves if leaf[0] == region}) >= REGION_RACKS:
                    region += 1
            leaves.append((region, rack, shard, weight))
        return Tree(tuple(leaves))

    def reweighted(self, weights: dict[int, float]) -> Tree:
        return Tree(tuple((g, r, s, weights.get(s, w)) for g, r, s, w in self.leaves))

    def place(self, key: Sequence[str]) -> Column:
        """Struct of region, rack and shard of a row with these key columns; equal draws go to the smaller numbers."""
        regions: dict[int, dict[int, list[tuple[int, float]]]] = {}
        for region, rack, shard, weight in self.leaves:
            if weight > 0:
                regions.setdefault(region, {}).setdefault(rack, []).append((shard, weight))
        racks = {g: [_least([_draw(key, g, r, s, w) for s, w in below]) for r, below in held.items()] for g, held in regions.items()}
        return _least([_least(draws) for draws in racks.values()])


def _least(draws: list[Column]) -> Column:
    return F.least(*draws) if len(draws) > 1 else draws[0]


def _draw(key: Sequence[str], region: int, rack: int, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of the hash of key and shard, and where the shard is."""
    h = F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in key], F.lit(shard)), 12)
    cost = -F.ln((h + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))
    return F.struct(cost.alias("draw"), F.lit(region).alias("region"), F.lit(rack).alias("rack"), F.lit(shard).alias("shard"))


def assign(docs: DataFrame, shards: int | Tree, id_col: str = "doc_id", text_col: str = "text", grow: int = 1) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``grown_shard`` is the place in the tree grown by ``grow`` shards.
    """
    tree = shards if isinstance(shards, Tree) else Tree.of(shards)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = only(docs, id=id_col, text=text_col).select("id", (F.length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumns({"now": tree.place(["id"]), "then": tree.grown(grow).place(["id"])})
    rows = rows.select("id", "size", "text_crc32", "now.region", "now.rack", "now.shard", F.col("then.shard").alias("grown_shard"))
    out = with_slots(materialize(rows, "shards"), "shard")
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.col("grown_shard").cast("int").alias("grown_shard"), "region", "rack",
    )


def with_slots(written: DataFrame, shard: str) -> DataFrame:
    """Number the rows of each shard from 0, in the order of the written files and of the rows in them."""
    rows = written.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = rows.groupBy(shard, "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(shard, "_file").orderBy("_row")
    numbered = rows.join(offsets, [shard, "_file"]).withColumn("slot", F.col("_before") + F.row_number().over(local) - 1)
    return numbered.withColumn("slot", F.col("slot").cast("long")).drop("_file", "_row", "_before")

"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard.  At each level every child of the current node draws
a number from the hash of (row key, child's name) and the row goes to the child with the
smallest ``-ln(u) / weight``: a child of weight w gets the share w / sum of weights.  A draw
depends on nothing but the key and the child, so a change of one child's weight moves rows
only into or out of that child, and inside a subtree whose weights don't change nothing
moves at all.  Capacity is added as a subtree of its own (`grown`): one more shard is a new
region with one rack, so rows move only into the new shard.

The law is ``key``: the key and the tree decide, whatever other rows there are.

Edge cases: a null key is drawn like the empty string; repeated rows share a shard and get
slots of their own; null texts have size 1 and texts of any length are measured whole; of equal draws
the first child by name wins; an empty table gives an empty result; further
columns are kept by `assign` (``shard`` is replaced) and not read by `placed`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.ranking import numbered


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


#: Two regions of two racks of two shards.
PRODUCTION_TREE = tuple(Leaf(f"r{s // 4}", f"k{s // 2}", s) for s in range(8))


def grown(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard, as a region of its own."""
    n = max(leaf.shard for leaf in tree) + 1
    return (*tree, Leaf(f"r+{n}", f"k+{n}", n, weight))


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / w with u from 48 bits of an MD5, in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(name + "/"), key)), 1, 12), 16, 10).cast("double")
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(2**48))) / F.lit(float(weight))


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; the first name wins a tie."""
    if len(children) == 1:
        return children[0][2]
    draws = [(_draw(key, name, w), value) for name, w, value in children]
    best = F.least(*[d for d, _ in draws])
    out = draws[-1][1]
    for d, value in reversed(draws[:-1]):
        out = F.when(d == best, value).otherwise(out)
    return out


def shard_of(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The shard of a key: an expression of hashes, so it needs no shuffle and no state."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    region_children = []
    for region, racks in sorted(regions.items()):
        rack_children = []
        for rack, leaves in sorted(racks.items()):
            shards = [(f"{region}/{rack}/{x.shard}", x.weight, F.lit(x.shard)) for x in leaves]
            rack_children.append((f"{region}/{rack}", sum(x.weight for x in leaves), _choose(key, shards)))
        region_children.append(
            (region, sum(x.weight for r in racks.values() for x in r), _choose(key, rack_children))
        )
    return _choose(key, region_children)


def assign(docs: DataFrame, tree: tuple[Leaf, ...] = PRODUCTION_TREE) -> DataFrame:
    """``docs`` with a column shard."""
    return docs.withColumn("shard", shard_of(F.col("doc_id"), tree))


def placed(docs: DataFrame, tree: tuple[Leaf, ...] = PRODUCTION_TREE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row; slots are gapless per shard."""
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
    ).withColumns({"shard": shard_of(F.col("doc_id"), tree), "grown_shard": shard_of(F.col("doc_id"), grown(tree))})
    return numbered(rows, "shard", F.col("doc_id"), ["size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )

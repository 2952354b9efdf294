"""Connected components of a link table, without collecting links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.plans.scratch import discard, materialised, materialised_at

HELD = 100_000  # links that one task takes at once: 1.6 MB of numbers


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); component is the smallest node.

    Alternating large-star and small-star steps: every step replaces a node's links by links
    to the smallest neighbour, so the number of links never grows, and the rounds grow with
    the logarithm of the longest chain.  A hub's minimum is found by partial aggregation and
    its rows are joined, which adaptive execution can split.  HELD links or fewer need no rounds: one task
    joins them, since a round costs a dozen shuffles however few links there are.  Each round is written to the
    shared checkpoint folder and the round before it removed, so one table stays.  Null ends and self-links are ignored; no links give no rows.
    """
    kind = dict(links.dtypes)["a"]
    edges = (
        links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges, path = materialised_at(edges, "links")
    if kind in ("bigint", "int", "string") and edges.count() <= HELD:
        found = materialised(_joined_at_once(edges, kind), "links")
        discard(links.sparkSession, path)
        return found
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m")).hint("merge")  # files of links are small for their rows, by which Spark would broadcast
        # large-star: neighbours above u move to u's smallest neighbour
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small-star: neighbours below u, and u itself, move to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m")).hint("merge")
        small = (
            large.join(small_low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        nxt, next_path = materialised_at(small, "links")
        discard(links.sparkSession, path)
        # stars only: no node is both an upper and a lower end, and every upper end has one link
        several = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        both_ends = nxt.select("u").join(nxt.select(F.col("v").alias("u")).distinct().hint("merge"), "u", "left_semi")
        stars = several.unionByName(both_ends).isEmpty()
        edges, path = nxt, next_path
        if stars:
            break
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return out.unionByName(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))


def _joined_at_once(edges: DataFrame, kind: str) -> DataFrame:
    """(node, component) of HELD links (u, v) at most, in one task."""

    def run(batches):
        import pyarrow as pa

        forest, nodes, arrow = LocalForest(), set(), pa.int64()
        for batch in batches:
            u, v = batch.column(0), batch.column(1)
            arrow = u.type
            for x, y in zip(u.to_pylist(), v.to_pylist()):
                forest.union(x, y)
                nodes |= {x, y}
        if nodes:
            ordered = sorted(nodes)
            yield pa.RecordBatch.from_arrays([pa.array(ordered, arrow), pa.array([forest.find(x) for x in ordered], arrow)], ["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


class LocalForest:
    """Union-find over the few rows of one task; the smaller id becomes the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in self.parent if self.find(x) != x]

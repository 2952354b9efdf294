"""Near-duplicate grouping by perceptual hash.

Equal hashes are one hash.  Two hashes within t bits agree in at least r of t + r bands, so hashes
meet under keys of r bands and are verified.  More bands a key (r) make more keys with fewer hashes
each: r follows the number of hashes and changes no result.  For classes the hashes of a key are
compared in pairs of blocks of bounded size, and each task sends on a spanning forest of its links,
so neither a hot key (blank pictures) nor a large class makes a table of pairs.  `hash_pairs` is the
search for the pairs themselves.
"""

from __future__ import annotations

import posixpath
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.ids import group_id
from lumenlake.functions.similarity import phash_halves, valid_phash
from lumenlake.operators.components import LocalForest, components
from lumenlake.operators.order import all_equal
from lumenlake.plans.scratch import materialised
from lumenlake.sources.merge import MergeTable

BLOCK = 2_048  # hashes of a key that are compared with each other at once


def distinct_hashes(media: DataFrame) -> DataFrame:
    """(phash, hi, lo, first_id): one row per valid hash, with its smallest media id."""
    hi, lo = phash_halves(F.col("phash"))
    return (
        media.where(valid_phash(F.col("phash")))
        .select(F.lower("phash").alias("phash"), "id")
        .groupBy("phash")
        .agg(F.min("id").alias("first_id"))
        .withColumns({"hi": hi, "lo": lo})
    )


def _bands(threshold: int, agreeing: int) -> list[int]:
    """Masks of the bands that 64 bits are cut into."""
    n = min(64, threshold + agreeing)
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def agreeing_bands(hashes: int) -> int:
    """How many bands a key has, so that few hashes share a key by chance: 13, 17 or 21 bits of a key at 8 bits."""
    return 2 if hashes < 1_000_000 else 3 if hashes < 100_000_000 else 4


def _keyed(hashes: DataFrame, threshold: int, agreeing: int) -> DataFrame:
    """(phash, whole, n, key): each hash, as 64 bits, under its keys; n numbers the choice of bands."""
    whole = F.shiftleft(F.col("hi"), 32).bitwiseOR(F.col("lo"))
    bands = _bands(threshold, agreeing)
    masks = [sum(chosen) for chosen in combinations(bands, min(agreeing, len(bands)))]
    key = F.posexplode(F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m: m.bitwiseAND(F.col("whole"))))
    return hashes.select("phash", whole.alias("whole")).select("phash", "whole", key.alias("n", "key"))


def hash_pairs(hashes: DataFrame, threshold: int, agreeing: int = 2) -> DataFrame:
    """(a, b, distance) of distinct hashes within the threshold, a before b, each pair once.

    A pair counts under the first bands in which it agrees, so that pairs need not be made distinct.
    """
    bands = _bands(threshold, agreeing)
    chosen = F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(len(bands)), min(agreeing, len(bands)))])
    keyed = _keyed(hashes, threshold, agreeing)
    left = keyed.select("n", "key", F.col("phash").alias("a"), F.col("whole").alias("x"))
    right = keyed.select("n", "key", F.col("phash").alias("b"), F.col("whole").alias("y"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    same = [F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(i)) for i, m in enumerate(bands)]
    first = F.slice(F.filter(F.array(*same), lambda i: i.isNotNull()), 1, min(agreeing, len(bands)))
    met = left.join(right.hint("merge"), ["n", "key"]).where("a < b").withColumn("distance", F.bit_count(differ))
    return met.where((F.col("distance") <= threshold) & (first == F.get(chosen, F.col("n")))).select("a", "b", "distance")


def hash_links(hashes: DataFrame, threshold: int, agreeing: int) -> DataFrame:
    """(a, b): links that join all hashes within the threshold, as signed 64 bits; a forest per task."""
    keyed = _keyed(hashes, threshold, agreeing).drop("phash")
    sizes = keyed.groupBy("n", "key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("c"))
    met = keyed.join(sizes.where("c > 1").drop("c").hint("merge"), ["n", "key"])  # Spark takes the keys for as few as the hashes
    block = F.pmod(F.xxhash64("whole"), F.col("blocks").cast("long")).cast("int")
    placed = (
        met.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("n", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "whole")
    )
    dealt = placed.repartition("n", "key", "i", "j").sortWithinPartitions("n", "key", "i", "j")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        forest, held = LocalForest(), None

        def link(whole):
            bits = whole.view(np.uint64)
            for at in range(0, len(whole), 256):
                near = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, at:]) <= threshold
                for x, y in zip(*(c.tolist() for c in np.nonzero(np.triu(near, 1)))):
                    forest.union(int(whole[at + x]), int(whole[at + y]))

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("n", "key", "i", "j", "whole")]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            cuts = np.nonzero(np.any([np.diff(c) != 0 for c in columns[:4]], axis=0))[0] + 1
            for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
                if b - a > 1:
                    link(columns[4][a:b])
            held = [c[cuts[-1] if len(cuts) else 0 :].copy() for c in columns]
        if held is not None:
            link(held[4])
        edges = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def membership(media: DataFrame, threshold: int = 8) -> DataFrame:
    """(id, root): each media row with a valid hash and the smallest id of its class.

    The classes of all media take a few shuffles: write the result and keep it until media change.
    Tables with a row for each medium, hash or class are joined by a merge, here and below: a broadcast passes them through the driver.
    Media are read once, for their ids and hashes, which are written: the driver's plans then hold neither their scan nor its columns.
    """
    rows = materialised(media.where(valid_phash(F.col("phash"))).select("id", F.lower("phash").alias("phash")), "media")
    hashes = materialised(distinct_hashes(rows), "hashes")
    linked = components(hash_links(hashes, threshold, agreeing_bands(hashes.count())))
    whole = F.shiftleft(F.col("hi"), 32).bitwiseOR(F.col("lo"))
    classes = hashes.withColumn("whole", whole).join(linked.hint("merge"), F.col("whole") == linked["node"], "left").select(
        "phash", "first_id", F.coalesce("component", "whole").alias("cls")
    )
    roots = classes.groupBy("cls").agg(F.min("first_id").alias("root"))
    by_hash = classes.join(roots.hint("merge"), "cls").select("phash", "root")
    return rows.join(by_hash.hint("merge"), "phash").select("id", "root")


def groups(members: DataFrame) -> DataFrame:
    """(representative, size, group_id, ids) of classes of two or more, largest first.

    A group's id is a digest of all its ids in order, so a row holds its class: for classes that are
    too large for a row use `group_sizes`, whose rows are the members.
    """
    return (
        members.groupBy(F.col("root").alias("representative"))
        .agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("ids"))
        .where("size > 1")
        .withColumn("group_id", group_id(F.transform("ids", lambda x: x.cast("string"))))
        .orderBy(F.desc("size"), "representative")
    )


def group_sizes(members: DataFrame) -> DataFrame:
    """(id, root, size) of rows in classes of two or more, without gathering any class.  Members are read twice: write them before."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(sizes.hint("merge"), "root").select("id", "root", "size")


def only_duplicates(media: DataFrame, members: DataFrame) -> DataFrame:
    return media.join(group_sizes(members).select("id").hint("merge"), "id", "left_semi")


def without_duplicates(media: DataFrame, members: DataFrame) -> DataFrame:
    return media.join(group_sizes(members).select("id").hint("merge"), "id", "left_anti")


def with_group(media: DataFrame, members: DataFrame) -> DataFrame:
    """Media rows with their class's root (null outside) and its size (1 outside)."""
    sized = group_sizes(members).withColumnsRenamed({"root": "duplicate_root", "size": "duplicate_group_size"})
    return media.join(sized.hint("merge"), "id", "left").withColumn("duplicate_group_size", F.coalesce("duplicate_group_size", F.lit(1)).cast("long"))


class DuplicateIndex:
    """Classes of near duplicates that are kept up to date: a change compares only what it brings.

    Two merge-on-read tables below a path: the hash of each medium, and the class of each hash (named by one of its
    hashes).  `refresh` brings the second in line with the first, from whatever state it finds, so a job that died
    between the two is finished by the next: hashes that are new are compared with the hashes that share a key of
    theirs, and classes that they join are merged by a component search over class names; where the last medium
    of a hash is gone, the other hashes of its class are taken as new.  Keys are made in the scan of
    the hashes and filtered by those of the new ones, which are broadcast: beyond so many new hashes that nearly
    every hash shares a key with one of them (2^13 to 2^22 keys, by ``agreeing``), all are compared instead.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: int = 8, agreeing: int = 2, id_type: str = "string", buckets: int = 16):
        self.threshold, self.agreeing = threshold, agreeing
        self.media = MergeTable(spark, posixpath.join(path, "media"), "id", f"id {id_type}, whole long", buckets)
        self.hashes = MergeTable(spark, posixpath.join(path, "hashes"), "whole", "whole long, cls long", buckets)

    def add(self, media: DataFrame) -> None:
        """Media rows (id, phash) come in, or get other hashes; one without a valid hash is in no class."""
        hi, lo = phash_halves(F.lower("phash"))
        whole = F.when(valid_phash(F.col("phash")), F.shiftleft(hi, 32).bitwiseOR(lo))
        self.media.upsert(media.select("id", whole.alias("whole")))
        self.refresh()

    def remove(self, ids: DataFrame) -> None:
        self.media.delete(ids.select("id"))
        self.refresh()

    def refresh(self) -> None:
        present = self.media.read().select("whole").where("whole IS NOT NULL").distinct()
        known = materialised(self.hashes.read(), "known")
        present = materialised(present, "present")
        gone = materialised(known.join(present, "whole", "left_anti"), "gone")
        broken = gone.select("cls").distinct()
        loose = known.join(broken, "cls", "left_semi").join(gone, "whole", "left_anti").select("whole")
        new = materialised(present.join(known, "whole", "left_anti").select("whole").union(loose), "new")
        if not new.isEmpty():
            settled = known.join(broken, "cls", "left_anti")
            self.hashes.upsert(self._classes(settled, new))
        if not gone.isEmpty():
            self.hashes.delete(gone.select("whole"))
        self.media.compact()
        self.hashes.compact()

    def _classes(self, settled: DataFrame, new: DataFrame) -> DataFrame:
        """(whole, cls) of the new hashes and of settled ones whose class has another name now."""
        keyed = lambda rows: _keyed(_halves(rows), self.threshold, self.agreeing)
        keys = len(list(combinations(_bands(self.threshold, self.agreeing), self.agreeing)))
        if new.count() * keys < 2 ** (64 * self.agreeing / (self.threshold + self.agreeing)):
            wanted = F.broadcast(keyed(new).select("n", "key").distinct())
            near = keyed(settled).join(wanted, ["n", "key"], "left_semi").select("whole").distinct()
        else:
            near = settled.select("whole")
        links = materialised(hash_links(_halves(near.union(new)), self.threshold, self.agreeing), "links")
        names = settled.select(F.col("whole").alias("hash"), "cls")
        for end in ("a", "b"):
            links = links.join(names, links[end] == names["hash"], "left").withColumn(end, F.coalesce("cls", end)).drop("hash", "cls")
        merged = materialised(components(links), "merged")
        fresh = new.join(merged, new["whole"] == merged["node"], "left").select("whole", F.coalesce("component", "whole").alias("cls"))
        other = merged.where("node <> component")
        renamed = settled.join(other, settled["cls"] == other["node"]).select("whole", F.col("component").alias("cls"))
        return fresh.unionByName(renamed)

    def membership(self) -> DataFrame:
        """(id, root) as of `membership` over all media."""
        named = self.media.read().where("whole IS NOT NULL").join(self.hashes.read(), "whole").select("id", "cls")
        roots = named.groupBy("cls").agg(F.min("id").alias("root"))
        return named.join(roots, all_equal(named, roots, ["cls"])).select("id", "root")


def _halves(rows: DataFrame) -> DataFrame:
    """Hashes of 64 bits as `hash_links` takes them."""
    return rows.select(F.lit("").alias("phash"), F.shiftrightunsigned("whole", 32).alias("hi"), F.col("whole").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))

"""Clusters founded in the order of arrival: an item joins its most similar founder, or founds a cluster.

The rule is a fold: an item that is similar enough to a founder before it joins the most similar of
them (the first of equals); any other founds.  The fold's founders are the lexicographically first set
of items that are pairwise apart, so they can be found in rounds:

* groups of up to ``small`` items are folded whole, a group in a task;
* of a larger group, the window of a round is its first items that aren't decided, ``small`` at most: what
  founders before it have claimed is no longer among them.  One task a group folds the window;
* the round's new founders then meet all later items of their group, in slices over all tasks.  An item keeps
  its best founder, is decided once that is similar enough, and final when the window has passed it.

An item is compared with the founders before it and with nothing else, as in the fold, and what one task
holds is bounded.  The rounds are as many as the founders (and what they claim within their own window)
over ``small``.  Cosines are summed in a fixed order wherever a comparison is close, so results don't depend
on slices or retries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenlake.functions.similarity import as_doubles
from lumenlake.operators.order import all_equal, numbered
from lumenlake.plans.scratch import discard, materialised_at

CLOSE = 1e-9
KNOWN_AT = -(1 << 40)  # positions of founders of earlier runs come before all


@dataclass(frozen=True)
class FoundingParams:
    small: int = 8_192  # items that one task folds
    slice_rows: int = 16_384  # items that meet a round's founders in one task
    chunk: int = 1_024  # positions by which windows are cut
    tile: int = 512


def units(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
    if not x.shape[1]:
        return x
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def cosines(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Of equally many rows, each summed in the same way whatever rows are beside it."""
    return (x * f).sum(axis=1)


def fold(x: np.ndarray, least: float) -> list[int]:
    """The founders among unit rows in order."""
    kept = np.empty_like(x)
    out: list[int] = []
    for i, v in enumerate(x):
        scores = kept[: len(out)] @ v
        top = scores.max(initial=-2.0)
        if top >= least - CLOSE:
            near = np.nonzero(scores >= least - CLOSE)[0]
            if top >= least + CLOSE or cosines(np.broadcast_to(v, (len(near), len(v))), kept[near]).max() >= least:
                continue
        kept[len(out)] = v
        out.append(i)
    return out


def best_founders(x: np.ndarray, at: np.ndarray, f: np.ndarray, f_at: np.ndarray, least: float, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(founder's index or -1, cosine) of each row: the most similar founder before it, the first of equals."""
    order = np.argsort(f_at, kind="stable")
    f, f_at = f[order], f_at[order]
    index, score = np.full(len(x), -1), np.full(len(x), -2.0)
    for a in range(0, len(x) if len(f) else 0, tile):
        rows = x[a : a + tile]
        sims = np.where(f_at[None, :] < at[a : a + tile, None], rows @ f.T, -3.0)
        top = sims.max(axis=1)
        for r in np.nonzero(top >= least - CLOSE)[0].tolist():
            near = np.nonzero(sims[r] >= top[r] - CLOSE)[0]
            exact = cosines(np.broadcast_to(rows[r], (len(near), rows.shape[1])), f[near])
            best = int(exact.argmax())
            if exact[best] >= least:
                index[a + r], score[a + r] = order[near[best]], exact[best]
    return index, score


def founded(
    items: DataFrame, group: str, item: str, vector: str, least: float, params: FoundingParams = FoundingParams(), known: DataFrame | None = None
) -> DataFrame:
    """(group, item, width, at, founder, founder_at, score, founds) of each item, by the order of ``item``.

    ``founder_at`` names a founder within its group and width; a founder's score is 1.  ``known`` has the
    founders of earlier runs (group, n, item, vector), which come before all items, in the order of ``n``.

    Items whose vector is null or holds a null or non-finite component found nothing and join nothing: the
    columns of their founder are null.  Vectors of unequal lengths are never similar.  A zero vector has a cosine
    of 0 with all.  Items of equal ids are in the order of a hash of their vectors; a null group is a group.
    """
    kind = items.schema[item].dataType
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("i"), as_doubles(F.col(vector)).alias("v"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.withColumn("w", F.when(F.coalesce(fine, F.lit(False)), F.size("v"))).withColumn("h", F.xxhash64("v"))
    state = [F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("f_at"), F.lit(None).cast(kind).alias("f")]
    usable, path = materialised_at(rows.where("w IS NOT NULL").select("g", "w", "i", "h", "v", *state), "items")
    counts = usable.groupBy("g", "w").agg(F.count("*").alias("n"))
    big = counts.where(F.col("n") > params.small)
    out, paths = [], [path]
    few = usable.join(big, all_equal(usable, big, ["g", "w"]), "left_anti")
    small, path = materialised_at(_small(few, known, least, params), "founded")
    out.append(small)
    if not big.isEmpty():
        many = usable.join(big, all_equal(usable, big, ["g", "w"]), "left_semi")
        out += _rounds(numbered(many, ["g", "w"], [F.col("i"), F.col("h")], "at").drop("h"), known, least, params)
    unusable = rows.where("w IS NULL").select("g", "i", "w", *[F.lit(None).cast(t).alias(c) for c, t in (("at", "long"), ("f", kind), ("f_at", "long"), ("score", "double"))])
    found = reduce(DataFrame.unionByName, [d.select("g", "i", "w", "at", "f", "f_at", "score") for d in out] + [unusable])
    founds = F.coalesce(F.col("at") == F.col("f_at"), F.lit(False)).alias("founds")
    for p in paths:
        discard(items.sparkSession, p)
    return found.select(F.col("g").alias(group), F.col("i").alias(item), F.col("w").alias("width"), "at", F.col("f").alias("founder"), F.col("f_at").alias("founder_at"), "score", founds)


def _known(known: DataFrame, kind) -> DataFrame:
    group, n, item, vector = known.columns
    rows = known.select(F.col(group).alias("g"), (F.col(n) + KNOWN_AT).cast("long").alias("f_at"), F.col(item).cast(kind).alias("f"), as_doubles(F.col(vector)).alias("v"))
    return rows.withColumn("w", F.size("v"))


def _schema(df: DataFrame, *drop: str) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in drop])


def _updated(table, x, at, founders, f_at, ids, least, params):
    """Arrow columns score, f_at and f of items after they have met founders; items that are founders are their own."""
    import pyarrow as pa

    index, score = best_founders(x, at, founders, f_at, least, params.tile)
    old = table.column("score").to_numpy(zero_copy_only=False).astype(np.float64)
    old_at = table.column("f_at").combine_chunks()
    better = (index >= 0) & ~(score <= np.where(np.isnan(old), -3.0, old))
    own = np.isin(at, f_at)
    new_at = pa.array(np.where(better, f_at[index] if len(f_at) else 0, 0), mask=~better)
    new_id = ids.take(pa.array(np.where(better, index, 0), mask=~better)) if len(ids) else pa.nulls(len(x), ids.type)
    choose = lambda mine, new, kept: pa.compute.if_else(pa.array(own), mine, pa.compute.if_else(pa.array(better), new, kept))
    scores = pa.array(np.where(own, 1.0, np.where(better, score, old)), mask=~own & ~better & np.isnan(old))
    return scores, choose(pa.array(at), new_at, old_at), choose(table.column("i").combine_chunks(), new_id, table.column("f").combine_chunks())


def _joined(table, schema, **new):
    import pyarrow as pa

    return pa.Table.from_arrays([new[n] if n in new else table.column(n).combine_chunks() for n in schema.names], schema=schema)


def _small(few: DataFrame, known: DataFrame | None, least: float, params: FoundingParams) -> DataFrame:
    """Groups that one task folds."""
    schema = T.StructType([*_schema(few, "h", "v"), T.StructField("at", T.LongType())])
    arrow, kind = to_arrow_schema(schema), few.schema["i"].dataType

    def solve(table):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        table = table.take(pa.compute.sort_indices(table, sort_keys=[("i", "ascending"), ("h", "ascending")], null_placement="at_start"))
        x, at = units(table.column("v").to_pylist()), np.arange(len(table), dtype=np.int64)
        open_ = np.nonzero(np.isnan(table.column("score").to_numpy(zero_copy_only=False).astype(np.float64)))[0]
        new = open_[fold(x[open_], least)]
        score, f_at, f = _updated(table, x, at, x[new], at[new], table.column("i").combine_chunks().take(pa.array(new)), least, params)
        return _joined(table, arrow, at=pa.array(at), score=score, f_at=f_at, f=f)

    if known is not None:  # what known founders claim comes first
        few = _met(few.withColumn("at", F.lit(0).cast("long")), _known(known, kind), least, params).drop("at")
    return few.groupBy("g", "w").applyInArrow(solve, schema)


def _met(items: DataFrame, founders: DataFrame, least: float, params: FoundingParams) -> DataFrame:
    """Items after meeting founders (g, w, f_at, f, v), ``small`` of a group at a time, in slices of a group."""
    spark = items.sparkSession
    numbers = F.row_number().over(Window.partitionBy("g", "w").orderBy("f_at"))
    per_group = founders.groupBy("g", "w").agg(F.count("*").alias("n"))
    most = per_group.agg(F.max("n").alias("n")).first().n or 0
    path = None
    if most > params.small:
        founders, path = materialised_at(founders.withColumn("_n", numbers), "founders")
    for block in range(-(-most // params.small)):
        own = founders if path is None else founders.where(F.floor((F.col("_n") - 1) / params.small) == block).drop("_n")
        items = _met_block(items, own, least, params)
        if path is not None:
            items, _ = materialised_at(items, "met")
    if path is not None:
        discard(spark, path)
    return items


def _met_block(items: DataFrame, founders: DataFrame, least: float, params: FoundingParams) -> DataFrame:
    schema = items.schema
    arrow = to_arrow_schema(schema)
    sizes = items.groupBy("g", "w").agg(F.max("at").alias("last"))
    dealt = founders.join(sizes, all_equal(founders, sizes, ["g", "w"])).select(
        founders["g"], founders["w"], "f_at", "f", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / params.slice_rows))).alias("s")
    )
    sliced = items.withColumn("s", F.floor(F.col("at") / params.slice_rows))

    def meet(left, right):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        if not len(left):
            return pa.Table.from_batches([], schema=arrow)
        if not len(right):
            return left.select(arrow.names)
        x, at = units(left.column("v").to_pylist()), left.column("at").to_numpy()
        f, f_at = units(right.column("v").to_pylist()), right.column("f_at").to_numpy()
        score, new_at, new = _updated(left, x, at, f, f_at, right.column("f").combine_chunks(), least, params)
        return _joined(left, arrow, score=score, f_at=new_at, f=new)

    return sliced.groupBy("g", "w", "s").cogroup(dealt.groupBy("g", "w", "s")).applyInArrow(meet, schema)


def _rounds(items: DataFrame, known: DataFrame | None, least: float, params: FoundingParams) -> list[DataFrame]:
    """Tables of final items of groups that no task could hold."""
    spark, kind = items.sparkSession, items.schema["i"].dataType
    items = items.select("g", "w", "i", "v", "score", "f_at", "f", "at")
    if known is not None:
        items = _met(items, _known(known, kind), least, params)
    active, path = materialised_at(items, "active")
    founder_schema = T.StructType([items.schema["g"], items.schema["w"], T.StructField("f_at", T.LongType()), T.StructField("f", kind), items.schema["v"]])
    arrow = to_arrow_schema(founder_schema)

    def found(table):
        import pyarrow as pa

        table = table.sort_by("at")
        new = pa.array(fold(units(table.column("v").to_pylist()), least))
        kept = table.take(new)
        return pa.Table.from_arrays([kept.column(c).combine_chunks() for c in ("g", "w", "at", "i", "v")], schema=arrow)

    out = []
    while True:
        undecided = active.where("score IS NULL")
        chunks = undecided.groupBy("g", "w", F.floor(F.col("at") / params.chunk).alias("c")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy("g", "w").orderBy("c")  # as many rows as a group has chunks
        summed = chunks.withColumns({"sum": F.sum("n").over(upto), "first": F.row_number().over(upto) == 1})
        cuts = summed.where((F.col("sum") <= params.small) | F.col("first")).groupBy("g", "w").agg(((F.max("c") + 1) * params.chunk).alias("cut"))
        cuts, cuts_path = materialised_at(cuts, "cuts")
        if cuts.isEmpty():
            out.append(active)
            discard(spark, cuts_path)
            return out
        window = undecided.join(cuts, all_equal(undecided, cuts, ["g", "w"])).where("at < cut").select(undecided["g"], undecided["w"], "i", "at", "v")
        founders, founders_path = materialised_at(window.groupBy("g", "w").applyInArrow(found, founder_schema), "founders")
        met = _met_block(active, founders, least, params)
        marked = met.join(cuts, all_equal(met, cuts, ["g", "w"]), "left").select(*[met[c] for c in met.columns], F.coalesce(F.col("at") < F.col("cut"), F.lit(True)).alias("final"))
        done, done_path = materialised_at(marked, "active")
        discard(spark, path)
        discard(spark, cuts_path)
        discard(spark, founders_path)
        path = done_path
        out.append(done.where("final").drop("final"))
        active = done.where("NOT final").drop("final")
        if active.isEmpty():
            return out
        active, path = materialised_at(active, "active")

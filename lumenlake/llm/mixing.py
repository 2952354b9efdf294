"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Time is cut into slots of one block.  A source with the share n/N of the mix is due n blocks in
every N slots: its k-th block is released at floor(k N / n) and due by ceil((k + 1) N / n).
Earliest deadline first among the released blocks meets every deadline (the shares add up to
one), so at any slot each source has had its weight's part of the blocks, less or more than it
by under one block.  The schedule repeats after N slots, so one period is folded once, in a
single SQL expression whose size is bounded by ``period`` and ``max_sources``; a block's slot
then is arithmetic and the rows are placed by a join with the pattern.

Rows of a source are taken in the order of a hash of their id.  ``stop`` says what happens when
a source runs out: ``first_exhausted`` ends the mix there; ``all_exhausted`` (the default) lets
scarce sources start over until the source that lasts longest is used up, so that no row is lost
and the mix is on target throughout; the last period is cut where the longest source ends.

Edge cases: a null source is a source of its own; a source without a weight in the given table
is left out; null ids sort as the empty string; null texts count as rows; repeated rows are rows;
an empty table gives an empty mix; a source's share is at least 1/N, and what small sources so
get beyond their weight is taken from all larger ones in proportion; N is ``period``, or more where
the smallest share asks for it: one over it, ``max_period`` at most, and twice the number of sources
in any case (so a source with less than 1/``max_period`` of the weight is in the mix more often than
its weight says); texts are carried, not read, so any length will do; equal ids are ordered in no
stated way; all further columns of the documents, whatever their names, ride along with their values
in `mixed_documents` (in the schedule, columns of the same name as an added one are replaced).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import written
from lumenlake.llm.ranking import numbered


@dataclass(frozen=True)
class MixParams:
    block_rows: int = 16
    period: int = 500
    max_period: int = 20_000
    lot: int = 10_000  # copies of a row that one task makes
    temperature: float = 0.7  # without given weights: share of rows to this power
    stop: str = "all_exhausted"
    max_sources: int = 2_000


def source_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))


def weighed_sources(counts: DataFrame, weights: DataFrame | None, params: MixParams) -> DataFrame:
    """(source, n, w): the sources in the mix with their weights."""
    if weights is None:
        return counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(params.temperature)))
    given = weights.select(F.col("source").cast("string").alias("_s"), F.col("weight").cast("double").alias("w"))
    return counts.join(given, counts["source"].eqNullSafe(given["_s"])).drop("_s").where("w > 0")


def shares(counts: DataFrame, weights: DataFrame | None, params: MixParams) -> DataFrame:
    """(source, n, blocks): each source's blocks in a period, at least one; sum = period.

    Sources due less than a block get one.  The others share what is left by largest remainders:
    they are the longest run of sources by falling weight whose last still is due a block then.
    """
    weighed = weighed_sources(counts, weights, params)
    every = Window.partitionBy()  # one row per source, max_sources at most
    falling = Window.orderBy(F.col("w").desc(), F.col("source").asc_nulls_first())
    so_far = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spare = F.lit(params.period) - F.count("*").over(every)
    ranked = weighed.withColumns({"spare": spare, "m": F.row_number().over(falling), "upto": F.sum("w").over(so_far)})
    # the factor lets rounding in the sum not cost a source its part; a part short of one block by it is one block
    large = ranked.withColumn("large", F.col("w") * (F.col("spare") + F.col("m")) * F.lit(1 + 1e-12) >= F.col("upto"))
    exact = large.withColumns({
        "quota": F.col("spare") + F.sum(F.col("large").cast("int")).over(every),
        "total": F.sum(F.when(F.col("large"), F.col("w"))).over(every),
    }).withColumn("exact", F.when(F.col("large"), F.col("w") / F.col("total") * F.col("quota")))
    floors = exact.withColumn("floor", F.when(F.col("large"), F.greatest(F.lit(1), F.floor("exact").cast("int"))).otherwise(1))
    left = F.lit(params.period) - F.sum("floor").over(every)
    rank = F.row_number().over(Window.orderBy((F.col("exact") - F.col("floor")).desc_nulls_last(), F.col("source").asc_nulls_first()))
    topped = floors.withColumn("left", left).withColumn("rank", rank)
    blocks = (F.col("floor") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("int")
    checked = topped.withColumn("blocks", blocks).withColumn("sum", F.sum("blocks").over(every))
    wrong = F.raise_error(F.lit(f"the sources don't fit a period of {params.period} slots")).cast("int")
    sound = (F.col("blocks") >= 1) & (F.col("sum") == params.period)
    return checked.select("source", "n", F.when(sound, F.col("blocks")).otherwise(wrong).alias("blocks"))


def pattern(shares_: DataFrame, params: MixParams) -> DataFrame:
    """(source, blocks, n, k, slot, release, deadline): the schedule of one period, by a fold over its slots.

    The state is each source's blocks so far; a slot goes to the released block that is due
    first, and of equal deadlines to the source that comes first.
    """
    N = params.period
    one = shares_.agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("_key"), "source", "blocks", "n"))).alias("s")
    ).where(F.size("s") > 0)
    fold = f"""
      aggregate(
        sequence(0, {N} - 1),
        named_struct('done', transform(s, x -> 0), 'picks', cast(array() as array<int>)),
        (acc, t) -> transform(array(
            array_min(filter(
              transform(s, (x, i) -> named_struct(
                'due', cast(ceil((acc.done[i] + 1) * {N} / cast(x.blocks as double)) as int),
                'i', i,
                'ready', floor(acc.done[i] * {N} / cast(x.blocks as double)) <= t and acc.done[i] < x.blocks)),
              c -> c.ready)).i),
          p -> named_struct(
            'done', transform(acc.done, (d, i) -> if(i = p, d + 1, d)),
            'picks', array_append(acc.picks, p)))[0],
        acc -> acc.picks)
    """
    slots = one.select("s", F.posexplode(F.expr(fold)).alias("slot", "pick"))
    picked = slots.select(F.expr("s[pick]").alias("x"), "slot")
    k = F.row_number().over(Window.partitionBy("x").orderBy("slot")) - 1
    n = F.col("x.blocks")
    return picked.withColumn("k", k).select(
        F.col("x.source").alias("source"),
        F.col("x.blocks").alias("blocks"),
        F.col("x.n").alias("n"),
        "k",
        "slot",
        F.floor(F.col("k") * N / n).cast("int").alias("release"),
        F.ceil((F.col("k") + 1) * N / n).cast("int").alias("deadline"),
    )


ADDED = ("epoch", "block", "release", "deadline", "slot", "place")


def schedule(docs: DataFrame, weights: DataFrame | None = None, params: MixParams = MixParams()) -> DataFrame:
    """``docs`` in the mix: columns epoch, block, release, deadline, slot and place in the block.

    Block numbers count through the epochs of a source; slot orders the mix, place orders a slot.
    """
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c not in ADDED]
    return _scheduled(docs, weights, params).select(*kept, *ADDED)


def _scheduled(docs: DataFrame, weights: DataFrame | None, params: MixParams) -> DataFrame:
    """(doc, epoch, block, release, deadline, slot, place): the columns of ``docs`` are kept apart in a struct."""
    if params.stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError("stop is first_exhausted or all_exhausted")
    counts = written(source_counts(docs), "mix")  # a row per source
    known = weighed_sources(counts, weights, params).agg(F.count("*").alias("n"), (F.min("w") / F.sum("w")).alias("least")).first()
    if known.n > params.max_sources:
        raise ValueError(f"more than {params.max_sources} sources: group them first")
    finest = min(params.max_period, math.ceil(1 / known.least)) if known.n else 0
    params = replace(params, period=max(params.period, finest, 2 * known.n))
    plan = written(pattern(shares(counts, weights, params), params), "mix")  # period rows
    B, N = params.block_rows, params.period
    # the slot in which a source's last whole or partial block falls, were it to run alone
    per_source = plan.groupBy("source").agg(F.first("blocks").alias("blocks"), F.first("n").alias("n"))
    own_blocks = F.ceil(F.col("n") / F.lit(B)).cast("long")
    last = per_source.withColumn("own", own_blocks).select(
        "source", "blocks", "n", "own",
        F.floor((F.col("own") - 1) / F.col("blocks")).cast("long").alias("last_period"),
        F.pmod(F.col("own") - 1, F.col("blocks").cast("long")).cast("int").alias("last_k"),
    )
    at = plan.select(F.col("source").alias("_s"), F.col("k").alias("_k"), "slot")
    ends = last.join(F.broadcast(at), last["source"].eqNullSafe(at["_s"]) & (last["last_k"] == at["_k"])).select(
        "source", "n", (F.col("last_period") * N + F.col("slot")).alias("end")
    )
    pick = F.min("end") if params.stop == "first_exhausted" else F.max("end")
    final = ends.agg(pick.alias("final")).first()["final"]
    if final is None:
        final = -1
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.col("source").cast("string").alias("_src"), F.col("doc_id").alias("_id"),
    )
    ranked = numbered(packed, "_src", F.col("_id"), [], "_rank")
    sized = per_source.select(
        F.col("source").alias("_s"), F.col("blocks").alias("_blocks"), F.col("n").alias("_n"),
        # epochs that may begin before the mix ends
        F.floor(((final // N + 1) * F.col("blocks").cast("long") * B - 1) / F.col("n") + 1).cast("long").alias("_epochs"),
    )
    whole = ranked.join(F.broadcast(sized), ranked["_src"].eqNullSafe(sized["_s"]))
    zero, lot = F.lit(0).cast("long"), F.lit(params.lot).cast("long")
    epochs = F.explode(F.sequence(zero, F.col("_epochs") - 1))
    copies = whole.where(F.col("_epochs") <= lot).withColumn("epoch", epochs)
    if not sized.where(F.col("_epochs") > lot).isEmpty():  # a row of a tiny source, over and over: the copies are dealt in lots
        lots = whole.where(F.col("_epochs") > lot).withColumn("_lot", F.explode(F.sequence(zero, F.floor((F.col("_epochs") - 1) / lot))))
        lots = lots.repartition("_src", "_rank", "_lot")
        upto = F.least(F.col("_epochs"), (F.col("_lot") + 1) * lot) - 1
        copies = copies.unionByName(lots.withColumn("epoch", F.explode(F.sequence(F.col("_lot") * lot, upto))).drop("_lot"))
    copies = (
        copies.withColumn("_at", F.col("epoch") * F.col("_n") + F.col("_rank"))
        .withColumn("block", F.floor(F.col("_at") / B).cast("long"))
        .withColumn("place", F.pmod("_at", F.lit(B)).cast("int"))
        .withColumn("_period", F.floor(F.col("block") / F.col("_blocks")).cast("long"))
        .withColumn("_k", F.pmod(F.col("block"), F.col("_blocks").cast("long")).cast("int"))
    )
    pat = plan.select(
        F.col("source").alias("_ps"), F.col("k").alias("_pk"), F.col("slot").alias("_slot"),
        F.col("release").alias("_release"), F.col("deadline").alias("_deadline"),
    )
    placed = copies.join(F.broadcast(pat), copies["_src"].eqNullSafe(pat["_ps"]) & (copies["_k"] == pat["_pk"]))
    base = F.col("_period") * N
    return (
        placed.withColumns({"slot": base + F.col("_slot"), "release": base + F.col("_release"), "deadline": base + F.col("_deadline")})
        .where(F.col("slot") <= final)
        .select("doc", *ADDED)
    )


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, params: MixParams = MixParams()) -> DataFrame:
    """The rows of the mix with the columns of ``docs``; a row appears once per epoch it is in."""
    return _scheduled(docs, weights, params).select("doc.*")

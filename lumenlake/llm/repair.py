"""Conversation structure repair: the cheapest edits that give turns a legal order of roles.

A legal conversation's role initials are ``(s?(ua)+)?``.  Each row is kept (0), given the role user
or assistant (1) or deleted (2, required for blank and duplicate rows); an empty user or assistant
turn can be inserted anywhere (5); a truncated row that stays adds 5.  A backward dynamic programme
over (row, grammar state) gives the cost to go; a forward walk then takes, of the edits that are
tight in it, the one whose initial (D, I, K, R) is least in ASCII, which makes the edits' initials the
least of all cheapest sequences'.

One range shuffle sorts the rows by conversation and turn, so a partition holds whole conversations but
for the first and last of it; those that it holds whole are repaired on the way.  What crosses a border
or is longer than ``block_rows`` is kept as blocks, of which none is ever needed beside another: a
block's costs are a 4 x 4 matrix in (min, +), the matrices are multiplied up from the end of a
conversation to the cost to go at each block's end, each block is walked from each of the four states,
and a scan from the front chooses the walk.  A conversation of any length so takes tasks of a block;
only rows of a few numbers a block, and the bytes that its digest is made of, pass one task in order.

Edge cases: null ids are one conversation; null roles and texts are one space (so a null text is blank, and
a null role fits no place); null turns come first; rows of one turn are ordered by role and text; rows
equal in all four columns are one row with a count (the copies are duplicates); roles are known by
their first letter and stay as they are when kept; conversations without rows after `damaged` have
one block without turns; texts of any length are read whole; an empty table gives an empty result;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenlake.llm.common import written

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # grammar states: nothing yet, after s, after u, after a
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))  # a state's next turn but for s
ENDS = (START, ASSISTANT)
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
FAR = 1 << 60

BLOCK = "seq bigint, turns array<bigint>, roles array<string>, texts array<string>, copies array<bigint>"
REPAIRED = (
    "block bigint, whole boolean, audit string, repaired array<struct<role:string,text:string>>, cost bigint, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_turn bigint, last_turn bigint, n_turns bigint, "
    "first_role string, last_role string"
)


@dataclass(frozen=True)
class RepairParams:
    block_rows: int = 4_096
    block_chars: int = 4 << 20


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows harmed by a checksum of conversation and turn, for tests of a repair.

    A row that is dropped stays as a row without turn, role and text and with no copies, so that its
    conversation is known.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    harm = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", harm.alias("harm"))
    there = F.col("harm") != 0
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        "conv_id",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(F.col("harm") == 4, F.lit("user")).when(there, role).alias("role"),
        F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate(text, ".!?", "")).when(there, text).alias("text"),
        F.when(F.col("harm") == 3, 2).when(there, 1).otherwise(0).cast("long").alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows as they are."""
    space = F.lit(" ")
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        F.lit(1).cast("long").alias("copies"),
    )


# ------------------------------------------------------------------ one block


def faults(roles: list[str], texts: list[str], copies: list[int], seen: frozenset[bytes] = frozenset()) -> list[tuple[int, str, str]]:
    """(row, fault, initial) of each turn of a block, copies one by one; seen: digests of turns of earlier blocks."""
    here: set[tuple[str, str]] = set()
    out = []
    for i, (role, text, n) in enumerate(zip(roles, texts, copies)):
        if not n:
            continue
        core = text.rstrip(SPACE)
        initial = role[:1]
        if not core:
            out.extend([(i, "blank", initial)] * n)
            continue
        known = (role, text) in here or (bool(seen) and turn_digest(role, text) in seen)
        here.add((role, text))
        out.append((i, "duplicate" if known else "" if core[-1] in ".!?" else "truncated", initial))
        out.extend([(i, "duplicate", initial)] * (n - 1))
    return out


def turn_digest(role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.blake2b(len(r).to_bytes(4, "little") + r + text.encode(), digest_size=16).digest()


def kept_state(state: int, initial: str) -> int | None:
    """The state after a turn that keeps its role, if it fits."""
    if initial == "s":
        return SYSTEM if state == START else None
    after, role = NEXT[state]
    return after if initial == role[0] else None


def with_inserts(cost: list[int]) -> list[int]:
    """Costs to go where turns can be inserted before what follows: at most two in a row ever pay."""
    out = list(cost)
    for _ in range(2):
        for s in range(4):
            out[s] = min(out[s], INSERT + out[NEXT[s][0]])
    return out


def costs_to_go(rows: list[tuple[int, str, str]], end: list[int]) -> list[list[int]]:
    """Per row and at the end: the least cost from each grammar state, given the costs after the block."""
    out = [[]] * (len(rows) + 1)
    after = out[-1] = with_inserts(end)
    for i in range(len(rows) - 1, -1, -1):
        _, fault, initial = rows[i]
        now = [DELETE + c for c in after]
        if fault not in ("blank", "duplicate"):
            stays = CUT if fault else 0
            for s in range(4):
                now[s] = min(now[s], REROLE + stays + after[NEXT[s][0]])
                k = kept_state(s, initial)
                if k is not None:
                    now[s] = min(now[s], stays + after[k])
        after = out[i] = with_inserts(now)
    return out


def walk(rows: list[tuple[int, str, str]], to_go: list[list[int]], state: int, end: list[int], last: bool) -> tuple[str, int]:
    """(edits' initials, state after): from a state along tight edits, the ASCII-least first.

    Inserts at the end of a block are left to the next block, in which they are tight as well, but in the last.
    """
    edits, i = [], 0
    while True:
        cost = to_go[i][state]
        if i < len(rows):
            _, fault, initial = rows[i]
            after = to_go[i + 1]
            if cost == DELETE + after[state]:
                edits.append("D")
                i += 1
                continue
        elif not last or cost == end[state]:
            return "".join(edits), state
        into = NEXT[state][0]
        if cost == INSERT + to_go[i][into]:
            edits.append("I")
            state = into
            continue
        k = kept_state(state, initial)
        if k is not None and cost == (CUT if fault else 0) + after[k]:
            edits.append("K")
            state = k
        else:
            edits.append("R")
            state = into
        i += 1


def final_costs() -> list[int]:
    return [0 if s in ENDS else FAR for s in range(4)]


def block_matrix(rows: list[tuple[int, str, str]]) -> list[int]:
    """The least cost through a block from each state to each, row by row, without inserts at its end."""
    columns = []
    for t in range(4):
        columns.append(costs_to_go(rows, [0 if s == t else FAR for s in range(4)])[0])
    return [columns[t][s] for s in range(4) for t in range(4)]


def counted(rows, turns: list[int | None], copies: list[int]) -> dict:
    """The figures of a block that add up over blocks, and its ends."""
    initials = [x[2] for x in rows]
    present = [t for t, n in zip(turns, copies) if n and t is not None]
    kinds = [x[1] for x in rows]
    return {
        **{f: kinds.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "first_turn": present[0] if present else None, "last_turn": present[-1] if present else None, "n_turns": len(set(present)),
        "first_role": initials[0] if rows else None, "last_role": initials[-1] if rows else None,
    }


def rebuilt(audit: str, rows, state: int, roles: list[str], texts: list[str]) -> tuple[list[dict], int]:
    """The turns that edits leave, replayed from a state, and the edits' cost."""
    out, cost, i = [], 0, 0
    for kind in audit:
        if kind == "I":
            state, role = NEXT[state]
            out.append({"role": role, "text": ""})
            cost += INSERT
            continue
        row, fault, initial = rows[i]
        i += 1
        if kind == "D":
            cost += DELETE
            continue
        role = roles[row]
        if kind == "R":
            state, role = NEXT[state]
            cost += REROLE
        else:
            state = kept_state(state, initial)
        cost += CUT if fault else 0
        out.append({"role": role, "text": texts[row]})
    return out, cost


def repaired_block(rows, turns, roles, texts, copies, block: int, whole: bool, audit: str, state: int) -> dict:
    left, cost = rebuilt(audit, rows, state, roles, texts)
    return {"block": block, "whole": whole, "audit": audit, "repaired": left, "cost": cost, **counted(rows, turns, copies)}


def repair_whole(turns, roles, texts, copies) -> dict:
    """The repair of a conversation that is one block."""
    rows = faults(roles, texts, copies)
    end = final_costs()
    audit, _ = walk(rows, costs_to_go(rows, end), START, end, True)
    return repaired_block(rows, turns, roles, texts, copies, 0, True, audit, START)


# ------------------------------------------------------------------ all conversations


def schemas(conv_id: T.DataType) -> tuple[T.StructType, T.StructType]:
    """Of a block of rows and of a repaired block."""
    head = T.StructType([T.StructField("conv_id", conv_id)])
    return (T.StructType([*head, *T.StructType.fromDDL(BLOCK)]), T.StructType([*head, *T.StructType.fromDDL(REPAIRED)]))


def repaired(rows: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """Repaired conversations of (conv_id, turn, role, text, copies), in blocks of rows.

    (conv_id, block, whole, audit, repaired, cost, blank, duplicate, truncated, illegal, first_turn, last_turn,
    n_turns, first_role, last_role): ``whole`` says that the block is all of the conversation; ``audit`` holds
    the edits' initials and ``repaired`` the turns that are left, in order; the figures are the block's own.
    """
    open_block, done = schemas(rows.schema["conv_id"].dataType)
    counted_rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    lots = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / params.block_rows) - 1, F.lit(0))))
    counted_rows = counted_rows.withColumn("lot", lots)  # very many copies are several rows
    counted_rows = counted_rows.withColumn("copies", F.least(F.col("n") - F.col("lot") * params.block_rows, F.lit(params.block_rows)).cast("long"))
    # the driver holds bounds of the ranges, so they are short; the sort sees whole texts
    ordered = counted_rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64))
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text", "copies")
    both = T.StructType([T.StructField("done", done), T.StructField("open", open_block)])
    solved = written(ordered.mapInArrow(partition_solver(to_arrow_schema(both), params), both), "repaired")
    whole = solved.where("done IS NOT NULL").select("done.*")
    return whole.unionByName(across_borders(solved.where("open IS NOT NULL").select("open.*"), done))


def partition_solver(schema, params: RepairParams):
    """Sorted rows to whole conversations, repaired, and to blocks of those that are long or may cross a border."""

    def run(batches):
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[list] = [[], [], [], []]  # turns, roles, texts, copies of the block that is read
        conv, seen_any, first, chars, copies, waiting, k, opened = None, False, True, 0, 0, 0, 0, 0

        def as_open():
            nonlocal opened
            columns = dict(zip(("turns", "roles", "texts", "copies"), held))
            out.append({"done": None, "open": {"conv_id": conv, "seq": (part << 32) + opened, **columns}})
            opened += 1

        def ready():
            batch = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if not seen_any or conv_id != conv:
                    if seen_any:
                        if first or k:
                            as_open()
                        else:
                            out.append({"done": {"conv_id": conv, **repair_whole(*held)}, "open": None})
                        first, k = False, 0
                    conv, seen_any, chars, copies, held = conv_id, True, 0, 0, [[], [], [], []]
                elif copies >= params.block_rows or chars >= params.block_chars:
                    as_open()
                    k, chars, copies, held = k + 1, 0, 0, [[], [], [], []]
                for column, value in zip(held, row):
                    column.append(value)
                size = len(row[2] or "")
                chars, copies, waiting = chars + size, copies + row[3], waiting + size
                if len(out) >= 512 or (out and waiting >= 2 * params.block_chars):
                    yield ready()
                    waiting = 0
        if seen_any:  # the last of a partition may go on in the next
            as_open()
        if out:
            yield ready()

    return run


def per_block(df: DataFrame, of, schema: T.StructType) -> DataFrame:
    """One row of ``schema`` per row of ``df``; ``of`` takes and gives dicts."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):  # blocks may be megabytes
                yield pa.RecordBatch.from_pylist([of(batch.slice(i, 1).to_pylist()[0])], schema=arrow)

    return df.mapInArrow(run, schema)


def scanned(df: DataFrame, step, first, schema: T.StructType, reverse: bool = False) -> DataFrame:
    """Rows of each conversation in the order of ``seq``, with a state carried from one to the next.

    ``step(state, row)`` gives the next state and a row; ``first`` is the state before a conversation.  Rows are
    streamed, a task holds one batch of them.
    """
    arrow = to_arrow_schema(schema)
    order = F.desc("seq") if reverse else F.asc("seq")
    ordered = df.repartition("conv_id").sortWithinPartitions("conv_id", order)

    def run(batches):
        import pyarrow as pa

        conv, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    conv, state, begun = row["conv_id"], first, True
                state, made = step(state, row)
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ordered.mapInArrow(run, schema)


def across_borders(blocks: DataFrame, done: T.StructType) -> DataFrame:
    """Repaired blocks of conversations that may be in several."""
    head = T.StructType([f for f in done if f.name == "conv_id"])
    with_head = lambda ddl: T.StructType([*head, *T.StructType.fromDDL(ddl)])

    def digests(b):
        return {"conv_id": b["conv_id"], "seq": b["seq"], "d": sorted({turn_digest(r, t) for r, t, n in zip(b["roles"], b["texts"], b["copies"]) if n})}

    turns = per_block(blocks, digests, with_head("seq bigint, d array<binary>")).select("conv_id", "seq", F.explode("d").alias("d"))
    earlier = Window.partitionBy("conv_id", "d").orderBy("seq")  # a row per block at most
    again = turns.withColumn("_n", F.row_number().over(earlier)).where("_n > 1").groupBy("seq").agg(F.collect_list("d").alias("seen"))
    blocks = written(blocks.join(again, "seq", "left"), "blocks")

    def rows_of(b):
        return faults(b["roles"], b["texts"], b["copies"], frozenset(bytes(d) for d in b["seen"] or ()))

    # from the back: the costs to go at each block's end
    matrices = per_block(blocks, lambda b: {"conv_id": b["conv_id"], "seq": b["seq"], "m": block_matrix(rows_of(b))}, with_head("seq bigint, m array<bigint>"))

    def before(after, r):
        last = after is None
        end = final_costs() if last else after
        start = [min(FAR, *(r["m"][4 * s + t] + end[t] for t in range(4))) for s in range(4)]
        return start, {"conv_id": r["conv_id"], "seq": r["seq"], "end": end, "last": last}

    ends = scanned(matrices, before, None, with_head("seq bigint, end array<bigint>, last boolean"), reverse=True)
    known = written(blocks.join(ends.drop("conv_id"), "seq"), "blocks")

    # each block is walked from every state, then the states are chosen from the front
    def walks(b):
        rows = rows_of(b)
        to_go = costs_to_go(rows, b["end"])
        found = [walk(rows, to_go, s, b["end"], b["last"]) if to_go[0][s] < FAR else ("", s) for s in range(4)]
        return {"conv_id": b["conv_id"], "seq": b["seq"], "last": b["last"], "audits": [f[0] for f in found], "exits": [f[1] for f in found]}

    walked = per_block(known, walks, with_head("seq bigint, last boolean, audits array<string>, exits array<int>"))

    def onward(state, r):
        entry, block = state
        made = {"conv_id": r["conv_id"], "seq": r["seq"], "block": block, "whole": block == 0 and r["last"], "entry": entry, "audit": r["audits"][entry]}
        return (r["exits"][entry], block + 1), made

    chosen = scanned(walked, onward, (START, 0), with_head("seq bigint, block bigint, whole boolean, entry int, audit string"))

    def rebuilt_block(b):
        made = repaired_block(rows_of(b), b["turns"], b["roles"], b["texts"], b["copies"], b["block"], b["whole"], b["audit"], b["entry"])
        return {"conv_id": b["conv_id"], **made}

    return per_block(known.join(chosen.drop("conv_id"), "seq"), rebuilt_block, done)


FIGURES = ("blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def summaries(blocks: DataFrame) -> DataFrame:
    """One row per conversation of `repaired`: gaps in its turns, figures, edits and the SHA-256 of its turns as ``role:text`` lines."""
    turns = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    single = blocks.where("whole").select(
        "conv_id", gaps.alias("gaps"), *FIGURES, "audit", F.sha2(F.array_join(turns, "\n").cast("binary"), 256).alias("repaired_sha256")
    )
    return single.unionByName(_summed(blocks.where("NOT whole")))


def _summed(blocks: DataFrame) -> DataFrame:
    """Conversations of several blocks, read in order: what is held of one is its sums, its audit and a digest."""
    schema = T.StructType([T.StructField("conv_id", blocks.schema["conv_id"].dataType), *T.StructType.fromDDL(SUMMARY)])
    arrow = to_arrow_schema(schema)
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(batches):
        import pyarrow as pa

        now = None

        def closed():
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["n"]
            row = {"conv_id": now["conv_id"], "gaps": gaps, **now["sums"], "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                if now is None or b["block"] == 0:
                    if now is not None:
                        yield closed()
                    now = {"conv_id": b["conv_id"], "low": None, "high": None, "n": 0, "sums": dict.fromkeys(FIGURES, 0), "audit": [], "sha": hashlib.sha256(), "any": False, "role": None}
                for f in FIGURES:
                    now["sums"][f] += b[f]
                if now["role"] is not None and b["first_role"] is not None:
                    now["sums"]["illegal"] += now["role"] + b["first_role"] not in ("su", "ua", "au")
                now["role"] = now["role"] if b["last_role"] is None else b["last_role"]
                if b["n_turns"]:
                    now["n"] += b["n_turns"] - (now["high"] == b["first_turn"])
                    now["low"] = b["first_turn"] if now["low"] is None else now["low"]
                    now["high"] = b["last_turn"]
                now["audit"].append(b["audit"])
                for t in b["repaired"]:
                    now["sha"].update((("\n" if now["any"] else "") + t["role"] + ":" + t["text"]).encode())
                    now["any"] = True
        if now is not None:
            yield closed()

    return ordered.mapInArrow(run, schema)

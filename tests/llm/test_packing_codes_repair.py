"""Packing, vector codes and conversation repair against plain recomputations."""

import hashlib
import random
import zlib
from fractions import Fraction
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenlake.llm import packing, repair, vafile

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ packing


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma's", "12345", "émile", "日本語", "\n\n", "...", "<br>", "  "]
    return [" ".join(rng.choices(words, k=int(rng.expovariate(1 / 150)) + rng.randrange(2))) for _ in range(n)]


def test_ids_are_those_of_the_tokenizer():
    mine, plain = packing.Encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    assert mine.fast is not None
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    blocks = ["a".join(letters[i : i + 500]) + " " + " ".join(letters[i : i + 500]) for i in range(0, len(letters), 500)]
    odd = ["", " ", "\n" * 30_000 + "x", "a" * 20_000, "one<|endoftext|>two", "I'll we're 's 'S x", "\x1c\x85\xa0 　b", *texts(50)]
    for text in [*blocks, *odd]:
        assert mine.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    small = packing.Encoder(BYTE_BPE, packing.PackParams(text_chars=50))
    for text in texts(200, 3):
        assert small.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_another_tokenizer_goes_through_its_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, plain = packing.Encoder(path), Tokenizer.from_file(path)
    assert mine.fast is None
    assert mine.ids("Hello there").tolist() == plain.encode("Hello there", add_special_tokens=False).ids


def brute_bins(lengths, size):
    """Fewest bins by search, for a few pieces."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best[0] if lengths else 0


def test_bounds_hold_and_best_fit_is_best_fit():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.choice([10, 16, 24])
        lengths = [rng.randrange(1, size) for _ in range(rng.randrange(0, 9))]
        bound, part = packing.dual_bounds(np.bincount(lengths, minlength=size + 1), size)
        fewest = brute_bins(lengths, size)
        assert bound <= fewest and part <= fewest
        ordered = np.array(sorted(lengths, reverse=True), dtype=np.int64)
        bins, offsets = packing.best_fit_decreasing(ordered, size)
        again, places = packing.exchanged(ordered, size)
        for b in set(again.tolist()):
            inside = sorted((o, n) for n, c, o in zip(ordered.tolist(), again.tolist(), places.tolist()) if c == b)
            ends = np.cumsum([n for _, n in inside]).tolist()
            assert [o for o, _ in inside] == [0, *ends[:-1]] and ends[-1] <= size
        assert sorted(set(again.tolist())) == list(range(again.max(initial=-1) + 1)) and again.max(initial=-1) + 1 >= fewest
        rooms = []
        for length, b, o in zip(ordered.tolist(), bins.tolist(), offsets.tolist()):
            fitting = [r for r in rooms if r >= length]
            assert (b == len(rooms)) == (not fitting)
            if fitting:
                assert rooms[b] == min(fitting) and o == size - rooms[b]
                rooms[b] -= length
            else:
                rooms.append(size - length)
                assert o == 0


def test_exchanges_close_a_gap():
    edges, counts = [1, 50, 100, 200, 300, 400, 500, 600, 700, 800, 900, 1_024], [2664, 2063, 5102, 6571, 6386, 6139, 5346, 4661, 4080, 4086, 4159]
    for seed in range(3):
        rng = np.random.default_rng(seed)
        lengths = np.sort(np.concatenate([rng.integers(a, b, n) for a, b, n in zip(edges, edges[1:], counts)]))[::-1]
        bound, _ = packing.dual_bounds(np.bincount(lengths, minlength=1_025), 1_024)
        assert packing.best_fit_decreasing(lengths, 1_024)[0].max() + 1 > bound
        none = np.full(len(lengths), -1)
        assert packing.repacked(lengths, none, none, packing.PackParams())[0].max() + 1 == bound


@pytest.mark.parametrize("part_pieces,fan", [(65_536, 16), (64, 4), (40, 2)])
def test_packing_round_trip(spark, part_pieces, fan):
    docs = [(i, t) for i, t in enumerate(texts(600))] + [(7, None), (7, ""), (None, "x y"), (900, "long " * 5_000), (900, "long " * 5_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS piece", "'a' AS bin", "2 AS length", "3 AS pid", "4 AS part")
    params = packing.PackParams(part_pieces=part_pieces, fan=fan)
    rows = packing.packed_documents(df, BYTE_BPE, params).collect()
    plain = Tokenizer.from_file(BYTE_BPE)
    want = []
    for doc_id, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(pairwise(cuts)):
            want.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 1024
    count = np.bincount([w[3] for w in want], minlength=1025)
    bound, _ = packing.dual_bounds(count, 1024)
    whole = packing.best_fit_decreasing(np.array(sorted((w[3] for w in want), reverse=True)), 1024)[0].max() + 1
    assert bound <= len(bins) <= whole * 1.01 + 1  # partitions of a few dozen pieces cost little against one of all


def test_sequences_hold_the_tokens(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d " * 3_000), (3, None)], "doc_id long, text string")
    found = packing.sequences(docs, BYTE_BPE).collect()
    plain = Tokenizer.from_file(BYTE_BPE)
    assert all(len(r.ids) <= 1024 for r in found)
    parts = {(d, s): r.ids for r in found for d, s in zip(r.doc_ids, r.starts)}
    assert sum(len(r.ids) for r in found) == sum(len(plain.encode(t).ids) + 1 for t in ("a b c", "d " * 3_000, ""))
    assert {d for d, _ in parts} == {1, 2, 3}


def test_packing_an_empty_table(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string"), BYTE_BPE).collect() == []


# ------------------------------------------------------------------ codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error) by loops, for vectors of one length, and the codebooks."""
    q = [(i, [int(Fraction(x) * 4096 // 1) for x in v]) for i, v in rows]
    sizes = [len(q[0][1]) // parts + (p < len(q[0][1]) % parts) for p in range(parts)]
    cuts = [0, *np.cumsum(sizes).tolist()]
    first = [v for _, _, v in sorted((i is None, i or 0, v) for i, v in q)[:entries]]
    books = [[v[a:b] for v in first] for a, b in pairwise(cuts)]

    def nearest(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p, (a, b) in enumerate(pairwise(cuts)):
            members = {}
            for _, v in q:
                members.setdefault(nearest(p, v[a:b])[1], []).append(v[a:b])
            for k, of in members.items():
                new[p][k] = [sum(c) // len(of) for c in zip(*of)]
        books = new
    out = []
    for i, v in q:
        found = [nearest(p, v[a:b]) for p, (a, b) in enumerate(pairwise(cuts))]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{k:02x}" for _, k in found), error if error < 2**63 else None))
    return sorted(out, key=str), books


@pytest.mark.parametrize("width,n,scale", [(16, 120, 1.0), (19, 60, 1.0), (5, 60, 0.001), (8, 9, 1.0), (16, 60, 1e9), (9, 40, 1e200)])
def test_codes_match_loops(spark, width, n, scale):
    rng = np.random.default_rng(width + n)
    rows = [(i, (np.round(rng.normal(size=width), 1) * scale).tolist()) for i in range(n)]  # rounding makes ties
    rows += [(3, rows[5][1]), (None, rows[6][1]), (1, rows[1][1])]
    bad = [(500, None), (501, [1.0] * (width - 1) + [None]), (502, [float("nan")] * width), (503, [float("inf")] * width)]
    df = spark.createDataFrame([(*r, i % 3 or None, "x") for i, r in enumerate(rows + bad)], "vec_id long, embedding array<double>, label int, error string")
    codes, books = vafile.compressed(df, vafile.CodeParams(chunk=7))
    want, want_books = plain_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error) for r in codes.collect()), key=str) == want
    assert [[list(map(int, e)) for e in b] for b in books[width]] == want_books
    digest = hashlib.sha256(",".join(str(v) for b in want_books for e in b for v in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in codes.collect()} == {digest}


def test_bounds_never_drop_a_nearest_entry():
    rng = np.random.default_rng(3)
    for bits in (1, 2, 3, 5):
        entries = rng.integers(-9, 9, (16, 4))
        entries[3] = entries[11]
        q = rng.integers(-12, 12, (500, 4))
        entry, apart = vafile.VAFile(entries, bits).nearest(q)
        every = ((q[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        assert (entry == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()


def test_labels_lengths_and_empty_tables(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.25] * 8, None), (3, [0.5] * 4, None), (4, [], 1), (5, [0.75] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    codes, books = vafile.compressed(df, vafile.CodeParams(book_numbers=1))
    assert sorted(books) == [0, 4, 8] and codes.count() == 5
    summed = {r.vec_id: (r.label, r.error, r.label_error) for r in vafile.with_label_errors(codes).collect()}
    for label in (1, None):
        assert {e for x, _, e in summed.values() if x == label} == {sum(e for x, e, _ in summed.values() if x == label)}
    none, _ = vafile.compressed(df.where("vec_id > 9"))
    assert vafile.with_label_errors(none).collect() == []


# ------------------------------------------------------------------ repair


def plain_repair(rows):
    """(cost, audit, turns) of (role, text) rows by a forward search that keeps the least (cost, audit) of each grammar state."""
    cheapest = {"": (0, "", [])}  # state: the last initial that is left

    def inserted(of):
        for _ in range(3):
            for state, (cost, audit, turns) in list(of.items()):
                into, role = ("a", "assistant") if state == "u" else ("u", "user")
                made = (cost + 5, audit + "I", [*turns, (role, "")])
                if into not in of or made[:2] < of[into][:2]:
                    of[into] = made
        return of

    cheapest = inserted(cheapest)
    seen, kinds = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
        seen.add((role, text))
        kinds.append(kind)
        new = {}

        def offer(state, made):
            if state not in new or made[:2] < new[state][:2]:  # noqa: B023
                new[state] = made  # noqa: B023

        for state, (cost, audit, turns) in cheapest.items():
            offer(state, (cost + 2, audit + "D", turns))
            if kind in ("blank", "duplicate"):
                continue
            more = 5 if kind else 0
            into, given = ("a", "assistant") if state == "u" else ("u", "user")
            if role[:1] == into or (role[:1] == "s" and state == ""):
                offer(role[:1], (cost + more, audit + "K", [*turns, (role, text)]))
            offer(into, (cost + more + 1, audit + "R", [*turns, (given, text)]))
        cheapest = inserted(new)
    cost, audit, turns = min((v for k, v in cheapest.items() if k in ("", "a")), key=lambda v: v[:2])
    return cost, audit, turns, kinds


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for _ in range(longest if c == 0 else rng.randrange(0, 9)):
            turn = rng.choice([None, *range(-1, 12)]) if c != 0 else rng.choice([None, *range(40)])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "usher", "tool", "", None])
            rows.append((c, turn, role, rng.choice(["Yes.", "No!", "cut", "  \t", "", None, "Why?\n ", "é.", "Yes.  ", " ", str(rng.random()) + "."])))
    return rows + rows[: len(rows) // 4]


def crc_damaged(rows):
    out = {}
    for c, turn, role, text in rows:
        kept = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        elif k == 2:
            text = "".join(x for x in text if x not in ".!?")
        elif k == 4:
            role = "user"
        kept.extend([(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


@pytest.mark.parametrize("block_rows,parts", [(4_096, 4), (3, 4), (1, 7), (5, 1)])
def test_repair_matches_a_forward_search(spark, block_rows, parts):
    rows = conversations(block_rows, 60, 150)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "'z' AS audit", "2 AS copies", "3 AS n")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = repair.summaries(repair.repaired(repair.damaged(df), repair.RepairParams(block_rows=block_rows))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    damaged = crc_damaged(rows)
    assert sorted(map(str, damaged)) == sorted(str(r.conv_id) for r in found)
    for r in found:
        own = damaged[r.conv_id]
        cost, audit, turns, kinds = plain_repair([x[1:] for x in own])
        seen = [t for t, _, _ in own if t is not None]
        initials = [x[1][:1] for x in own]
        assert (r.cost, r.audit) == (cost, audit)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated) == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        assert r.gaps == (max(seen) - min(seen) + 1 - len(set(seen)) if seen else 0)
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))


def test_very_many_copies_are_cut_into_blocks(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    rows = df.crossJoin(spark.range(2_000)).drop("id")
    blocks = repair.repaired(repair.undamaged(rows), repair.RepairParams(block_rows=64)).collect()
    assert max(len(b.audit) for b in blocks) <= 2 * 64 + 2
    r = repair.summaries(repair.repaired(repair.undamaged(rows), repair.RepairParams(block_rows=64))).first()
    assert (r.duplicate, r.cost, r.audit) == (3_998, 7_996, "K" + "D" * 1_999 + "K" + "D" * 1_999)


def test_repair_of_empty_tables_and_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.summaries(repair.repaired(repair.damaged(empty))).collect() == []
    dropped = next(t for t in range(1_000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    gone = spark.createDataFrame([(5, dropped, "user", "Hi.")], empty.schema)
    r = repair.summaries(repair.repaired(repair.damaged(gone))).first()
    assert tuple(r) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())

"""Operators against brute force on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenlake.llm import decontam, graph, mixing, pivots, ranking, sharding, simhash, tokencount, toxicity, urlrules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=True):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({c: F.lit(7) for c in ("score", "shard", "component_id", "fp", "slot", "block", "tile", "hash")}) if extra else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- toxicity


def toxic_corpus(n=400, seed=0):
    r = random.Random(seed)
    syll = ["an", "the", "er", "ing", "on", "re", "ha", "wh", "st", "en", "ou", "ea"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["worthless", "idiotic", "disgusting", "pathetic"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_the_held_out_fold(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.03 * len(held)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_toxicity_learns_nothing_from_the_held_out_fold(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], DOCS)
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    a, b = (spark.createDataFrame([(i, 1, f(i, y)) for i, _, y in rows], "doc_id long, quality int, toxic int") for f in (lambda i, y: y, flip))
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score_documents(docs, x).collect()) for x in (a, b)]
    assert scores[0] == scores[1]


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, None), (None, 0, 0), (0, 0, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [None, "", "  ...", "word " * 50_000]).unionByName(docs_of(spark, ["a"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert [r.predicted for r in toxicity.score_documents(docs, labels).collect()] == [0] * 5
    assert toxicity.score_documents(empty(spark), labels.limit(0)).count() == 0
    model = toxicity.fit([(t, y) for _, t, y in toxic_corpus(120)])
    s = toxicity.scorer(model)
    assert s.score(None) == s.score(b"") == s.score(b" . ") and s.score(b"disgusting pathetic worthless") > s.score(b"the on there")


def test_toxicity_against_a_plain_recomputation():
    import math

    import zstandard as zs

    rows = [(t, y) for _, t, y in toxic_corpus(200)] + [("worthless idiotic pathetic " * 30_000, 1), (None, 0), ("", 1), toxic_corpus(200)[0][1:]]
    model = toxicity.fit(rows)
    plain = [zs.ZstdCompressor(level=19, dict_data=zs.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.ordinary, model.toxic)]

    def windows(text):
        return {w for w in "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (text or "").lower()).split()}

    def cell(word):  # a frame's magic number has four bytes
        return tuple(min(len(c.compress(b" " * 24 + word.encode() + b" ")) - 4, 23) for c in plain)

    # of copies with one label the first counts; each third row of a class calibrates
    first = list(dict.fromkeys((t, y) for t, y in rows if windows(t)))
    held = {y: [t for t, label in first if label == y][::3] for y in (0, 1)}
    n = {y: Counter(cell(w) for t in held[y] for w in windows(t)) for y in (0, 1)}
    whole = {y: sum(n[y].values()) for y in (0, 1)}
    table = {}
    for c in {*n[0], *n[1]}:
        raw = math.log((n[1][c] + 0.5) / (whole[1] + 1)) - math.log((n[0][c] + 0.5) / (whole[0] + 1))
        sure = abs(raw) - math.sqrt(1 / (n[1][c] + 0.5) + 1 / (n[0][c] + 0.5))
        table[c] = math.copysign(max(sure, 0), raw) if max(sure, 0) >= 0.5 else 0.0
    for c, value in table.items():
        assert abs(model.log_ratio[c[0] * toxicity.CELLS + c[1]] - value) < 1e-9
    evidence = lambda t: sum(table.get(cell(w), 0.0) for w in windows(t))
    a, b = model.weights
    x, y = (np.array(v) for v in zip(*[(evidence(t), k) for k in (0, 1) for t in held[k]]))
    p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
    scale = np.abs(x).max()  # at the curve's best fit the gradient is the small pull on the slope
    assert abs((y - p).sum()) < 1e-6 and abs(((y - p) * x / scale).sum() - 1e-3 * b * scale) < 1e-6
    s = toxicity.scorer(model)
    for t, _ in rows:
        want = 1 / (1 + math.exp(-min(max(a + b * sum(model.log_ratio[c[0] * toxicity.CELLS + c[1]] for c in map(cell, windows(t))), -500), 500)))
        assert abs(s.score((t or "").encode()) - want) < 1e-9


def test_toxicity_reads_labelled_rows_whole():
    r = random.Random(4)
    same = " ".join(f"w{i}" for i in range(40)) + " "
    rest = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    rows = [(f"{same}{rest()} worthless idiotic", 1) for _ in range(40)] + [(f"{same}{rest()} plain end", 0) for _ in range(40)]
    model = toxicity.fit(rows)
    s = toxicity.scorer(model)
    assert s.score(f"{same}{rest()} worthless idiotic".encode()) > s.score(f"{same}{rest()} plain end".encode())
    # near copies count once: many of one text don't change the model of the others
    copies = [(rows[0][0].replace("w3 ", f"x{i} "), 1) for i in range(30)]
    assert toxicity.fit(rows + copies).key == model.key


# ---------------------------------------------------------------- vectors


def brute_links(v, ok, threshold):
    x = np.array(v, dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {(i, j) for i in range(len(v)) for j in range(len(v)) if i != j and x[i] @ x[j] >= threshold}


def brute_components(ids, links):
    low = {i: i for i in ids}
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


@pytest.mark.parametrize("block", [8, 1024])
def test_vectors_against_brute_force(spark, block):
    r = np.random.default_rng(0)
    base = r.standard_normal((120, 32))
    near = base[:40] + 0.25 * r.standard_normal((40, 32)) * np.linalg.norm(base[:40], axis=1, keepdims=True) / np.sqrt(32)
    crowd = base[5] + 0.05 * r.standard_normal((60, 32))
    v = np.concatenate([base, near, crowd, base[:5], 3 * base[5:8]]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 0, "clash") for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int, component string")
    got = {r.vec_id: r for r in pivots.linked_vectors(df, pivots.PivotParams(least_block=block)).collect()}
    links = brute_links(v, None, 0.9)
    n = Counter(a for a, _ in links)
    found = sum(got[i].n_links for i in range(len(v)))
    assert found >= 0.95 * len(links) and all(got[i].n_links <= n[i] for i in got)
    low = brute_components(range(len(v)), links)
    assert np.mean([got[i].component_id == low[i] for i in low]) >= 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, -0.0]), (9, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted([tuple(r) for r in pivots.linked_vectors(df).collect()], key=str)
    assert [g for g in got if g[0] in (1, 2, 3, 4, 5, 6, 9)] == [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)]
    assert [g for g in got if g[0] in (7, 8)] == [(7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False)]
    assert (None, 0, None, False) in got
    assert pivots.linked_vectors(df.limit(0)).count() == 0


def test_vectors_of_extreme_size_and_many_lengths(spark):
    rows = [(0, [1e200, 1e200]), (1, [2e200, 2e200]), (2, [1e-170, 1e-170]), (3, [1.0, 0.2]), (4, [5e-324, 0.0]), (5, [1e308, 0.0]), (6, [-1e308, 0.0])]
    rows += [(10 + n, [1.0] * n) for n in range(3, 20)] + [(40 + n, [2.0] * n) for n in range(3, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pivots.linked_vectors(df).collect()}
    assert [got[i].n_links for i in range(7)] == [2, 2, 2, 2, 2, 2, 0]
    assert [got[i].component_id for i in range(7)] == [0, 0, 0, 3, 3, 3, 6]
    assert all((got[10 + n].n_links, got[40 + n].component_id) == (1, 10 + n) for n in range(3, 20))


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shaped(r, n, shape):
    """Unit vectors: isotropic of a length, with a common direction, or near a plane of few dimensions (also with a common direction)."""
    kind, width = shape.split("-")
    width = int(width)
    x = unit(r.standard_normal((n, width)))
    if kind in ("low", "conelow"):
        x = unit(r.standard_normal((n, 8)) @ r.standard_normal((8, width)) + 0.05 * r.standard_normal((n, width)))
    if kind in ("cone", "conelow"):
        x = unit(0.8 * np.eye(width)[0] + 0.6 * x)
    return x


def with_mates(r, x):
    """The vectors and one more for each, at a cosine just above 0.9, on the way to another."""
    y = pivots.mates_of(x, x[r.permutation(len(x))], 0.9)
    t = r.uniform(0.9, 0.999, (len(x), 1))
    return np.concatenate([x, unit(t * y + (1 - t) * x)])


SHAPES = ["iso-4", "iso-8", "iso-64", "iso-384", "cone-64", "cone-384", "low-64", "conelow-64"]


@pytest.mark.parametrize("shape", SHAPES)
def test_fitted_pivots_find_pairs_at_the_threshold_and_few_others(shape):
    r = np.random.default_rng(3)
    x = shaped(r, 12_000, shape)
    sample, probe = x[:8_192], x[8_192:]
    mates = pivots.mates_of(probe, probe[r.permutation(len(probe))], 0.9)
    for count in (20_000, 2_000_000, 2_000_000_000):
        known = pivots.fitted(sample, count, pivots.PivotParams())
        a, b = (known.permutations(v, 32) for v in (probe, mates))
        both = lambda p, q: (p[:, : known.lists, None] == q[:, None, : known.lists]).any((1, 2)) & ((p[:, :, None] == q[:, None, :]).any(2).sum(1) >= known.shared)  # noqa: E731,B023
        assert both(a, b).mean() >= 0.965
        chance = np.mean([both(a, np.roll(a, i, 0)).mean() for i in (1, 2, 3)])
        linked = np.mean([((probe * np.roll(probe, i, 0)).sum(1) >= 0.9).mean() for i in (1, 2, 3)])
        # true links are candidates; with a common direction and few dimensions chance pairs are hardly farther apart than links
        most = 0.15 if shape.startswith("conelow") else 0.05
        assert count < 1_000_000 or chance <= most + 5 * linked


@pytest.mark.parametrize("shape,count", [("iso-64", 64), ("iso-64", 512), ("iso-64", 2_048), ("iso-4", 1), ("iso-8", 64), ("cone-64", 64), ("cone-384", 512), ("low-64", 256), ("conelow-64", 64)])
def test_recall_at_the_threshold(spark, shape, count):
    r = np.random.default_rng(count)
    v = with_mates(r, shaped(r, 1_500, shape))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.n_links for x in pivots.linked_vectors(df, pivots.PivotParams(min_pivots=count, least_block=256)).collect()}
    links = Counter(a for a, _ in brute_links(v, None, 0.9))
    assert sum(got.values()) >= 0.95 * sum(links.values()) and all(got[i] <= links[i] for i in got)


def test_components_on_random_graphs(spark):
    r = random.Random(1)
    for n, m in ((30, 20), (200, 150), (50, 49)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 15)] + [(None, 1)]
        got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
        real = [(a, b) for a, b in links if a is not None and a != b]
        assert got == brute_components({x for l in real for x in l}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- WARC


def test_warc_round_trip(spark, tmp_path):
    big, nasty = "é" * 60, "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "y" * 90
    rows = [(5, "u5", big), (3, "u3", big), (9, "http://h/\r\nX: 1", big), (1, None, "small"), (2, "u2", "small"), (4, "u4", None), (6, "u6", ""), (7, "u7", nasty), (8, "u8", nasty), (8, "u8", nasty), (None, "n", big), (None, "n", "only" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "payload": F.lit("q")})
    got = sorted(map(tuple, warc.archive_round_trip(pages, warc.WarcParams(archive_bytes=200)).collect()), key=str)
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    first = {big: 3, nasty: 7}
    want = [(i, len((h or "").encode()), sha(h), "revisit" if h in first and i != first[h] else "response", first[h] if h in first and i != first[h] else None) for i, _, h in rows]
    assert got == sorted(want, key=str)
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert {bytes(r.payload) for r in records if r.payload is not None} == {(h or "").encode() for _, _, h in rows}
    assert all(r.payload is None for r in records if r.record_type == "revisit")
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_archives_are_bounded_and_revisits_name_their_response(spark, tmp_path):
    import gzip

    texts = ["ab" * 200] * 4 + [f"{i} " * 150 for i in range(60)] + ["long " * 300_000, "longer " * 300_000, "long " * 300_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"), warc.WarcParams(archive_bytes=4_000, class_factor=2))
    archives = [gzip.decompress(p.read_bytes()).decode() for p in (tmp_path / "w").rglob("*.gz")]
    assert all(a.count("WARC-Record-ID") == 1 or len(a) < 4_000 + 700 * a.count("WARC-Record-ID") for a in archives)
    records = [x for a in archives if a for x in a.split("\r\n\r\nWARC/1.1\r\n")]
    assert len(records) == len(texts) and sum("WARC-Type: revisit" in x for x in records) == 4
    assert all(("WARC-Refers-To-Target-URI: http://h/0\r\n" in x or "Target-URI: http://h/64\r\n" in x) and "WARC-Refers-To-Date: " in x for x in records if "revisit" in x)
    back = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert all(bytes(back[i].payload).decode() == t for i, t in enumerate(texts) if back[i].payload is not None) and len(back) == len(texts)


# ---------------------------------------------------------------- url rules


def brute_judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits and host else (host, path, None, "allow")


@pytest.mark.parametrize("salt_rows", [3, 5_000])
def test_url_rules_against_brute_force(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(urlrules, "SALT_ROWS", salt_rows)
    r = random.Random(2)
    label, part = (lambda: r.choice(["a", "b", "com", "x-y"])), (lambda: r.choice(["/", "/en", "/en/", "/e", "/en/é", "\u007f", ""]))
    rules = {(".".join(label() for _ in range(r.randint(1, 3))), part() + part()): r.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"{r.choice(['http', 'HTTPS'])}://{'.'.join(label() for _ in range(r.randint(1, 5))).upper() if r.random() < 0.3 else '.'.join(label() for _ in range(r.randint(1, 5)))}{part()}{part()}{r.choice(['', '?q=/en', '#f', 'z\u00ff'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http:///en", "http://com", "http://com/", "x://A.com/EN\n/q"] + ["http://a.com/en/"] * 50
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    frame = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block"), ("com", "/", "odd")], "host string, path string, verdict string")
    got = {x.page_id: tuple(x)[1:] for x in urlrules.judge(pages, frame).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == brute_judge(u, rules), u
    assert urlrules.judge(pages.limit(0), frame).count() == 0
    assert urlrules.judge(pages, frame.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)


def test_url_rules_with_separators_in_hosts_and_long_urls(spark):
    rules = [("www.example.com", "/en/", "block"), ("com", "/" + "a" * 50_000, "block")]
    marks = "\u0001\u0002\u0003"
    urls = [f"http://example{a}{b}www.com/en/x" for a in marks for b in ["", *marks]] + ["http://q.com/" + "a" * 60_000, "http://" + "b" * 60_000 + ".com/", "http://com\u0001example\u0001www/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: tuple(x)[1:] for x in urlrules.judge(pages, urlrules.rule_table(spark, rules)).collect()}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate(urls)}


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items, n=10):
    import re

    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for i in range(max(1, len(x) - n + 1) if x else 0):
            g = x[i : i + n]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_windows", [3, 10_000])
def test_decontamination_against_brute_force(spark, max_windows):
    r = random.Random(3)
    vocab = ["the", "An", "ß", "x1", "9", "é́", "word", "日本"]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(r.choice([3, 9, 10, 11, 30])))) for i in range(12)] + [(90, None), (91, ""), (92, "..."), (0, "an an an an")]
    texts = [None, "", "...", "The", *[" ".join([*words(5), *(items[i % 12][1].upper() if i % 2 else items[i % 12][1].replace(" ", ", ")).split(), *words(4)]) for i in range(30)], " ".join(words(3000)), "a" * 600_000 + " " + items[3][1]]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    params = decontam.DecontamParams(max_windows=max_windows)
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in decontam.report(docs, bench, params).collect()}
    want = {i: brute_hits(t, items) for i, t in enumerate(texts)}
    assert got == want
    kept = decontam.decontaminate(docs, bench, params)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, w in want.items() if not w[1]}
    cut = {x.doc_id: x.text for x in decontam.decontaminate(docs, bench, params, "span").collect()}
    assert len(cut) == len(texts) and all(cut[i] == texts[i] for i, w in want.items() if not w[1])
    assert all(brute_hits(cut[i], items)[0] <= w[0] - w[1] + 1 for i, w in want.items() if w[1] and i < 30)
    assert decontam.report(docs.limit(0), bench).count() == 0 and decontam.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_spans_do_not_depend_on_the_size_of_a_block(spark):
    abc = [chr(97 + i) for i in range(26)]
    items = [(1, " ".join(abc[:12])), (2, " ".join(abc[7:20])), (3, " ".join(abc[5:17]))]
    docs = spark.createDataFrame([(1, " ".join(abc), "keep", 5), (2, None, "x", 6), (3, "A-b " + "c " * 9, None, 7)], "doc_id long, text string, row string, found int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    runs = []
    for params in (decontam.DecontamParams(max_windows=1), decontam.DecontamParams(max_bytes=30), decontam.DecontamParams()):
        cut = decontam.decontaminate(docs, bench, params, "span")
        assert cut.columns == docs.columns
        runs.append(sorted(map(tuple, cut.collect())))
        assert {r.doc_id for r in decontam.decontaminate(docs, bench, params).collect()} == {2, 3}
    assert runs[0] == runs[1] == runs[2] and runs[0][0] == (1, " u v w x y z", "keep", 5)


# ---------------------------------------------------------------- mixing


def edf(shares, period):
    done, out = {s: 0 for s in shares}, []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // n), s) for s, n in sorted(shares.items()) if done[s] * period // n <= t and done[s] < n]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


@pytest.mark.parametrize("stop", ["all_exhausted", "first_exhausted"])
def test_mix_is_the_edf_schedule_within_one_block(spark, stop):
    sizes = {"big": 700, "mid": 150, "": 60, "tiny": 9}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(k, "t", "en", s or None, 1) for k, (i, s) in enumerate(rows)], DOCS)
    params = mixing.MixParams(block_rows=4, period=50, stop=stop)
    weights = spark.createDataFrame([("big", 10.0), ("mid", 9.0), (None, 5.0), ("tiny", 1.0)], "source string, weight double")
    got = mixing.schedule(docs, weights, params).collect()
    shares = {"big": 20, "mid": 18, "": 10, "tiny": 2}
    order = edf(shares, 50)
    slots = {r.slot: (r.source or "") for r in got}
    assert sorted(slots) == list(range(max(slots) + 1))
    assert all(slots[t] == order[t % 50] for t in slots)
    assert all(r.release <= r.slot < r.deadline for r in got)
    for s, n in shares.items():
        seen = 0
        for t in sorted(slots):
            seen += slots[t] == s
            assert abs(seen - (t + 1) * n / 50) < 1
    count = Counter((r.doc_id) for r in got)
    if stop == "all_exhausted":
        assert set(count) == set(range(len(rows)))
        assert all(r.epoch == 0 for r in got if r.source == "big")
    else:
        assert max(count.values()) <= 1 or any(r.source == "tiny" for r in got)
    places = Counter((r.slot, r.place) for r in got)
    assert max(places.values()) == 1


def test_mix_edges(spark):
    docs = docs_of(spark, [None, "", "a", "a", "b", None]).unionByName(docs_of(spark, ["q"]).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")}))
    mixed = mixing.mixed_documents(docs, params=mixing.MixParams(block_rows=1, period=20))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {0, 1, 2, 3, 4, 5, None}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(docs, params=mixing.MixParams(max_sources=2))


@pytest.mark.parametrize("small, large, rows, period", [(60, 30, 300, 100), (30, 30, 300, 100), (270, 4, 900, 50)])
def test_mix_of_many_small_sources_loses_no_document(spark, small, large, rows, period):
    sizes = {**{f"s{i}": 1 for i in range(small)}, **{f"l{i}": rows + i for i in range(large)}}
    names = [s for s, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, "t", "en", s, 1) for i, s in enumerate(names)], DOCS)
    params = mixing.MixParams(block_rows=2, period=period, max_period=0)  # no longer period for the small ones
    got = mixing.schedule(docs, params=params).select("doc_id", "slot", "source").collect()
    assert {r.doc_id for r in got} == set(range(len(names)))
    whole = max(period, 2 * (small + large))
    slots = {r.slot: r.source for r in got}
    blocks = Counter(slots[t] for t in range(whole))
    assert sorted(slots) == list(range(max(slots) + 1)) and len(blocks) == small + large
    weight = {s: n**params.temperature for s, n in sizes.items() if s[0] == "l"}
    for s in sizes:
        due = 1 if s[0] == "s" else (whole - small) * weight[s] / sum(weight.values())
        assert blocks[s] >= 1 and abs(blocks[s] - due) < 1


def test_mix_keeps_the_values_of_clashing_columns(spark):
    names = [*mixing.ADDED, "_n", "_hash", "_src", "_rank", "doc", "a.b"]
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), *[(F.col("id") * 10 + k).alias(n) for k, n in enumerate(names)])
    params = mixing.MixParams(block_rows=2, period=10)
    mixed = mixing.mixed_documents(docs, params=params)
    assert mixed.columns == docs.columns and set(mixed.collect()) == set(docs.collect())
    assert mixing.schedule(docs, params=params).columns == ["doc_id", "source", *names[6:], *mixing.ADDED]


@pytest.mark.parametrize("lot", [3, 10_000])
def test_mix_follows_small_weights_and_deals_copies_in_lots(spark, lot):
    docs = spark.range(2_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "tiny").otherwise("big").alias("source"))
    weights = spark.createDataFrame([("big", 999.0), ("tiny", 1.0)], "source string, weight double")
    few = mixing.MixParams(block_rows=1, period=50, lot=lot)
    got = Counter(r.source for r in mixing.schedule(docs, weights, few).collect())
    assert got["big"] == 2_000 and got["tiny"] in (2, 3)  # a period of 1,000 slots
    equal = spark.createDataFrame([("big", 1.0), ("tiny", 1.0)], "source string, weight double")
    rows = mixing.schedule(docs, equal, few).collect()
    assert Counter(r.source for r in rows)["big"] == 2_000 and len({(r.slot, r.place) for r in rows}) == len(rows)
    assert sorted(r.epoch for r in rows if r.source == "tiny") == list(range(sum(r.source == "tiny" for r in rows)))


def test_mix_of_many_skewed_sources(spark):
    sizes = [2] * 200 + [190 + i for i in range(50)]
    names = [f"s{k}" for k, n in enumerate(sizes) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    weights = spark.createDataFrame([(f"s{k}", 0.1 if k < 200 else 9.6) for k in range(250)], "source string, weight double")
    plan = mixing.shares(mixing.source_counts(docs), weights, mixing.MixParams()).collect()
    assert len(plan) == 250 and min(r.blocks for r in plan) >= 1 and sum(r.blocks for r in plan) == 500
    assert {r.doc_id for r in mixing.schedule(docs, weights, mixing.MixParams(block_rows=4)).select("doc_id").collect()} == set(range(len(names)))


# ---------------------------------------------------------------- SimHash


def brute_print(text, k, seed=42):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64(g, seed=seed).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.mark.parametrize("tile", [16, 16_384])
def test_simhash_against_brute_force(spark, tile):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(r.randint(1, 200))] for _ in range(60)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1] + ["end"]) for b in base] + ["\t".join(base[3]).upper()] * 5
    texts += [None, "", " \n", "One", "one\u00a0two", "x " * 70_000]
    docs = docs_of(spark, texts)
    params = simhash.SimHashParams(shingle_words=4, radius=4, tile=tile)
    got = {x.doc_id: (x.fp % 2**64, x.component_id) for x in simhash.near_duplicates(docs, params).collect()}
    prints = [brute_print(t, 4) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == prints
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    low = brute_components(range(len(texts)), links)
    assert {i: g[1] for i, g in got.items()} == low


def brute_similar(texts, similarity=0.8, k=5):
    """Links of texts whose distinct k-word shingles have the similarity."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    same = lambda a, b: a == b or (len(a & b) >= similarity * len(a | b) and bool(a and b))
    return [(i, j) for i in range(len(texts)) for j in range(i) if same(sets[i], sets[j])]


@pytest.mark.parametrize("block", [4, 256])
def test_similar_documents_against_brute_force(spark, block):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(60, 300))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 6):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy).title())
    crowd = [word() for _ in range(200)]
    texts += [" ".join([*crowd[:i], word(), *crowd[i + 1 :]]) for i in range(40)]
    texts += [None, "", " ", "one two", "One  two", "one two three", texts[0]]
    docs = docs_of(spark, texts)
    params = simhash.SimHashParams(block=block)
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(docs, params).collect()}
    links = brute_similar(texts)
    low = brute_components(range(len(texts)), links)
    assert {i: got[i] for i in low} == low
    kept = simhash.drop_near_duplicates(docs.unionByName(docs.limit(9)), params)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(low.values()))


@pytest.mark.parametrize("posting_block", [4, 4_096])
def test_similar_documents_with_repeated_lines_and_short_texts(spark, posting_block):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for times in (10, 20, 50):
        for _ in range(4):
            body, line = [[word() for _ in range(n)] for n in (400, 15)]
            texts += [" ".join(body + line), " ".join(body + line * times)]
    for n in (*range(5, 17), 24, 44):  # a word less or more: short sets on both sides of 0.8
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts += [" ".join(base), " ".join([*base, word()]), " ".join([word(), *base[1:]])]
    common = [word() for _ in range(30)]  # a passage in many texts, also counted as common in the sample
    texts += [" ".join([*common, *(word() for _ in range(r.randint(1, 60)))]) for _ in range(120)]
    docs = docs_of(spark, texts)
    params = simhash.SimHashParams(posting_block=posting_block, sampled=2)
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(docs, params).collect()}
    assert got == brute_components(range(len(texts)), brute_similar(texts))


def test_one_id_with_several_texts_keeps_each_class(spark):
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, d, e = (text(60) for _ in range(5))
    rows = [(5, a), (5, b), (5, b), (3, c), (5, c + " more"), (8, d), (8, d + " more"), (9, e), (9, e + " more"), (9, c), (9, a + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = simhash.drop_near_duplicates(docs)
    got = [(x.doc_id, x.text.removesuffix(" more")) for x in kept.collect()]
    assert kept.columns == docs.columns and sorted(got) == sorted([(5, a), (5, b), (3, c), (8, d), (9, e)])


def test_prefixes_and_radius_keep_every_pair_at_the_similarity():
    r = np.random.default_rng(3)
    radius, missed = simhash.sketch_radius(0.8, 1e-6), 0
    assert radius < 64
    for size in (*range(4, 40), 100, 401):
        for _ in range(20):
            most = int(size / 0.8 - size + 1e-9)
            own = int(r.integers(0, most + 1))
            x = r.integers(0, 2**63, size + most, dtype=np.uint64)
            a, b = np.unique(x[: size + own]), np.unique(np.r_[x[:size], x[size + own :]])
            hashes = np.unique(r.choice(x, 3))
            for common in ((np.array([], dtype=np.uint64), np.array([])), (hashes, np.arange(5, 5 + len(hashes)))):
                assert len(np.intersect1d(simhash.prefix(a, common, 0.8), simhash.prefix(b, common, 0.8)))
            prints = [(simhash.majority([s]), simhash.majority([simhash.remixed(s)])) for s in (a, b)]
            missed += sum((p ^ q).bit_count() for p, q in zip(*prints)) > radius
    assert missed == 0


def test_tiles_lose_no_link_and_skip_by_counts():
    r = np.random.default_rng(5)
    fp = r.integers(0, 2**63, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, int(k), replace=False)) for k in r.integers(0, 8, 3000)], dtype=np.uint64)
    other = fp ^ flips
    ids = np.arange(3000)
    forest = graph.LocalForest()
    simhash.link_tiles(simhash._sorted_tile(fp, ids), simhash._sorted_tile(other, ids + 3000), 4, forest)
    near = np.bitwise_count(flips) <= 4
    assert all((forest.find(int(i)) == forest.find(int(i) + 3000)) == near[i] for i in range(3000))


def test_simhash_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c", "en", "s", 1), (None, "a b c", "en", "s", 1), (4, "d e f g", "en", "s", 1), (None, "d e f g", "en", "s", 1)], DOCS)
    assert sorted(map(str, (x.component_id for x in simhash.near_duplicates(docs).collect()))) == ["4", "4", "None", "None"]
    both = simhash.drop_near_duplicates(docs.withColumn("fp", F.lit(1)))
    assert both.columns == [*docs.columns, "fp"] and sorted((str(x.doc_id), x.text) for x in both.collect()) == [("4", "d e f g"), ("None", "a b c"), ("None", "a b c")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- tokens


def brute_tokens(word, v):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        size = len(word[e - 1].encode())
        options = [(best[e - 1][0] + tokencount.BYTE_SCORE * size, best[e - 1][1] + size)]
        options += [(best[s][0] + v.scores[word[s:e]], best[s][1] + 1) for s in range(max(0, e - v.longest), e) if word[s:e] in v.scores]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_token_counts_against_brute_force(spark):
    r = random.Random(6)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aab", "bb", "▁ab", "é"]
    v = tokencount.Vocabulary.of(pieces)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 30))) for _ in range(60)]
    texts += [None, "", " \n ", "ab" * 20_000, "日本 ab"]
    got = {x.doc_id: (x.n_tokens, x.n_pretokens) for x in tokencount.token_counts(docs_of(spark, texts), v).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert got[i] == (sum(brute_tokens("▁" + w, v) for w in words), len(words))
    assert tokencount.token_counts(empty(spark), v).count() == 0


# ---------------------------------------------------------------- sharding


def brute_shard(key, tree):
    import math

    def draw(name, w):
        h = int(hashlib.md5(f"{name}/{key}".encode()).hexdigest()[:12], 16)
        return -math.log((h + 0.5) / 2**48) / w

    level = {}
    for x in tree:
        level.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    w = lambda xs: sum(x.weight for x in xs)
    region = min(sorted(level), key=lambda g: draw(g, w([x for r in level[g].values() for x in r])) if len(level) > 1 else 0)
    rack = min(sorted(level[region]), key=lambda k: draw(f"{region}/{k}", w(level[region][k])) if len(level[region]) > 1 else 0)
    leaves = level[region][rack]
    return min(leaves, key=lambda x: draw(f"{region}/{rack}/{x.shard}", x.weight) if len(leaves) > 1 else 0).shard


def test_sharding_against_brute_force(spark):
    texts = [None, "", "long " * 200_000, *["é" * (i % 9) for i in range(3000)]]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["r"] * 3))
    rows = sharding.placed(docs).collect()
    assert len(rows) == len(texts) + 3
    tree, more = sharding.PRODUCTION_TREE, sharding.grown(sharding.PRODUCTION_TREE)
    for r in rows:
        assert r.shard == brute_shard(r.doc_id, tree) and r.grown_shard == brute_shard(r.doc_id, more)
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = Counter(r.shard for r in rows)
    assert min(sizes.values()) > 0.8 * len(rows) / 8 and 0.07 < sum(r.grown_shard == 8 for r in rows) / len(rows) < 0.15
    by_id = {r.doc_id: r for r in rows if r.doc_id > 2}
    assert all((by_id[i].size, by_id[i].text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts) if i > 2)
    assert sharding.placed(docs.limit(0)).count() == 0
    assert sharding.assign(docs).columns == docs.columns


def test_weight_change_moves_rows_only_into_or_out_of_its_subtree(spark):
    tree = sharding.PRODUCTION_TREE
    heavier = tuple(sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 2 else 1.0) for x in tree)
    ids = spark.range(4000).withColumn("doc_id", F.col("id"))
    moved = ids.select(sharding.shard_of(F.col("doc_id"), tree).alias("a"), sharding.shard_of(F.col("doc_id"), heavier).alias("b")).where("a <> b").collect()
    assert moved and all(r.b in (2, 3) or (r.a // 2 == r.b // 2) or r.b // 4 == 0 for r in moved)
    assert not any(r.a // 4 == 1 and r.b // 4 == 1 for r in moved)


def test_numbering_is_gapless_and_independent_of_chunks(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), "id")
    runs = []
    for size in (10, 50_000):
        monkeypatch.setattr(ranking, "CHUNK_ROWS", size)
        runs.append(sorted((r.id, r.n) for r in ranking.numbered(df, "g", F.col("id"), [], "n").collect()))
    assert runs[0] == runs[1]

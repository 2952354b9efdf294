"""The ``opN_*`` queries: thin digests of the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import (
    decontam,
    langid,
    mixing,
    packing,
    pivots,
    repair,
    sharding,
    simhash,
    tokencount,
    toxicity,
    urlrules,
    vafile,
    warc,
)
from lumenlake.llm.common import table

#: Of the public tokenizer whose pieces op9 counts; the environment's folder of vocabulary files.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

#: Of the public tokenizer by which op11 counts and cuts; looked up by name, as its folder may differ between machines.
BYTE_BPE = "byte_bpe_50k.json"

#: (host, path, verdict)
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pivot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.linked_vectors(table(spark, sf_dir, "embeddings"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark, URL_RULES))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(
        table(spark, sf_dir, "documents"), simhash.SimHashParams(shingle_words=4, radius=4)
    )
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(
        table(spark, sf_dir, "documents"), tokencount.Vocabulary.from_sentencepiece(PIECES)
    )


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"))


def op11_bound_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op12_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = vafile.compressed(table(spark, sf_dir, "embeddings"))
    return vafile.with_label_errors(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summaries(repair.repaired(repair.damaged(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_toxicity, op2_pivot_vectors, op3_warc_revisits, op4_url_rules, op5_decontamination,
        op6_pfair_mix, op7_simhash, op8_language_id, op9_token_counts, op10_hash_tree_shards,
        op11_bound_packing, op12_va_codes, op13_turn_repair,
    )  # fmt: skip
    return {f.__name__: f for f in every}


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x,
         embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda e: e IS NULL OR NOT isfinite(e))) = 0
         AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda e: e <> 0)) > 0 AS ok
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
low AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON v.vec_id = low.node LEFT JOIN n ON n.a = v.vec_id
"""

OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP4_SQL = """
WITH r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (
  SELECT k.*, r.rh || r.rp AS rule, r.rv,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rh || r.rp) DESC NULLS LAST) AS n
  FROM k LEFT JOIN r ON (k.host = r.rh OR ends_with(k.host, '.' || r.rh)) AND starts_with(k.path, r.rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE n = 1
"""

OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids
  FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE c AS (SELECT source, count(*) AS n, pow(count(*), 0.7) AS w FROM documents GROUP BY source),
e AS (SELECT *, w / sum(w) OVER () * 500 AS exact FROM c),
f AS (SELECT *, greatest(1, CAST(floor(exact) AS BIGINT)) AS fl FROM e),
g AS (SELECT *, 500 - sum(fl) OVER () AS over_, row_number() OVER (ORDER BY exact - floor(exact) DESC, source NULLS FIRST) AS rk,
        row_number() OVER (ORDER BY fl DESC, source NULLS FIRST) AS bs FROM f),
s AS (SELECT source, n, CAST(fl + CASE WHEN rk <= over_ THEN 1 ELSE 0 END + CASE WHEN over_ < 0 AND bs = 1 THEN over_ ELSE 0 END AS BIGINT) AS b,
        row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM g),
l AS (SELECT list(b ORDER BY i) AS bs FROM s),
step AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(bs, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, bs FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, j: CASE WHEN j = p THEN d + 1 ELSE d END), p, bs FROM (
    SELECT t, done, bs, list_min(list_filter(list_transform(range(1, len(bs) + 1), lambda i: {'due': CAST(ceil((done[i] + 1) * 500 / bs[i]) AS BIGINT), 'i': CAST(i AS BIGINT),
      'ready': floor(done[i] * 500 / bs[i]) <= t + 1 AND done[i] < bs[i]}), lambda x: x.ready)).i AS p FROM step WHERE t < 499)),
pat AS (SELECT pick AS i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM step WHERE t >= 0),
ends AS (SELECT s.*, (CAST(ceil(n / 16.0) - 1 AS BIGINT) // b) * 500 + pat.slot AS final FROM s JOIN pat ON pat.i = s.i AND pat.k = CAST(ceil(n / 16.0) - 1 AS BIGINT) % s.b),
fin AS (SELECT CAST(max(final) AS BIGINT) AS final FROM ends),
r AS (SELECT doc_id, d.source, s.n, s.b, s.i, row_number() OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS rank
      FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
x AS (SELECT r.*, final, unnest(range(0, CAST(floor(((final // 500 + 1) * b * 16 - 1) / n) AS BIGINT) + 1)) AS epoch FROM r, fin),
y AS (SELECT *, (epoch * n + rank) // 16 AS block, CAST((epoch * n + rank) % 16 AS INT) AS place FROM x)
SELECT doc_id, source, epoch, block, place, block // b * 500 + pat.slot AS slot,
       CAST(block // b * 500 + floor(pat.k * 500 / b) AS BIGINT) AS release, CAST(block // b * 500 + ceil((pat.k + 1) * 500 / b) AS BIGINT) AS deadline
FROM y JOIN pat ON pat.i = y.i AND pat.k = block % b WHERE block // b * 500 + pat.slot <= final
"""


def _draw_sql(name: str, weight: float) -> str:
    return f"-ln((CAST('0x' || substr(md5('{name}/' || k), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) / {weight:.1f}::DOUBLE"


def _tree_sql(tree) -> str:
    """The shard of a key, as SQL: at each level the child of the smallest draw."""
    regions: dict = {}
    for x in tree:
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)

    def choose(children):
        if len(children) == 1:
            return children[0][2]
        rows = ", ".join(f"{{'d': {_draw_sql(n, w)}, 's': {v}}}" for n, w, v in children)
        return f"list_min([{rows}]).s"

    of_region = []
    for region, racks in sorted(regions.items()):
        of_rack = []
        for rack, leaves in sorted(racks.items()):
            shards = [(f"{region}/{rack}/{x.shard}", x.weight, str(x.shard)) for x in leaves]
            of_rack.append((f"{region}/{rack}", sum(x.weight for x in leaves), choose(shards)))
        of_region.append((region, sum(x.weight for r in racks.values() for x in r), choose(of_rack)))
    return choose(of_region)


OP10_SQL = f"""
WITH t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
b AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, size,
  xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, crc[(xor(c, x) % 256) + 1])), 4294967295) AS text_crc32 FROM b, t),
s AS (SELECT *, CAST({_tree_sql(sharding.PRODUCTION_TREE)} AS INT) AS shard,
  CAST({_tree_sql(sharding.grown(sharding.PRODUCTION_TREE))} AS INT) AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(k), size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard FROM s
"""


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after another; a codebook is a list of entries by part."""
    apart = "list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - b[e][i]) * (p[i] - b[e][i])))"

    def assigned(n: int) -> str:
        near = f"list_transform(range(1, len(b) + 1), lambda e: {{'d': {apart}, 'e': e}})"
        return f"a{n} AS MATERIALIZED (SELECT vec_id, part, p, list_min({near}) AS m FROM parts JOIN b{n} USING (part))"

    def improved(n: int) -> str:
        mean = "list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i)"
        return f"""
u{n} AS (SELECT part, e, {mean} AS c FROM (
  SELECT part, m.e AS e, i, sum(p[i]) AS s, count(*) AS n FROM a{n - 1}, (SELECT unnest(range(1, 1000)) AS i) WHERE i <= len(p) GROUP BY ALL) GROUP BY part, e),
b{n} AS MATERIALIZED (
  SELECT part, list(coalesce(c, b[e]) ORDER BY e) AS b FROM (SELECT part, b, unnest(range(1, len(b) + 1)) AS e FROM b{n - 1}) LEFT JOIN u{n} USING (part, e) GROUP BY part)"""

    steps = ", ".join(f"{improved(n)}, {assigned(n)}" for n in range(1, rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 4096) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, q[part * len(q) // {parts} + 1:(part + 1) * len(q) // {parts}] AS p FROM kept, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (
  SELECT part, list(p ORDER BY vec_id) AS b FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}) GROUP BY part),
{assigned(0)}, {steps},
codes AS (SELECT vec_id, string_agg(printf('%02x', m.e - 1), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(flatten(b), ','), ',' ORDER BY part)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), digest
"""


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(
    regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM conversations),
harm AS (SELECT conv_id, turn, role, text,
  xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, crc[(xor(c, x) % 256) + 1])), 4294967295) % 20 AS k FROM h, t),
rows_ AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM harm, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) WHERE k <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_),
f AS MATERIALIZED (
  SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
-- per conversation and row: the cheapest edits so far that end in each grammar state (0 nothing, 1 after s, 2 after u, 3 after a)
step AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': '', 't': ''} AS s0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s1,
         {'c': 5, 'a': 'I', 't': E'user:'} AS s2, {'c': 10, 'a': 'II', 't': E'user:
assistant:'} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, list_min(list_filter([s3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || E'
assistant:'}], lambda x: x IS NOT NULL AND x.c IS NOT NULL)) FROM (
    SELECT conv_id, i, s0, s1, s3, list_min(list_filter([s2, {'c': s0.c + 5, 'a': s0.a || 'I', 't': 'user:'}, {'c': s1.c + 5, 'a': s1.a || 'I', 't': s1.t || E'
user:'},
      {'c': s3.c + 5, 'a': s3.a || 'I', 't': s3.t || E'
user:'}], lambda x: x IS NOT NULL AND x.c IS NOT NULL)) AS s2 FROM (
      SELECT step.conv_id, f.i, {'c': s0.c + 2, 'a': s0.a || 'D', 't': ''} AS s0,
        list_min(list_filter([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t}, CASE WHEN ok AND r = 's' THEN {'c': s0.c + cut, 'a': s0.a || 'K', 't': line} END], lambda x: x IS NOT NULL AND x.c IS NOT NULL)) AS s1,
        list_min(list_filter([{'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t},
          CASE WHEN ok AND r = 'u' THEN {'c': s0.c + cut, 'a': s0.a || 'K', 't': line} END, CASE WHEN ok AND r = 'u' THEN {'c': s1.c + cut, 'a': s1.a || 'K', 't': s1.t || E'
' || line} END,
          CASE WHEN ok AND r = 'u' THEN {'c': s3.c + cut, 'a': s3.a || 'K', 't': s3.t || E'
' || line} END, CASE WHEN ok THEN {'c': s0.c + cut + 1, 'a': s0.a || 'R', 't': 'user:' || text} END,
          CASE WHEN ok THEN {'c': s1.c + cut + 1, 'a': s1.a || 'R', 't': s1.t || E'
user:' || text} END, CASE WHEN ok THEN {'c': s3.c + cut + 1, 'a': s3.a || 'R', 't': s3.t || E'
user:' || text} END],
          lambda x: x IS NOT NULL AND x.c IS NOT NULL)) AS s2,
        list_min(list_filter([{'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t}, CASE WHEN ok AND r = 'a' THEN {'c': s2.c + cut, 'a': s2.a || 'K', 't': s2.t || E'
' || line} END,
          CASE WHEN ok THEN {'c': s2.c + cut + 1, 'a': s2.a || 'R', 't': s2.t || E'
assistant:' || text} END], lambda x: x IS NOT NULL AND x.c IS NOT NULL)) AS s3
      FROM step JOIN (SELECT *, fault NOT IN ('b', 'd') AS ok, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS cut, role || ':' || text AS line FROM f) f
        ON f.conv_id IS NOT DISTINCT FROM step.conv_id AND f.i = step.i + 1))),
last AS (SELECT conv_id, list_min(list_filter([s0, s3], lambda x: x.c IS NOT NULL)) AS s FROM step QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
SELECT last.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(s.c AS BIGINT) AS cost, s.a AS audit, sha256(s.t) AS repaired_sha256
FROM last LEFT JOIN figures ON last.conv_id IS NOT DISTINCT FROM figures.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; the others are tested against brute force."""
    return {
        "op2_pivot_vectors": OP2_SQL,
        "op3_warc_revisits": OP3_SQL,
        "op4_url_rules": OP4_SQL,
        "op5_decontamination": OP5_SQL,
        "op6_pfair_mix": OP6_SQL,
        "op10_hash_tree_shards": OP10_SQL,
        "op12_va_codes": _op12_sql(),
        "op13_turn_repair": OP13_SQL,
    }

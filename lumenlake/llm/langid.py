"""Language identification by Bayesian evidence fusion.

A page's posterior over languages multiplies
 - the likelihood of its text under hashed character trigrams, trained on labelled documents and
   tempered, as neighbouring trigrams are not independent;
 - the likelihood of the language that its markup declares, from a confusion table;
 - a prior of its host, smoothed towards its domain's, the domain's towards the address
   suffix's, and the suffix's towards the whole corpus'.
The tables of the last two are soft counts of the text posteriors, by grouped aggregation over all
pages; a page's own count is taken out of the ones that it meets again.

Edge cases: null and empty html have an even text likelihood, so that declared language and host
decide; null urls and urls without ``://`` belong to one empty host; a missing declaration is a
declaration of its own; pages of any length are read whole; of languages with equal posteriors the
first by name wins; repeated rows are rows; an empty table gives an empty result; further
columns are not read.  Without any training row no language is known: lang, text_lang and probability are null.
"""

from __future__ import annotations

import html as html_entities
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import ascii_lower, joined_hot, written
from lumenlake.plans.scratch import discard, materialised_at

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
HIDDEN = re.compile(r"(?i)<(?:(script)|(style)|(nav))\b")
CLOSERS = tuple(re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "nav"))
ROOT = re.compile(r"(?i)<html\b")
DECLARED = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})")


@dataclass(frozen=True)
class LanguageParams:
    buckets_log2: int = 15  # hash cells of the trigram table
    sample_per_language: int = 1_000  # labelled documents of each language that train it
    sample_text_bytes: int = 32_768  # longer documents don't train
    temper: float = 0.05  # weight of a trigram's log likelihood
    most_evidence: float = 12.0  # log likelihood range that text may contribute
    pull: float = 5.0  # pseudo pages by which a level is smoothed towards the one above
    block_languages: int = 64  # whose table is held at a time


def trigram_cells(text: str, log2: int) -> np.ndarray:
    folded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    code = np.frombuffer(folded.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(code) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = (code[:-2] << np.uint64(42)) ^ (code[1:-1] << np.uint64(21)) ^ code[2:]
    return ((mixed * MULTIPLIER) >> np.uint64(64 - log2)).astype(np.int64)


def visible_text(page: str) -> str:
    """The page without comments, scripts, styles, navigation and tags; what isn't closed is text.

    One forward scan: a closing mark that isn't found once isn't looked for again, so a page of open marks
    takes no longer than any other.
    """
    out, at = [], 0
    gone = [False] * (len(CLOSERS) + 1)  # closing marks of hidden elements and of comments that aren't ahead any more
    while (start := page.find("<", at)) >= 0:
        end = -1
        if not gone[-1] and page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            gone[-1], end = close < 0, close + 3 if close >= 0 else -1
        elif opened := HIDDEN.match(page, start):
            which = opened.lastindex - 1
            if not gone[which]:
                close = CLOSERS[which].search(page, opened.end())
                gone[which], end = close is None, close.end() if close else -1
        if end < 0:
            end = page.find(">", start) + 1
            if not end:
                break  # no tag is closed from here on
        out += [page[at:start], " "]
        at = end
    return html_entities.unescape("".join([*out, page[at:]]))


def declared_language(page: str) -> str:
    """The language of the first html tag that names one; each part of the page is looked at once."""
    at = 0
    while tag := ROOT.search(page, at):
        end = page.find(">", tag.end())
        found = DECLARED.search(page, tag.end(), end if end >= 0 else len(page))
        if found:
            return found[1].lower()
        if end < 0:
            break
        at = end
    return ""


def languages(docs: DataFrame) -> list[str]:
    """The languages of labelled documents, by name."""
    return sorted(r.lang for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang").distinct().collect())


def train(docs: DataFrame, params: LanguageParams, langs: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (all, or those given) and their log probabilities by trigram cell, from a bounded sample by hash of id."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    langs = languages(docs) if langs is None else langs
    log2 = params.buckets_log2
    counts = np.zeros((len(langs), 1 << log2))
    ids = [
        labelled.where((F.col("lang") == lang) & (F.octet_length("text") <= params.sample_text_bytes) & F.col("doc_id").isNotNull())
        .select("doc_id", F.lit(i).alias("_class"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(params.sample_per_language)
        for i, lang in enumerate(langs)
    ]
    if not ids:
        return langs, counts
    chosen = F.broadcast(reduce(DataFrame.unionByName, ids).distinct())  # at most languages x sample_per_language
    rows = labelled.select("doc_id", "text").join(chosen, "doc_id").select("_class", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seen = np.zeros((len(langs), 1 << log2), dtype=np.int64)
            for which, text in zip(batch.column("_class").to_pylist(), batch.column("text").to_pylist()):
                seen[which] += np.bincount(trigram_cells(text, log2), minlength=1 << log2)
            which, cell = np.nonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(cell), pa.array(seen[which, cell])], ["_class", "cell", "n"])

    sums = rows.mapInArrow(run, "_class long, cell long, n long").groupBy("_class", "cell").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():  # at most languages x cells rows
        counts[r["_class"], r["cell"]] = r["n"]
    smoothed = counts + 0.1
    return langs, np.log(smoothed / smoothed.sum(axis=1, keepdims=True))


def likelihoods(text: str, table: np.ndarray, params: LanguageParams) -> np.ndarray:
    """Tempered log likelihood of each language of a table."""
    return table[:, trigram_cells(text, params.buckets_log2)].sum(axis=1) * params.temper


def clipped(ll: np.ndarray, params: LanguageParams) -> np.ndarray:
    """The best at 0 and none below -most_evidence."""
    return np.maximum(ll - ll.max(), -params.most_evidence) if len(ll) else ll


def text_evidence(text: str, table: np.ndarray, params: LanguageParams) -> np.ndarray:
    return clipped(likelihoods(text, table, params), params)


def evidence(pages: DataFrame, docs: DataFrame, langs: list[str], params: LanguageParams) -> DataFrame:
    """(page_id, host, domain, suffix, declared, ll, soft) per page; ll and soft follow ``langs``.

    Languages are taken ``block_languages`` at a time: a pass over the pages for each block's table.
    """
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    host = ascii_lower(
        F.regexp_extract(F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise(F.lit("")), "^[^/?#:]*", 0)
    )
    rows = pages.select(
        "page_id",
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
        F.substring_index(host, ".", -1).alias("suffix"),
        "html",
        F.array().cast("array<double>").alias("ll"),
    )
    kind = dict(rows.dtypes)["page_id"]
    head = f"page_id {kind}, host string, domain string, suffix string"
    blocks = [langs[i : i + params.block_languages] for i in range(0, len(langs), params.block_languages)] or [[]]
    spark, path = pages.sparkSession, None
    for n, block in enumerate(blocks):
        table = train(docs, params, block)[1]
        shared = spark.sparkContext.broadcast(table)  # block_languages x cells doubles
        if n < len(blocks) - 1:
            done, next_path = materialised_at(rows.mapInArrow(_more_evidence(shared, params), f"{head}, html string, ll array<double>"), "evidence")
            if path is not None:
                discard(spark, path)
            rows, path = done, next_path
    return rows.mapInArrow(_all_evidence(shared, params), f"{head}, declared string, ll array<double>, soft array<double>")


def _more_evidence(shared, params: LanguageParams):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = (visible_text(t.as_py() or "") for t in batch.column("html"))
            lls = [[*old, *likelihoods(text, shared.value, params).tolist()] for old, text in zip(batch.column("ll").to_pylist(), texts)]
            at = batch.schema.get_field_index("ll")
            yield pa.RecordBatch.from_arrays([pa.array(lls, pa.list_(pa.float64())) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return run


def _all_evidence(shared, params: LanguageParams):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            declared, lls, softs = [], [], []
            for t, old in zip(batch.column("html"), batch.column("ll").to_pylist()):
                page = t.as_py() or ""
                ll = clipped(np.array([*old, *likelihoods(visible_text(page), shared.value, params)]), params)
                soft = np.exp(ll)
                declared.append(declared_language(page))
                lls.append(ll.tolist())
                softs.append((soft / soft.sum()).tolist() if len(soft) else [])
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "domain", "suffix")), pa.array(declared, pa.string()), pa.array(lls, doubles), pa.array(softs, doubles)],
                ["page_id", "host", "domain", "suffix", "declared", "ll", "soft"],
            )

    return run


def soft_counts(scored: DataFrame, by: list[str], langs: list[str], prefix: str) -> DataFrame:
    sums = [F.sum(F.get("soft", F.lit(i))) for i in range(len(langs))]
    return scored.groupBy(by).agg(F.array(*sums).alias(f"{prefix}_c"))


def identify(pages: DataFrame, docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) per row of ``pages``."""
    langs = languages(docs)
    scored = evidence(pages, docs, langs, params)
    if not langs:
        return scored.select(
            "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
            F.lit(None).cast("string").alias("text_lang"), "declared", "host",
        )
    scored = written(scored, "langid")
    k, pull = len(langs), params.pull
    hosts = soft_counts(scored, ["suffix", "domain", "host"], langs, "host")
    add = lambda col: F.array(*[F.sum(F.get(col, F.lit(i))) for i in range(k)])
    domains = hosts.groupBy("suffix", "domain").agg(add("host_c").alias("domain_c"))
    suffixes = domains.groupBy("suffix").agg(add("domain_c").alias("suffix_c"))
    total = [c or 0.0 for c in suffixes.agg(add("suffix_c").alias("c")).first()["c"]]
    whole = sum(total) + k
    overall = F.array(*[F.lit((c + 1.0) / whole) for c in total])
    confusion = soft_counts(scored, ["declared"], langs, "declared")  # codes of two or three letters
    # a suffix may hold a third of all hosts and a host a third of all pages: such keys aren't shuffled
    hosts = written(hosts, "hosts")
    named = joined_hot(joined_hot(hosts, domains, ["suffix", "domain"], "inner"), suffixes, ["suffix"], "inner")
    levels = named.select("host", "host_c", "domain_c", "suffix_c")
    joined = joined_hot(scored, levels, ["host"], "inner").join(F.broadcast(confusion), "declared")  # 26^2 + 26^3 + 1 codes at most

    def smoothed(counts: str, parent):
        """Own counts without this page's, pulled towards the level above."""
        own = F.zip_with(counts, "soft", lambda c, s: F.greatest(c - s, F.lit(0.0)))
        n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, parent, lambda c, p: (c + F.lit(pull) * p) / (n + F.lit(pull)))

    declared_own = F.zip_with("declared_c", "soft", lambda c, s: F.greatest(c - s, F.lit(0.0)))
    likelihood = F.zip_with(declared_own, overall, lambda c, p: (c + F.lit(1.0)) / (p * F.lit(whole) + F.lit(2.0)))
    posed = (
        joined.withColumn("_suffix", smoothed("suffix_c", overall))
        .withColumn("_domain", smoothed("domain_c", F.col("_suffix")))
        .withColumn("_host", smoothed("host_c", F.col("_domain")))
        .withColumn("_declared", likelihood)
        .withColumn("_log", F.zip_with(
            F.zip_with("ll", "_host", lambda a, p: a + F.ln(p)), "_declared", lambda a, p: a + F.ln(p)))
        .withColumn("_top", F.array_max("_log"))
        .withColumn("_sum", F.aggregate("_log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top"))))
    )
    names = F.array(*[F.lit(x) for x in langs])
    return posed.select(
        "page_id",
        F.get(names, (F.array_position("_log", F.col("_top")) - 1).cast("int")).alias("lang"),
        (F.lit(1.0) / F.col("_sum")).alias("probability"),
        F.get(names, (F.array_position("ll", F.array_max("ll")) - 1).cast("int")).alias("text_lang"),
        "declared",
        "host",
    )

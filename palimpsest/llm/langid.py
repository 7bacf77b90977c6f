"""Language identification by Bayesian fusion of evidence.

log posterior = log prior of the host + log likelihood of the declared language
+ log likelihood of the address suffix + log likelihood of the text, by language.

* Text: naive Bayes over hashed byte trigrams.  The languages are the declared
  values that hold at least ``LEAST_ROWS`` declared rows or, in small tables, at
  least ``SHARE`` of them; the trigrams are
  counted on about ``FIT_ROWS`` whole texts of each, picked by a hash.
* What texts alone are held to be is then counted by grouped sums over all rows:
  by (declared, language), (suffix, language) and (host, language).
* Host priors are smoothed through a hierarchy: a host's counts are joined by
  ``WEIGHT`` rows that follow its domain, whose counts are joined by as many that
  follow all rows.
* A host's own rows say what its suffix says, so the suffix counts in full where
  the host has no rows, and for ``WEIGHT`` / (rows + ``WEIGHT``) where it has some.

A row without a letter in its text has no language ("und") and is rejected; so
is one whose best posterior is below ``LEAST``.  Null text is empty; null declared
values, suffixes and hosts are no evidence.  Ties go to the first language in
alphabetical order.  Rows are judged one by one, so repeated rows agree.  Very long
texts are scored whole, in runs of at least one text.  An empty table, or one
without declared values, gives "und" throughout.  Extra columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytewords import LOWER, chunked, sums
from palimpsest.llm.common import bounded_batches, give_back, stored

BUCKETS = 1 << 14
LEAST_ROWS = 30
SHARE = 0.002
FIT_ROWS = 3_000
WEIGHT = 20.0
LEAST = 0.5
#: Trigrams overlap, so each counts for less than a trigram of its own.
TEMPER = 0.4

_FOLD = LOWER.copy()
_FOLD[:0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 0x20


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that starts at each byte, -1 for none, and each document's first."""
    d = _FOLD[data].astype(np.uint32)
    n = len(d)
    out = np.full(n, -1, np.int32)
    if n > 2:
        key = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
        slot = (key * np.uint32(2654435761)) >> np.uint32(32 - 14)
        letter = (d != 0x20).astype(np.uint8)
        out[:-2] = np.where(letter[:-2] + letter[1:-1] + letter[2:] >= 2, slot, -1)
    ends = np.unique(np.concatenate([offsets[1:] - 1, offsets[1:] - 2]))
    out[ends[ends >= 0]] = -1
    # a document's last two bytes start no trigram; shorter documents have none
    return out, offsets


def _counter(batches):
    for batch in batches:
        for row, end, data, offsets in chunked(batch.column(1)):
            slot, first = trigrams(data, offsets)
            language = np.array(batch.column(0).slice(row, end - row).to_pylist(), object)
            doc = np.repeat(np.arange(end - row), np.diff(first))
            for name in sorted(set(language)):
                own = slot[(language == name)[doc] & (slot >= 0)]
                count = np.bincount(own, minlength=BUCKETS)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(count[some])], names=["language", "bucket", "n"])


class Model:
    """log probabilities of trigrams by language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood by document and language, trigrams with letters by document)."""
        slot, first = trigrams(data, offsets)
        some = slot >= 0
        count = sums(some.astype(np.int64), first, np.int64)
        out = np.zeros((len(first) - 1, len(self.languages)))
        kept, where = slot[some], np.concatenate([[0], np.cumsum(count)])
        for j in range(len(self.languages)):
            out[:, j] = sums(self.table[j][kept], where) * TEMPER
        return out, count


def train(evidence: DataFrame) -> Model:
    """A model of the declared languages of ``evidence`` (text, declared)."""
    declared = evidence.filter("declared is not null")
    total = declared.count()
    counts = {r[0]: r[1] for r in declared.groupBy("declared").count().filter(F.col("count") >= min(LEAST_ROWS, SHARE * total)).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(max(1, counts[k] // FIT_ROWS)))])[F.col("declared")]
    picked = declared.filter(F.col("declared").isin(languages)).filter(F.expr("xxhash64(text, 5)") % share == 0)
    rows = picked.select("declared", "text").mapInArrow(_counter, "language string, bucket bigint, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), BUCKETS), 0.5)
    place = {k: i for i, k in enumerate(languages)}
    np.add.at(table, ([place[x] for x in rows["language"].to_pylist()], rows["bucket"].to_numpy()), rows["n"].to_numpy())
    return Model(languages, np.log(table / table.sum(1, keepdims=True)))


def _scorer(shared, place: int, schema):
    def run(batches):
        model = shared.value
        for batch in batches:
            for row, end, data, offsets in chunked(batch.column(place)):
                score, count = model.scores(data, offsets)
                kept = [batch.column(i).slice(row, end - row) for i in range(batch.num_columns) if i not in schema]
                width = score.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(end - row + 1, dtype=np.int32) * width), pa.array(score.reshape(-1)))
                names = [n for i, n in enumerate(batch.schema.names) if i not in schema]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(count)], names=[*names, "text_score", "trigrams"])
        give_back()

    return run


def _scored(rows: DataFrame, model: Model, keep_text: bool) -> DataFrame:
    """``rows`` with text_score (by language) and trigrams; without text if it is not kept."""
    place = rows.columns.index("text")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for i, f in enumerate(rows.schema) if keep_text or i != place]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text_score array<double>, trigrams bigint"])
    return rows.mapInArrow(_scorer(shared, place, () if keep_text else (place,)), kind)


def _best(scores, languages: list[str]):
    """The language of the largest score; the first of equal ones."""
    return F.element_at(F.array(*map(F.lit, languages)), F.array_position(scores, F.array_max(scores)).cast("int"))


def _table(rows: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """Counts of text languages by ``key``: (key, counts in the order of ``languages``)."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum((F.col("text_lang") == name).cast("double")) for name in languages]).alias("counts"))


def fuse(rows: DataFrame, counted: DataFrame, languages: list[str]) -> DataFrame:
    """``rows`` (text_score, trigrams, declared, suffix, domain, host ...) with lang_found, text_lang, confidence and rejected.

    ``counted`` are the rows whose text languages make up priors and likelihoods.
    """
    if not languages:
        return rows.select("*", F.lit("und").alias("lang_found"), F.lit("und").alias("text_lang"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"))
    every = F.array(*map(F.lit, languages))
    counted = counted.withColumn("text_lang", F.when(F.col("trigrams") > 0, _best(F.col("text_score"), languages))).filter("text_lang is not null")
    whole = counted.agg(*[F.coalesce(F.sum((F.col("text_lang") == name).cast("double")), F.lit(0.0)) for name in languages]).first()
    total = sum(whole)
    base = [(n + 1) / (total + len(languages)) for n in whole]
    prior = F.array(*map(F.lit, base))
    smooth = lambda counts, parent: F.zip_with(counts, parent, lambda n, p: n + WEIGHT * p)
    share = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    nothing = F.transform(every, lambda _: F.lit(0.0))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    hosts = counted.filter("host is not null").groupBy("host", "domain").agg(F.array(*[F.sum((F.col("text_lang") == name).cast("double")) for name in languages]).alias("counts"))
    domains = _table(counted, "domain", languages).select("domain", share(smooth(F.col("counts"), prior)).alias("domain_prior"))
    hosts = hosts.join(domains, "domain", "left")
    rows_of = F.aggregate("counts", F.lit(0.0), lambda s, x: s + x)
    hosts = stored(hosts.select(F.col("host").alias("prior_host"), share(smooth(F.col("counts"), F.coalesce("domain_prior", prior))).alias("host_prior"), rows_of.alias("host_rows")))
    # written tables, so that Spark knows their sizes: small ones are broadcast, others joined by key
    # likelihoods of a declared value and a suffix under each language, with one more row spread over unseen values
    given = lambda key, out: stored(_table(counted, key, languages).select(F.col(key).alias(f"given_{key}"), F.zip_with("counts", F.array(*map(F.lit, whole)), lambda n, t: F.log((n + 0.01) / (t + 1))).alias(out)))
    rows = rows.join(hosts, F.col("host") == F.col("prior_host"), "left").join(given("declared", "declared_score"), F.col("declared") == F.col("given_declared"), "left").join(given("suffix", "suffix_score"), F.col("suffix") == F.col("given_suffix"), "left")
    part = F.lit(WEIGHT) / (F.coalesce("host_rows", F.lit(0.0)) + WEIGHT)
    suffix = F.transform(F.coalesce("suffix_score", nothing), lambda x: x * part)
    fused = add(add(add("text_score", F.coalesce("declared_score", nothing)), suffix), F.transform(F.coalesce("host_prior", prior), lambda p: F.log(p)))
    rows = rows.withColumn("fused", fused).withColumn("high", F.array_max("fused"))
    confidence = 1 / F.aggregate(F.transform("fused", lambda x: F.exp(x - F.col("high"))), F.lit(0.0), lambda s, x: s + x)
    found = F.when(F.col("trigrams") > 0, _best(F.col("fused"), languages)).otherwise("und")
    text = F.when(F.col("trigrams") > 0, _best(F.col("text_score"), languages)).otherwise("und")
    rows = rows.withColumns({"lang_found": found, "text_lang": text, "confidence": F.when(F.col("trigrams") > 0, confidence).otherwise(0.0)})
    rows = rows.withColumn("rejected", (F.col("trigrams") == 0) | (F.col("confidence") < LEAST))
    return rows.drop("prior_host", "host_prior", "host_rows", "given_declared", "declared_score", "given_suffix", "suffix_score", "fused", "high")


def evidence(rows: DataFrame, text: str, declared: str | None, host: str | None, *keep) -> DataFrame:
    """(kept columns, text, declared, host, domain, suffix) from columns of ``rows``; declared is the primary subtag."""
    bounded_batches(rows.sparkSession)
    tag = F.lower(F.trim(F.col(declared).cast("string"))) if declared else F.lit(None).cast("string")
    name = F.lower(F.col(host).cast("string")) if host else F.lit(None).cast("string")
    labels = F.split(name, r"\.")
    dotted = F.size(labels) > 1
    return rows.select(
        *keep,
        F.col(text).cast("string").alias("text"),
        F.nullif(F.regexp_extract(tag, "^[a-z]+", 0), F.lit("")).alias("declared"),
        F.nullif(name, F.lit("")).alias("host"),
        F.when(dotted, F.array_join(F.slice(labels, -2, 2), ".")).alias("domain"),
        F.when(dotted, F.element_at(labels, -1)).alias("suffix"),
    )


def page_evidence(pages: DataFrame, *keep) -> DataFrame:
    """Evidence of raw pages (url, html): text between tags, the root element's lang, the address's host."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    marked = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    names = [pages.select(k).columns[0] for k in keep]
    made = pages.select(*keep, text.alias("page_text"), marked.alias("page_lang"), host.alias("page_host"))
    return evidence(made, "page_text", "page_lang", "page_host", *names)


def identify(rows: DataFrame) -> DataFrame:
    """Rows of ``evidence`` with lang_found, text_lang, confidence, rejected, without their texts."""
    model = train(rows)
    scored = stored(_scored(rows, model, keep_text=False))
    return fuse(scored, scored, model.languages)


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang, source ...) without the rejected rows; lang becomes the language found."""
    # other columns are set aside under names that nothing here has
    aside = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "lang")}
    rows = evidence(docs, "text", "lang", "source", *[F.col(f"`{c}`").alias(k) for c, k in aside.items()])
    model = train(rows)
    # texts are scored once: what priors are counted on is read from the written rows
    scored = stored(_scored(rows, model, keep_text=True))
    kept = fuse(scored, scored.select("text_score", "trigrams", "declared", "host", "domain", "suffix"), model.languages).filter(~F.col("rejected"))
    return kept.select(*[F.col("lang_found").alias(c) if c == "lang" else F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(evidence(docs, "text", "lang", "source", F.col("doc_id").cast("bigint").alias("doc_id")))
    return found.select("doc_id", "declared", "host", "lang_found", "text_lang", "confidence", "rejected")


def pages_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = identify(page_evidence(pages, F.col("page_id").cast("bigint").alias("page_id")))
    return found.select("page_id", "declared", "host", "suffix", "lang_found", "text_lang", "confidence", "rejected")

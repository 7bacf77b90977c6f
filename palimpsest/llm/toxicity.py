"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words is trained in numpy on confirmed
toxic texts (P) and unlabelled ones (U).  With class prior p and logistic loss,
the risk is p R+(P) + max(0, R-(U) - p R-(P)): unlabelled text counts as harmless,
less the share of toxic text in it, and never below zero (Kiryo et al., 2017).
When the second term is negative, a step goes against it.

Only the fit is bounded: at most about ``FIT_POSITIVE`` and ``FIT_UNLABELLED``
texts, picked by a hash of their ids from all rows of the training folds; the
prior is the share of label 1 among the labelled rows of these folds.  Every text
is scored in full.  Labels, language, source and id are no inputs of a score.

Words are runs of ASCII digits, letters (lower-cased) and non-ASCII characters,
told apart by 64-bit hashes.  A null or empty text has no words and gets the
intercept's score.  Without a positive example all scores are 0.  Of several
labels of an id the largest counts.  Repeated rows are scored one by one, and very
long texts whole.  An empty table gives an empty result.  Extra columns are left out
at the scan, whatever their names.  All words of the samples whose shares differ by
``LEAST_Z`` standard errors are features; there is no cap on them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytewords import ALNUM, Words, chunked, sums
from palimpsest.llm.common import only

FIT_POSITIVE = 4_000
FIT_UNLABELLED = 12_000
#: Standard errors by which a word's shares in the two samples differ at least, and texts of them it is in.
LEAST_Z = 4.0
LEAST_TEXTS = 3
FOLDS, HELD = 4, 2
THRESHOLD = 0.3


def _fold(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS


def _presence(batches):
    for batch in batches:
        for row, end, data, offsets in chunked(batch.column(0)):
            words = Words(data, offsets, ALNUM)
            pair = np.stack([words.doc().astype(np.uint64), words.hashes()], 1)
            pair = np.unique(pair, axis=0) if len(pair) else pair
            first = np.searchsorted(pair[:, 0], np.arange(end - row + 1).astype(np.uint64))
            raw = np.ascontiguousarray(pair[:, 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(row, end - row), pa.array([raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                names=["positive", "words"],
            )


class Model:
    """Weights of word hashes, sorted, and the intercept."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, intercept: float | None):
        self.names, self.weights, self.intercept = names, weights, intercept
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(names >> np.uint64(44)).astype(np.int64)] = True

    def scores(self, words: Words) -> np.ndarray:
        if self.intercept is None:
            return np.zeros(words.docs)
        hashes = words.hashes()
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.names, hashes[some]), max(0, len(self.names) - 1))
        good = self.names[at] == hashes[some] if len(self.names) else np.zeros(0, bool)
        doc = np.searchsorted(words.first, some[good], "right") - 1
        pair = np.unique(doc * len(self.names) + at[good])
        width = max(1, len(self.names))
        total = np.bincount(pair // width, self.weights[pair % width], words.docs) if len(pair) else np.zeros(words.docs)
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -500, 500)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-5) -> Model:
    """A model from the distinct word hashes of confirmed and of unlabelled texts."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.uint64), np.zeros(0), None)
    both = positive + unlabelled
    n, n_p = len(both), len(positive)
    every = np.concatenate(both)
    owner = np.repeat(np.arange(n), [len(x) for x in both])
    names, code = np.unique(every, return_inverse=True)
    in_p = np.bincount(code[owner < n_p], minlength=len(names))
    in_u = np.bincount(code[owner >= n_p], minlength=len(names))
    # words whose share clearly differs between the two sets
    p, u, pool = in_p / n_p, in_u / (n - n_p), (in_p + in_u + 1) / (n + 2)
    z = np.abs(p - u) / np.sqrt(pool * (1 - pool) * (1 / n_p + 1 / (n - n_p)))
    order = np.flatnonzero((z >= LEAST_Z) & (in_p + in_u >= LEAST_TEXTS))
    place = np.full(len(names), -1)
    place[order] = np.arange(len(order))
    kept = place[code] >= 0
    row, column = owner[kept], place[code][kept]
    first = np.searchsorted(row, np.arange(n + 1))
    w, b = np.zeros(len(order)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        g = sums(w[column], first) + b
        s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
        harmless = np.logaddexp(0, g)  # loss if held harmless; the loss if held toxic is harmless - g
        slack = harmless[n_p:].mean() - prior * harmless[:n_p].mean()
        grad = np.zeros(n)
        if slack >= 0:
            grad[:n_p] = prior * (s[:n_p] - 1) / n_p - prior * s[:n_p] / n_p
            grad[n_p:] = s[n_p:] / (n - n_p)
        else:
            grad[:n_p] = prior * s[:n_p] / n_p
            grad[n_p:] = -s[n_p:] / (n - n_p)
        gw = np.bincount(column, grad[row], len(w)) + decay * w
        gb = grad.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        one, two = 1 - 0.9**step, 1 - 0.999**step
        w = w - rate * (m / one) / (np.sqrt(v / two) + 1e-8)
        b = b - rate * (mb / one) / (np.sqrt(vb / two) + 1e-8)
    return Model(names[order], w, b)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the training folds of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    docs = only(docs, doc_id="bigint", text="string")
    labels = only(labels, doc_id="bigint", toxic="int").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(_fold() != HELD)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled, toxic = labels.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return fit([], [], 0.5)
    prior = min(0.95, max(1e-4, toxic / labelled))
    total = docs.filter(_fold() != HELD).count()
    share = lambda n, bound: F.expr(f"pmod(xxhash64(doc_id, 17), {max(1, -(-n // bound))}) = 0")
    # bounded by the share: some FIT_POSITIVE ids
    chosen = F.broadcast(labels.filter("toxic = 1").filter(share(toxic, FIT_POSITIVE)).select("doc_id", F.lit(True).alias("positive")))
    picked = docs.filter(_fold() != HELD).join(chosen, "doc_id", "left")
    picked = picked.select("text", F.coalesce("positive", F.lit(False)).alias("positive"), share(total, FIT_UNLABELLED).alias("unlabelled")).filter("positive or unlabelled")
    # a toxic text of the unlabelled sample stays in it
    kinds = F.expr("filter(array(if(positive, true, null), if(unlabelled, false, null)), x -> x is not null)")
    sample = picked.select("text", F.explode(kinds).alias("positive"))
    rows = sample.mapInArrow(_presence, "positive boolean, words binary").toArrow()
    flag = rows["positive"].to_numpy()
    words = [np.frombuffer(x, np.uint64) for x in rows["words"].to_pylist()]
    return fit([x for x, f in zip(words, flag, strict=True) if f], [x for x, f in zip(words, flag, strict=True) if not f], prior)


def _scorer(shared, threshold: float):
    def run(batches):
        model = shared.value
        for batch in batches:
            for row, end, data, offsets in chunked(batch.column(1)):
                score = model.scores(Words(data, offsets, ALNUM))
                ids = batch.column(0).slice(row, end - row)
                held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD for i in ids.to_pylist()], bool)
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return only(docs, doc_id="bigint", text="string").mapInArrow(_scorer(shared, threshold), "doc_id bigint, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

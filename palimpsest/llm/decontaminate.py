"""Benchmark decontamination with suffix arrays of training shards.

Each task cuts its documents into shards of a few megabytes and builds a suffix
array of every shard over word numbers.  The array holds the suffixes that start
with a few words of some benchmark item, as no other suffix can match; stretches
of a document that no such suffix covers become a separator.  Every test suffix
whose first words occur in the shard is then binary-searched for all occurrences
of its window; those without a predecessor are followed to the end of the verbatim
match.  A document's result is its hit words, the items found, and its longest
match with the places of it; nothing is shuffled.  ``longest_matches`` gives the
longest match of each test suffix over all shards, by another search.

Words are maximal runs of bytes outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F``
after lower-casing A-Z.  A window is ``width`` consecutive words of an item; an
item of fewer words, but not none, is one window.  Null texts have no words.
The benchmark goes to all executors in pieces of at most ``limit`` bytes: one
piece as a rule; a larger benchmark takes one pass over the documents a piece.
Items with a null id mark words like others and are listed by an empty name.
Repeated rows and repeated items are handled one by one; items are counted by id.
Of equally long matches the first in the document is given, then the one of the
smallest item, then its first place in the item.  Very long texts are shards of
their own.  Empty tables give empty results, or rows without hits.  Extra columns of
any names are left out, or kept by ``clean``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytewords import ALNUM, Words, chunked, mix
from palimpsest.llm.common import bounded_batches, give_back, only

WIDTH = 10
#: Words by which suffixes are picked; the shortest window's length if that is less.
LEAD = 3
PIECE_BYTES = 16 << 20

OUT = "doc_id bigint, text_key bigint, n_words bigint, hits array<struct<start:bigint,stop:bigint>>, items array<string>, longest struct<less:bigint,at:bigint,item:bigint,offset:bigint>"
FOUND = "item_id bigint, offset bigint, words bigint, doc_id bigint, at_word bigint"


class Index:
    """Word numbers, windows and leading grams of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = WIDTH):
        self.width = width
        words = Words(*_joined([t or "" for _, t in items]), ALNUM)
        hashes = words.hashes()
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        self.names = ["" if i is None else str(i) for i, _ in items]
        self.ids = [i for i, _ in items]
        self.rank = np.argsort(sorted(range(len(items)), key=lambda k: (items[k][0] is not None, items[k][0])))  # by id, null first
        # items one after another, each closed by a separator of its own kind, 0
        item = words.doc()
        self.sequence = np.zeros(len(hashes) + len(items) + 1, np.int64)
        at = np.arange(len(hashes)) + item
        self.sequence[at] = number + 1
        self.start, self.item = at, item
        self.offset = np.arange(len(hashes)) - words.first[item]
        count = words.count[item]
        self.length = np.where(count >= width, width, count)  # of the window that starts here
        self.window = (self.offset + self.length) <= count
        left = count - self.offset
        self.lead = int(min(LEAD, self.length.min())) if len(hashes) else 1
        gram = _grams(self.sequence, self.lead)[at]
        gram = np.where(left >= self.lead, gram, 0)
        order = np.argsort(gram, kind="stable")
        order = order[gram[order] > 0]
        self.by_gram, self.grams = order, gram[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, from 1, or 0 for a word in no item."""
        out = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), max(0, len(self.vocabulary) - 1))
        good = self.vocabulary[at] == hashes[some] if len(self.vocabulary) else np.zeros(0, bool)
        out[some[good]] = at[good] + 1
        return out


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _grams(sequence: np.ndarray, k: int) -> np.ndarray:
    """A positive key of the k numbers that start at each place, 0 where one of them is 0."""
    n = len(sequence)
    key, full = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        key[: n - j] = key[: n - j] * np.uint64(0x9E3779B97F4A7C15) + sequence[j:].astype(np.uint64)
        full[: n - j] &= sequence[j:] > 0
        full[n - j :] = False
    return np.where(full, (mix(key) >> np.uint64(1)).astype(np.int64) | 1, 0)


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Places of ``sequence`` in the order of their suffixes, by prefix doubling."""
    n = len(sequence)
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64) + 1
    step, order = 1, np.argsort(rank, kind="stable")
    while n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]).cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n:
            break
        step *= 2
    return order


class Shard:
    """The suffix array of a run of documents, and searches in it."""

    def __init__(self, index: Index, words: Words):
        self.index, self.words = index, words
        number = index.numbers(words.hashes()) if len(words.start) else np.zeros(0, np.int64)
        doc = words.doc()
        spread = np.zeros(len(number) + words.docs + 1, np.int64)
        spread[np.arange(len(number)) + doc] = number
        gram = _grams(spread, index.lead)
        some = np.flatnonzero(gram)
        if len(some) and len(index.grams):
            at = np.minimum(np.searchsorted(index.grams, gram[some]), len(index.grams) - 1)
            some = some[index.grams[at] == gram[some]]
        else:
            some = some[:0]
        self.leads = np.unique(gram[some])
        edge = np.zeros(len(spread) + 1, np.int64)
        np.add.at(edge, some, 1)
        np.add.at(edge, some + index.lead, -1)
        kept = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        # a separator of its own wherever a stretch ends
        gap = np.flatnonzero(np.diff(kept, append=-1) != 1)
        self.where = np.insert(kept, gap + 1, -1)
        self.sequence = np.where(self.where >= 0, spread[self.where], 0)
        cut = np.flatnonzero(self.where < 0)
        unique = self.sequence.copy()
        unique[cut] = -1 - np.arange(len(cut))
        self.order = suffix_array(unique)
        self.order = self.order[np.isin(self.order, cut, invert=True)] if len(cut) else self.order
        self.word = self.where - np.searchsorted(words.first[1:] + np.arange(words.docs), self.where, "right") if len(kept) else self.where

    def active(self) -> np.ndarray:
        """Test suffixes whose first words occur in the shard."""
        low, high = (np.searchsorted(self.index.grams, self.leads, side) for side in ("left", "right"))
        return np.sort(self.index.by_gram[_ranges(low, high)]) if len(low) else np.zeros(0, np.int64)

    def compare(self, test: np.ndarray, place: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order of the shard's suffix against the test suffix: -1, 0, 1; words in common), within ``limit`` words."""
        sign, same = np.zeros(len(test), np.int64), np.zeros(len(test), np.int64)
        live, depth = np.arange(len(test)), 0
        own, other = self.sequence, self.index.sequence
        while len(live):
            live = live[limit[live] > depth]
            a = own[np.minimum(place[live] + depth, len(own) - 1)]
            b = other[self.index.start[test[live]] + depth]
            equal = (a == b) & (a > 0)
            sign[live[~equal]] = np.where(a[~equal] < b[~equal], -1, 1)
            live = live[equal]
            same[live] += 1
            depth += 1
        return sign, same

    def bound(self, test: np.ndarray, limit: np.ndarray, right: bool) -> np.ndarray:
        low, high = np.zeros(len(test), np.int64), np.full(len(test), len(self.order), np.int64)
        while (open_ := low < high).any():
            some = np.flatnonzero(open_)
            mid = (low[some] + high[some]) // 2
            sign, _ = self.compare(test[some], self.order[mid], limit[some])
            before = sign <= 0 if right else sign < 0
            low[some[before]] = mid[before] + 1
            high[some[~before]] = mid[~before]
        return low

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, place) of each occurrence of a window."""
        test = self.active()
        test = test[self.index.window[test]]
        if not len(test) or not len(self.order):
            return (np.zeros(0, np.int64),) * 2
        low, high = self.bound(test, self.index.length[test], False), self.bound(test, self.index.length[test], True)
        return np.repeat(test, high - low), self.order[_ranges(low, high)]

    def hits(self, test: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, item, document) of each occurrence."""
        word = self.word[place] if len(place) else place
        return word, self.index.length[test], self.index.item[test], np.searchsorted(self.words.first, word, "right") - 1

    def best(self, test: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, words in common, first word in it, item, first word in the item) of each document's longest match."""
        key = self.index.start[test] * (len(self.sequence) + 1) + place
        # an occurrence that goes on from another is a part of that one's match
        alone = ~np.isin(key - (len(self.sequence) + 1) - 1, key) | (self.index.offset[test] == 0)
        test, place = test[alone], place[alone]
        _, same = self.compare(test, place, np.full(len(test), len(self.index.sequence) + 1, np.int64))
        word, _, item, doc = self.hits(test, place)
        offset = self.index.offset[test]
        order = np.lexsort((offset, self.index.rank[item] if len(item) else item, word, -same, doc))
        first = order[np.unique(doc[order], return_index=True)[1]]
        return doc[first], same[first], word[first] - self.words.first[doc[first]], item[first], offset[first]

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test suffix, words in common, first word) of the longest match of each active test suffix."""
        test = self.active()
        if not len(test) or not len(self.order):
            return (np.zeros(0, np.int64),) * 3
        far = np.full(len(test), len(self.index.sequence) + 1, np.int64)
        at = self.bound(test, far, False)
        best, place = np.zeros(len(test), np.int64), np.zeros(len(test), np.int64)
        for near in (at - 1, at):
            good = np.flatnonzero((near >= 0) & (near < len(self.order)))
            _, same = self.compare(test[good], self.order[near[good]], far[good])
            more = same > best[good]
            best[good[more]], place[good[more]] = same[more], self.order[near[good[more]]]
        return test, best, self.word[place]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0] .. high[0] - 1, low[1] .. and so on."""
    count = high - low
    return np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)


def _marker(shared):
    def run(batches):
        index = shared.value
        names = np.array(index.names, object)
        for batch in batches:
            for row, end, data, offsets in chunked(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                shard = Shard(index, words)
                found = shard.occurrences()
                word, length, item, doc = shard.hits(*found)
                pair = np.unique(doc * len(names) + item)
                who, which = pair // max(1, len(names)), names[pair % max(1, len(names))]
                # occurrences as disjoint stretches of words within their document
                edge = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(edge, word, 1)
                np.add.at(edge, word + length, -1)
                hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                cut = words.first[1:-1]
                starts = np.flatnonzero(hit[1:] & ~hit[:-1])
                starts = np.unique(np.concatenate([starts, cut[hit[np.minimum(cut + 1, len(hit) - 1)]]]))
                ends = np.flatnonzero(~hit[1:] & hit[:-1])
                ends = np.unique(np.concatenate([ends, cut[hit[cut]]]))
                owner = np.searchsorted(words.first, starts, "right") - 1
                stretches = pa.StructArray.from_arrays([pa.array(starts - words.first[owner], pa.int64()), pa.array(ends - words.first[owner], pa.int64())], names=["start", "stop"])
                rows = np.arange(end - row + 1)
                own, same, at, item, offset = shard.best(*found)
                spot = np.zeros(end - row, np.int64)
                spot[own] = np.arange(len(own))
                none = np.ones(end - row, bool)
                none[own] = False
                value = lambda x: pa.array(np.asarray(x, np.int64)).take(pa.array(spot, mask=none)) if len(own) else pa.nulls(end - row, pa.int64())  # noqa: E731, B023
                ids = pa.array([index.ids[i] for i in item], pa.int64())
                ids = ids.take(pa.array(spot, mask=none)) if len(own) else pa.nulls(end - row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        batch.column(2).slice(row, end - row),
                        pa.array(words.count.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, rows).astype(np.int32)), stretches),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(who, rows).astype(np.int32)), pa.array(list(which), pa.string())),
                        pa.StructArray.from_arrays([value(-same), value(at), ids, value(offset)], names=["less", "at", "item", "offset"], mask=pa.array(none)),
                    ],
                    names=["doc_id", "text_key", "n_words", "hits", "items", "longest"],
                )
        give_back()

    return run


def _cleaner(shared, place: int):
    def run(batches):
        index = shared.value
        for batch in batches:
            for row, end, data, offsets in chunked(batch.column(place)):
                keep = np.ones(end - row, bool)
                shard = Shard(index, Words(data, offsets, ALNUM))
                keep[shard.hits(*shard.occurrences())[3]] = False
                yield batch.slice(row, end - row).filter(pa.array(keep))

    return run


def _finder(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for row, end, data, offsets in chunked(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                test, best, word = Shard(index, words).longest()
                doc = np.searchsorted(words.first, word, "right") - 1
                ids = batch.column(0).slice(row, end - row).take(pa.array(doc)) if len(doc) else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([index.ids[i] for i in index.item[test]], pa.int64()), pa.array(index.offset[test]), pa.array(best), ids, pa.array(word - words.first[doc] if len(doc) else word)],
                    names=["item_id", "offset", "words", "doc_id", "at_word"],
                )

    return run


def _indexes(benchmark: DataFrame, width: int, limit: int):
    """Indexes of pieces of the benchmark, each within ``limit`` bytes of text."""
    spark = benchmark.sparkSession
    items = only(benchmark, item_id="bigint", text="string")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(1, math.ceil(total / limit))
    for k in range(pieces):
        part = items if pieces == 1 else items.filter(F.expr(f"pmod(xxhash64(item_id, text), {pieces}) = {k}"))
        yield spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in part.collect()], width))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, match_words, match_at, match_item, match_offset) of every row of ``docs``.

    The match columns are those of the longest verbatim match: its words, the first
    word's number in the document, the item, and the first word's number in it.
    """
    texts = only(docs, doc_id="bigint", text="string").withColumn("text_key", F.xxhash64("text"))
    parts = [texts.mapInArrow(_marker(index), OUT) for index in _indexes(benchmark, width, limit)]
    marked = parts[0]
    if len(parts) > 1:
        # rows of equal id and text are equal: count them, merge the pieces, and give them back
        every = reduce(DataFrame.unionAll, parts).groupBy("doc_id", "text_key").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"), F.min("longest").alias("longest"), (F.count("*") / len(parts)).cast("int").alias("copies"))
        marked = every.select("doc_id", "text_key", "n_words", "hits", "items", "longest", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
    # words in the union of the stretches, which those of several pieces may share
    n_hit = F.expr("""aggregate(array_sort(hits), struct(0L as total, -1L as last),
        (m, h) -> struct(m.total + greatest(0L, h.stop - greatest(h.start, m.last)) as total, greatest(m.last, h.stop) as last)).total""")
    items = F.array_sort(F.array_distinct("items"))
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.coalesce(-F.col("longest.less"), F.lit(0).cast("bigint")).alias("match_words"),
        F.col("longest.at").alias("match_at"),
        F.col("longest.item").alias("match_item"),
        F.col("longest.offset").alias("match_offset"),
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = PIECE_BYTES) -> DataFrame:
    """(item_id, offset, words, doc_id, at_word): the longest verbatim match of each test suffix, over all shards.

    Suffixes whose first ``LEAD`` words (or as many as the shortest window has) occur
    nowhere are absent.  Of equally long matches the smallest (doc_id, at_word) is given.
    """
    texts = only(docs, doc_id="bigint", text="string")
    found = reduce(DataFrame.unionAll, [texts.mapInArrow(_finder(index), FOUND) for index in _indexes(benchmark, width, limit)])
    best = found.groupBy("item_id", "offset").agg(F.max(F.struct("words", -F.col("doc_id"), -F.col("at_word"))).alias("m"))
    return best.select("item_id", "offset", F.col("m.words").alias("words"), (-F.col("m.col2")).alias("doc_id"), (-F.col("m.col3")).alias("at_word"))


def clean(docs: DataFrame, benchmark: DataFrame, column: str = "text", width: int = WIDTH, limit: int = PIECE_BYTES) -> DataFrame:
    """The rows of ``docs`` whose ``column`` has no benchmark window, with all their columns; nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(column)
    for shared in _indexes(benchmark, width, limit):
        docs = docs.mapInArrow(_cleaner(shared, place), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same in DuckDB, with windows as joined words and matches as runs of windows on a diagonal.
ORACLE = """
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
b as (
  select row_number() over () as i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark),
bw as (
  select i, item_id, o, least(10, len(w)) as n, array_to_string(w[o:o + least(10, len(w)) - 1], ' ') as k
  from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(o) where len(w) > 0),
dw as (
  select r, p, n, array_to_string(w[p:p + n - 1], ' ') as k
  from d, (select distinct n from bw), unnest(range(1, len(w) - n + 2)) as u(p)),
h as (select r, p, n, i, item_id, o from dw join bw using (n, k)),
hit as (select r, count(distinct q) as n_hit from h, unnest(range(p, p + n)) as u(q) group by r),
found as (select r, count(*) as n_items, string_agg(x, ',' order by x) as x from (select distinct r, coalesce(cast(item_id as varchar), '') as x from h) group by r),
runs as (
  select r, i, item_id, n, min(p) as p, min(o) as o, count(*) + n - 1 as words
  from (select *, p - row_number() over (partition by r, i, p - o order by p) as island from h) group by r, i, item_id, n, p - o, island),
best as (select * from runs qualify row_number() over (partition by r order by words desc, p, item_id nulls first, o) = 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(x, '')) as items_sha256,
       n_hit is not null as contaminated, coalesce(words, 0) as match_words, p - 1 as match_at, item_id as match_item, o - 1 as match_offset
from d left join hit using (r) left join found using (r) left join best using (r)
"""

"""N-gram Jaccard join: MinHash banding, then exact comparison of full n-gram sets.

Plan, for N documents:

1. one scan turns every text into band hashes and a key of its n-gram set;
   documents with equal sets form a class, so copies cost one grouped row;
2. classes meet on (band, hash).  A bucket is not expanded into pairs: each
   member is tied to the bucket's smallest member, and the connected components
   of these ties hold every candidate pair;
3. n-gram sets are made again for the classes in components of two or more, and
   each component is compared in tiles of bounded size.  A tile gives, for each
   class, the number of its links and one tree edge, not the pairs;
4. where ties chain unlike texts to a component of more pairs than its buckets
   have, each bucket is compared instead, in the same tiles, and a pair counts in
   the first band that it shares.

Words are maximal runs of ASCII digits, ASCII letters (lower-cased) and
non-ASCII characters.  A text with fewer words than n, but not none, has one
n-gram of all its words.  A text without words, or null, links with nothing.
Very long texts are read whole; their sets travel as one value each.  Equal ids,
ties and copies make no difference to links.  An empty table gives an empty result;
extra columns are left out, or kept by ``one_of_each``, whatever their names.
Repeated rows count as copies.  Rows with a null id count as copies of others
and get the class of their text, but never name a class.  Rows of one id with
different texts are told apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytewords import ALNUM, Words, chunked, mix, windows
from palimpsest.llm.common import components, give_back, only, stored

#: Classes in one block of a tile; a tile compares two blocks.
BLOCK = 64
#: A component is compared as a whole as long as it has at most this many times the pairs of its buckets.
CHAIN = 1.0


def banding(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands find a pair at ``threshold`` with probability ``recall`` within ``most`` hashes."""
    found = (1, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > most:
            break
        found = (bands, rows)
    return found


def _sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, sorted within each document, and each document's first."""
    grams, first = windows(words.hashes(), words.first, n)
    doc = np.repeat(np.arange(words.docs), np.diff(first))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(words.docs + 1))


def _keys(grams: np.ndarray, first: np.ndarray, some: np.ndarray) -> np.ndarray:
    """A key of each document's set: a sum over its distinct members."""
    doc = np.repeat(np.arange(len(some)), np.diff(first)[some])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    repeated = np.zeros(len(grams), bool)
    repeated[1:] = (grams[1:] == grams[:-1]) & (doc[1:] == doc[:-1])
    grams = mix(grams)
    grams[repeated] = 0
    return mix(np.add.reduceat(grams, first[some]))


def _signer(n: int, bands: int, rows: int):
    multipliers = np.random.default_rng(7).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in chunked(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                grams, first = windows(words.hashes(), words.first, n)
                some = np.flatnonzero(np.diff(first))
                band = np.zeros((len(some), bands), np.uint64)
                key = np.zeros(len(some), np.uint64)
                if len(some):
                    at, work = first[some], np.empty_like(grams)
                    for k, m in enumerate(multipliers):
                        np.multiply(grams, m, out=work)
                        band[:, k // rows] = mix(band[:, k // rows] * np.uint64(31) + np.minimum.reduceat(work, at) + np.uint64(k + 1))
                    key = _keys(grams, first, some)
                keys = np.zeros(end - row, np.int64)
                keys[some] = key.view(np.int64)
                absent = np.ones(end - row, bool)
                absent[some] = False
                where = np.concatenate([[0], np.cumsum(np.where(absent, 0, bands))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, end - row) for i in (0, 2)), pa.array(keys, mask=absent), pa.ListArray.from_arrays(where, band.reshape(-1).view(np.int64))],
                    names=["doc_id", "text_key", "key", "bands"],
                )
        give_back()

    return run


def _grams(n: int):
    """Sets of the rows whose text has the key that is asked for."""

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in chunked(batch.column(2)):
                words = Words(data, offsets, ALNUM)
                grams, first = windows(words.hashes(), words.first, n)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                own = batch.slice(row, end - row)
                right = np.zeros(end - row, bool)
                right[some] = _keys(grams, first, some).view(np.int64) == own.column(0).to_numpy()[some]
                grams, first = _sets(words, n)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - row, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(grams))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(2)), raw], names=["node", "size", "grams"]).filter(pa.array(right))

    return run


def _compare(threshold: float):
    def run(key, group):
        group = group.combine_chunks()
        node, comp, size, block, band = (group[c].to_numpy() for c in ("node", "unit", "size", "block", "band"))
        sets = [np.frombuffer(x, np.uint64) for x in group["grams"].to_pylist()]
        n, count = len(sets), np.array([len(x) for x in sets])
        grams, owner = np.concatenate(sets), np.repeat(np.arange(n), count)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        owner, column = owner[shared], column[shared]
        column = np.unique(column, return_inverse=True)[1]
        both = np.zeros((n, n), np.float32)
        total = int(column.max()) + 1 if len(column) else 0
        for low in range(0, total, 4096):
            a, b = np.searchsorted(column, (low, low + 4096))
            part = np.zeros((n, min(4096, total - low)), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            both += part @ part.T
        union = count[:, None] + count[None, :] - both
        # exact: whole numbers below 2^24 on both sides; the margin is far below 1 / union
        link = (both >= threshold * union - 1e-6) & (comp[:, None] == comp[None, :])
        if key[1].as_py() != key[2].as_py():
            link &= block[:, None] != block[None, :]  # pairs within a block belong to its own tile
        if (band > 0).any():  # pairs that an earlier band has
            bands = group["bands"].fill_null([]).to_pylist()
            wide = max(map(len, bands))
            table = np.array([x or [0] * wide for x in bands], np.int64)
            for k in range(int(band.max())):
                link &= (table[:, None, k] != table[None, :, k]) | (band[:, None] <= k)
        np.fill_diagonal(link, False)
        root = np.arange(n)
        rank = np.argsort(np.argsort(node))
        low = rank.copy()
        while True:  # smallest reachable rank
            reach = np.where(link, low[None, :], n).min(1, initial=n)
            new_low = np.minimum(low, reach)
            if (new_low == low).all():
                break
            low = new_low
        root = np.argsort(rank)[low]
        return pa.table({"node": node, "links": (link * size[None, :]).sum(1).astype(np.int64), "root": node[root]})

    return run


def _classes(docs: DataFrame, threshold: float, n: int, recall: float) -> DataFrame:
    """(doc_id, text_key, root, class_id, n_links) of every row; root names the group, also where ids repeat."""
    bands, rows = banding(threshold, recall)
    docs = only(docs, doc_id="bigint", text="string").withColumn("text_key", F.xxhash64("text"))
    signed = stored(docs.mapInArrow(_signer(n, bands, rows), "doc_id bigint, text_key bigint, key bigint, bands array<bigint>"))
    classes = signed.filter("key is not null").groupBy(F.col("key").alias("node")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    classes = stored(classes)
    banded = classes.filter("rep is not null").select("node", F.posexplode("bands").alias("band", "hash"))
    bucket = banded.groupBy("band", "hash").agg(F.min("node").alias("low"), F.count("*").alias("many")).filter("many > 1")
    tied = stored(banded.join(bucket, ["band", "hash"]))
    groups = components(tied.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()).withColumnRenamed("root", "comp")
    groups = stored(groups.join(classes.select("node", "rep", "size"), "node"))

    wide = groups.groupBy("comp").agg(F.count("*").alias("width"))
    # pairs of a component, and of its buckets, twice each
    buckets = tied.join(groups.select("node", "comp"), "node").groupBy("comp").agg(F.sum("many").alias("shared"))
    wide = stored(wide.join(buckets, "comp").withColumn("chained", (F.col("width") > BLOCK) & (F.col("width").cast("double") * F.col("width") > CHAIN * F.col("shared"))))
    whole = groups.join(wide.filter("not chained"), "comp").select("node", F.col("comp").alias("unit"), "width", F.lit(-1).alias("band"), F.lit(None).cast("array<bigint>").alias("bands"))
    parts = groups.select("node", "comp").join(wide.filter("chained").select("comp"), "comp").join(tied, "node").join(classes.select("node", "bands"), "node")
    units = stored(whole.unionAll(parts.select("node", F.xxhash64("band", "hash").alias("unit"), F.col("many").alias("width"), "band", "bands")))
    small = units.filter(F.col("width") <= BLOCK).count()
    tiled = units.withColumn("blocks", F.ceil(F.col("width") / BLOCK).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    pack = F.array(F.struct(F.expr(f"pmod(xxhash64(unit), {max(1, math.ceil(small / BLOCK))})").alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    tiles = F.expr("transform(sequence(0, blocks - 1), x -> struct(unit as g, least(x, block) as i, greatest(x, block) as j))")
    tiled = tiled.select("node", "unit", "band", "bands", "block", F.when(F.col("width") <= BLOCK, pack).otherwise(tiles).alias("tiles"))

    # one text for each class in a component; repeated rows of an id are one.  Both sides grow with
    # the corpus, so the join is by key at every size and never a broadcast
    texts = docs.join(groups.select(F.col("rep").alias("doc_id"), "node", "size").hint("merge"), "doc_id").select("node", "size", "text")
    sets = texts.mapInArrow(_grams(n), "node bigint, size bigint, grams binary")
    if _repeats(signed):
        sets = sets.groupBy("node", "size").agg(F.first("grams").alias("grams"))
    dealt = sets.join(tiled, "node").select("node", "unit", "band", "bands", "size", "grams", "block", F.explode("tiles").alias("t")).select("node", "unit", "band", "bands", "size", "grams", "block", "t.*")
    verified = stored(dealt.groupBy("g", "i", "j").applyInArrow(_compare(threshold), "node bigint, links bigint, root bigint"))

    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "rep", "size").join(linked, "node", "left").join(roots, "node", "left")
    named = stored(named.select("node", "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    firsts = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.drop("rep").join(firsts, "root").withColumnRenamed("node", "key")
    out = signed.select("doc_id", "text_key", "key").join(named, "key", "left")
    return out.select("doc_id", "text_key", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def _repeats(rows: DataFrame) -> bool:
    """Whether an id has several rows."""
    return bool(rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count())


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """(doc_id, class_id, n_links) of every row of ``docs`` (doc_id, text).

    n_links counts the other rows whose n-gram sets have a Jaccard similarity of
    at least ``threshold`` with this row's, copies included; class_id is the
    smallest doc_id reachable by such links.  A pair at the threshold is a
    candidate with probability ``recall`` or more; every link is verified.
    """
    return _classes(docs, threshold, n, recall).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the smallest id.

    Rows with a null id stay.  Of repeated rows of one id in a group, one stays.
    """
    classes = stored(_classes(docs, threshold, n, recall))
    own = F.xxhash64(docs["text"].cast("string"))
    gone = classes.filter("doc_id is not null and doc_id <> class_id").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    left = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (own == gone["gone_key"]), "left_anti")
    if _repeats(classes):
        groups = classes.filter("doc_id is not null").groupBy(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")).agg(F.coalesce(F.first("root"), F.first("text_key")).alias("own_root"))
        kept = left.join(groups, (left["doc_id"] == groups["own_id"]) & (F.xxhash64(left["text"].cast("string")) == groups["own_key"]))
        left = kept.dropDuplicates(["own_id", "own_root"]).select(*[left[c] for c in docs.columns]).unionByName(left.filter("doc_id is null"))
    return left


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in DuckDB, with sets of joined words, pairs that share an n-gram, and their transitive closure.
ORACLE = """
with recursive
d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
grams as (select distinct r, doc_id, array_to_string(w[p:p + 4], ' ') as g from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(p) where len(w) > 0),
size as (select r, count(*) as n from grams group by r),
shared as (select a.r as x, b.r as y, count(*) as c from grams a join grams b on a.g = b.g and a.r <> b.r group by a.r, b.r),
links as (select x, y from shared join size p on p.r = x join size q on q.r = y where 10 * c >= 8 * (p.n + q.n - c)),
reach as (select r as x, r as y from d union select reach.x, links.y from reach join links on links.x = reach.y),
class as (select x as r, min(doc_id) as class_id from reach join d on d.r = reach.y group by x),
degree as (select x as r, count(*) as n from links group by x)
select doc_id, class_id, coalesce(n, 0) as n_links from d join class using (r) left join degree using (r)
"""

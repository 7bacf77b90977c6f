"""Prediction by partial matching over bytes, with a word baseline.

Model.  A text is read as its tokens: lower-cased words joined by one space, and
one end symbol.  The trie has a node for each context of up to ``ORDER`` bytes
and each byte seen after it, with counts over all training documents.  A byte is
predicted in the longest known context; a byte not seen there escapes to the
next shorter one (as in method D: every byte seen gives up ``DISCOUNT`` of its
count, and these parts are the escape's), where bytes seen in the longer context
are excluded.  As all bytes seen after a context are also seen after its suffix, what is excluded
depends on the longer context alone and is a column of its node.  Below order 0
all 257 - seen symbols are equally likely.

Scale.  A byte's probability depends on its gram, the byte and the ``ORDER`` before
it.  Texts are cut into blocks, and a block's distinct grams and words are what is
sent, in slices by hash: one row for the names of a block that fall into a slice, so
that few rows and no places are sent, as values come back in the order of the names.
Counts of grams are dealt by the last ``SHARED`` bytes of the context, so a bucket
holds every node of the longer contexts that end in these bytes and gives the
probabilities of its grams; the nodes of shorter contexts, 2^24 at most, go to all
executors.  A name is in a slice once a block at most, however frequent it is.  The
trie is never cut and never in one place, and it grows with the corpus.  Words are
told apart by 64-bit hashes.

Null texts are empty: one end token.  A document is in training unless
crc32(doc_id as text) % folds is ``held``; a null id counts as the empty text.
Rows are scored one by one, so repeated rows agree; they count as often as they
occur.  A very long text is a block of its own, worked on in pieces.  An empty table
gives an empty result.  Extra columns are left out at the scan, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytewords import NONSPACE, Words, buffers, chunked, mix, sums
from palimpsest.llm.common import discard, give_back, only, stored

ORDER = 5
DISCOUNT = 0.3
#: Bytes of the context that all nodes of a bucket share. Shorter contexts have 256^SHARED nodes at most.
SHARED = 3
FOLDS, HELD = 7, 2
#: Text bytes and documents in a block, and symbols worked on at once.
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 50_000
PIECE = 2 << 20
#: Grams in a bucket of the trie, and names of all blocks in a slice.
BUCKET_GRAMS = 500_000
SLICE_NAMES = 1_000_000
#: Most partitions that slices, or blocks, are dealt to.
MOST_PARTITIONS = 20_000
END = 0xFF  # in no UTF-8 text
END_HASH = np.uint64(0xE1C8864680B583EB)


def held_out(ids: pa.Array, folds: int = FOLDS, held: int = HELD) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == held for i in ids.to_pylist()], bool)


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each document, after ORDER end symbols of padding, and each one's first symbol."""
    length = words.end - words.start
    first = words.first
    own = sums(length, first, np.int64) + np.maximum(words.count, 1) + ORDER
    at = np.concatenate([[0], np.cumsum(own)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    # where each word goes: its document's start, the padding, earlier words and their spaces
    before = np.cumsum(length) - length
    doc = words.doc()
    base = np.concatenate([before, [length.sum()]])[first[:-1]] if len(first) > 1 else before[:0]
    to = at[doc] + ORDER + (before - base[doc]) + (np.arange(len(length)) - first[doc])
    source = np.arange(int(length.sum()))
    out[source + np.repeat(to - before, length)] = words.data[source + np.repeat(words.start - before, length)]
    for k in range(ORDER):
        out[at[:-1] + k] = END
    out[at[1:] - 1] = END
    return out, at


def grams(symbols: np.ndarray, at: np.ndarray):
    """Pieces of the documents' grams: (distinct gram << 16 | document, sorted, and how often each occurs).

    A gram is the ORDER + 1 bytes that end with a symbol, as a number; padding has none.
    """
    for low in range(ORDER, len(symbols), PIECE):
        s = symbols[low - ORDER : low + PIECE].astype(np.uint64)
        n = len(s) - ORDER
        key = np.zeros(n, np.uint64)
        for j in range(ORDER + 1):
            key <<= np.uint64(8)
            key |= s[j : j + n]
        first, last = np.searchsorted(at, [low, low + n - 1], "right") - 1
        edges = np.clip(at[first : last + 2] - low, 0, n)
        doc = np.repeat(np.arange(first, last + 1), np.diff(edges))
        inside = np.arange(low, low + n) - at[doc] >= ORDER
        packed = (key[inside] << np.uint64(16)) | doc[inside].astype(np.uint64)
        packed.sort()
        yield _runs(packed)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[start], np.diff(np.append(start, len(ordered)))


class Trie:
    """Nodes of the trie by order, as sorted arrays."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], lower: Trie | None = None):
        """levels[k]: contexts of k bytes with one more byte, as numbers, and their counts; ``lower`` has the levels before these."""
        self.grams, self.n, self.direct, self.contexts = (list(getattr(lower, x, ())) for x in ("grams", "n", "direct", "contexts"))
        for key, n in levels:
            order = np.argsort(key)
            key, n = key[order], n[order].astype(np.float64)
            context, first = np.unique(key >> np.uint64(8), return_index=True)
            kinds = np.diff(np.append(first, len(key)))
            total = np.add.reduceat(n, first) if len(n) else n
            shut = np.zeros(len(context))
            if self.grams and len(key):
                mask = np.uint64((1 << (8 * len(self.grams))) - 1)
                shut = np.add.reduceat(self.n[-1][np.searchsorted(self.grams[-1], key & mask)], first)
            self.grams.append(key)
            self.n.append(n)
            self.direct.append(np.log10((n - DISCOUNT) / np.repeat(total, kinds)).astype(np.float32))
            # total, kinds, and the count that the next shorter context has for the bytes seen here
            self.contexts.append((context, total, kinds.astype(np.int32), shut))

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each of the sorted grams, after the others."""
        out = np.zeros(len(key))
        live = np.arange(len(key))
        shut, shut_kinds = np.zeros(len(key)), np.zeros(len(key))
        for k in range(len(self.grams) - 1, -1, -1):
            if not len(live):
                break
            part = key[live] & np.uint64((1 << (8 * (k + 1))) - 1)
            names, n = self.grams[k], self.n[k]
            at = np.minimum(np.searchsorted(names, part), max(0, len(names) - 1))
            hit = names[at] == part if len(names) else np.zeros(len(part), bool)
            fresh = shut_kinds[live] == 0
            quick = hit & fresh
            out[live[quick]] += self.direct[k][at[quick]]
            rest = np.flatnonzero(~quick)
            live, part, at, hit = live[rest], part[rest], at[rest], hit[rest]
            context, total, kinds, lower = self.contexts[k]
            where = np.minimum(np.searchsorted(context, part >> np.uint64(8)), max(0, len(context) - 1))
            known = context[where] == part >> np.uint64(8) if len(context) else np.zeros(len(part), bool)
            if len(context):
                all_kinds = np.where(known, kinds[where], 0)
                left = np.where(known, total[where], 0) - shut[live]
                left_kinds = all_kinds - shut_kinds[live]
                opened = known & (left_kinds > 0)
                space = np.where(opened, left, 1)
                out[live] += np.where(hit, np.log10(np.maximum(n[at] - DISCOUNT, 1e-9) / space), np.where(opened, np.log10(DISCOUNT * np.maximum(left_kinds, 1) / space), 0))
                shut[live] = np.where(known, lower[where], 0)
                shut_kinds[live] = all_kinds
            if k == 0:
                missed = live[~hit]
                out[missed] -= np.log10(257 - shut_kinds[missed])
            live = live[~hit]
        if not len(self.grams):
            out -= np.log10(257)
        return out


def shorter(key: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams' last ``width`` bytes and their counts."""
    key = key & np.uint64((1 << (8 * width)) - 1)
    order = np.argsort(key, kind="stable")
    short, times = _runs(key[order])
    return short, np.add.reduceat(n[order], np.cumsum(times) - times) if len(n) else n


def pack(numbers: np.ndarray) -> bytes:
    """Numbers of 1, 4 or 8 bytes, compressed with their bytes of the same rank together."""
    width = numbers.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def unpack(packed: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pack_sorted(names: np.ndarray) -> bytes:
    return pack(np.diff(names, prepend=names.dtype.type(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def sliced(names: np.ndarray, slices: int, mixed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts names by their slice, slices that have any, first name of each of these and the end).

    Hashes are spread as they are; other names are ``mixed`` first.
    """
    high = (mix(names) if mixed else names) >> np.uint64(32)
    slot = ((high * np.uint64(slices)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    present, times = _runs(slot[order])
    return order, present, np.concatenate([[0], np.cumsum(times)])


BLOCKS = "block bigint, doc_ids array<bigint>, held array<boolean>, texts binary, words binary, word_n binary, grams binary, gram_n binary, many_words bigint, many_grams bigint"


class Block:
    """The distinct words and grams of a run of documents."""

    def __init__(self, texts: pa.Array):
        self.hashes, self.counts, self.parts = [], [], []  # of words by chunk; packed grams of a piece, times, first document
        for row, _, data, offsets in chunked(texts):
            words = Words(data, offsets, NONSPACE)
            # every document ends with one end token
            at = words.first[1:] + np.arange(words.docs)
            every = np.full(len(words.start) + words.docs, END_HASH)
            rest = np.ones(len(every), bool)
            rest[at] = False
            every[rest] = words.hashes()
            self.hashes.append(every)
            self.counts.append(words.count + 1)
            self.parts += [(packed, times.astype(np.int32), row) for packed, times in grams(*stream(words))]
        self.counts = np.concatenate(self.counts)
        self.words, self.token = np.unique(np.concatenate(self.hashes), return_inverse=True)
        self.grams = np.zeros(0, np.uint64)
        for packed, _, _ in self.parts:
            self.grams = np.union1d(self.grams, _runs(packed >> np.uint64(16))[0])

    def in_training(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and each gram occurs in documents that aren't held out."""
        words = np.bincount(self.token[~np.repeat(held, self.counts)], minlength=len(self.words))
        found = np.zeros(len(self.grams), np.int64)
        for packed, times, row in self.parts:
            name, runs = _runs(packed >> np.uint64(16))
            doc = (packed & np.uint64(0xFFFF)).astype(np.int64) + row
            found[np.searchsorted(self.grams, name)] += np.add.reduceat(np.where(held[doc], 0, times), np.cumsum(runs) - runs)
        return words, found

    def scores(self, word_value: np.ndarray, gram_value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the words' and the grams' values by document."""
        model = np.zeros(len(self.counts))
        for packed, times, row in self.parts:
            name, runs = _runs(packed >> np.uint64(16))
            value = np.repeat(gram_value[np.searchsorted(self.grams, name)], runs) * times
            part = np.bincount((packed & np.uint64(0xFFFF)).astype(np.int64), value)
            model[row : row + len(part)] += part
        return np.add.reduceat(word_value[self.token], np.cumsum(self.counts) - self.counts), model


def _blocks(batches):
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 20
    ids, texts, docs, size = [], [], 0, 0

    def flush():
        every, names = pa.concat_arrays(texts), pa.concat_arrays(ids)
        own, held = Block(every), held_out(names)
        words, found = own.in_training(held)
        data, offsets = buffers(every)
        packed = [zstandard.compress(offsets.tobytes() + data.tobytes(), 3), pack_sorted(own.words), pack(words.astype(np.int32)), pack_sorted(own.grams), pack(found.astype(np.int32))]
        row = [pa.array([block]), pa.array([names.to_pylist()], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in packed), pa.array([len(own.words)]), pa.array([len(own.grams)])]
        return pa.RecordBatch.from_arrays(row, names=["block", "doc_ids", "held", "texts", "words", "word_n", "grams", "gram_n", "many_words", "many_grams"])

    for batch in batches:
        for row, end, data, _ in chunked(batch.column(1)):
            ids.append(batch.column(0).slice(row, end - row))
            texts.append(batch.column(1).slice(row, end - row).fill_null(""))
            docs, size = docs + end - row, size + len(data)
            if size >= BLOCK_BYTES or docs >= BLOCK_DOCS:
                yield flush()
                block, docs, size = block + 1, 0, 0
                ids.clear(), texts.clear()
    if ids:
        yield flush()
    give_back()


def _slicer(slices: int, mixed: bool):
    def run(batches):
        for batch in batches:
            for block, names, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names, n = unpack_sorted(names), unpack(n, np.int32)
                order, present, first = sliced(names, slices, mixed)
                names, n = names[order], n[order]
                cells = [(pack_sorted(names[a:b]), pack(n[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(np.full(len(present), block)), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["slice", "block", "names", "n"])

    return run


def _counted(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Names of each cell of a slice; the distinct ones, the number of each name of the cells, and counts of the distinct ones."""
    cells = [unpack_sorted(x) for x in group["names"].to_pylist()]
    n = np.concatenate([unpack(x, np.int32) for x in group["n"].to_pylist()])
    names, number = np.unique(np.concatenate(cells), return_inverse=True)
    return cells, names, number, np.bincount(number, n, len(names)).astype(np.int64)


BACK = "block bigint, slice bigint, gram boolean, packed binary, total bigint, known bigint"


def _back(group: pa.Table, cells: list[np.ndarray], value: np.ndarray, gram: bool, total: int, known: int) -> pa.Table:
    """The values of a slice's names, cell by cell; totals of the slice stand in the first row."""
    rows = len(cells)
    parts = np.split(value, np.cumsum([len(c) for c in cells])[:-1])
    once = lambda x: np.array([x] + [0] * (rows - 1), np.int64)
    return pa.table({"block": group["block"], "slice": group["slice"], "gram": np.full(rows, gram), "packed": pa.array([pack(x) for x in parts], pa.binary()), "total": once(total), "known": once(known)})


def _count_words(key, group):
    cells, _, number, count = _counted(group)
    return _back(group, cells, count[number], False, int(count.sum()), int((count > 0).sum()))


def _count_grams(key, group):
    _, names, _, count = _counted(group)
    return pa.table({"gram": names.view(np.int64), "n": count})


def _look_up(key, group, values):
    cells = [unpack_sorted(x) for x in group["names"].to_pylist()]
    gram, value = values["gram"].to_numpy().view(np.uint64), values["value"].to_numpy()
    order = np.argsort(gram)
    return _back(group, cells, value[order][np.searchsorted(gram[order], np.concatenate(cells))], True, 0, 0)


def _valuer(shared, slices: int):
    def run(key, group):
        group = group.combine_chunks()
        gram, n = group["gram"].to_numpy().view(np.uint64), group["n"].to_numpy()
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        seen = n > 0
        levels = [(gram[seen], n[seen])]
        for width in range(ORDER, SHARED, -1):
            levels.insert(0, shorter(*levels[0], width))
        value = Trie(levels, shared.value).log10(gram).astype(np.float32)
        order, present, first = sliced(gram, slices, True)
        return pa.table({"slice": np.repeat(present, np.diff(first)), "gram": gram[order].view(np.int64), "value": value[order]})

    return run


def model(counts: DataFrame, slices: int = 1) -> DataFrame:
    """(slice, gram, value): log10 of the probability of the last byte of each gram of ``counts`` (gram, n; n may be 0)."""
    low = counts.filter("n > 0").groupBy(F.expr(f"gram & {(1 << (8 * SHARED)) - 1}L").alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    key, n = low["gram"].to_numpy().view(np.uint64), low["n"].to_numpy()
    shared = counts.sparkSession.sparkContext.broadcast(Trie([shorter(key, n, k + 1) for k in range(SHARED)]))
    buckets = max(1, -(-counts.count() // BUCKET_GRAMS))
    context = f"(gram >> 8) & {(1 << (8 * SHARED)) - 1}L"
    return counts.groupBy(F.expr(f"pmod(xxhash64({context}), {buckets})")).applyInArrow(_valuer(shared, slices), "slice bigint, gram bigint, value float")


def _scorer(total: int, distinct: int, slices: int):
    def run(key, blocks, back):
        row = blocks.to_pylist()[0]
        docs = len(row["doc_ids"])
        raw = zstandard.decompress(row["texts"])
        offsets = np.frombuffer(raw, np.int64, docs + 1)
        own = Block(pa.LargeStringArray.from_buffers(docs, pa.py_buffer(offsets), pa.py_buffer(memoryview(raw)[offsets.nbytes :])))
        cells = sorted(zip(back["gram"].to_pylist(), back["slice"].to_pylist(), back["packed"].to_pylist(), strict=True))
        c = np.concatenate([unpack(x, np.int64) for gram, _, x in cells if not gram])
        value = np.zeros(len(own.grams))
        value[sliced(own.grams, slices, True)[0]] = np.concatenate([unpack(x, np.float32) for gram, _, x in cells if gram])
        base, score = own.scores(np.log10((c + 1) / (total + distinct + 1)), value)
        known = np.add.reduceat((c > 0).astype(np.int64)[own.token], np.cumsum(own.counts) - own.counts)
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": own.counts.astype(np.int64), "n_known": known, "train_tokens": np.full(docs, total), "base_score": base, "score": score})

    return run


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    blocks = stored(only(docs, doc_id="bigint", text="string").mapInArrow(_blocks, BLOCKS))
    many, words, grams_ = (x or 0 for x in blocks.agg(F.count("*"), F.sum("many_words"), F.sum("many_grams")).first())
    slices = lambda n: max(1, -(-n // SLICE_NAMES))
    dealt = lambda df, n, by: df.repartition(max(1, min(n, MOST_PARTITIONS)), by)
    cell = "slice bigint, block bigint, names binary, n binary"
    w, g = slices(words), slices(grams_)
    word_cells = dealt(blocks.select("block", "words", "word_n").mapInArrow(_slicer(w, False), cell), w, "slice")
    counted = stored(word_cells.groupBy("slice").applyInArrow(_count_words, BACK))
    total, distinct = (x or 0 for x in counted.agg(F.sum("total"), F.sum("known")).first())
    gram_cells = dealt(blocks.select("block", "grams", "gram_n").mapInArrow(_slicer(g, True), cell), g, "slice")
    counts = stored(gram_cells.groupBy("slice").applyInArrow(_count_grams, "gram bigint, n bigint"))
    values = stored(model(counts, g))
    discard(counts)
    found = gram_cells.groupBy("slice").cogroup(dealt(values.withColumnRenamed("slice", "own"), g, "own").groupBy("own")).applyInArrow(_look_up, BACK)
    back = counted.unionAll(found).select(F.col("block").alias("own"), "slice", "gram", "packed")
    kind = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    texts = dealt(blocks.select("block", "doc_ids", "held", "texts"), many, "block")
    return texts.groupBy("block").cogroup(dealt(back, many, "own").groupBy("own")).applyInArrow(_scorer(total, distinct, g), kind)


def query(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokens_query(spark, sf_dir: str) -> DataFrame:
    """The baseline's tokens, without the sums of logarithms, whose last digits depend on their order."""
    return query(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


#: The baseline's tokens in DuckDB; the checksum is taken bit by bit.
TOKENS_ORACLE = """
with d as (
  select row_number() over () as r, doc_id,
         list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(coalesce(cast(doc_id as varchar), '')) + 1), lambda i: cast(ascii(substr(cast(doc_id as varchar), i, 1)) as bigint))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, 3988292384::bigint * (x & 1)))) as c,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') as w
  from documents),
h as (select r, doc_id, w, xor(c, 4294967295::bigint) % 7 = 2 as held_out from d),
t as (select r, held_out, unnest(w) as word from h),
known as (select word, count(*) as c from t where not held_out group by word),
n as (select r, count(*) as n_tokens, count(c) as n_known from t left join known using (word) group by r)
select doc_id, held_out, n_tokens, n_known, (select coalesce(sum(c), 0)::bigint from known) as train_tokens from h join n using (r)
"""

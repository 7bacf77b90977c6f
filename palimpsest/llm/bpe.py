"""Byte-level BPE encoding and decoding with recursive DuckDB queries.

Each task splits its texts into pieces and encodes the distinct new ones in an
in-process DuckDB.  A piece is a set of (piece, position, token) rows; a step of
the recursion joins neighbours with the merge table and contracts each piece's
leftmost pair of the smallest rank, until no pair is left.  Decoding aggregates
the bytes of a piece's tokens in the order of their positions.

A piece of more than ``LONG`` bytes is encoded in overlapping windows of that size,
each a piece of the recursion.  Neighbouring windows are joined behind a token that
both have at the same place; where they share none, a window twice as large takes
their place (of more than ``WIDE`` bytes, by a recursion with the same result that
contracts all pairs of the smallest rank a step).  The result is exact: a sequence of tokens is the encoding of its bytes
if, and only if, every two neighbours are the encoding of theirs, and in the joined
sequence any two neighbours come from the same window.  So a long piece costs in
proportion to its length.

Null texts are empty: no ids.  Rows are handled one by one, whatever their ids, so
repeated rows and null ids come out as they come in.  An empty table gives an empty
result.  Extra columns are left out at the scan, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.bytewords import chunked
from palimpsest.llm.common import give_back, only
from palimpsest.llm.pretokens import Recent, splitter

#: Distinct pieces whose ids a worker keeps between batches, and pieces in one recursive query.
CACHE_WORDS = 240_000
QUERY_WORDS = 20_000
#: Bytes of the longest piece that is encoded at once.
LONG = 64
#: Bytes of the windows of longer pieces, and of the largest one whose pairs are contracted one by one.
WINDOW, WIDE = 128, 512
#: Bytes of the pieces in one recursive query, or one piece.
QUERY_BYTES = 150_000

#: One pair of each piece a step. A state row has the token that follows, its place, and the rank of the pair.
ENCODE = """
with recursive state(step, word, pos, id, after, next_pos, rank) as (
  select 0, t.word, t.pos, t.id, n.id, n.pos, m.merged
  from tokens t
  left join tokens n on n.word = t.word and n.pos = t.pos + 1
  left join merges m on m.a = t.id and m.b = n.id
  union all
  select s.step, s.word, s.pos, s.id, s.after, s.next_pos, m.merged
  from (
    select s.step + 1 as step, s.word, s.pos,
           case when s.pos = best.next_pos then best.rank else s.id end as id,
           case when s.next_pos = best.pos then best.rank else s.after end as after,
           case when s.next_pos = best.pos then best.next_pos else s.next_pos end as next_pos
    from state s
    join (
      select word, min(rank) as rank,
             arg_min(pos, (rank::bigint << 32) + pos) as pos,
             arg_min(next_pos, (rank::bigint << 32) + pos) as next_pos
      from state where rank is not null group by word
    ) best on s.word = best.word and s.pos <> best.pos
  ) s
  left join merges m on m.a = s.id and m.b = s.after
)
select s.word, s.pos, s.id from state s join (select word, max(step) as step from state group by word) using (word, step)
"""

_START = """
  select t.word, t.pos, t.id, n.id as after, n.pos as next_pos, m.merged as rank
  from tokens t
  left join tokens n on n.word = t.word and n.pos = t.pos + 1
  left join merges m on m.a = t.id and m.b = n.id
"""

_PICKED = """(
  select word, pos, next_pos, rank from (
    select *, row_number() over (partition by word, run order by pos) as nth from (
      select *, row_number() over (partition by word order by pos)
                - row_number() over (partition by word, rank is not distinct from low order by pos) as run
      from (select *, min(rank) over (partition by word) as low from recurring.state where id >= 0)
    ) where rank = low
  ) where nth % 2 = 1
)"""

#: The same with all pairs of the smallest rank a step; of overlapping ones every other from the left. No merge across such
#: pairs can come first, as a pair with the new token always has a higher rank.
ENCODE_WIDE = f"""
with recursive state(word, pos, id, after, next_pos, rank) using key (word, pos) as (
  {_START}
  union
  select s.word, s.pos, s.id, s.after, s.next_pos, m.merged
  from (
    select s.word, s.pos,
           case when gone.pos is not null then -1 when made.pos is not null then made.rank else s.id end as id,
           case when near.pos is not null then near.rank else s.after end as after,
           case when near.pos is not null then near.next_pos else s.next_pos end as next_pos
    from (select * from recurring.state where id >= 0) s
    left join {_PICKED} gone on s.word = gone.word and s.pos = gone.pos
    left join {_PICKED} made on s.word = made.word and s.pos = made.next_pos
    left join {_PICKED} near on s.word = near.word and s.next_pos = near.pos
    where s.word in (select word from {_PICKED})
  ) s
  left join merges m on m.a = s.id and m.b = s.after
)
select word, pos, id from state where id >= 0
"""

DECODE = """
select e.word, string_agg(v.chars, '' order by e.pos) as chars
from encoded e join vocabulary v on v.id = e.id group by e.word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, from a tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(a, b, merged): the pair of lower tokens that each token of two or more bytes comes from."""
    rows = []
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            lowest, i = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if lowest >= rank:
                raise ValueError(f"no merges give token {rank}")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            rows.append((ranks[parts[0]], ranks[parts[1]], rank))
    return np.array(rows, np.int32).reshape(-1, 3)


def _wider(spans: list[tuple[int, int]], apart: list[int], length: int) -> list[tuple[int, int]]:
    """``spans`` with one of twice the size in place of each window that has no token in common with the next."""
    wide: list[tuple[int, int]] = []
    for j in apart:
        a, b = spans[j]
        b = min(length, max(spans[j + 1][1], 2 * b - a))
        if wide and a < wide[-1][1]:
            wide[-1] = (wide[-1][0], max(b, wide[-1][1]))
        else:
            wide.append((a, b))
    at = [w[0] for w in wide]
    within = lambda span: (k := bisect.bisect_right(at, span[0]) - 1) >= 0 and span[1] <= wide[k][1]
    return sorted([span for span in spans if not within(span)] + wide)


class Coder:
    """Encodes pieces; ids and decoded bytes of the last ones are kept."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray, pattern: str):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.name = {i: str(i) for i in ranks.values()}
        self.split = splitter(pattern)
        self.known = Recent(CACHE_WORDS)  # tokens, ids as text, decoded bytes
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": "", "preserve_insertion_order": False})
        self.db.execute("create table merges(a int, b int, merged int)")
        self.db.execute("create table vocabulary(id int, chars varchar)")
        self._fill("merges", pa.table({"a": merges[:, 0], "b": merges[:, 1], "merged": merges[:, 2]}))
        # a byte is the character of its number, as varchar is all that string_agg takes
        self._fill("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "chars": [t.decode("latin-1") for t in ranks]}))

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"insert into {name} select * from given")
        self.db.unregister("given")

    def _tokens(self, pieces: list[bytes], query: str = ENCODE) -> tuple[np.ndarray, np.ndarray]:
        """(last byte of each token, tokens) of all pieces, one after another, and each piece's first token."""
        ends, ids, counts, low = [], [], [], 0
        size = np.cumsum([len(p) for p in pieces])
        while low < len(pieces):
            high = min(low + QUERY_WORDS, max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + QUERY_BYTES, "right"))))
            some = pieces[low:high]
            length = np.array([len(r) for r in some])
            data = np.frombuffer(b"".join(some), np.uint8)
            pos = np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)
            self.db.register("tokens", pa.table({"word": np.repeat(np.arange(len(some), dtype=np.int32), length), "pos": pos.astype(np.int32), "id": self.byte[data]}))
            got = self.db.execute(query).fetchnumpy()
            self.db.unregister("tokens")
            # a merged token stands at its last byte
            order = np.lexsort((got["pos"], got["word"]))
            ends.append(got["pos"][order].astype(np.int64)), ids.append(got["id"][order].astype(np.int64))
            counts.append(np.bincount(got["word"], minlength=len(some)))
            low = high
        count = np.concatenate([*counts, np.zeros(0, np.int64)])
        return np.stack([np.concatenate(ends), np.concatenate(ids)], 1) if ends else np.zeros((0, 2), np.int64), np.concatenate([[0], np.cumsum(count)])

    def _long(self, pieces: list[bytes]) -> list[np.ndarray]:
        """(last byte of each token, token) of each piece, from overlapping windows."""
        half = WINDOW // 2
        spans = [[(a, min(a + WINDOW, len(p))) for a in range(0, max(1, len(p) - half), half)] for p in pieces]
        out: list = [None] * len(pieces)
        known: dict = {}
        todo = list(range(len(pieces)))
        while todo:
            new = [(i, a, b) for i in todo for a, b in spans[i] if (i, a, b) not in known]
            for query, some in ((ENCODE, [x for x in new if x[2] - x[1] <= WIDE]), (ENCODE_WIDE, [x for x in new if x[2] - x[1] > WIDE])):
                tokens, first = self._tokens([pieces[i][a:b] for i, a, b in some], query)
                for k, (i, a, b) in enumerate(some):
                    known[i, a, b] = tokens[first[k] : first[k + 1]] + [a, 0]
            left = []
            for i in todo:
                parts, apart = [known[i, *spans[i][0]]], []
                for j, span in enumerate(spans[i][1:]):
                    last, part = parts[-1], known[i, *span]
                    same = np.intersect1d((last[:, 0] << 32) + last[:, 1], (part[:, 0] << 32) + part[:, 1], assume_unique=True)
                    if len(same):
                        end = same[len(same) // 2] >> 32
                        parts[-1], part = last[last[:, 0] <= end], part[part[:, 0] > end]
                    else:
                        apart.append(j)
                    parts.append(part)
                if apart:
                    spans[i] = _wider(spans[i], apart, len(pieces[i]))
                    left.append(i)
                else:
                    out[i] = np.concatenate(parts)
            todo = left
        return out

    def learn(self, pieces: set[str]) -> None:
        new = self.known.missing(pieces)
        new.sort(key=len)  # pieces of a query take about as many steps
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        long_ = [i for i, r in enumerate(raw) if len(r) > LONG]
        order = short + long_
        tokens, first = self._tokens([raw[i] for i in short])
        flat, count = [tokens[:, 1]], [np.diff(first)]
        for found in self._long([raw[i] for i in long_]):
            flat.append(found[:, 1]), count.append(np.array([len(found)]))
        flat, count = np.concatenate(flat).astype(np.int32), np.concatenate(count)
        last = np.cumsum(count)
        low = 0
        while low < len(new):
            # the tokens of some pieces, those of one at least
            high = max(low + 1, int(np.searchsorted(last, last[low] + QUERY_BYTES)))
            begin, end = last[low] - count[low], last[high - 1]
            own, n = flat[begin:end], count[low:high]
            start = np.cumsum(n) - n
            pos = np.arange(len(own)) - np.repeat(start, n)
            self.db.register("encoded", pa.table({"word": np.repeat(np.arange(low, high, dtype=np.int32), n), "pos": pos.astype(np.int32), "id": own}))
            name = self.name
            ids = [name[i] for i in own.tolist()]
            start, n = start.tolist(), n.tolist()
            for word, chars in self.db.execute(DECODE).fetchall():
                i = word - low
                self.known[new[order[word]]] = (n[i], " ".join(ids[start[i] : start[i] + n[i]]), chars.encode("latin-1"))
            self.db.unregister("encoded")
            low = high

    def encode(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, bytes]]:
        """(tokens, ids joined by spaces, bytes decoded from the ids) of each text."""
        split = self.split(texts, data, offsets)
        self.learn(set().union(*split) if split else set())
        get = self.known.__getitem__
        out = []
        for pieces in split:
            if pieces:
                n, ids, raw = zip(*map(get, pieces), strict=True)
                out.append((sum(n), " ".join(ids), b"".join(raw)))
            else:
                out.append((0, "", b""))
        return out


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    ranks, merges, pattern = shared.value
    key = hash((len(ranks), pattern, merges.tobytes()))
    if key not in _coders:
        _coders[key] = Coder(ranks, merges, pattern)
    return _coders[key]


def _runner(shared, digests: bool):
    def run(batches):
        coder = _coder(shared)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for row, end, data, offsets in chunked(batch.column(1)):
                texts = ["" if t is None else t for t in batch.column(1).slice(row, end - row).to_pylist()]
                coded = coder.encode(texts, data, offsets)
                columns = [batch.column(0).slice(row, end - row), pa.array([n for n, _, _ in coded], pa.int64())]
                if digests:
                    columns += [pa.array([sha(ids.encode()) for _, ids, _ in coded], pa.string()), pa.array([sha(raw) for _, _, raw in coded], pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    first = np.concatenate([[0], np.cumsum([n for n, _, _ in coded])]).astype(np.int32)
                    flat = np.array(" ".join(ids for _, ids, _ in coded if ids).split(), np.int32)
                    columns += [pa.ListArray.from_arrays(first, flat), pa.array([raw for _, _, raw in coded], pa.binary())]
                    names = ["doc_id", "n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs``; ``decoded`` are the bytes that the ids stand for.

    With ``digests``: (doc_id, n_tokens, ids_sha256, decoded_sha256) instead, the
    SHA-256 of the ids joined by spaces and of the decoded bytes.  The vocabulary,
    of about a megabyte, goes to every executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks), pattern))
    kind = "doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    return only(docs, doc_id="bigint", text="string").mapInArrow(_runner(shared, digests), kind)


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and splitting pattern of an installed public vocabulary."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_ranks(), digests=True)


def round_trip_query(spark, sf_dir: str) -> DataFrame:
    """SHA-256 of the bytes decoded from the ids of each document."""
    return query(spark, sf_dir).select("doc_id", "decoded_sha256")


#: The same of the texts themselves, in DuckDB.
ROUND_TRIP_ORACLE = "select doc_id, sha256(coalesce(text, '')) as decoded_sha256 from documents"

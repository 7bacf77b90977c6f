"""Exact token counts of every prefix of a text, by dynamic programming.

Byte-level BPE has one last token for every prefix of a piece: the token t that
ends the prefix and whose left neighbour, the last token of the shorter prefix,
stays apart from t when both are encoded together.  So with last tokens known for
shorter prefixes, count(prefix) = count(prefix without t) + 1.  The programme
runs over all distinct pieces of a batch at once, position by position.

A text's counts are kept as one signed byte per character: by how much the count
of the prefix that ends there differs from that of the prefix one shorter.  Sums
of these answer how many tokens a prefix has, and which prefix fits a budget,
without encoding again (``tokens_at``, ``longest_prefix``).

Null texts are empty and have no tokens.  A special string inside a text is one
token, as the tokenizers library has it by default; inside a prefix that ends
within the string, its characters are ordinary.  Rows are handled one by one,
whatever their ids, so repeated rows and null ids come out as they come in.  Very
long texts are counted whole.  An empty table gives an empty result; extra columns
are left out at the scan, whatever their names.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.bytewords import chunked
from palimpsest.llm.common import give_back, only
from palimpsest.llm.pretokens import Recent, splitter

#: Distinct pieces whose counts a worker keeps between batches.
CACHE_WORDS = 200_000
LIMIT = 512


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of byte-level BPE."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


class _Pairs:
    """A map of pairs of token numbers (below 2^20) to numbers, for arrays."""

    BITS = 22

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        key = (left.astype(np.int64) << 20) | right
        order = np.argsort(key, kind="stable")
        self.key, self.value = key[order], value[order].astype(np.int64)
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self._slot(self.key)] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, or -1."""
        key = (left << 20) | right
        out = np.full(len(key), -1, np.int64)
        some = np.flatnonzero(self.maybe[self._slot(key)])
        if len(some):
            at = np.minimum(np.searchsorted(self.key, key[some]), len(self.key) - 1)
            good = self.key[at] == key[some]
            out[some[good]] = self.value[at[good]]
        return out


class PrefixCounter:
    """Counts of tokens for every prefix, for the vocabulary and merges of a tokenizers JSON file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        code = {c: b for b, c in enumerate(byte_characters())}
        token = [bytes([b]) for b in range(256)]
        number = {t: b for b, t in enumerate(token)}
        left, right = list(range(256)), list(range(256))
        for pair in model["merges"]:
            a, b = (bytes(code[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            if a + b in number:
                raise ValueError("two merges give the same token")
            number[a + b] = len(token)
            left.append(number[a])
            right.append(number[b])
            token.append(a + b)
        self.left, self.right = np.array(left), np.array(right)
        merged = np.arange(256, len(token))
        self.pairs = _Pairs(self.left[256:], self.right[256:], merged)
        self.memo_key = np.full(1 << 20, -1, np.int64)
        self.memo = np.zeros(1 << 20, bool)
        self._trie(token)

    def _trie(self, token: list[bytes]) -> None:
        """Tokens by their bytes from the last to the first."""
        child: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, t in enumerate(token):
            node = 0
            for b in reversed(t):
                node = child.setdefault((node, b), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends)
        self.first = np.zeros(256, np.int64)
        for b in range(256):
            self.first[b] = child[0, b]
        parent, byte, node = (np.array(x) for x in zip(*((p, b, n) for (p, b), n in child.items()), strict=True))
        self.child = _Pairs(parent, byte, node)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b stay as they are when their bytes are encoded together.

        Undoes the merges of both from the latest; were a merge across the border
        to come before the merge that was undone last, it would have happened.
        """
        key = (a << 20) | b
        slot = ((key.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)
        known = self.memo_key[slot] == key
        out = self.memo[slot]
        live = np.flatnonzero(~known)
        if len(live):
            fresh, one, two = live, a[live], b[live]
            limit = np.full(len(live), 1 << 40)
            out[live] = True
            while len(live):
                across = self.pairs.get(one, two)
                joined = (across >= 0) & (across < limit)
                out[live[joined]] = False
                live, one, two, limit = live[~joined], one[~joined], two[~joined], limit[~joined]
                later = np.maximum(one, two)  # a byte was never merged
                open_ = later >= 256
                live, one, two, limit, later = live[open_], one[open_], two[open_], limit[open_], later[open_]
                # of two equal tokens the right one merged last
                of_one = one > two
                limit = np.where(of_one, one, two + 1)
                one, two = np.where(of_one, self.right[one], one), np.where(of_one, two, self.left[two])
            self.memo_key[slot[fresh]] = key[fresh]
            self.memo[slot[fresh]] = out[fresh]
        return out

    def counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of the prefix that ends with each byte, each piece's first byte in this array)."""
        length = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-length, kind="stable")
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(len(data)) - np.repeat(start[:-1], length)  # position within the piece
        # tokens that end at each position, from short to long
        live, node, depth = np.arange(len(data)), self.first[data], 1
        found = []
        while len(live):
            token = self.ends[node]
            hit = token >= 0
            found.append((live[hit], token[hit], depth))
            more = at[live] >= depth
            live, node = live[more], node[more]
            node = self.child.get(node, data[live - depth])
            live, node = live[node >= 0], node[node >= 0]
            depth += 1
        last = np.zeros(len(data), np.int64)
        count = np.zeros(len(data), np.int64)
        place = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        token = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        size = np.concatenate([np.full(len(f[0]), f[2]) for f in found]) if found else np.zeros(0, np.int64)
        # by position within the piece, then place, then the longest first
        by = np.lexsort((-size, place, at[place]))
        place, token, size = place[by], token[by], size[by]
        step = np.searchsorted(at[place], np.arange(int(length.max(initial=0)) + 1))
        for p in range(len(step) - 1):
            spot, tok, wide = (x[step[p] : step[p + 1]] for x in (place, token, size))
            new = np.ones(len(spot), bool)
            new[1:] = spot[1:] != spot[:-1]
            try_ = np.flatnonzero(new)
            end = np.append(try_[1:], len(spot))
            while len(try_):
                where, t, w = spot[try_], tok[try_], wide[try_]
                whole = w == p + 1
                before = where - w
                good = whole.copy()
                rest = np.flatnonzero(~whole)
                good[rest] = self.apart(last[before[rest]], t[rest])
                last[where[good]] = t[good]
                count[where[good]] = np.where(whole[good], 1, count[np.maximum(before[good], 0)] + 1)
                try_, end = try_[~good] + 1, end[~good]
                if len(try_) and (try_ >= end).any():
                    raise ValueError("a token that its own bytes don't give")
        return count, start


def _signed(change: np.ndarray) -> bytes:
    """Changes as signed bytes; no byte-level vocabulary with tokens of less than 127 bytes needs more."""
    if len(change) and np.abs(change).max() > 127:
        raise ValueError("counts of two neighbouring prefixes differ by more than 127")
    return change.astype(np.int8).tobytes()


_counters: dict[int, tuple] = {}


class TextCounter:
    """Changes of the count at each character of whole texts."""

    def __init__(self, raw: bytes, pattern: str):
        self.counter = PrefixCounter(raw)
        self.split = splitter(pattern)
        self.cache = Recent(CACHE_WORDS)

    def learn(self, pieces: set[str]) -> None:
        new = self.cache.missing(pieces)
        if not new:
            return
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        count, start = self.counter.counts(raw)
        data = np.frombuffer(b"".join(raw), np.uint8)
        final = np.append((data[1:] & 0xC0) != 0x80, True)  # last bytes of characters
        kept = count[final]
        first = np.concatenate([[0], np.cumsum(final)])[start]
        change = np.diff(kept, prepend=0)
        change[first[:-1]] = kept[first[:-1]]
        flat = _signed(change)
        for i, p in enumerate(new):
            self.cache[p] = flat[first[i] : first[i + 1]]

    def changes(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        special = [any(s in t for s in self.counter.specials) for t in texts]
        split = self.split(texts, data, offsets)
        self.learn(set().union(*split) if split else set())
        get = self.cache.__getitem__
        out = []
        for text, pieces, odd in zip(texts, split, special, strict=True):
            if odd:
                out.append(self._special(text))
            else:
                out.append(self._mend(pieces, b"".join(map(get, pieces))))
        return out

    def _mend(self, pieces: list[str], change: bytes) -> bytes:
        """Prefixes that end within a piece whose prefix is split otherwise: runs of white space, contractions."""
        odd = [i for i, p in enumerate(pieces[:-1]) if p.isspace() and pieces[i + 1][0].isspace()]
        odd += [i for i, p in enumerate(pieces) if p in ("'re", "'ve", "'ll")]
        if not odd:
            return change
        base = np.frombuffer(change, np.int8).astype(np.int64)
        array = base.copy()
        end = np.cumsum([len(p) for p in pieces])
        extra = {pieces[i] + pieces[i + 1][0] for i in odd if pieces[i][0] != "'"} | {pieces[i + 1][0] for i in odd if pieces[i][0] != "'"} | {"'", "r", "v", "l"}
        total = {p: int(c[-1]) for p, c in self._exact(extra).items()}.__getitem__
        for i in odd:
            p = pieces[i]
            if p[0] == "'":
                # the prefix 'r is no contraction yet: two pieces
                at, off = end[i] - 2, total("'") + total(p[1]) - int(base[end[i] - 3] + base[end[i] - 2])
            else:
                # the run is one piece as long as nothing follows it
                run = p + pieces[i + 1][0]
                at, off = end[i], total(run) - int(base[end[i] - len(p) : end[i]].sum()) - int(base[end[i]])
            if off:
                array[at] += off
                if at + 1 < len(array):
                    array[at + 1] -= off
        return _signed(array)

    def _exact(self, pieces: set[str]) -> dict[str, np.ndarray]:
        """Counts after each byte of the pieces."""
        pieces = sorted(pieces)
        count, start = self.counter.counts([p.encode("utf-8", "surrogatepass") for p in pieces])
        return {p: count[start[i] : start[i + 1]] for i, p in enumerate(pieces)}

    def _special(self, text: str) -> bytes:
        """Segments between special strings; each special string is one token once it is complete."""
        out, low = [], 0
        while low < len(text):
            near = [(text.find(s, low), -len(s), s) for s in self.counter.specials if s in text[low:]]
            if not near:
                out.append(self._plain(text[low:]))
                break
            at, _, s = min(near)
            plain = np.frombuffer(self._plain(text[low : at + len(s)]), np.int8).astype(np.int64)
            before = int(np.frombuffer(self._plain(text[low:at]), np.int8).astype(np.int64).sum())
            plain[-1] = before + 1 - int(plain[:-1].sum())
            out.append(_signed(plain))
            low = at + len(s)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        pieces = self.split([text], raw, np.array([0, len(raw)]))[0]
        self.learn(set(pieces))
        return self._mend(pieces, b"".join(self.cache[p] for p in pieces))


def tokens_at(changes: bytes, characters: int) -> int:
    """Tokens of the prefix of so many characters."""
    return int(np.frombuffer(changes[:characters], np.int8).sum(dtype=np.int64))


def longest_prefix(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _runner(shared, limit: int, keep: bool):
    def run(batches):
        raw, pattern = shared.value
        key = hash((raw, pattern))
        if key not in _counters:
            _counters[key] = TextCounter(raw, pattern)
        counter = _counters[key]
        for batch in batches:
            for row, end, data, offsets in chunked(batch.column(1)):
                texts = ["" if t is None else t for t in batch.column(1).slice(row, end - row).to_pylist()]
                changes = counter.changes(texts, data, offsets)
                flat, where = np.frombuffer(b"".join(changes), np.int8), np.concatenate([[0], np.cumsum([len(c) for c in changes])])
                running = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
                total = running[where[1:]] - running[where[:-1]]
                fit = [len(c) if n <= limit else longest_prefix(c, limit) for c, n in zip(changes, total.tolist(), strict=True)]
                columns = [batch.column(0).slice(row, end - row), pa.array(np.diff(offsets)), pa.array(total), pa.array(total > limit), pa.array(fit, pa.int64())]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"]
                if keep:
                    columns, names = [*columns, pa.array(changes, pa.binary())], [*names, "changes"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return run


def prefix_counts(docs: DataFrame, tokenizer: bytes, pattern: str, limit: int = LIMIT, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fitting_chars[, changes]) of every row of ``docs``.

    fitting_chars is the length in characters of the longest prefix of at most
    ``limit`` tokens; changes has the counts of all prefixes (see ``tokens_at``).
    ``tokenizer`` is the content of the JSON file, of a few megabytes; it goes to
    every executor.
    """
    kind = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fitting_chars bigint" + ", changes binary" * keep
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, pattern))
    return only(docs, doc_id="bigint", text="string").mapInArrow(_runner(shared, limit, keep), kind)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        raw = file.read()
    return prefix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), raw, public_tokenizers.PATTERN, keep=False)

"""Near-duplicate vectors through a robust-pruned flat graph.

Vectors are compared only within a label.  Equal vectors form a class and count
as one node.  A label of more than ``SHARD`` classes is cut into cells by
centroids fitted on a bounded sample; each vector goes to its nearest centroid's
cell, its home, and to every other whose border with the home is within a margin.
Each vector is searched in its home shard, so no link has to be sent between tasks
as a pair.  The margin is what linked vectors need: a sample of classes is compared
with all rows of their label by brute force, and the farthest that one of their links
lies beyond a border is taken with a quarter more.  (The threshold's whole angle
can't be crossed by any link, but in many dimensions hardly a link goes straight for
a border, and at that margin most vectors would be in most cells.)

In each shard every node gets its nearest neighbours, robustly pruned: a
neighbour is left out if a kept one is closer to it by the factor ``ALPHA``.  Where
a group has more close members than a node has candidates, these alone leave its
parts apart, so the edges of the shard's tree of greatest cosines are added, along
which rows that a chain of links joins reach each other over links.  All vectors
then search their home shard's graph: greedily from the shard's medoid and from
their own nodes with a frontier of ``beam`` nodes, then on from every node met that
lies near the range until no more are met.  Whatever is found is verified with
cosines in double precision.

Only the nodes at home in a shard have candidates of their own in it, as only these
are searched; the others hang on their edges.  A shard of more than ``WHOLE`` times
``PART`` nodes is dealt out: its graph is the union of graphs
of overlapping parts (each node is in two, by hash), and its vectors search in as
many tasks.  Only counts and at most one tree edge per node and task leave a task.

Shards are worked off in rounds of at most ``ROUND`` members per class, whose files
are deleted before the next: however many cells a vector is in, the disk in use stays
in proportion to the input.

Every run is audited: the links of another fixed sample of classes are counted by
brute force over all rows of their label.  Below ``RECALL`` the graphs are built and
searched again with more candidates, a wider range and a wider margin, at last the
threshold's angle; if the widest search stays below ``LEAST_RECALL``, an error is raised.

A vector that is null, zero, or holds null or non-finite components, or whose
label is null, links with nothing.  Vectors of different lengths link with
nothing.  Repeated rows count as copies.  A row with a null vec_id counts as a
copy or a link of others, has no component of its own and names none.  Float
columns stay floats, all others become doubles; cosines are in double precision
either way.  Long vectors need memory in proportion, nothing else.  An empty table
gives an empty result.  Extra columns are left out at the scan, whatever their names.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytewords import mix
from palimpsest.llm.common import components, discard, stored

THRESHOLD = 0.98
SHARD = 1_500
#: Nodes whose graph one task builds, and whose searches one task runs.
PART = 6_000
#: Parts up to which a shard stays whole: members that are at home elsewhere cost little.
WHOLE = 4
ALPHA = 1.2
DEGREE = 24
#: (candidates of a node, nodes in a search's frontier, cosine below the threshold down to which it goes on), widening.
EFFORTS = ((64, 32, 0.08), (160, 96, 0.2), (400, 256, 0.5))
#: Vectors in the sample that centroids are fitted on, over all labels, and classes in an audit and in the sample for the margin.
FIT_ROWS = 60_000
AUDIT_ROWS, MARGIN_ROWS = 512, 4_096
#: Links below which the sample for the margin says too little.
MARGIN_LINKS = 100
#: Members that are sent to shards in a round, for each class; at least ``LEAST_ROUND``.
ROUND, LEAST_ROUND = 2, 20_000
RECALL, LEAST_RECALL = 0.99, 0.9


def _units(kind: np.dtype):
    """A key of (label, vector) and the vector for each row; both null for what links with nothing."""
    bits = np.uint32 if kind == np.float32 else np.uint64

    def run(batches):
        for batch in batches:
            label, column = batch.column(1), batch.column(2)
            name = label.fill_null(0).to_numpy().astype(np.int64)
            length = np.where(label.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), 0)
            place, key, dims, units, count = np.full(len(name), -1), np.zeros(len(name), np.int64), np.zeros(len(name), np.int32), [], 0
            for d in np.unique(length[length > 0]).tolist():
                own = np.flatnonzero(length == d)
                array = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d) + kind.type(0)  # -0 is 0, null is NaN
                good = np.isfinite(array).all(1) & array.any(1)
                own, array = own[good], array[good]
                with np.errstate(over="ignore"):
                    mixed = mix(array.view(bits).astype(np.uint64) + np.arange(1, d + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(1, dtype=np.uint64) + (name[own] % (1 << 32)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                place[own], key[own], dims[own] = np.arange(count, count + len(own)), mix(mixed).view(np.int64), d
                units.append(pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * d), pa.array(array.ravel())))
                count += len(own)
            none = place < 0
            unit = pa.concat_arrays([pa.array([], pa.list_(pa.from_numpy_dtype(kind))), *units]).take(pa.array(place, mask=none))
            yield pa.RecordBatch.from_arrays([batch.column(0), label, pa.array(key, mask=none), pa.array(dims, mask=none), unit], names=["vec_id", "label", "key", "dims", "unit"])

    return run


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions by spherical k-means."""
    rng = np.random.default_rng(5)
    found = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(sample @ found.T, 1)
        total = np.zeros_like(found)
        np.add.at(total, own, sample)
        size = np.sqrt((total**2).sum(1, keepdims=True))
        found = np.where(size > 0, total / np.where(size > 0, size, 1), found)
    return np.unique(found, axis=0)


def _dots(one: np.ndarray, two: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows i of ``one`` with rows j of ``two``, each the same in whatever batch it is."""
    return np.concatenate([np.einsum("ij,ij->i", one[i[k : k + 50_000]], two[j[k : k + 50_000]]) for k in range(0, max(1, len(i)), 50_000)])


def cells(units: np.ndarray, table: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) of the cells whose border with the row's home is at most ``margin`` away, the home included, and each row's home."""
    near = units.astype(np.float32) @ table.astype(np.float32).T
    # centroids are at most 2 apart; single precision only leaves out what is clear
    i, j = np.nonzero(near >= near.max(1, keepdims=True) - np.float32(2 * margin + 1e-5))
    near = _dots(units, table, i, j)
    best = np.maximum.reduceat(near, np.searchsorted(i, np.arange(len(units))))
    top = np.flatnonzero(near == best[i])
    home = j[top[np.unique(i[top], return_index=True)[1]]]
    inside = best[i] - near <= margin * _apart(table, home[i], j)
    return i[inside], j[inside], home


def _apart(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of centroids: their border is the plane across the middle of it."""
    return np.sqrt(np.maximum(0, 2 - 2 * _dots(table, table, i, j)))


def _groups(batch: pa.RecordBatch):
    """(label, dims) and the rows of each group of a batch that has these columns."""
    code = batch["label"].to_numpy().astype(np.int64) << 32 | batch["dims"].to_numpy()
    order = np.argsort(code, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(code) else ():
        yield (batch["label"][own[0]].as_py(), batch["dims"][own[0]].as_py()), own


def _placed(batches, table: dict, margin: float):
    """(batch, group, row, cell, is it the home) for each group of each batch, 1,000 rows at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, 1_000):
            part = batch.slice(low, 1_000)
            for name, own in _groups(part):
                if name in table:
                    i, j, home = cells(_matrix(part["unit"].take(pa.array(own))), table[name], margin)
                    yield part, name, own[i], j, home[i] == j
                else:
                    yield part, name, own, np.zeros(len(own), np.int64), np.ones(len(own), bool)


def _counted(nodes: DataFrame, shared, margin: float) -> dict:
    """Members of each shard: {(label, dims): counts}."""

    def run(batches):
        for _, name, _, shard, _ in _placed(batches, shared.value, margin):
            found, n = np.unique(shard, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name[0]] * len(n), pa.int32()), pa.array([name[1]] * len(n), pa.int32()), pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))], names=["label", "dims", "shard", "n"])

    out: dict = {}
    for label, dims, shard, n in nodes.select("label", "dims", "unit").mapInArrow(run, "label int, dims int, shard int, n bigint").groupBy(*BY).agg(F.sum("n")).collect():
        out.setdefault((label, dims), np.zeros(len(shared.value.get((label, dims), [0])), np.int64))[shard] = n
    return out


def _members(nodes: DataFrame, shared, margin: float, turns, turn: int) -> DataFrame:
    """The members of the shards whose turn it is; turns: {(label, dims): turn of each shard}."""

    def run(batches):
        for part, name, row, shard, home in _placed(batches, shared.value, margin):
            now = turns.value[name][shard] == turn
            take = pa.array(row[now])
            yield pa.RecordBatch.from_arrays([*(part[c].take(take) for c in ("rep", "label", "dims", "size", "unit")), pa.array(shard[now].astype(np.int32)), pa.array(home[now])], names=["rep", "label", "dims", "size", "unit", "shard", "home"])

    return nodes.mapInArrow(run, f"rep bigint, label int, dims int, size bigint, unit {nodes.schema['unit'].dataType.simpleString()}, shard int, home boolean")


def _margin(nodes: DataFrame, shared, threshold: float) -> float:
    """How far beyond its home's border a vector must be a member, as far as the links of about ``MARGIN_ROWS`` sampled classes tell."""
    reach = math.sin(math.acos(threshold)) + 1e-9
    if not shared.value:
        return reach
    of = {name: len(table) for name, table in shared.value.items()}
    sample = nodes.filter(F.expr(f"pmod(xxhash64(rep, 5), {max(1, nodes.count() // MARGIN_ROWS)}) = 0")).select("rep", "label", "dims", "unit").toArrow().combine_chunks().to_batches()
    asked = {name: (part["rep"].to_numpy()[own], u := _matrix(part["unit"].take(pa.array(own))), cells(u, shared.value[name], 0)[2]) for part in sample for name, own in _groups(part) if name in of}
    queries = nodes.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for batch in batches:
            for name, own in _groups(batch):
                if name not in queries.value:
                    continue
                (rep, q, there), table = queries.value[name], shared.value[name]
                units = _matrix(batch["unit"].take(pa.array(own)))
                i, j = np.nonzero(units.astype(np.float32) @ q.astype(np.float32).T >= threshold - 1e-6)
                other = batch["rep"].to_numpy()[own][i] != rep[j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                rows, i = np.unique(i, return_inverse=True)
                home, to = cells(units[rows], table, 0)[2], there[j]
                apart = _apart(table, home[i], to)
                need = (_dots(units[rows], table, np.arange(len(rows)), home)[i] - _dots(units[rows], table, i, to)) / np.where(apart > 0, apart, 1)
                yield pa.RecordBatch.from_arrays([pa.array([len(i)], pa.int64()), pa.array([need.max()], pa.float64())], names=["links", "need"])

    links, need = nodes.select("rep", "label", "dims", "unit").mapInArrow(run, "links bigint, need double").agg(F.sum("links"), F.max("need")).first()
    least = 0 if (links or 0) >= MARGIN_LINKS else 3 * reach / math.sqrt(min(d for _, d in of))
    return min(reach, max(1.25 * (need or 0), least) + 1e-9)


def nearest(vectors: np.ndarray, wide: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``wide`` vectors nearest to each of ``rows``, closest first, and their cosines."""
    v = vectors.astype(np.float32)
    wide = min(wide, len(v) - 1)
    place, cosines = np.zeros((len(rows), wide), np.int64), np.zeros((len(rows), wide), np.float32)
    step = max(16, min(512, 3_000_000 // max(1, len(v))))
    for low in range(0, len(rows) if wide else 0, step):
        own = rows[low : low + step]
        cosine = v[own] @ v.T
        cosine[np.arange(len(own)), own] = -2
        np.negative(cosine, out=cosine)
        near = np.argpartition(cosine, wide - 1, axis=1)[:, :wide]
        value = -np.take_along_axis(cosine, near, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        place[low : low + step], cosines[low : low + step] = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
    return place, cosines


def pruned(vectors: np.ndarray, place: np.ndarray, cosines: np.ndarray, listed: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each row after robust pruning of its nearest ones; only neighbours that are ``listed`` themselves make others needless."""
    v, wide = vectors.astype(np.float32), place.shape[1]
    step = max(8, min(512, 2_000_000 // max(1, wide) ** 2))
    out: list[np.ndarray] = []
    for low in range(0, len(place), step):
        near, far = place[low : low + step], np.sqrt(np.maximum(0, 2 - 2 * cosines[low : low + step]))
        alive, kept, count = np.ones(near.shape, bool), np.zeros(near.shape, bool), np.zeros(len(near), int)
        close = v[near]
        between = alpha * np.sqrt(np.maximum(0, 2 - 2 * (close @ close.transpose(0, 2, 1))))
        for r in range(wide):
            take = alive[:, r] & (count < degree)
            kept[take, r] = True
            count += take
            if (count >= degree).all():
                break
            alive[:, r + 1 :] &= (between[:, r, r + 1 :] > far[:, r + 1 :]) | ~(take & listed[near[:, r]])[:, None]
        out += [row[k] for row, k in zip(near, kept, strict=True)]
    return out


def _lowest(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows can reach over the undirected edges."""
    low = np.arange(n)
    while len(one):
        new = low.copy()
        np.minimum.at(new, one, low[two])
        np.minimum.at(new, two, low[one])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def joining(vectors: np.ndarray, place: np.ndarray, cosines: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning tree of ``rows`` and all that they link, in which what a chain of links joins is reached over links.

    From each part the closest row outside is joined, until one part is left: first
    along links among the nearest ones; then along any links of rows with more of
    them than nearest ones are known; then along the nearest ones of all; and at
    last along any pairs.
    """
    n, v = len(vectors), vectors.astype(np.float32)
    more_a, more_b, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(n)

    def join(a, b, cosine):
        """Joins parts along the best of their edges that lead outside, and returns these edges."""
        nonlocal low
        out = np.flatnonzero(low[a] != low[b])
        a, b, cosine = a[out], b[out], cosine[out]
        if not len(out):
            return a, b, cosine
        order = np.lexsort((-cosine, low[a]))
        best = order[np.unique(low[a][order], return_index=True)[1]]
        more_a.append(a[best]), more_b.append(b[best])
        low = _lowest(n, low[a[best]], low[b[best]])[low]
        return a, b, cosine

    own = np.zeros(n, bool)
    own[rows] = True

    def known(some):
        i, j = np.nonzero(some)
        a, b, cosine = rows[i], place[i, j], cosines[i, j]
        if len(rows) < n:  # what isn't among the rows joins as well
            a, b, cosine = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([cosine, cosine])
        while len(a):
            a, b, cosine = join(a, b, cosine)

    def dense(rows, least):
        while (low[rows] != low[rows][:1]).any():
            best, other = np.empty(len(rows), np.float32), np.empty(len(rows), np.int64)
            for k in range(0, len(rows), 512):
                cosine = v[rows[k : k + 512]] @ v[rows].T
                cosine[low[rows[k : k + 512], None] == low[rows][None, :]] = -2
                other[k : k + 512] = np.argmax(cosine, 1)
                best[k : k + 512] = cosine[np.arange(len(cosine)), other[k : k + 512]]
            good = best >= least
            if not good.any() or not len(join(rows[good], rows[other[good]], best[good])[0]):
                break

    known(cosines >= threshold)
    full = rows[cosines[:, -1] >= threshold - 1e-5] if cosines.shape[1] else rows[:0]
    linked = np.zeros(n, bool)
    linked[full] = True
    if len(rows) < n:
        for k in range(0, len(full), 128):
            linked |= (v[full[k : k + 128]] @ v.T >= threshold - 1e-5).any(0)
    dense(np.flatnonzero(linked), threshold - 1e-5)
    known(own[place])
    dense(rows, -1)
    return np.concatenate(more_a), np.concatenate(more_b)


def graph_of(vectors: np.ndarray, threshold: float, wide: int, asks: np.ndarray) -> np.ndarray:
    """Edges of the graph in which those that ask find their links, as from * nodes + to, sorted.

    Nodes that don't ask have the edges of those that do, as all go both ways.
    """
    n, rows = len(vectors), np.flatnonzero(asks)
    if not len(rows):
        return np.zeros(0, np.int64)
    place, cosines = nearest(vectors, wide, rows)
    near = pruned(vectors, place, cosines, asks)
    more_a, more_b = joining(vectors, place, cosines, rows, threshold)
    a, b = np.concatenate([np.repeat(rows, [len(x) for x in near]), more_a]), np.concatenate([*near, more_b])
    return np.unique(np.concatenate([a * n + b, b * n + a]))


def _by_rep(members: pa.Table) -> pa.Table:
    return members.take(pa.array(np.argsort(members["rep"].to_numpy(), kind="stable")))


def _builder(threshold: float, wide: int):
    def run(key, group):
        group = _by_rep(group)
        rep = group["rep"].to_numpy()
        pair = graph_of(_matrix(group["unit"]), threshold, wide, np.ones(len(rep), bool))
        first = np.searchsorted(pair, np.arange(len(rep) + 1) * len(rep)).astype(np.int32)
        label, dims, shard = (pa.array([x.as_py()] * len(rep), pa.int32()) for x in key[:3])
        return pa.table({"label": label, "dims": dims, "shard": shard, "rep": rep, "near": pa.ListArray.from_arrays(pa.array(first), pa.array(rep[pair % len(rep)]))})

    return run


class Graph:
    """Unit vectors and the places of their neighbours, those of node i from first[i] to first[i + 1]."""

    def __init__(self, vectors: np.ndarray, first: np.ndarray, near: np.ndarray):
        self.vectors, self.first, self.near = vectors.astype(np.float32), first, near
        held = np.flatnonzero(np.diff(first)) if len(near) else np.arange(len(vectors))
        self.medoid = int(held[np.argmax(self.vectors[held] @ self.vectors[held].mean(0))]) if len(vectors) else 0

    def _met(self, q: np.ndarray, node: np.ndarray, seen: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Neighbours of the (query, node) pairs that are new to their query, as query * nodes + node, each once."""
        count = self.first[node + 1] - self.first[node]
        at = np.arange(count.sum()) + np.repeat(self.first[node] - (np.cumsum(count) - count), count)
        flat = np.repeat(q, count) * len(self.vectors) + self.near[at]
        flat = flat[~seen[flat]]
        turn = np.arange(len(flat), dtype=np.int32)
        tag[flat] = turn
        flat = flat[tag[flat] == turn]
        seen[flat] = True
        return flat

    def search(self, queries: np.ndarray, reach: float, beam: int):
        """(query, node, cosine) of all nodes met with cosine >= ``reach``, a block of queries at a time.

        A query first expands the closest node of its frontier, the ``beam`` closest
        met so far, until all of these are expanded; then all met within reach, and
        those met from them.
        """
        n, v = len(self.vectors), self.vectors
        step = max(8, min(1024, 3_000_000 // max(1, n)))
        for low in range(0, len(queries), step):
            own = queries[low : low + step]
            rows = np.arange(len(own))
            seen, tag = np.zeros(len(own) * n, bool), np.zeros(len(own) * n, np.int32)
            node, value = np.full((len(own), beam), -1), np.full((len(own), beam), -2, np.float32)
            node[:, 0], value[:, 0] = own, 1
            node[:, 1], value[:, 1] = self.medoid, np.where(own == self.medoid, -2, v[own] @ v[self.medoid])
            seen[rows * n + own] = seen[rows * n + self.medoid] = True
            todo = value > -2
            kept, cosines = [rows * n + own, rows * n + self.medoid], [value[:, 0].copy(), value[:, 1].copy()]
            active = rows
            while len(active):
                score = np.where(todo[active], value[active], -2)
                best = np.argmax(score, 1)
                go = score[np.arange(len(active)), best] > -2
                active, best = active[go], best[go]
                if not len(active):
                    break
                todo[active, best] = False
                flat = self._met(active, node[active, best], seen, tag)
                q, new = flat // n, flat % n
                cosine = np.einsum("ij,ij->i", v[own[q]], v[new])
                kept.append(flat), cosines.append(cosine)
                # the new nodes beside the old frontier, and the closest of them all
                count = np.bincount(q, minlength=len(own))[active]
                wide = int(count.max(initial=0))
                if not wide:
                    continue
                place = np.searchsorted(active, q), beam + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
                all_value, all_node, all_todo = (np.full((len(active), beam + wide), fill, kind) for fill, kind in ((-2, np.float32), (-1, np.int64), (False, bool)))
                all_value[:, :beam], all_node[:, :beam], all_todo[:, :beam] = value[active], node[active], todo[active]
                all_value[place], all_node[place], all_todo[place] = cosine, new, True
                top = np.argpartition(-all_value, beam - 1, axis=1)[:, :beam]
                value[active], node[active], todo[active] = (np.take_along_axis(x, top, 1) for x in (all_value, all_node, all_todo))
            kept, cosines = np.concatenate(kept), np.concatenate(cosines)
            near = cosines >= reach
            front = kept[near]
            kept, cosines = [front], [cosines[near]]
            while len(front):
                after = []
                for k in range(0, len(front), 50_000):
                    part = front[k : k + 50_000]
                    flat = self._met(part // n, part % n, seen, tag)
                    cosine = np.concatenate([np.einsum("ij,ij->i", v[own[flat[j : j + 200_000] // n]], v[flat[j : j + 200_000] % n]) for j in range(0, max(1, len(flat)), 200_000)])
                    near = cosine >= reach
                    after.append(flat[near]), kept.append(flat[near]), cosines.append(cosine[near])
                front = np.concatenate(after)
            kept = np.concatenate(kept)
            yield own[kept // n], kept % n, np.concatenate(cosines)


LINKS = "rep bigint, links bigint, root bigint"


def _answers(members: pa.Table, vectors: np.ndarray, pair: np.ndarray, asks: np.ndarray, threshold: float, beam: int, slack: float) -> pa.Table:
    """(rep, links, root) of the members that ask, and of those that they link."""
    rep, size, n = members["rep"].to_numpy(), members["size"].to_numpy(), len(members)
    graph = Graph(vectors, np.searchsorted(pair, np.arange(n + 1) * n), pair % n)
    links, low = np.zeros(n, np.int64), np.arange(n)
    for q, other, cosine in graph.search(np.flatnonzero(asks), threshold - slack, beam):
        keep = (q != other) & (cosine > threshold - 1e-4)
        q, other, cosine = q[keep], other[keep], cosine[keep]
        # single precision decides what is clear, double precision the rest
        close = np.flatnonzero(cosine < threshold + 1e-4)
        good = np.ones(len(q), bool)
        for k in range(0, len(close), 100_000):
            some = close[k : k + 100_000]
            good[some] = (vectors[q[some]] * vectors[other[some]]).sum(1) >= threshold
        q, other = q[good], other[good]
        links += np.bincount(q, size[other], n).astype(np.int64)
        low = _lowest(n, np.concatenate([low[q], np.arange(n)]), np.concatenate([low[other], low]))
    touched = np.flatnonzero(asks | (low != np.arange(n)))
    return pa.table({"rep": rep[touched], "links": links[touched], "root": rep[low[touched]]})


def _solver(threshold: float, wide: int, beam: int, slack: float):
    """Builds and searches the graph of a whole shard."""

    def run(key, members):
        members = _by_rep(members)
        vectors, asks = _matrix(members["unit"]), members["home"].to_numpy()
        return _answers(members, vectors, graph_of(vectors, threshold, wide, asks), asks, threshold, beam, slack)

    return run


def _searcher(threshold: float, beam: int, slack: float):
    """Searches a shard's graph for one part of its members."""

    def run(key, members, lists):
        members = _by_rep(members)
        rep, n = members["rep"].to_numpy(), len(members)
        # each node's united list
        column = lists["near"].combine_chunks()
        owner = np.repeat(np.searchsorted(rep, lists["node"].to_numpy()), np.diff(column.offsets.to_numpy()))
        pair = np.unique(owner * n + np.searchsorted(rep, column.flatten().to_numpy()))
        return _answers(members, _matrix(members["unit"]), pair, members["asks"].to_numpy(), threshold, beam, slack)

    return run


def _audited(classes: DataFrame, links: DataFrame, threshold: float, rows: int = AUDIT_ROWS) -> float | None:
    """Share of the links of about ``rows`` sampled classes, by brute force over all classes, that ``links`` (rep, links) counts."""
    spark = classes.sparkSession
    total = classes.count()
    sample = classes.filter("rep is not null").filter(F.expr(f"pmod(xxhash64(rep, 3), {max(1, total // rows)}) = 0")).select("rep", "label", "dims", "unit").toArrow()
    groups: dict = {}
    for i, name in enumerate(zip(sample["label"].to_pylist(), sample["dims"].to_pylist(), strict=True)):
        groups.setdefault(name, []).append(i)
    reps = sample["rep"].to_numpy()
    shared = spark.sparkContext.broadcast({name: (reps[own], _matrix(sample["unit"].take(pa.array(own)))) for name, own in groups.items()})

    def count(batches):
        queries = shared.value
        for batch in batches:
            label, dims = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            size = batch.column(3).to_numpy()
            group = list(zip(label, dims, strict=True))
            for name in sorted(set(group) & set(queries)):
                own = np.array([i for i, g in enumerate(group) if g == name])
                near = _matrix(batch.column(4).take(pa.array(own))) @ queries[name][1].T >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(queries[name][0]), pa.array(size[own] @ near.astype(np.int64))], names=["rep", "n"])

    own = classes.select(F.col("rep").alias("own"), F.col("size").alias("own_size"))
    true = classes.filter("rep is not null").select("rep", "label", "dims", "size", "unit").mapInArrow(count, "rep bigint, n bigint").groupBy("rep").agg(F.sum("n").alias("n"))
    true = true.join(own, true["rep"] == own["own"]).select("rep", (F.col("n") - F.col("own_size")).alias("n"))
    seen = true.join(links, "rep", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0))))).first()
    return seen[1] / seen[0] if seen[0] else None


BY = ["label", "dims", "shard"]


def _parted(members: DataFrame) -> DataFrame:
    """``members`` with the number of parts that their shard is dealt to, and their own."""
    sizes = members.groupBy(*BY).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    return members.join(sizes, BY).withColumn("own_part", F.expr("pmod(xxhash64(rep, 11), parts)").cast("int"))


def _lists(members: DataFrame, threshold: float, wide: int) -> DataFrame:
    """(label, dims, shard, rep, near): the united adjacency list of each node."""
    two = F.expr("pmod(own_part + 1 + pmod(xxhash64(rep, 13), parts - 1), parts)").cast("int")
    part = F.explode(F.when(F.col("parts") > 1, F.array("own_part", two)).otherwise(F.array(F.lit(0)))).alias("part")
    lists = _parted(members).select("rep", "unit", *BY, part).groupBy(*BY, "part").applyInArrow(_builder(threshold, wide), "label int, dims int, shard int, rep bigint, near array<bigint>")
    # at most the lists of the two parts that a node is in meet in a group
    return lists.groupBy(*BY, "rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _linked(members: DataFrame, lists: DataFrame, threshold: float, beam: int, slack: float, low: int, high: int) -> DataFrame:
    """(rep, links, root) of the vectors of parts ``low`` to ``high`` by searches of the given effort; several rows of a class where several tasks met it."""
    slots = F.explode(F.expr(f"filter(sequence(0, parts - 1), x -> x between {low} and {high})")).alias("part")
    members = _parted(members)
    asking = members.select("rep", "size", "unit", "home", "own_part", *BY, slots).withColumn("asks", F.expr("home and part = own_part"))
    spread = members.select("rep", *BY, slots).join(lists, [*BY, "rep"]).select(*[F.col(c).alias(f"own_{c}") for c in [*BY, "part"]], F.col("rep").alias("node"), "near")
    return asking.select("rep", "size", "unit", "asks", *BY, "part").groupBy(*BY, "part").cogroup(spread.groupBy(*[f"own_{c}" for c in [*BY, "part"]])).applyInArrow(_searcher(threshold, beam, slack), LINKS)


def rounds(counts: dict, most: int) -> tuple[dict, list[int], int]:
    """The turn of each shard, members of each turn, and the turns of whole shards, before those of shards that are dealt out.

    No turn has more than ``most`` members, unless a shard alone has.
    """
    turns, total = {name: np.zeros(len(n), np.int64) for name, n in counts.items()}, [0]
    whole = 0
    for dealt in (False, True):
        for name in sorted(counts):
            for shard in np.flatnonzero((counts[name] > WHOLE * PART) == dealt).tolist():
                n = int(counts[name][shard])
                if total[-1] and total[-1] + n > most:
                    total.append(0)
                turns[name][shard] = len(total) - 1
                total[-1] += n
        if not dealt:
            whole = len(total)
            total.append(0)
    return turns, total, whole


def _searched(nodes: DataFrame, shared, margin: float, most: int, threshold: float, effort: tuple) -> list[DataFrame]:
    """Stored tables (rep, links, root) of all shards, round by round."""
    wide, beam, slack = effort
    counts = _counted(nodes, shared, margin)
    plan, total, whole = rounds(counts, most)
    turns = nodes.sparkSession.sparkContext.broadcast(plan)
    found = []
    for turn, n in enumerate(total):
        members = _members(nodes, shared, margin, turns, turn)
        if not n:
            continue
        if turn < whole:
            found.append(stored(members.groupBy(*BY).applyInArrow(_solver(threshold, wide, beam, slack), LINKS)))
            continue
        members = stored(members)
        lists = stored(_lists(members, threshold, wide))
        parts = max(math.ceil(int(c) / PART) for name in counts for c in counts[name][plan[name] == turn])
        step = max(1, most // n)
        for low in range(0, parts, step):
            found.append(stored(_linked(members, lists, threshold, beam, slack, low, low + step - 1)))
        discard(members, lists)
    return found


def _found(embeddings: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(vec_id, key) of the rows, (key, rep, size) of the classes, (rep, links) and (rep, root)."""
    spark = embeddings.sparkSession
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    real, kind = ("float", np.dtype(np.float32)) if single else ("double", np.dtype(np.float64))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast(f"array<{real}>").alias("embedding"))
    keyed = stored(rows.mapInArrow(_units(kind), f"vec_id bigint, label int, key bigint, dims int, unit array<{real}>"))
    classes = keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("unit").alias("unit"))
    classes, ids = stored(classes), stored(keyed.select("vec_id", "key"))
    discard(keyed)
    nodes = classes.filter("rep is not null").select("rep", "label", "dims", "size", "unit")

    # labels that need several shards, and centroids for them
    large = {(r[0], r[1]): r[2] for r in nodes.groupBy("label", "dims").count().filter(F.col("count") > SHARD).collect()}
    table = {}
    if large:
        every = max(1, sum(large.values()) // FIT_ROWS)
        sample = nodes.filter(F.expr(f"pmod(xxhash64(rep), {every}) = 0")).select("label", "dims", "unit").toArrow()
        label, dims = sample["label"].to_numpy(), sample["dims"].to_numpy()
        for name, n in large.items():
            own = np.flatnonzero((label == name[0]) & (dims == name[1]))
            if len(own):
                table[name] = centroids(_matrix(sample["unit"].take(pa.array(own))), math.ceil(n / SHARD))
    shared = spark.sparkContext.broadcast(table)
    margin, reach = _margin(nodes, shared, threshold), math.sin(math.acos(threshold)) + 1e-9
    most = max(LEAST_ROUND, ROUND * nodes.count())
    for effort, wider in zip(EFFORTS, (margin, min(reach, 2 * margin), reach), strict=True):
        parts = _searched(nodes, shared, wider, most, threshold, effort)
        found = reduce(DataFrame.union, parts, spark.createDataFrame([], LINKS))
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        recall = _audited(classes, links, threshold)
        if recall is None or recall >= RECALL or effort == EFFORTS[-1]:
            break
        discard(*parts)
    if recall is not None and recall < LEAST_RECALL:
        raise RuntimeError(f"only {recall:.3f} of the links of the audited vectors were found")
    edges = found.filter("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    return ids, classes.select("key", "rep", "size"), links, components(edges).withColumnRenamed("node", "rep")


@contextmanager
def _tidied(spark):
    """Deletes shuffled files when a job is done, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding, label)."""
    with _tidied(embeddings.sparkSession):
        ids, classes, links, roots = _found(embeddings, threshold)
    named = classes.join(links, "rep", "left").join(roots, "rep", "left")
    named = named.select("key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = ids.join(named, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same in DuckDB, over all pairs of a label, with their transitive closure.
ORACLE = """
with recursive
v as (
  select row_number() over () as r, vec_id, label, cast(embedding as double[]) as e,
         label is not null and len(embedding) > 0 and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), false)
         and coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) as good
  from embeddings),
u as (select r, label, len(e) as n, e, sqrt(list_inner_product(e, e)) as size from v where good),
links as (select a.r as x, b.r as y from u a join u b on a.label = b.label and a.n = b.n and a.r <> b.r where list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach as (select r as x, r as y from v union select reach.x, links.y from reach join links on links.x = reach.y),
class as (select x as r, min(vec_id) as component_id from reach join v on v.r = reach.y group by x),
degree as (select x as r, count(*) as n from links group by x)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from v join class using (r) left join degree using (r)
"""

"""The commit graph: ancestry, first-parent lineage, common ancestors and merge bases.

A graph of up to ``SMALL`` edges is walked on the driver, where a step costs
nothing.  A larger one is walked by joins of a frontier with the edges, each
layer written out, so that paths never multiply and lineage stays short.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.errors import AmbiguousMergeBase, CommitNotFound, NoCommonHistory
from palimpsest.operators.log import Log
from palimpsest.sources.store import local, stored

SMALL = 1_000_000
DEPTHS = "commit_id string, depth bigint"


class Graph:
    """Parents by commit, on the driver."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.parents = {commit: list(parents) for commit, parents in rows}

    @classmethod
    def of(cls, log: Log) -> Graph:
        return cls([(r[0], r[1]) for r in log.commits.select("commit_id", "parents").collect()])

    def _known(self, commit: str) -> None:
        if commit not in self.parents:
            raise CommitNotFound(commit)

    def ancestors(self, commit: str) -> dict[str, int]:
        """Every commit reachable over all parents, with its shortest distance."""
        self._known(commit)
        depth, layer = {commit: 0}, [commit]
        while layer:
            following = []
            for c in layer:
                for p in self.parents[c]:
                    if p not in depth:
                        depth[p] = depth[c] + 1
                        following.append(p)
            layer = following
        return depth

    def lineage(self, commit: str) -> dict[str, int]:
        """The chain of first parents, with distances."""
        self._known(commit)
        depth: dict[str, int] = {}
        at: str | None = commit
        while at is not None and at not in depth:
            depth[at] = len(depth)
            parents = self.parents[at]
            at = parents[0] if parents else None
        return depth

    def best_common(self, left: str, right: str) -> list[str]:
        """Common ancestors that are no proper ancestor of another one, sorted."""
        common = self.ancestors(left).keys() & self.ancestors(right).keys()
        below: set[str] = set()
        for c in common:
            if c not in below:
                below |= self.ancestors(c).keys() - {c}
        return sorted(common - below)

    def merge_base(self, left: str, right: str) -> str:
        if left == right:
            return left
        found = self.best_common(left, right)
        if not found:
            raise NoCommonHistory(f"{left}, {right}")
        if len(found) > 1:
            raise AmbiguousMergeBase(", ".join(found))
        return found[0]

    def children(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = defaultdict(list)
        for commit, parents in self.parents.items():
            for p in parents:
                out[p].append(commit)
        return out


def _frame(spark: SparkSession, depth: dict[str, int]) -> DataFrame:
    return local(spark, list(depth.items()), DEPTHS)


def _is_small(log: Log) -> bool:
    return log.commits.limit(SMALL + 1).count() <= SMALL


def walk(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(commit_id, depth) of all that ``start`` (commit_id) reaches over ``edges`` (child_id, parent_id), by layers."""
    seen = stored(start.select("commit_id", F.lit(0).cast("bigint").alias("depth")))
    layer = seen
    while True:
        following = layer.join(edges, F.col("commit_id") == F.col("child_id")).select(F.col("parent_id").alias("commit_id"), (F.col("depth") + 1).alias("depth")).distinct()
        layer = stored(following.join(seen.select("commit_id"), "commit_id", "left_anti"))
        if layer.isEmpty():
            return seen
        seen = seen.unionByName(layer)


def ancestry(log: Log, commit: str) -> DataFrame:
    """(commit_id, depth): every ancestor over all parents at its shortest depth, the commit itself at 0."""
    if _is_small(log):
        return _frame(log.spark, Graph.of(log).ancestors(commit))
    return walk(log.edges(), log.commits.filter(F.col("commit_id") == commit).select("commit_id"))


def lineage(log: Log, commit: str) -> DataFrame:
    """(commit_id, depth) along first parents."""
    if _is_small(log):
        return _frame(log.spark, Graph.of(log).lineage(commit))
    return walk(log.edges().filter("parent_order = 0"), log.commits.filter(F.col("commit_id") == commit).select("commit_id"))


def best_common_ancestors(log: Log, left: str, right: str) -> DataFrame:
    """(commit_id) of the best common ancestors."""
    if _is_small(log):
        return local(log.spark, [(c,) for c in Graph.of(log).best_common(left, right)], "commit_id string")
    common = stored(ancestry(log, left).select("commit_id").join(ancestry(log, right).select("commit_id"), "commit_id"))
    parents = common.join(log.edges(), F.col("commit_id") == F.col("child_id")).select(F.col("parent_id").alias("commit_id")).distinct()
    below = walk(log.edges(), parents).select("commit_id").distinct()
    return common.join(below, "commit_id", "left_anti")


def merge_base(log: Log, left: str, right: str) -> str:
    """The one best common ancestor; none or several are errors."""
    if left == right:
        return left
    found = sorted(r[0] for r in best_common_ancestors(log, left, right).limit(3).collect())
    if not found:
        raise NoCommonHistory(f"{left}, {right}")
    if len(found) > 1:
        raise AmbiguousMergeBase(", ".join(found))
    return found[0]

"""States of commits, and overlays of changes on a base table.

A row's version at a commit is its nearest member along the first-parent
lineage.  The lineage is joined with the members (broadcast by Spark if small),
and one grouped minimum by distance picks the winners of all rows at once.
Several commits are resolved in the same pass: a diff or a merge reads and
shuffles the members once, however many states it compares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import Graph, _is_small, lineage
from palimpsest.operators.log import IDENTITY, Log
from palimpsest.sources.store import local

VERSION = ("change_id", "deleted", "snapshot", "updated_at")


def winners(log: Log, commits: dict[str, str]) -> DataFrame:
    """The identity, and for each name in ``commits`` a struct of the row's version at that commit, or null."""
    depths = _depths(log, commits)
    met = log.members.join(depths, "commit_id")
    version = F.struct(*VERSION)
    picks = [F.min_by(version, F.col(f"{name}_depth")).alias(name) for name in commits]
    return met.groupBy(*IDENTITY).agg(*picks)


def _depths(log: Log, commits: dict[str, str]) -> DataFrame:
    """(commit_id, <name>_depth ...): distances from each of the commits; null where a commit is not in its lineage."""
    if _is_small(log):
        graph = Graph.of(log)
        lines = {name: graph.lineage(commit) for name, commit in commits.items()}
        every = sorted(set().union(*lines.values()))
        return local(log.spark, [(c, *[lines[name].get(c) for name in commits]) for c in every], ", ".join(["commit_id string", *[f"{name}_depth bigint" for name in commits]]))
    frames = [lineage(log, commit).withColumnRenamed("depth", f"{name}_depth") for name, commit in commits.items()]
    return reduce(lambda a, b: a.join(b, "commit_id", "full"), frames)


def changed_between(log: Log, commits: dict[str, str]) -> Log:
    """``log`` with the members of rows that may differ between the commits only.

    Members of commits that all lineages share can't make a difference by
    themselves; they are kept just for rows that some other member touches.
    """
    depths = _depths(log, commits)
    some = reduce(lambda a, b: a | b, [F.col(f"{name}_depth").isNull() for name in commits])
    touched = log.members.join(depths.filter(some).select("commit_id"), "commit_id", "left_semi").select(*IDENTITY).distinct()
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in IDENTITY]
    members = log.members.alias("m").join(touched.alias("t"), reduce(lambda a, b: a & b, same), "left_semi")
    return Log(log.changes, members, log.commits, log.branches)


def state_at(log: Log, commit: str, with_deleted: bool = False) -> DataFrame:
    """The rows that exist at ``commit``: identity, change_id, snapshot, updated_at (and deleted ones if asked for)."""
    won = winners(log, {"w": commit}).select(*IDENTITY, "w.*")
    return won if with_deleted else won.filter("not deleted")


def overlay(base: DataFrame, changes: DataFrame, keys: list[str], deleted: str = "deleted") -> DataFrame:
    """``base`` with later versions of rows: changed rows replace base rows, deleted ones hide them.

    ``changes`` has the columns of ``base`` and a flag, one row per key.
    """
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes.filter(~F.col(deleted)).select(*base.columns))


def visible(tiers: list[DataFrame], keys: list[str], order: str = "seq") -> DataFrame:
    """Rows seen through tiers of candidates, from the lowest to the highest.

    The highest tier that has a row wins, and within it the largest ``order``; a
    deleted winner hides the row, also one of a lower tier.
    """
    every = reduce(DataFrame.unionByName, [t.withColumn("_tier", F.lit(i)) for i, t in enumerate(tiers)])
    rest = [c for c in tiers[0].columns if c not in keys and c != order]
    top = every.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), F.struct("_tier", order)).alias("v"))
    return top.select(*keys, "v.*").filter("not deleted")

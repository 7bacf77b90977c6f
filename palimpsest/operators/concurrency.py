"""Commits that were made on an old head, and commits that nothing reaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import ancestry, lineage
from palimpsest.operators.log import IDENTITY, Log


def _touched(log: Log, base: str, head: str) -> DataFrame:
    """Rows with members in the lineage of ``head`` after ``base``."""
    since = lineage(log, head).join(lineage(log, base), "commit_id", "left_anti").select("commit_id")
    return log.members.join(since, "commit_id", "left_semi").select(*IDENTITY).distinct()


def clashes(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows (by identity) that are in both; an empty one means that the second may follow the first."""
    a, b = theirs.alias("a"), mine.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in IDENTITY])
    return a.join(b, same, "left_semi")


def overlap(log: Log, base: str, head: str, mine: str) -> DataFrame:
    """Rows that both the head and my own line changed since the base: these must be reconciled, all others not."""
    return clashes(_touched(log, base, mine), _touched(log, base, head))


def unreachable(log: Log, roots: list[str]) -> DataFrame:
    """(commit_id) of commits that none of the roots reaches."""
    kept = reduce(DataFrame.unionByName, [ancestry(log, r).select("commit_id") for r in roots]).distinct()
    return log.commits.select("commit_id").join(kept, "commit_id", "left_anti")

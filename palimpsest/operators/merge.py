"""Three-way merges: the plan, its statistics, and conflict resolution by column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.diff import kind_of, live, unchanged
from palimpsest.operators.graph import merge_base
from palimpsest.operators.log import IDENTITY, Log
from palimpsest.operators.state import changed_between, winners


def merge_plan(log: Log, base: str, target: str, source: str) -> DataFrame:
    """(identity, action, target_diff, source_diff, target_*, source_* versions) of rows that differ from the base on some side.

    action: ``keep`` where only the target changed, ``pick`` where only the source
    did, ``noop`` where both reach the same state, else ``conflict``.
    """
    commits = {"o": base, "t": target, "s": source}
    rows = winners(changed_between(log, commits), commits).withColumns({"target_diff": kind_of("o", "t"), "source_diff": kind_of("o", "s")})
    both = F.col("target_diff").isNotNull() & F.col("source_diff").isNotNull()
    same = (~live("t") & ~live("s")) | (live("t") & live("s") & unchanged("t", "s"))
    action = F.when(both & same, "noop").when(both, "conflict").when(F.col("source_diff").isNotNull(), "pick").when(F.col("target_diff").isNotNull(), "keep")
    sides = [F.col(f"{k}.{c}").alias(f"{name}_{c}") for k, name in (("o", "base"), ("t", "target"), ("s", "source")) for c in ("change_id", "deleted", "snapshot", "updated_at")]
    return rows.withColumn("action", action).filter("action is not null").select(*IDENTITY, "action", "target_diff", "source_diff", *sides)


def outcome(log: Log, target: str, source: str) -> tuple[str, str]:
    """(what a merge of ``source`` into ``target`` does, the merge base)."""
    base = merge_base(log, target, source)
    return ("AlreadyUpToDate" if base == source else "FastForward" if base == target else "MergeCommitted"), base


def statistics(plan: DataFrame) -> DataFrame:
    """(diff_type, n) of what a merge brings into the target."""
    return plan.filter(F.col("action").isin("pick", "conflict")).groupBy(F.col("source_diff").alias("diff_type")).agg(F.count("*").alias("n"))


Merger = Callable[[Column, Column, Column], Column]


def resolve(conflicts: DataFrame, columns: list[str], keys: list[str] | None = None, mergers: dict[str, Merger] | None = None) -> DataFrame:
    """Conflicts of a plan with ``resolved``, the merged snapshot, and ``resolved_deleted``.

    Sides are ranked by (updated_at, change_id).  Where one side deletes or both
    create, the later side wins as a whole.  Else each column is taken from the only
    side that changed it, and from the later one if both did.  Key columns may not
    change.  ``mergers`` has functions of (base, target, source) for columns whose
    values are to be merged where both sides changed them.  The expressions are made
    per schema, so they stay compiled.
    """
    later = F.struct("source_updated_at", "source_change_id") > F.struct("target_updated_at", "target_change_id")
    whole = F.col("base_change_id").isNull() | F.coalesce("base_deleted", F.lit(True)) | F.col("target_deleted") | F.col("source_deleted")

    def column(name: str):
        o, t, s = (F.col(f"{side}_snapshot.{name}") for side in ("base", "target", "source"))
        value = F.when(t.eqNullSafe(s), t).when(t.eqNullSafe(o), s).when(s.eqNullSafe(o), t).otherwise(mergers[name](o, t, s) if name in (mergers or {}) else F.when(later, s).otherwise(t))
        return F.when(whole, F.when(later, s).otherwise(t)).otherwise(value).alias(name)

    deleted = F.when(later, F.col("source_deleted")).otherwise(F.col("target_deleted"))
    merged = F.struct(*[column(c) for c in columns])
    rows = conflicts.withColumn("resolved_deleted", F.when(whole, deleted).otherwise(False))
    if keys:
        moved = F.lit(False)
        for k in keys:
            moved = moved | (~whole & (~F.col(f"base_snapshot.{k}").eqNullSafe(F.col(f"target_snapshot.{k}")) | ~F.col(f"base_snapshot.{k}").eqNullSafe(F.col(f"source_snapshot.{k}"))))
        rows = rows.withColumn("_checked", F.when(moved, F.raise_error(F.lit("a merge may not change a primary key"))).otherwise(F.lit(True))).filter("_checked").drop("_checked")
    return rows.withColumn("resolved", F.when(~F.col("resolved_deleted"), merged))

"""The change log: changes, commits, members and branches as DataFrames.

A change is one new version of a row, named by (schema_key, file_id, row_pk).  A
commit lists its parents and its members, one change per row at most.  A branch
points at a commit.  All of a table's past is in the log; states, diffs and
merges are queries over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.store import local, stored

#: What names a row.
IDENTITY = ("schema_key", "file_id", "row_pk")

COMMITS = "commit_id string, generation bigint, parents array<string>"
BRANCHES = "id string, name string, hidden boolean, commit_id string, checkpoint_commit_id string"


@dataclass
class Log:
    """``members``: commit_id, the identity, change_id, deleted, snapshot, updated_at."""

    changes: DataFrame
    members: DataFrame
    commits: DataFrame
    branches: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.members.sparkSession

    def edges(self) -> DataFrame:
        """(child_id, parent_id, parent_order) of every commit."""
        return self.commits.select(F.col("commit_id").alias("child_id"), F.posexplode("parents").alias("parent_order", "parent_id")).select("child_id", "parent_id", "parent_order")

    def head(self, branch: str) -> str:
        row = self.branches.filter(F.col("name") == branch).select("commit_id").first()
        if row is None:
            raise KeyError(branch)
        return row[0]


def latest_per_row(changes: DataFrame, *order: str) -> DataFrame:
    """The last change of each (commit_id, identity) by ``order``: one grouped maximum, combined before the shuffle."""
    keys = ["commit_id", *IDENTITY]
    rest = [c for c in changes.columns if c not in keys and c not in order]
    top = changes.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return top.select(*keys, *[F.col(f"m.{c}").alias(c) for c in (*order, *rest)])


#: Days of the fixture whose odd events are on the side branch, its base, and its last day.
DRAFT_DAYS, LAST_DAY = range(11, 14), 30
MERGE_BASE, TARGET, SOURCE = "M10", "M13", "D13"


def fixture_commits(spark: SparkSession) -> DataFrame:
    """M1 .. M30 in a line but for X13, which merges D11 .. D13 (from M10) into M13."""
    rows = [("M1", 0, [])]
    rows += [(f"M{d}", d - 1, [f"M{d - 1}"]) for d in range(2, 14)]
    rows += [("D11", 10, ["M10"])] + [(f"D{d}", d - 1, [f"D{d - 1}"]) for d in (12, 13)]
    rows += [("X13", 13, [TARGET, SOURCE]), ("M14", 14, ["X13"])]
    rows += [(f"M{d}", d, [f"M{d - 1}"]) for d in range(15, LAST_DAY + 1)]
    return local(spark, rows, COMMITS)


_logs: dict[tuple[str, str], Log] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Log:
    """The log derived from the events table, whose members are written once for a session.

    X13's members are what the merge takes from the source, as a merge writes them.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _logs:
        _logs[key] = _derive(spark, sf_dir)
    return _logs[key]


def _derive(spark: SparkSession, sf_dir: str) -> Log:
    from palimpsest.operators.merge import merge_plan

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = (F.datediff("ts", F.lit("2024-01-01")) + 1).cast("int")
    draft = day.between(DRAFT_DAYS.start, DRAFT_DAYS.stop - 1) & (F.col("event_id") % 2 == 1)
    changes = events.select(
        F.when(draft, F.concat(F.lit("D"), day)).otherwise(F.concat(F.lit("M"), day)).alias("commit_id"),
        F.lit("user_event").alias("schema_key"),
        F.lit(None).cast("string").alias("file_id"),
        F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(',"'), "event_type", F.lit('"]')).alias("row_pk"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("change_id"),
        (F.col("event_id") % 7 == 0).alias("deleted"),
        F.when(F.col("event_id") % 7 != 0, F.struct("event_type", "value", "props")).alias("snapshot"),
    )
    members = latest_per_row(changes, "updated_at", "change_id")
    commits = fixture_commits(spark)
    branches = local(spark, [("main", "main", False, "M30", "M10"), ("draft", "draft", False, "D13", "M10")], BRANCHES)
    members = stored(members)
    base = Log(changes, members, commits, branches)
    plan = merge_plan(base, MERGE_BASE, TARGET, SOURCE)
    # a conflict goes to the later change as a whole
    taken = plan.filter((F.col("action") == "pick") | ((F.col("action") == "conflict") & (F.struct("source_updated_at", "source_change_id") > F.struct("target_updated_at", "target_change_id"))))
    merged = taken.select(F.lit("X13").alias("commit_id"), *IDENTITY, F.col("source_updated_at").alias("updated_at"), F.col("source_change_id").alias("change_id"), F.col("source_deleted").alias("deleted"), F.col("source_snapshot").alias("snapshot"))
    return Log(changes, members.unionByName(stored(merged.select(*members.columns))), commits, branches)

"""Versions of rows along the commits that an anchor reaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import ancestry
from palimpsest.operators.log import IDENTITY, Log
from palimpsest.sources.store import stored


def history(log: Log, schema_key: str, anchor: str, row_pk: str | None = None, depths: tuple[int, int] | None = None) -> DataFrame:
    """(identity, change_id, commit_id, depth, deleted, snapshot): each change once, at the nearest commit that has it.

    A key, or a range of depths, is applied before anything is joined.
    """
    near = ancestry(log, anchor)
    if depths:
        near = near.filter(F.col("depth").between(*depths))
    members = log.members.filter(F.col("schema_key") == schema_key)
    if row_pk is not None:
        members = members.filter(F.col("row_pk") == row_pk)
    met = members.join(near, "commit_id")
    first = met.groupBy("change_id", *IDENTITY).agg(F.min(F.struct("depth", "commit_id")).alias("at"), F.first("deleted").alias("deleted"), F.first("snapshot").alias("snapshot"))
    return first.select(*IDENTITY, "change_id", F.col("at.commit_id").alias("commit_id"), F.col("at.depth").alias("depth"), "deleted", "snapshot")


def in_order(versions: DataFrame) -> DataFrame:
    """The published order: depth, commit, change."""
    return versions.orderBy("depth", "commit_id", "change_id")


def affected_files(log: Log, anchor: str, trees: DataFrame) -> DataFrame:
    """(file_id, commit_id, depth, source_changes): one revision of a file for each commit that touches it or a directory above it.

    ``trees`` (file_id, part_schema, part_pk) lists the descriptor, contents and
    directories that each file is made of.
    """
    parts = log.members.join(ancestry(log, anchor), "commit_id").select("commit_id", "depth", "change_id", F.col("schema_key").alias("part_schema"), F.col("row_pk").alias("part_pk"))
    met = parts.join(trees, ["part_schema", "part_pk"])
    return met.groupBy("file_id", "commit_id", "depth").agg(F.to_json(F.sort_array(F.collect_set(F.struct("change_id", F.col("part_schema").alias("schema_key"), F.col("part_pk").alias("row_pk"))))).alias("source_changes"))


def composed(log: Log, anchor: str, owner: str, key_column: str, parts: list[tuple[str, str]], directories: str, parent: dict[str, str]) -> DataFrame:
    """(id, commit_id, depth, source_changes): revisions of things made of several rows, along the commits that the anchor reaches.

    ``owner`` is the schema whose rows name the things; ``parts`` are (schema, key
    column) of further rows of one thing each; ``parent`` names, by schema, the
    column with the directory that a row hangs on.  A change of a directory is a
    revision of everything that hung on it, at any depth, at some time up to then.
    """
    near = ancestry(log, anchor)
    met = log.members.join(near, "commit_id")
    value = lambda column: F.get_json_object("snapshot", f"$.{column}")
    key = F.from_json("row_pk", "array<string>")[0]
    # every place that a thing or a directory ever had, in the commits reached
    hung = lambda schema: met.filter((F.col("schema_key") == schema) & ~F.col("deleted")).select(key.alias("id"), value(parent[schema]).alias("directory_id")).filter("directory_id is not null").distinct()
    above = up = stored(hung(owner))
    steps = hung(directories).select(F.col("id").alias("directory_id"), F.col("directory_id").alias("higher"))
    while not up.isEmpty():
        up = stored(up.join(steps, "directory_id").select("id", F.col("higher").alias("directory_id")).distinct().join(above, ["id", "directory_id"], "left_anti"))
        above = above.unionByName(up)
    change = F.struct("change_id", "schema_key", "row_pk", "deleted")
    own = [met.filter(F.col("schema_key") == schema).select(key.alias("id"), "commit_id", "depth", change.alias("change")) for schema, _ in [(owner, key_column), *parts]]
    of_directories = met.filter(F.col("schema_key") == directories).select(key.alias("directory_id"), "commit_id", "depth", change.alias("change"))
    every = reduce(DataFrame.unionByName, [*own, of_directories.join(above, "directory_id").select("id", "commit_id", "depth", "change")])
    return every.groupBy("id", "commit_id", "depth").agg(F.to_json(F.sort_array(F.collect_set("change"))).alias("source_changes"))

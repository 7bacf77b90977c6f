"""Differences of two commits, and the ids that name them."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.log import IDENTITY, Log
from palimpsest.operators.state import changed_between, winners

#: Schemas that are no part of a diff.
HIDDEN_SCHEMAS = ("checkpoint", "undo_marker")


def uuid_hex(change_id: Column, text: bool = False) -> Column:
    """32 hexadecimal digits of a change id: a UUID's where it is a text, else those of a number."""
    return F.lower(F.replace(change_id, F.lit("-"), F.lit(""))) if text else F.lower(F.lpad(F.hex(change_id), 32, "0"))


def diff_id(before: Column, after: Column) -> Column:
    """``d1.`` and the unpadded URL-safe base64 of flags (1: before, 2: after) and the ids that are there.

    ``before`` and ``after`` are 32 hexadecimal digits or null.
    """
    flags = F.when(before.isNotNull(), 1).otherwise(0) + F.when(after.isNotNull(), 2).otherwise(0)
    body = F.concat(F.lpad(F.hex(flags), 2, "0"), F.coalesce(before, F.lit("")), F.coalesce(after, F.lit("")))
    return F.concat(F.lit("d1."), F.rtrim(F.translate(F.base64(F.unhex(body)), "+/", "-_"), F.lit("=")))


def decode_diff_id(text: str) -> tuple[str | None, str | None]:
    """(before, after) as 32 hexadecimal digits or None."""
    if not text.startswith("d1."):
        raise ValueError(text)
    raw = base64.urlsafe_b64decode(text[3:] + "=" * (-len(text[3:]) % 4))
    flags, body = raw[0], raw[1:].hex()
    if flags not in (1, 2, 3) or len(body) != 32 * (flags & 1) + 32 * (flags >> 1):
        raise ValueError(text)
    before = body[:32] if flags & 1 else None
    after = body[-32:] if flags & 2 else None
    return before, after


def live(version: str) -> Column:
    """Whether a version is there and not deleted."""
    return F.coalesce(~F.col(f"{version}.deleted"), F.lit(False))


def unchanged(a: str, b: str) -> Column:
    """Whether two versions that are there are the same change or have equal contents."""
    return (F.col(f"{a}.change_id") == F.col(f"{b}.change_id")) | F.col(f"{a}.snapshot").eqNullSafe(F.col(f"{b}.snapshot"))


def kind_of(before: str, after: str) -> Column:
    """added, removed, modified, or null for no difference."""
    return (
        F.when(~live(before) & live(after), "added")
        .when(live(before) & ~live(after), "removed")
        .when(live(before) & live(after) & ~unchanged(before, after), "modified")
    )


def diff(log: Log, before: str, after: str, schema_key: str | None = None, row_pk: str | None = None, prune: bool = True) -> DataFrame:
    """(diff_id, identity, diff_type, before_change_id, after_change_id, before_snapshot, after_snapshot).

    The before side is the visible row, the after side the raw one, so that a
    removal names its deleting change.  Filters on the key reach the log.
    """
    if schema_key is not None or row_pk is not None:
        members = log.members
        members = members.filter(F.col("schema_key") == schema_key) if schema_key is not None else members
        members = members.filter(F.col("row_pk") == row_pk) if row_pk is not None else members
        log = Log(log.changes, members, log.commits, log.branches)
    log = Log(log.changes, log.members.filter(~F.col("schema_key").isin(*HIDDEN_SCHEMAS)), log.commits, log.branches)
    sides = {"a": before, "b": after}
    both = winners(changed_between(log, sides) if prune else log, sides).withColumn("diff_type", kind_of("a", "b")).filter("diff_type is not null")
    old = F.when(live("a"), F.col("a.change_id"))
    new = F.col("b.change_id")
    text = dict(log.members.dtypes)["change_id"] == "string"
    return both.select(
        diff_id(F.when(old.isNotNull(), uuid_hex(old, text)), F.when(new.isNotNull(), uuid_hex(new, text))).alias("diff_id"),
        *IDENTITY,
        "diff_type",
        old.alias("before_change_id"),
        new.alias("after_change_id"),
        F.when(live("a"), F.col("a.snapshot")).alias("before_snapshot"),
        F.when(live("b"), F.col("b.snapshot")).alias("after_snapshot"),
    )


def working_diff(log: Log, branch: str, **filters: str | None) -> DataFrame:
    """The difference of a branch's checkpoint and its head."""
    row = log.branches.filter(F.col("name") == branch).first()
    return diff(log, row["checkpoint_commit_id"], row["commit_id"], **filters)

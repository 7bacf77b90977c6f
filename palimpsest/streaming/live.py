"""Live queries and the change feed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.repository import MEMBER, Repository, Session


@dataclass
class Event:
    """A result that differs from the one before."""

    sequence: int
    version: int
    rows: DataFrame


def fingerprint(rows: DataFrame) -> tuple:
    """A digest of a result as a bag of rows, added up on the executors."""
    each = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns]) if rows.columns else F.lit(0).cast("bigint")
    return tuple(rows.agg(F.count("*"), F.sum(each.cast("decimal(38,0)")), F.bit_xor(each)).first())


class Observation:
    """A query that is evaluated at once and again after commits; only changed results are events.

    Observations of the same text and parameters on the same branch share their
    evaluation through the session.
    """

    def __init__(self, session: Session, text: str, params: list):
        self.session, self.text, self.params = session, text, params
        self.sequence, self.seen, self.version = 0, None, -1

    def poll(self) -> Event | None:
        """The next event, or None if nothing was committed or the result is the same."""
        repo = self.session.repo
        repo.refresh()
        if repo.meta.version == self.version:
            return None
        self.version = repo.meta.version
        shared = self.session.__dict__.setdefault("_evaluated", {})
        key = (self.session.branch_id, self.text, repr(self.params), self.version)
        if key not in shared:
            shared.clear()
            rows = self.session.sql(self.text, self.params)
            shared[key] = rows, fingerprint(rows)
        rows, print_ = shared[key]
        if print_ == self.seen:
            return None
        self.seen = print_
        self.sequence += 1
        return Event(self.sequence, self.version, rows)

    def __iter__(self) -> Iterator[Event]:
        """Events until the result stays the same."""
        while (event := self.poll()) is not None:
            yield event


def change_feed(spark: SparkSession, repo: Repository, files_per_trigger: int = 100) -> DataFrame:
    """A stream of members as commits are written: (commit_id, identity, change, ...)."""
    return spark.readStream.schema(MEMBER).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(f"{repo.path}/commits")


def follow(session: Session, text: str, sink: Callable[[Event], None], checkpoint: str, params: list | None = None) -> StreamingQuery:
    """Feeds ``sink`` the events of a live query as commits arrive, until the stream is stopped."""
    watched = Observation(session, text, params or [])

    def on_batch(_: DataFrame, __: int) -> None:
        event = watched.poll()
        if event is not None:
            sink(event)

    return change_feed(session.spark, session.repo).writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_batch).start()

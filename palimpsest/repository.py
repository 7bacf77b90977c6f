"""Repositories and sessions: branches, transactions, commands and queries.

On disk a repository is a folder of Parquet and small JSON records:

    commits/<commit_id>/   the members of a commit, written once
    blobs/                 file contents by hash
    meta/<n>.json          one record for each change of the graph, branches or schemas

A record's name is the next number, and it is created only if it does not exist.
Of two writers one comes second: it reads the other's records and, if these touch
none of its rows and its constraints still hold, follows them; else it fails with
TransactionConflict.  Members are written before the record that makes them
visible, and a receipt is part of its commit's record, so a lost writer leaves no
half commit.  States, diffs and merges are DataFrames over the members.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import errors as E
from palimpsest.functions import jsonb
from palimpsest.functions.scalar import Ids, uuidv7
from palimpsest.operators import concurrency as C
from palimpsest.operators import diff as D
from palimpsest.operators import history as H
from palimpsest.operators import merge as M
from palimpsest.operators import state as S
from palimpsest.operators.graph import Graph
from palimpsest.operators.log import BRANCHES, COMMITS, IDENTITY, Log
from palimpsest.schema import BUILTIN, PRIVATE, Schema, amend
from palimpsest.sources.files import FileSystem
from palimpsest.sources.store import local, stored

MEMBER = "commit_id string, schema_key string, file_id string, row_pk string, change_id string, account_id string, deleted boolean, snapshot string, metadata string, updated_at timestamp, origin_key string"
GLOBAL = "global"


@dataclass
class Receipt:
    """What a write did."""

    commit_id: str | None
    rows_affected: int
    rows: DataFrame | None = None


@dataclass
class _Meta:
    """The folded records."""

    version: int = 0
    commits: dict[str, dict] = field(default_factory=dict)
    branches: dict[str, dict] = field(default_factory=dict)
    receipts: dict[str, dict] = field(default_factory=dict)
    swept: set[str] = field(default_factory=set)

    def apply(self, record: dict) -> None:
        for c in record.get("commits", []):
            self.commits[c["id"]] = c
        for b in record.get("branches", []):
            self.branches[b["id"]] = b
        for b in record.get("dropped", []):
            self.branches.pop(b, None)
        for r in record.get("receipts", []):
            self.receipts[r["key"]] = r
        for c in record.get("swept", []):
            self.commits.pop(c, None)
            self.swept.add(c)
        self.version += 1


class Repository:
    def __init__(self, spark: SparkSession, path: str, ids: Ids | None = None):
        self.spark, self.path, self.ids = spark, path.rstrip("/"), ids or Ids()
        self.fs = FileSystem(spark)
        self.meta = _Meta()
        self._schemas: dict[str, Schema] = {}
        self.refresh()

    @classmethod
    def open(cls, path: str, spark: SparkSession, ids: Ids | None = None) -> Repository:
        """Opens the repository, or makes one with branches ``global`` and ``main``."""
        repo = cls(spark, path, ids)
        if not repo.meta.version:
            root = repo.ids()
            try:
                repo.publish({"commits": [repo.commit_record(root, [])], "branches": [{"id": GLOBAL, "name": GLOBAL, "hidden": True, "commit_id": root, "checkpoint_commit_id": root}, {"id": "main", "name": "main", "hidden": False, "commit_id": root, "checkpoint_commit_id": root}]})
            except E.TransactionConflict:
                repo.refresh()
        return repo

    def session(self, branch: str = "main", account: str = "anonymous") -> Session:
        return Session(self, branch, account)

    # --- records
    def refresh(self) -> None:
        while True:
            text = self.fs.read_text(f"{self.path}/meta/{self.meta.version:012d}.json")
            if text is None:
                return
            self.meta.apply(json.loads(text))

    def publish(self, record: dict) -> None:
        if not self.fs.create_text(f"{self.path}/meta/{self.meta.version:012d}.json", json.dumps(record)):
            raise E.TransactionConflict(f"record {self.meta.version} was written by another session")
        self.meta.apply(record)

    def commit_record(self, commit_id: str, parents: list[str], **more) -> dict:
        generation = 1 + max((self.meta.commits[p]["generation"] for p in parents), default=-1)
        return {"id": commit_id, "parents": parents, "generation": generation, "created_at": datetime.now(UTC).isoformat(), "members": False} | more

    def graph(self) -> Graph:
        return Graph([(c["id"], c["parents"]) for c in self.meta.commits.values()])

    def branch(self, name: str) -> dict:
        found = next((b for b in self.meta.branches.values() if name in (b["id"], b["name"])), None)
        if found is None:
            raise E.BranchNotFound(name)
        return found

    # --- the log
    def members(self, commits: Iterable[str] | None = None) -> DataFrame:
        wanted = [c for c in (self.meta.commits if commits is None else commits) if self.meta.commits[c]["members"]]
        if not wanted:
            return local(self.spark, [], MEMBER)
        return self.spark.read.schema(MEMBER).parquet(*[f"{self.path}/commits/{c}" for c in wanted])

    def log(self, commits: Iterable[str] | None = None) -> Log:
        """The log, read from the members of the given commits only."""
        members = self.members(commits)
        graph = local(self.spark, [(c["id"], c["generation"], c["parents"]) for c in self.meta.commits.values()], COMMITS)
        heads = local(self.spark, [(b["id"], b["name"], b["hidden"], b["commit_id"], b["checkpoint_commit_id"]) for b in self.meta.branches.values()], BRANCHES)
        return Log(members, members, graph, heads)

    def lineage_log(self, *commits: str) -> Log:
        graph = self.graph()
        return self.log(sorted(set().union(*[graph.lineage(c) for c in commits])))

    def write_members(self, commit_id: str, members: DataFrame) -> None:
        kind = T._parse_datatype_string(MEMBER)
        members.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind]).write.parquet(f"{self.path}/commits/{commit_id}")

    def untracked(self, branch: str) -> DataFrame | None:
        """Members that are in no commit: they show on their branch only, and no diff, merge or restore sees them."""
        where = f"{self.path}/untracked/{branch}"
        fs, path = self.fs._at(where)
        return self.spark.read.schema(MEMBER).option("recursiveFileLookup", "true").parquet(where) if fs.exists(path) else None

    # --- surfaces
    def changes(self) -> DataFrame:
        """Every change once, in however many commits it is, and one change for each commit."""
        columns = [F.col("change_id").alias("id"), "account_id", "row_pk", "schema_key", "file_id", "metadata", F.col("updated_at").alias("created_at"), "origin_key", F.col("snapshot").alias("snapshot_content")]
        rows = [(c["id"], json.dumps([c["id"]]), datetime.fromisoformat(c["created_at"]), json.dumps({"id": c["id"]}, separators=(",", ":"))) for c in self.meta.commits.values()]
        made = local(self.spark, rows, "change_id string, row_pk string, updated_at timestamp, snapshot string")
        none = F.lit(None).cast("string")
        made = made.withColumns({"account_id": none, "schema_key": F.lit("commit"), "file_id": none, "metadata": none, "origin_key": none})
        return self.members().dropDuplicates(["change_id", *IDENTITY]).select(*columns).unionByName(made.select(*columns))

    def checkpoints(self) -> DataFrame:
        rows = [(c["checkpoint"], c["id"]) for c in self.meta.commits.values() if c.get("checkpoint")]
        return self.spark.createDataFrame(rows, "id string, commit_id string")

    def collect_garbage(self) -> list[str]:
        """Drops commits that no branch, checkpoint cursor or undo step reaches; returns their ids."""
        graph = self.graph()
        kept: set[str] = set()
        for b in self.meta.branches.values():
            for root in (b["commit_id"], b["checkpoint_commit_id"], *b.get("undone", [])):
                kept |= graph.ancestors(root).keys()
        dead = sorted(set(self.meta.commits) - kept)
        if dead:
            had = [c for c in dead if self.meta.commits[c]["members"]]
            self.publish({"swept": dead})
            for c in had:
                self.fs.delete(f"{self.path}/commits/{c}")
        return dead


class Session:
    """One branch, one account, at most one open transaction."""

    def __init__(self, repo: Repository, branch: str, account: str):
        self.repo, self.spark = repo, repo.spark
        self.branch_id = repo.branch(branch)["id"]
        self.account = account
        self.staged: list[DataFrame] | None = None
        self.closed = False
        self._known: tuple | None = None
        self._asked: dict | None = None  # the receipt of the call that is running
        self.mergers: dict[str, dict[str, M.Merger]] = {}

    # --- facts
    @property
    def head(self) -> str:
        return self.repo.meta.branches[self.branch_id]["commit_id"]

    @property
    def checkpoint_commit(self) -> str:
        return self.repo.meta.branches[self.branch_id]["checkpoint_commit_id"]

    @property
    def active_branch_id(self) -> str:
        return self.branch_id

    @property
    def active_account_id(self) -> str:
        return self.account

    def close(self) -> None:
        self.staged, self.closed = None, True

    # --- schemas
    def schemas(self) -> dict[str, Schema]:
        """Built-in schemas and those registered on this branch."""
        state = (self.repo.meta.branches[GLOBAL]["commit_id"], self.head, len(self.staged or []), self.staged is not None)
        if self._known and self._known[0] == state:
            return self._known[1]
        rows = self.rows("registered_schema").select("snapshot").collect()
        found = dict(BUILTIN)
        for r in rows:
            value = json.loads(json.loads(r[0])["value"])
            found[value["key"]] = Schema.of(value)
        self._known = state, found
        return found

    def schema(self, key: str) -> Schema:
        if key in BUILTIN:
            return BUILTIN[key]
        found = self.schemas().get(key)
        if found is None:
            raise E.TableNotFound(key)
        return found

    def register_schema(self, document: str | dict) -> Receipt:
        new = Schema.of(document)
        if new.key in BUILTIN:
            raise E.SchemaDefinition(f"{new.key} is built in")
        known = self.schemas()
        if new.key in known:
            amend(known[new.key], new)
        for f in new.foreign_keys:
            target = new if f.schema_key == new.key else known.get(f.schema_key)
            if target is None or (f.references != target.primary_key and f.references not in target.unique):
                raise E.SchemaDefinition(f"{f.schema_key}{f.references} is no key")
        row = self.spark.createDataFrame([(new.key, new.document)], "schema_key string, value string")
        return self.insert("registered_schema", row, on_conflict={"value": F.col("excluded.value")})

    # --- reads
    def rows(self, key: str | None = None) -> DataFrame:
        """Visible members of the branch: its state over the global branch's, under what is staged."""
        repo, graph = self.repo, self.repo.graph()
        heads = [repo.meta.branches[GLOBAL]["commit_id"], self.head]
        tiers = []
        for i, head in enumerate(dict.fromkeys(heads)):
            log = repo.log(sorted(graph.lineage(head)))
            if key is not None:
                log = Log(log.changes, log.members.filter(F.col("schema_key") == key), log.commits, log.branches)
            depth = graph.lineage(head)
            near = local(self.spark, list(depth.items()), "commit_id string, depth bigint")
            rest = [c for c in log.members.columns if c not in IDENTITY]
            # the nearest version of each row, with all its columns, in one grouped minimum
            full = log.members.join(near, "commit_id").groupBy(*IDENTITY).agg(F.min_by(F.struct(*rest), "depth").alias("v")).select(*IDENTITY, "v.*")
            tiers.append(full.withColumn("seq", F.lit(i)))
        loose = repo.untracked(self.branch_id)
        if loose is not None:
            rest = [c for c in loose.columns if c not in IDENTITY]
            loose = loose if key is None else loose.filter(F.col("schema_key") == key)
            loose = loose.groupBy(*IDENTITY).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "change_id")).alias("v")).select(*IDENTITY, "v.*")
            tiers.append(loose.withColumn("seq", F.lit(len(tiers))))
        for i, staged in enumerate(self.staged or []):
            own = staged if key is None else staged.filter(F.col("schema_key") == key)
            tiers.append(own.withColumn("seq", F.lit(len(tiers) + i)))
        return S.visible(tiers, list(IDENTITY))

    def table(self, key: str, system: bool = False) -> DataFrame:
        """The typed rows of a schema on this branch."""
        if key in PRIVATE:
            raise E.TableNotFound(key)
        return self._typed(key, system)

    def _typed(self, key: str, system: bool = False) -> DataFrame:
        schema = self.schema(key)
        rows = self.rows(key).withColumn("v", F.from_json("snapshot", schema.struct()))
        more = [F.col("row_pk").alias("sys_row_pk"), F.col("schema_key").alias("sys_schema_key"), F.col("file_id").alias("sys_file_id"), F.col("metadata").alias("sys_metadata"), F.col("updated_at").alias("sys_updated_at"), F.col("change_id").alias("sys_change_id"), F.col("commit_id").alias("sys_commit_id")] if system else []
        return rows.select(*[F.col(f"v.{c.name}").alias(c.name) for c in schema.columns], *more)

    def register_views(self, names: set[str] | None = None) -> None:
        """Temporary views of the named (or all) tables, and of branches, changes, commits and checkpoints."""
        wanted = lambda name: names is None or name in names
        for key in self.schemas():
            if key not in PRIVATE and wanted(key):
                self.table(key, system=True).createOrReplaceTempView(key)
        log = self.repo.log([])
        if wanted("branch"):
            log.branches.filter("not hidden").select("id", "name", "hidden", "commit_id").createOrReplaceTempView("branch")
        if wanted("commit"):
            log.commits.select(F.col("commit_id").alias("id")).createOrReplaceTempView("commit")
        if wanted("commit_edge"):
            log.edges().createOrReplaceTempView("commit_edge")
        info = self.information_schema() if names is None or any(n.startswith("information_schema") for n in names) else {}
        for name, frame in info.items():
            frame.createOrReplaceTempView(f"information_schema_{name}")
        if names and names & {"file", "directory"}:
            from palimpsest.files import Files

            files = Files(self)
            if "file" in names:
                files.files(content="content" in names or "*" in names).createOrReplaceTempView("file")
            if "directory" in names:
                files.directories().createOrReplaceTempView("directory")
        if wanted("change"):
            self.repo.changes().createOrReplaceTempView("change")
        if wanted("checkpoint"):
            self.repo.checkpoints().createOrReplaceTempView("checkpoint")

    def information_schema(self) -> dict[str, DataFrame]:
        """columns, tables and table_functions, made from the registered schemas."""
        columns = [(k, c.name, i + 1, c.type, "YES" if c.nullable else "NO", c.default_expression or (None if c.default_value is None else json.dumps(c.default_value)), "jsonb" if c.type == "jsonb" else "scalar", c.insert_policy) for k, s in sorted(self.schemas().items()) if k not in PRIVATE for i, c in enumerate(s.columns)]
        functions = [("history", "relation text, commit text default active head"), ("diff", "before text, after text"), ("working_diff", ""), ("commit_ancestry", "commit text default active head")]
        return {
            "columns": self.spark.createDataFrame(columns, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string, value_kind string, insert_policy string"),
            "tables": self.spark.createDataFrame([(k, "BASE TABLE") for k in sorted(self.schemas()) if k not in PRIVATE], "table_name string, table_type string"),
            "table_functions": self.spark.createDataFrame(functions, "function_name string, arguments string"),
        }

    def sql(self, text: str, params: list | None = None, idempotency_key: str | None = None):
        """A query's DataFrame, or a write's receipt."""
        from palimpsest.front import run

        return self._once(idempotency_key, [text, params], lambda: run(self, text, params or []))

    def _once(self, key: str | None, request, action):
        if key is None:
            return action()
        print_ = hashlib.sha256(json.dumps(request, default=str).encode()).hexdigest()
        seen = self.repo.meta.receipts.get(key)
        if seen:
            if seen["fingerprint"] != print_:
                raise E.IdempotencyReuse(key)
            return Receipt(seen["commit_id"], seen["rows_affected"])
        self._asked = {"key": key, "fingerprint": print_, "commit_id": None, "rows_affected": 0}
        try:
            out = action()
        finally:
            asked, self._asked = self._asked, None
        # what made no commit of its own has no record yet
        if isinstance(out, Receipt) and key not in self.repo.meta.receipts:
            self.repo.publish({"receipts": [asked | {"commit_id": out.commit_id, "rows_affected": out.rows_affected}]})
        return out

    def script(self, text: str) -> list:
        """Statements between BEGIN and COMMIT as one commit, or one after another without them."""
        from palimpsest.front import statements

        parts = statements(text)
        first, last = (parts[i].strip().lower() if parts else "" for i in (0, -1))
        if any(p.strip().lower().split()[0] in ("rollback", "savepoint", "release") for p in parts):
            raise E.UnsupportedSql("rollback and savepoints in a script")
        if first in ("begin", "begin transaction", "start transaction"):
            if last != "commit" or any(p.strip().lower() in ("begin", "commit") for p in parts[1:-1]):
                raise E.UnsupportedSql("a script is one BEGIN ... COMMIT")
            return self.batch(parts[1:-1])
        return [self.sql(p) for p in parts]

    # --- versions
    def composed_history(self, kind: str, commit: str | None = None) -> DataFrame:
        """(id, commit_id, depth, source_changes): revisions of files or directories along the commits that one reaches."""
        anchor = commit or self.head
        log = self.repo.log(sorted(self.repo.graph().ancestors(anchor)))
        parent = {"file_descriptor": "directory_id", "directory_descriptor": "parent_id"}
        owner, parts = ("file_descriptor", [("blob_ref", "id")]) if kind == "file" else ("directory_descriptor", [])
        return H.composed(log, anchor, owner, "id", parts, "directory_descriptor", parent)

    def history(self, key: str, commit: str | None = None, **more) -> DataFrame:
        if key in ("file", "directory"):
            return self.composed_history(key, commit)
        anchor = commit or self.head
        log = self.repo.log(sorted(self.repo.graph().ancestors(anchor)))
        schema = self.schema(key)
        rows = H.history(log, key, anchor, **more).withColumn("v", F.from_json("snapshot", schema.struct()))
        keys = F.from_json("row_pk", "array<string>")
        columns = []
        for c in schema.columns:
            value = F.col(f"v.{c.name}")
            if c.name in schema.primary_key:  # a deletion still names its row
                value = F.coalesce(value, keys[schema.primary_key.index(c.name)].cast(schema.struct()[c.name].dataType))
            columns.append(value.alias(c.name))
        return rows.select(*columns, "row_pk", "change_id", "commit_id", "depth", "deleted")

    def diff(self, before: str, after: str, **filters) -> DataFrame:
        return D.diff(self.repo.lineage_log(before, after), before, after, **filters)

    def working_diff(self, **filters) -> DataFrame:
        return self.diff(self.checkpoint_commit, self.head, **filters)

    def commit_ancestry(self, commit: str | None = None) -> DataFrame:
        rows = self.repo.graph().ancestors(commit or self.head)
        return self.spark.createDataFrame(sorted(rows.items(), key=lambda r: (r[1], r[0])), "commit_id string, depth bigint")

    # --- writes
    def _pk(self, schema: Schema) -> Column:
        """A row's key as JSON array text."""
        parts = [F.col(k).cast("string") if schema.column(k).type == "int8" else F.regexp_extract(F.to_json(F.struct(F.col(k).alias("k"))), r'^\{"k":(.*)\}$', 1) for k in schema.primary_key]
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))

    def _member(self, key: str, rows: DataFrame, deleted: bool, file_id: str | None = None, origin_key: str | None = None, metadata: str | None = None) -> DataFrame:
        """Members for typed rows of a schema."""
        schema = self.schema(key)
        snapshot = F.lit(None).cast("string") if deleted else F.to_json(F.struct(*[F.col(c.name) for c in schema.columns]), {"ignoreNullFields": "true"})
        return rows.select(
            F.lit(None).cast("string").alias("commit_id"), F.lit(key).alias("schema_key"), F.lit(file_id).cast("string").alias("file_id"), self._pk(schema).alias("row_pk"), uuidv7().alias("change_id"), F.lit(self.account).alias("account_id"),
            F.lit(deleted).alias("deleted"), snapshot.alias("snapshot"), F.lit(metadata).cast("string").alias("metadata"), F.current_timestamp().alias("updated_at"), F.lit(origin_key).cast("string").alias("origin_key"),
        )

    def _proposed(self, schema: Schema, rows: DataFrame) -> DataFrame:
        """Rows to insert with all columns in order, defaults filled in and types checked."""
        unknown = set(rows.columns) - {c.name for c in schema.columns}
        if unknown:
            raise E.ColumnNotFound(", ".join(sorted(unknown)))
        out = []
        for c in schema.columns:
            kind = schema.struct()[c.name].dataType
            if c.name in rows.columns:
                value = F.col(c.name).cast(kind)
            elif c.default_expression == "uuidv7()":
                value = uuidv7()
            elif c.default_expression == "CURRENT_TIMESTAMP":
                value = F.current_timestamp()
            elif c.default_value is not None:
                value = F.lit(json.dumps(c.default_value) if c.type == "jsonb" else c.default_value).cast(kind)
            elif not c.nullable:
                raise E.NotNullViolation(f"{schema.key}.{c.name} must be given")
            else:
                value = F.lit(None).cast(kind)
            if c.type == "jsonb":
                value = jsonb.call("jsonb", value)
            if c.type == "float8":
                value = F.when(value == 0, F.lit(0.0)).otherwise(value)
            out.append(value.alias(c.name))
        return rows.select(*out)

    def insert(self, key: str, rows: DataFrame, on_conflict: str | dict | None = None, **more) -> Receipt:
        """Inserts rows.  ``on_conflict``: "nothing", or columns to update, with ``excluded.<column>`` for the new value."""
        schema = self.schema(key)
        new = self._pinned(self._proposed(schema, rows))
        if new.groupBy(*schema.primary_key).count().filter("count > 1").limit(1).count():
            raise E.PrimaryKeyViolation(f"{key}: a key twice in one statement")
        old = self._typed(key)
        clash = new.alias("excluded").join(old.alias("own"), [F.col(f"excluded.{k}") == F.col(f"own.{k}") for k in schema.primary_key])
        if on_conflict is None:
            if clash.limit(1).count():
                raise E.PrimaryKeyViolation(key)
            changed = new
        else:
            fresh = new.join(old.select(*schema.primary_key), list(schema.primary_key), "left_anti").select(*[c.name for c in schema.columns])
            changed = fresh
            if on_conflict != "nothing":
                kept = [on_conflict.get(c.name, F.col(f"own.{c.name}")).alias(c.name) for c in schema.columns]
                changed = fresh.unionByName(clash.select(*kept))
            changed = self._pinned(changed)
        return self._write(key, changed, False, **more)

    def update(self, key: str, assignments: dict[str, Column], where: Column | str | None = None, **more) -> Receipt:
        schema = self.schema(key)
        if set(assignments) - {c.name for c in schema.columns}:
            raise E.ColumnNotFound(", ".join(assignments))
        old = self._typed(key)
        rows = old if where is None else old.filter(where)
        if set(assignments) & set(schema.primary_key):
            # a changed key is a deletion and an insertion
            moved = self._pinned(rows)
            new = self._proposed(schema, moved.withColumns(assignments))
            gone = self._member(key, moved.join(new.select(*schema.primary_key), list(schema.primary_key), "left_anti"), True)
            return self._write(key, self._pinned(new), False, extra=[gone], **more)
        return self._write(key, self._pinned(self._proposed(schema, rows.withColumns(assignments))), False, **more)

    def delete(self, key: str, where: Column | str | None = None, **more) -> Receipt:
        rows = self._typed(key)
        return self._write(key, self._pinned(rows if where is None else rows.filter(where)), True, **more)

    def delete_rows(self, key: str, keys: DataFrame, **more) -> Receipt:
        """Deletes the rows whose primary keys are in ``keys``."""
        rows = self._typed(key).join(keys, list(self.schema(key).primary_key), "left_semi")
        return self._write(key, self._pinned(rows), True, **more)

    def write_untracked(self, key: str, rows: DataFrame, deleted: bool = False) -> Receipt:
        """Writes rows (or, with ``deleted``, removes their keys) outside of the log; needs no commit."""
        schema = self.schema(key)
        new = self._pinned(rows if deleted else self._proposed(schema, rows))
        self._member(key, new, deleted).write.mode("append").parquet(f"{self.repo.path}/untracked/{self.branch_id}/{self.repo.ids()}")
        return Receipt(None, new.count(), new)

    def _pinned(self, rows: DataFrame) -> DataFrame:
        """Rows that stay as they are when read again: volatile defaults are drawn once."""
        return stored(rows)

    def _write(self, key: str, rows: DataFrame, deleted: bool, extra: list[DataFrame] | None = None, **more) -> Receipt:
        if key == "undo_marker":
            raise E.ReadOnly(key)
        count = rows.count()
        members = self._pinned(self._member(key, rows, deleted, **more))
        batch = [*(extra or []), members]
        return self._stage(batch, count, rows, {key})

    def _stage(self, batch: list[DataFrame], count: int, rows: DataFrame | None, touched: set[str] | None = None) -> Receipt:
        if self.closed:
            raise E.TransactionClosed("the session is closed")
        if not count and len(batch) == 1:
            return Receipt(None, 0, rows)
        own = self.staged is None
        if self._asked is not None:
            self._asked["rows_affected"] = count
        before = list(self.staged or [])
        self.staged = before + batch
        try:
            self.validate(batch, touched)
            commit = self._commit_staged() if own else None
        except Exception:
            self.staged = before
            raise
        finally:
            if own:
                self.staged = None
        return Receipt(commit, count, rows)

    # --- constraints
    def validate(self, batch: list[DataFrame], touched: set[str] | None = None) -> None:
        """Not-null, unique and foreign keys of the tables that the batch touches, on the state it leads to."""
        touched = touched or {r[0] for b in batch for r in b.select("schema_key").distinct().collect()}
        schemas = self.schemas()
        for key in sorted(touched & set(schemas)):
            schema = schemas[key]
            rows = self._typed(key)
            # all row checks in one job
            empty = [F.max(F.col(c.name).isNull().cast("int")) for c in schema.columns if not c.nullable]
            odd = [F.max((F.isnan(c.name) | (F.abs(c.name) == float("inf"))).cast("int")) for c in schema.columns if c.type == "float8"]
            seen = rows.agg(F.greatest(F.lit(0), F.lit(0), *empty), F.greatest(F.lit(0), F.lit(0), *odd)).first()
            if seen[0]:
                raise E.NotNullViolation(key)
            if seen[1]:
                raise E.TypeMismatch(f"{key}: floats must be finite")
            for group in schema.unique:
                filled = rows.dropna(subset=list(group))
                if filled.groupBy(*group).count().filter("count > 1").limit(1).count():
                    raise E.UniqueViolation(f"{key}{group}")
            for f in schema.foreign_keys:
                self._foreign(rows, key, f)
        for other in schemas.values():
            for f in other.foreign_keys:
                if f.schema_key in touched and other.key not in touched:
                    self._foreign(self._typed(other.key), other.key, f)

    def _foreign(self, rows: DataFrame, key: str, f) -> None:
        target = self._typed(f.schema_key).select(*[F.col(c).alias(f"r_{c}") for c in f.references])
        on = [F.col(a) == F.col(f"r_{b}") for a, b in zip(f.columns, f.references, strict=True)]
        if rows.dropna(subset=list(f.columns)).join(target, on, "left_anti").limit(1).count():
            raise E.ForeignKeyViolation(f"{key}{f.columns} -> {f.schema_key}{f.references}")

    # --- transactions
    def begin(self) -> Session:
        if self.staged is not None:
            raise E.TransactionConflict("a transaction is open")
        self.repo.refresh()
        self.staged = []
        self._base = self.head
        return self

    def __enter__(self) -> Session:
        return self.begin()

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()

    def commit(self) -> str | None:
        if self.staged is None:
            raise E.TransactionClosed("no transaction is open")
        try:
            return self._commit_staged() if self.staged else None
        finally:
            self.staged = None

    def rollback(self) -> None:
        self.staged = None

    def batch(self, statements: list) -> list:
        """Statements as one commit: (text, params) pairs or texts."""
        with self:
            return [self.sql(s) if isinstance(s, str) else self.sql(*s) for s in statements]

    def _commit_staged(self, parents: list[str] | None = None, **more) -> str:
        every = None
        for i, b in enumerate(self.staged):
            one = b.withColumn("seq", F.lit(i))
            every = one if every is None else every.unionByName(one)
        rest = [c for c in every.columns if c not in IDENTITY and c != "seq"]
        last = every.groupBy(*IDENTITY).agg(F.max_by(F.struct(*rest), "seq").alias("m")).select(*IDENTITY, "m.*")
        return self._append(last, parents or [self.head], **more)

    def _append(self, members: DataFrame | None, parents: list[str], branch: dict | None = None, **more) -> str:
        repo, base = self.repo, self.head
        commit = repo.ids()
        if members is not None:
            repo.write_members(commit, members.withColumn("commit_id", F.lit(commit)))
        while True:
            own = dict(repo.meta.branches[self.branch_id])
            head = own | {"commit_id": commit, "undone": [], "steps": [*own.get("steps", []), commit]} | (branch or {})
            record = {"commits": [repo.commit_record(commit, parents, **({"members": members is not None} | more))], "branches": [head]}
            if self._asked is not None:
                record["receipts"] = [self._asked | {"commit_id": commit}]
            try:
                repo.publish(record)
                return commit
            except E.TransactionConflict:
                repo.refresh()
                if self.branch_id not in repo.meta.branches or (self._asked and self._asked["key"] in repo.meta.receipts):
                    raise
                if self.head != base:
                    parents, base = self._follow(members, parents, base), self.head

    def _follow(self, members: DataFrame | None, parents: list[str], base: str) -> list[str]:
        """Parents on the head that another session has made since ``base``, if its commits leave my rows alone."""
        graph = self.repo.graph()
        since = graph.ancestors(self.head).keys() - graph.ancestors(base).keys()
        if parents != [base] or members is None or base not in graph.ancestors(self.head):
            raise E.TransactionConflict("the branch was moved by another session")
        if C.clashes(members, self.repo.members(sorted(since))).limit(1).count():
            raise E.TransactionConflict("another session has changed the same rows")
        self._known = None
        if self.staged:
            self.validate(self.staged)
        return [self.head]

    def _versions(self, commit: str) -> DataFrame:
        """All rows at a commit, deleted ones too, as members."""
        log = self.repo.lineage_log(commit)
        state = S.state_at(log, commit, with_deleted=True).select(*IDENTITY, "change_id").withColumnsRenamed({c: f"_{c}" for c in (*IDENTITY, "change_id")})
        same = (F.col("change_id") == F.col("_change_id")) & (F.col("schema_key") == F.col("_schema_key")) & (F.col("row_pk") == F.col("_row_pk")) & F.col("file_id").eqNullSafe(F.col("_file_id"))
        return log.members.join(state, same, "left_semi").dropDuplicates([*IDENTITY, "change_id"])

    # --- branches
    def create_branch(self, name: str, commit: str | None = None, hidden: bool = False) -> str:
        if any(b["name"] == name for b in self.repo.meta.branches.values()):
            raise E.InvalidBranch(f"{name} exists")
        at = commit or self.head
        if at not in self.repo.meta.commits:
            raise E.CommitNotFound(at)
        made = {"id": self.repo.ids(), "name": name, "hidden": hidden, "commit_id": at, "checkpoint_commit_id": at}
        self.repo.publish({"branches": [made]})
        return made["id"]

    def switch_branch(self, name: str) -> None:
        if self.staged is not None:
            raise E.TransactionConflict("a transaction is open")
        self.branch_id = self.repo.branch(name)["id"]

    def delete_branch(self, name: str) -> None:
        found = self.repo.branch(name)
        if found["id"] in (GLOBAL, "main", self.branch_id):
            raise E.InvalidBranch(f"{name} can't be deleted")
        self.repo.publish({"dropped": [found["id"]]})

    # --- merges
    def register_merger(self, key: str, column: str, merger: M.Merger) -> None:
        """Merges a column's values with ``merger(base, target, source)`` where both branches changed them."""
        if self.schema(key).column(column) is None:
            raise E.ColumnNotFound(column)
        self.mergers.setdefault(key, {})[column] = merger

    def merge_preview(self, source: str) -> dict:
        """outcome, base, and statistics of what a merge would bring."""
        other = self.repo.branch(source)
        if other["id"] == self.branch_id:
            raise E.InvalidBranch("a branch can't be merged into itself")
        target, from_ = self.head, other["commit_id"]
        base = self.repo.graph().merge_base(target, from_)
        kind = "AlreadyUpToDate" if base == from_ else "FastForward" if base == target else "MergeCommitted"
        stats = {"added": 0, "modified": 0, "removed": 0}
        if kind != "AlreadyUpToDate":
            plan = M.merge_plan(self.repo.lineage_log(base, target, from_), base, target, from_)
            stats |= {r[0]: r[1] for r in M.statistics(plan).collect()}
        return {"outcome": kind, "base": base, **stats, "total": sum(stats.values())}

    def merge_branch(self, source: str, strict: bool = False) -> Receipt:
        """Merges another branch into this one.  With ``strict`` a conflict is an error instead of being settled by column."""
        seen = self.merge_preview(source)
        other = self.repo.branch(source)
        if seen["outcome"] == "AlreadyUpToDate":
            return Receipt(None, 0)
        if seen["outcome"] == "FastForward":
            self.repo.publish({"branches": [dict(self.repo.meta.branches[self.branch_id]) | {"commit_id": other["commit_id"], "undone": [], "steps": []}]})
            return Receipt(other["commit_id"], seen["total"])
        target, from_, base = self.head, other["commit_id"], seen["base"]
        plan = self._pinned(M.merge_plan(self.repo.lineage_log(base, target, from_), base, target, from_))
        conflicts = plan.filter("action = 'conflict'")
        if strict and conflicts.limit(1).count():
            raise E.MergeConflict(f"{conflicts.count()} rows")
        taken = plan.filter("action = 'pick'").select(*IDENTITY, F.col("source_change_id").alias("change_id"), F.col("source_deleted").alias("deleted"), F.col("source_snapshot").alias("snapshot"), F.col("source_updated_at").alias("updated_at"))
        schemas = self.schemas()
        for (key,) in conflicts.select("schema_key").distinct().collect():
            schema = schemas[key]
            own = conflicts.filter(F.col("schema_key") == key)
            typed = own.withColumns({f"{side}_snapshot": F.from_json(f"{side}_snapshot", schema.struct()) for side in ("base", "target", "source")})
            settled = M.resolve(typed, [c.name for c in schema.columns], list(schema.primary_key), self.mergers.get(key))
            taken = taken.unionByName(settled.select(*IDENTITY, uuidv7().alias("change_id"), F.col("resolved_deleted").alias("deleted"), F.to_json("resolved").alias("snapshot"), F.current_timestamp().alias("updated_at")))
        members = self._pinned(taken.select(F.lit(None).cast("string").alias("commit_id"), *IDENTITY, "change_id", F.lit(self.account).alias("account_id"), "deleted", "snapshot", F.lit(None).cast("string").alias("metadata"), "updated_at", F.lit(None).cast("string").alias("origin_key")))
        self.staged = [members]
        try:
            self.validate([members])
            commit = self._commit_staged([target, from_], merge=True)
        finally:
            self.staged = None
        return Receipt(commit, seen["total"])

    # --- diff commands
    def _selected(self, diffs: DataFrame, backward: bool) -> DataFrame:
        ids = [r[0] for r in diffs.select("diff_id").collect()]  # names of rows a user picked
        if None in ids or len(set(ids)) < len(ids):
            raise E.StaleDiff("a diff is null or given twice")
        pairs = [D.decode_diff_id(i) for i in ids]
        dashed = lambda h: None if h is None else f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
        rows = [(dashed(b), dashed(a)) if backward else (dashed(a), dashed(b)) for a, b in pairs]
        return self.spark.createDataFrame([(o, n) for o, n in rows], "old_id string, new_id string")

    def revert(self, diffs: DataFrame) -> Receipt:
        """Moves the rows of ``diffs`` (diff_id) from their after side back to their before side."""
        return self._move(diffs, True)

    def apply(self, diffs: DataFrame) -> Receipt:
        """Moves the rows of ``diffs`` (diff_id) from their before side to their after side."""
        return self._move(diffs, False)

    def _move(self, diffs: DataFrame, backward: bool) -> Receipt:
        picked = self._selected(diffs, backward)
        n = picked.count()
        if not n:
            return Receipt(None, 0)
        every = self.repo.members().dropDuplicates(["change_id", *IDENTITY])
        old = every.select(F.col("change_id").alias("old_id"), *IDENTITY, F.col("deleted").alias("old_deleted"))
        new = every.select(F.col("change_id").alias("new_id"), *[F.col(c).alias(f"n_{c}") for c in IDENTITY], F.col("deleted").alias("new_deleted"), F.col("snapshot").alias("new_snapshot"))
        rows = picked.join(old, "old_id", "left").join(new, "new_id", "left")
        rows = rows.select(*[F.coalesce(c, f"n_{c}").alias(c) for c in IDENTITY], "old_id", F.coalesce("old_deleted", F.lit(True)).alias("old_deleted"), F.coalesce("new_deleted", F.lit(True)).alias("deleted"), "new_snapshot")
        now = self.rows().select(*[F.col(c).alias(f"h_{c}") for c in IDENTITY], F.col("change_id").alias("here"))
        rows = self._pinned(rows.join(now, (F.col("row_pk") == F.col("h_row_pk")) & (F.col("schema_key") == F.col("h_schema_key")) & F.col("file_id").eqNullSafe(F.col("h_file_id")), "left"))
        at = F.when(F.col("old_deleted"), F.col("here").isNull()).otherwise(F.coalesce(F.col("here") == F.col("old_id"), F.lit(False)))
        if rows.filter(~at | F.col("row_pk").isNull()).limit(1).count() or rows.count() != n:
            raise E.StaleDiff("a selected row has changed since")
        members = self._pinned(rows.select(F.lit(None).cast("string").alias("commit_id"), *IDENTITY, uuidv7().alias("change_id"), F.lit(self.account).alias("account_id"), "deleted", F.when(~F.col("deleted"), F.col("new_snapshot")).alias("snapshot"), F.lit(None).cast("string").alias("metadata"), F.current_timestamp().alias("updated_at"), F.lit(None).cast("string").alias("origin_key")))
        return self._stage([members], n, None)

    # --- checkpoints and restore points
    def create_checkpoint(self, diffs: DataFrame | None = None) -> str:
        """A commit with the whole state (or the state with the selected diffs only, and the rest as its child)."""
        if self.branch_id == GLOBAL:
            raise E.InvalidBranch("the global branch has no checkpoints")
        parent = self.checkpoint_commit
        now = self._versions(self.head)
        if diffs is None:
            commit = self.repo.ids()
            self.repo.write_members(commit, now.withColumn("commit_id", F.lit(commit)))
            head = dict(self.repo.meta.branches[self.branch_id]) | {"commit_id": commit, "checkpoint_commit_id": commit, "undone": [], "steps": []}
            self.repo.publish({"commits": [self.repo.commit_record(commit, [parent], members=True, checkpoint=self.repo.ids())], "branches": [head]})
            return commit
        working = self.working_diff()
        keys = [F.col(f"m.{c}").eqNullSafe(F.col(f"d.{c}")) for c in IDENTITY]
        on = keys[0] & keys[1] & keys[2]
        chosen = working.join(diffs.select("diff_id").distinct(), "diff_id", "left_semi")
        if chosen.count() != diffs.count():
            raise E.StaleDiff("a selected diff is not in the working diff")
        rest = self._pinned(now.alias("m").join(working.join(diffs.select("diff_id"), "diff_id", "left_anti").alias("d"), on, "left_semi"))
        before = self._versions(parent)
        kept = now.alias("m").join(rest.alias("d"), on, "left_anti").unionByName(before.alias("m").join(rest.alias("d"), on, "left_semi"))
        commit, child = self.repo.ids(), self.repo.ids()
        self.repo.write_members(commit, kept.withColumn("commit_id", F.lit(commit)))
        self.repo.write_members(child, rest.withColumn("commit_id", F.lit(child)))
        first = self.repo.commit_record(commit, [parent], members=True, checkpoint=self.repo.ids())
        second = {"id": child, "parents": [commit], "generation": first["generation"] + 1, "created_at": first["created_at"], "members": True}
        head = dict(self.repo.meta.branches[self.branch_id]) | {"commit_id": child, "checkpoint_commit_id": commit, "undone": [], "steps": []}
        self.repo.publish({"commits": [first, second], "branches": [head]})
        return commit

    def restore(self, commit: str) -> None:
        """Moves the head back to one of its ancestors; no commit is made."""
        if commit not in self.repo.graph().ancestors(self.head):
            raise E.CommitNotFound(f"{commit} is no ancestor of the head")
        self.repo.publish({"branches": [dict(self.repo.meta.branches[self.branch_id]) | {"commit_id": commit, "undone": [], "steps": []}]})

    # --- undo and redo
    def undo(self) -> str:
        """Stages the inverse of the newest commit that is not undone; merges, checkpoints and restores are floors."""
        branch = self.repo.meta.branches[self.branch_id]
        steps, undone = branch.get("steps", []), branch.get("undone", [])
        if not steps:
            raise E.NothingToUndo(self.branch_id)
        target = steps[-1]
        record = self.repo.meta.commits[target]
        if record.get("merge") or len(record["parents"]) != 1:
            raise E.NothingToUndo("a merge")
        commit = self._replay(target, record["parents"][0])
        self._mark(commit, steps[:-1], [*undone, target])
        return commit

    def redo(self) -> str:
        branch = self.repo.meta.branches[self.branch_id]
        steps, undone = branch.get("steps", []), branch.get("undone", [])
        if not undone:
            raise E.NothingToRedo(self.branch_id)
        target = undone[-1]
        commit = self._replay(self.repo.meta.commits[target]["parents"][0], target)
        self._mark(commit, [*steps, target], undone[:-1])
        return commit

    def _replay(self, before: str, after: str) -> str:
        rows = self.diff(before, after)
        members = self._pinned(rows.select(F.lit(None).cast("string").alias("commit_id"), *IDENTITY, uuidv7().alias("change_id"), F.lit(self.account).alias("account_id"), (F.col("diff_type") == "removed").alias("deleted"), F.col("after_snapshot").alias("snapshot"), F.lit(None).cast("string").alias("metadata"), F.current_timestamp().alias("updated_at"), F.lit(None).cast("string").alias("origin_key")))
        self.staged = [members]
        try:
            self.validate([members])
            return self._commit_staged()
        finally:
            self.staged = None

    def _mark(self, commit: str, steps: list[str], undone: list[str]) -> None:
        self.repo.publish({"branches": [dict(self.repo.meta.branches[self.branch_id]) | {"steps": steps, "undone": undone}]})

    # --- live queries
    def observe(self, text: str, params: list | None = None):
        from palimpsest.streaming.live import Observation

        return Observation(self, text, params or [])

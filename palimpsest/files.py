"""Files and directories of a session, stored as rows: descriptors, and contents by hash."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import errors as E
from palimpsest.operators import paths as P
from palimpsest.repository import Receipt, Session
from palimpsest.sources import formats

BLOB = "hash string, content binary"


def _bytes(content) -> bytes:
    if content is None:
        raise E.NotNullViolation("file.content")
    return content.encode() if isinstance(content, str) else bytes(content)


class Files:
    """``Files(session)``: whole files by path.  Every call is one commit, or part of an open transaction."""

    def __init__(self, session: Session):
        self.session, self.repo, self.spark = session, session.repo, session.spark

    # --- relations
    def directories(self) -> DataFrame:
        """(id, path, parent_id, name)."""
        own = self.session._typed("directory_descriptor")
        return own.join(P.directory_paths(own).select("id", "path"), "id").select("id", "path", "parent_id", "name")

    def files(self, content: bool = False) -> DataFrame:
        """(id, path, directory_id, name, hash, size[, content]); contents are only read if asked for."""
        found = P.file_paths(self.session._typed("file_descriptor"), self.session._typed("directory_descriptor"))
        found = found.join(self.session._typed("blob_ref"), "id", "left").select("id", "path", "directory_id", "name", "hash", "size")
        return found.join(self._blobs(), "hash", "left") if content else found

    def _blobs(self) -> DataFrame:
        where = f"{self.repo.path}/blobs"
        fs, path = self.repo.fs._at(where)
        if not fs.exists(path):
            return self.spark.createDataFrame([], BLOB)
        return self.spark.read.schema(BLOB).parquet(where).dropDuplicates(["hash"])

    def _find(self, path: str):
        return self.files().filter(F.col("path") == path).first()

    # --- commands
    @contextmanager
    def _as_one(self):
        """All writes within as one commit, or as part of the open transaction."""
        outer = self.session.staged is None
        if outer:
            self.session.begin()
        try:
            yield
            if outer:
                self.commit_id = self.session.commit()
        except Exception:
            if outer:
                self.session.rollback()
            raise

    def _directory(self, parts: list[str]) -> str | None:
        """The id of the directory, made with all above it where it is missing."""
        if not parts:
            return None
        known = {r["path"]: r["id"] for r in self.directories().filter(F.col("path").isin(["/" + "/".join(parts[: i + 1]) for i in range(len(parts))])).collect()}
        parent = None
        for i, name in enumerate(parts):
            path = "/" + "/".join(parts[: i + 1])
            if path not in known:
                if self._find(path) is not None:
                    raise E.InvalidPath(f"{path} is a file")
                known[path] = self.repo.ids()
                row = self.spark.createDataFrame([(known[path], parent, name)], "id string, parent_id string, name string")
                self.session.insert("directory_descriptor", row)
            parent = known[path]
        return parent

    def make_directory(self, path: str) -> str | None:
        with self._as_one():
            return self._directory(P.segments(path))

    def write(self, path: str, content: bytes) -> str:
        """Writes a whole file, new or old; returns its id."""
        parts = P.segments(path)
        if not parts:
            raise E.InvalidPath(path)
        if self.directories().filter(F.col("path") == path).limit(1).count():
            raise E.InvalidPath(f"{path} is a directory")
        digest = hashlib.sha256(content).hexdigest()
        old = self._find(path)
        if old is not None and old["hash"] == digest:
            return old["id"]
        if not self._blobs().filter(F.col("hash") == digest).limit(1).count():
            self.spark.createDataFrame([(digest, bytearray(content))], BLOB).write.mode("append").parquet(f"{self.repo.path}/blobs")
        with self._as_one():
            file_id = old["id"] if old is not None else self.repo.ids()
            if old is None:
                row = self.spark.createDataFrame([(file_id, self._directory(parts[:-1]), parts[-1])], "id string, directory_id string, name string")
                self.session.insert("file_descriptor", row)
            ref = self.spark.createDataFrame([(file_id, digest, len(content))], "id string, hash string, size bigint")
            self.session.insert("blob_ref", ref, on_conflict={"hash": F.col("excluded.hash"), "size": F.col("excluded.size")})
        return file_id

    def read(self, path: str, start: int = 0, length: int | None = None) -> bytes:
        """A file's bytes, or a range of them."""
        row = self._find(path)
        if row is None:
            raise E.InvalidPath(path)
        part = F.col("content") if not start and length is None else F.substring("content", start + 1, length if length is not None else 2**31 - 1)
        return bytes(self._blobs().filter(F.col("hash") == row["hash"]).select(part).first()[0])

    def delete(self, path: str) -> Receipt:
        receipt = self.delete_where(F.col("path") == path)
        if not receipt.rows_affected:
            raise E.InvalidPath(path)
        return receipt

    def delete_where(self, where=None) -> Receipt:
        """Deletes the files that a condition holds for, with their contents' references."""
        found = self.files()
        gone = self.session._pinned((found if where is None else found.filter(where)).select("id"))
        return self._delete(gone, None)

    def _delete(self, files: DataFrame, directories: DataFrame | None) -> Receipt:
        with self._as_one():
            self.session.delete_rows("blob_ref", files)
            done = self.session.delete_rows("file_descriptor", files).rows_affected
            if directories is not None:
                done += self.session.delete_rows("directory_descriptor", directories).rows_affected
        return Receipt(getattr(self, "commit_id", None), done, files)

    def move(self, path: str, to: str) -> Receipt:
        """Renames or moves a file; its id and contents stay."""
        row, parts = self._find(path), P.segments(to)
        if row is None or not parts or self._find(to) is not None:
            raise E.InvalidPath(f"{path} -> {to}")
        with self._as_one():
            receipt = self.session.update("file_descriptor", {"directory_id": F.lit(self._directory(parts[:-1])).cast("string"), "name": F.lit(parts[-1])}, F.col("id") == row["id"])
        return receipt

    def delete_directory(self, path: str) -> int:
        """Deletes a directory with all below it; returns how many files and directories went."""
        done = self.delete_directories(F.col("path") == path).rows_affected
        if not done:
            raise E.InvalidPath(path)
        return done

    def delete_directories(self, where=None) -> Receipt:
        """Deletes the directories that a condition holds for, with all below them."""
        found = self.directories()
        root = (found if where is None else found.filter(where)).select("id")
        gone = self.session._pinned(P.descendants(self.session._typed("directory_descriptor"), root).select("id"))
        files = self.session._typed("file_descriptor").join(gone.withColumnRenamed("id", "directory_id"), "directory_id", "left_semi").select("id")
        return self._delete(self.session._pinned(files), gone)

    # --- rows of the relations ``file`` and ``directory``
    def insert(self, kind: str, rows: DataFrame) -> Receipt:
        """Makes files from (path, content), or directories from (path); one commit. The rows of one statement go through the driver."""
        wanted = {"file": {"path", "content"}, "directory": {"path"}}[kind]
        if set(rows.columns) != wanted:
            raise E.ColumnNotFound(f"{kind} is written by {', '.join(sorted(wanted))}")
        given = rows.collect()
        known = {r[0] for r in (self.files() if kind == "file" else self.directories()).select("path").join(rows.select("path"), "path", "left_semi").collect()}
        if known or len({r["path"] for r in given}) < len(given):
            raise E.UniqueViolation(f"{kind}(path)")
        with self._as_one():
            for r in given:
                if kind == "directory":
                    self._directory(P.segments(r["path"]))
                else:
                    self.write(r["path"], _bytes(r["content"]))
        return Receipt(getattr(self, "commit_id", None), len(given), rows)

    def update(self, assigned: dict, where=None) -> Receipt:
        """Sets the contents or paths of the files that a condition holds for; one commit."""
        if set(assigned) - {"content", "path"}:
            raise E.ColumnNotFound(", ".join(assigned))
        found = self.files(content=True)
        rows = (found if where is None else found.filter(where)).select("path", *[c.alias(f"new_{k}") for k, c in assigned.items()]).collect()
        with self._as_one():
            for r in rows:
                if "content" in assigned:
                    self.write(r["path"], _bytes(r["new_content"]))
                if "path" in assigned and r["new_path"] != r["path"]:
                    self.move(r["path"], r["new_path"])
        return Receipt(getattr(self, "commit_id", None), len(rows))

    # --- contents as rows
    def rows(self, kind: str) -> DataFrame:
        """Rows of all files whose name has the format's ending."""
        endings = [e for e, k in formats.ENDINGS.items() if k == kind]
        some = self.files(content=True).filter(F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).isin(endings))
        return formats.project(some.select(F.col("id").alias("file_id"), "content"), kind)

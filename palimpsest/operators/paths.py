"""Directory trees: paths from parents, descendants, and what a change of a directory affects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import InvalidPath
from palimpsest.sources.store import local, stored

MAX_DEPTH = 256
#: Directories up to which paths are made on the driver.
FEW = 20_000


def segments(path: str) -> list[str]:
    """Segments of an absolute path; anything but plain segments is an error."""
    if not path.startswith("/") or (path != "/" and path.endswith("/")):
        raise InvalidPath(path)
    parts = path.split("/")[1:] if path != "/" else []
    if any(p in ("", ".", "..") or "\0" in p for p in parts):
        raise InvalidPath(path)
    return parts


def _few(directories: DataFrame) -> list | None:
    """(id, parent_id, name) of all directories where these are at most ``FEW``; one job instead of one a level."""
    rows = directories.select("id", "parent_id", "name").limit(FEW + 1).collect()
    return rows if len(rows) <= FEW else None


def _paths_of(directories: DataFrame, rows: list) -> DataFrame:
    below: dict = {}
    for r in rows:
        below.setdefault(r["parent_id"], []).append(r)
    found, layer, depth = [], [(r["id"], "/" + r["name"]) for r in below.get(None, []) if r["name"] is not None], 1
    while layer:
        if depth > MAX_DEPTH:
            raise InvalidPath(f"more than {MAX_DEPTH} levels")
        found += [(i, path, depth) for i, path in layer]
        layer, depth = [(r["id"], f"{path}/{r['name']}") for i, path in layer if i is not None for r in below.get(i, []) if r["name"] is not None], depth + 1
    return local(directories.sparkSession, found, f"id {directories.schema['id'].dataType.simpleString()}, path string, depth int")


def directory_paths(directories: DataFrame) -> DataFrame:
    """(id, path, depth) of directories (id, parent_id, name), from the roots down, a level at a time.

    Directories that hang on themselves or on nothing never get a path; a chain of
    more than ``MAX_DEPTH`` is an error.
    """
    few = _few(directories)
    if few is not None:
        return _paths_of(directories, few)
    layer = stored(directories.filter("parent_id is null").select("id", F.concat(F.lit("/"), "name").alias("path"), F.lit(1).alias("depth")))
    found, depth = layer, 1
    while not layer.isEmpty():
        if depth > MAX_DEPTH:
            raise InvalidPath(f"more than {MAX_DEPTH} levels")
        above = layer.select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
        layer = stored(directories.join(above, "parent_id").select("id", F.concat("above", F.lit("/"), "name").alias("path"), F.lit(depth + 1).alias("depth")))
        found = found.unionByName(layer)
        depth += 1
    return found


def lost_directories(directories: DataFrame) -> DataFrame:
    """Directories without a path: members of a cycle, what is below it, and orphans."""
    return directories.join(directory_paths(directories).select("id"), "id", "left_anti")


def file_paths(files: DataFrame, directories: DataFrame) -> DataFrame:
    """``files`` (id, directory_id, name ...) with their paths."""
    above = directory_paths(directories).select(F.col("id").alias("directory_id"), F.col("path").alias("above"))
    return files.join(above, "directory_id", "left").filter("directory_id is null or above is not null").withColumn("path", F.concat(F.coalesce("above", F.lit("")), F.lit("/"), "name")).drop("above")


def descendants(directories: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) of the given directories (id) and all below them, each once."""
    few = _few(directories.select("id", "parent_id", F.lit("").alias("name")))
    start = roots.select("id").distinct().limit(FEW + 1).collect() if few is not None else None
    if few is not None and len(start) <= FEW:
        below: dict = {}
        for r in few:
            below.setdefault(r["parent_id"], []).append(r["id"])
        depths = {r["id"]: 0 for r in start}
        queue = list(depths)
        for i in queue:
            for child in below.get(i, ()) if i is not None else ():
                if child not in depths:
                    depths[child] = depths[i] + 1
                    queue.append(child)
        return local(directories.sparkSession, list(depths.items()), f"id {directories.schema['id'].dataType.simpleString()}, depth int")
    layer = stored(roots.select("id", F.lit(0).alias("depth")).distinct())
    found, depth = layer, 0
    while not layer.isEmpty():
        depth += 1
        below = directories.join(layer.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct()
        layer = stored(below.join(found.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        found = found.unionByName(layer)
    return found


def ancestors_of_files(files: DataFrame, directories: DataFrame) -> DataFrame:
    """(file_id, directory_id): every directory above each file; what a directory's change affects."""
    up = stored(files.filter("directory_id is not null").select(F.col("id").alias("file_id"), "directory_id"))
    found = up
    while not up.isEmpty():
        parent = directories.filter("parent_id is not null").select(F.col("id").alias("directory_id"), "parent_id")
        up = stored(up.join(parent, "directory_id").select("file_id", F.col("parent_id").alias("directory_id")).join(found, ["file_id", "directory_id"], "left_anti"))
        found = found.unionByName(up)
    return found


def glob_pattern(path: str) -> str:
    """A pattern for LIKE that matches what is below a directory."""
    return re.sub(r"([%_\\])", r"\\\1", path.rstrip("/")) + "/%"

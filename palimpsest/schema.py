"""Row schemas: documents that declare a table's columns, keys and constraints."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from palimpsest.errors import ReservedNamespace, SchemaDefinition
from palimpsest.functions.jsonb import dump, parse

#: Column types and their Spark types; jsonb and uuid are texts at the boundary.
TYPES = {"text": T.StringType(), "uuid": T.StringType(), "int8": T.LongType(), "float8": T.DoubleType(), "boolean": T.BooleanType(), "jsonb": T.StringType(), "timestamptz": T.TimestampType()}
KEY_TYPES = ("text", "uuid", "int8")
EXPRESSIONS = ("uuidv7()", "CURRENT_TIMESTAMP")
RESERVED = "vt"
_NAME = re.compile(r"[a-z_][a-z0-9_]{0,62}")


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default_value: object = None
    default_expression: str | None = None

    @property
    def defaulted(self) -> bool:
        return self.default_value is not None or self.default_expression is not None

    @property
    def insert_policy(self) -> str:
        return "DEFAULT" if self.defaulted else "OPTIONAL" if self.nullable else "REQUIRED"


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    schema_key: str
    references: tuple[str, ...]


@dataclass(frozen=True)
class Schema:
    key: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    document: str = field(default="", compare=False)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.type], True, {"type": c.type, "insert_policy": c.insert_policy}) for c in self.columns])

    @classmethod
    def of(cls, document: str | dict, internal: bool = False) -> Schema:
        """A schema from its document; whatever is wrong with it is an error."""
        doc = parse(document if isinstance(document, str) else json.dumps(document))
        if not isinstance(doc, dict):
            raise SchemaDefinition("a schema is a JSON object")
        unknown = set(doc) - {"$schema", "key", "description", "columns", "primary_key", "unique", "foreign_keys", "examples", "deprecated"}
        if unknown:
            raise SchemaDefinition(f"unknown members: {', '.join(sorted(unknown))}")
        key = doc.get("key")
        _check_name(key)
        if not internal and (key == RESERVED or key.startswith(RESERVED + "_")):
            raise ReservedNamespace(key)
        columns = tuple(_column(c) for c in doc.get("columns") or [])
        names = [c.name for c in columns]
        if not names or len(set(names)) < len(names):
            raise SchemaDefinition("columns must be there, with different names")
        by = {c.name: c for c in columns}
        pk = tuple(doc.get("primary_key") or ())
        if not pk or len(set(pk)) < len(pk):
            raise SchemaDefinition("a primary key of different columns is needed")
        for name in pk:
            if name not in by or by[name].nullable or by[name].type not in KEY_TYPES:
                raise SchemaDefinition(f"key column {name} must be a non-null text, uuid or int8")
        unique = tuple(tuple(u) for u in doc.get("unique") or ())
        foreign = tuple(ForeignKey(tuple(f["columns"]), f["references"]["schema_key"], tuple(f["references"]["columns"])) for f in doc.get("foreign_keys") or ())
        for group in (*unique, *(f.columns for f in foreign)):
            if not group or any(n not in by for n in group):
                raise SchemaDefinition(f"unknown column in {group}")
        if any(len(f.columns) != len(f.references) for f in foreign):
            raise SchemaDefinition("a foreign key must name as many columns as it references")
        return cls(key, columns, pk, unique, foreign, dump(doc))


def _check_name(name) -> None:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise SchemaDefinition(f"not a lower-case identifier: {name!r}")


def _column(doc: dict) -> Column:
    _check_name(doc.get("name"))
    if doc.get("type") not in TYPES:
        raise SchemaDefinition(f"{doc['name']}: unknown type {doc.get('type')!r}")
    expression = doc.get("default_expression")
    if expression is not None and expression not in EXPRESSIONS:
        raise SchemaDefinition(f"{doc['name']}: unknown default {expression!r}")
    if expression is not None and "default_value" in doc:
        raise SchemaDefinition(f"{doc['name']}: two defaults")
    return Column(doc["name"], doc["type"], doc.get("nullable", True), doc.get("default_value"), expression)


def amend(old: Schema, new: Schema) -> Schema:
    """``new`` if it only appends nullable or defaulted columns to ``old``."""
    if old.key != new.key or (old.primary_key, old.unique, old.foreign_keys) != (new.primary_key, new.unique, new.foreign_keys):
        raise SchemaDefinition("key and constraints may not change")
    if new.columns[: len(old.columns)] != old.columns:
        raise SchemaDefinition("columns may not be removed, renamed, moved or changed")
    for c in new.columns[len(old.columns) :]:
        if not (c.nullable or c.defaulted):
            raise SchemaDefinition(f"appended column {c.name} must be nullable or have a default")
    return new


BUILTIN = {
    s.key: s
    for s in (
        Schema.of({"key": "key_value", "columns": [{"name": "key", "type": "text", "nullable": False}, {"name": "value", "type": "jsonb"}], "primary_key": ["key"]}),
        Schema.of({"key": "registered_schema", "columns": [{"name": "schema_key", "type": "text", "nullable": False}, {"name": "value", "type": "jsonb", "nullable": False}], "primary_key": ["schema_key"]}),
        Schema.of({"key": "account", "columns": [{"name": "id", "type": "uuid", "nullable": False, "default_expression": "uuidv7()"}, {"name": "kind", "type": "text", "nullable": False}, {"name": "name", "type": "text", "nullable": False}, {"name": "status", "type": "text", "nullable": False}], "primary_key": ["id"]}),
        Schema.of({"key": "directory_descriptor", "columns": [{"name": "id", "type": "uuid", "nullable": False, "default_expression": "uuidv7()"}, {"name": "parent_id", "type": "uuid"}, {"name": "name", "type": "text", "nullable": False}], "primary_key": ["id"]}),
        Schema.of({"key": "file_descriptor", "columns": [{"name": "id", "type": "uuid", "nullable": False, "default_expression": "uuidv7()"}, {"name": "directory_id", "type": "uuid"}, {"name": "name", "type": "text", "nullable": False}], "primary_key": ["id"]}),
        Schema.of({"key": "blob_ref", "columns": [{"name": "id", "type": "uuid", "nullable": False}, {"name": "hash", "type": "text", "nullable": False}, {"name": "size", "type": "int8", "nullable": False}], "primary_key": ["id"]}),
        Schema.of({"key": "undo_marker", "columns": [{"name": "id", "type": "text", "nullable": False}, {"name": "kind", "type": "text", "nullable": False}, {"name": "commit_id", "type": "text", "nullable": False}], "primary_key": ["id"]}),
    )
}
#: Schemas that have no table of their own.
PRIVATE = frozenset(["directory_descriptor", "file_descriptor", "blob_ref", "undo_marker"])

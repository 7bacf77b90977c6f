"""Errors with stable codes."""

from __future__ import annotations


class PalimpsestError(Exception):
    code = "INTERNAL"


def _kind(name: str, code: str) -> type[PalimpsestError]:
    return type(name, (PalimpsestError,), {"code": code})


ParseError = _kind("ParseError", "PARSE_ERROR")
TypeMismatch = _kind("TypeMismatch", "TYPE_MISMATCH")
TableNotFound = _kind("TableNotFound", "TABLE_NOT_FOUND")
ColumnNotFound = _kind("ColumnNotFound", "COLUMN_NOT_FOUND")
ReadOnly = _kind("ReadOnly", "READ_ONLY")
UnsupportedSql = _kind("UnsupportedSql", "UNSUPPORTED_SQL")
PrimaryKeyViolation = _kind("PrimaryKeyViolation", "PRIMARY_KEY")
UniqueViolation = _kind("UniqueViolation", "UNIQUE")
NotNullViolation = _kind("NotNullViolation", "NOT_NULL")
ForeignKeyViolation = _kind("ForeignKeyViolation", "FOREIGN_KEY")
SchemaDefinition = _kind("SchemaDefinition", "SCHEMA_DEFINITION")
ReservedNamespace = _kind("ReservedNamespace", "RESERVED_NAMESPACE")
MergeConflict = _kind("MergeConflict", "MERGE_CONFLICT")
NoCommonHistory = _kind("NoCommonHistory", "NO_COMMON_HISTORY")
AmbiguousMergeBase = _kind("AmbiguousMergeBase", "AMBIGUOUS_MERGE_BASE")
CommitNotFound = _kind("CommitNotFound", "COMMIT_NOT_FOUND")
BranchNotFound = _kind("BranchNotFound", "BRANCH_NOT_FOUND")
InvalidBranch = _kind("InvalidBranch", "INVALID_BRANCH")
NothingToUndo = _kind("NothingToUndo", "NOTHING_TO_UNDO")
NothingToRedo = _kind("NothingToRedo", "NOTHING_TO_REDO")
TransactionConflict = _kind("TransactionConflict", "TRANSACTION_CONFLICT")
TransactionClosed = _kind("TransactionClosed", "TRANSACTION_CLOSED")
IdempotencyReuse = _kind("IdempotencyReuse", "IDEMPOTENCY_KEY_REUSE")
StaleDiff = _kind("StaleDiff", "STALE_DIFF")
InvalidPath = _kind("InvalidPath", "INVALID_PATH")
InvalidJson = _kind("InvalidJson", "INVALID_JSON")

"""Scalar functions with semantics of their own."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.errors import TypeMismatch


def uuid7(millis: int | None = None, tail: bytes | None = None) -> str:
    """A time-ordered UUID."""
    millis = time.time_ns() // 1_000_000 if millis is None else millis
    raw = bytearray((millis & ((1 << 48) - 1)).to_bytes(6, "big") + (tail or os.urandom(10)))
    raw[6] = raw[6] & 0x0F | 0x70
    raw[8] = raw[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(raw)))


class Ids:
    """Time-ordered ids that never go back, or with ``start`` the same ones in every run."""

    def __init__(self, start: int | None = None):
        self.fixed, self.last, self.count = start is not None, start or 0, 0

    def __call__(self) -> str:
        self.count += 1
        now = self.last if self.fixed else max(self.last, time.time_ns() // 1_000_000)
        self.last = now
        return uuid7(now, bytes(3) + self.count.to_bytes(4, "big") + (bytes(3) if self.fixed else os.urandom(3)))


def uuidv7() -> Column:
    """A new time-ordered UUID for each row; volatile, compiled: no Python runs."""
    millis = F.unix_millis(F.current_timestamp())
    noise = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    stamp = F.lpad(F.lower(F.hex(millis)), 12, "0")
    return F.concat_ws("-", F.substring(stamp, 1, 8), F.substring(stamp, 9, 4), F.concat(F.lit("7"), F.substring(noise, 14, 3)), F.concat(F.lit("8"), F.substring(noise, 18, 3)), F.substring(noise, 21, 12))


def octet_length(df, column: str) -> Column:
    """Bytes of a text or binary column; other types are refused."""
    kind = dict(df.dtypes)[column]
    if kind not in ("string", "binary"):
        raise TypeMismatch(f"octet_length takes text or bytes, not {kind}")
    return F.octet_length(F.col(column))

"""JSONB values: canonical text, and PostgreSQL's operators on it.

A value is kept as canonical JSON text: keys sorted by code point, the last of
equal keys, no white space, whole floats within 2^53 as integers, U+0000 refused.
Canonical texts are equal where the values are.  All functions give null for a
null input.  They are Arrow UDFs; ``field`` is a compiled short cut for text under
one key of an object.
"""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from palimpsest.errors import InvalidJson

_floats = 0


def _float(text: str):
    """A number with a point or an exponent: an integer where it is a whole one within 2^53."""
    global _floats
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise InvalidJson(text)
    if value == int(value) and abs(value) <= 2**53:
        return int(value)
    _floats += 1
    return value


def _refuse(name: str):
    raise InvalidJson(name)


_DECODER = json.JSONDecoder(parse_float=_float, parse_constant=_refuse)
_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _holds_nul(value) -> bool:
    if isinstance(value, str):
        return "\0" in value
    if isinstance(value, dict):
        return any(_holds_nul(k) or _holds_nul(v) for k, v in value.items())
    return isinstance(value, list) and any(map(_holds_nul, value))


def parse(text: str):
    """The normalised value of a JSON text."""
    try:
        value = _DECODER.decode(text)
        if "\\u0000" in text and _holds_nul(value):
            raise InvalidJson("U+0000 in a JSONB string")
    except (ValueError, OverflowError, RecursionError) as error:
        raise InvalidJson(str(error)) from error
    return value


def dump(value) -> str:
    """Canonical text of a normalised value."""
    if isinstance(value, float):
        return re.sub(r"e\+?(-?)0*", r"e\1", repr(value))
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{dump(k)}:{dump(value[k])}" for k in sorted(value)) + "}"
    return json.dumps(value, ensure_ascii=False)


_MISSING = object()


def step(value, key, index_ok: bool):
    """The member under a key or, where allowed, a possibly negative index."""
    if isinstance(value, dict):
        return value.get(key, _MISSING) if isinstance(key, str) else _MISSING
    if isinstance(value, list) and index_ok:
        try:
            at = int(key)
        except ValueError:
            return _MISSING
        return value[at] if -len(value) <= at < len(value) else _MISSING
    return _MISSING


def path_parts(path: str) -> list[str]:
    """Segments of a text array such as {a,0,b}."""
    path = path.strip()
    if not (path.startswith("{") and path.endswith("}")):
        raise InvalidJson(f"not a path: {path}")
    return path[1:-1].split(",") if path[1:-1] else []


def get(value, key):
    """``->``: text keys name object members only, integers array elements only."""
    if isinstance(key, str):
        return step(value, key, False)
    return step(value, key, True) if isinstance(value, list) else _MISSING


def walk(value, path: str):
    """``#>``."""
    for part in path_parts(path):
        value = step(value, part, True)
        if value is _MISSING:
            break
    return value


def contains(left, right) -> bool:
    """``@>``: objects member by member; each right element in some left one; an array may contain a scalar."""
    if isinstance(left, dict) and isinstance(right, dict):
        return all(k in left and contains(left[k], v) for k, v in right.items())
    if isinstance(left, list) and isinstance(right, list):
        return all(any(contains(x, v) for x in left) for v in right)
    if isinstance(left, list):
        return any(contains(x, right) for x in left)
    return type(left) is type(right) and left == right if isinstance(left, bool) or isinstance(right, bool) else left == right


def exists(value, key: str) -> bool:
    """``?``: a key of an object, or a string element of an array."""
    return key in value if isinstance(value, dict) else isinstance(value, list) and any(isinstance(v, str) and v == key for v in value)


def as_json(value, floats: bool = True) -> str | None:
    """Canonical text; without ``floats`` in the value the compiled encoder gives it."""
    return None if value is _MISSING else dump(value) if floats else _ENCODER.encode(value)


def as_text(value, floats: bool = True) -> str | None:
    if value is _MISSING or value is None:
        return None
    return value if isinstance(value, str) else as_json(value, floats)


def _null(x) -> bool:
    return x is None or x is pd.NA or (isinstance(x, float) and x != x)


def _each(f, *columns: pd.Series) -> pd.Series:
    """f(value, whether it has floats, ...) of each text; equal neighbours are computed once."""
    out, last, result = [], None, None
    for row in zip(*columns, strict=True):
        if row != last:
            last = row
            if any(map(_null, row)):
                result = None
            else:
                before = _floats
                value = parse(row[0])
                result = f(value, _floats > before, *row[1:])
        out.append(result)
    return pd.Series(out, dtype=object)


@functools.lru_cache(256)
def _parsed(text: str):
    return parse(text)


def _one(f):
    return lambda a: _each(f, a)


def _two(f):
    return lambda a, b: _each(f, a, b)


_FUNCTIONS = {
    "jsonb": (_one(as_json), "string"),
    "jsonb_get": (_two(lambda v, fl, k: as_json(get(v, k), fl)), "string"),
    "jsonb_get_text": (_two(lambda v, fl, k: as_text(get(v, k), fl)), "string"),
    "jsonb_element": (_two(lambda v, fl, k: as_json(get(v, int(k)), fl)), "string"),
    "jsonb_element_text": (_two(lambda v, fl, k: as_text(get(v, int(k)), fl)), "string"),
    "jsonb_path": (_two(lambda v, fl, p: as_json(walk(v, p), fl)), "string"),
    "jsonb_path_text": (_two(lambda v, fl, p: as_text(walk(v, p), fl)), "string"),
    "jsonb_contains": (_two(lambda v, fl, w: contains(v, _parsed(w))), "boolean"),
    "jsonb_exists": (_two(lambda v, fl, k: exists(v, k)), "boolean"),
}


def _make(name: str):
    f, kind = _FUNCTIONS[name]
    if f.__code__.co_argcount == 1:

        def one(a: pd.Series) -> pd.Series:
            return f(a)

        return F.pandas_udf(one, kind)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return f(a, b)

    return F.pandas_udf(two, kind)


def call(name: str, *args: Column) -> Column:
    """A JSONB function by its name in SQL."""
    return _make(name)(*args)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL."""
    for name in _FUNCTIONS:
        spark.udf.register(name, _make(name))


def field(column: Column, key: str) -> Column:
    """Text under a key of canonical objects, compiled: ``->>`` for columns that hold JSONB."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key):
        raise ValueError("only plain keys have a short cut")
    return F.get_json_object(column, f"$.{key}")

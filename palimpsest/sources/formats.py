"""Files as rows and back: text lines, CSV and TSV, JSON, Markdown and drawing scenes.

Each format has ``parse`` (bytes to rows) and ``serialize`` (rows to bytes) with
serialize(parse(x)) == x.  A row is a dict of the columns in ``COLUMNS``; row ids
are made from the row's place, and ``reconcile`` gives rows of a new version the
ids of equal rows of the old one.  ``project`` runs a parser over a DataFrame of
files in Arrow batches.
"""

from __future__ import annotations

import base64
import difflib
import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import InvalidJson
from palimpsest.functions.jsonb import dump, parse

ROWS = "schema_key string, row_id string, parent_id string, order_key string, payload string"


def order_key(n: int) -> str:
    """A text that sorts like the number."""
    return f"{n:012d}"


def _row(schema: str, row_id: str, n: int, payload: dict, parent: str | None = None) -> dict:
    return {"schema_key": schema, "row_id": row_id, "parent_id": parent, "order_key": order_key(n), "payload": dump(parse(json.dumps(payload)))}


def _ordered(rows: Iterable[dict], schema: str | None = None) -> list[dict]:
    return sorted((r for r in rows if schema in (None, r["schema_key"])), key=lambda r: (r["order_key"], r["row_id"]))


# --- text: a row for each line, ending included
def parse_text(content: bytes) -> list[dict]:
    return [_row("text_line", f"l{i}", i, {"content": base64.b64encode(line).decode()}) for i, line in enumerate(re.findall(rb"[^\n]*\n|[^\n]+", content))]


def serialize_text(rows: Iterable[dict]) -> bytes:
    return b"".join(base64.b64decode(json.loads(r["payload"])["content"]) for r in _ordered(rows))


# --- CSV and TSV: one row for the dialect, one for each record with its cells and what its spelling adds
def parse_csv(content: bytes, delimiter: str = ",") -> list[dict]:
    text = content.decode("utf-8-sig")
    bom = content.startswith(b"\xef\xbb\xbf")
    end = "\r\n" if "\r\n" in text else "\n"
    rows = [_row("csv_table", "table", 0, {"delimiter": delimiter, "terminator": end, "bom": bom})]
    at, n = 0, 0
    while at < len(text):
        cells, quoted, closed, begin = [], [], "", at
        while True:
            if at < len(text) and text[at] == '"':
                stop = at + 1
                while True:
                    stop = text.find('"', stop)
                    if stop < 0:
                        raise ValueError("unclosed quote")
                    if text[stop : stop + 2] != '""':
                        break
                    stop += 2
                cell, raw_end = text[at + 1 : stop].replace('""', '"'), stop + 1
                quoted.append(len(cells))
            else:
                m = re.compile(rf"[^{re.escape(delimiter)}\r\n]*").match(text, at)
                cell, raw_end = m[0], m.end()
            tail = re.compile(rf"[^{re.escape(delimiter)}\r\n]*").match(text, raw_end)
            cells.append(cell + tail[0])
            at = tail.end()
            if text[at : at + 1] == delimiter:
                at += 1
                continue
            closed = "\r\n" if text.startswith("\r\n", at) else text[at : at + 1]
            at += len(closed)
            break
        needed = [i for i, c in enumerate(cells) if re.search(rf'["{re.escape(delimiter)}\r\n]', c)]
        layout = ({} if quoted == needed else {"quoted": quoted}) | ({} if closed == end else {"end": closed})
        if _record({"cells": cells, "layout": layout}, delimiter, end) != text[begin:at]:
            layout = {"raw": text[begin:at]}  # spelled in a way that cells and quotes don't tell
        rows.append(_row("csv_row", f"r{n}", n + 1, {"cells": cells} | ({"layout": layout} if layout else {})))
        n += 1
    return rows


def _record(record: dict, d: str, end: str) -> str:
    layout = record.get("layout", {})
    if "raw" in layout:
        own = json.loads(parse_csv(layout["raw"].encode(), d)[1]["payload"])["cells"]
        if own == record["cells"]:
            return layout["raw"]
    quoted = layout.get("quoted")
    cells = [f'"{c.replace(chr(34), chr(34) * 2)}"' if (i in quoted if quoted is not None else re.search(rf'["{re.escape(d)}\r\n]', c)) else c for i, c in enumerate(record["cells"])]
    return d.join(cells) + layout.get("end", end)


def serialize_csv(rows: Iterable[dict]) -> bytes:
    rows = list(rows)
    dialect = json.loads(_ordered(rows, "csv_table")[0]["payload"])
    out = [_record(json.loads(r["payload"]), dialect["delimiter"], dialect["terminator"]) for r in _ordered(rows, "csv_row")]
    return (b"\xef\xbb\xbf" if dialect["bom"] else b"") + "".join(out).encode()


# --- JSON: the root, object members and array items, each a row under its parent
def parse_json(content: bytes) -> list[dict]:
    rows: list[dict] = []

    def add(schema: str, row_id: str, parent: str | None, n: int, value, more: dict) -> None:
        kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar"
        rows.append(_row(schema, row_id, n, {"kind": kind} | more | ({"value": value} if kind == "scalar" else {}), parent))
        if kind == "object":
            for i, (k, v) in enumerate(value.items()):
                add("json_object_member", dump([row_id, k]), row_id, i, v, {"key": k})
        elif kind == "array":
            for i, v in enumerate(value):
                add("json_array_item", dump([row_id, i]), row_id, i, v, {})

    try:
        value = json.loads(content)
    except ValueError as error:
        raise InvalidJson(str(error)) from error
    add("json_root", "root", None, 0, value, {"source": base64.b64encode(content).decode()})
    return rows


def json_value(rows: Iterable[dict]):
    """The value that rows of a JSON file stand for."""
    rows = list(rows)
    below: dict[str | None, list[dict]] = {}
    for r in rows:
        below.setdefault(r["parent_id"], []).append(r)

    def build(row: dict):
        payload = json.loads(row["payload"])
        if payload["kind"] == "scalar":
            return payload["value"]
        own = _ordered(below.get(row["row_id"], []))
        if payload["kind"] == "array":
            return [build(r) for r in own]
        return {json.loads(r["payload"])["key"]: build(r) for r in own}

    return build(below[None][0])


def serialize_json(rows: Iterable[dict]) -> bytes:
    """The source as it was while the rows still stand for it, else compact JSON."""
    rows = list(rows)
    value = json_value(rows)
    source = json.loads(next(r for r in rows if r["schema_key"] == "json_root")["payload"]).get("source")
    if source:
        raw = base64.b64decode(source)
        if parse(json.dumps(json.loads(raw))) == parse(json.dumps(value)):
            return raw
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()


# --- Markdown: blocks under headings, each with its source lines
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def parse_markdown(content: bytes) -> list[dict]:
    lines = content.decode().splitlines(keepends=True)
    rows = [_row("markdown_node", "root", 0, {"kind": "document"})]
    above: list[tuple[int, str]] = [(0, "root")]
    block: list[str] = []
    state = {"kind": "", "fence": ""}

    def close() -> None:
        if block:
            rows.append(_row("markdown_node", f"n{len(rows)}", len(rows), {"kind": state["kind"], "source": "".join(block)}, above[-1][1]))
            block.clear()
        state["kind"] = ""

    for line in lines:
        text = line.rstrip("\r\n")
        if state["fence"]:
            block.append(line)
            if text.strip().startswith(state["fence"]) and not text.strip().strip(state["fence"][0]):
                state["fence"] = ""
                close()
            continue
        heading = re.match(r" {0,3}(#{1,6})(?:\s|$)", text)
        fence = _FENCE.match(text)
        if fence:
            close()
            state["kind"], state["fence"] = "code", fence[1]
            block.append(line)
        elif heading:
            close()
            depth = len(heading[1])
            while above[-1][0] >= depth:
                above.pop()
            row_id = f"n{len(rows)}"
            rows.append(_row("markdown_node", row_id, len(rows), {"kind": "heading", "depth": depth, "source": line}, above[-1][1]))
            above.append((depth, row_id))
        elif not text.strip():
            if state["kind"] != "blank":
                close()
                state["kind"] = "blank"
            block.append(line)
        else:
            kind = "thematic_break" if re.fullmatch(r" {0,3}([-*_])(?:\s*\1){2,}\s*", text) else "list" if re.match(r"\s*(?:[-*+]|\d+[.)])\s", text) else "quote" if re.match(r" {0,3}>", text) else "table" if "|" in text and state["kind"] in ("table", "") else "paragraph"
            if kind != state["kind"] and not (state["kind"] in ("list", "quote", "paragraph") and kind == "paragraph"):
                close()
                state["kind"] = kind
            block.append(line)
    close()
    return rows


def serialize_markdown(rows: Iterable[dict]) -> bytes:
    return "".join(json.loads(r["payload"]).get("source", "") for r in _ordered(rows)).encode()


# --- drawing scenes: the scene, its elements and its files
def parse_scene(content: bytes) -> list[dict]:
    doc = json.loads(content)
    rest = {k: v for k, v in doc.items() if k not in ("elements", "files")}
    rows = [_row("scene", "scene", 0, {"rest": rest, "keys": list(doc), "source": base64.b64encode(content).decode()})]
    rows += [_row("scene_element", str(e.get("id", f"e{i}")), i, {"element": e}, "scene") for i, e in enumerate(doc.get("elements", []))]
    rows += [_row("scene_file", k, i, {"file": v}, "scene") for i, (k, v) in enumerate(doc.get("files", {}).items())]
    return rows


def serialize_scene(rows: Iterable[dict]) -> bytes:
    rows = list(rows)
    scene = json.loads(_ordered(rows, "scene")[0]["payload"])
    doc = dict.fromkeys(scene["keys"]) | scene["rest"]
    if "elements" in doc or _ordered(rows, "scene_element"):
        doc["elements"] = [json.loads(r["payload"])["element"] for r in _ordered(rows, "scene_element")]
    if "files" in doc or _ordered(rows, "scene_file"):
        doc["files"] = {r["row_id"]: json.loads(r["payload"])["file"] for r in _ordered(rows, "scene_file")}
    raw = base64.b64decode(scene["source"])
    if parse(raw.decode()) == parse(json.dumps(doc)):
        return raw
    return json.dumps(doc, ensure_ascii=False, indent=2).encode()


FORMATS: dict[str, tuple[Callable, Callable]] = {
    "text": (parse_text, serialize_text),
    "csv": (parse_csv, serialize_csv),
    "tsv": (lambda c: parse_csv(c, "\t"), serialize_csv),
    "json": (parse_json, serialize_json),
    "markdown": (parse_markdown, serialize_markdown),
    "scene": (parse_scene, serialize_scene),
}
# Endings of file names by format.
ENDINGS = {".txt": "text", ".csv": "csv", ".tsv": "tsv", ".json": "json", ".md": "markdown", ".markdown": "markdown", ".excalidraw": "scene"}


def format_of(path: str) -> str | None:
    return ENDINGS.get(path[path.rfind(".") :].lower()) if "." in path.rsplit("/", 1)[-1] else None


def reconcile(old: list[dict], new: list[dict]) -> list[dict]:
    """New rows with the ids of the old rows that they continue: equal ones first, then replaced ones in their place."""
    match = difflib.SequenceMatcher(a=[r["payload"] for r in old], b=[r["payload"] for r in new], autojunk=False)
    ids, taken = {}, {r["row_id"] for r in old}
    for tag, a, b, c, d in match.get_opcodes():
        if tag in ("equal", "replace"):
            ids |= {new[c + k]["row_id"]: old[a + k]["row_id"] for k in range(min(b - a, d - c)) if old[a + k]["schema_key"] == new[c + k]["schema_key"]}
    for r in new:
        if r["row_id"] not in ids:
            own, n = r["row_id"], 0
            while own in taken:
                n += 1
                own = f"{r['row_id']}.{n}"
            ids[r["row_id"]] = own
            taken.add(own)
    return [r | {"row_id": ids[r["row_id"]], "parent_id": ids.get(r["parent_id"], r["parent_id"])} for r in new]


def project(files: DataFrame, kind: str, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, schema_key, row_id, parent_id, order_key, payload) of every file of a format."""
    parser = FORMATS[kind][0]

    def rows(batches):
        import pandas as pd

        for batch in batches:
            out = [(k, *r.values()) for k, c in zip(batch[key], batch[content], strict=True) if c is not None for r in parser(bytes(c))]
            yield pd.DataFrame(out, columns=[key, "schema_key", "row_id", "parent_id", "order_key", "payload"])

    return files.select(key, content).mapInPandas(rows, f"{key} {dict(files.dtypes)[key]}, {ROWS}")


def text_lines(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, line_no, line) of texts, compiled: no Python runs."""
    return files.select(key, F.posexplode(F.split(content, "\n", -1)).alias("line_no", "line"))

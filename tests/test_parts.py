"""Parts that need no tables: JSONB, schemas, formats, paths, ids, the front end's tokens."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest import errors as E
from palimpsest import front
from palimpsest.functions import jsonb, scalar
from palimpsest.operators import paths
from palimpsest.operators.diff import decode_diff_id
from palimpsest.schema import Schema, amend
from palimpsest.sources import formats

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(st.characters(min_codepoint=1, exclude_categories=["Cs"]), max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", max_size=2), x, max_size=3), max_leaves=8)


@pytest.mark.parametrize(
    ("text", "canonical"),
    [('{"b":1.0,"a":[1,2.5,1e22,1e-7],"b":2}', '{"a":[1,2.5,1e22,1e-7],"b":2}'), (" [1.0 , -0.0, 9007199254740992.0]", "[1,0,9007199254740992]"), ('"\\u00e9"', '"é"'), ("null", "null"), ('{"a":{"c":1,"b":null}}', '{"a":{"b":null,"c":1}}')],
)
def test_canonical_text(text, canonical):
    assert jsonb.dump(jsonb.parse(text)) == canonical


@pytest.mark.parametrize("text", ["{", "NaN", "[1,]", '"\\u0000"', "{'a':1}", ""])
def test_what_is_no_jsonb(text):
    with pytest.raises(E.InvalidJson):
        jsonb.parse(text)


@given(JSON)
@settings(max_examples=100, deadline=None)
def test_canonical_text_is_stable_and_contains_itself(value):
    text = jsonb.dump(jsonb.parse(json.dumps(value)))
    assert jsonb.dump(jsonb.parse(text)) == text
    assert jsonb.contains(jsonb.parse(text), jsonb.parse(text))


def test_operators():
    v = jsonb.parse('{"a":[10,null,{"b":"x"}],"0":"zero","n":null}')
    assert jsonb.as_json(jsonb.get(v, "n")) == "null" and jsonb.as_text(jsonb.get(v, "n")) is None
    assert jsonb.as_json(jsonb.get(v, "q")) is None
    assert jsonb.as_json(jsonb.get(v["a"], -1)) == '{"b":"x"}' and jsonb.as_json(jsonb.get(v["a"], "0")) is None
    assert jsonb.as_json(jsonb.get(v, 0)) is None and jsonb.as_text(jsonb.get(v, "0")) == "zero"
    assert jsonb.as_text(jsonb.walk(v, "{a,-1,b}")) == "x" and jsonb.as_json(jsonb.walk(v, "{a,7}")) is None
    assert jsonb.contains([1, [2]], 1) and not jsonb.contains(1, [1]) and jsonb.contains([1, 2, 2], [2, 1]) and not jsonb.contains([1], [True])
    assert jsonb.exists(["a", 1], "a") and not jsonb.exists(["a", 1], "1") and jsonb.exists({"k": None}, "k") and not jsonb.exists("k", "k")


def test_schemas():
    doc = {"key": "task", "columns": [{"name": "id", "type": "text", "nullable": False}, {"name": "n", "type": "int8"}], "primary_key": ["id"]}
    old = Schema.of(doc)
    assert amend(old, Schema.of(doc | {"columns": [*doc["columns"], {"name": "m", "type": "jsonb"}]})).column("m").type == "jsonb"
    for bad in ({"columns": doc["columns"][:1]}, {"unique": [["n"]]}, {"columns": [*doc["columns"], {"name": "z", "type": "text", "nullable": False}]}):
        with pytest.raises(E.SchemaDefinition):
            amend(old, Schema.of(doc | bad))
    for bad in ({"key": "Task"}, {"primary_key": []}, {"primary_key": ["n"]}, {"columns": []}, {"foreign_keys": [{"columns": ["q"], "references": {"schema_key": "a", "columns": ["id"]}}]}, {"other": 1}):
        with pytest.raises(E.SchemaDefinition):
            Schema.of(doc | bad)
    with pytest.raises(E.ReservedNamespace):
        Schema.of(doc | {"key": "vt_x"})


@given(st.binary(max_size=80))
@settings(max_examples=100, deadline=None)
def test_text_round_trip(content):
    assert formats.serialize_text(formats.parse_text(content)) == content


@given(st.lists(st.sampled_from(["a", ",", '"x"', '"a""b"', '"l\nm"', "\n", "\r\n", " ", "é"]), max_size=20).map("".join))
@settings(max_examples=200, deadline=None)
def test_csv_round_trip(text):
    assert formats.serialize_csv(formats.parse_csv(text.encode())) == text.encode()


def test_csv_cells():
    rows = formats.parse_csv(b'a,"b ""q"", c"\r\n1,\r\n')
    assert [json.loads(r["payload"])["cells"] for r in rows[1:]] == [["a", 'b "q", c'], ["1", ""]]


@given(JSON)
@settings(max_examples=60, deadline=None)
def test_json_round_trip(value):
    raw = json.dumps(value, indent=1).encode()
    rows = formats.parse_json(raw)
    random.shuffle(rows)
    assert formats.json_value(rows) == value and formats.serialize_json(rows) == raw


@given(st.lists(st.sampled_from(["# h\n", "## g\n", "text\n", "\n", "- item\n", "```py\n", "x = 1\n", "```\n", "> q\n", "---\n", "a | b\n", "end"]), max_size=20).map("".join))
@settings(max_examples=150, deadline=None)
def test_markdown_round_trip(text):
    rows = formats.parse_markdown(text.encode())
    assert formats.serialize_markdown(rows) == text.encode()


def test_scene_round_trip_and_edit():
    raw = json.dumps({"type": "excalidraw", "elements": [{"id": "a", "x": 1}, {"id": "b"}], "appState": {"z": 1}, "files": {"f": {"m": 1}}}, indent=2).encode()
    rows = formats.parse_scene(raw)
    assert formats.serialize_scene(rows) == raw
    left = [r for r in rows if r["row_id"] != "b"]
    assert [e["id"] for e in json.loads(formats.serialize_scene(left))["elements"]] == ["a"]


def test_rows_keep_their_ids():
    old, new = formats.parse_text(b"a\nb\nc\n"), formats.parse_text(b"x\na\nB\nc\n")
    kept = {json.loads(r["payload"])["content"]: r["row_id"] for r in formats.reconcile(old, new)}
    was = {json.loads(r["payload"])["content"]: r["row_id"] for r in old}
    assert kept["YQo="] == was["YQo="] and kept["Ywo="] == was["Ywo="] and kept["Qgo="] == was["Ygo="]
    assert len(set(kept.values())) == 4


def test_paths():
    assert paths.segments("/a/b c/é") == ["a", "b c", "é"] and paths.segments("/") == []
    for bad in ("a", "/a/", "//a", "/./a", "/a/..", "/a\0", ""):
        with pytest.raises(E.InvalidPath):
            paths.segments(bad)


def test_cycles_have_no_path(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 4, "c"), (4, 3, "d"), (5, 9, "e")], "id bigint, parent_id bigint, name string")
    assert {r["id"]: r["path"] for r in paths.directory_paths(rows).collect()} == {1: "/a", 2: "/a/b"}
    assert sorted(r["id"] for r in paths.lost_directories(rows).collect()) == [3, 4, 5]


def test_ids_grow():
    fixed = [scalar.Ids(5)() for _ in range(2)]
    assert fixed[0] == fixed[1]
    ids = scalar.Ids()
    many = [ids() for _ in range(2000)]
    assert many == sorted(many) and len(set(many)) == 2000


def test_diff_ids():
    for bad in ("d2.AA", "d1.", "d1.BA"):
        with pytest.raises((ValueError, IndexError)):
            decode_diff_id(bad)


def test_tokens_and_lowering():
    lower = lambda t, p=(): "".join(front.lower_jsonb(front.bind(front.tokens(t), list(p))))
    assert lower("select a -> 'b' ->> 2 from t") == "select jsonb_element_text(jsonb_get(a , 'b') , '2') from t".replace(" ,", ",")
    assert lower("select x.v @> '{\"a\":1}'::jsonb") == "select jsonb_contains(x.v, jsonb('{\"a\":1}'))"
    assert lower("select f(a, (b)) #>> '{x,0}' as c") == "select jsonb_path_text(f(a, (b)), '{x,0}') as c"
    assert lower("select $1, $2 -- note\n", ["it's", None]) == "select 'it\\'s', NULL"
    assert lower("select 'a -> b', c ? 'k'") == "select 'a -> b', jsonb_exists(c, 'k')"
    for bad in ("select 'a", "select 1; select 2"):
        with pytest.raises(E.ParseError):
            front.tokens(bad)
    with pytest.raises(E.ParseError):
        front.bind(front.tokens("select $3"), [1])

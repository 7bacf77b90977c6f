"""Queries over JSONB values, file projections, directory trees and concurrent commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import jsonb
from palimpsest.functions.scalar import uuidv7
from palimpsest.operators import concurrency as C
from palimpsest.operators import history as H
from palimpsest.operators import log as L
from palimpsest.operators import paths as P
from palimpsest.plans.versioned import LOG_SQL
from palimpsest.sources import formats

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def _values(spark, sf_dir):
    """A JSON document for each event: its number as a float, a nested list, a null."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit('.0,"k":'), F.get_json_object("props", "$.k"), F.lit(',"tags":["'), "event_type", F.lit('",'), (F.col("user_id") % 5).cast("string"), F.lit('],"none":null,"k":'), (F.col("event_id") % 9).cast("string"), F.lit("}"))
    return events.select("event_id", jsonb.call("jsonb", text).alias("doc"))


_DOC = """with docs as (select event_id, event_type, user_id % 5 as u, event_id % 9 as k from events),
canon as (select *, '{"k":' || k || ',"n":' || event_id || ',"none":null,"tags":["' || event_type || '",' || u || ']}' as doc from docs)
"""


@_query("jsonb_canonical", _DOC + "select event_id, doc from canon")
def jsonb_canonical(spark, sf_dir):
    return _values(spark, sf_dir)


@_query("jsonb_get", _DOC + """select event_id, cast(k as varchar) as k, cast(k as varchar) as k_text, '"' || event_type || '"' as tag, event_type as tag_text, cast(u as varchar) as last_tag, 'null' as none_json, cast(null as varchar) as none_text, cast(null as varchar) as missing from canon""")
def jsonb_get(spark, sf_dir):
    doc, lit, call = F.col("doc"), F.lit, jsonb.call
    return _values(spark, sf_dir).select(
        "event_id",
        call("jsonb_get", doc, lit("k")).alias("k"),
        call("jsonb_get_text", doc, lit("k")).alias("k_text"),
        call("jsonb_element", call("jsonb_get", doc, lit("tags")), lit("0")).alias("tag"),
        call("jsonb_element_text", call("jsonb_get", doc, lit("tags")), lit("0")).alias("tag_text"),
        call("jsonb_path", doc, lit("{tags,-1}")).alias("last_tag"),
        call("jsonb_get", doc, lit("none")).alias("none_json"),
        call("jsonb_get_text", doc, lit("none")).alias("none_text"),
        call("jsonb_path_text", doc, lit("{tags,9}")).alias("missing"),
    )


@_query("jsonb_predicates", _DOC + "select event_id, k = 4 as has_k, event_type = 'click' as tagged, true as has_key, u = 3 as deep from canon")
def jsonb_predicates(spark, sf_dir):
    doc = F.col("doc")
    return _values(spark, sf_dir).select(
        "event_id",
        jsonb.call("jsonb_contains", doc, F.lit('{"k":4}')).alias("has_k"),
        jsonb.call("jsonb_exists", jsonb.call("jsonb_get", doc, F.lit("tags")), F.lit("click")).alias("tagged"),
        jsonb.call("jsonb_exists", doc, F.lit("none")).alias("has_key"),
        jsonb.call("jsonb_contains", doc, F.lit('{"tags":[3]}')).alias("deep"),
    )


@_query("jsonb_field", "select event_id, json_extract_string(props, '$.k') as k from events where cast(json_extract_string(props, '$.k') as integer) > 50")
def jsonb_field(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", jsonb.field(F.col("props"), "k").alias("k")).filter("cast(k as int) > 50")


@_query("text_lines", "select doc_id, cast(line_no - 1 as integer) as line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)")
def text_lines(spark, sf_dir):
    return formats.text_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


@_query("file_projection", "select doc_id, count(*) as lines from (select doc_id, unnest(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')) as line from documents) group by doc_id")
def file_projection(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return formats.project(files, "text", key="doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"))


_TREE = """with recursive dirs as (select s_suppkey as id, case when s_suppkey >= 3 then s_suppkey // 3 end as parent_id, s_name as name from supplier),
paths as (select id, '/' || name as path, 1 as depth from dirs where parent_id is null union all select d.id, p.path || '/' || d.name, p.depth + 1 from dirs d join paths p on d.parent_id = p.id)
"""


def _directories(spark, sf_dir):
    parent = F.when(F.col("s_suppkey") >= 3, F.expr("s_suppkey div 3"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), parent.alias("parent_id"), F.col("s_name").alias("name"))


@_query("directory_paths", _TREE + "select id, path, depth from paths")
def directory_paths(spark, sf_dir):
    return P.directory_paths(_directories(spark, sf_dir))


@_query("file_paths", _TREE + "select c_custkey as id, coalesce(path, '') || '/' || c_name as path from customer left join paths on paths.id = c_nationkey where c_nationkey > 0 and path is not null or c_nationkey = 0")
def file_paths(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") > 0, F.col("c_nationkey")).cast("bigint").alias("directory_id"), F.col("c_name").alias("name"))
    return P.file_paths(files, _directories(spark, sf_dir)).select("id", "path")


ORACLES["file_paths"] = _TREE + "select c_custkey as id, case when c_nationkey = 0 then '' else path end || '/' || c_name as path from customer left join paths on paths.id = c_nationkey where c_nationkey = 0 or path is not null"


@_query("directory_descendants", _TREE + ", below as (select id, 0 as depth from dirs where id = 1 union all select d.id, b.depth + 1 from dirs d join below b on d.parent_id = b.id) select id, depth from below")
def directory_descendants(spark, sf_dir):
    rows = _directories(spark, sf_dir)
    return P.descendants(rows, rows.filter("id = 1").select("id"))


@_query("composed_history", LOG_SQL + """select split_part(substr(m.row_pk, 2), ',', 1) as file_id, a.commit_id, a.depth, count(distinct m.change_id) as n_sources
from ancestry a join members m using (commit_id) where a.anchor = 'M30' group by 1, 2, 3""")
def composed_history(spark, sf_dir):
    log = L.fixture(spark, sf_dir)
    # a user's rows make up a file: each commit that touches one of them is a revision
    trees = log.members.select(F.regexp_extract("row_pk", r"^\[(\d+),", 1).alias("file_id"), F.col("schema_key").alias("part_schema"), F.col("row_pk").alias("part_pk")).distinct()
    rows = H.affected_files(log, log.head("main"), trees)
    return rows.select("file_id", "commit_id", "depth", F.json_array_length("source_changes").cast("bigint").alias("n_sources"))


@_query("stale_overlap", LOG_SQL + "select distinct row_pk from own_members where commit_id in ('M11', 'M12', 'M13') and row_pk in (select row_pk from own_members where commit_id in ('D11', 'D12', 'D13'))")
def stale_overlap(spark, sf_dir):
    return C.overlap(L.fixture(spark, sf_dir), L.MERGE_BASE, L.TARGET, L.SOURCE).select("row_pk")


@_query("unreachable_commits", LOG_SQL + "select commit_id from commits where commit_id not in (select commit_id from ancestry where anchor in ('D13', 'M12'))")
def unreachable_commits(spark, sf_dir):
    return C.unreachable(L.fixture(spark, sf_dir), ["D13", "M12"])


@_query("uuidv7_shape", "select count(*) as n, count(*) as well_formed from events")
def uuidv7_shape(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(uuidv7().alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count(F.when(F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}$"), 1)).alias("well_formed"))

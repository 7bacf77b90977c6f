"""Queries over the change log that is derived from the events table, and over branch overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import diff as D
from palimpsest.operators import graph as G
from palimpsest.operators import history as H
from palimpsest.operators import log as L
from palimpsest.operators import merge as M
from palimpsest.operators import state as S

CONTENT = ("event_type", "value", "props")

# --- the same log in SQL: changes, own members, the graph, the merge's picks, all members
LOG_SQL = """
with recursive changes as (
  select case when d between 11 and 13 and event_id % 2 = 1 then 'D' || d else 'M' || d end as commit_id,
         '[' || user_id || ',"' || event_type || '"]' as row_pk, ts as updated_at, event_id as change_id, event_id % 7 = 0 as deleted,
         case when event_id % 7 <> 0 then event_type end as event_type, case when event_id % 7 <> 0 then value end as value, case when event_id % 7 <> 0 then props end as props
  from (select *, date_diff('day', timestamp '2024-01-01', date_trunc('day', ts)) + 1 as d from events)
),
own_members as (select * from changes qualify row_number() over (partition by commit_id, row_pk order by updated_at desc, change_id desc) = 1),
edges as (
  select 'M' || i as child_id, 'M' || (i - 1) as parent_id, 0 as parent_order from range(2, 14) r(i)
  union all select 'M' || i, 'M' || (i - 1), 0 from range(15, 31) r(i)
  union all values ('D11', 'M10', 0), ('D12', 'D11', 0), ('D13', 'D12', 0), ('X13', 'M13', 0), ('X13', 'D13', 1), ('M14', 'X13', 0)
),
commits as (select 'M1' as commit_id union select child_id from edges),
lines as (
  select commit_id as anchor, commit_id, 0 as depth from commits
  union all select l.anchor, e.parent_id, l.depth + 1 from lines l join edges e on e.child_id = l.commit_id and e.parent_order = 0
),
reach as (
  select commit_id as anchor, commit_id, 0 as depth from commits
  union select r.anchor, e.parent_id, r.depth + 1 from reach r join edges e on e.child_id = r.commit_id
),
ancestry as (select anchor, commit_id, min(depth) as depth from reach group by anchor, commit_id),
own_state as (
  select l.anchor, m.* from lines l join own_members m using (commit_id) where l.anchor in ('M10', 'M13', 'D13')
  qualify row_number() over (partition by l.anchor, m.row_pk order by l.depth) = 1
),
o as (select * from own_state where anchor = 'M10'), t as (select * from own_state where anchor = 'M13'), s as (select * from own_state where anchor = 'D13'),
sides as (
  select row_pk, o.change_id as o_id, t.change_id as t_id, s.change_id as s_id, coalesce(not o.deleted, false) as o_live, coalesce(not t.deleted, false) as t_live, coalesce(not s.deleted, false) as s_live,
         o.event_type as o_event_type, t.event_type as t_event_type, s.event_type as s_event_type, o.value as o_value, t.value as t_value, s.value as s_value, o.props as o_props, t.props as t_props, s.props as s_props,
         t.updated_at as t_at, s.updated_at as s_at
  from o full join t using (row_pk) full join s using (row_pk)
),
judged as (
  select *,
    case when not o_live and t_live then 'added' when o_live and not t_live then 'removed' when o_live and t_live and not (o_id = t_id or (o_event_type, o_value, o_props) is not distinct from (t_event_type, t_value, t_props)) then 'modified' end as target_diff,
    case when not o_live and s_live then 'added' when o_live and not s_live then 'removed' when o_live and s_live and not (o_id = s_id or (o_event_type, o_value, o_props) is not distinct from (s_event_type, s_value, s_props)) then 'modified' end as source_diff
  from sides
),
plan as (
  select *, case
      when target_diff is not null and source_diff is not null and ((not t_live and not s_live) or (t_live and s_live and (t_id = s_id or (t_event_type, t_value, t_props) is not distinct from (s_event_type, s_value, s_props)))) then 'noop'
      when target_diff is not null and source_diff is not null then 'conflict' when source_diff is not null then 'pick' when target_diff is not null then 'keep' end as action
  from judged
),
members as (
  select * from own_members
  union all
  select 'X13', s.row_pk, s.updated_at, s.change_id, s.deleted, s.event_type, s.value, s.props from s join plan p using (row_pk)
  where p.action = 'pick' or (p.action = 'conflict' and (p.s_at > p.t_at or (p.s_at = p.t_at and p.s_id > p.t_id)))
),
state as (
  select l.anchor, m.* exclude (commit_id) from lines l join members m using (commit_id)
  qualify row_number() over (partition by l.anchor, m.row_pk order by l.depth) = 1
),
versions as (
  select a.anchor, m.*, a.depth from ancestry a join members m using (commit_id)
  qualify row_number() over (partition by a.anchor, m.change_id, m.row_pk order by a.depth, m.commit_id) = 1
)
"""


def _diff_sql(before: str, after: str, where: str = "true") -> str:
    return LOG_SQL + f""",
compared as (
  select row_pk, case when not a.deleted then a.change_id end as before_change_id, b.change_id as after_change_id, coalesce(not a.deleted, false) as a_live, coalesce(not b.deleted, false) as b_live,
         a.change_id = b.change_id or (a.event_type, a.value, a.props) is not distinct from (b.event_type, b.value, b.props) as same
  from (select * from state where anchor = '{before}') a full join (select * from state where anchor = '{after}') b using (row_pk)
),
typed as (select *, case when not a_live and b_live then 'added' when a_live and not b_live then 'removed' when a_live and b_live and not same then 'modified' end as diff_type from compared)
select 'd1.' || rtrim(translate(to_base64(unhex(
         lpad(to_hex((case when before_change_id is not null then 1 else 0 end) + (case when after_change_id is not null then 2 else 0 end)), 2, '0')
         || coalesce(lpad(to_hex(before_change_id), 32, '0'), '') || coalesce(lpad(to_hex(after_change_id), 32, '0'), ''))), '+/', '-_'), '=') as diff_id,
       'user_event' as schema_key, row_pk, diff_type, before_change_id, after_change_id
from typed where diff_type is not null and {where}"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def flat(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(f"snapshot.{c}").alias(c) for c in CONTENT])


@_query("log_changes", LOG_SQL + "select commit_id, row_pk, change_id, deleted, event_type, value, props from changes")
def log_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(L.fixture(spark, sf_dir).changes, "commit_id", "row_pk", "change_id", "deleted")


@_query("log_members", LOG_SQL + "select commit_id, row_pk, change_id, deleted from members")
def log_members(spark, sf_dir):
    return L.fixture(spark, sf_dir).members.select("commit_id", "row_pk", "change_id", "deleted")


@_query("branch_scan", "select * from (values ('draft', 'D13', 'M10'), ('main', 'M30', 'M10')) v(name, commit_id, checkpoint_commit_id)")
def branch_scan(spark, sf_dir):
    return L.fixture(spark, sf_dir).branches.filter("not hidden").select("name", "commit_id", "checkpoint_commit_id")


@_query("commit_edges", LOG_SQL + "select child_id, parent_id, parent_order from edges")
def commit_edges(spark, sf_dir):
    return L.fixture(spark, sf_dir).edges()


@_query("commit_ancestry", LOG_SQL + "select commit_id, depth from ancestry where anchor = 'M30'")
def commit_ancestry(spark, sf_dir):
    log = L.fixture(spark, sf_dir)
    return G.ancestry(log, log.head("main"))


@_query("best_common_ancestors", LOG_SQL + """, common as (select a.commit_id from ancestry a join ancestry b using (commit_id) where a.anchor = 'M13' and b.anchor = 'D13')
select commit_id from common where commit_id not in (select a.commit_id from ancestry a join common c on a.anchor = c.commit_id where a.depth > 0)""")
def best_common(spark, sf_dir):
    return G.best_common_ancestors(L.fixture(spark, sf_dir), L.TARGET, L.SOURCE)


@_query("live_by_event_type", LOG_SQL + "select event_type, count(*) as live_rows, round(sum(value), 2) as total_value from state where anchor = 'M30' and not deleted group by event_type")
def live_by_event_type(spark, sf_dir):
    log = L.fixture(spark, sf_dir)
    rows = flat(S.state_at(log, log.head("main")))
    return rows.groupBy("event_type").agg(F.count("*").alias("live_rows"), F.round(F.sum("value"), 2).alias("total_value"))


@_query("state_at_commit", LOG_SQL + "select row_pk, change_id, event_type, value, props from state where anchor = 'M20' and not deleted")
def state_at_commit(spark, sf_dir):
    return flat(S.state_at(L.fixture(spark, sf_dir), "M20"), "row_pk", "change_id")


@_query("state_before_merge", LOG_SQL + "select row_pk, change_id, event_type, value, props from state where anchor = 'D13' and not deleted")
def state_before_merge(spark, sf_dir):
    log = L.fixture(spark, sf_dir)
    return flat(S.state_at(log, log.head("draft")), "row_pk", "change_id")


def _diffed(before: str, after: str, **filters):
    def run(spark, sf_dir):
        return D.diff(L.fixture(spark, sf_dir), before, after, **filters).select("diff_id", "schema_key", "row_pk", "diff_type", "before_change_id", "after_change_id")

    return run


for _name, _before, _after in (("diff_forward", "M10", "M13"), ("diff_side_branch", "M10", "D13"), ("diff_backward", "M20", "M12"), ("diff_across", "D13", "M13"), ("diff_same", "M13", "M13")):
    _query(_name, _diff_sql(_before, _after))(_diffed(_before, _after))
_query("diff_one_row", _diff_sql("M10", "M30", "row_pk = '[3,\"click\"]'"))(_diffed("M10", "M30", row_pk='[3,"click"]'))


@_query("working_diff", _diff_sql("M10", "M30"))
def working_diff(spark, sf_dir):
    return D.working_diff(L.fixture(spark, sf_dir), "main").select("diff_id", "schema_key", "row_pk", "diff_type", "before_change_id", "after_change_id")


@_query("row_history", LOG_SQL + "select row_pk, change_id, commit_id, depth, deleted, event_type, value, props from versions where anchor = 'M30'")
def row_history(spark, sf_dir):
    log = L.fixture(spark, sf_dir)
    return flat(H.history(log, "user_event", log.head("main")), "row_pk", "change_id", "commit_id", "depth", "deleted")


@_query("row_history_recent", LOG_SQL + "select row_pk, change_id, commit_id, depth from versions where anchor = 'M30' and depth <= 5")
def row_history_recent(spark, sf_dir):
    log = L.fixture(spark, sf_dir)
    return H.history(log, "user_event", log.head("main"), depths=(0, 5)).select("row_pk", "change_id", "commit_id", "depth")


@_query("merge_plan", LOG_SQL + "select row_pk, action, target_diff, source_diff, o_id as base_change_id, t_id as target_change_id, s_id as source_change_id from plan where action is not null")
def merge_plan(spark, sf_dir):
    plan = M.merge_plan(L.fixture(spark, sf_dir), L.MERGE_BASE, L.TARGET, L.SOURCE)
    return plan.select("row_pk", "action", "target_diff", "source_diff", "base_change_id", "target_change_id", "source_change_id")


@_query("merge_statistics", LOG_SQL + "select source_diff as diff_type, count(*) as n from plan where action in ('pick', 'conflict') group by source_diff")
def merge_statistics(spark, sf_dir):
    return M.statistics(M.merge_plan(L.fixture(spark, sf_dir), L.MERGE_BASE, L.TARGET, L.SOURCE))


def _lww(column: str) -> str:
    t, s, o = f"t_{column}", f"s_{column}", f"o_{column}"
    later = f"case when late then {s} else {t} end"
    return f"case when gone then null when whole then {later} when {t} is not distinct from {s} then {t} when {t} is not distinct from {o} then {s} when {s} is not distinct from {o} then {t} else {later} end as {column}"


@_query(
    "merge_resolution",
    LOG_SQL + f""", ranked as (select *, s_at > t_at or (s_at = t_at and s_id > t_id) as late, not (o_live and t_live and s_live) as whole from plan where action = 'conflict'),
settled as (select *, whole and (case when late then not s_live else not t_live end) as gone from ranked)
select row_pk, gone as resolved_deleted, {', '.join(_lww(c) for c in CONTENT)} from settled""",
)
def merge_resolution(spark, sf_dir):
    plan = M.merge_plan(L.fixture(spark, sf_dir), L.MERGE_BASE, L.TARGET, L.SOURCE)
    rows = M.resolve(plan.filter("action = 'conflict'"), list(CONTENT), keys=["event_type"])
    return rows.select("row_pk", "resolved_deleted", *[F.col(f"resolved.{c}").alias(c) for c in CONTENT])


# --- a branch's view of a table: base rows under a sparse overlay, then the analytical shapes over it
OVERLAY_SQL = """
with overlay as (select * replace (o_totalprice + 1000 as o_totalprice), o_orderkey % 100 = 50 as deleted from orders where o_orderkey % 50 = 0),
branch_orders as (select * from orders where o_orderkey not in (select o_orderkey from overlay) union all select * exclude (deleted) from overlay where not deleted)
"""


def branch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a branch sees them that raised each 50th order's price and deleted every second of those."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    changes = orders.filter("o_orderkey % 50 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1000, "deleted": F.col("o_orderkey") % 100 == 50})
    return S.overlay(orders, changes, ["o_orderkey"])


@_query("overlay_scan", OVERLAY_SQL + "select o_orderkey, o_custkey, o_totalprice from branch_orders")
def overlay_scan(spark, sf_dir):
    return branch_orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice")


@_query("overlay_filter", OVERLAY_SQL + "select o_orderkey, o_totalprice from branch_orders where o_totalprice > 300000 and o_orderstatus = 'O'")
def overlay_filter(spark, sf_dir):
    return branch_orders(spark, sf_dir).filter("o_totalprice > 300000 and o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")


@_query("overlay_top", OVERLAY_SQL + "select o_orderkey, o_totalprice from branch_orders order by o_totalprice desc, o_orderkey limit 100")
def overlay_top(spark, sf_dir):
    return branch_orders(spark, sf_dir).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@_query("overlay_group", OVERLAY_SQL + "select o_orderstatus, o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as mean from branch_orders group by o_orderstatus, o_orderpriority")
def overlay_group(spark, sf_dir):
    return branch_orders(spark, sf_dir).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@_query("overlay_aggregate", OVERLAY_SQL + "select count(*) as n, round(sum(o_totalprice), 2) as total, min(o_totalprice) as low, max(o_totalprice) as high from branch_orders")
def overlay_aggregate(spark, sf_dir):
    return branch_orders(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@_query("overlay_self_join", OVERLAY_SQL + "select a.o_orderkey as first_key, b.o_orderkey as second_key from branch_orders a join branch_orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.o_totalprice + b.o_totalprice > 800000")
def overlay_self_join(spark, sf_dir):
    rows = branch_orders(spark, sf_dir)
    a = rows.select(F.col("o_orderkey").alias("first_key"), "o_custkey", F.col("o_totalprice").alias("a_price"))
    b = rows.select(F.col("o_orderkey").alias("second_key"), "o_custkey", F.col("o_totalprice").alias("b_price"))
    return a.join(b, "o_custkey").filter("first_key < second_key and a_price + b_price > 800000").select("first_key", "second_key")


@_query("overlay_tpch_q6", """
with overlay as (select *, row_number() over () as rn from lineitem where l_quantity = 10),
view_ as (select l_shipdate, l_extendedprice, l_discount, l_quantity from lineitem where l_quantity <> 10 union all select l_shipdate, l_extendedprice * 2, l_discount, l_quantity from overlay where l_discount < 0.09)
select round(sum(l_extendedprice * l_discount), 2) as revenue from view_ where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24""")
def overlay_tpch_q6(spark, sf_dir):
    # lines have no key: the overlay replaces the lines of a quantity as a whole
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    changed = lines.filter("l_quantity = 10 and l_discount < 0.09").withColumn("l_extendedprice", F.col("l_extendedprice") * 2)
    rows = lines.filter("l_quantity <> 10").unionByName(changed)
    rows = rows.filter("l_shipdate >= TIMESTAMP_NTZ'1997-01-01' and l_shipdate < TIMESTAMP_NTZ'1998-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@_query("visibility_tiers", """
with tiers as (
  select 0 as tier, c_custkey as k, 1 as seq, false as deleted, c_acctbal as v from customer
  union all select 1, c_custkey, 2, c_custkey % 10 = 0, c_acctbal + 1 from customer where c_custkey % 5 = 0
  union all select 2, c_custkey, c_nationkey, c_custkey % 21 = 0, c_acctbal + 2 from customer where c_custkey % 7 = 0
  union all select 3, c_custkey, 5, false, c_acctbal + 3 from customer where c_custkey % 42 = 0)
select k, seq, v from (select * from tiers qualify row_number() over (partition by k order by tier desc, seq desc) = 1) where not deleted""")
def visibility_tiers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    tier = lambda where, seq, gone, more: rows.filter(where).select(F.col("c_custkey").alias("k"), F.expr(seq).cast("int").alias("seq"), F.expr(gone).alias("deleted"), (F.col("c_acctbal") + more).alias("v"))
    tiers = [tier("true", "1", "false", 0), tier("c_custkey % 5 = 0", "2", "c_custkey % 10 = 0", 1), tier("c_custkey % 7 = 0", "c_nationkey", "c_custkey % 21 = 0", 2), tier("c_custkey % 42 = 0", "5", "false", 3)]
    return S.visible(tiers, ["k"]).select("k", "seq", "v")

"""Relational queries over the driver's tables.

Each query is one text for Spark SQL and DuckDB.  ``TS'...'`` stands for a
timestamp literal without time zone, so that Spark can push comparisons to the
scan.  DUCKDB has the text for DuckDB where a function's name differs.
"""

from __future__ import annotations

REVENUE = "l_extendedprice * (1 - l_discount)"

SQL: dict[str, str] = {}
DUCKDB: dict[str, str] = {}

# --- decision support, after the standard query set, with constants of these tables
SQL["q1"] = f"""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
       round(sum({REVENUE}), 2) as sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 2) as sum_charge,
       round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= TS'2001-08-01' group by l_returnflag, l_linestatus"""
SQL["q2_cheapest_part_by_brand"] = """
select p_partkey, p_brand, p_size, p_retailprice from part p
where p_size between 10 and 20 and p_retailprice = (select min(i.p_retailprice) from part i where i.p_brand = p.p_brand and i.p_size between 10 and 20)"""
SQL["q3"] = f"""
select l_orderkey, round(sum({REVENUE}), 2) as revenue, o_orderdate, o_orderpriority
from customer, orders, lineitem
where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < TS'1998-03-15' and l_shipdate > TS'1998-03-15'
group by l_orderkey, o_orderdate, o_orderpriority order by revenue desc, l_orderkey limit 10"""
SQL["q4"] = """
select o_orderpriority, count(*) as order_count from orders
where o_orderdate >= TS'1997-07-01' and o_orderdate < TS'1997-10-01'
  and exists (select * from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_shipdate > o_orderdate)
group by o_orderpriority"""
SQL["q5"] = f"""
select n_name, round(sum({REVENUE}), 2) as revenue
from customer, orders, lineitem, supplier, nation, region
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey
  and n_regionkey = r_regionkey and r_name = 'ASIA' and o_orderdate >= TS'1996-01-01' and o_orderdate < TS'1998-01-01'
group by n_name"""
SQL["q6"] = """
select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem
where l_shipdate >= TS'1997-01-01' and l_shipdate < TS'1998-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24"""
SQL["q7"] = f"""
select supp_nation, cust_nation, l_year, round(sum(volume), 2) as revenue from (
  select n1.n_name as supp_nation, n2.n_name as cust_nation, year(l_shipdate) as l_year, {REVENUE} as volume
  from supplier, lineitem, orders, customer, nation n1, nation n2
  where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
    and ((n1.n_name = 'NATION_3' and n2.n_name = 'NATION_7') or (n1.n_name = 'NATION_7' and n2.n_name = 'NATION_3'))
    and l_shipdate between TS'1997-01-01' and TS'1999-12-31'
) shipping group by supp_nation, cust_nation, l_year"""
SQL["q8"] = f"""
select o_year, round(sum(case when nation = 'NATION_2' then volume else 0 end) / sum(volume), 6) as mkt_share from (
  select year(o_orderdate) as o_year, {REVENUE} as volume, n2.n_name as nation
  from part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey
    and n1.n_regionkey = r_regionkey and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey
    and o_orderdate between TS'1996-01-01' and TS'1999-12-31' and p_type = 'ECONOMY'
) all_nations group by o_year"""
SQL["q9_profit_by_nation_and_year"] = f"""
select n_name as nation, year(o_orderdate) as o_year, round(sum({REVENUE} - p_retailprice * l_quantity), 2) as sum_profit
from part, supplier, lineitem, orders, nation
where s_suppkey = l_suppkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%ring%'
group by n_name, year(o_orderdate)"""
SQL["q10"] = f"""
select c_custkey, c_name, round(sum({REVENUE}), 2) as revenue, c_acctbal, n_name
from customer, orders, lineitem, nation
where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= TS'1997-10-01' and o_orderdate < TS'1998-04-01' and l_returnflag = 'R' and c_nationkey = n_nationkey
group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20"""
SQL["q11_important_suppliers"] = f"""
select l_suppkey, round(sum({REVENUE}), 2) as value from lineitem group by l_suppkey
having sum({REVENUE}) > (select sum({REVENUE}) * 1.05 / count(distinct l_suppkey) from lineitem)"""
SQL["q12_priority_by_status"] = """
select l_linestatus, sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as high_line_count,
       sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as low_line_count
from orders, lineitem where o_orderkey = l_orderkey and l_returnflag in ('A', 'R') and l_shipdate >= TS'1998-01-01' and l_shipdate < TS'1999-01-01'
group by l_linestatus"""
DUCKDB["q12_priority_by_status"] = SQL["q12_priority_by_status"].replace("sum(case", "cast(sum(case").replace("end) as", "end) as bigint) as")
SQL["q13"] = """
select c_count, count(*) as custdist from (
  select c_custkey, count(o_orderkey) as c_count from customer left outer join orders on c_custkey = o_custkey and o_orderpriority not like '%LOW%' group by c_custkey
) c_orders group by c_count"""
SQL["q14"] = f"""
select round(100.00 * sum(case when p_type like 'PROMO%' then {REVENUE} else 0 end) / sum({REVENUE}), 6) as promo_revenue
from lineitem, part where l_partkey = p_partkey and l_shipdate >= TS'1997-09-01' and l_shipdate < TS'1997-10-01'"""
SQL["q15"] = f"""
with revenue as (select l_suppkey as supplier_no, round(sum({REVENUE}), 2) as total_revenue from lineitem where l_shipdate >= TS'1998-01-01' and l_shipdate < TS'1998-04-01' group by l_suppkey)
select s_suppkey, s_name, total_revenue from supplier, revenue where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue)"""
SQL["q16_supplier_count"] = """
select p_brand, p_type, p_size, count(distinct l_suppkey) as supplier_cnt from lineitem, part
where p_partkey = l_partkey and p_brand <> 'Brand#4' and p_type not like 'MEDIUM%' and p_size in (1, 4, 7, 9, 14, 19, 23, 36)
  and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 1000)
group by p_brand, p_type, p_size"""
SQL["q17"] = """
select round(sum(l_extendedprice) / 7.0, 2) as avg_yearly from lineitem, part
where p_partkey = l_partkey and p_brand = 'Brand#3' and l_quantity < (select 0.5 * avg(i.l_quantity) from lineitem i where i.l_partkey = p_partkey)"""
SQL["q18"] = """
select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) as sum_qty
from customer, orders, lineitem
where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200) and c_custkey = o_custkey and o_orderkey = l_orderkey
group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderkey limit 100"""
SQL["q19"] = f"""
select round(sum({REVENUE}), 2) as revenue from lineitem, part
where (p_partkey = l_partkey and p_brand = 'Brand#12' and l_quantity between 1 and 11 and p_size between 1 and 15)
   or (p_partkey = l_partkey and p_brand = 'Brand#23' and l_quantity between 10 and 20 and p_size between 1 and 20)
   or (p_partkey = l_partkey and p_brand = 'Brand#4' and l_quantity between 20 and 30 and p_size between 1 and 25)"""
SQL["q20_suppliers_of_rings"] = """
select s_name, s_acctbal from supplier, nation where s_suppkey in (
  select l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_name like '%ring%')
    and l_quantity > (select 1.5 * avg(i.l_quantity) from lineitem i where i.l_suppkey = lineitem.l_suppkey)
) and s_nationkey = n_nationkey and n_regionkey in (1, 2)"""
SQL["q21"] = """
select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation
where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_returnflag = 'R'
  and exists (select * from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
  and not exists (select * from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R')
  and s_nationkey = n_nationkey and n_name in ('NATION_1', 'NATION_5', 'NATION_9')
group by s_name order by numwait desc, s_name limit 100"""
SQL["q22"] = """
select segment, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal from (
  select substr(c_mktsegment, 1, 4) as segment, c_acctbal from customer
  where substr(c_mktsegment, 1, 1) in ('B', 'M', 'F') and c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.00)
    and not exists (select * from orders where o_custkey = c_custkey and o_orderstatus = 'P')
) custsale group by segment"""

# --- projection, filter, predicates
SQL["project_case_arithmetic"] = """
select o_orderkey, case when o_totalprice >= 400000 then 'large' when o_totalprice >= 100000 then 'medium' else 'small' end as size_class,
       o_totalprice * 2 - 5 as adjusted, o_orderkey % 7 as key_mod from orders"""
SQL["filter_null_in_between"] = """
select c_custkey, c_acctbal from customer
where (c_acctbal between 100 and 5000 or c_nationkey in (1, 2, 3)) and c_nationkey not in (4, 5) and c_mktsegment is not null and not (c_acctbal < 0)"""
SQL["filter_like_escape"] = r"""
select event_id, event_type from events where props like '{"k": 1_}' or event_type ilike 'S%' or event_type like 'cl!_%' escape '!'"""
SQL["cast_wide"] = """
select event_id, cast(value as bigint) as v_int, cast(event_id as double) as id_double, cast(user_id as string) as user_text, cast(event_id % 2 as boolean) as odd from events where value >= 0"""
DUCKDB["cast_wide"] = SQL["cast_wide"].replace("cast(value as bigint)", "cast(trunc(value) as bigint)").replace("as string", "as varchar")
SQL["scalar_subquery"] = "select c_custkey, c_acctbal from customer where c_acctbal > (select avg(c_acctbal) from customer)"
SQL["in_and_not_in_subquery"] = """
select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)
  and s_suppkey not in (select l_suppkey from lineitem where l_quantity = 50 and l_discount = 0.1)"""
SQL["correlated_exists"] = """
select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 450000)
  and not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')"""
SQL["cte_and_derived"] = """
with big as (select o_custkey, count(*) as n from orders where o_totalprice > 200000 group by o_custkey),
     named as (select c_name, n from customer join big on c_custkey = o_custkey)
select d.n, count(*) as customers, max(d.c_name) as last_name from (select * from named where n > 1) d group by d.n"""
SQL["values_relation"] = """
select v.code, v.label, count(o_orderkey) as n from (values ('O', 'open'), ('F', 'filled'), ('X', 'none')) as v(code, label)
left join orders on o_orderstatus = v.code group by v.code, v.label"""

# --- joins
SQL["join_inner"] = "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 300000"
SQL["join_left_residual"] = """
select c_custkey, count(o_orderkey) as n, round(coalesce(sum(o_totalprice), 0), 2) as total from customer
left join orders on c_custkey = o_custkey and o_orderpriority = '1-URGENT' and o_totalprice > c_acctbal group by c_custkey"""
SQL["join_right"] = "select n_name, count(s_suppkey) as suppliers from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000 group by n_name"
SQL["join_full"] = """
select coalesce(a.k, b.k) as k, a.n as left_n, b.n as right_n from
  (select o_custkey as k, count(*) as n from orders where o_orderstatus = 'P' group by o_custkey) a
full outer join (select o_custkey as k, count(*) as n from orders where o_orderstatus = 'F' group by o_custkey) b on a.k = b.k"""
SQL["join_cross"] = "select r_name, n_name from region cross join nation"
SQL["join_semi"] = "select c_custkey from customer left semi join orders on c_custkey = o_custkey and o_totalprice > 400000"
DUCKDB["join_semi"] = "select c_custkey from customer semi join orders on c_custkey = o_custkey and o_totalprice > 400000"
SQL["join_anti"] = "select c_custkey from customer left anti join orders on c_custkey = o_custkey"
DUCKDB["join_anti"] = "select c_custkey from customer anti join orders on c_custkey = o_custkey"
SQL["join_non_equi"] = """
select a.s_suppkey as a_key, b.s_suppkey as b_key from supplier a join supplier b
on a.s_nationkey = b.s_nationkey and a.s_acctbal < b.s_acctbal and a.s_suppkey <> b.s_suppkey"""
SQL["join_self"] = """
select a.o_orderkey as first_order, b.o_orderkey as second_order from orders a join orders b
on a.o_custkey = b.o_custkey and a.o_orderdate = b.o_orderdate and a.o_orderkey < b.o_orderkey"""
SQL["join_probe_key"] = """
select l_orderkey, l_linenumber, l_quantity, k.tag from lineitem join (values (17, 'a'), (42, 'b'), (99, 'c')) as k(partkey, tag) on l_partkey = k.partkey"""

# --- aggregation
SQL["group_multi_key"] = """
select o_orderstatus, o_orderpriority, count(*) as n, count(o_custkey) as n_cust, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean,
       min(o_totalprice) as low, max(o_totalprice) as high from orders group by o_orderstatus, o_orderpriority"""
SQL["count_distinct"] = """
select l_returnflag, count(distinct l_partkey) as parts, count(distinct case when l_quantity > 25 then l_suppkey end) as big_suppliers from lineitem group by l_returnflag"""
SQL["having_plain"] = "select o_custkey, count(*) as n from orders group by o_custkey having count(*) >= 15 and max(o_totalprice) > 300000"
SQL["distinct_rows"] = "select distinct p_brand, p_type from part where p_size < 10"
SQL["aggregate_global"] = "select count(*) as n, min(o_orderdate) as first_day, max(o_orderdate) as last_day, round(avg(o_totalprice), 4) as mean, max(o_custkey) as top from orders"
SQL["aggregate_empty"] = "select count(*) as n, avg(o_totalprice) as mean, max(o_orderkey) as top from orders where o_totalprice < 0"
SQL["conditional_aggregation"] = """
select event_type, sum(case when value > 50 then 1 else 0 end) as high, count(case when value <= 50 then 1 end) as low from events group by event_type"""
DUCKDB["conditional_aggregation"] = SQL["conditional_aggregation"].replace("sum(case when value > 50 then 1 else 0 end)", "cast(sum(case when value > 50 then 1 else 0 end) as bigint)")
SQL["aggregate_filter"] = "select user_id, count(*) filter (where event_type = 'click') as clicks, round(sum(value) filter (where event_type = 'purchase'), 2) as spent from events group by user_id"
SQL["rollup"] = "select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup(r_name, n_name)"
SQL["cube"] = "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube(o_orderstatus, o_orderpriority)"
SQL["grouping_sets"] = "select p_brand, p_type, count(*) as n from part group by grouping sets ((p_brand), (p_type), ())"
SQL["string_and_array_agg"] = """
select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names, cardinality(array_agg(n_nationkey)) as n from nation group by n_regionkey"""
DUCKDB["string_and_array_agg"] = "select n_regionkey, string_agg(n_name, ',' order by n_name) as names, cast(len(array_agg(n_nationkey)) as integer) as n from nation group by n_regionkey"
SQL["statistical"] = """
select event_type, round(stddev_samp(value), 6) as sd, round(var_pop(value), 6) as variance, round(corr(value, user_id), 6) as correlation,
       round(covar_pop(value, user_id), 6) as covariance, round(percentile(value, 0.5), 6) as median from events group by event_type"""
DUCKDB["statistical"] = SQL["statistical"].replace("percentile(value, 0.5)", "quantile_cont(value, 0.5)")
SQL["approximate"] = "select event_type, approx_count_distinct(user_id) as users, percentile_approx(value, 0.9) as p90 from events group by event_type"

# --- windows, order, limit, sets
SQL["window_ranking"] = """
select o_orderkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(4) over w as quarter
from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)"""
SQL["window_analytic"] = """
select event_id, lag(value) over w as before, lead(value, 2) over w as after, first_value(value) over w as first_v, last_value(value) over w as last_v
from events window w as (partition by user_id order by ts, event_id)"""
SQL["window_frames"] = """
select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 4) as moving,
       count(*) over (partition by user_id order by event_id range between 100 preceding and 100 following) as near_n from events"""
SQL["window_qualify"] = """
select * from (select c_nationkey, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rn from customer) r where rn <= 3"""
SQL["order_limit_offset"] = "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey asc limit 50 offset 20"
SQL["order_nulls"] = """
select * from (select c_custkey, nullif(c_nationkey, 3) as nk from customer) x order by nk desc nulls first, c_custkey limit 100"""
SQL["union_all"] = "select o_custkey as k from orders where o_totalprice > 400000 union all select c_custkey from customer where c_acctbal > 9000"
SQL["union_distinct"] = "select c_nationkey as k from customer union select s_nationkey from supplier"
SQL["intersect_distinct"] = "select o_custkey from orders where o_orderstatus = 'P' intersect select o_custkey from orders where o_orderstatus = 'F'"
SQL["intersect_all"] = "select l_partkey from lineitem where l_quantity > 40 intersect all select l_partkey from lineitem where l_discount > 0.08"
SQL["except_distinct"] = "select c_custkey from customer except select o_custkey from orders"
SQL["except_all"] = "select l_suppkey from lineitem where l_returnflag = 'R' except all select l_suppkey from lineitem where l_returnflag = 'A'"

# --- scalar families
SQL["scalar_string"] = """
select c_custkey, substr(c_name, 10, 4) as part, lower(c_name) as low, upper(c_mktsegment) as up, trim(concat('  ', c_name, ' ')) as trimmed, replace(c_name, '#', '-') as replaced,
       split_part(c_name, '#', 2) as second, lpad(c_mktsegment, 12, '*') as padded, rpad(c_mktsegment, 4, ' ') as cut, reverse(c_mktsegment) as turned,
       left(c_name, 3) as head, right(c_name, 3) as tail, char_length(c_name) as chars, position('#' in c_name) as hash_at, octet_length(encode(c_name, 'utf-8')) as bytes from customer"""
DUCKDB["scalar_string"] = SQL["scalar_string"].replace("char_length(c_name) as chars, position('#' in c_name) as hash_at, octet_length(encode(c_name, 'utf-8')) as bytes", "cast(length(c_name) as integer) as chars, cast(position('#' in c_name) as integer) as hash_at, cast(octet_length(encode(c_name)) as integer) as bytes")
SQL["scalar_datetime"] = """
select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, cast(date_trunc('month', o_orderdate) as date) as month_start,
       cast(o_orderdate + interval '10' day as date) as later, cast(extract(quarter from o_orderdate) as integer) as q, cast(to_timestamp('2020-01-02 03:04:05') as date) as fixed from orders"""
DUCKDB["scalar_datetime"] = SQL["scalar_datetime"].replace("year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d", "cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m, cast(day(o_orderdate) as integer) as d").replace("to_timestamp('2020-01-02 03:04:05')", "timestamp '2020-01-02 03:04:05'")
SQL["scalar_regex"] = r"""
select p_partkey, regexp_like(p_name, '^[a-m].*r') as early, regexp_replace(p_name, '[aeiou]', '_') as masked, regexp_extract(p_brand, 'Brand#([0-9]+)', 1) as number from part"""
DUCKDB["scalar_regex"] = SQL["scalar_regex"].replace("regexp_like", "regexp_matches").replace("'_')", "'_', 'g')")
SQL["scalar_nested"] = """
select n_nationkey, array_join(array(n_name, 'x'), '-') as joined, element_at(array(n_nationkey, 7, 9), 2) as second, size(split(n_name, '_')) as pieces, named_struct('k', n_regionkey).k as region_k from nation"""
DUCKDB["scalar_nested"] = """
select n_nationkey, array_to_string([n_name, 'x'], '-') as joined, [n_nationkey, 7, 9][2] as second, cast(len(string_split(n_name, '_')) as integer) as pieces, struct_pack(k := n_regionkey).k as region_k from nation"""
SQL["unnest"] = "select conv_id, turn, word from (select conv_id, turn, explode(split(text, ' ')) as word from conversations) w where length(word) > 12"
DUCKDB["unnest"] = "select conv_id, turn, word from (select conv_id, turn, unnest(string_split(text, ' ')) as word from conversations) w where length(word) > 12"
SQL["scalar_core"] = """
select c_custkey, coalesce(nullif(c_nationkey, 3), -1) as nk, greatest(c_acctbal, 0) as floor0, least(c_acctbal, 100) as cap100, abs(c_acctbal) as size, round(sqrt(abs(c_acctbal)), 6) as root,
       floor(c_acctbal) as down, sign(c_acctbal) as direction, round(power(c_nationkey, 2), 2) as squared, round(ln(abs(c_acctbal) + 1), 6) as logged, c_custkey % 5 as modulo from customer"""
DUCKDB["scalar_core"] = SQL["scalar_core"].replace("floor(c_acctbal)", "cast(floor(c_acctbal) as bigint)").replace("sign(c_acctbal)", "cast(sign(c_acctbal) as double)")
SQL["octet_length"] = "select doc_id, octet_length(text) as bytes, char_length(text) as chars from documents"
DUCKDB["octet_length"] = "select doc_id, cast(octet_length(encode(text)) as integer) as bytes, cast(length(text) as integer) as chars from documents"

#: Approximate aggregates have no exact equivalent.
NO_ORACLE = {"approximate"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def spark_text(name: str) -> str:
    return SQL[name].replace("TS'", "TIMESTAMP_NTZ'")


def duckdb_text(name: str) -> str:
    return DUCKDB.get(name, SQL[name]).replace("TS'", "TIMESTAMP '")


def query(name: str):
    text = spark_text(name)

    def run(spark, sf_dir):
        for table in TABLES:
            if table in text:
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(text)

    return run


QUERIES = {name: query(name) for name in SQL}
ORACLES = {name: duckdb_text(name) for name in SQL if name not in NO_ORACLE}

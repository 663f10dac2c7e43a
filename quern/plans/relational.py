"""Relational breadth on the star schema and on events: joins, sets, grouping, windows, JSON, time."""

from __future__ import annotations

from quern.plans.dialect import both

_SQL = [
    both("pricing_summary", """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 6) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus"""),
    both("join_inner_chain", """
select n_name, r_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name, r_name"""),
    both("join_left", "select c_custkey, count(o_orderkey) as orders, coalesce(round(sum(o_totalprice), 2), 0) as total from customer left join orders on c_custkey = o_custkey group by c_custkey"),
    both("join_full", "select coalesce(s_nationkey, c_nationkey) as nation, coalesce(s, 0) as suppliers, coalesce(c, 0) as customers from (select s_nationkey, count(*) as s from supplier where s_acctbal > 5000 group by 1) a full outer join (select c_nationkey, count(*) as c from customer where c_acctbal > 9000 group by 1) b on s_nationkey = c_nationkey"),
    both("join_semi", "select count(*) as n from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)"),
    both("join_anti", "select count(*) as n from customer where not exists (select 1 from orders where o_custkey = c_custkey)"),
    both("join_range", "select s.stage, count(*) as n, round(avg(value), 6) as mean from events join (values ('low', 0.0, 10.0), ('mid', 10.0, 100.0), ('high', 100.0, 1e9)) s(stage, lo, hi) on value >= lo and value < hi group by s.stage"),
    both("join_cross_small", "select r_name, s.k, count(*) as nations from region cross join (values (1), (2)) s(k) join nation on n_regionkey = r_regionkey group by r_name, s.k"),
    both("distinct_aggregate", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag"),
    both("group_cube", "select coalesce(c_mktsegment, '*') as segment, coalesce(cast(c_nationkey as varchar(10)), '*') as nation, count(*) as n from customer group by cube (c_mktsegment, c_nationkey)"),
    both("group_rollup", "select coalesce(o_orderpriority, '*') as priority, coalesce(o_orderstatus, '*') as status, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderpriority, o_orderstatus)"),
    both("group_sets", "select coalesce(p_brand, '*') as brand, coalesce(p_type, '*') as kind, count(*) as n from part group by grouping sets ((p_brand), (p_type), ())"),
    both("rank_functions", """
select c_custkey, cast(row_number() over w as bigint) as rn, cast(rank() over w as bigint) as rk, cast(dense_rank() over w as bigint) as dr, cast(ntile(4) over w as bigint) as quartile, round(percent_rank() over w, 9) as pr, round(cume_dist() over w, 9) as cd
from customer window w as (partition by c_nationkey order by c_acctbal desc, c_custkey)"""),
    both("analytic_frames", """
select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as s3, lag(event_id) over (partition by user_id order by ts, event_id) as prev,
  lead(event_id, 2) over (partition by user_id order by ts, event_id) as next2, first_value(event_type) over (partition by user_id order by ts, event_id) as first_type from events"""),
    both("set_union", "select n_nationkey as k from nation union select r_regionkey from region"),
    both("set_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier"),
    both("set_except", "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 45"),
    both("top_orders", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20"),
    both("top_per_group", "select * from (select c_nationkey, c_custkey, cast(row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as bigint) as rn from customer) q where rn <= 3"),
    both("json_props", "select event_type, cast(sum(#json_int(props|k)) as bigint) as total, max(#json_int(props|k)) as most from events group by event_type"),
    both("tumbling_hours", "select event_type, cast(date_trunc('day', ts) as date) as day, count(*) as n, round(sum(value), 4) as total from events group by event_type, cast(date_trunc('day', ts) as date)"),
    both("sessions", """
with g as (select user_id, ts, event_id, case when lag(ts) over w is null or ts > lag(ts) over w + interval '6' hour then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
select user_id, cast(session as bigint) as session, min(ts) as started, count(*) as n from s group by user_id, session"""),
    both("revenue_by_nation", """
select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey group by n_name"""),
    both("correlated_average", "select count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem l join (select l_partkey as k, 0.5e0 * avg(l_quantity) as q from lineitem group by l_partkey) a on l.l_partkey = a.k and l.l_quantity < a.q"),
    both("conditional_counts", "select o_orderpriority, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as f, cast(sum(case when o_orderstatus = 'O' then 1 else 0 end) as bigint) as o, cast(sum(case when o_orderstatus = 'P' then 1 else 0 end) as bigint) as p from orders group by o_orderpriority"),
    both("deduplicated_events", "select user_id, event_type, min(event_id) as first_event, count(*) as n from events group by user_id, event_type"),
    both("running_bytes", """
with d as (select doc_id, n_chars, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as run, source from documents where n_chars >= 200)
select source, count(*) as kept, cast(sum(n_chars) as bigint) as chars from d where run - n_chars < 20000 group by source"""),
    both("overflow_split", """
with d as (select doc_id, lang, n_chars, coalesce(sum(n_chars) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents)
select lang, case when before < 100000 then 'train' when before < 150000 then 'eval' else 'none' end as part, count(*) as n, cast(sum(n_chars) as bigint) as chars from d group by 1, 2"""),
    both("positional_split", """
with d as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as i, count(*) over (partition by lang) as n from documents)
select lang, case when i <= greatest(1, floor(8e-1 * n)) then 'train' else 'eval' end as part, count(*) as n from d group by 1, 2"""),
    both("result_upsert", """
with old as (select user_id as k, count(*) as n from events where event_id < 5000 group by 1), new as (select user_id as k, count(*) as n from events where event_id >= 5000 and user_id % 2 = 0 group by 1)
select k, n from old where k not in (select k from new) union all select k, n from new"""),
    both("missing_parameters", "select k from (values (1), (50), (149), (900)) g(k) where not exists (select 1 from events where user_id = k)"),
    both("tolerance_check", "select a.event_type, abs(a.m - b.m) > 5 as outside from (select event_type, avg(value) as m from events group by 1) a join (select event_type, avg(value) as m from events where event_id % 2 = 0 group by 1) b on a.event_type = b.event_type"),
    both("cheap_checks", "select name, case when ok then 'PASS' else 'FAIL' end as verdict from (select 'finite' as name, count(*) = count(value) as ok from events union all select 'positive', min(value) >= 0 from events union all select 'unique', count(*) = count(distinct event_id) from events) q"),
]
QUERIES = {n: f for n, f, _ in _SQL}
ORACLES = {n: q for n, _, q in _SQL}

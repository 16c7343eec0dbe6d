"""Suggestions compiled, ordered and turned into changes; orders stand for drafts, customers for runs and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import suggestions as S
from ..session import table
from .graph import entities
from .registry import query

_RAW = """with recursive ent as (select c_custkey as id, c_name as name, case when c_custkey % 3 <> 0 then ['al' || (c_custkey % 700), 'Zz' || c_custkey] else [] end as aliases, c_mktsegment as entity_type from customer),
 ord as (select *, lead(o_orderkey) over w as nx, lag(o_orderkey) over w as pv from orders window w as (partition by o_custkey order by o_orderkey)),
 raw as (select o_custkey as run, o_orderkey as pos, case o_orderstatus when 'O' then 'create_relationship' when 'F' then 'create_entity' else 'update_entity' end as kind, case when o_orderkey % 13 <> 0 then 'E' || (o_orderkey % 7) end as name, o_orderpriority as entity_type, case when o_orderstatus = 'P' then o_custkey * (1 + o_orderkey % 2 * 100000) end as target_id,
   case when o_orderkey % 3 = 0 then o_custkey end as source_id, 'e' || (o_orderkey % 9) as source_name, case when o_orderkey % 11 <> 0 then 'AL' || (o_orderkey % 900) end as dest_name, 'knows ' || o_orderpriority as label, list_filter([case when o_orderkey % 4 = 0 then nx end, case when o_orderkey % 4 = 1 then pv end], lambda x: x is not null) as needs from ord),
 kn as (select key, min(id) as known_id from (select id, lower(name) as key from ent union all select id, lower(unnest(aliases)) from ent) group by key),
 e0 as (select run, pos, 0 as side, source_id as end_id, source_name as end_name from raw where kind = 'create_relationship' union all select run, pos, 1, null, coalesce(dest_name, '') from raw where kind = 'create_relationship'),
 dr as (select run, lower(name) as key, min(pos) as draft_pos from raw where kind = 'create_entity' and name is not null group by all),
 e1 as (select e.*, lower(end_name) as key, coalesce(i.id, kn.known_id) as entity, draft_pos from e0 e left join ent i on i.id = e.end_id left join kn on kn.key = lower(e.end_name) left join dr on dr.run = e.run and dr.key = lower(e.end_name)),
 sy as (select run, key, arg_min(struct_pack(pos := pos, side := side, name := end_name), (pos, side)) as f from e1 where entity is null and draft_pos is null and key <> '' group by run, key),
 st as (select *, row_number() over (partition by run order by pos, sub) as step from (select run, pos, 2 as sub, kind, name, entity_type, target_id, label, false as made, null as key from raw union all select run, f.pos, f.side, 'create_entity', f.name, 'Other', null, null, true, key from sy)),
 pl as (select e1.*, case when entity is null then coalesce(d.step, m.step) end as need from e1 left join st d on d.run = e1.run and d.pos = e1.draft_pos and d.sub = 2 left join st m on m.run = e1.run and m.made and m.key = e1.key),
 rf as (select run, pos, max(case when side = 0 then r end) as source, max(case when side = 1 then r end) as target from (select *, case when entity is not null then 'entity:' || entity when need is not null then 'step:' || need end as r from pl) group by all),
 sp as (select st.run, step, st.pos, kind, name, entity_type, target_id, source, target, label, made, case when kind = 'create_entity' and trim(coalesce(name, '')) = '' then 'no_name' when kind = 'update_entity' and target_id not in (select id from ent) then 'no_target' when kind = 'create_relationship' and (source is null or target is null) then 'no_end' end as fault from st left join rf on rf.run = st.run and rf.pos = st.pos and st.sub = 2),
 nd as (select pl.run, s.step, pl.need from pl join st s on s.run = pl.run and s.pos = pl.pos and s.sub = 2 where need is not null union select r.run, s.step, t.step from (select run, pos, unnest(needs) as p2 from raw) r join st s on s.run = r.run and s.pos = r.pos and s.sub = 2 join st t on t.run = r.run and t.pos = r.p2 and t.sub = 2),
 wk(run, step, here, path, ring) as (select run, step, step, [step], false from sp union all select w.run, w.step, n.need, list_append(path, n.need), list_contains(path, n.need) from wk w join nd n on n.run = w.run and n.step = w.here where not ring),
 sn as (select w.run, w.step, max(len(path) - 1) as depth, bool_or(ring) as ring, bool_or(b.fault is not null) as bad from wk w join sp b on b.run = w.run and b.step = w.here group by all),
 pn as (select sp.*, coalesce(fault, case when ring then 'cycle' when bad then 'blocked' else 'ready' end) as status, depth from sp join sn using (run, step)) """


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    k, customer = F.col("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), k % n)
    status = F.col("o_orderstatus")
    needs = F.array_compact(F.array(F.when(k % 4 == 0, F.lead("o_orderkey").over(customer)), F.when(k % 4 == 1, F.lag("o_orderkey").over(customer))))
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("run"), k.alias("pos"), F.when(status == "O", "create_relationship").when(status == "F", "create_entity").otherwise("update_entity").alias("kind"), F.when(k % 13 != 0, text("E", 7)).alias("name"), F.col("o_orderpriority").alias("entity_type"),
        F.when(status == "P", F.col("o_custkey") * (1 + k % 2 * 100_000)).alias("target_id"), F.when(k % 3 == 0, F.col("o_custkey")).alias("source_id"), text("e", 9).alias("source_name"), F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("long").alias("dest_id"), F.when(k % 11 != 0, text("AL", 900)).alias("dest_name"),
        F.lit("").alias("dest_type"), F.concat(F.lit("knows "), "o_orderpriority").alias("label"), needs.alias("needs"),
    )


@query(_RAW + "select run, step, pos, kind, name, made, source, target, status, case when status = 'ready' then depth end as level from pn")
def suggestion_plan(spark: SparkSession, d: str) -> DataFrame:
    planned = S.plan(*S.compiled(_drafts(spark, d), entities(spark, d)))
    return planned.select("run", "step", "pos", "kind", "name", "made", "source", "target", "status", "level")


@query(_RAW + """, fd as (select pn.run, pn.depth as level, step, unnest(case when kind = 'create_relationship' then [{'field': 'source', 'before': null, 'after': source}, {'field': 'target', 'before': null, 'after': target}, {'field': 'label', 'before': null, 'after': label}]
   else [{'field': 'name', 'before': e.name, 'after': pn.name}, {'field': 'entity_type', 'before': e.entity_type, 'after': pn.entity_type}] end) as f from pn left join ent e on e.id = pn.target_id where status = 'ready')
 select run, level, step, f.field as field, f.before as before, f.after as after from fd where f.after is not null and f.after is distinct from f.before""")
def suggestion_deltas(spark: SparkSession, d: str) -> DataFrame:
    nodes = entities(spark, d)
    return S.deltas(S.plan(*S.compiled(_drafts(spark, d), nodes)), nodes)

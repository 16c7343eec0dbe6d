"""Chapters from pieces, life of assets, contexts within budgets, answers checked, tables repaired.

Events stand for what happens to an index, customers of a nation for a context's entities, orders for
answers, sessions and chapters, line items for runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import validation as V
from ..operators import budget as B
from ..operators import pieces as P
from ..operators import repair as X
from ..session import settled, table
from ..streaming import events as E
from ..streaming import lifecycle as L
from .registry import SQL, query
from .texts import _HEADING


@query(SQL["chapter_split"])
def chapter_split_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The chapters of chapter_split from texts in pieces of 700 characters, which cut headings and lines."""
    pieces = P.pieces_of(table(spark, d, "documents"), "doc_id", "text", 700)
    return P.gathered(*P.split_pieces(pieces, [("any", _HEADING)])).select("id", "chapter", "label", "title", "content")


_LIFE = """with e as (select user_id, case event_type when 'signup' then 'enqueue' when 'view' then 'enqueue' when 'click' then 'claim' when 'purchase' then 'success' when 'error' then 'failure' end as op, cast(json_extract_string(props, '$.k') as bigint) as rev, case when event_type = 'error' then 'e' || event_id end as err from events),
 m as (select user_id, coalesce(max(rev) filter (rev > 0), 0) as target, coalesce(max(rev) filter (op = 'claim' and rev > 0), 0) as claimed, coalesce(max(rev) filter (op = 'success' and rev > 0), 0) as completed, coalesce(max(rev) filter (op = 'failure' and rev > 0), 0) as failed,
  max({'r': rev, 'e': err}) filter (op = 'failure' and rev > 0) as worst from e where op is not null group by user_id),
 s as (select *, case when completed >= target then 'completed' when failed >= target then 'failed' when claimed >= target and claimed > completed and claimed > failed then 'running' else 'queued' end as status from m)
 select user_id, target, claimed, completed, failed, status, case when status = 'failed' then worst.e end as error from s"""


def _happened(events: DataFrame) -> DataFrame:
    kinds = {"signup": "enqueue", "view": "enqueue", "click": "claim", "purchase": "success", "error": "failure"}
    operation = F.lit(None).cast("string")
    for kind, what in kinds.items():
        operation = F.when(F.col("event_type") == kind, what).otherwise(operation)
    return events.select("user_id", operation.alias("operation"), F.get_json_object("props", "$.k").cast("long").alias("revision"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), "event_id")).alias("error"))


@query(_LIFE)
def index_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return L.state_of(_happened(table(spark, d, "events")), "user_id")


@query(_LIFE)
def index_lifecycle_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same states from a stream over the events, dealt out to files first so that several micro-batches arrive."""
    settled(spark.range(1))  # sets the shared folder
    folder = f"{spark.sparkContext.getCheckpointDir()}/lifecycle-{uuid.uuid4().hex}"
    happened = _happened(table(spark, d, "events"))
    happened.repartition(8).write.parquet(f"{folder}/in")
    stream = E.read_events(spark, f"{folder}/in", "user_id bigint, operation string, revision bigint, error string", files=3)
    E.run_available(L.advanced(stream, "user_id"), f"{folder}/progress", L.keep_updates(f"{folder}/out"), "update")
    updates = spark.read.schema("key long, target long, claimed long, completed long, failed long, error string, version long").parquet(f"{folder}/out")
    return L.latest_states(updates, "user_id")


_BUDGET = """with ent as (select c_nationkey as ctx, c_custkey as id, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank, length(c_name) + length(c_mktsegment) as cost from customer),
 num as (select ctx, count(*) as n from ent group by ctx),
 att as (select e.ctx, e.rank, o_orderkey % 3 = 0 as ref, length(o_orderpriority) + length(o_orderstatus) as cost from orders join ent e on e.id = o_custkey),
 edg as (select e.ctx, greatest(e.rank, t.rank) as rank, o_orderkey % 2 = 0 as ref, length(o_orderpriority) + 10 as cost from orders join ent e on e.id = o_custkey join num using (ctx) join ent t on t.ctx = e.ctx and t.rank = 1 + o_orderkey % n),
 sys as (select s_nationkey as ctx, sum(length(s_name)) as cost from supplier where s_nationkey in (select ctx from ent) group by 1),
 ctxs as (select distinct ctx from ent), ks as (select ctx, 0 as k from ctxs union all select ctx, rank from ent),
 own as (select rank as k, ctx, sum(cost) as cost from (select ctx, rank, cost from ent union all select ctx, rank, cost from att where not ref union all select ctx, rank, cost from edg where not ref) group by all),
 at_k as (select ks.ctx, ks.k, coalesce(sum(own.cost) over (partition by ks.ctx order by ks.k), 0) + coalesce(sys.cost, 0) as cost from ks left join own on own.ctx = ks.ctx and own.k = ks.k left join sys on sys.ctx = ks.ctx),
 tot as (select c.ctx, (select max(cost) from at_k where at_k.ctx = c.ctx) as base, coalesce((select sum(cost) from att where ref and att.ctx = c.ctx), 0) as refs, coalesce((select sum(cost) from edg where ref and edg.ctx = c.ctx), 0) as ref_edges from ctxs c),
 b as (select tot.*, n, budget from tot join num using (ctx), unnest([600, 6000, 60000]) u(budget)),
 t as (select *, case when base + refs + ref_edges <= budget then 0 when base + refs <= budget then 1 when base <= budget then 2 else 3 end as tier from b)
 select ctx, budget, cast(tier as integer) as tier, cast(case when tier < 3 then n else coalesce((select max(k) from at_k where at_k.ctx = t.ctx and at_k.cost <= budget), 0) end as bigint) as kept,
 cast(case tier when 0 then base + refs + ref_edges when 1 then base + refs when 2 then base else coalesce((select max(a.cost) from at_k a where a.ctx = t.ctx and a.cost <= budget), (select cost from at_k a where a.ctx = t.ctx and k = 0)) end as bigint) as cost from t"""


@query(_BUDGET)
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of three budgets: nearly all, some and few of a nation's customers stay."""
    nation = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    entities = table(spark, d, "customer").select(F.col("c_nationkey").alias("ctx"), F.col("c_custkey").alias("id"), F.row_number().over(nation).alias("rank"), B.chars(F.col("c_name"), F.col("c_mktsegment")).alias("cost"))
    orders = table(spark, d, "orders").join(entities.select("ctx", F.col("id").alias("o_custkey")), "o_custkey")
    kind = lambda k: F.when(F.col("o_orderkey") % k == 0, "reference").otherwise("active").alias("visibility")
    attributes = orders.select("ctx", F.col("o_custkey").alias("entity_id"), kind(3), B.chars(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("cost"))
    peers = entities.select("ctx", F.col("rank").cast("long").alias("place"), F.col("id").alias("target_id"))
    sized = orders.join(entities.groupBy("ctx").agg(F.count("*").alias("n")), "ctx").withColumn("place", 1 + F.col("o_orderkey") % F.col("n")).join(peers, ["ctx", "place"])
    edges = sized.select("ctx", F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("source_id"), "target_id", kind(2), (B.chars(F.col("o_orderpriority")) + 10).alias("cost"))
    contexts = entities.select("ctx").distinct()
    systems = table(spark, d, "supplier").select(F.col("s_nationkey").alias("ctx"), B.chars(F.col("s_name")).alias("cost")).join(contexts, "ctx", "left_semi")
    budgets = contexts.select("ctx", F.explode(F.array(*map(F.lit, (600, 6000, 60000)))).alias("budget"))
    return B.fit(entities, attributes, edges, systems, budgets)


SCHEMA = {"type": "object", "fields": {"name": {"type": "string", "required": True}, "status": {"type": "string", "required": True, "values": ["O", "F"]}, "total": {"type": "number", "required": True}, "items": {"type": "array", "items": {"type": "object", "fields": {"id": {"type": "integer", "required": True}}}}}}


@query("""with r as (select o_orderkey as k, '{' || case when o_orderkey % 11 = 0 then '' else '"name": "' || o_orderpriority || '", ' end || '"status": "' || o_orderstatus || '", "total": ' || case when o_orderkey % 5 = 0 then '"much"' else cast(o_orderkey as varchar) || '.5' end || ', "items": [{"id": 1}, {"id": ' || case when o_orderkey % 7 = 0 then '"bad"' else cast(o_orderkey as varchar) end || '}]}' as t from orders),
 w as (select k, k % 17 = 0 as late, case when k % 13 = 0 then left(t, length(t) - 4) when k % 19 = 0 then 'Here you are' when k % 23 = 0 then '' else t end as t from r),
 f as (select *, case when late then 'truncated' when t = '' then 'empty' when not json_valid(t) and starts_with(t, '{') then 'truncated' when not json_valid(t) then 'no JSON' when json_type(t, '$.name') is null then '$.name: missing' when json_extract_string(t, '$.status') not in ('O', 'F') then '$.status: not allowed'
   when json_type(t, '$.total') = 'VARCHAR' then '$.total: not number' when json_type(t, '$.items[1].id') = 'VARCHAR' then '$.items[1].id: not integer' end as fault from w)
 select k, fault is null as valid, fault, coalesce(fault = 'truncated', false) as truncated from f""".replace("json_type(t,", "json_type(case when json_valid(t) then t end,").replace("json_extract_string(t,", "json_extract_string(case when json_valid(t) then t end,"))
def answer_check(spark: SparkSession, d: str) -> DataFrame:
    """Answers, some fenced, cut off, of wrong types or no JSON at all."""
    k, c = F.col("o_orderkey"), lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    name = F.when(k % 11 == 0, "").otherwise(c('"name": "', F.col("o_orderpriority"), '", '))
    text = c("{", name, '"status": "', F.col("o_orderstatus"), '", "total": ', F.when(k % 5 == 0, '"much"').otherwise(c(k.cast("string"), ".5")), ', "items": [{"id": 1}, {"id": ', F.when(k % 7 == 0, '"bad"').otherwise(k.cast("string")), "}]}")
    text = F.when(k % 13 == 0, F.substring(text, F.lit(1), F.length(text) - 4)).when(k % 19 == 0, "Here you are").when(k % 23 == 0, "").otherwise(text)
    text = F.when(k % 4 == 0, c("```json\n", text, "\n```")).otherwise(text)
    answers = table(spark, d, "orders").select(k.alias("k"), text.alias("text"), F.when(k % 17 == 0, "length").otherwise("stop").alias("finish"))
    return V.checked(answers, "text", SCHEMA, "finish").select("k", "checked.valid", "checked.fault", "checked.truncated")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), (F.col("o_custkey") % 50).alias("novel_id"), F.col("o_orderpriority").alias("user_id"), F.col("o_orderstatus").alias("signature"), F.when(k % 3 != 0, F.col("o_orderdate")).alias("last_active_at"), F.date_add(F.col("o_orderdate").cast("date"), -1).cast("timestamp_ntz").alias("created_at"))


@query("""with s as (select o_orderkey as id, o_custkey % 50 as novel_id, o_orderpriority as user_id, o_orderstatus as signature, coalesce(case when o_orderkey % 3 <> 0 then o_orderdate end, cast(cast(o_orderdate as date) - 1 as timestamp)) as seen from orders),
 k as (select id, first(id) over (partition by novel_id, user_id, signature order by seen desc, id desc) as keeper from s)
 select keeper as session_id, (select count(*) from k b where b.keeper = a.keeper) as merged, coalesce((select count(*) from lineitem join k b on b.id = l_orderkey where b.keeper = a.keeper), 0) as runs from (select distinct keeper from k) a""")
def session_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each session that stays, with how many it stands for and its runs after repointing."""
    sessions = _sessions(spark, d)
    runs = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("session_id"))
    kept, moved = X.merged_sessions(sessions, runs)
    order = [F.coalesce("last_active_at", "created_at").desc_nulls_last()]
    sizes = X.survivors(sessions, ["novel_id", "user_id", "signature"], order).groupBy(F.col("keeper").alias("session_id")).agg(F.count("*").alias("merged"))
    counted = moved.groupBy("session_id").agg(F.count("*").alias("runs"))
    return kept.select(F.col("id").alias("session_id")).join(sizes, "session_id").join(counted, "session_id", "left").select("session_id", "merged", F.coalesce("runs", F.lit(0)).alias("runs"))


@query("""with r as (select l_orderkey * 10 + l_linenumber as id, l_partkey as session_id, case l_returnflag when 'R' then 'running' when 'A' then 'queued' else 'done' end as status, case when l_linenumber % 2 = 0 then l_shipdate end as started_at, cast('1992-01-01' as timestamp) as created_at, l_linestatus as lease_owner from lineitem),
 n as (select *, row_number() over (partition by session_id, status in ('queued', 'running') order by (status <> 'running')::int, coalesce(started_at, created_at) desc, id desc) as nth from r)
 select id, case when x then 'interrupted' else status end as status, case when x then 'second active run' end as error, case when not x then lease_owner end as lease_owner from (select *, status in ('queued', 'running') and nth > 1 as x from n)""")
def active_run_repair(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    runs = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("session_id"), F.when(flag == "R", "running").when(flag == "A", "queued").otherwise("done").alias("status"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")).alias("started_at"),
        F.lit("1992-01-01").cast("timestamp_ntz").alias("created_at"), F.col("l_linestatus").alias("lease_owner"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("finished_at"),
    )
    return X.one_active(runs, F.current_timestamp(), "second active run").select("id", "status", "error", "lease_owner")


@query("""select c_custkey as id, case when c_acctbal > 0 then 'fresh' else 'missing' end as index_status, case when exists (select 1 from orders where o_custkey = c_custkey) then 1 else 0 end as index_revision, case when c_acctbal > 0 then 1 end as built_revision from customer""")
def index_backfill(spark: SparkSession, d: str) -> DataFrame:
    novels = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("has_index"))
    out = X.back_filled(novels, table(spark, d, "orders").select(F.col("o_custkey").alias("novel_id")))
    return out.select("id", "index_status", "index_revision", "built_revision")


@query("""select o_orderkey, o_custkey, o_orderpriority from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as r from orders) where r = 1 and not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal < 0 and o_orderpriority = '1-URGENT')""")
def first_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as inserted under a unique key, where customers in debt already hold the urgent key."""
    given = table(spark, d, "orders")
    stored = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    return X.first_inserted(given, stored, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderpriority")

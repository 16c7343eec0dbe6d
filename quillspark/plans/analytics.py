"""Analytics queries. The events table stands for the product's log: project k % 10 of the props, click for a generation, purchase for a save, view for a completed demo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..session import table
from .registry import query

NOW = "timestamp '2024-01-31 00:00:00'"


def log(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        "event_id", "user_id", F.when(k % 7 == 0, F.concat(F.lit("v"), k)).alias("anonymous_id"), F.col("event_type").alias("event"), F.when(k >= 5, k % 10).alias("project_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.create_map(F.lit("mode"), F.when(k % 3 != 0, F.concat(F.lit("m"), k % 4)), F.lit("channel"), F.concat(F.lit("c"), k % 5)).alias("meta"),
    )


LOG = """with log as (select event_id, user_id, case when k % 7 = 0 then 'v' || k end as anonymous_id, event_type as event,
 case when k >= 5 then k % 10 end as project_id, ts as created_at, case when k % 3 <> 0 then 'm' || (k % 4) end as mode, 'c' || (k % 5) as channel
 from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)) """
COUNTS = {"generation": "click", "save": "purchase", "demo": "view", "error": "error"}


@query(LOG + "select event, count(*) as total, count(distinct user_id) as users, count(distinct anonymous_id) as visitors, count(distinct (user_id, project_id)) as projects from log group by event")
def funnel_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.funnel_summary(log(spark, d))


@query(LOG + """, keys as (select distinct user_id, project_id from log where event in ('signup') and project_id is not null)
 select event_id, event from log where project_id is null or exists (select 1 from keys where keys.user_id = log.user_id and keys.project_id = log.project_id)""")
def trusted_projects(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)
    return A.trusted_events(rows, rows.filter("false"), ["signup"]).select("event_id", "event")


@query(LOG + "select user_id, min(created_at) as signup_at, arg_min(mode, (created_at, event_id)) as mode, arg_min(channel, (created_at, event_id)) as channel from (select *, coalesce(mode, '') as mode0 from log where event = 'signup') group by user_id".replace("arg_min(mode,", "nullif(arg_min(mode0,").replace("event_id)) as mode,", "event_id)), '') as mode,"))
def signup_attribution(spark: SparkSession, d: str) -> DataFrame:
    return A.signup_attribution(log(spark, d), "signup", ["mode", "channel"])


_ROLLUP = LOG + """, marked as (select *, min(case when event = 'click' then (created_at, event_id) end) over (partition by user_id, project_id) as begun from log where project_id is not null),
 rollup_ as (select user_id, project_id, count(*) as n_events, min(created_at) as first_seen_at, max(created_at) as last_seen_at,
 coalesce(min(created_at) filter (event = 'signup'), min(created_at)) as start_at, coalesce(arg_max(mode, (created_at, event_id)) filter (event = 'signup' and mode is not null), 'unknown') as start_mode,
 min(created_at) filter (event = 'purchase' and (created_at, event_id) > begun) as first_value_at, """ + ", ".join(f"count(*) filter (event = '{e}') as n_{n}, min(created_at) filter (event = '{e}') as first_{n}_at" for n, e in COUNTS.items()) + " from marked group by user_id, project_id) "


def _projects(spark: SparkSession, d: str) -> DataFrame:
    return A.project_rollup(log(spark, d), COUNTS, "signup", "click", "purchase")


@query(_ROLLUP + "select * from rollup_")
def project_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _projects(spark, d)


@query(_ROLLUP + "select start_mode, count(*) as projects, count(distinct user_id) as users, count(*) filter (n_generation > 0) as generated, count(*) filter (n_save > 1) as saved_twice, count(*) filter (first_value_at is not null) as reached_value from rollup_ group by start_mode")
def segment_summary(spark: SparkSession, d: str) -> DataFrame:
    flags = {"generated": F.col("n_generation") > 0, "saved_twice": F.col("n_save") > 1, "reached_value": F.col("first_value_at").isNotNull()}
    return A.segment_summary(_projects(spark, d), ["start_mode"], flags)


@query(_ROLLUP + """select metric, count(*) filter (holds) as projects, count(distinct user_id) filter (holds) as users from (
 select user_id, 'generated' as metric, n_generation > 0 as holds from rollup_ union all select user_id, 'saved', n_save > 0 from rollup_
 union all select user_id, 'value', first_value_at is not null from rollup_ union all select user_id, 'failed', n_error > n_save from rollup_) group by metric""")
def derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    return A.metrics(_projects(spark, d), {"generated": F.col("n_generation") > 0, "saved": F.col("n_save") > 0, "value": F.col("first_value_at").isNotNull(), "failed": F.col("n_error") > F.col("n_save")})


@query(LOG + f"select event, cast(created_at as date) as day, count(*) as n from log where created_at >= {NOW} - interval 20 day group by all")
def daily_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return A.daily_counts(log(spark, d), F.expr("timestamp_ntz '2024-01-31 00:00:00'"), 20)


@query(LOG + """, f as (select user_id, min(created_at) as completed_at from log where event = 'view' group by user_id)
 select f.user_id, completed_at, count(*) filter (event = 'click' and created_at >= completed_at) as n_click, count(*) filter (event = 'purchase' and created_at >= completed_at) as n_purchase from f join log using (user_id) group by all""")
def cross_project(spark: SparkSession, d: str) -> DataFrame:
    return A.after_first(log(spark, d), "view", ["click", "purchase"])


@query(LOG + "select event_id, user_id, event, created_at from log order by created_at desc, event_id desc limit 100")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return A.recent(log(spark, d).select("event_id", "user_id", "event", "created_at"))


@query(LOG + """select user_id, project_id, 'signup' as event, (min((created_at, event_id)))[1] as created_at from log l where project_id is not null group by user_id, project_id
 having not bool_or(event = 'signup')""")
def project_starts(spark: SparkSession, d: str) -> DataFrame:
    return A.missing_starts(log(spark, d), "signup")


@query(LOG + """select before, after, count(*) as n, (before, after) in (('signup', 'view'), ('view', 'click'), ('click', 'purchase')) as is_allowed
 from (select lag(event) over (partition by user_id order by created_at, event_id) as before, event as after from log) where before is not null group by all""")
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase")], "before string, after string")
    return A.transitions(log(spark, d), allowed)


def usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("node"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_extendedprice").alias("cost"), F.when(F.col("l_linenumber") % 2 == 0, "hosted").otherwise("own").alias("billing"), F.col("l_shipdate").cast("timestamp_ntz").alias("created_at"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")
    )


@query("""with u as (select l_returnflag as model, case when l_linestatus <> 'F' then l_linestatus else 'unknown' end as node, cast(l_quantity as bigint) as tokens, l_extendedprice as cost from lineitem)
 select case grouping(model, node) when 3 then 'total' when 1 then 'model' else 'node' end as kind, coalesce(model, node, '') as name, count(*) as requests, cast(sum(tokens) as bigint) as tokens, round(sum(cost), 2) as cost from u group by grouping sets ((), (model), (node))""")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.usage_summary(usage(spark, d))


@query("select l_orderkey as id, l_linenumber as line, l_returnflag as model, l_extendedprice as cost, l_shipdate as created_at from lineitem order by l_shipdate desc, l_orderkey desc, l_linenumber desc limit 200")
def usage_recent(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).select("id", "line", "model", "cost", "created_at").orderBy(F.desc("created_at"), F.desc("id"), F.desc("line")).limit(200)


@query("select round(coalesce(sum(l_extendedprice), 0), 2) as spent, round(coalesce(sum(l_extendedprice), 0), 2) >= 1000000.0 as blocked from lineitem where l_linenumber % 2 = 0")
def spend_guard(spark: SparkSession, d: str) -> DataFrame:
    return A.spend_guard(usage(spark, d), 1e6)


def reservations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), F.col("l_quantity").cast("long").alias("reserved"), (F.col("l_tax") * 500).cast("long").alias("charged"), F.concat(F.lit("lease"), F.col("l_linenumber") % 3).alias("lease"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("released_at")
    )


@query("""select l_suppkey as user_id, count(*) as reservations, cast(sum(greatest(0, cast(l_quantity as bigint) - cast(trunc(l_tax * 500) as bigint))) as bigint) as refund
 from lineitem where l_linestatus <> 'F' and l_linenumber % 3 <> 1 group by 1""")
def quota_refunds(spark: SparkSession, d: str) -> DataFrame:
    return A.quota_refunds(reservations(spark, d), "lease1")


@query("select l_suppkey as user_id, count(*) as n from lineitem where trunc(l_tax * 500) > cast(l_quantity as bigint) or l_tax < 0 group by 1")
def quota_violations(spark: SparkSession, d: str) -> DataFrame:
    return A.quota_violations(reservations(spark, d)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("select source as novel_id, doc_id as chapter_number, length(text) as chars, chapters from (select *, count(*) over (partition by source) as chapters, row_number() over (partition by source order by doc_id desc) as r from documents) where r <= 3")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("novel_id"), F.col("doc_id").alias("chapter_number"), F.col("text").alias("content"))
    return A.dashboard(docs, 3)


def jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 400 days")).alias("lease_expires_at"), F.col("o_custkey").alias("novel_id")
    )


@query("select o_orderpriority as kind, count(*) as queued, cast(max(epoch(timestamp '2000-01-01') - epoch(o_orderdate)) as bigint) as oldest_s, max(epoch(timestamp '2000-01-01') - epoch(o_orderdate)) >= 300 as stalled from orders where o_orderstatus = 'O' group by 1")
def queue_health(spark: SparkSession, d: str) -> DataFrame:
    return A.queue_health(jobs(spark, d), F.expr("timestamp_ntz '2000-01-01 00:00:00'"), 300)


@query("select o_orderkey as id from orders where o_orderstatus = 'P' and case when o_orderkey % 2 = 0 then o_orderdate + interval 400 day <= timestamp '1997-01-01' else epoch(timestamp '1997-01-01') - epoch(o_orderdate) >= 86400 * 90 end")
def stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    return A.stale_jobs(jobs(spark, d), F.expr("timestamp_ntz '1997-01-01 00:00:00'"), 86400 * 90).select("id")


@query("select o_orderkey as id, o_custkey as novel_id, o_orderdate as ready_at from orders o where o_orderstatus = 'O' and not exists (select 1 from orders p where p.o_orderstatus = 'P' and p.o_custkey = o.o_custkey) order by o_orderdate, o_orderkey limit 1")
def next_deferred(spark: SparkSession, d: str) -> DataFrame:
    rows = jobs(spark, d)
    return A.next_deferred(rows.filter("status = 'queued'").select("id", "novel_id", F.col("created_at").alias("ready_at")), rows.filter("status = 'running'"))


@query("select source, lang, round(avg(length(text)), 6) as avg, median(length(text)) as p50, cast(max(length(text)) as double) as max from documents group by source, lang")
def profiler(spark: SparkSession, d: str) -> DataFrame:
    return A.profile(table(spark, d, "documents").withColumn("n", F.length("text")), ["source", "lang"], "n")


@query(r"select doc_id, 10 + case when length(regexp_replace(text, '\s+', '', 'g')) >= 20 and len(list_distinct(string_split(regexp_replace(text, '\s+', '', 'g'), ''))) >= 6 then 5 else 0 end as quota from documents")
def feedback_bonus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", A.feedback_bonus(F.col("text")).alias("quota"))

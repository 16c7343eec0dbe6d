"""Profiles of projects. The events table stands for the log: its ids and k name the events, projects and meta values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles as P
from ..session import table
from .registry import query

NAMES = [P.SIGNUP, P.START, P.UPLOAD, *P.COUNTS.values(), *P.DECIDED.values(), "demo_guide_completed", "demo_guide_skipped", P.APPLY, P.CLICK]
#: Meta keys and their values, SQL over n, a number made of the event's id and k; both engines read it alike.
META = {
    "start_mode": "case when n % 3 = 0 then 'chapter_import' when n % 3 = 1 then 'm' || (n % 4) end",
    "entry_action": "case when n % 2 = 0 then 'a' || (n % 6) end",
    "source_surface": "case when n % 4 <> 0 then ' s' || (n % 5) else ' ' end",
    "channel": "case when n % 5 = 0 then 'c' || (n % 3) end",
    "invite_batch": "case when n % 7 = 0 then 'b' || (n % 2) end",
    "entry_path": "case when n % 3 = 0 then '/' || (n % 4) end",
    "landing_path": "case when n % 3 = 1 then repeat('l', cast(n % 400 as int)) end",
    "referrer_host": "case when n % 2 = 0 then 'h' || (n % 9) end",
    "admission_provider": "case when n % 6 = 0 then 'p' || (n % 2) end",
    "step": "case n % 5 when 0 then 'chapter' when 1 then 'atlas' when 2 then 'write' when 3 then 'copilot' end",
    "count": "case n % 4 when 0 then '0' when 1 then '3' when 2 then 'x' end",
    "success_count": "case n % 4 when 0 then '0' when 1 then '2' when 2 then '-1' end",
    "applied_count": "case when n % 3 = 0 then '4' end",
}


def log(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").withColumn("n", F.col("event_id") % 1009 * 7 + k)
    names = F.array(*[F.lit(n) for n in NAMES])
    meta = F.map_from_arrays(F.array(*[F.lit(m) for m in META]), F.array(*[F.expr(v) for v in META.values()]))
    project, named = F.when(F.col("n") % 9 > 0, F.col("n") % 2), F.element_at(names, (F.col("n") % len(NAMES) + 1).cast("int"))
    return rows.select("event_id", "user_id", named.alias("event"), project.alias("project_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), meta.alias("meta"))


def _last(key: str, event: str, name: str) -> str:
    return f"arg_max({key}, (created_at, event_id)) filter (event = '{event}' and {key} is not null) as {name}"


def _in(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_LOG = (
    f"with raw as (select event_id, user_id, [{_in(tuple(NAMES))}][cast(n % {len(NAMES)} + 1 as integer)] as event, case when n % 9 > 0 then n % 2 end as project_id, ts as created_at, "
    + ", ".join(f"nullif(substr(trim({v}), 1, 240), '') as {m}" for m, v in META.items())
    + " from (select *, event_id % 1009 * 7 + cast(json_extract_string(props, '$.k') as bigint) as n from events)), log as (select * replace (try_cast(count as bigint) as count, try_cast(success_count as bigint) as success_count, try_cast(applied_count as bigint) as applied_count) from raw)"
)
_SUMS = ", ".join(
    ["min(created_at) as first_seen_at", f"min(created_at) filter (event = '{P.START}') as started", f"min((created_at, event_id)) filter (event = '{P.GENERATION}') as begun", _last("source_surface", P.UPLOAD, "upload_source_surface")]
    + [_last(key, P.START, name) for name, key in (P.START_FIELDS | {a: "" + a for a in P.ATTRIBUTION}).items()]
    + [f"min(created_at) filter (event = '{e}') as {c}" for c, e in P.FIRSTS.items()]
    + [f"count(*) filter (event = '{e}') as {c}" for c, e in P.COUNTS.items()]
    + [f"count(*) filter (event = '{P.STEP}' and step = '{s}') as demo_guide_step_{s}_count" for s in P.STEPS]
    + [f"cast(coalesce(sum(greatest(1, coalesce(count, 1))) filter (event = '{e}'), 0) as bigint) as {c}" for c, e in P.DECIDED.items()]
    + [f"cast(coalesce(sum(greatest(0, case when success_count <> 0 then success_count when applied_count <> 0 then applied_count else 0 end)) filter (event = '{P.APPLY}'), 0) as bigint) as copilot_apply_count"]
    + [f"bool_or(event in ({_in(P.ACTIVATION)})) as world_model_activated", f"bool_or(event in ({_in(P.ACTIVATION + P.SUBMITTED)})) as world_onboarding_engaged"]
)
_PROFILES = (
    _LOG
    + f""", own as (select * from log where user_id is not null and project_id is not null), made as (select user_id, project_id, {_SUMS} from own group by all),
 val as (select user_id, project_id, min(o.created_at) as first_value_at from own o join made m using (user_id, project_id) where event = '{P.SAVE}' and (o.created_at, o.event_id) > begun group by all),
 sg as (select * from log where event = '{P.SIGNUP}' and user_id is not null qualify row_number() over (partition by user_id order by created_at, event_id) = 1),
 prof as (select m.* exclude (begun, started) replace ({", ".join(f"coalesce(m.{a}, sg.{a}) as {a}" for a in P.ATTRIBUTION)}, coalesce(m.project_start_mode, 'unknown') as project_start_mode), coalesce(started, first_seen_at) as project_start_at, first_value_at,
   first_value_at is not null as first_value_completed, demo_guide_completed_at is not null as demo_guide_completed, demo_guide_skipped_at is not null as demo_guide_skipped, world_onboarding_view_count > 0 as world_onboarding_viewed, world_onboarding_dismiss_count > 0 as world_onboarding_dismissed,
   world_model_view_count > 0 as world_model_viewed, copilot_open_count > 0 as copilot_opened, copilot_run_count > 0 as copilot_ran, copilot_apply_count > 0 as copilot_applied
   from made m left join val v on v.user_id = m.user_id and v.project_id = m.project_id left join sg on sg.user_id = m.user_id),
 dm as (select user_id, min(demo_guide_completed_at) as completed from prof where demo_guide_completed group by user_id), ad as (select prof.*, coalesce(project_start_mode = '{P.IMPORT_MODE}' and project_start_at >= completed, false) as after_demo from prof left join dm using (user_id)) """
)


@query(_PROFILES + "select * from prof")
def project_profiles(spark: SparkSession, d: str) -> DataFrame:
    return P.profiles(log(spark, d))


_FLAGS = {
    "generated": "generation_count > 0", "first_value": "first_value_completed", "world_onboarding_view": "world_onboarding_viewed", "world_onboarding_engaged": "world_onboarding_engaged", "world_generate_submit": "world_generate_submit_count > 0",
    "world_generate_success": "world_generate_count > 0", "worldpack_import": "worldpack_import_count > 0", "bootstrap_trigger": "bootstrap_trigger_count > 0", "bootstrap_run": "bootstrap_run_count > 0", "demo_guide_completed": "demo_guide_completed",
    "demo_guide_skipped": "demo_guide_skipped", "world_model_view": "world_model_viewed", "world_model_activated": "world_model_activated", "copilot_open": "copilot_opened", "copilot_run": "copilot_ran", "copilot_apply": "copilot_applied",
}


@query(_PROFILES + f"""select coalesce(channel, 'unknown') as channel, coalesce(invite_batch, 'unknown') as invite_batch, coalesce(entry_path, 'unknown') as entry_path, project_start_mode, count(*) as projects, count(distinct user_id) as users,
 {", ".join(f"count(*) filter ({c}) as {n}_projects" for n, c in _FLAGS.items())} from prof group by 1, 2, 3, 4""")
def profile_segments(spark: SparkSession, d: str) -> DataFrame:
    return P.segments(P.profiles(log(spark, d)))


_METRICS = {c: c for c in ("first_value_completed", "world_onboarding_engaged", "world_model_activated", "demo_guide_completed", "copilot_applied")} | {"copilot_discovered": "copilot_opened", "uploaded_own_novel_after_demo_guide": "after_demo"}


@query(_PROFILES + "select metric, count(*) filter (holds) as projects, count(distinct user_id) filter (holds) as users from (" + " union all ".join(f"select user_id, '{m}' as metric, {c} as holds from ad" for m, c in _METRICS.items()) + ") group by metric")
def profile_metrics(spark: SparkSession, d: str) -> DataFrame:
    return P.derived_metrics(P.profiles(log(spark, d)))


@query(_PROFILES + f"""select 'demo_guide_to_upload_click' as metric, count(distinct user_id) as users, count(*) as n from log join dm using (user_id) where event = '{P.CLICK}' and created_at >= completed
 union all select 'demo_guide_to_chapter_import', count(distinct user_id), count(*) from ad where after_demo""")
def after_demo(spark: SparkSession, d: str) -> DataFrame:
    events = log(spark, d)
    return P.after_demo(events, P.profiles(events))

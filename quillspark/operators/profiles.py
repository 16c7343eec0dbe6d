"""A profile of each project from the event log: how it began, who brought it, what was done with it, and summaries of profiles.

Events are as in analytics, with a map of texts as meta. Sums, counts and firsts are merged
map-side; only saves meet their project once more, for the first one after a generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import analytics as A

# Names of events and of meta keys in the log.
START, UPLOAD, SIGNUP, GENERATION, SAVE, APPLY, STEP, CLICK = "project_start", "novel_upload", "signup", "generation", "chapter_save", "copilot_apply", "demo_guide_step_complete", "upload_cta_click"
START_FIELDS = {"project_start_mode": "start_mode", "project_start_entry_action": "entry_action", "project_start_source_surface": "source_surface"}
ATTRIBUTION = ("channel", "invite_batch", "entry_path", "landing_path", "referrer_host", "admission_provider")
STEPS = ("chapter", "atlas", "write", "copilot")
COUNTS = {
    "world_onboarding_view_count": "world_onboarding_view",
    "world_onboarding_dismiss_count": "world_onboarding_dismissed",
    "world_generate_open_count": "world_generate_open",
    "world_generate_submit_count": "world_generate_submit",
    "world_generate_failed_count": "world_generate_failed",
    "worldpack_import_submit_count": "worldpack_import_submit",
    "worldpack_import_failed_count": "worldpack_import_failed",
    "bootstrap_trigger_count": "bootstrap_trigger",
    "bootstrap_failed_count": "bootstrap_failed",
    "demo_guide_view_count": "demo_guide_view",
    "demo_guide_step_count": STEP,
    "world_model_view_count": "world_model_view",
    "bootstrap_run_count": "bootstrap_run",
    "world_generate_count": "world_generate",
    "worldpack_import_count": "worldpack_import",
    "world_edit_count": "world_edit",
    "copilot_open_count": "copilot_open",
    "copilot_run_count": "copilot_run",
    "generation_count": GENERATION,
    "chapter_save_count": SAVE,
}
DECIDED = {"draft_confirm_count": "draft_confirm", "draft_reject_count": "draft_reject"}
FIRSTS = {"first_generation_at": GENERATION, "demo_guide_completed_at": "demo_guide_completed", "demo_guide_skipped_at": "demo_guide_skipped"}
ACTIVATION = ("bootstrap_run", "world_generate", "worldpack_import", "draft_confirm", "draft_reject", "world_edit")
SUBMITTED = ("world_generate_submit", "worldpack_import_submit", "bootstrap_trigger")
IMPORT_MODE = "chapter_import"

KEY = ["user_id", "project_id"]


def profiles(events: DataFrame) -> DataFrame:
    """A row for each (user_id, project_id), neither null.

    Start fields and attribution are the last that a start event gives; attribution falls back to
    the user's first signup. project_start_at is the first start or else the first event, the mode
    unknown where no start names one. A decision on drafts counts as at least one; an application
    as its successes, or those applied. first_value_at is the first save after the first generation
    in the order of the log. Meta values are trimmed, cut and null if blank. Rows that repeat an
    event count again.
    """
    rows = events.withColumn("meta", A.normalise_meta(F.col("meta")))
    own, event, meta = rows.filter("user_id is not null and project_id is not null"), F.col("event"), F.col("meta")
    last = lambda key, name: F.max_by(meta[key], F.when((event == name) & meta[key].isNotNull(), A.order()))
    number = lambda key: F.nullif(A.meta_int(meta[key]), F.lit(0))
    done = F.greatest(F.lit(0), F.coalesce(number("success_count"), number("applied_count"), F.lit(0)))
    decided = F.greatest(F.lit(1), F.coalesce(A.meta_int(meta["count"]), F.lit(1)))
    zero = F.lit(0).cast("long")
    aggregates = [
        F.min("created_at").alias("first_seen_at"),
        F.min(F.when(event == START, F.col("created_at"))).alias("started"),
        *[last(key, START).alias(name) for name, key in (START_FIELDS | {a: a for a in ATTRIBUTION}).items()],
        last("source_surface", UPLOAD).alias("upload_source_surface"),
        F.min(F.when(event == GENERATION, A.order())).alias("begun"),
        *[F.min(F.when(event == name, F.col("created_at"))).alias(c) for c, name in FIRSTS.items()],
        *[F.count_if(event == name).alias(c) for c, name in COUNTS.items()],
        *[F.count_if((event == STEP) & (meta["step"] == s)).alias(f"demo_guide_step_{s}_count") for s in STEPS],
        *[F.coalesce(F.sum(F.when(event == name, decided)), zero).alias(c) for c, name in DECIDED.items()],
        F.coalesce(F.sum(F.when(event == APPLY, done)), zero).alias("copilot_apply_count"),
        F.coalesce(F.bool_or(event.isin(*ACTIVATION)), F.lit(False)).alias("world_model_activated"),
        F.coalesce(F.bool_or(event.isin(*ACTIVATION, *SUBMITTED)), F.lit(False)).alias("world_onboarding_engaged"),
    ]
    made = own.groupBy(KEY).agg(*aggregates)
    saves = own.filter(event == SAVE).select(*KEY, "created_at", "event_id").join(made.filter("begun is not null").select(*KEY, "begun"), KEY)
    value = saves.filter(A.order() > F.col("begun")).groupBy(KEY).agg(F.min("created_at").alias("first_value_at"))
    signups = A.signup_attribution(rows.filter("user_id is not null"), SIGNUP, ATTRIBUTION).select("user_id", F.struct(*ATTRIBUTION).alias("signup"))
    out = made.drop("begun").join(value, KEY, "left").join(signups, "user_id", "left")
    known = {a: F.coalesce(a, F.col("signup")[a]) for a in ATTRIBUTION}
    flags = {"world_onboarding_viewed": "world_onboarding_view_count", "world_onboarding_dismissed": "world_onboarding_dismiss_count", "world_model_viewed": "world_model_view_count", "copilot_opened": "copilot_open_count", "copilot_ran": "copilot_run_count", "copilot_applied": "copilot_apply_count"}
    more = {"project_start_at": F.coalesce("started", "first_seen_at"), "project_start_mode": F.coalesce("project_start_mode", F.lit("unknown")), "first_value_completed": F.col("first_value_at").isNotNull()}
    ended = {c.removesuffix("_at"): F.col(c).isNotNull() for c in ("demo_guide_completed_at", "demo_guide_skipped_at")}
    return out.withColumns(known | more | ended | {f: F.col(c) > 0 for f, c in flags.items()}).drop("signup", "started")


def segments(projects: DataFrame) -> DataFrame:
    """Projects of each channel, batch, entry path and start mode, unknown if null, and how many did what."""
    more = lambda c: F.col(c) > 0
    flags: dict[str, Column] = {
        "generated_projects": more("generation_count"),
        "first_value_projects": F.col("first_value_completed"),
        "world_onboarding_view_projects": F.col("world_onboarding_viewed"),
        "world_onboarding_engaged_projects": F.col("world_onboarding_engaged"),
        "world_generate_submit_projects": more("world_generate_submit_count"),
        "world_generate_success_projects": more("world_generate_count"),
        "worldpack_import_projects": more("worldpack_import_count"),
        "bootstrap_trigger_projects": more("bootstrap_trigger_count"),
        "bootstrap_run_projects": more("bootstrap_run_count"),
        "demo_guide_completed_projects": F.col("demo_guide_completed"),
        "demo_guide_skipped_projects": F.col("demo_guide_skipped"),
        "world_model_view_projects": F.col("world_model_viewed"),
        "world_model_activated_projects": F.col("world_model_activated"),
        "copilot_open_projects": F.col("copilot_opened"),
        "copilot_run_projects": F.col("copilot_ran"),
        "copilot_apply_projects": F.col("copilot_applied"),
    }
    return A.segment_summary(projects, ["channel", "invite_batch", "entry_path", "project_start_mode"], flags)


def _after_demo(projects: DataFrame) -> DataFrame:
    """Projects with after_demo: an import that began at or after the user's first completed demo."""
    first = projects.groupBy("user_id").agg(F.min("demo_guide_completed_at").alias("completed")).filter("completed is not null")
    after = (F.col("project_start_mode") == IMPORT_MODE) & (F.col("project_start_at") >= F.col("completed"))
    return projects.join(first, "user_id", "left").withColumn("after_demo", F.coalesce(after, F.lit(False)))


def derived_metrics(projects: DataFrame) -> DataFrame:
    """(metric, projects, users) of seven named sets of profiles."""
    named = {c: F.col(c) for c in ("first_value_completed", "world_onboarding_engaged", "world_model_activated", "demo_guide_completed", "copilot_applied")}
    return A.metrics(_after_demo(projects), named | {"copilot_discovered": F.col("copilot_opened"), "uploaded_own_novel_after_demo_guide": F.col("after_demo")})


def after_demo(events: DataFrame, projects: DataFrame) -> DataFrame:
    """(metric, users, n): clicks on upload, and imports, at or after the first demo that the user completed in any project."""
    first = projects.groupBy("user_id").agg(F.min("demo_guide_completed_at").alias("completed")).filter("completed is not null")
    clicks = events.filter(F.col("event") == CLICK).select("user_id", "created_at").join(first, "user_id").filter("created_at >= completed")
    imports = _after_demo(projects).filter("after_demo")
    one = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))
    return one(clicks, "demo_guide_to_upload_click").unionByName(one(imports, "demo_guide_to_chapter_import"))

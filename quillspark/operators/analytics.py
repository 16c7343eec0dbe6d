"""Product analytics over an event log (event_id, user_id, event, project_id, created_at, meta) and ledgers.

Order of events is (created_at, event_id) throughout. Every operator is one or two shuffles on
user, project or event, with partial aggregation; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def order() -> Column:
    """Where an event stands in the log."""
    return F.struct("created_at", "event_id")


META_CHARS = 240


def normalise_meta(meta: Column) -> Column:
    """A map's values trimmed, cut to META_CHARS, null if blank."""
    return F.transform_values(meta, lambda _, v: F.when(F.trim(v) != "", F.substring(F.trim(v), 1, META_CHARS)))


def meta_int(value: Column) -> Column:
    """An integer from text that holds a whole number, 3 or 3.0; null otherwise."""
    return F.when(value.rlike(r"^\s*-?\d+(\.0+)?\s*$"), F.regexp_extract(value, r"(-?\d+)", 1).cast("long"))


def funnel_summary(events: DataFrame) -> DataFrame:
    """For each event: how many, of how many users, anonymous visitors and projects."""
    return events.groupBy("event").agg(
        F.count("*").alias("total"), F.count_distinct("user_id").alias("users"), F.count_distinct("anonymous_id").alias("visitors"), F.count_distinct(F.struct("user_id", "project_id")).alias("projects")
    )


def trusted_events(events: DataFrame, owned: DataFrame, trusting: Sequence[str]) -> DataFrame:
    """Events without project, and those of projects (user_id, project_id) that are owned or have an event of trusting."""
    keys = owned.select("user_id", "project_id").union(events.filter(F.col("event").isin(*trusting)).select("user_id", "project_id")).distinct()
    return events.filter("project_id is null").unionByName(events.filter("project_id is not null").join(keys, ["user_id", "project_id"], "left_semi"))


def signup_attribution(events: DataFrame, signup: str, keys: Sequence[str]) -> DataFrame:
    """For each user the meta values of the first signup."""
    first = events.filter(F.col("event") == signup).groupBy("user_id").agg(F.min_by("meta", order()).alias("m"), F.min("created_at").alias("signup_at"))
    return first.select("user_id", "signup_at", *[F.col("m")[k].alias(k) for k in keys])


def project_rollup(events: DataFrame, counts: Mapping[str, str], start: str, generation: str, save: str) -> DataFrame:
    """A row for each (user, project): n_<name> and first_<name>_at for the events in counts, the last start mode, and the first value.

    first_value_at is the first save that comes after the first generation, ties by event_id;
    start_at is the first start or, without one, the first event, start_mode the last non-null.
    """
    by_key = Window.partitionBy("user_id", "project_id")
    begun = F.min(F.when(F.col("event") == generation, order())).over(by_key)
    rows = events.filter("project_id is not null").withColumn("begun", begun)
    value = F.min(F.when((F.col("event") == save) & (order() > F.col("begun")), F.col("created_at")))
    aggregates = [x for name, event in counts.items() for x in (F.count_if(F.col("event") == event).alias(f"n_{name}"), F.min(F.when(F.col("event") == event, F.col("created_at"))).alias(f"first_{name}_at"))]
    mode = F.max_by(F.col("meta")["mode"], F.when((F.col("event") == start) & F.col("meta")["mode"].isNotNull(), order()))
    started = F.min(F.when(F.col("event") == start, F.col("created_at")))
    return rows.groupBy("user_id", "project_id").agg(
        F.count("*").alias("n_events"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"), F.coalesce(started, F.min("created_at")).alias("start_at"), F.coalesce(mode, F.lit("unknown")).alias("start_mode"), value.alias("first_value_at"), *aggregates
    )


def segment_summary(projects: DataFrame, by: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Projects, users and conditional counts for each segment, with unknown for a missing value."""
    filled = projects.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in by})
    return filled.groupBy(*by).agg(F.count("*").alias("projects"), F.count_distinct("user_id").alias("users"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def metrics(projects: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """(metric, projects, users) for each named filter, in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(c, F.lit(False)).alias("holds")) for k, c in named.items()])
    rows = projects.select("user_id", F.explode(pairs).alias("m"))
    return rows.groupBy("m.metric").agg(F.count_if("m.holds").alias("projects"), F.count_distinct(F.when(F.col("m.holds"), F.col("user_id"))).alias("users"))


def daily_counts(events: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Events by name and day over the days up to now."""
    recent = events.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("event", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


def after_first(events: DataFrame, completed: str, later: Sequence[str]) -> DataFrame:
    """For each user that completed: the first time, and how many later events of each name came at or after it."""
    first = events.filter(F.col("event") == completed).groupBy("user_id").agg(F.min("created_at").alias("completed_at"))
    joined = first.join(events.select("user_id", "event", "created_at"), "user_id", "left")
    counts = [F.count_if((F.col("event") == e) & (F.col("created_at") >= F.col("completed_at"))).alias(f"n_{e}") for e in later]
    return joined.groupBy("user_id", "completed_at").agg(*counts)


def recent(events: DataFrame, limit: int = 100) -> DataFrame:
    """The last events, in order: a top-k, not a sort of the log."""
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)


def missing_starts(events: DataFrame, start: str) -> DataFrame:
    """The first event of each project that never started, as the start to add."""
    first = events.filter("project_id is not null").groupBy("user_id", "project_id").agg(F.min(order()).alias("o"))
    started = events.filter(F.col("event") == start).select("user_id", "project_id").distinct()
    return first.join(started, ["user_id", "project_id"], "left_anti").select("user_id", "project_id", F.lit(start).alias("event"), F.col("o.created_at").alias("created_at"))


def transitions(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """How often each (before, after) of a user's successive events occurs, and whether allowed has it."""
    order = Window.partitionBy("user_id").orderBy("created_at", "event_id")
    steps = events.select("user_id", F.lag("event").over(order).alias("before"), F.col("event").alias("after")).filter("before is not null")
    counts = steps.groupBy("before", "after").agg(F.count("*").alias("n"))
    return counts.join(allowed.distinct().withColumn("is_allowed", F.lit(True)), ["before", "after"], "left").withColumn("is_allowed", F.coalesce("is_allowed", F.lit(False)))


def usage_summary(usage: DataFrame) -> DataFrame:
    """Requests, tokens and cost in total, by model and by node (null: unknown), from one scan."""
    rows = usage.select("model", F.coalesce("node", F.lit("unknown")).alias("node"), "tokens", "cost")
    grouped = rows.groupingSets([[], ["model"], ["node"]], "model", "node")
    return grouped.agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.grouping_id().alias("gid")).select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "model").otherwise("node").alias("kind"), F.coalesce("model", "node", F.lit("")).alias("name"), "requests", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce("cost", F.lit(0.0)), 2).alias("cost")
    )


def spend_guard(usage: DataFrame, limit: float) -> DataFrame:
    """The hosted cost so far, and whether it has come to the limit."""
    return usage.filter(F.col("billing") == "hosted").agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("spent")).withColumn("blocked", F.col("spent") >= limit)


def quota_refunds(reservations: DataFrame, live_lease: str) -> DataFrame:
    """For each user what open reservations of other leases give back: the reserved beyond the charged."""
    lost = reservations.filter("released_at is null").filter(F.col("lease") != live_lease)
    return lost.groupBy("user_id").agg(F.count("*").alias("reservations"), F.sum(F.greatest(F.lit(0), F.col("reserved") - F.col("charged"))).alias("refund"))


def quota_violations(reservations: DataFrame) -> DataFrame:
    """Reservations that break 0 <= charged <= reserved."""
    return reservations.filter("charged < 0 or charged > reserved")


def dashboard(chapters: DataFrame, k: int) -> DataFrame:
    """The last k chapters of each novel in ascending order, with their lengths and the novel's number of chapters."""
    novel = Window.partitionBy("novel_id")
    rows = chapters.select("novel_id", "chapter_number", F.length("content").cast("long").alias("chars"), F.count("*").over(novel).alias("chapters"), F.row_number().over(novel.orderBy(F.desc("chapter_number"))).alias("r"))
    return rows.filter(F.col("r") <= k).drop("r")


def queue_health(jobs: DataFrame, now: Column, stalled_s: int) -> DataFrame:
    """For each kind of queued job: how many, the oldest's age in seconds, whether it is stalled."""
    age = F.max(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp")))
    return jobs.filter("status = 'queued'").groupBy("kind").agg(F.count("*").alias("queued"), age.alias("oldest_s")).withColumn("stalled", F.col("oldest_s") >= stalled_s)


def stale_jobs(jobs: DataFrame, now: Column, idle_s: int) -> DataFrame:
    """Running jobs whose lease is over, or that have none and were not touched for idle_s."""
    idle = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))) >= idle_s
    return jobs.filter("status = 'running'").filter(F.when(F.col("lease_expires_at").isNotNull(), F.col("lease_expires_at") <= now).otherwise(idle))


def next_deferred(candidates: DataFrame, active: DataFrame) -> DataFrame:
    """The one candidate to run next: oldest (ready_at, id) whose novel has no active job."""
    return candidates.join(active.select("novel_id").distinct(), "novel_id", "left_anti").orderBy("ready_at", "id").limit(1)


def profile(measures: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Average, exact median and maximum of a measure by stage."""
    v = F.col(value).cast("double")
    return measures.groupBy(*by).agg(F.round(F.avg(v), 6).alias("avg"), F.percentile(v, 0.5).alias("p50"), F.max(v).alias("max"))


def feedback_bonus(text: Column, base: int = 10, bonus: int = 5) -> Column:
    """base, and bonus for text of at least 20 non-blank characters, 6 of them different."""
    chars = F.split(F.regexp_replace(text, r"\s+", ""), "")
    return F.lit(base) + F.when((F.size(chars) >= 20) & (F.size(F.array_distinct(chars)) >= 6), bonus).otherwise(0)

"""Repairs of stored tables: duplicates repointed and removed, second active runs interrupted, columns back-filled by what other tables hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survivors(rows: DataFrame, by: Sequence[str], order: Sequence[Column], key: str = "id") -> DataFrame:
    """(key, keeper): for each row the one of its group that stays, the first in order, then of greatest key; nulls in by are a group of their own."""
    best = Window.partitionBy(*by).orderBy(*order, F.desc(key))
    return rows.select(key, F.first(key).over(best).alias("keeper"))


def repointed(rows: DataFrame, keepers: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Rows whose foreign key follows the survivor; keys that no row has, and null, stay as they are."""
    links = keepers.filter(F.col(key) != F.col("keeper")).select(F.col(key).alias(foreign), "keeper")
    return rows.join(links, foreign, "left").withColumn(foreign, F.coalesce("keeper", foreign)).drop("keeper")


def merged_sessions(sessions: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions (id, novel_id, user_id, signature, last_active_at, created_at) without duplicates, the last active one staying, and runs (…, session_id) of what stays.

    Runs are repointed before a session goes, so none is left without one.
    """
    keepers = survivors(sessions, ["novel_id", "user_id", "signature"], [F.coalesce("last_active_at", "created_at").desc_nulls_last()])
    kept = sessions.join(keepers.filter("id = keeper").select("id"), "id", "left_semi")
    return kept, repointed(runs, keepers, "session_id")


def one_active(runs: DataFrame, now: Column, error: str) -> DataFrame:
    """Runs of which each session keeps one active: running before queued, then the latest, then the greatest id; the others are interrupted, without lease."""
    active = F.col("status").isin("queued", "running")
    order = Window.partitionBy("session_id", active).orderBy((F.col("status") != "running").cast("int"), F.coalesce("started_at", "created_at").desc_nulls_last(), F.desc("id"))
    extra = F.coalesce(active & F.col("session_id").isNotNull() & (F.col("nth") > 1), F.lit(False))
    put = lambda c, v: F.when(F.col("extra"), v).otherwise(F.col(c)).alias(c)
    rows = runs.withColumn("nth", F.row_number().over(order)).withColumn("extra", extra)
    changed = {"status": F.lit("interrupted"), "error": F.lit(error), "lease_owner": F.lit(None).cast("string"), "finished_at": now}
    return rows.select(*[put(c, changed[c]) if c in changed else c for c in runs.columns])


def back_filled(novels: DataFrame, chapters: DataFrame) -> DataFrame:
    """Novels with index_status, index_revision, built_revision and index_error: fresh or missing by whether they have an index, revision 1 if any chapter exists.

    The existence test is a semi-join's flag on distinct keys, so a novel of very many chapters is one row of it.
    """
    has = chapters.select("novel_id").filter("novel_id is not null").distinct().withColumn("has", F.lit(True))
    rows = novels.join(has.withColumnRenamed("novel_id", "id"), "id", "left")
    built = F.col("has_index")
    new = {"index_status": F.when(built, "fresh").otherwise("missing"), "index_revision": F.when(F.col("has"), 1).otherwise(0), "built_revision": F.when(built, 1), "index_error": F.lit(None).cast("string")}
    return rows.withColumns(new).drop("has")


def first_inserted(given: DataFrame, stored: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Given rows that stored lacks, of equal keys the first in order: an insert that ignores conflicts."""
    once = Window.partitionBy(*key).orderBy(*order)
    return given.withColumn("r", F.row_number().over(once)).filter("r = 1").drop("r").join(stored.select(*key).distinct(), list(key), "left_anti")

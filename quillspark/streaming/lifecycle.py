"""The life of derived assets, such as an index: revisions asked for, claimed, built and failed, as a report and as a keyed stream.

All that a job's state needs of its events are maxima over revisions: the highest one asked for
coalesces all requests below it, and a result of a lower revision than one already there, or asked
for since, changes nothing or leaves the job open. So replayed and reordered events end in the same
state, and the stream's state is a few numbers a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What happens to a job; a request also raises the target, as do later events for a revision never asked for.
OPERATIONS = ("enqueue", "claim", "success", "failure")
_MARKS = "target long, claimed long, completed long, failed long, error string"


def status(target, claimed, completed, failed):
    """completed, failed, running or queued; the last result counts only if it is of the revision that is asked for."""
    return F.when(completed >= target, "completed").when(failed >= target, "failed").when((claimed >= target) & (claimed > completed) & (claimed > failed), "running").otherwise("queued")


def state_of(events: DataFrame, by: str) -> DataFrame:
    """(by, target, claimed, completed, failed, status, error) from events (by, operation, revision, error); 0 where there was none.

    A claim, success or failure counts once its revision is positive; of failures of the highest
    revision the greatest message is kept, and only while the job has failed. Null operations and revisions change nothing.
    """
    top = lambda *ops: F.coalesce(F.max(F.when(F.col("operation").isin(*ops) & (F.col("revision") > 0), F.col("revision"))), F.lit(0)).cast("long")
    error = F.max(F.when((F.col("operation") == "failure") & (F.col("revision") > 0), F.struct("revision", F.coalesce("error", F.lit("")).alias("error"))))["error"]
    marks = events.filter(F.col("operation").isin(*OPERATIONS)).groupBy(by).agg(top(*OPERATIONS).alias("target"), top("claim").alias("claimed"), top("success").alias("completed"), top("failure").alias("failed"), error.alias("error"))
    return _reported(marks, by)


def _reported(marks: DataFrame, by: str) -> DataFrame:
    rows = marks.withColumn("status", status(*[F.col(c) for c in ("target", "claimed", "completed", "failed")]))
    return rows.select(by, "target", "claimed", "completed", "failed", "status", F.when(F.col("status") == "failed", F.col("error")).alias("error"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    target, claimed, completed, failed, error, version = state.get if state.exists else (0, 0, 0, 0, "", 0)
    top = {"claim": claimed, "success": completed, "failure": failed}
    for rows in batches:
        rows = rows[rows["operation"].isin(OPERATIONS) & (rows["revision"] > 0)]
        if not len(rows):
            continue
        target = max(target, int(rows["revision"].max()))
        for operation, revisions in rows.groupby("operation")["revision"]:
            best = int(revisions.max())
            if operation == "failure":
                said = rows[(rows["operation"] == "failure") & (rows["revision"] == best)]["error"].fillna("").max()
                error = said if best > failed else max(error, said) if best == failed else error
                failed = max(failed, best)
            elif operation in top:
                top[operation] = max(top[operation], best)
    new = (target, top["claim"], top["success"], failed, error, version + 1)
    state.update(new)
    yield pd.DataFrame([(*key, *new)], columns=["key", "target", "claimed", "completed", "failed", "error", "version"])


def advanced(events: DataFrame, by: str) -> DataFrame:
    """A stream of (key, target, claimed, completed, failed, error, version): each touched key's marks after each micro-batch."""
    rows = events.select(F.col(by).alias("key"), "operation", "revision", "error")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(_advance, f"key {kind}, {_MARKS}, version long", f"{_MARKS}, version long", "update", GroupStateTimeout.NoTimeout)


def keep_updates(path: str):
    """A handler that writes each micro-batch's marks under its number; repeating a batch changes nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def latest_states(updates: DataFrame, by: str) -> DataFrame:
    """The state of each key, as state_of gives it, from the updates written."""
    marks = [c.split(" ")[0] for c in _MARKS.split(", ")]
    last = updates.groupBy("key").agg(F.max_by(F.struct(*marks), "version").alias("s")).select(F.col("key").alias(by), "s.*")
    return _reported(last, by)

"""A session with the settings that the library's queries assume."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for any cluster; sizes of shuffles are left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "corpus", **more: str) -> SparkSession:
    """A session with SETTINGS; more overrides them, with _ for the dots of a name."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str):
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and read again from the folder of spark.checkpoint.dir, which driver and executors share; a local session without one gets a temporary folder, on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if given is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()


def recursive(sql: str, **frames: DataFrame) -> DataFrame:
    """The result of a recursive query over frames, named in braces. The session's limits on its rows and levels are lifted, as both grow with the data."""
    spark = next(iter(frames.values())).sparkSession
    for limit in ("RowLimit", "LevelLimit"):
        spark.conf.set(f"spark.sql.cteRecursion{limit}", "-1")
    return spark.sql(sql, **frames)

"""Text files whose encoding is not known, read whole as rows; and writers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Encodings in the order in which they are tried (fixed values).
ENCODINGS = ("utf-8", "gb18030", "gbk", "gb2312", "utf-16")
MOST_BYTES = 30 * 1024 * 1024


def decode(data: bytes, encodings: Sequence[str] = ENCODINGS) -> tuple[str | None, str | None]:
    """The text and the first encoding that decodes data; nulls if none does."""
    for name in encodings:
        try:
            return data.decode(name), name
        except (UnicodeDecodeError, UnicodeError):
            continue
    return None, None


def read_texts(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, suffix: str = "*.txt") -> DataFrame:
    """(path, bytes, encoding, text) of the files at path; text is null if no encoding fits, files beyond most_bytes, and empty ones, are left out by the scan."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).filter(F.col("length") <= most_bytes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [decode(b) for b in f["content"]]
            yield pd.DataFrame({"path": f["path"], "bytes": f["length"], "encoding": [e for _, e in done], "text": [t for t, _ in done]})

    return rows.select("path", "length", "content").mapInPandas(run, "path string, bytes long, encoding string, text string")


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON documents of a declared schema; a document that does not fit is a reject with its text.

    Files are read once as text, so the rejects need no cached parse.
    """
    texts = spark.read.text(path, wholetext=True)
    parsed = texts.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"))
    broken = F.col("row").isNull() | ~F.coalesce(F.is_valid_utf8("value"), F.lit(False)) | F.expr("try_parse_json(value) is null")
    return parsed.filter(~broken).select("row.*"), parsed.filter(broken).select("value")


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes df by partition, replacing only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def split_valid(events: DataFrame, names: Sequence[str], needs_project: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Events to take and to reject: the name must be known, and a project given exactly if the event needs one."""
    fine = F.col("event").isin(*names) & (F.col("event").isin(*needs_project) == F.col("project_id").isNotNull()) & (F.col("user_id").isNotNull() | F.col("anonymous_id").isNotNull())
    fine = F.coalesce(fine, F.lit(False))
    return events.filter(fine), events.filter(~fine)

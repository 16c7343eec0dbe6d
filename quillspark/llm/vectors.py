"""Vectors as Spark rows: which take part, and blocks of queries that meet blocks of data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of data, and of queries, that meet in one task.
DATA_ROWS, QUERY_ROWS = 8192, 4096


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose id and vector are not null and whose components are finite (nonzero: not all 0)."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    if nonzero:
        fine &= F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def dimension(rows: DataFrame) -> int | None:
    """The vectors' length; None without rows. Rows of several lengths are an error."""
    got = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if got[0] != got[1]:
        raise ValueError(f"vectors of {got[0]} to {got[1]} components")
    return got[0]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def table_of(batches: list[pa.RecordBatch] | pa.Table) -> pa.Table:
    return batches if isinstance(batches, pa.Table) else pa.Table.from_batches(batches)


def in_blocks(key: list[str], count: int, rows: int, by: Column) -> Column:
    """A number from 0 on for blocks of about rows of count rows, dealt by a hash."""
    return F.pmod(by, F.lit(max(1, -(-count // rows)))).cast("int")


def queries_of(rows: DataFrame) -> DataFrame:
    """Query rows with a mark of their vector, each once: id and mark tell queries apart that share an id."""
    return rows.distinct().withColumn("mark", F.xxhash64("v"))


def best(df: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query (query_id, mark), ties to the smaller vec_id: (query_id, rank, vec_id, score)."""
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores the columns of the k highest, ties to the smaller id; -inf is no candidate."""
    n = scores.shape[1]
    for row in range(len(scores)):
        s = scores[row]
        if n > k:
            least = np.partition(s, n - k)[n - k]
            at = np.flatnonzero(s >= least)
        else:
            at = np.arange(n)
        at = at[s[at] > -np.inf]
        yield row, at[np.lexsort((ids[at], -s[at]))][:k]


Local = Callable[[pa.Table, pa.Table], pa.Table]

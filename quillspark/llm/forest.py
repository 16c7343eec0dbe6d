"""Approximate nearest neighbours by cosine: a forest of sorted hash strings.

Every row is indexed, in shards of bounded size. A shard has several trees: sorted arrays of the
rows' long hash strings (signs of random projections). A query descends each tree to the longest
prefix it shares with any row, then ascends all trees at once, one bit at a time, taking in the
rows under each shorter prefix until it has enough candidates, which are scored exactly.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import DATA_ROWS, QUERY_ROWS, best, dimension, matrix, queries_of, top_of, usable

TREES, BITS, SEED = 16, 60, 7
#: A query's ascent ends when its candidates in a shard are at least that share of the shard's rows.
SHARE = 0.6


@cache
def planes(dim: int, trees: int, bits: int, seed: int) -> np.ndarray:
    """The random projections, alike on every executor."""
    return np.random.default_rng(seed).standard_normal((dim, trees * bits))


def hash_strings(x: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """(tree, row): the signs of a tree's projections as bits of an integer, the first at the top."""
    sign = (x @ planes(x.shape[1], trees, bits, seed) >= 0).reshape(len(x), trees, bits)
    return (sign @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).T


class Forest:
    """The sorted hash strings of one shard's rows."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.trees, self.bits, self.seed = trees, bits, seed
        strings = hash_strings(x, trees, bits, seed)
        self.order = np.argsort(strings, 1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the rows met when at least enough are found, or all trees' roots are reached."""
        strings = hash_strings(queries, self.trees, self.bits, self.seed)
        n = self.sorted.shape[1]
        # The span of rows under each prefix length, for all queries and trees at once.
        spans = np.empty((self.bits + 1, 2, self.trees, len(queries)), np.int32)
        for cutoff in range(self.bits + 1):
            low = (strings >> cutoff) << cutoff
            for t in range(self.trees):
                spans[cutoff, 0, t] = np.searchsorted(self.sorted[t], low[t])
                spans[cutoff, 1, t] = np.searchsorted(self.sorted[t], low[t] + (1 << cutoff))
        for q in range(len(queries)):
            seen = np.zeros(n, bool)
            width = spans[:, 1, :, q] - spans[:, 0, :, q]
            # Descent: the longest matches of the trees; nothing is met below the longest of all.
            cutoff = int(np.argmax(width.max(1) > 0))
            before = None
            while True:
                for t in range(self.trees):
                    lo, hi = spans[cutoff, :, t, q]
                    if before is None:
                        seen[self.order[t, lo:hi]] = True
                    else:  # only what the shorter prefix adds
                        a, b = spans[before, :, t, q]
                        if lo < a or a == b:
                            seen[self.order[t, lo : a if a < b else hi]] = True
                        if a < b < hi:
                            seen[self.order[t, b:hi]] = True
                if cutoff == self.bits or int(seen.sum()) >= enough:
                    break
                before, cutoff = cutoff, cutoff + 1
            yield np.flatnonzero(seen)


def _searched(k: int, share: float, trees: int, bits: int, seed: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(data):
            queries, data = queries.combine_chunks(), data.combine_chunks()
            x, ids = matrix(data.column("v").chunk(0)), data.column("vec_id").to_numpy()
            q, own = matrix(queries.column("v").chunk(0)), queries.column("vec_id").to_numpy()
            norm, q_norm = np.sqrt((x**2).sum(1)), np.sqrt((q**2).sum(1))
            # Scaled first, so that squares neither overflow nor vanish.
            unit = x / np.abs(x).max(1, keepdims=True)
            unit /= np.sqrt((unit**2).sum(1, keepdims=True))
            q_unit = q / np.abs(q).max(1, keepdims=True)
            q_unit /= np.sqrt((q_unit**2).sum(1, keepdims=True))
            forest = Forest(unit, trees, bits, seed)
            enough = max(4 * (k + 1), int(share * len(x)))
            for at in range(0, len(q), 256):
                for row, near in enumerate(forest.candidates(q_unit[at : at + 256], enough), at):
                    near = near[ids[near] != own[row]]
                    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                        score = (x[near] * q[row]).sum(1) / (norm[near] * q_norm[row])
                    rough = ~np.isfinite(score)
                    score[rough] = (unit[near][rough] * q_unit[row]).sum(1)
                    for _, cols in top_of(score[None, :], ids[near], k):
                        found.append((np.full(len(cols), row), ids[near][cols], score[cols]))
        parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0), np.empty(0), np.empty(0)]
        row = pa.array(parts[0].astype(np.int64))
        names = [queries.column(c).take(row) if found else row for c in ("vec_id", "mark")]
        return pa.table([*names, pa.array(parts[1].astype(np.int64)), pa.array(parts[2].astype(np.float64))], names=["query_id", "mark", "vec_id", "score"])

    return run


def search(queries: DataFrame, data: DataFrame, k: int = 5, share: float = SHARE, trees: int = TREES, bits: int = BITS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest found by cosine, its own id excepted.

    score is the cosine of the original vectors in double precision. Ties go to the smaller
    vec_id; a query with fewer candidates gets all. Rows whose id or vector is null, or whose vector
    is empty, zero or holds null or non-finite components, take no part; vectors of several lengths
    are an error. Rows that share an id are each a candidate, and each a query if their
    vectors differ; equal query rows are one query. Empty tables give an empty
    result; other columns are ignored.

    share is the part of a shard that a query looks at before its ascent ends, and sets the recall.
    Rows are dealt to shards of about DATA_ROWS rows by a hash of id and vector, queries to blocks.
    """
    spark = data.sparkSession
    rows, asked = usable(data, id_col, vector_col, True), queries_of(usable(queries, id_col, vector_col, True))
    n, m = rows.count(), asked.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dimension(rows) != dimension(asked):
        raise ValueError("queries and data differ in length")
    shards, blocks = -(-n // DATA_ROWS), -(-m // QUERY_ROWS)
    data_side = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    query_side = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = query_side.groupBy("shard", "block").cogroup(data_side.groupBy("shard", "block"))
    return best(met.applyInArrow(_searched(k, share, trees, bits, seed), "query_id long, mark long, vec_id long, score double"), k)

"""Exact top-k search: a Voronoi kNN join for the inner product of integer vectors.

Data rows are grouped by their nearest pivot; a group's summary is its size and the largest
distance to its pivot. By Cauchy and Schwarz no member of a group scores above
q.p + |q| * radius against a query q, and the k-th best score against the pivots, which are data
rows themselves, is a floor for the k-th best of all. A query goes to the bins that hold groups whose
bound reaches its floor. There the groups are taken in the order of their bounds, and a query passes
over those whose bound is below its k-th best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import DATA_ROWS, QUERY_ROWS, best, dimension, matrix, queries_of, top_of, usable

#: Pivots are as many rows as the root of all, but from that many to that many, chosen by a hash of the id.
PIVOTS, MOST_PIVOTS = 256, 4096
_EXACT = 2.0**53
_LONG = 2**63 - 1


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """v becomes floor(scale * x) for each component x."""
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles while every partial sum fits, else in Python's integers, held to 64 bits."""
    top = (np.abs(queries).max() * np.abs(data).max() * queries.shape[1]) if queries.size and data.size else 0
    if top < _EXACT:
        return queries @ data.T
    exact = np.array([[int(x) for x in r] for r in queries], object) @ np.array([[int(x) for x in r] for r in data], object).T
    return np.clip(exact, -_LONG, _LONG)


def _assigned(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            square = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
            group = np.argmin(square, 1)
            away = np.sqrt(((x - pivots[group]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group.astype(np.int32)), pa.array(away)], [*batch.schema.names, "grp", "away"])

    return run


def _sent(pivots: np.ndarray, pivot_ids: np.ndarray, groups: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int):
    """Each query once for every group that may hold one of its k best, with the group's bound and the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, ids = matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            norm = np.sqrt((q**2).sum(1))[:, None]
            score = q @ pivots.T
            bound = score[:, groups] + norm * radii
            own = np.where(pivot_ids == ids[:, None], -np.inf, score)
            floor = np.sort(own, 1)[:, -k] if own.shape[1] >= k else np.full(len(q), -np.inf)
            # Rounding may not shut a group out.
            bound = bound + 1e-9 * (1 + np.abs(bound) + norm * np.abs(radii))
            row, at = np.nonzero((bound >= floor[:, None]) & (sizes > 0))
            arrays = [*[c.take(pa.array(row)) for c in batch.columns], pa.array(groups[at].astype(np.int32)), pa.array(bound[row, at]), pa.array(floor[row])]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "grp", "bound", "floor"])

    return run


def solve(q: np.ndarray, own: np.ndarray, floors: np.ndarray, asked: list[np.ndarray], bounds: list[np.ndarray], groups: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """(queries, row ids, scores) and the rows scored: each query's, told by its place in q, k best among the groups that it asks for.

    The groups come in the order of their highest bounds. A query passes over a group whose bound is
    below its floor, which rises to its k-th best score so far.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in q]
    floors, scored = floors.copy(), 0
    wants: dict[int, list[tuple[int, float]]] = {}
    for row, (gs, bs) in enumerate(zip(asked, bounds, strict=True)):
        for g, b in zip(gs.tolist(), bs.tolist(), strict=True):
            wants.setdefault(g, []).append((row, b))
    for g, rows in sorted(wants.items(), key=lambda w: -max(b for _, b in w[1])):
        live = np.array([row for row, b in rows if b >= floors[row]], np.int64)
        if not len(live) or g not in groups:
            continue
        ids, x = groups[g]
        exact = _products(q[live], x)
        scored += exact.size
        rank = exact if exact.dtype == object else exact.astype(float)
        for row, line in zip(live.tolist(), rank, strict=True):
            free = ids != own[row]
            values, names = line[free], ids[free]
            if len(values) > k and values.dtype != object:
                values, names = (c[values >= np.partition(values, len(values) - k)[len(values) - k]] for c in (values, names))
            best[row] = sorted([*best[row], *((-int(v), int(i)) for v, i in zip(values, names, strict=True))])[:k]
            if len(best[row]) == k:
                floors[row] = max(floors[row], -best[row][-1][0])
    rows = [(row, i, -s) for row, found in enumerate(best) for s, i in found]
    return rows, scored


def _solved(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        found = []
        if len(queries) and len(data):
            data, queries = data.combine_chunks(), queries.combine_chunks()
            x, ids, grp = matrix(data.column("v").chunk(0)), data.column("vec_id").to_numpy(), data.column("grp").to_numpy()
            groups = {int(g): (ids[grp == g], x[grp == g]) for g in np.unique(grp)}
            q, own, floors = matrix(queries.column("v").chunk(0)), queries.column("vec_id").to_numpy(), queries.column("floor").to_numpy()
            asked, bounds = ([np.array(v) for v in queries.column(c).to_pylist()] for c in ("grps", "bounds"))
            found, _ = solve(q, own, floors, asked, bounds, groups, k)
        row, ids, scores = zip(*found, strict=True) if found else ((), (), ())
        row = pa.array(row, pa.int64())
        names = [queries.column(c).take(row) if found else row for c in ("vec_id", "mark")]
        return pa.table([*names, pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "mark", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, scale: int = 256, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k data rows of highest inner product for each query, its own id excepted.

    Vectors are turned into integers, floor(scale * x); scores are exact. Ties go to the smaller
    vec_id; a query with fewer candidates gets all. Rows whose id or vector is null, or whose vector
    is empty or holds null or non-finite components, take no part; vectors of several lengths are
    an error. Rows that share an id are each a candidate, and each a query if their integer
    vectors differ; equal query rows are one query. Empty tables give an empty
    result; other columns are ignored. Scores beyond 64 bits are held at their ends.

    The driver holds up to pivots rows and a summary of each group. A group of more than DATA_ROWS
    rows, be its rows equal or not, is cut into blocks, and so are the queries sent to it.
    """
    spark = data.sparkSession
    rows = quantised(usable(data, id_col, vector_col), scale)
    asked = queries_of(quantised(usable(queries, id_col, vector_col), scale))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, int(rows.count() ** 0.5)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not chosen or asked.isEmpty():
        return empty
    if dimension(rows) != dimension(asked):
        raise ValueError("queries and data differ in length")
    pivot = np.array([r.v for r in chosen])
    grouped = rows.mapInArrow(_assigned(pivot), "vec_id long, v array<double>, grp int, away double")
    summary = grouped.groupBy("grp").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("grp").collect()
    groups, sizes, radii = (np.array([r[c] for r in summary]) for c in ("grp", "n", "radius"))
    sent = asked.mapInArrow(_sent(pivot, np.array([r.vec_id for r in chosen]), groups, sizes, radii, k), "vec_id long, v array<double>, mark long, grp int, bound double, floor double")

    # Small groups meet in bins, so that a task has about DATA_ROWS rows; large ones are cut.
    bins, at, filled = {}, -1, DATA_ROWS
    for g, n in zip(groups.tolist(), sizes.tolist(), strict=True):
        if n > DATA_ROWS or filled + n > DATA_ROWS:
            at, filled = at + 1, 0
        bins[g] = (at, max(1, -(-n // DATA_ROWS)))
        filled += n if n <= DATA_ROWS else DATA_ROWS
    place = spark.createDataFrame([(g, b, c) for g, (b, c) in bins.items()], "grp int, bin int, cuts int")
    data_side = grouped.drop("away").join(F.broadcast(place), "grp").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"))
    # A row for each bin that a query meets, with the groups in it that matter.
    met = sent.join(F.broadcast(place), "grp")
    query_side = met.groupBy("vec_id", "v", "mark", "bin", "cuts").agg(F.collect_list(F.struct("grp", "bound")).alias("asked"), F.max("floor").alias("floor"))
    query_side = query_side.select("vec_id", "v", "mark", "bin", "cuts", "floor", F.col("asked.grp").alias("grps"), F.col("asked.bound").alias("bounds"))
    loads = {r.bin: r.n for r in query_side.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame([(b, max(1, -(-n // QUERY_ROWS))) for b, n in loads.items()], "bin int, asks int")
    query_side = query_side.join(F.broadcast(blocks), "bin").withColumn("ask", F.pmod(F.xxhash64("vec_id"), F.col("asks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    data_side = data_side.join(F.broadcast(blocks), "bin").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    key = ["bin", "part", "ask"]
    # New names, as both sides stem from one table.
    asked_cols, data_cols = [*key, "vec_id", "v", "mark", "floor", "grps", "bounds"], [*key, "vec_id", "v", "grp"]
    left = query_side.select(*asked_cols).toDF(*asked_cols).groupBy(*key)
    right = data_side.select(*data_cols).toDF(*data_cols).groupBy(*key)
    return best(left.cogroup(right).applyInArrow(_solved(k), "query_id long, mark long, vec_id long, score long"), k)

"""Exact and approximate search beside brute force."""

import math
import random

import numpy as np
import pytest

from quillspark.llm import forest, knn, queries

SCHEMA = "vec_id long, embedding array<float>, v int, grp string"


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(8)]) for k in range(400)]
    rows += [(400 + k, rows[7][1]) for k in range(60)] + [(500, rows[7][1]), (550, [0.0] * 8), (551, None), (552, [1.0] * 7 + [None]), (553, [float("nan")] * 8), (600, [float("inf")] + [0.0] * 7), (None, rows[1][1])]
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(5).cache()


def usable(vectors, nonzero):
    out = []
    for r in vectors.collect():
        if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and (any(r.embedding) or not nonzero):
            out.append((r.vec_id, list(r.embedding)))
    return out


def test_exact_top_k(vectors, monkeypatch):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in usable(vectors, False)]
    want = set()
    for i, q in rows:
        if i % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i))[:5]
            want |= {(i, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    asked = vectors.filter("vec_id % 50 = 0")
    assert {tuple(r) for r in knn.top_k(asked, vectors).collect()} == want
    monkeypatch.setattr(knn, "DATA_ROWS", 50)
    monkeypatch.setattr(knn, "QUERY_ROWS", 3)
    assert {tuple(r) for r in knn.top_k(asked, vectors, pivots=16).collect()} == want


def test_bounds_spare_most_pairs():
    """On clustered vectors a query is scored against few rows, and the result is brute force's."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    centres = rng.normal(0, 4000, (40, 16))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 60, (4000, 16)))
    ids, pivots = np.arange(4000), x[:128]
    rows = lambda v, i: pa.RecordBatch.from_arrays([pa.array(i), pa.array(v.tolist(), pa.list_(pa.float64()))], ["vec_id", "v"])
    grouped = next(knn._assigned(pivots)(iter([rows(x, ids)])))
    grp, away = grouped.column("grp").to_numpy(), grouped.column("away").to_numpy()
    names = np.unique(grp)
    sizes, radii = np.array([(grp == g).sum() for g in names]), np.array([away[grp == g].max() for g in names])
    asked = np.arange(0, 4000, 50)
    sent = next(knn._sent(pivots, ids[:128], names, sizes, radii, 5)(iter([rows(x[asked], asked)]))).to_pydict()
    wants = {i: ([], [], f) for i, f in zip(sent["vec_id"], sent["floor"], strict=True)}
    for i, g, b in zip(sent["vec_id"], sent["grp"], sent["bound"], strict=True):
        wants[i][0].append(g)
        wants[i][1].append(b)
    found, scored = knn.solve(x[asked], asked, np.array([wants[i][2] for i in asked]), [np.array(wants[i][0]) for i in asked], [np.array(wants[i][1]) for i in asked], {int(g): (ids[grp == g], x[grp == g]) for g in names}, 5)
    want = {(int(i), j, int(-s)) for i in asked for s, j in sorted((-int(x[i] @ x[j]), j) for j in range(4000) if j != i)[:5]}
    assert {(int(asked[row]), i, s) for row, i, s in found} == want and scored < 0.1 * len(asked) * 4000


@pytest.mark.parametrize("search", [knn.top_k, forest.search])
def test_repeated_query_rows(vectors, search):
    """A query row given twice is one query; another vector under its id is a query of its own."""
    asked = vectors.filter("vec_id in (0, 50)")
    once = sorted(map(tuple, search(asked, vectors).collect()))
    assert len(once) == 10 and sorted(map(tuple, search(asked.union(asked), vectors).collect())) == once
    other = vectors.filter("vec_id = 7").selectExpr("50L as vec_id", "embedding", "v", "grp")
    both = [tuple(r) for r in search(asked.union(other), vectors).collect()]
    assert set(once) <= set(both) and len(both) == 15 and sorted(r[1] for r in both if r[0] == 50) == sorted(2 * [1, 2, 3, 4, 5])


def test_exact_top_k_of_few_and_none(vectors):
    few = vectors.filter("vec_id in (0, 1, 2)")
    assert len(knn.top_k(few, few).collect()) == 6
    assert knn.top_k(few, few.filter("false")).count() == 0 and knn.top_k(few.filter("false"), few).count() == 0


def test_products_beyond_doubles():
    big = np.array([[2.0**40, 1.0]])
    assert knn._products(big, big)[0][0] == min(2**80 + 1, 2**63 - 1)


def test_forest_finds_most(vectors, monkeypatch):
    rows = usable(vectors, True)
    x = np.array([v for _, v in rows], np.float64)
    ids = [i for i, _ in rows]
    norm = np.sqrt((x**2).sum(1))
    want, score = set(), {}
    for a, i in enumerate(ids):
        if i % 50 == 0:
            cos = (x @ x[a]) / (norm * norm[a])
            order = sorted((-round(float(c), 12), j) for c, j in zip(cos, ids, strict=True) if j != i)[:5]
            want |= {(i, j) for _, j in order}
            score |= {(i, j): float(c) for c, j in zip(cos, ids, strict=True)}
    asked = vectors.filter("vec_id % 50 = 0")
    for rows_each in (8192, 100):
        monkeypatch.setattr(forest, "DATA_ROWS", rows_each)
        got = forest.search(asked, vectors).collect()
        assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
        assert all(abs(r.score - score[r.query_id, r.vec_id]) < 1e-12 for r in got)
        assert {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def test_forest_looks_at_all_if_told(vectors):
    x = np.random.default_rng(1).standard_normal((300, 6))
    trees = forest.Forest(x, 4, 20)
    assert all(len(c) == 300 for c in trees.candidates(x[:5], 300))
    assert all(k in c and len(c) >= 10 for k, c in enumerate(trees.candidates(x[:20], 10)))


def test_forest_of_none(vectors):
    assert forest.search(vectors.filter("vec_id = 0"), vectors.filter("false")).count() == 0


def test_recall_on_the_table(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    want = set()
    for a in np.flatnonzero(ids % 50 == 0):
        cos = unit @ unit[a]
        cos[a] = -2
        want |= {(int(ids[a]), int(ids[j])) for j in np.lexsort((ids, -cos))[:5]}
    got = {(r.query_id, r.vec_id) for r in queries.op7_forest(spark, folder).collect()}
    assert len(got & want) >= 0.9 * len(want)

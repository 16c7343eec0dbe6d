"""Shortlists, pair ranks and opened evidence on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evidence as V
from quillspark.operators import refine as R
from quillspark.operators.zh_names import NameRules

RULES = NameRules(singles="王李", compounds=("欧阳",), noise="的", translit="克斯尔", titles=("王子",))


@pytest.mark.parametrize("windows,want", [(0, 0), (1, 1), (2, 1), (3, 3), (300, 3), (800, 4), (4000, 8), (10**6, 8)])
def test_thresholds(windows, want):
    assert R.window_threshold(windows) == want


def test_limits():
    assert [R.shortlist_limit(n) for n in (0, 1, 100, 200, 500, 600)] == [1, 4, 400, 512, 512, 600]


def test_shadows_need_one_dominant_extension(spark):
    rows = [("李星", 100), ("李星河", 95), ("李星云", 40), ("王小", 100), ("王小明", 91), ("李山", 100), ("李山水", 95), ("李山石", 48), ("高山", 9), ("高山流", 9), ("欧阳锋", 5), ("欧阳锋大", 5), ("李零", 0)]
    got = {tuple(r) for r in R.prefix_shadows(spark.createDataFrame(rows, "name string, importance long"), RULES).collect()}
    assert got == {("李星", "李星河"), ("欧阳锋", "欧阳锋大")}


def test_surface_values(spark):
    rows = spark.createDataFrame([("王小明",), ("克斯尔",), ("一山城",), ("山城",), ("好不吧",), ("世界",), ("",)], "name string")
    got = {r["name"]: r.v for r in rows.select("name", R.surface_value(F.col("name"), RULES, ("城",), ("世界",)).alias("v")).collect()}
    assert got == {"王小明": 14.0, "克斯尔": 12.0, "一山城": 3.0, "山城": 4.0, "好不吧": -8.0, "世界": -8.0, "": 0.0}


def select_by_hand(scored, most):
    by_score = [n for n, i, s, sh in sorted(scored, key=lambda x: (-x[2], -x[1], -len(x[0]), x[0])) if not sh]
    by_count = sorted(scored, key=lambda x: (-x[1], -len(x[0]), x[0]))
    open_, shut = [n for n, _, _, sh in by_count if not sh], [n for n, _, _, sh in by_count if sh]
    reserve = min(most, max(most // 4, 1))
    primary = max(most - reserve, 1)
    out = []
    for names in (by_score[:primary], open_[:reserve], by_score[primary:], shut):
        for n in names:
            if n not in out and len(out) < most:
                out.append(n)
    return out


@pytest.mark.parametrize("most", [1, 2, 3, 4, 7, 12, 40])
def test_tiers_equal_selection_by_hand(spark, most):
    scored = [(f"n{k}", (k * 37) % 11, float((k * 53) % 17), k % 6 == 0) for k in range(30)]
    frame = spark.createDataFrame(scored, "name string, importance long, score double, shadowed boolean")
    got = [r["name"] for r in R.tiered(frame, most).orderBy("place").collect()]
    assert got == select_by_hand(scored, most)


def test_scores_and_pairs(spark):
    importance = spark.createDataFrame([("a", 4), ("b", 9), ("c", 1), ("z", 0)], "name string, importance long")
    pairs = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "z", 5), ("a", "q", 7), ("b", "c", 0)], "left string, right string, count long")
    shadows = spark.createDataFrame([("c", "a")], "name string, long string")
    scored = R.candidate_scores(importance, pairs, F.lit(1.0), shadows)
    got = {r["name"]: (r.degree, round(r.association, 6), round(r.score, 6), r.shadowed) for r in scored.collect()}
    assert got == {"a": (2, 0.5, round(18 * math.log(5) + 7 + 1, 6), False), "b": (1, 0.5, round(18 * math.log(10) + 7 + 1, 6), False), "c": (1, 0.5, round(18 * math.log(2) + 7 + 1 - 16, 6), True)}
    best = R.ranked_pairs(pairs, scored, 1).first()
    assert (best.left, best.right, round(best.score, 6)) == ("a", "b", round(3 * 1.5 + 0.35 * got["a"][2], 6))


def test_handles_open_each_character_once(spark):
    text = "".join(chr(97 + k % 26) for k in range(100))
    chapters = spark.createDataFrame([(1, text), (2, "short")], "chapter_id long, content string")
    segments = spark.createDataFrame([(10 + k, 1, k, 10 * k, 10 * k + 10) for k in range(10)] + [(20, 2, 0, 0, 5)], "segment_id long, chapter_id long, ordinal long, start_pos long, end_pos long")
    handles = ["segment::12", "segment::12", "segment::13", "range::1::38::41", "range::1::70::75", "range::2::0::99", "segment::99", "range::1::9::3", "range::1::x::3", "odd", "trace::a::b"]
    asked = spark.createDataFrame([("r", h) for h in handles] + [("s", "segment::20"), ("s", None)], "request string, handle string")
    places = V.resolved(asked.filter("handle is not null"), segments)
    assert {r.handle for r in places.filter("kind = 'unknown'").collect()} == {"segment::99", "range::1::9::3", "range::1::x::3", "odd", "trace::a::b"}
    lengths = chapters.select("chapter_id", F.length("content").cast("long").alias("length"))
    got = {(r.request, r.chapter_id, r.start, r.end): (r.text, list(r.handles)) for r in V.read(V.merged(places, lengths, 2, 3), chapters).collect()}
    assert got == {("r", 1, 18, 44): (text[18:44], ["range::1::38::41", "segment::12", "segment::13"]), ("r", 1, 68, 78): (text[68:78], ["range::1::70::75"]), ("r", 2, 0, 5): ("short", ["range::2::0::99"]), ("s", 2, 0, 5): ("short", ["segment::20"])}
    near = {r.handle: (r.start, r.end) for r in V.resolved(asked.filter("handle = 'segment::12' or handle = 'segment::20'"), segments, 1).collect()}
    assert near == {"segment::12": (10, 40), "segment::20": (0, 5)}


def test_strengths_by_numbers_equal_the_joins(spark, monkeypatch):
    """Names side by side in texts, as numbers: degrees and associations are those of the joins on strings, which lists beyond MOST still take; no string is shuffled."""
    import random

    from quillspark.operators import beside as B
    from quillspark.operators import match as M
    from quillspark.operators.zh_growth import written

    draw = random.Random(3)
    words = ["ab", "Ab", "abc", "cd", "xyz", "(cd)", "--", "a.b", "the", "q"]
    letters = {"a": "王", "A": "王", "b": "李", "c": "张", "d": "马", "x": "", "y": "", "z": "", ".": "。"}
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(30))) for _ in range(60)] + [None, "", "ab", "ab Ab"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    importance = spark.createDataFrame([("王李", 40), ("王李张", 9), ("张马", 31), ("王。李", 7), ("q", 0), ("马", 5), ("", 4)], "name string, importance long")
    beside = M.neighbour_counts(rows, "text").select(written(F.col("a"), letters).alias("a"), written(F.col("b"), letters).alias("b"), "count").filter("a <> b and a <> '' and b <> ''")
    pairs = beside.groupBy(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).agg(F.sum("count").alias("count"))
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    want = rows_of(R.strongest(importance, pairs))
    got = B.strongest(rows, "text", importance, letters)
    assert rows_of(got) == want and len(want) == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "left" not in plan and rows_of(B.strongest(rows, "text", importance.filter("name = '马'"), letters)) == []
    monkeypatch.setattr(B, "MOST", 1)
    assert rows_of(B.strongest(rows, "text", importance, letters)) == want


def test_pairs_are_put_together_in_parts(monkeypatch):
    """However few pairs a task holds at once, the counts are the same."""
    import numpy as np
    import pyarrow as pa

    from quillspark.operators import beside as B

    words = ["ab", "cd", "ef", "gh"]
    h = np.sort(np.array([B._hash(w) for w in words]))
    names = type("Names", (), {"value": (h, np.array([4, 9, 16, 25]))})
    batches = [pa.record_batch([pa.array(["ab cd ef ab cd", "gh x ab cd", None])], ["text"])] * 3

    def all_of():
        pairs = pa.Table.from_batches(list(B._numbered(names, None)(iter(batches)))).group_by("key").aggregate([("n", "sum")])
        ends = pa.Table.from_batches(list(B._strengths(names)(pairs.select(["key", "n_sum"]).rename_columns(["key", "n"]).to_batches(max_chunksize=1))))
        return sorted(map(tuple, (r.values() for r in ends.group_by("h").aggregate([("degree", "sum"), ("association", "max")]).to_pylist())))

    whole = all_of()
    monkeypatch.setattr(B, "HELD", 1)
    assert all_of() == whole and [d for _, d, _ in sorted(whole)] == [2, 2, 2]

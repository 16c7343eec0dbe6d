"""Chapters from pieces, life of assets, budgets, answers and repairs on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import validation as V
from quillspark.operators import budget as B
from quillspark.operators import ingest as I
from quillspark.operators import pieces as P
from quillspark.operators import repair as X
from quillspark.plans.upkeep import SCHEMA
from quillspark.streaming import events as E
from quillspark.streaming import lifecycle as L

BOOKS = [
    (1, "Before\nChapter 1 Dawn\nAda reached Port Mira.\n\nChapter II: Dusk\r\nAda stays.\r\nchapters are not headings\rChapter 3\r\r\nEnd"),
    (2, "第一章 开始\n正文\n第二章\n更多\nChapter 9 not of this language\n"),
    (3, "No headings here.\n  Only text.  "), (4, ""), (5, "\n\nChapter 7"), (6, "Chapter 1\nChapter 2\n\n" + "long line " * 300 + "\nChapter 3 " + "x" * 70 + "\nbody"), (7, "Chapter 5 At once"), (8, "\r"),
]


def chapters(df):
    return sorted((r.id, r.chapter, r.label, r.number, r.title, r.content) for r in df.select("id", "chapter", "label", "number", "title", "content").collect())


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_pieces_give_the_chapters_of_the_whole(spark, size):
    texts = spark.createDataFrame(BOOKS, "id long, text string").repartition(3)
    want = chapters(I.split_chapters(texts, "id", "text"))
    assert chapters(P.gathered(*P.split_pieces(P.pieces_of(texts, "id", "text", size)))) == want and len(want) == 12


def test_a_long_book_in_pieces(spark):
    rnd = random.Random(4)
    book = "".join(f"Chapter {k} Title {k}\n" + "\n".join("some words of text " * rnd.randint(0, 40) for _ in range(60)) + "\n" for k in range(1, 80))
    texts = spark.createDataFrame([(1, book)], "id long, text string")
    heads, parts = P.split_pieces(P.pieces_of(texts, "id", "text", 50_021))
    assert parts.select(F.max(F.length("text"))).first()[0] <= 50_021 and parts.select("n").distinct().count() > 10
    assert chapters(P.gathered(heads, parts)) == chapters(I.split_chapters(texts, "id", "text"))


def lives():
    rnd = random.Random(9)
    rows = [(rnd.randint(1, 25), rnd.choice([*L.OPERATIONS, "noise", None]), rnd.choice([None, 0, 1, 2, 3, 4, 5]), rnd.choice([None, "a", "b"])) for _ in range(700)]
    return rows + [(99, "enqueue", 3, None), (99, "claim", 3, None), (98, "enqueue", 2, None), (98, "success", 1, None), (97, "claim", 4, None), (97, "failure", 4, "z"), (97, "failure", 4, "y"), (96, "noise", 4, None)]


def test_replayed_and_reordered_stream_ends_in_the_batch_result(spark, tmp_path):
    rows, schema = lives(), "novel_id long, operation string, revision long, error string"
    want = {tuple(r) for r in L.state_of(spark.createDataFrame(rows, schema), "novel_id").collect()}
    assert {(99, 3, 3, 0, 0, "running", None), (98, 2, 0, 1, 0, "queued", None), (97, 4, 4, 0, 4, "failed", "z")} <= want
    again = rows + rows[:200]
    random.Random(1).shuffle(again)
    for k in range(6):
        spark.createDataFrame(again[k::6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = E.read_events(spark, str(tmp_path / "in"), schema, files=2)
    E.run_available(L.advanced(stream, "novel_id"), str(tmp_path / "progress"), L.keep_updates(str(tmp_path / "out")), "update")
    updates = spark.read.parquet(str(tmp_path / "out"))
    assert updates.select("batch").distinct().count() >= 3
    got = {tuple(r) for r in L.latest_states(updates.drop("batch"), "novel_id").collect()}
    assert {r for r in got if r[1]} == want


def fit_by_hand(entities, attributes, edges, systems, budget):
    def cost(n, refs, ref_edges):
        ids = {e[0] for e in entities[:n]}
        known = {e[0] for e in entities}
        total = sum(systems) + sum(e[1] for e in entities[:n]) + sum(c for o, v, c in attributes if o in ids and (refs or v != "reference"))
        return total + sum(c for s, t, v, c in edges if (ref_edges or v != "reference") and (not {s, t} <= known or {s, t} <= ids))

    for tier, (refs, ref_edges) in enumerate([(True, True), (True, False), (False, False)]):
        if cost(len(entities), refs, ref_edges) <= budget:
            return tier, len(entities), cost(len(entities), refs, ref_edges)
    n = len(entities)
    while n and cost(n, False, False) > budget:
        n -= 1
    return 3, n, cost(n, False, False)


def test_budget_equals_dropping_one_by_one(spark):
    rnd = random.Random(6)
    tables, want = ([], [], [], [], []), set()
    for ctx in range(12):
        entities = [(10 * ctx + k, rnd.randint(1, 30)) for k in range(rnd.randint(0, 8))]
        ids = [e[0] for e in entities] + [-1]
        attributes = [(rnd.choice(ids[:-1]), rnd.choice(["active", "reference"]), rnd.randint(0, 20)) for _ in range(10) if len(ids) > 1]
        edges = [(rnd.choice(ids[:-1]), rnd.choice(ids if k == 0 else ids[:-1]), rnd.choice(["active", "reference"]), rnd.randint(0, 9)) for k in range(8) if len(ids) > 1]
        systems = [rnd.randint(0, 20) for _ in range(2)]
        tables[0].extend((ctx, i, k, c) for k, (i, c) in enumerate(entities, 1))
        tables[1].extend((ctx, *a) for a in attributes)
        tables[2].extend((ctx, 100 * ctx + k, *e) for k, e in enumerate(edges))
        tables[3].extend((ctx, c) for c in systems)
        for budget in (5, 30, 60, 100, 140, 1000):
            tables[4].append((ctx, budget))
            want.add((ctx, budget, *fit_by_hand(entities, attributes, edges, systems, budget)))
    schemas = ("ctx long, id long, rank int, cost long", "ctx long, entity_id long, visibility string, cost long", "ctx long, edge_id long, source_id long, target_id long, visibility string, cost long", "ctx long, cost long", "ctx long, budget int")
    frames = [spark.createDataFrame(t, s) for t, s in zip(tables, schemas, strict=True)]
    fits = B.fit(*frames)
    assert {tuple(r) for r in fits.collect()} == want and len({w[2] for w in want}) == 4
    entities, attributes, edges = B.cut_to(fits, *frames[:3])
    kept = {(r.ctx, r.budget): r["count"] for r in entities.groupBy("ctx", "budget").count().collect()}
    assert all(kept.get((c, b), 0) == n for c, b, _, n, _ in want)
    tiers = {(c, b): t for c, b, t, _, _ in want}
    assert all(tiers[r.ctx, r.budget] < 2 for r in attributes.filter("visibility = 'reference'").collect()) and all(tiers[r.ctx, r.budget] < 1 for r in edges.filter("visibility = 'reference'").collect())


GOOD = '{"name": "n", "status": "O", "total": 1.5, "items": [{"id": 1}], "more": null}'
ANSWERS = [
    (GOOD, None, None, False), (f"```json\n{GOOD}\n```", "stop", None, False), (GOOD, "length", "truncated", True), (GOOD[:-4], None, "truncated", True), ('{"name": "n', None, "truncated", True), ("", None, "empty", False), (None, None, "empty", False), ("words", None, "no JSON", False),
    ("[1]", None, "$: not object", False), ('{"name": 1}', None, "$.name: not string", False), ('{"name": null}', None, "$.name: missing", False), (GOOD.replace('"O"', '"X"'), None, "$.status: not allowed", False), (GOOD.replace("1.5", "true"), None, "$.total: not number", False),
    (GOOD.replace('{"id": 1}', '{"id": 1}, {"id": 1.5}, {}'), None, "$.items[1].id: not integer", False), (GOOD.replace('{"id": 1}', "7"), None, "$.items[0]: not object", False), (GOOD.replace('[{"id": 1}]', "{}"), None, "$.items: not array", False), (GOOD.replace('"n"', '"{[ \\" {"'), None, None, False), ("{}}", None, "no JSON", False),
]


def test_answers_are_checked(spark):
    rows = spark.createDataFrame([(k, t, f) for k, (t, f, _, _) in enumerate(ANSWERS)], "k int, text string, finish string")
    got = {r.k: r.o for r in V.checked(rows, "text", SCHEMA, "finish", "o").collect()}
    for k, (_, _, fault, cut) in enumerate(ANSWERS):
        assert (got[k].fault, got[k].truncated, got[k].valid) == (fault, cut, fault is None), ANSWERS[k]
        assert (got[k].value is not None) == (fault is None)


def test_sessions_merge_without_orphans(spark):
    t = lambda k: f"2024-01-{k:02d} 00:00:00"
    sessions = spark.createDataFrame([(1, 1, 1, "s", t(5), t(1)), (2, 1, 1, "s", None, t(6)), (3, 1, 1, "s", t(6), t(1)), (4, 1, 2, "s", t(1), t(1)), (5, None, 1, "s", None, None), (6, None, 1, "s", t(1), None)], "id long, novel_id long, user_id long, signature string, last_active_at string, created_at string")
    runs = spark.createDataFrame([(10 + k, s) for k, s in enumerate([1, 2, 3, 4, 5, 6, None, 77])], "id long, session_id long")
    kept, moved = X.merged_sessions(sessions, runs)
    assert {r.id for r in kept.collect()} == {3, 4, 6}
    assert {r.id: r.session_id for r in moved.collect()} == {10: 3, 11: 3, 12: 3, 13: 4, 14: 6, 15: 6, 16: None, 17: 77}


def test_one_active_run_stays(spark):
    rows = [(1, 1, "queued", "b"), (2, 1, "running", "a"), (3, 1, "running", "a"), (4, 1, "done", "z"), (5, 2, "queued", None), (6, None, "running", "a"), (7, None, "running", "a")]
    runs = spark.createDataFrame([(*r, None, "x", None) for r in rows], "id long, session_id long, status string, started_at string, error string, lease_owner string, created_at string")
    out = X.one_active(runs, F.current_timestamp(), "twice")
    assert out.columns == runs.columns
    assert {(r.id, r.status, r.error, r.lease_owner) for r in out.collect()} == {(1, "interrupted", "twice", None), (2, "interrupted", "twice", None), (3, "running", None, "x"), (4, "done", None, "x"), (5, "queued", None, "x"), (6, "running", None, "x"), (7, "running", None, "x")}


def test_back_fill_and_first_inserts(spark):
    novels = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, has_index boolean")
    chapters_ = spark.createDataFrame([(1,), (1,), (None,), (9,)], "novel_id long")
    got = {r.id: (r.index_status, r.index_revision, r.built_revision) for r in X.back_filled(novels, chapters_).collect()}
    assert got == {1: ("fresh", 1, 1), 2: ("missing", 0, None), 3: ("missing", 0, None)}
    given = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    assert {tuple(r) for r in X.first_inserted(given, spark.createDataFrame([("b",)], "k string"), ["k"], ["n"]).collect()} == {("a", 1), ("c", 1)}

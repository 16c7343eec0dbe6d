"""Answers, names, systems and lore."""

import json

from pyspark.sql import functions as F

from quillspark.functions import answers, names
from quillspark.operators import lore, systems


def test_tool_calls(spark):
    texts = ['<tool_call>{"name": "find", "arguments": {"q": "x"}}</tool_call> ok', '<function=open>{"id": 3}</function>', '{"name": "find", "arguments": "{\\"q\\": 1}"}', "plain {not json}", '<tool>{"name": "rm", "arguments": {}}</tool>', None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.name, r.arguments) for r in answers.tool_calls(df, "id", "text", ["find", "open"]).collect()}
    assert got == {(0, "find", '{"q": "x"}'), (1, "open", '{"id": 3}'), (2, "find", '{"q": 1}')}
    assert df.select(answers.without_calls(F.col("text")).alias("t")).first().t == "ok"


def test_json_of_answers(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('x ```json\n{"b": 2}\n``` y',), ("none",)], "t string")
    assert [r[0] and json.loads(r[0]) for r in df.select(answers.whole_json(F.col("t"))).collect()] == [{"a": 1}, {"b": 2}, None]
    assert answers.first_object('so {x} {"c": {"d": 1}} z') == {"c": {"d": 1}}


def test_names(spark):
    df = spark.createDataFrame([("王小明见李四。",), ("王小明和欧阳锋。欧阳锋走",)], "t string")
    got = {r.name: r["count"] for r in names.recovered_counts(df, "t").collect()}
    assert got == {"王小明": 2} or got["王小明"] == 2
    assert [r[0] for r in df.select(names.looks_like_person(F.lit("李四"))).collect()] == [True, True]
    assert df.select(names.bigrams(F.lit("云澈在 此")).alias("b")).first().b == ["云澈", "澈在"]


def test_systems(spark):
    tree = {"nodes": [{"label": "A", "children": [{"label": "B", "visibility": "hidden", "children": [{"label": "C"}]}, {"label": "D"}]}]}
    line = {"events": [{"label": "e1", "time": "t"}, {"label": "e2", "visibility": "hidden"}]}
    df = spark.createDataFrame([(1, 1, json.dumps(tree), ["one", " ", "two"]), (1, 2, json.dumps(line), ["three"]), (1, 3, "broken", None)], "novel_id int, system_id int, data string, constraints array<string>")
    flat = systems.nodes(df)
    assert {(r.path, r.depth, r.hidden) for r in flat.collect()} == {("A", 0, False), ("A / B", 1, True), ("A / B / C", 2, True), ("A / D", 1, False)}
    assert systems.rendered(flat).first().text == "- A\n  - D"
    assert {r.label for r in systems.labels(df).collect()} == {"A", "B", "C", "D", "e1", "e2"}
    kept = df.filter("system_id = 2").select(systems.pruned_items(F.col("data"), "events")).first()[0]
    assert [e["label"] for e in json.loads(kept)["events"]] == ["e1"]
    assert systems.constraints(df).first().text == "1. one\n2. two\n3. three"


def test_lore(spark):
    texts = spark.createDataFrame([(1, "The Red Tower fell near Ada."), (2, "red tower and adage")], "doc long, text string")
    entries = spark.createDataFrame([(1, 1, True, 700), (2, 2, True, 1500), (3, 3, True, 900), (4, 0, False, 1)], "entry_id long, priority int, enabled boolean, token_budget int")
    keys = spark.createDataFrame([(1, "red tower", False, False), (2, "Ada", False, True), (3, "f.ll", True, False), (4, "fell", False, False)], "entry_id long, keyword string, is_regex boolean, case_sensitive boolean")
    found = lore.lore_matches(texts, "doc", "text", entries, keys)
    assert {(r.id, r.entry_id) for r in found.collect()} == {(1, 1), (1, 2), (1, 3), (2, 1)}
    got = {r.id: (r.used, r["items"]) for r in lore.injected(found, entries, 2000).collect()}
    assert got == {1: (1600, [1, 3]), 2: (700, [1])}

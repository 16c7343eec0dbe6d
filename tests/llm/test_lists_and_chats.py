"""URL lists beside SQL, transcripts beside a plain Viterbi, and the pipeline."""

import datetime

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from quillspark.llm import queries, transcripts, url_lists


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, folder, name):
    assert compare(spark, folder, name, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_url_lists(spark, monkeypatch):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(1, "https://a.Bad.org/x", day(5)), (2, "https://a.bad.org/x", day(9)), (3, "http://bad.org", day(10)), (4, "http://notbad.org/", day(5)), (5, None, day(5)), (6, "http://bad.org/", None), (7, "/relative", day(5)), (8, "http://u:p@ok.org:80/p/q/r?x=bad.org", day(5)), (8, "http://u:p@ok.org:80/p/q/r?x=bad.org", day(5)), (9, "http://ok.org/pq", day(5))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").withColumn("key", F.lit(1)).withColumn("since", F.lit("x"))
    list_ = [("domain", "bad.org", "2024-01-03", "add"), ("domain", "bad.org", "2024-01-04", "add"), ("domain", "bad.org", "2024-01-09", "remove"), ("domain", "bad.org", "2024-01-10", "remove"), ("domain", "bad.org", "2024-01-10", "add"), ("prefix", "ok.org/p/q", "2024-01-01", "add"), (None, "x", "2024-01-01", "add"), ("domain", "never.org", "2024-01-01", "remove")]
    entries = spark.createDataFrame(list_, "kind string, value string, day string, action string")
    want = [(1, True), (2, False), (3, True), (4, False), (5, False), (6, False), (7, False), (8, True), (8, True), (9, False)]
    for bound in (50_000, 0):
        monkeypatch.setattr(url_lists, "BROADCAST_ROWS", bound)
        got = url_lists.listed(captures, entries).orderBy("page_id").collect()
        assert [(r.page_id, r.blocked) for r in got] == want
    assert {r.listed_key for r in got if r.page_id == 8} == {"prefix:ok.org/p/q"}
    assert url_lists.listed(captures.filter("false"), entries).count() == 0
    assert not any(r.blocked for r in url_lists.listed(captures, entries.filter("false")).collect())


def plain_viterbi(model, obs):
    weight, back = transcripts.begin(), []
    for o in obs:
        moves = weight[:, None] + model.step(o)
        back.append(moves.argmax(0))
        weight = moves.max(0)
    path = [int(weight.argmax())]
    for b in back[:0:-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_over_fragments(spark, folder):
    raw = queries.raw_transcripts(spark.read.parquet(f"{folder}/conversations.parquet"))
    raw = raw.withColumn("conv_id", F.when(F.col("conv_id") < 15, -1).otherwise(F.when(F.col("conv_id") > 17, F.col("conv_id"))))
    lines = transcripts.lines_of(raw, "conv_id", ["turn"], "raw", F.col("role")).cache()
    model = transcripts.learn(lines)
    seen = {}
    for r in lines.select("conv_id", "place", transcripts.observation(F.col("line")).alias("o")).orderBy("conv_id", "place").collect():
        seen.setdefault(r.conv_id, []).append(r.o)
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {}
        for r in transcripts.parse(lines, model).orderBy("conv_id", "place").collect():
            got.setdefault(r.conv_id, []).append((r.role, r.starts))
        assert {k: v for k, v in got.items()} == {k: [(transcripts.ROLES[s // 2], s % 2 == 0) for s in plain_viterbi(model, o)] for k, o in seen.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert transcripts.parse(lines.filter("false"), model).count() == 0


def test_markers(spark):
    cases = {"User: hi": 1 + 1, "### Question: x": 2, "**Assistant:** y": 3, "[SYSTEM]: z": 1, "no marker": 0, "Bob: hey": 4, "": 0, "<|user|>: q": 2}
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    assert [r[0] for r in df.select(transcripts.marker_of(F.col("line"))).collect()] == list(cases.values())
    assert df.select(transcripts.content_of(F.col("line")).alias("c")).first().c == "hi"


def test_markers_of_very_long_runs(spark):
    runs = ["#" * 1_000_000, "# " * 500_000, "> [" * 300_000 + "User: x", "a " * 500_000, "User" + " ]" * 500_000, "x: " * 300_000]
    rows = spark.createDataFrame([(r,) for r in runs], "line string").select(transcripts.observation(F.col("line")).alias("o"), F.length(transcripts.content_of(F.col("line"))).alias("n"))
    assert len(rows.collect()) == len(runs)


def test_prefixes_with_scheme_slash_and_case(spark):
    day = "2024-01-01"
    entries = [("prefix", "https://OK.org/p/", day, "add"), ("domain", " Bad.ORG. ", day, "add"), ("word", "x", day, "add")]
    pages = [(1, "http://ok.org/p/a", "2024-02-01"), (2, "http://ok.org/P/a", "2024-02-01"), (3, "http://www.bad.org/", "2024-02-01"), (4, "http://ok.org/pa", "2024-02-01")]
    out = url_lists.listed(spark.createDataFrame(pages, "page_id long, url string, fetched_at string"), spark.createDataFrame(entries, "kind string, value string, day string, action string"))
    assert {r.page_id for r in out.filter("blocked").collect()} == {1, 3}


def test_roles_are_recovered(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("true"))
    rows = queries.op10_transcripts(spark, folder).join(turns, ["conv_id", "turn"]).collect()
    assert sum(r.role == r.true for r in rows) >= 0.9 * len(rows)
    assert all(r.canonical.startswith(f"<|{r.role}|>\n") for r in rows if r.starts)


def test_joined_matrices_do_not_depend_on_grouping():
    m = list(np.random.default_rng(0).standard_normal((5, 3, 3)))
    left = m[0]
    for x in m[1:]:
        left = transcripts.join(left, x)
    assert np.allclose(transcripts._tree(m), left)


def test_pipeline(spark, folder, tmp_path):
    import corpus_pipeline

    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "tokens":
            assert docs.columns == first.columns
            assert docs.filter("n_chars <> length(text)").isEmpty()
        if name == "near_copies":
            assert docs.select("doc_id").distinct().count() == docs.count() < before
    assert docs.filter("n_tokens <> size(ids)").isEmpty() and docs.count() > 0.5 * before

"""Operators that SQL does not express: headings, segments, claims, files, cards and streams."""

import base64
import json
import struct
import zlib

from pyspark.sql import functions as F

from quillspark.operators import analytics, ingest, match, segments, state
from quillspark.sources import cards, files
from quillspark.streaming import events as stream


def test_headings(spark):
    text = "lost\nChapter 1 Dawn\nAda reached Port Mira.\n\nChapter II: Dusk\nAda stays."
    other = "第一章 开始\n甲\n第二章\n乙\nChapter 9 x"
    rows = spark.createDataFrame([(1, text), (2, other), (3, "no heading\nat all"), (4, "")], "id long, text string")
    got = {(r.id, r.chapter): (r.number, r.title, r.content) for r in ingest.split_chapters(rows, "id", "text").collect()}
    assert got[1, 1] == (1, "Dawn", "Ada reached Port Mira.")
    assert got[1, 2] == (2, "Dusk", "Ada stays.")
    assert got[2, 1][0] == 1 and got[2, 2] == (2, None, "乙\nChapter 9 x")
    assert got[3, 1] == (None, None, "no heading\nat all") and got[4, 1][2] == ""


def test_segments_cover_and_keep_their_sizes(spark):
    text = "".join(f"Sentence number {k} is here. " for k in range(200))
    parts = segments.cuts(text)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert all(segments.LEAST <= b - a <= segments.HARD for a, b in parts[:-1])
    assert segments.cuts("") == [] and segments.cuts("x" * 1500) == [(0, 700), (700, 1500)]
    rows = spark.createDataFrame([(1, 1, text), (1, 2, text), (2, 1, "short")], "novel_id long, chapter_id long, content string")
    out = segments.segment(spark, rows).collect()
    book = sorted((r.chapter_id, r.start_pos, r.bucket) for r in out if r.novel_id == 1)
    assert [b for _, _, b in book] == [min(7, k * 8 // len(book)) for k in range(len(book))]
    assert sum(r.prev_id is None for r in out) == 3 and sum(r.next_id is None for r in out) == 3


def test_regimes_of_one_key(spark):
    rows = [("t", "s", v, c, c, k, 0.9, 1) for k, (c, v) in enumerate([(1, "A"), (2, "A"), (3, "B"), (7, "B")])]
    df = spark.createDataFrame(rows, "target string, slot string, value string, chapter long, segment long, claim_id long, confidence double, cues int")
    got = [(r.value, r.start_chapter, r.end_chapter, round(r.conflict, 2)) for r in state.regimes(df).orderBy("island").collect()]
    assert got == [("A", 1, 2, 1.8), ("B", 3, 3, 0.0), ("B", 7, 7, 0.0)]


def test_first_value_needs_a_later_save(spark):
    rows = [(5, 1, "generation", 1, 1), (4, 1, "save", 1, 1), (6, 1, "save", 1, 2)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event string, project_id long, t long").withColumn("created_at", F.timestamp_seconds("t")).withColumn("meta", F.create_map(F.lit("mode"), F.lit("m")))
    row = analytics.project_rollup(df, {"save": "save"}, "start", "generation", "save").first()
    assert row.first_value_at.second == 2 and row.n_save == 2


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("n", 1, 1, 700), ("n", 2, 2, 1500), ("n", 3, 3, 900)], "novel string, rank int, item long, cost long")
    row = match.within_budget(df, "novel", ["rank"], 2000).first()
    assert (row.used, row["items"]) == (1600, [1, 3])


def test_texts_of_several_encodings(spark, tmp_path):
    for name, data in {"a.txt": "héllo".encode(), "b.txt": "你好世界".encode("gb18030"), "c.txt": b"", "d.bin": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.text) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("utf-8", "héllo"), "b.txt": ("gb18030", "你好世界")}


def test_ndjson_and_rejects(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    files.write_ndjson(df, str(tmp_path / "out"))
    lines = sorted(x for p in (tmp_path / "out").glob("*.txt") for x in p.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"a": 3}')
    (tmp_path / "in/2.json").write_text("{broken")
    rows, rejects = files.read_json(spark, str(tmp_path / "in"), "a int")
    assert [r.a for r in rows.collect()] == [3] and rejects.count() == 1


def _png(kind: bytes, body: bytes) -> bytes:
    def chunk(k, b):
        return struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))

    return cards.SIGNATURE + chunk(b"IHDR", b"0" * 13) + chunk(kind, body) + chunk(b"IEND", b"")


def test_cards(spark, tmp_path):
    card = {"data": {"name": " Ada ", "description": "d", "tags": ["x", " "]}}
    packed = base64.b64encode(json.dumps(card).encode())
    (tmp_path / "a.json").write_text(json.dumps(card))
    (tmp_path / "b.png").write_bytes(_png(b"tEXt", b"chara\0" + packed))
    (tmp_path / "c.png").write_bytes(_png(b"zTXt", b"chara\0\0" + zlib.compress(packed)))
    (tmp_path / "d.png").write_bytes(cards.SIGNATURE + b"\0\0")
    got = {r.path.rsplit("/", 1)[1]: (r.name, r.content, r["keywords"]) for r in cards.card_text(cards.read_cards(spark, str(tmp_path))).collect()}
    assert got["a.json"] == got["b.png"] == got["c.png"] == ("Ada", "[description]\nd", ["Ada", "x"])
    assert got["d.png"][0] is None


def test_stream_equals_batch(spark, folder, tmp_path):
    batch = spark.read.parquet(f"{folder}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    rows = stream.read_events(spark, str(tmp_path / "in"), batch.schema.simpleString()[7:-1].replace(":", " "), 1)
    query = stream.windowed_counts(rows, "ts", "event_type", late="60 days").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r.start), r.event_type): r.n for r in spark.table("counts").collect()}
    want = {(str(r.start), r.event_type): r.n for r in batch.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_dirty_partitions_are_replaced(spark, tmp_path):
    schema = "novel_id long, chapter_id long, content string"
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema)
    files.replace_partitions(old, str(tmp_path / "index"), "novel_id")
    spark.createDataFrame([(2, 1, "new")], schema).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    handle = stream.replace_dirty(str(tmp_path / "index"), lambda b: b)
    stream.run_available(rows, str(tmp_path / "cp"), handle)
    got = {(r.novel_id, r.content) for r in spark.read.parquet(str(tmp_path / "index")).collect()}
    assert got == {(1, "a"), (2, "new")}


def test_chunks_reach_the_end_of_a_text(spark):
    from quillspark.operators import ingest

    text = "".join(chr(97 + k * k % 26) for k in range(70_000)) + "end"
    rows = sorted((r.chunk, r.content) for r in ingest.chunks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect())
    assert len(rows) == 11 and rows[0][1] + "".join(c[500:] for _, c in rows[1:]) == text


def test_long_runs_of_words_take_no_stack(spark):
    from quillspark.operators import checks

    runs = ["a-" * 500_000, "a'" * 500_000, "a" * 1_000_000, "a b " * 250_000]
    df = spark.createDataFrame(list(enumerate(runs)), "id int, text string")
    assert {r.version: r.words for r in checks.long_paragraphs(df, "id", "text").collect()} == {3: 500_000}
    assert checks.long_sentences(df, "id", "text").count() == 1


def test_matches_in_texts_equal_those_of_tokens(spark):
    """Runs of words are found where the texts lie: the same rows, and only what may be a name is shuffled."""
    from pyspark.sql import functions as F

    from quillspark.operators import candidates as C
    from quillspark.operators import match as M

    texts = spark.createDataFrame([(1, "\"Ann Lee\" met Ann,\n\n(Bo) -- Lee\tAnn Lee's"), (2, ""), (3, None), (4, "*** Bo  Lee. é Ö ß 北京 Ann"), (5, "--Ann--Lee-- Ann")], "id long, text string")
    aliases = spark.createDataFrame([("Ann", 1), ("Ann Lee", 2), ("Bo", 3), ("Bo Lee", 4), ("Lee é Ö", 5), ("北京 Ann", 6), (None, 7), ("Ann", 8)], "alias string, target_id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    mine = M.matches_in(texts, aliases, "id", "text", 3)
    assert rows(mine) == rows(M.matches(C.tokens(texts, "id", "text"), aliases, 3)) and mine.filter("alias = 'Bo Lee'").count() == 2
    assert "Window" not in mine._jdf.queryExecution().executedPlan().toString()
    # Segments of a long text meet matches by their cell, also where one covers several.
    found = spark.range(0, 9000, 300).select(F.lit(1).alias("id"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"), F.lit(7).alias("target_id"))
    segments = spark.createDataFrame([(1, 10, 0, 5000), (1, 11, 4000, 9000), (1, 12, 600, 600), (1, 13, 1023, 1025), (2, 14, 0, 9000)], "id long, segment_id long, start_pos long, end_pos long")
    assert {(r.segment_id, r.n) for r in M.mention_postings(found, segments).collect()} == {(10, 17), (11, 16)}


def test_neighbours_and_windows_without_a_row_a_token(spark):
    """Neighbours are counted in their text; a window's pairs come from one row; prefix shadows need no pairs."""
    from quillspark.operators import candidates as C
    from quillspark.operators import match as M

    texts = spark.createDataFrame([(1, "a, b a\nb -- (a) c"), (2, "b"), (3, None), (4, "a b")], "id long, text string")
    counted = M.neighbour_counts(texts, "text")
    assert {(r.a, r.b, r["count"]) for r in counted.collect()} == {("a", "b", 3), ("b", "a", 2), ("a", "c", 1)}
    assert "Window" not in counted._jdf.queryExecution().executedPlan().toString()
    present = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 1, 0), ("a", 1, 1), ("b", 1, 1), ("b", None, 0), ("a", 2, 0), ("d", 2, 0)], "name string, id long, window long")
    pairs = C.cooccurrence(present, C.importance(present), 2)
    assert {(r["left"], r["right"], r["count"]) for r in pairs.collect()} == {("a", "b", 2)}
    assert "SortMergeJoin [id" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_regimes_and_conflicts_are_one_pass_without_collected_claims(spark):
    rows = [(1, "s", v, c, c, k, w, 1) for k, (v, c, w) in enumerate([("a", 0, 0.5), ("a", 1, 0.25), ("a", 1, 1.0), ("b", 2, 0.5), ("b", 9, 0.25), ("a", 10, 1.0)])]
    islands = state.regimes(spark.createDataFrame(rows, "target long, slot string, value string, chapter long, segment long, claim_id long, confidence double, cues int"))
    out = state.next_conflict(islands)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan
    assert [(r.claims, r.tail, r.end_segment) for r in islands.orderBy("island").collect()] == [(3, 1.25, 1), (1, 0.5, 2), (1, 0.25, 9), (1, 1.0, 10)]
    assert [(r.value, r.next_chapter, r.next_value) for r in out.orderBy("island").collect()] == [("a", 2, "b"), ("b", 10, "a"), ("b", 10, "a"), ("a", None, None)]

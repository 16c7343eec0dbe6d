"""Dictionary matches in any script and Chinese discovery on small texts."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import policy as P
from quillspark.operators import candidates as C
from quillspark.operators import match as M
from quillspark.operators import overlaps as O
from quillspark.operators import zh_names as Z

ALIASES = [("a1", "李星"), ("a2", "李星河"), ("a3", "星河"), ("b1", "the Old Mill"), ("b2", "Old Mill"), ("b3", "Mill"), ("b4", "one two three four five six"), ("b5", "Mill-Race"), ("c1", "星"), ("c2", "Straße"), ("d", "aa")]


def inside(text, i):
    return 0 <= i < len(text) and (text[i] in "_-" or unicodedata.category(text[i])[0] in "LN")


def by_hand(texts, aliases):
    found = set()
    for k, cjk, text in texts:
        for target, alias in aliases:
            for at in range(len(text or "") - len(alias) + 1):
                end = at + len(alias)
                if text[at:end] == alias and (cjk or not inside(text, at - 1) and not inside(text, end)):
                    found.add((k, at, end, alias, target))
    return found


def test_overlaps_equal_search_by_hand(spark):
    rnd = random.Random(2)
    pieces = ["李星河", "星", "河李", "the Old Mill", "Old Mill-Race", " ", "Mill", "Mills", "_Mill", "one two three four five six", "aaaa", "aa", "Straße", "，", "\n", "😀"]
    texts = [(k, k % 2 == 0, "".join(rnd.choices(pieces, k=rnd.randint(0, 30)))) for k in range(200)] + [(900, True, None), (901, False, ""), (902, True, "星"), (903, False, "Mill")]
    rows = spark.createDataFrame([(k, c, t, 7) for k, c, t in texts], "id long, cjk boolean, text string, start int").repartition(4)
    names = spark.createDataFrame([(t, a) for t, a in ALIASES], "target_id string, alias string")
    got = {tuple(r) for r in O.overlap_matches(rows, names, "id", "text", F.col("cjk")).collect()}
    assert got == by_hand(texts, ALIASES) and len(got) > 300
    assert O.overlap_matches(rows, names.limit(0), "id", "text", F.col("cjk")).count() == 0


def test_folded_names_match(spark):
    texts = spark.createDataFrame([(1, "In der STRASSE am ﬁnalen Tor, ＡＢＣ"), (2, "straßen")], "id long, text string")
    targets = spark.createDataFrame([(1, ["Straße"]), (2, ["finalen Tor"]), (3, ["abc"]), (4, ["Tor"]), (5, ["tor"])], "target_id long, names array<string>")
    index = M.keyword_index(targets)
    assert {r.keyword for r in index.collect()} == {"strasse", "finalen tor", "abc"}
    found = O.overlap_matches(texts, index.select(F.col("keyword").alias("alias"), "target_id"), "id", "text", F.lit(False), folded=True)
    assert {(r.id, r.alias) for r in found.collect()} == {(1, "strasse"), (1, "finalen tor"), (1, "abc")}


def test_context_and_variants(spark):
    texts = spark.createDataFrame([(1, "見過李星河了")], "id long, text string")
    names = spark.createDataFrame([("李星河", 1)], "alias string, target_id int")
    row = O.overlap_matches(texts, names, "id", "text", F.lit(True), folded=True, variants={"見": "见", "過": "过"}, around=2).first()
    assert (row.before, row.after, row.start) == ("见过", "了", 2)


@pytest.mark.parametrize("code,sample,want", [("ZH_hant", None, ("zh-hant", "zh", "cjk", "dictionary", "zh")), ("ja", None, ("ja", "ja", "cjk", "cjk_bigram", "zh")), (None, "Just words here", ("en", "en", "whitespace", "whitespace", "en")), (None, "", ("zh", "zh", "cjk", "dictionary", "zh")), ("fr-FR", None, ("fr-fr", "fr", "whitespace", "whitespace", "en"))])
def test_policy(spark, code, sample, want):
    row = spark.createDataFrame([(code, sample)], "code string, sample string").select(P.policy(F.col("code"), F.col("sample")).alias("p")).first().p
    assert (row.language, row.base, row.family, row.tokenizer, row.words) == want and "。" in row.ends


def test_keys_and_labels(spark):
    rows = spark.createDataFrame([("Ｓｔｒaße", "  Best  FRIENDS ", "师徒关系", "关系", None, "「李星」")], "a string, b string, c string, d string, e string, f string")
    cjk, other = F.lit("cjk"), F.lit("whitespace")
    row = rows.select(P.match_key(F.col("a")), P.label_key(F.col("b"), other), P.label_key(F.col("c"), cjk), P.label_key(F.col("d"), cjk), P.match_key(F.col("e")), P.clean_token(F.lit("“李星。”"))).first()
    assert list(row) == ["strasse", "best friends", "师徒", "关系", None, "李星"]


RULES = Z.NameRules(singles="王李张", compounds=("欧阳",), noise="的说", translit="克斯尔特拉罗", titles=("王子",), common=("李子",))


def counts(df):
    return {r["name"]: r["count"] for r in df.collect()}


def test_names_found_in_runs(spark):
    texts = spark.createDataFrame([(1, "王小明见欧阳锋大侠，李子好吃。王小明笑"), (2, "王小明来，克斯尔王子和克斯尔王子，特拉")], "id long, text string")
    assert counts(Z.split_names(texts, "text", RULES)) == {"王小明": 3}
    assert counts(Z.split_names(texts, "text", RULES, least=1))["欧阳锋大"] == 1
    assert counts(Z.translit_spans(texts, "text", RULES)) == {"克斯尔王子": 2}
    assert [r.token for r in Z.zh_tokens(texts.filter("id = 2"), "id", "text").filter("n < 3").collect()] == ["王小", "小明", "明来"]


def chain(spark, lists):
    rows = [(k, n, t) for k, ts in enumerate(lists) for n, t in enumerate(ts)]
    tokens = spark.createDataFrame(rows, "id long, n int, token string")
    edges = Z.bound_edges(Z.fragment_pairs(tokens, RULES), RULES)
    return edges, tokens


def test_bound_fragments(spark):
    """A chain up to its title; a fork binds nothing; a ring has no start; rare and broken pairs do not bind."""
    lists = [["克斯", "尔特", "拉", "王子", "罗"]] * 4 + [["斯克", "拉特"]] * 3 + [["斯克", "特特"]] * 3 + [["罗罗", "罗尔", "罗罗"]] * 5 + [["拉拉", "尔尔"]] * 2 + [["特克", "，", "特罗"]] * 9
    edges, tokens = chain(spark, lists)
    got = {(r.first, r.name, r["count"], r.size) for r in Z.bound_names(edges, RULES).collect()}
    assert got == {("克斯", "克斯尔特拉王子", 4, 4)}
    counted = tokens.groupBy(F.col("token").alias("name")).agg(F.count("*").alias("count"))
    after = counts(Z.with_bound_names(counted, edges, RULES))
    assert after["克斯尔特拉王子"] == 4 and "克斯" not in after and after["罗"] == 4 and after["斯克"] == 6


def test_fragments_and_noise_go(spark):
    counted = spark.createDataFrame([("克斯尔王子", 5), ("克斯", 5), ("斯尔", 6), ("王子", 3), ("李星", 9), ("李星说", 2), ("高山的", 1)], "name string, count long")
    kept = Z.without_fragments(counted, RULES)
    assert counts(kept) == {"克斯尔王子": 5, "斯尔": 6, "李星": 9, "李星说": 2, "高山的": 1}
    assert counts(C.fold_onto(kept, RULES.without_noise(F.col("name")))) == {"克斯尔王子": 5, "斯尔": 6, "李星": 11, "高山的": 1}


def test_grown_surfaces(spark):
    blocks = spark.createDataFrame([(1, "去青云城。"), (2, "青云城门"), (3, "到青云城，青云子"), (4, "青云"), (5, "x")], "id long, text string")
    seeds = spark.createDataFrame([("青云",), ("a",)], "name string")
    occurrences = Z.grown_occurrences(blocks, seeds, RULES)
    got = {(r.id, r.start, r.surface, r.left, r.right) for r in occurrences.collect()}
    assert (1, 1, "青云城", "去", ".") in got and (2, 0, "青云城门", "^", "$") in got and (4, 0, "青云", "^", "$") in got and (3, 5, "青云子", ".", "$") in got
    assert all(len(s) <= 4 for _, _, s, _, _ in got)
    stats = {r.surface: r for r in Z.grown_surfaces(occurrences, seeds, RULES).collect()}
    assert (stats["青云"].n, stats["青云"].blocks, stats["青云"].kept) == (5, 4, True)
    assert (stats["青云城"].n, stats["青云城"].blocks) == (3, 3) and stats["青云城"].kept and not stats["青云子"].kept


def test_canonical_forms(spark):
    """李星说 stands for 李星, which stands for 李星河: a chain of three; a ring is left where it closes."""
    rows = [("李星说", 3, 3, 1.0, 1.0, 5.0), ("李星", 12, 10, 1.0, 1.0, 8.0), ("李星河", 11, 10, 2.0, 2.0, 12.0), ("云山", 8, 8, 0.5, 3.0, 6.0), ("青云山", 8, 8, 3.0, 3.0, 9.0), ("风铃", 5, 5, 2.0, 2.0, 4.0)]
    surfaces = spark.createDataFrame([(*r, True) for r in rows], "surface string, n long, blocks long, left double, right double, score double, kept boolean")
    held = {"李星说": range(3), "李星": range(10), "李星河": range(10), "云山": range(20, 28), "青云山": range(20, 28), "风铃": range(40, 45)}
    present = spark.createDataFrame([(s, k) for s, ks in held.items() for k in ks], "surface string, id long")
    canonical = Z.canonical_surfaces(surfaces, present, RULES)
    got = {r.surface: r.canonical for r in canonical.collect()}
    assert got == {"李星说": "李星河", "李星": "李星河", "李星河": "李星河", "云山": "青云山", "青云山": "青云山", "风铃": "风铃"}
    best = {r.canonical: r for r in Z.canonical_candidates(surfaces, present, canonical).collect()}
    assert best["李星河"].surfaces == ["李星河", "李星", "李星说"] and (best["李星河"].blocks, best["李星河"].n, best["李星河"].importance) == (10, 26, 20)
    ring = spark.createDataFrame([("甲", "乙"), ("乙", "甲")], "surface string, target string")
    walked = spark.sql(Z.FOLLOW, surfaces=spark.createDataFrame([("甲", True), ("乙", True)], "surface string, kept boolean"), edges=ring)
    ends = {r.surface: r.canonical for r in walked.groupBy("surface").agg(F.max_by("canonical", "steps").alias("canonical")).collect()}
    assert ends == {"甲": "乙", "乙": "甲"}


def test_rules_from_files(spark, tmp_path):
    for name, text in {"singles": "王李\n张\n", "compounds": "# two\n欧阳\n\n", "noise": "说 的", "translit": "克斯", "titles": "王子\n", "common": "天地\n"}.items():
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    rules = Z.NameRules.read(spark, str(tmp_path))
    assert (set(rules.singles), rules.compounds, set(rules.noise), rules.titles, rules.common) == (set("王李张"), ("欧阳",), set("说的"), ("王子",), ("天地",))


def test_counted_growth_equals_its_rows(spark):
    """Counts made where blocks lie equal those of the rows, also of blocks that share an id; none of the texts' places is a row."""
    from quillspark.operators import zh_growth as W

    texts = ["王小明说王小明来了，欧阳锋在大城。", "王小明 王小", "尔克斯特王子走了王小明的", "", None, "克斯特尔王子王子", "欧阳锋欧阳"]
    blocks = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, "小明王小明"), (None, "王小明了"), (None, "王小明了")], "id long, text string")
    seeds = spark.createDataFrame([(n,) for n in ("王小", "小明", "王小明", "欧阳", "克斯", "王子", "大城")], "name string")
    occurrences = Z.grown_occurrences(blocks, seeds, RULES)
    growth = W.Growth(blocks, seeds, RULES)
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    for mine, its in zip(growth.sides(), Z.surface_sides(occurrences), strict=True):
        assert rows(mine) == rows(its)
    present = occurrences.select("surface", "id").distinct().filter("id is not null")
    names = [r.surface for r in present.select("surface").distinct().collect()]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a != b and a in b], "short string, long string")
    alone = W.Growth(blocks.filter("id is not null"), seeds, RULES)
    assert rows(alone.both(pairs)) == rows(Z._overlaps(pairs, present))
    canonical = spark.createDataFrame([(n, n[:2]) for n in names], "surface string, canonical string")
    assert rows(alone.held(canonical)) == rows(present.join(canonical, "surface").select("canonical", "id").distinct().groupBy("canonical").count().withColumnRenamed("count", "blocks"))
    plan = growth.sides()[0]._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan
    pairs_of = {r.name: r["count"] for r in W.pair_counts(spark.createDataFrame([("王小明，小明",), (None,), ("明",), ("王小a小明",)], "text string"), "text").collect()}
    assert pairs_of == {"王小": 2, "小明": 3}


def test_overlap_query_counts_names_as_its_sql(spark, folder, tmp_path):
    """A long number as a name is none in Han texts; a name that ends in a mark may touch a word; an even number of pieces is no name."""
    from pathlib import Path

    import pyarrow as pa
    import pyarrow.parquet as pq
    from compare import compare

    from quillspark import plans

    for table in Path(folder).iterdir():
        (tmp_path / table.name).symlink_to(table) if table.name != "documents.parquet" else None
    texts = [("4397110767823743", "en"), ("ÄÖ 4397110767823743 Ö", "de"), ("+#~ + x", "de"), ("a+#~b +#~ c+b", "en"), ("#Ö und", "de"), ("x#Ö #Öz #Ö", "en"), ("##Ö", "fr"), (None, "de"), ("", "en"), ("Ada Bo", None), ("Ada Bo Ada", "es")]
    pq.write_table(pa.table({"doc_id": [6 * k for k in range(len(texts))], "text": [t for t, _ in texts], "lang": [c for _, c in texts], "source": ["s"] * len(texts), "n_chars": [len(t or "") for t, _ in texts]}), tmp_path / "documents.parquet")
    assert compare(spark, str(tmp_path), "overlap_matches", plans.QUERIES["overlap_matches"], plans.SQL["overlap_matches"]) == ""


def test_pieces_inside_names(spark):
    """Each piece's highest count among longer names that hold it, from one row a piece and batch."""
    names = spark.createDataFrame([("克斯尔", 3), ("斯尔特", 5), ("克斯", 9), ("斯", 2)], "name string, count long")
    pieces = spark.createDataFrame([("克斯",), ("斯尔",), ("斯",), ("克斯尔",), ("拉",), ("",), (None,)], "alias string")
    assert {(r.alias, r.most) for r in O.most_inside(names, pieces).collect()} == {("克斯", 3), ("斯尔", 5), ("斯", 9)}


def test_names_are_worked_out_once_and_texts_side_by_side(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(name):
        seen.add(1)
        return name

    rows = [(k, t, c) for k, (t, c) in enumerate([("Ada of Rome, ada", False), (None, False), ("", True), ("ada", False), ("xadax", True), ("xadax ", False), (" ada rome", False), ("da of Rome", False)])]
    texts = spark.createDataFrame(rows, "id long, text string, cjk boolean").coalesce(1)
    names = spark.createDataFrame([("Ada", 1), ("ada of", 2), ("dax", 3)], "alias string, target_id long").withColumn("alias", F.udf(counted).asNondeterministic()("alias"))
    for block in (1, 1 << 18):
        seen.value = 0
        monkeypatch.setattr(O, "BLOCK", block)
        found = {(r.id, r.start, r.end, r.target_id) for r in O.overlap_matches(texts, names, "id", "text", F.col("cjk"), folded=True).collect()}
        assert found == {(0, 0, 3, 1), (0, 13, 16, 1), (0, 0, 6, 2), (3, 0, 3, 1), (4, 1, 4, 1), (4, 2, 5, 3), (6, 1, 4, 1)} and seen.value == 3
    bits = np.full(1 << (O.MAP_BITS - 6), -1, np.int64)  # every substring may be a name
    where = [O._hits(part, np.array(cjk), [1, 2, 3, 7], bits) for part, cjk in (([t or "" for _, t, _ in rows], [c for *_, c in rows]), (["", ""], [False, True]))]
    assert not len(where[1][0])
    got = {(r, a, s) for r, a, s in zip(*map(np.ndarray.tolist, where[0]))}
    assert len(got) == len(where[0][0])
    at, want = 0, set()
    for k, text, cjk in rows:
        text = text or ""
        free = [True, *[not c.isalnum() for c in text], True]
        for a in range(len(text)):
            want |= {(k, at + a, s) for s in (1, 2, 3, 7) if a + s <= len(text) and (cjk or (a == 0 or free[a]) and (a + s == len(text) or free[a + s + 1]))}
        at += len(text)
    assert got == want


def test_few_other_strings_are_in_the_map_of_many_names(spark):
    lengths, bits = O._map_of(spark.range(400_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("alias")).repartition(4))
    text = "".join(f"m{k:06}" for k in range(200_000))
    batch = next(O._candidates([7], type("Map", (), {"value": bits}), 0)(iter([O.pa.RecordBatch.from_arrays([O.pa.array([1]), O.pa.array([text]), O.pa.array([True])], ["id", "text", "cjk"])])), None)
    assert lengths == [2, 3, 4, 5, 6, 7] and (batch is None or batch.num_rows < len(text) / 500)
    names = "".join(f"n{k}" for k in range(100_000, 110_000))
    batch = next(O._candidates([7], type("Map", (), {"value": bits}), 0)(iter([O.pa.RecordBatch.from_arrays([O.pa.array([1]), O.pa.array([names]), O.pa.array([True])], ["id", "text", "cjk"])])))
    assert set(range(0, len(names), 7)) <= set(batch.column("start").to_pylist())


def test_pairs_and_split_names_in_one_look(spark):
    """What the expression of split_names() finds, and pairs, from one look at the texts; letters are written as others or left out there."""
    import random

    from quillspark.operators import zh_growth as W

    draw = random.Random(4)
    rules = Z.NameRules(singles="王李司", compounds=("司马", "大城", "欧阳锋"), common=("王大", "李大城", "司马王李", "马大"))
    rows = ["".join(draw.choice("aebfdc x.") for _ in range(draw.randrange(60))) for _ in range(300)] + [None, ""]
    letters = {"a": "王", "b": "李", "c": "司", "d": "马", "e": "大", "f": "城", " ": "", ".": "。"}
    texts = spark.createDataFrame([(t,) for t in rows], "text string")
    plain = texts.select(W.written(F.col("text"), letters).alias("text"))
    got = [(r.name, r.split, r["count"]) for r in W.name_counts(texts, "text", rules, letters).collect()]
    assert {(n, c) for n, split, c in got if split and c >= 2} == {(r.name, r["count"]) for r in Z.split_names(plain, "text", rules).collect()}
    pairs = Z.zh_tokens(plain.withColumn("id", F.lit(1)), "id", "text").filter("length(token) = 2").groupBy("token").agg(F.count("*").alias("count"))
    assert {(n, c) for n, split, c in got if not split} == {(r.token, r["count"]) for r in pairs.collect()} and len({n for n, *_ in got}) > 30


def test_growth_cuts_and_writes_texts_where_they_lie(spark, monkeypatch):
    """Texts go to the tasks as they are; their blocks' counts equal those of the rows, also of texts that share an id, of more parts than one and of counts given out early."""
    import random

    from quillspark.operators import zh_growth as W

    draw = random.Random(5)
    letters = {"a": "王", "b": "小", "c": "明", "d": "的", "e": "克", "f": "斯", " ": "", ".": "。"}
    rows = [(k % 40, "".join(draw.choice("aabbccdef .x") for _ in range(draw.randrange(90)))) for k in range(45)] + [(90, None), (91, "abc" * 30)]
    texts = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    seeds = spark.createDataFrame([(n,) for n in ("王小", "小明", "王小明", "克斯", "明的", "小")], "name string")
    occurrences = Z.grown_occurrences(W.cut(texts.withColumn("text", W.written(F.col("text"), letters)), 7), seeds, RULES)
    growth = W.Growth(texts, seeds, RULES, 7, letters)
    rows_of = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    for mine, its in zip(growth.sides(), Z.surface_sides(occurrences), strict=True):
        assert rows_of(mine) == rows_of(its)
    present = occurrences.select("surface", "id").distinct()
    names = [r.surface for r in present.select("surface").distinct().collect()]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a != b and a in b], "short string, long string")
    assert rows_of(growth.both(pairs)) == rows_of(Z._overlaps(pairs, present))
    assert "translate" not in growth.alone.mapInArrow(W._counted(growth.seeds, growth.form), "surface string, side string, c string, seed boolean, n long, any long, own long")._jdf.queryExecution().executedPlan().toString()

    def counted():
        batch = W.pa.record_batch([W.pa.array([t for _, t in rows], W.pa.string())], ["text"])
        found = W.pa.Table.from_batches(list(W._counted(growth.seeds, growth.form)(iter([batch]))))
        return sorted(map(tuple, (r.values() for r in found.group_by(["surface", "side", "c", "seed"]).aggregate([(k, "sum") for k in ("n", "any", "own")]).to_pylist())), key=repr), found.num_rows

    whole, n = counted()
    monkeypatch.setattr(W, "PART", 20)
    parts, m = counted()
    assert whole == parts and n == m  # a task's parts are put together
    monkeypatch.setattr(W, "HELD", 64)
    early, k = counted()
    assert whole == early and k > n


def test_seeds_that_share_a_slot_are_told_apart(spark, monkeypatch):
    """Many seeds with the same upper bits of their hashes."""
    from quillspark.operators import zh_growth as W

    names = [a + b for a in "王小明克斯" for b in "王小明克斯尔"]
    seeds = spark.createDataFrame([(n,) for n in names], "name string")
    blocks = spark.createDataFrame([(1, "王小明克斯尔王王小斯明"), (2, "克小斯王尔明")], "id long, text string")
    its = Z.surface_sides(Z.grown_occurrences(blocks, seeds, RULES))[1]
    monkeypatch.setattr(W, "SEED_BITS", 2)
    growth = W.Growth(blocks, seeds, RULES)
    assert growth.seeds.value.depth > 3
    batch = W.pa.record_batch([W.pa.array(["王小明克斯尔王王小斯明", "克小斯王尔明"])], ["text"])
    found = next(W._counted(growth.seeds, growth.form)(iter([batch]))).to_pylist()
    got = {r["surface"] for r in found if r["side"] is None and (r["own"] or r["any"])}
    assert {r.surface for r in its.collect()} <= got and set(names) & got == {n for n in names if any(n in t for t in ("王小明克斯尔王王小斯明", "克小斯王尔明"))}


def test_surfaces_alone_are_not_looked_for_again(spark):
    """A name with one surface has that surface's blocks; the texts are looked at for the others only."""
    rows = [("李星", 12, 10, 8.0), ("李星河", 11, 9, 12.0), ("风铃", 5, 4, 4.0)]
    surfaces = spark.createDataFrame(rows, "surface string, n long, blocks long, score double")
    canonical = spark.createDataFrame([("李星", "李星河"), ("李星河", "李星河"), ("风铃", "风铃")], "surface string, canonical string")
    asked = []

    class Present:
        def held(self, names):
            asked.extend(map(tuple, names.collect()))
            return names.groupBy("canonical").agg(F.lit(11).cast("long").alias("blocks"))

    best = {r.canonical: r for r in Z.canonical_candidates(surfaces, Present(), canonical).collect()}
    assert sorted(asked) == [("李星", "李星河"), ("李星河", "李星河")]
    assert (best["李星河"].blocks, best["风铃"].blocks, best["风铃"].importance) == (11, 4, 6)

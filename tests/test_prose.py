"""Phrases that repeat and sentences that run on, against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import phrases

WORD, CJK = re.compile(r"[^\W_]+(?:['’][^\W_]+)*"), "㐀-䶿一-鿿぀-ヿ가-힯"


def by_hand(text, family):
    """The best phrases of a text: all grams counted, then sorted."""
    out, runs = {}, {"whitespace": [], "cjk": []}
    if family != "cjk":
        runs["whitespace"] = [WORD.findall((text or "").lower())]
    if family != "whitespace":
        runs["cjk"] = [list(r) for r in re.findall(f"[{CJK}]+", text or "")]
    for kind, sizes, gap in (("whitespace", (3, 4, 5), " "), ("cjk", (3, 4, 5, 6), "")):
        grams = [(gap.join(r[k : k + n]), (j, k)) for j, r in enumerate(runs[kind]) for n in sizes for k in range(len(r) - n + 1)]
        first = {}
        for gram, at in grams:
            first[gram] = min(at, first.get(gram, at))
        often = [(-c, -len(g), first[g], g) for g, c in Counter(g for g, _ in grams).items() if c >= 3]
        if often:
            out[kind] = (min(often)[3], -min(often)[0])
    return out


def test_repeated_phrases(spark, monkeypatch):
    rnd = random.Random(5)
    words, han = ["it's", "so", "He", "Über", "x1"], "王李张한글かな"
    texts = [None, "", "one two three", "a b c " * 3, "a b. c d\n" * 3000, "王李张" * 4, "王李张。李张王。" * 3]
    for _ in range(120):
        texts.append(rnd.choice([" ", ", "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) + "".join(rnd.choice(han + "。 ") for _ in range(rnd.randint(0, 80))))
    rows = [(k // 2 if k < 6 else k, t, [None, "cjk", "whitespace", "both"][rnd.randrange(4)], "z") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, kind string, gram string")
    for tokens in (1 << 20, 50):
        monkeypatch.setattr(phrases, "TOKENS", tokens)
        got = [tuple(r) for r in phrases.repeated_phrases(df.coalesce(1), "id", "text", F.col("kind")).collect()]
        want = [(i, kind, gram, count) for i, t, family, _ in rows for kind, (gram, count) in by_hand(t, family or "both").items()]
        assert Counter(got) == Counter(want) and {g[1] for g in got} == {"whitespace", "cjk"}
    assert phrases.repeated_phrases(df.filter("false"), "id", "text", F.lit(None).cast("string")).count() == 0
    null_ids = spark.createDataFrame([(None, "a b c " * 3)], "id string, text string")
    assert [tuple(r) for r in phrases.repeated_phrases(null_ids, "id", "text", F.lit("both")).collect()] == [(None, "whitespace", "a b c", 3)]


def test_abnormal_sentences(spark):
    long_cjk, long_words = "王" * 201 + "…", "w " * 61 + "!"
    rows = [(1, f"王。{long_cjk}"), (2, f"Short. {long_words}"), (3, "王" * 300 + "\n" + "w " * 99), (4, None), (5, ""), (6, "한" * 201 + ". " + "w " * 60 + "."), (7, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = lambda family: sorted(map(tuple, phrases.abnormal_sentences(df, "id", "text", F.lit(family)).collect()))
    assert got("both") == [(1, "cjk_chars", 1, 201), (2, "words", 1, 62), (6, "cjk_chars", 0, 201), (6, "words", 1, 61)]
    assert {r[1] for r in got("cjk")} == {"cjk_chars"} and {r[1] for r in got("whitespace")} == {"words"}

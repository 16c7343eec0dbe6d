"""Scalar functions on small tables of cases."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in df.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_chinese_numbers(spark):
    cases = {"一": 1, "十": 10, "十二": 12, "二十": 20, "二十一": 21, "一百零五": 105, "三百二十": 320, "一千零一": 1001, "两万三千": 23000, "12": 12, "零": None, "": None, "abc": None}
    assert column(spark, cases, T.chinese_number) == list(cases.values())


def test_source_numbers(spark):
    cases = {"IV": 4, "xii": 12, "MCMXCIV": 1994, "１２": 12, "IIII": None, "七": 7}
    assert column(spark, cases, T.source_number) == list(cases.values())


@pytest.mark.parametrize(("text", "lang"), [("", "en"), ("hello there", "en"), ("你好，世界", "zh"), ("こんにちは世界", "ja"), ("안녕하세요 여러분", "ko"), ("A long English text with one 字 in it", "en")])
def test_language(spark, text, lang):
    assert column(spark, [text], T.detect_language) == [lang]


def test_fold_is_compatible_and_caseless(spark):
    assert column(spark, ["ＡＢＣ", "Straße", None], T.fold) == ["abc", "strasse", None]


def test_boundaries(spark):
    rows = spark.createDataFrame([("the cat", 5, 3), ("the cats", 5, 3), ("a-cat", 3, 3), ("cat", 1, 3)], "t string, s int, n int")
    got = [r[0] for r in rows.select(T.has_boundaries(F.col("t"), F.col("s"), F.col("n"), F.lit(False))).collect()]
    assert got == [True, False, False, True]


def test_trim_to_sentence(spark):
    text = "One two. Three four five. Six"
    assert column(spark, [text], lambda c: T.trim_to_sentence(c, 12)) == ["One two."]
    assert column(spark, [text], lambda c: T.trim_to_sentence(c, 12, 20)) == ["One two. Three four five."]
    assert column(spark, ["abcdef"], lambda c: T.trim_to_sentence(c, 3)) == ["abc"]


def test_think_blocks_and_labels(spark):
    assert column(spark, ["<think>x\ny</think> Answer: yes", "plain"], T.strip_thinking) == ["yes", "plain"]
    assert column(spark, ["Sworn  Enemy Relation", "师徒关系", "relation"], T.canonical_label) == ["sworn enemy", "师徒", "relation"]


def test_request_hash_ignores_order(spark):
    df = spark.sql("select map('a', '1', 'b', '2') as x, map('b', '2', 'a', '1') as y")
    assert df.select(T.request_hash(F.col("x")) == T.request_hash(F.col("y"))).first()[0]

"""Chinese name shapes, from word lists given by the user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A small default list; give your own for real texts.
SURNAMES = ("王", "李", "张", "刘", "陈", "杨", "赵", "黄", "周", "吴", "欧阳", "司马")


def _any(words: Sequence[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def looks_like_person(token: Column, surnames: Sequence[str] = SURNAMES) -> Column:
    """A surname and one or two more Han characters."""
    return token.rlike(f"^{_any(surnames)}[\\x{{4E00}}-\\x{{9FFF}}]{{1,2}}$")


def split_names(text: Column, surnames: Sequence[str] = SURNAMES) -> Column:
    """Names found from left to right in Han text, the longest surname first: a surname and up to two more characters."""
    return F.regexp_extract_all(text, F.lit(f"{_any(surnames)}[\\x{{4E00}}-\\x{{9FFF}}]{{1,2}}"), F.lit(0))


def recovered_counts(texts: DataFrame, text_col: str, surnames: Sequence[str] = SURNAMES, least: int = 2) -> DataFrame:
    """(name, count) of the names found at least that often."""
    rows = texts.select(F.explode(split_names(F.col(text_col), surnames)).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("count")).filter(F.col("count") >= least)


def merge_counts(counted: DataFrame, recovered: DataFrame) -> DataFrame:
    """Both tables' names with the larger count."""
    both = counted.select("name", F.col("count").alias("a")).join(recovered.select("name", F.col("count").alias("b")), "name", "full_outer")
    return both.select("name", F.greatest("a", "b").alias("count"))


def bigrams(text: Column) -> Column:
    """Neighbouring pairs of characters of the runs between punctuation: the tokeniser without a dictionary."""
    runs = F.filter(F.split(text, r"[\s\p{P}]+"), lambda r: F.length(r) >= 2)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))))

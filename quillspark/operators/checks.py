"""Quality checks of generated text: each gives (version, code, term, evidence) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Possessive, so that a long run takes no stack.
WORD = r"[\p{L}\p{N}]++(?:['’][\p{L}\p{N}]++)*+"
SPACED = r"[^\x20\x09-\x0D]+"
SENTENCE = r"[^.!?。！？…]+[.!?。！？…]*"


def long_paragraphs(texts: DataFrame, id_col: str, text_col: str, words: int = 250, cjk: int = 600) -> DataFrame:
    """(version, paragraph, words) for paragraphs, between blank lines, of too many words, which lie between blanks, or CJK characters."""
    parts = F.split(F.col(text_col), r"\n[ \t]*\n")
    rows = texts.select(F.col(id_col).alias("version"), F.posexplode(parts).alias("paragraph", "p"))
    counted = rows.select("version", "paragraph", F.regexp_count("p", F.lit(SPACED)).cast("long").alias("words"), F.regexp_count("p", F.lit(r"[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]")).alias("cjk"))
    return counted.filter((F.col("words") > words) | (F.col("cjk") > cjk)).select("version", "paragraph", "words")


def long_sentences(texts: DataFrame, id_col: str, text_col: str, words: int = 60) -> DataFrame:
    """(version, sentence, words) for sentences of too many words, which lie between blanks."""
    rows = texts.select(F.col(id_col).alias("version"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(SENTENCE), F.lit(0))).alias("sentence", "s"))
    return rows.select("version", "sentence", F.regexp_count("s", F.lit(SPACED)).cast("long").alias("words")).filter(F.col("words") > words)


def phrase_hits(texts: DataFrame, id_col: str, text_col: str, phrases: Sequence[str]) -> DataFrame:
    """(version, phrase, at): the first place of each phrase, whatever the case; without a shuffle."""
    low = F.lower(F.col(text_col))
    found = F.array(*[F.struct(F.lit(p).alias("phrase"), F.instr(low, p).alias("at")) for p in phrases])
    return texts.select(F.col(id_col).alias("version"), F.explode(F.filter(found, lambda x: x["at"] > 0)).alias("f")).select("version", "f.phrase", F.col("f.at").cast("long").alias("at"))


def quoted_terms(text: Column) -> Column:
    """Terms in quotation marks or brackets of 2 to 30 characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\"“「『\[]([\p{L}][^\"”」』\]\n]{1,29})[\"”」』\]]"), F.lit(1)))


def named_terms(text: Column) -> Column:
    """Runs of two or three capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,2}"), F.lit(0)))


def drift(texts: DataFrame, terms: Column, known: DataFrame, id_col: str, recent_col: str) -> DataFrame:
    """(version, term): terms that are not known (term) and not in the recent text; a left-anti join on the term."""
    rows = texts.select(F.col(id_col).alias("version"), F.col(recent_col).alias("recent"), F.explode(terms).alias("term"))
    rows = rows.filter(~F.contains(F.coalesce("recent", F.lit("")), F.col("term"))).select("version", "term").distinct()
    return rows.withColumn("k", F.lower("term")).join(known.select(F.lower("term").alias("k")).distinct(), "k", "left_anti").select("version", "term")


def all_warnings(*tables: tuple[str, DataFrame, Column]) -> DataFrame:
    """(version, code, evidence) of several checks."""
    out = None
    for code, df, evidence in tables:
        rows = df.select("version", F.lit(code).alias("code"), evidence.cast("string").alias("evidence"))
        out = rows if out is None else out.unionByName(rows)
    return out


def by_version(warnings: DataFrame) -> DataFrame:
    """Warnings numbered in order of version, code and evidence."""
    return warnings.withColumn("nth", F.row_number().over(Window.partitionBy("version").orderBy("code", "evidence")))

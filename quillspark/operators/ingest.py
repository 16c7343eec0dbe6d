"""From raw texts to chapters: headings, cleaning, windows and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: (language, pattern) with groups label, number and title; one language's first match wins for a text.
HEADINGS = [
    ("zh", r"^\s*(第([0-9０-９零〇一二两三四五六七八九十百千万]+)[章回节卷])\s*[::、.\s]*(.{0,40})$"),
    ("ja", r"^\s*(第([0-9０-９一二三四五六七八九十百千]+)話)\s*[::\s]*(.{0,40})$"),
    ("ko", r"^\s*(제?\s*([0-9]+)\s*[장화])\s*[::.\s]*(.{0,40})$"),
    ("en", r"(?i)^\s*(chapter\s+([0-9]+|[ivxlcdm]+))\b\s*[::.\-\s]*(.{0,60})$"),
]


def lines_of(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, line) for each line; a text is split where it lies, without a shuffle."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), "\n", -1)).alias("n", "line"))


def heading_language(lines: DataFrame, order: Sequence[tuple[str, str]] = HEADINGS) -> DataFrame:
    """For each text the first language of order whose pattern matches any of its lines."""
    rank = F.array_min(F.array(*[F.when(F.col("line").rlike(p), k) for k, (_, p) in enumerate(order)]))
    return lines.withColumn("rank", rank).filter("rank is not null").groupBy("id").agg(F.min("rank").alias("rank"))


def split_chapters(texts: DataFrame, id_col: str, text_col: str, order: Sequence[tuple[str, str]] = HEADINGS) -> DataFrame:
    """(id, chapter, label, number, title, content): the text between headings, trimmed.

    Text before the first heading is dropped; a text without headings is one chapter without title.
    """
    lines = lines_of(texts, id_col, text_col)
    known = lines.join(heading_language(lines, order), "id", "left")
    pattern = F.element_at(F.array(*[F.lit(p) for _, p in order]), F.coalesce(F.col("rank"), F.lit(0)) + 1)
    is_heading = F.coalesce(F.expr("rank is not null") & F.regexp_like("line", pattern), F.lit(False))
    chapter = F.sum(is_heading.cast("int")).over(Window.partitionBy("id").orderBy("n"))
    marked = known.withColumns({"is_heading": is_heading, "chapter": chapter}).filter("chapter > 0 or rank is null")
    marked = marked.withColumn("chapter", F.when(F.col("rank").isNull(), 1).otherwise(F.col("chapter")))
    part = lambda k: F.max(F.when(F.col("is_heading"), F.call_function("regexp_extract", F.col("line"), pattern, F.lit(k))))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("n", "line"))))
    out = marked.groupBy("id", "chapter").agg(part(1).alias("label"), T.source_number(part(2)).alias("number"), F.nullif(F.trim(part(3)), F.lit("")).alias("title"), body.alias("body"))
    return out.withColumn("content", F.regexp_replace(F.array_join(F.transform("body", lambda b: b["line"]), "\n"), r"^\s+|\s+$", "")).drop("body")


def clean_lines(texts: DataFrame, id_col: str, text_col: str, phrases: Sequence[str]) -> DataFrame:
    """(id, text, dropped): each text without boilerplate lines and with no more than one blank line in a row, without a shuffle."""
    split = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(split, lambda line: ~T.is_boilerplate(line, phrases))
    return texts.select(F.col(id_col).alias("id"), T.normal_chapter(F.array_join(kept, "\n")).alias("text"), (F.size(split) - F.size(kept)).cast("long").alias("dropped"))


def latest_rows(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The row of greatest order for each key."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter("r = 1").drop("r")


def window_starts(length: Column, size: int = 500, step: int = 250) -> Column:
    """Where windows of size characters begin, every step, the last flush with the end."""
    last = length - size
    return F.when(length <= 0, F.array().cast("array<int>")).when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))))


def chunks(texts: DataFrame, id_col: str, text_col: str, size: int = 7000, overlap: int = 500, most: int | None = None) -> DataFrame:
    """(id, chunk, content): the trimmed chunks of size characters that overlap, all or the first most."""
    text = F.col(text_col)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1 - overlap), F.lit(size - overlap))
    starts = starts if most is None else F.slice(starts, 1, most)
    rows = texts.select(F.col(id_col).alias("id"), text.alias("t"), F.posexplode(starts).alias("chunk", "at"))
    return rows.select("id", "chunk", F.trim(F.substring("t", F.col("at") + 1, F.lit(size))).alias("content")).filter("content <> ''")


def sync_actions(stored: DataFrame, given: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """insert, update, delete or keep for each key of two tables."""
    both = stored.select(*key, F.col(value).alias("old"), F.lit(True).alias("has_old")).join(given.select(*key, F.col(value).alias("new"), F.lit(True).alias("has_new")), list(key), "full_outer")
    action = F.when(F.col("has_old").isNull(), "insert").when(F.col("has_new").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    return both.select(*key, action.alias("action"))


def best_duplicate(novels: DataFrame, by: str, score: Column) -> DataFrame:
    """Of rows of equal by, which one stays: the highest score, then the highest id."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("id"))
    return novels.withColumn("score", score).withColumn("stays", F.row_number().over(order) == 1)

"""Chapters of books that come in pieces: no book, chapter or long line is ever gathered in one row.

A piece may end anywhere, even inside a heading or between \\r and \\n. What a piece needs from those
before it are sums over pieces: how many line ends and how many headings. Only lines that cross a
border, and are short enough for a heading, are put together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled
from .ingest import HEADINGS

#: A longer line is no heading.
LONGEST_HEADING = 1000


def pieces_of(texts: DataFrame, id_col: str, text_col: str, size: int = 1 << 20) -> DataFrame:
    """(id, n, text): texts in pieces of size characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text_col) - 1) / size)).cast("int"))
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.explode(starts).alias("n"))
    return rows.select("id", "n", F.substring("t", F.col("n") * size + 1, F.lit(size)).alias("text"))


def _fragments(pieces: DataFrame) -> DataFrame:
    """(id, n, k, line, fragment, ends): the parts of lines in each piece; line counts through the book, k in the piece."""
    book = Window.partitionBy("id").orderBy("n")
    marks = pieces.select("id", "n", F.right("text", F.lit(1)).alias("last")).withColumn("after_cr", F.coalesce(F.lag("last").over(book) == "\r", F.lit(False))).select("id", "n", "after_cr")
    joined = pieces.join(marks, ["id", "n"])
    rest = F.when(F.col("after_cr") & F.startswith("text", F.lit("\n")), F.substring("text", F.lit(2), F.length("text"))).otherwise(F.col("text"))
    lines = joined.select("id", "n", F.split(F.regexp_replace(rest, "\r\n?", "\n"), "\n", -1).alias("parts"))
    before = lines.select("id", "n", (F.size("parts") - 1).alias("ends")).withColumn("before", F.coalesce(F.sum("ends").over(book.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("id", "n", "before")
    rows = lines.join(before, ["id", "n"]).select("id", "n", "before", (F.size("parts") - 1).alias("ends"), F.posexplode("parts").alias("k", "fragment"))
    return rows.select("id", "n", "k", (F.col("before") + F.col("k")).alias("line"), "fragment", "ends")


def split_pieces(pieces: DataFrame, order: Sequence[tuple[str, str]] = HEADINGS, longest: int = LONGEST_HEADING) -> tuple[DataFrame, DataFrame]:
    """Chapters (id, chapter, label, number, title) and their text in parts (id, chapter, n, text), from pieces (id, n, text).

    A chapter's parts in order of n, joined by nothing, are its text. As in split_chapters the first language of
    order with a heading decides, text before the first heading is dropped, and a book without
    headings is one chapter without title. Null pieces are empty.
    """
    fragments = settled(_fragments(pieces.withColumn("text", F.coalesce("text", F.lit("")))))
    inner = fragments.filter((F.col("k") > 0) & (F.col("k") < F.col("ends"))).select("id", "line", F.col("fragment").alias("text"))
    crossing = fragments.filter((F.col("k") == 0) | (F.col("k") == F.col("ends")))
    sizes = crossing.groupBy("id", "line").agg(F.sum(F.length("fragment")).alias("size")).filter(F.col("size") <= longest).select("id", "line")
    whole = crossing.filter("fragment <> ''").join(sizes, ["id", "line"]).groupBy("id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "fragment"))), lambda f: f["fragment"]), "").alias("text"))
    lines = inner.filter(F.length("text") <= longest).unionByName(whole)
    rank = F.array_min(F.array(*[F.when(F.col("text").rlike(p), k) for k, (_, p) in enumerate(order)]))
    candidates = lines.withColumn("rank", rank).filter("rank is not null")
    chosen = candidates.groupBy("id").agg(F.min("rank").alias("best"))
    pattern = F.element_at(F.array(*[F.lit(p) for _, p in order]), F.col("best") + 1)
    heads = settled(candidates.join(chosen, "id").filter(F.regexp_like("text", pattern)))
    part = lambda k: F.call_function("regexp_extract", F.col("text"), pattern, F.lit(k))
    named = heads.select("id", "line", part(1).alias("label"), T.source_number(part(2)).alias("number"), F.nullif(F.trim(part(3)), F.lit("")).alias("title"))
    flags = heads.select("id", "line", F.lit(True).alias("head"))
    marked = fragments.join(flags, ["id", "line"], "left").withColumn("head", F.coalesce("head", F.lit(False)))
    opens = (F.col("head") & ((F.col("k") > 0) | (F.col("n") == F.min("n").over(Window.partitionBy("id"))))).cast("int")
    marked = marked.withColumn("opens", opens)
    book = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = marked.groupBy("id", "n").agg(F.sum("opens").alias("opened")).withColumn("before", F.coalesce(F.sum("opened").over(book), F.lit(0))).select("id", "n", "before")
    chapter = F.col("before") + F.sum("opens").over(Window.partitionBy("id", "n").orderBy("k"))
    placed = marked.join(before, ["id", "n"]).withColumn("chapter", chapter).join(chosen.select("id", F.lit(True).alias("has")), "id", "left")
    placed = placed.withColumn("chapter", F.when(F.col("has"), F.col("chapter")).otherwise(1)).filter("chapter > 0")
    texts = placed.filter(~F.col("head")).groupBy("id", "chapter", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "fragment"))), lambda f: f["fragment"]), "\n").alias("text"))
    titles = placed.filter("opens = 1").select("id", "line", "chapter").join(named, ["id", "line"]).drop("line")
    bare = pieces.select("id").distinct().join(chosen.select("id"), "id", "left_anti").select("id", F.lit(1).cast("long").alias("chapter"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("title"))
    return titles.select("id", F.col("chapter").cast("long").alias("chapter"), "label", "number", "title").unionByName(bare), texts.select("id", F.col("chapter").cast("long").alias("chapter"), "n", "text")


def gathered(chapters: DataFrame, parts: DataFrame) -> DataFrame:
    """Chapters with their whole text, trimmed, as content: for books whose chapters fit in a row."""
    whole = parts.groupBy("id", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]), "").alias("content"))
    return chapters.join(whole, ["id", "chapter"], "left").withColumn("content", F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", ""))

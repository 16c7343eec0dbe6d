"""Greedy segmentation of chapters, which depends on each cut before, as a Python table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .match import progress_bucket

#: Characters: least of a segment, most that is liked, most; a tail below joins the last if both stay within.
LEAST, SOFT, HARD, TAIL, JOINED = 220, 520, 700, 160, 820
_BOUNDARY = re.compile(r"\n[ \t]*\n+|[.!?。！？…]+[\"'”’」』）)\]]*")


def cuts(text: str) -> list[tuple[int, int]]:
    """(start, end) of the segments: the first boundary from LEAST to SOFT, else up to HARD, else HARD."""
    ends = [m.end() for m in _BOUNDARY.finditer(text)]
    out, at, k = [], 0, 0
    while at < len(text):
        while k < len(ends) and ends[k] < at + LEAST:
            k += 1
        end = ends[k] if k < len(ends) and ends[k] <= at + HARD else min(len(text), at + HARD)
        if len(text) - at <= LEAST:
            end = len(text)
        out.append((at, end))
        at = end
    if len(out) > 1 and out[-1][1] - out[-1][0] < TAIL and out[-1][1] - out[-2][0] <= JOINED:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


@udtf(returnType="ordinal int, start_pos int, end_pos int")
class SegmentText:
    def eval(self, text: str) -> Iterator[tuple[int, int, int]]:
        for k, (a, b) in enumerate(cuts(text or "")):
            yield k, a, b


def segment(spark: SparkSession, chapters: DataFrame) -> DataFrame:
    """(novel_id, chapter_id, segment_id, start_pos, end_pos, bucket, prev_id, next_id) from chapters (novel_id, chapter_id, content).

    A segment's bucket needs its rank in the book: chapters' counts are summed first, so no window
    holds a book's segments.
    """
    spark.udtf.register("segment_text", SegmentText)
    chapters.createOrReplaceTempView("chapters_to_segment")
    rows = spark.sql("select novel_id, chapter_id, s.* from chapters_to_segment, lateral segment_text(content) s")
    per = rows.groupBy("novel_id", "chapter_id").agg(F.count("*").alias("n"))
    book = Window.partitionBy("novel_id")
    offsets = per.select("novel_id", "chapter_id", F.coalesce(F.sum("n").over(book.orderBy("chapter_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(book).alias("total"))
    ids = rows.withColumn("segment_id", F.shiftleft(F.col("chapter_id").cast("long"), 16) + F.col("ordinal"))
    chapter = Window.partitionBy("novel_id", "chapter_id").orderBy("ordinal")
    out = ids.join(offsets, ["novel_id", "chapter_id"]).withColumns({"prev_id": F.lag("segment_id").over(chapter), "next_id": F.lead("segment_id").over(chapter)})
    return out.select("novel_id", "chapter_id", "segment_id", "start_pos", "end_pos", progress_bucket(F.col("before") + F.col("ordinal"), F.col("total")).alias("bucket"), "prev_id", "next_id")

"""Evidence handles opened: what they point to, widened, merged where they overlap, and read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_handle(segment_id: Column) -> Column:
    return F.concat(F.lit("segment::"), segment_id.cast("string"))


def range_handle(chapter_id: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("::", F.lit("range"), chapter_id.cast("string"), start.cast("string"), end.cast("string"))


def resolved(asked: DataFrame, segments: DataFrame, neighbours: int = 0) -> DataFrame:
    """(request, handle, kind, chapter_id, start, end) of asked (request, handle), each once a request.

    kind is segment or range, or unknown for handles of another form and segments that do not exist; those have no place.
    segments are (segment_id, chapter_id, ordinal, start_pos, end_pos); with neighbours a segment's handle also
    covers so many segments of its chapter before and after it.
    """
    parts = F.split("handle", "::")
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("long")
    rows = asked.select("request", "handle").distinct().withColumns({"form": F.element_at(parts, 1), "size": F.size(parts), "segment_id": number(2)})
    direct = rows.filter((F.col("form") == "range") & (F.col("size") == 4)).select("request", "handle", number(2).alias("chapter_id"), number(3).alias("start"), number(4).alias("end")).filter("chapter_id is not null and start is not null and end is not null and start <= end")
    named = rows.filter((F.col("form") == "segment") & (F.col("size") == 2)).join(segments.select("segment_id", "chapter_id", "ordinal"), "segment_id")
    near = named.withColumn("at", F.explode(F.sequence(F.col("ordinal") - neighbours, F.col("ordinal") + neighbours))) if neighbours else named.withColumn("at", F.col("ordinal"))
    held = near.select("request", "handle", "chapter_id", F.col("at").alias("ordinal")).join(segments.select("chapter_id", "ordinal", "start_pos", "end_pos"), ["chapter_id", "ordinal"])
    covered = held.groupBy("request", "handle", "chapter_id").agg(F.min("start_pos").cast("long").alias("start"), F.max("end_pos").cast("long").alias("end"))
    found = covered.withColumn("kind", F.lit("segment")).unionByName(direct.withColumn("kind", F.lit("range")))
    lost = rows.select("request", "handle").join(found.select("request", "handle"), ["request", "handle"], "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    return found.select("request", "handle", "kind", "chapter_id", "start", "end").unionByName(lost.select("request", "handle", F.lit("unknown").alias("kind"), none("long").alias("chapter_id"), none("long").alias("start"), none("long").alias("end")))


def merged(places: DataFrame, lengths: DataFrame, before: int = 200, after: int = 1200) -> DataFrame:
    """(request, chapter_id, start, end, handles): places widened, kept inside their chapter (chapter_id, length), and put together where they overlap or touch."""
    wide = places.filter("kind <> 'unknown'").join(lengths, "chapter_id").withColumns({"start": F.greatest(F.lit(0), F.col("start") - before), "end": F.least(F.col("length"), F.col("end") + after)}).filter("start < end")
    chapter = Window.partitionBy("request", "chapter_id").orderBy("start", "end", "handle")
    reach = F.max("end").over(chapter.rowsBetween(Window.unboundedPreceding, -1))
    flagged = wide.withColumn("reach", reach).withColumn("opens", (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int"))
    islands = flagged.withColumn("island", F.sum("opens").over(chapter))
    return islands.groupBy("request", "chapter_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("handle")).alias("handles")).drop("island")


def read(ranges: DataFrame, chapters: DataFrame) -> DataFrame:
    """Ranges with their text from chapters (chapter_id, content): each character of a request once."""
    texts = ranges.join(chapters.select("chapter_id", "content"), "chapter_id")
    return texts.withColumn("text", F.substring("content", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))).drop("content")


"""Dictionary matches in texts, and what they make relevant."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import match_key
from ..functions.text import MARKS

#: Bits of the map of names that is sent to all, as a power of two; words whose answer a task remembers; a cell of a text in which matches meet segments.
MAP_BITS, REMEMBERED, CELL = 24, 1 << 20, 1024
_BLANK = re.compile(r"[ \t\n\r]")


def alias_table(targets: DataFrame) -> DataFrame:
    """(alias, target_id) from targets (target_id, rank, names array): the first target that has an alias owns it."""
    rows = targets.select("target_id", "rank", F.posexplode("names").alias("pos", "alias")).filter(F.trim("alias") != "")
    first = F.min_by("target_id", F.struct("rank", "pos", "target_id"))
    return rows.groupBy("alias").agg(first.alias("target_id"))


def keyword_index(targets: DataFrame) -> DataFrame:
    """(keyword, target_id, display): names, folded, that mean one target; the shortest, then least, spelling is shown."""
    rows = targets.select("target_id", F.explode("names").alias("name")).filter(F.trim("name") != "").withColumn("keyword", match_key(F.trim("name")))
    by = rows.groupBy("keyword").agg(F.min("target_id").alias("target_id"), F.max("target_id").alias("other"), F.min(F.struct(F.length("name").alias("n"), "name")).alias("d"))
    return by.filter("target_id = other").select("keyword", "target_id", F.col("d.name").alias("display"))


def token_grams(toks: DataFrame, most: int) -> DataFrame:
    """(id, start, end, n, gram): runs of one to most neighbouring tokens, joined by a blank."""
    order = Window.partitionBy("id").orderBy("n")
    rows = toks
    for k in range(1, most):
        rows = rows.withColumns({f"t{k}": F.lead("token", k).over(order), f"s{k}": F.lead("start", k).over(order)})
    runs = []
    for k in range(most):
        parts = [F.col("token"), *[F.col(f"t{j}") for j in range(1, k + 1)]]
        last_start, last = (F.col(f"s{k}"), F.col(f"t{k}")) if k else (F.col("start"), F.col("token"))
        runs.append(F.when(last.isNotNull(), F.struct(F.concat_ws(" ", *parts).alias("gram"), (last_start + F.length(last)).alias("end"))))
    return rows.select("id", "n", "start", F.explode(F.array_compact(F.array(*runs))).alias("g")).select("id", "n", "start", "g.end", "g.gram")


def matches(toks: DataFrame, aliases: DataFrame, most_words: int = 3, fold_case: bool = False) -> DataFrame:
    """(id, start, end, alias, target_id) for every run of tokens that is an alias: an equi-join on grams, no scan of the dictionary."""
    grams = token_grams(toks, most_words)
    key = F.lower("gram") if fold_case else F.col("gram")
    return grams.withColumn("alias", key).join(aliases, "alias").select("id", "start", "end", "alias", "target_id")


class _Known(dict):
    """Whether a run of words may be a name, by the map; a key that is new is looked up once."""

    def __init__(self, bit_map: bytes):
        self.map = bit_map

    def __missing__(self, gram: str) -> bool:
        spot = zlib.crc32(gram.encode("utf-8", "surrogatepass")) & ((1 << MAP_BITS) - 1)
        if len(self) >= REMEMBERED:
            self.clear()
        self[gram] = found = bool(self.map[spot >> 3] >> (spot & 7) & 1)
        return found


def _runs(most: int, bit_map):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(bit_map.value)
        for batch in batches:
            row, starts, ends, grams = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words, places, at = [], [], 0
                for raw in _BLANK.split(text or ""):
                    word = raw.strip(MARKS)
                    if word:
                        words.append(word)
                        places.append(at + (len(raw) - len(raw.lstrip(MARKS)) if raw[0] != word[0] else 0))
                    at += len(raw) + 1
                for k in range(most):
                    runs = words if k == 0 else [" ".join(words[j : j + k + 1]) for j in range(len(words) - k)]
                    for j, gram in enumerate(runs):
                        if known[gram]:
                            row.append(i)
                            starts.append(places[j])
                            ends.append(places[j + k] + len(words[j + k]))
                            grams.append(gram)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(grams, pa.string())], ["id", "start", "end", "alias"])

    return run


def _words(text: str | None) -> list[str]:
    return [w for w in (raw.strip(MARKS) for raw in _BLANK.split(text or "")) if w]


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbours, given out when so many different ones are held."""
    held: Counter = Counter()

    def counted() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in held], pa.string()), pa.array([b for _, b in held], pa.string()), pa.array(held.values(), pa.int64())], ["a", "b", "count"])
        held.clear()
        return out

    for batch in batches:
        for text in batch.column("text").to_pylist():
            words = _words(text)
            held.update(zip(words, words[1:], strict=False))
            if len(held) >= REMEMBERED // 4:
                yield counted()
    if held:
        yield counted()


def neighbour_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(a, b, count): how often token b stands next after token a; counted where the texts lie, so no token is shuffled."""
    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_beside, "a string, b string, count long")
    return rows.groupBy("a", "b").agg(F.sum("count").alias("count"))


def matches_in(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, most_words: int = 3) -> DataFrame:
    """What matches() finds among the tokens of texts: each text is cut where it lies, and only runs of words that a map of fixed size has meet the names.

    The map lets some others through and the equi-join on the run itself decides, so the result is exact for any number of names.
    """
    spark = texts.sparkSession
    spot = F.crc32(F.col("alias").cast("binary")).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int")))
    words = aliases.filter("alias is not null").groupBy(F.shiftright(spot, 6).alias("at")).agg(bits.alias("bits")).toArrow()  # 2 ** 18 rows at most
    bit_map = np.zeros(1 << (MAP_BITS - 6), "<i8")
    bit_map[words["at"].to_numpy()] = words["bits"].to_numpy()
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(_runs(most_words, spark.sparkContext.broadcast(bit_map.tobytes())), f"id {rows.schema['id'].dataType.simpleString()}, start long, end long, alias string")
    return found.join(aliases, "alias").select("id", "start", "end", "alias", "target_id")


def longest(found: DataFrame) -> DataFrame:
    """Matches that end beyond all that sort before them by (start, longest, target); overlaps that reach further stay."""
    order = Window.partitionBy("id").orderBy("start", F.desc("end"), "target_id").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reach", F.max("end").over(order)).filter("reach is null or end > reach").drop("reach")


def relevant(found: DataFrame) -> DataFrame:
    """(id, target_id, n, terms): how often, and as what, each target is matched in a text."""
    return found.groupBy("id", "target_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("alias")).alias("terms"))


def mention_postings(found: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, target_id, n, density, score, offset) from matches that lie in segments (id, segment_id, start_pos, end_pos)."""
    seg = segments.select("id", "segment_id", "start_pos", "end_pos").filter("start_pos < end_pos")
    # A match meets the segments of its cell of the text, not all of a long text's.
    cells = F.sequence(F.floor(F.col("start_pos") / CELL), F.floor((F.col("end_pos") - 1) / CELL))
    seg = seg.withColumn("cell", F.explode(cells))
    inside = found.withColumn("cell", F.floor(F.col("start") / CELL)).join(seg, ["id", "cell"]).filter("start >= start_pos and end <= end_pos")
    n = F.count("*")
    density = n / F.max(F.col("end_pos") - F.col("start_pos"))
    return inside.groupBy("segment_id", "target_id").agg(n.alias("n"), F.round(density, 6).alias("density"), F.round(n + F.least(F.lit(2.0), 120 * density), 4).alias("score"), F.min(F.col("start") - F.col("start_pos")).alias("offset"))


def coverage(postings: DataFrame, segments: DataFrame, buckets: int = 8) -> DataFrame:
    """(target_id, bucket, segment_id, score): each target's best segment in each part of the book, ties to the earliest."""
    placed = postings.join(segments.select("segment_id", "bucket"), "segment_id")
    best = F.max_by(F.struct("segment_id", "score"), F.struct("score", -F.col("segment_id")))
    return placed.groupBy("target_id", "bucket").agg(best.alias("b")).select("target_id", "bucket", "b.segment_id", "b.score")


def progress_bucket(rank0: Column, total: Column, buckets: int = 8) -> Column:
    """The part of the book, 0 to buckets - 1, that the segment of that rank lies in."""
    return F.least(F.lit(buckets - 1), F.floor(rank0 * buckets / total)).cast("int")


def passages(refs: DataFrame, limit: int = 20) -> DataFrame:
    """Each name's best windows by entity count, then window."""
    order = Window.partitionBy("name").orderBy(F.desc("entity_count"), "window_id")
    return refs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit)


def cooccurring(refs: DataFrame, a: Column, b: Column, limit: int = 20) -> DataFrame:
    """The windows of name a that also hold name b."""
    other = refs.filter(F.col("name") == b).select("window_id").distinct()
    return refs.filter(F.col("name") == a).join(other, "window_id", "left_semi").orderBy(F.desc("entity_count"), "window_id").limit(limit)


def within_budget(costs: DataFrame, by: str, order: list, budget: int) -> DataFrame:
    """Rows in order, each taken if it still fits what earlier ones left of the budget; others are skipped."""
    items = F.array_sort(F.collect_list(F.struct(*order, "item", "cost")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("items"))
    fits = lambda a, x: F.struct(F.when(a["used"] + x["cost"] <= budget, a["used"] + x["cost"]).otherwise(a["used"]).alias("used"), F.when(a["used"] + x["cost"] <= budget, F.concat(a["items"], F.array(x["item"].cast("long")))).otherwise(a["items"]).alias("items"))
    return costs.groupBy(by).agg(F.aggregate(items, start, fits).alias("o")).select(by, "o.used", "o.items")


def prefix_budget(costs: DataFrame, by: str, order: list, budget: int) -> DataFrame:
    """The first rows in order whose summed cost is within the budget."""
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return costs.withColumn("total", F.sum("cost").over(upto)).filter(F.col("total") <= budget)

"""Candidate names: tokens, character windows, co-occurrence, boundary entropy and shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_token


def tokens(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, start, token) of the blank-separated tokens without the marks around them; start counts from 0."""
    raw = F.split(F.col(text_col), r"[ \t\n\r]", -1)
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(raw).alias("n", "raw"))
    order = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("raw") + 1).over(order), F.lit(0))
    token = normal_token(F.col("raw"))
    return rows.withColumns({"at": start, "token": token}).filter("token <> ''").select("id", "n", (F.col("at") + F.instr("raw", F.col("token")) - 1).alias("start"), "token")


def counts(texts: DataFrame, text_col: str, common: DataFrame, least_chars: int = 2) -> DataFrame:
    """(name, count) of tokens that are not among common (word), raw or in lower case; no order, so no window and one shuffle."""
    rows = texts.select(F.explode(F.split(F.col(text_col), r"[ \t\n\r]+")).alias("raw")).select(normal_token(F.col("raw")).alias("name")).filter(F.length("name") >= least_chars)
    words = common.select(F.lower("word").alias("w")).distinct()
    return rows.groupBy("name").agg(F.count("*").alias("count")).withColumn("w", F.lower("name")).join(words, "w", "left_anti").select("name", "count")


def shortlist(counted: DataFrame, limit: int) -> DataFrame:
    """The limit best by count, then length, then name: a top-k."""
    return counted.orderBy(F.desc("count"), F.desc(F.length("name")), "name").limit(limit)


def window_span(start: Column, end: Column, length: Column, size: int, step: int) -> Column:
    """The numbers of the windows that hold [start, end); the last window lies flush with the text's end."""
    last = F.greatest(F.lit(0), length - size)
    regular = F.ceil(last / step).cast("long")
    low = F.greatest(F.lit(0), F.ceil((end - size) / step)).cast("long")
    high = F.least(F.floor(start / step), regular - 1).cast("long")
    inner = F.when((low <= high) & (regular > 0), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    flush = F.when((start >= last) & (end <= last + size), F.array(regular)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(inner, flush)


def presence(toks: DataFrame, texts: DataFrame, names: DataFrame, id_col: str, text_col: str, size: int = 500, step: int = 250) -> DataFrame:
    """(name, id, window) for each window of size characters that holds a token of names (name), without repeats.

    Names of any number; a list small enough is sent to the tokens by the planner.
    """
    lengths = texts.select(F.col(id_col).alias("id"), F.length(text_col).alias("len"))
    hits = toks.join(names.select(F.col("name").alias("token")).distinct(), "token").join(lengths, "id")
    spans = window_span(F.col("start"), F.col("start") + F.length("token"), F.col("len"), size, step)
    return hits.select(F.col("token").alias("name"), "id", F.explode(spans).alias("window")).distinct()


def importance(present: DataFrame) -> DataFrame:
    """In how many windows each name is."""
    return present.groupBy("name").agg(F.count("*").alias("importance"))


def cooccurrence(present: DataFrame, ranked: DataFrame, least: int) -> DataFrame:
    """(left, right, count): windows that hold both names, for names of at least that importance."""
    kept = present.join(ranked.filter(F.col("importance") >= least).select("name"), "name")
    # A window has few names, as it has few characters; its pairs are made in one row and counted before the shuffle.
    names = F.array_sort(F.collect_set("name"))
    held = kept.groupBy("id", "window").agg(names.alias("names")).filter(F.size("names") > 1)
    names = F.col("names")
    pairs = F.flatten(F.transform(names, lambda x, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda y: F.struct(x.alias("left"), y.alias("right")))))
    return held.select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("count"))


def scores(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, importance, association, score): 18 ln(1 + importance) + 14 times the best count / sqrt(importance product)."""
    ends = pairs.select(F.col("left").alias("name"), F.col("right").alias("other"), "count").union(pairs.select("right", "left", "count"))
    mine, its = ranked.select("name", F.col("importance").alias("i")), ranked.select(F.col("name").alias("other"), F.col("importance").alias("j"))
    best = ends.join(mine, "name").join(its, "other").groupBy("name").agg(F.max(F.col("count") / F.sqrt(F.col("i") * F.col("j"))).alias("association"))
    out = ranked.join(best, "name", "left").withColumn("association", F.coalesce("association", F.lit(0.0)))
    return out.withColumn("score", 18 * F.log1p("importance") + 14 * F.col("association"))


def boundary_entropy(toks: DataFrame, names: DataFrame) -> DataFrame:
    """(name, left, right): the entropy in bits of the first letters of what stands before and after each name."""
    order = Window.partitionBy("id").orderBy("n")
    rows = toks.withColumns({"before": F.coalesce(F.lower(F.substring(F.lag("token").over(order), 1, 1)), F.lit("^")), "after": F.coalesce(F.lower(F.substring(F.lead("token").over(order), 1, 1)), F.lit("$"))})
    hits = rows.join(names.select(F.col("name").alias("token")).distinct(), "token")
    sides = hits.select(F.col("token").alias("name"), F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("before").alias("c")), F.struct(F.lit("right").alias("side"), F.col("after").alias("c")))).alias("s"))
    each = sides.groupBy("name", "s.side", "s.c").agg(F.count("*").alias("n"))
    # -sum(p log p) from sums of n and n log n, so that no second pass over a name's rows is needed.
    bits = (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"))
    sided = each.groupBy("name", "side").agg(bits.alias("bits"))
    return sided.groupBy("name").agg(F.max(F.when(F.col("side") == "left", F.col("bits"))).alias("left"), F.max(F.when(F.col("side") == "right", F.col("bits"))).alias("right"))


def fold_shadows(counted: DataFrame, endings: Column) -> DataFrame:
    """Counts with a name that is another and one of endings (a regular expression) added to that other."""
    root = F.regexp_replace("name", endings, "")
    known = counted.select(F.col("name").alias("root"))
    rows = counted.withColumn("root", root).filter("root <> name").join(known, "root", "left_semi").select(F.col("root").alias("name"), "count", F.col("name").alias("shadow"))
    rest = counted.join(rows.select(F.col("shadow").alias("name")), "name", "left_anti").union(rows.select("name", "count"))
    return rest.groupBy("name").agg(F.sum("count").alias("count"))


def merge_inputs(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Primary's names and those of extra that it lacks."""
    return primary.unionByName(extra.join(primary.select("name"), "name", "left_anti"))


def fold_onto(counted: DataFrame, root: Column) -> DataFrame:
    """Counts with a name whose root is a name too added to that root; root is null where a name stands for itself."""
    known = counted.select(F.col("name").alias("root")).withColumn("known", F.lit(True))
    rows = counted.withColumn("root", root).join(known, "root", "left")
    return rows.groupBy(F.when(F.col("known"), F.col("root")).otherwise(F.col("name")).alias("name")).agg(F.sum("count").alias("count"))

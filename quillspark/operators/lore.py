"""Lore entries: keywords, plain, case-sensitive or regular expressions, matched in texts and injected within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import tokens
from .match import token_grams, within_budget


def lore_matches(texts: DataFrame, id_col: str, text_col: str, entries: DataFrame, keys: DataFrame, most_words: int = 3) -> DataFrame:
    """(id, entry_id, priority, first, terms) of enabled entries (entry_id, priority, enabled) with a keyword in the text.

    keys has entry_id, keyword, is_regex, case_sensitive. Plain keywords join on grams of tokens; only
    regular expressions, which no key can serve, meet every text; their list is sent to all tasks whole.
    """
    live = keys.join(entries.filter("enabled").select("entry_id"), "entry_id", "left_semi")
    grams = token_grams(tokens(texts, id_col, text_col), most_words)
    plain = live.filter("not is_regex").withColumn("k", F.when(F.col("case_sensitive"), F.col("keyword")).otherwise(F.lower("keyword")))
    both = grams.select("id", "start", F.explode(F.array(F.struct(F.col("gram").alias("k"), F.lit(True).alias("exact")), F.struct(F.lower("gram").alias("k"), F.lit(False).alias("exact")))).alias("g"))
    hits = both.join(plain, (F.col("g.k") == F.col("k")) & (F.col("g.exact") == F.col("case_sensitive"))).select("id", "entry_id", "start", "keyword")
    patterns = live.filter("is_regex").select("entry_id", "keyword", "case_sensitive")
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pattern = F.concat(F.when(F.col("case_sensitive"), "").otherwise("(?i)"), F.col("keyword"))
    found = rows.join(F.broadcast(patterns), F.regexp_like(F.col("text"), pattern)).select("id", "entry_id", (F.regexp_instr(F.col("text"), pattern) - 1).cast("long").alias("start"), "keyword")
    all_ = hits.select("id", "entry_id", F.col("start").cast("long").alias("start"), "keyword").unionByName(found)
    by = all_.groupBy("id", "entry_id").agg(F.min("start").alias("first"), F.array_sort(F.collect_set("keyword")).alias("terms"))
    return by.join(entries.select("entry_id", "priority"), "entry_id")


def injected(matches: DataFrame, entries: DataFrame, budget: int) -> DataFrame:
    """(id, used, items): entries taken in order of priority, first place and id while they fit; others are skipped."""
    costs = matches.join(entries.select("entry_id", F.col("token_budget").cast("long").alias("cost")), "entry_id").select("id", "priority", "first", F.col("entry_id").alias("item"), "cost")
    return within_budget(costs, "id", ["priority", "first"], budget)

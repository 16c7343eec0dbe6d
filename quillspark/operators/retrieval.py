"""Finding passages for a question: terms, scores, excerpts and evidence packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_terms(text: Column, most: int = 12) -> Column:
    """The different terms of a question, two characters or longer, in order."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}_-]+")
    return F.slice(F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 2)), 1, most)


def terms_of(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term)."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(query_terms(F.col(text_col))).alias("term"))


def postings(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, n, first): how often, and where first among its words, a text has each term; counted map-side, one shuffle."""
    words = F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_-]+")
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(words).alias("pos", "term")).filter("length(term) >= 2")
    return rows.groupBy("id", "term").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first"))


def find(terms: DataFrame, index: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, rank, id, terms, hits): the texts with most different terms, then hits, then the least id.

    An equi-join on the term; frequent terms make large groups, which adaptive execution splits.
    """
    hits = terms.join(index, "term").groupBy("query_id", "id").agg(F.count("*").alias("terms"), F.sum("n").alias("hits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("terms"), F.desc("hits"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def dedupe_packs(packs: DataFrame, most: int = 12) -> DataFrame:
    """One pack an id, that of most support, and the best most of them for each query."""
    one = packs.groupBy("query_id", "pack_id").agg(F.max_by("preview", F.struct("support", "preview")).alias("preview"), F.max("support").alias("support"))
    order = Window.partitionBy("query_id").orderBy(F.desc("support"), "pack_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def first_enough(primary: DataFrame, fallback: DataFrame, least: int = 3) -> DataFrame:
    """Primary's rows, and fallback's for queries (query_id) of which primary has fewer than least."""
    n = primary.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return primary.unionByName(fallback.join(n, "query_id", "left_anti"))


def excerpts(hits: DataFrame, gap: int = 220, most: int = 4) -> DataFrame:
    """(id, first, last, n): the first cluster of hits (id, pos): up to most, each within gap of the last."""
    sorted_ = F.slice(F.array_sort(F.collect_list("pos")), 1, most)
    start = F.struct(F.element_at("p", 1).alias("last"), F.lit(1).alias("n"), F.lit(True).alias("open"))
    step = lambda a, x: F.struct(F.when(a["open"] & (x - a["last"] <= gap), x).otherwise(a["last"]).alias("last"), F.when(a["open"] & (x - a["last"] <= gap), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["open"] & (x - a["last"] <= gap)).alias("open"))
    rows = hits.groupBy("id").agg(sorted_.alias("p"))
    return rows.select("id", F.element_at("p", 1).alias("first"), F.aggregate(F.slice("p", 2, most), start, step).alias("c")).select("id", "first", "c.last", "c.n")


def follow_up(turns: DataFrame, most: int = 4) -> DataFrame:
    """(conv_id, nth, role, text): a conversation's last few turns that are not blank, oldest first."""
    order = Window.partitionBy("conv_id")
    rows = turns.filter("trim(text) <> ''").withColumn("back", F.row_number().over(order.orderBy(F.desc("turn"))))
    kept = rows.filter(F.col("back") <= most)
    return kept.withColumn("nth", F.row_number().over(order.orderBy("turn"))).select("conv_id", "nth", "role", "text")


def latest_run(runs: DataFrame) -> DataFrame:
    """Each session's last run by (created_at, id) and how many are active."""
    return runs.groupBy("session_id").agg(F.max_by(F.struct("id", "status"), F.struct("created_at", "id")).alias("r"), F.count_if(F.col("status").isin("queued", "running")).alias("active")).select("session_id", "r.id", "r.status", "active")


def admission(requests: DataFrame, active: DataFrame, per_user: int, in_all: int) -> DataFrame:
    """(user_id, admitted, reason) for users that ask for a run while active (user_id) ones go on."""
    mine = active.groupBy("user_id").agg(F.count("*").alias("mine"))
    total = active.agg(F.count("*").alias("total"))
    rows = requests.join(mine, "user_id", "left").crossJoin(F.broadcast(total))  # one row
    reason = F.when(F.col("total") >= in_all, "busy").when(F.coalesce("mine", F.lit(0)) >= per_user, "user_limit")
    return rows.select("user_id", reason.isNull().alias("admitted"), reason.alias("reason"))

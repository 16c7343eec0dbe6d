"""Contexts cut to a budget, in tiers: reference edges, then reference attributes, then the last entities go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chars(*columns: Column) -> Column:
    """The characters of some columns together; null has none."""
    out = F.lit(0).cast("long")
    for c in columns:
        out += F.coalesce(F.length(c), F.lit(0))
    return out


def fit(entities: DataFrame, attributes: DataFrame, edges: DataFrame, systems: DataFrame, budgets: DataFrame) -> DataFrame:
    """(ctx, budget, tier, kept, cost): how far each context must be cut for each of its budgets (ctx, budget).

    entities have ctx, id, rank (from 1, no gaps) and cost, attributes ctx, entity_id, visibility, cost,
    edges ctx, edge_id, source_id, target_id, visibility, cost, systems ctx, cost. Tier 0 keeps all; 1
    drops edges whose visibility is reference; 2 such attributes too; 3 keeps the most first entities that fit,
    with the edges both whose ends are kept: an edge's cost falls due at the later of its ends' ranks,
    so running sums by rank tell what each number of entities costs. Systems always stay, even if they alone exceed the budget. Edges
    with an end that is no entity of the context cost from the start.
    """
    ranks = entities.select("ctx", F.col("id"), "rank")
    ends = edges
    for side in ("source", "target"):
        ends = ends.join(ranks.select("ctx", F.col("id").alias(f"{side}_id"), F.col("rank").alias(f"{side}_rank")), ["ctx", f"{side}_id"], "left")
    due = F.when(F.col("source_rank").isNotNull() & F.col("target_rank").isNotNull(), F.greatest("source_rank", "target_rank")).otherwise(0)
    owned = attributes.join(ranks.select("ctx", F.col("id").alias("entity_id"), "rank"), ["ctx", "entity_id"])
    reference = F.col("visibility") == "reference"
    costs = entities.select("ctx", "rank", F.col("cost").alias("base"), F.lit(0).alias("refs"), F.lit(0).alias("ref_edges"), F.lit(1).alias("n"))
    for rows, rank, kind in ((owned, F.col("rank"), "refs"), (ends, due, "ref_edges")):
        more = {k: F.when(reference, F.col("cost")).otherwise(0) if k == kind else F.lit(0) for k in ("refs", "ref_edges")}
        costs = costs.unionByName(rows.select("ctx", rank.alias("rank"), F.when(reference, 0).otherwise(F.col("cost")).alias("base"), *[v.alias(k) for k, v in more.items()], F.lit(0).alias("n")))
    costs = costs.unionByName(systems.select("ctx", F.lit(0).alias("rank"), F.col("cost").alias("base"), F.lit(0).alias("refs"), F.lit(0).alias("ref_edges"), F.lit(0).alias("n")))
    by_rank = costs.groupBy("ctx", "rank").agg(*[F.sum(c).cast("long").alias(c) for c in ("base", "refs", "ref_edges", "n")])
    order = Window.partitionBy("ctx")
    summed = by_rank.withColumns({"upto": F.sum("base").over(order.orderBy("rank")), **{f"all_{c}": F.sum(c).over(order) for c in ("base", "refs", "ref_edges", "n")}})
    asked = summed.join(budgets, "ctx")
    at_most = F.max(F.when(F.col("upto") <= F.col("budget"), F.struct("rank", "upto")))
    grouped = asked.groupBy("ctx", "budget").agg(*[F.first(f"all_{c}").alias(c) for c in ("base", "refs", "ref_edges", "n")], at_most.alias("fits"), F.min(F.struct("rank", "upto")).alias("least"))
    whole, no_edges = F.col("base") + F.col("refs") + F.col("ref_edges"), F.col("base") + F.col("refs")
    tier = F.when(whole <= F.col("budget"), 0).when(no_edges <= F.col("budget"), 1).when(F.col("base") <= F.col("budget"), 2).otherwise(3)
    none = F.when(F.col("least.rank") == 0, F.col("least.upto")).otherwise(0)
    kept = F.when(tier < 3, F.col("n")).otherwise(F.coalesce("fits.rank", F.lit(0)).cast("long"))
    cost = F.when(tier == 0, whole).when(tier == 1, no_edges).when(tier == 2, F.col("base")).otherwise(F.coalesce("fits.upto", none))
    return grouped.select("ctx", "budget", tier.alias("tier"), kept.alias("kept"), cost.alias("cost"))


def cut_to(fits: DataFrame, entities: DataFrame, attributes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The entities, attributes and edges that stay, with the budget they were cut to."""
    chosen = entities.join(fits.select("ctx", "budget", "tier", "kept"), "ctx").filter(F.col("rank") <= F.col("kept"))
    kept = chosen.select("ctx", "budget", "tier", F.col("id"))
    shown = attributes.join(kept.withColumnRenamed("id", "entity_id"), ["ctx", "entity_id"]).filter((F.col("tier") < 2) | (F.col("visibility") != "reference"))
    ends = edges.join(kept.withColumnRenamed("id", "source_id"), ["ctx", "source_id"]).join(kept.select("ctx", "budget", F.col("id").alias("target_id")), ["ctx", "budget", "target_id"])
    return chosen.drop("kept"), shown, ends.filter((F.col("tier") < 1) | (F.col("visibility") != "reference"))

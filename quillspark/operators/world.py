"""The world graph: filters, neighbourhoods, signatures, merges and reconciliation of entities and relationships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_label


def search(rows: DataFrame, text: str | None, columns: Sequence[str], exact: dict | None = None) -> DataFrame:
    """Rows in which any of columns holds text, whatever the case, and that equal exact's values; empty values do not count. % and _ in text are wild."""
    if text:
        hit = F.lit(False)
        for c in columns:
            hit |= F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        rows = rows.filter(hit)
    for c, v in (exact or {}).items():
        if v not in (None, ""):
            rows = rows.filter(F.col(c) == v)
    return rows


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, node) for each end of an edge that is one of nodes (id): two equi-joins, no disjunction."""
    ends = edges.select("edge_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    return ends.join(nodes.select("id").distinct(), "id", "left_semi").select("edge_id", F.col("id").alias("node"))


def star(edges: DataFrame, centre: Column) -> DataFrame:
    """The edges at centre with the peer, how many edges run between the two and which of them this is."""
    at = edges.filter((F.col("source_id") == centre) | (F.col("target_id") == centre))
    peer = F.when(F.col("source_id") == centre, F.col("target_id")).otherwise(F.col("source_id"))
    pair = Window.partitionBy("peer")
    return at.withColumn("peer", peer).withColumns({"parallel": F.count("*").over(pair), "nth": F.row_number().over(pair.orderBy("edge_id"))})


def neighbourhood(edges: DataFrame, nodes: DataFrame, focus: DataFrame, most_edges: int = 60, most_nodes: int = 80) -> DataFrame:
    """Nodes of the first most_edges edges, by id, at focus (id), with the focus itself; the first most_nodes by id."""
    near = incident(edges, focus).select("edge_id").distinct().orderBy("edge_id").limit(most_edges)
    ends = edges.join(F.broadcast(near), "edge_id", "left_semi").select(F.explode(F.array("source_id", "target_id")).alias("id")).union(focus.select("id")).distinct()
    return nodes.join(ends, "id", "left_semi").orderBy("id").limit(most_nodes)


def resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, id): the entity that alone has the name or alias, whatever the case; ambiguous names have none."""
    keys = entities.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k")).select("id", F.lower(F.trim("k")).alias("k")).filter("k <> ''")
    one = keys.groupBy("k").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other")
    return names.withColumn("k", F.lower(F.trim("name"))).join(one, "k", "left").select("name", "id")


def ambiguous(entities: DataFrame) -> DataFrame:
    """(alias, entities): aliases that more than one entity has."""
    keys = entities.select("id", F.explode("aliases").alias("alias")).select("id", F.lower(F.trim("alias")).alias("alias")).filter("alias <> ''")
    return keys.groupBy("alias").agg(F.count_distinct("id").alias("entities")).filter("entities > 1")


def signed(edges: DataFrame) -> DataFrame:
    """Edges with their canonical label and an undirected signature."""
    ends = F.array(F.least("source_id", "target_id"), F.greatest("source_id", "target_id"))
    return edges.withColumn("canonical", canonical_label(F.col("label"))).withColumn("signature", F.concat_ws("|", ends.cast("array<string>"), "canonical"))


def unique_edges(edges: DataFrame) -> DataFrame:
    """The first edge, by id, of each direction and canonical label; edges to themselves go."""
    order = Window.partitionBy("source_id", "target_id", "canonical").orderBy("edge_id")
    return signed(edges).filter("source_id <> target_id").withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def new_edges(given: DataFrame, stored: DataFrame) -> DataFrame:
    """Given edges whose ends and label no stored edge has, in either direction, each once."""
    fresh = unique_edges(given)
    order = Window.partitionBy("signature").orderBy("edge_id")
    once = fresh.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")
    return once.join(signed(stored).select("signature").distinct(), "signature", "left_anti")


def reconcile(stored: DataFrame, given: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """create, update, noop, preserve, link_existing, delete or keep for each key of an imported pack.

    stored has origin (pack or manual), pack (null if not of the pack) and in_use; given the pack's
    rows. Manual rows are preserved; stored rows outside any pack are linked; rows that the pack
    dropped are deleted unless something uses them or they are manual.
    """
    old = stored.select(key, "origin", "pack", "in_use", *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("has_old"))
    both = old.join(given.select(key, *values, F.lit(True).alias("has_new")), key, "full_outer")
    same = F.lit(True)
    for v in values:
        same &= F.col(f"old_{v}").eqNullSafe(F.col(v))
    action = (
        F.when(F.col("has_old").isNull(), "create")
        .when(F.col("has_new").isNull() & F.col("pack").isNull(), "keep")
        .when(F.col("has_new").isNull() & ((F.col("origin") == "manual") | F.col("in_use")), "keep")
        .when(F.col("has_new").isNull(), "delete")
        .when(F.col("pack").isNull(), "link_existing")
        .when(F.col("origin") == "manual", "preserve")
        .when(same, "noop")
        .otherwise("update")
    )
    return both.select(key, action.alias("action"))


def merge_chunks(rows: DataFrame, generic: Sequence[str] = ("other", "unknown")) -> DataFrame:
    """One entity a name from chunks (chunk, position, name, entity_type, description, aliases).

    The first type that is not generic wins, else the first; the longest description, the earliest
    of equals; all aliases.
    """
    at = F.struct("chunk", "position")
    specific = F.min_by("entity_type", F.when(~F.lower("entity_type").isin(*generic), at))
    description = F.max_by("description", F.struct(F.length("description"), -F.col("chunk"), -F.col("position")))
    aliases = F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases"))))
    return rows.groupBy("name").agg(F.coalesce(specific, F.min_by("entity_type", at)).alias("entity_type"), description.alias("description"), aliases.alias("aliases"), F.count("*").alias("mentions"))


def sample(rows: DataFrame, by: str, value: str, most: int = 6) -> DataFrame:
    """(by, n, sample): the distinct values' number and the least few of them, with (+n more)."""
    ranked = rows.select(by, value).distinct().withColumns({"r": F.row_number().over(Window.partitionBy(by).orderBy(value)), "n": F.count("*").over(Window.partitionBy(by))})
    few = ranked.filter(F.col("r") <= most).groupBy(by, "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda s: s[value].cast("string")), ", ").alias("s"))
    return few.select(by, "n", F.when(F.col("n") > most, F.concat("s", F.lit(" (+"), F.col("n") - most, F.lit(" more)"))).otherwise(F.col("s")).alias("sample"))


def draft_counts(*tables: tuple[str, DataFrame]) -> DataFrame:
    """(kind, drafts) for each named table with a status."""
    out = None
    for kind, df in tables:
        n = df.filter("status = 'draft'").agg(F.count("*").alias("drafts")).select(F.lit(kind).alias("kind"), "drafts")
        out = n if out is None else out.unionByName(n)
    return out


def audit(entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, missing): what each draft lacks: description, aliases, attributes."""
    has = attributes.select(F.col("entity_id").alias("id")).distinct().withColumn("has", F.lit(True))
    rows = entities.filter("status = 'draft'").join(has, "id", "left")
    missing = F.array_compact(F.array(F.when(F.coalesce(F.trim("description"), F.lit("")) == "", "description"), F.when(F.coalesce(F.size("aliases"), F.lit(0)) == 0, "aliases"), F.when(F.col("has").isNull(), "attributes")))
    return rows.select("id", missing.alias("missing")).filter(F.size("missing") > 0)


def visible(rows: DataFrame, for_writer: bool = True) -> DataFrame:
    """A writer does not see hidden rows; a checker sees all."""
    return rows.filter("visibility <> 'hidden'") if for_writer else rows


def context(entities: DataFrame, attributes: DataFrame, edges: DataFrame, relevant: DataFrame, for_writer: bool = True) -> DataFrame:
    """(id, name, attributes, edges): confirmed relevant entities with their visible attributes in order and the edges between them."""
    chosen = entities.filter("status = 'confirmed'").join(relevant.select("id").distinct(), "id", "left_semi")
    shown = visible(attributes, for_writer).groupBy(F.col("entity_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "key", "surface"))), lambda a: F.concat(a["key"], F.lit("="), a["surface"])).alias("attributes"))
    keys = chosen.select("id")
    both = visible(edges, for_writer).join(keys.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(keys.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    out = both.groupBy(F.col("source_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("target_id", "label"))), lambda e: F.concat(e["label"], F.lit(">"), e["target_id"])).alias("edges"))
    return chosen.select("id", "name").join(shown, "id", "left").join(out, "id", "left")

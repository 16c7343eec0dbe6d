"""World systems: JSON trees, timelines and lists, flattened, pruned and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST = "array<struct<label:string,visibility:string,time:string,description:string>>"
DEPTH = 8


def _node(depth: int) -> str:
    return "struct<label:string,visibility:string" + (f",children:array<{_node(depth - 1)}>" if depth else "") + ">"


def nodes(systems: DataFrame) -> DataFrame:
    """(system_id, path, depth, label, visibility, hidden) of hierarchies (system_id, data JSON with nodes), to DEPTH levels.

    path is the labels from the root; hidden tells whether the node or one above it is hidden. Each
    level is an explode where the row lies, so there is no shuffle.
    """
    rows = systems.select("system_id", F.from_json("data", f"nodes array<{_node(DEPTH)}>")["nodes"].alias("level"), F.array().cast("array<string>").alias("path"), F.lit(False).alias("hidden"))
    out = None
    for depth in range(DEPTH + 1):
        at = rows.select("system_id", "path", "hidden", F.explode("level").alias("n")).select("system_id", F.concat("path", F.array("n.label")).alias("path"), (F.col("hidden") | F.coalesce(F.col("n.visibility") == "hidden", F.lit(False))).alias("hidden"), "n")
        level = at.select("system_id", F.array_join("path", " / ").alias("path"), F.lit(depth).alias("depth"), "n.label", "n.visibility", "hidden")
        out = level if out is None else out.unionByName(level)
        if depth < DEPTH:
            rows = at.select("system_id", F.col("n.children").alias("level"), "path", "hidden")
    return out


def items(systems: DataFrame, field: str) -> DataFrame:
    """(system_id, nth, label, time, description, visibility) of timelines (field events) or lists (field items)."""
    return systems.select("system_id", F.posexplode(F.from_json("data", f"{field} {LIST}")[field]).alias("nth", "i")).select("system_id", "nth", "i.label", "i.time", "i.description", "i.visibility")


def pruned_items(data: Column, field: str) -> Column:
    """The data of a timeline or list without hidden elements, as JSON."""
    kept = F.filter(F.from_json(data, f"{field} {LIST}")[field], lambda i: F.coalesce(i["visibility"] != "hidden", F.lit(True)))
    return F.to_json(F.struct(kept.alias(field)))


def rendered(flat: DataFrame) -> DataFrame:
    """(system_id, text): a hierarchy's visible nodes as an indented list, in order of path."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("label"))
    rows = flat.filter("not hidden").select("system_id", "path", line.alias("line"))
    return rows.groupBy("system_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("text"))


def labels(systems: DataFrame) -> DataFrame:
    """(system_id, label) of everything that has a label, for the known terms."""
    return nodes(systems).select("system_id", "label").union(items(systems, "events").select("system_id", "label")).union(items(systems, "items").select("system_id", "label")).filter("trim(label) <> ''").distinct()


def constraints(systems: DataFrame) -> DataFrame:
    """(novel_id, text): all constraints, numbered in order of system and place."""
    rows = systems.select("novel_id", "system_id", F.posexplode("constraints").alias("pos", "c")).filter("trim(c) <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("system_id", "pos", "c")))
    return rows.groupBy("novel_id").agg(F.array_join(F.transform(ordered, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x["c"])), "\n").alias("text"))


def node_id(path: Column) -> Column:
    """A stable id of a generated node."""
    return F.concat(F.lit("wg_"), F.substring(F.sha1(path), 1, 12))

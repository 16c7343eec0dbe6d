"""Structured answers checked against a schema: the first fault's path and kind, or the parsed value; nothing is dropped.

A schema is a dict: {"type": "object", "fields": {name: schema}}, {"type": "array", "items": schema}, or a
scalar type string, integer, number, boolean; "required": True and "values": [...] may be added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What schema_of_variant says of values of each type.
_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "array": "ARRAY<.*>", "object": "OBJECT<.*>"}


def _kind(value: Column) -> Column:
    return F.upper(F.schema_of_variant(value))


def _fault(value: Column, schema: dict, path: Column) -> Column:
    """path: kind of the first fault in value, null if there is none; value is a variant, SQL null where it is missing."""
    kind = schema["type"]
    said = lambda what: F.concat(path, F.lit(f": {what}"))
    empty = value.isNull() | F.is_variant_null(value)
    wrong = ~_kind(value).rlike(f"^(?:{_KINDS[kind]})$")
    inner = F.lit(None).cast("string")
    if kind == "object":
        faults = [_fault(F.try_variant_get(value, f"$.{name}", "variant"), sub, F.concat(path, F.lit(f".{name}"))) for name, sub in schema["fields"].items()]
        inner = F.coalesce(*faults, F.lit(None).cast("string"))
    elif kind == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(items, lambda x, i: _fault(x, {"required": True, **schema["items"]}, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        inner = F.try_element_at(F.filter(each, lambda f: f.isNotNull()), F.lit(1))
    elif "values" in schema:
        inner = F.when(~F.try_variant_get(value, "$", "string").isin(*schema["values"]), said("not allowed"))
    return F.when(empty, said("missing") if schema.get("required") else F.lit(None).cast("string")).when(wrong, said(f"not {kind}")).otherwise(inner)


def without_fence(text: Column) -> Column:
    """An answer without a code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", "$1"))


def _open_brackets(bare: Column) -> Column:
    """How many brackets of a text without its strings are not closed; below 0 if more are closed."""
    return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")


def is_cut(text: Column) -> Column:
    """Whether an answer that cannot be parsed was broken off: it opens an object or array and lacks as many closing brackets outside strings, or ends inside a string."""
    bare = _bare(text)
    return text.rlike(r"^\s*[\[{]") & ((_open_brackets(bare) > 0) | F.contains(bare, F.lit('"')))


def one_value(text: Column) -> Column:
    """The variant that the whole of a text is; null if it is none, or if anything follows, which the parser alone would pass over."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    more = F.try_variant_get(alone, "$[1]", "variant")
    return F.when(more.isNull() & (_open_brackets(_bare(text)) == 0), F.try_variant_get(alone, "$[0]", "variant"))


def checked(rows: DataFrame, text_col: str, schema: dict, finish_col: str | None = None, into: str = "checked") -> DataFrame:
    """rows with a column struct(valid, fault, truncated, value); value is the parsed answer as JSON text, null unless valid.

    fault is the path and kind of the first fault in the order of the schema, 'empty', 'no JSON', or 'truncated'; an answer
    whose finish is length is truncated whatever it holds. Fields that the schema lacks do not matter.
    The text is parsed in a projection of its own, once a row.
    """
    clean, value = F.col("_clean"), F.col("_value")
    cut = F.coalesce(F.col(finish_col) == "length", F.lit(False)) if finish_col else F.lit(False)
    broken = cut | (value.isNull() & F.coalesce(is_cut(clean), F.lit(False)))
    none = F.coalesce(clean, F.lit("")) == ""
    fault = F.when(cut, "truncated").when(none, "empty").when(broken, "truncated").when(value.isNull(), "no JSON").otherwise(_fault(value, {"required": True, **schema}, F.lit("$")))
    parsed = rows.withColumn("_clean", without_fence(F.col(text_col))).withColumn("_value", one_value(clean)).withColumn("_fault", fault)
    found = F.col("_fault")
    out = F.struct(found.isNull().alias("valid"), found.alias("fault"), F.coalesce(found == "truncated", F.lit(False)).alias("truncated"), F.when(found.isNull(), F.to_json(value)).alias("value"))
    return parsed.withColumn(into, out).drop("_clean", "_value", "_fault")

"""What a language model's answer holds: JSON, tool calls in text, plain words."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: How much of a text is searched for a JSON object, and how many openings are tried.
FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
WRAPPED = re.compile(r"<(tool_call|function_call|tool)>\s*(.*?)\s*</\1>", re.S)
NAMED = re.compile(r"<function=([\w.-]+)>\s*(.*?)\s*</function>", re.S)


def whole_json(text: Column) -> Column:
    """The text, or its fenced block, if that is JSON; null otherwise. Native."""
    fenced = F.regexp_extract(text, FENCE, 1)
    valid = lambda c: F.when(c.startswith("{"), F.to_json(F.try_parse_json(c)))
    return F.coalesce(valid(F.trim(text)), valid(F.trim(fenced)))


def first_object(text: str) -> dict | None:
    """The first JSON object that begins at a brace of text."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, dict):
            return found
        at = text.find("{", at + 1)
    return None


def calls_in(text: str, tools: frozenset[str]) -> Iterator[tuple[str, str]]:
    """(name, arguments as JSON) of the known tools' calls that a text writes out."""
    bodies = [(None, m[2]) for m in WRAPPED.finditer(text)] + [(m[1], m[2]) for m in NAMED.finditer(text)]
    if not bodies and text.strip().startswith("{"):
        bodies = [(None, text)]
    for name, body in bodies:
        found = first_object(body) or {}
        name = name or found.get("name") or found.get("tool")
        given = found.get("arguments", found.get("parameters", found if "name" not in found and "tool" not in found else {}))
        if isinstance(given, str):
            given = first_object(given) or {}
        if name in tools:
            yield name, json.dumps(given, sort_keys=True, ensure_ascii=False)


@udtf(returnType="nth int, name string, arguments string")
class ToolCalls:
    def eval(self, text: str, tools: list) -> Iterator[tuple[int, str, str]]:
        for k, (name, arguments) in enumerate(calls_in(text or "", frozenset(tools))):
            yield k, name, arguments


def tool_calls(texts: DataFrame, id_col: str, text_col: str, tools: list[str]) -> DataFrame:
    """(id, nth, name, arguments) of the calls in each text; the table function runs beside its row, without a shuffle."""
    spark = texts.sparkSession
    spark.udtf.register("tool_calls_of", ToolCalls)
    texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array(*map(F.lit, tools)).alias("tools")).createOrReplaceTempView("texts_with_calls")
    return spark.sql("select id, c.* from texts_with_calls, lateral tool_calls_of(text, tools) c")


def without_calls(text: Column) -> Column:
    """The text without written-out calls. Native."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<(tool_call|function_call|tool)>.*?</\1>", ""), r"(?s)<function=[\w.-]+>.*?</function>", ""))

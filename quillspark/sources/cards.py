"""Character cards: JSON, or a PNG image's text chunks with base64 JSON."""

from __future__ import annotations

import base64
import binascii
import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
FIELDS = ("name", "description", "personality", "scenario", "first_mes", "mes_example", "creator_notes")
MOST_TEXT = 8 << 20


def _inflate(data: bytes) -> bytes:
    return zlib.decompressobj().decompress(data, MOST_TEXT)


def png_texts(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(keyword, value) of the text chunks of a PNG file; a broken file ends the walk."""
    at = len(SIGNATURE)
    while data.startswith(SIGNATURE) and at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        key, _, rest = body.partition(b"\0")
        try:
            if kind == b"tEXt":
                yield key.decode("latin-1"), rest
            elif kind == b"zTXt":
                yield key.decode("latin-1"), _inflate(rest[1:])
            elif kind == b"iTXt":
                packed, value = rest[:1] == b"\1", rest[2:].split(b"\0", 2)[-1]
                yield key.decode("latin-1"), _inflate(value) if packed else value
        except (zlib.error, IndexError):
            continue
        if kind == b"IEND":
            return


def card_json(data: bytes) -> dict | None:
    """The card's object in a file's bytes; null without one."""
    values = [v for k, v in png_texts(data) if k.lower() in ("chara", "ccv3")] if data.startswith(SIGNATURE) else [data]
    for value in values:
        for text in (lambda v: base64.b64decode(v, validate=True), lambda v: v):
            try:
                found = json.loads(text(value).decode("utf-8-sig"))
            except (ValueError, binascii.Error):
                continue
            if isinstance(found, dict):
                return found.get("data") if isinstance(found.get("data"), dict) else found
    return None


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, ..., tags) of the cards at path; fields of a file that is no card are null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cards = [card_json(b) or {} for b in f["content"]]
            out = {"path": f["path"]} | {k: [str(c[k]).strip() or None if c.get(k) is not None else None for c in cards] for k in FIELDS}
            yield pd.DataFrame(out | {"tags": [[str(t) for t in c.get("tags") or [] if str(t).strip()] for c in cards]})

    schema = "path string, " + ", ".join(f"{k} string" for k in FIELDS) + ", tags array<string>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def card_text(cards: DataFrame) -> DataFrame:
    """(path, name, content, keywords): the filled fields as sections, and the name and tags as keywords."""
    sections = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"[{k}]\n"), F.col(k))) for k in FIELDS[1:]]))
    return cards.select("path", "name", F.array_join(sections, "\n\n").alias("content"), F.array_distinct(F.array_compact(F.concat(F.array("name"), F.coalesce("tags", F.array().cast("array<string>"))))).alias("keywords"))

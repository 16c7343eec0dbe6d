"""Language identification by rank-order profiles of n-grams (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bound_batches, mix64

MAX_N, TOP = 5, 300
#: About so many documents of each language are learned from.
SAMPLE_DOCS = 1000
UNKNOWN = "und"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams, n to MAX_N, of the lower-case words between blanks; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    points = np.where(letter, points, 0)[keep]
    if not len(points):
        return np.empty(0, _U)
    points = np.concatenate(([0], points, [0] if points[-1] else [])).astype(_U)
    blank = points == 0
    value = points + _U(1)
    out = [value[~blank]]
    for n in range(2, MAX_N + 1):
        if len(points) < n:
            break
        value = value[:-1] * _BASE + points[n - 1 :] + _U(1)
        # Blanks stand at either end of an n-gram alone.
        inner = np.zeros(len(value), bool)
        for k in range(1, n - 1):
            inner |= blank[k : k + len(value)]
        out.append(value[~inner])
    return mix64(np.concatenate(out))


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each occurs."""
    if not len(hashes):
        return hashes, np.empty(0, np.int64)
    x = np.sort(hashes)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[at], np.diff(np.append(at, len(x)))


def ranked(hashes: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by hash."""
    keys, counts = counted(hashes)
    if len(keys) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        sure = np.flatnonzero(counts > least)
        at = np.sort(np.concatenate((sure, np.flatnonzero(counts == least)[: top - len(sure)])))
        keys, counts = keys[at], counts[at]
    return keys[np.argsort(-counts, kind="stable")]


class Profiles:
    """The learned languages' n-grams and the place of each in each language's order."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int = TOP):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.top = top
        self.keys = np.array(sorted({gram & (2**64 - 1) for _, gram, _ in rows}), _U)
        self.places = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.keys, _U(gram & (2**64 - 1))), self.langs.index(lang)] = place

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance (the first by name of equals), and 1 less its share of the most possible."""
        own = ranked(grams(text), self.top) if text else np.empty(0, _U)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, own)
        at = np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == own, at, len(self.keys))
        places = self.places[at]
        out = np.where(places < 0, self.top, np.abs(places - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(out))
        return self.langs[best], float(1 - out[best] / (self.top * len(own)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(grams(text))
            for lang, found in texts.items():
                keys, counts = counted(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def learn(docs: DataFrame, use: Column | None = None, sample_docs: int = SAMPLE_DOCS, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages of rows that satisfy use and have text and lang.

    A language's rows are sampled by a hash of the id at such a rate that about sample_docs are
    learned from, whatever the table's size; their whole texts count. The driver gets a count and
    top n-grams for each language. No such rows give profiles without languages.
    """
    bound_batches(docs.sparkSession)
    rows = docs.filter(use) if use is not None else docs
    rows = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("lang is not null and text is not null")
    sizes = {lang: n for lang, n in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles([], top)
    rate = F.create_map(*chain.from_iterable((F.lit(lang), F.lit(min(1.0, sample_docs / n))) for lang, n in sizes.items()))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", F.length("text")), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)
    counts = chosen.select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "gram")))
    # No more than top n-grams of each partial group matter, so they are cut before they meet.
    part = counts.withColumn("part", F.pmod(F.hash("gram"), F.lit(64))).groupBy("lang", "part").agg(F.slice(order, 1, top).alias("best"))
    best = part.select("lang", F.explode("best").alias("g")).groupBy("lang").agg(F.slice(F.array_sort(F.collect_list("g")), 1, top).alias("best"))
    return Profiles([(r.lang, g.gram, k) for r in best.collect() for k, g in enumerate(r.best)], top)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) of each whole text; `und` and 0 if it is null or has no letters.

    Only the text matters. A column of docs that has the name of a new one is replaced. An empty
    table gives an empty result; equal texts get equal results; ties go to the first language by name.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # top n-grams of each language

    @F.pandas_udf("struct<lang_pred string, score double>")
    def judge(texts):
        import pandas as pd

        own = shared.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])

    out = docs.drop("lang_pred", "score", "judged__").withColumn("judged__", judge(F.col(f"`{text_col}`").cast("string")))
    return out.withColumns({"lang_pred": F.col("judged__.lang_pred"), "score": F.col("judged__.score")}).drop("judged__")

"""How closely names stand beside each other in texts: numbers in place of strings, so that little is shuffled.

Names are told apart by 64-bit hashes; these go to all tasks with the names' importance, 16 bytes
a name, and texts are turned into pairs of numbers where they lie. A list of more than MOST names
takes the joins of refine.strongest() instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from . import refine as R
from .match import REMEMBERED, _words, neighbour_counts
from .zh_growth import written

#: Names that go to all tasks, 384 MB at most; pairs that a task holds.
MOST, HELD = 24_000_000, 1 << 21


def _hash(name: str) -> int:
    return int.from_bytes(blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("h", pa.array([_hash(n) for n in batch.column("name").to_pylist()], pa.int64()))


class _Numbers(dict):
    """The number of each word's name, -1 where that is not among the names; so many are remembered."""

    def __init__(self, hashes: np.ndarray, letters: dict | None):
        self.hashes, self.letters = hashes, letters

    def __missing__(self, word: str) -> int:
        h = _hash(word.translate(self.letters) if self.letters else word)
        k = int(np.searchsorted(self.hashes, h))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = k = k if k < len(self.hashes) and self.hashes[k] == h else -1
        return k


def _summed(keys: np.ndarray) -> pa.RecordBatch:
    keys, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])


def _numbered(names, letters: dict[str, str] | None):
    """(key, n): pairs of numbers, the lower one in the upper half, of names that stand side by side."""
    table = str.maketrans(letters) if letters else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = _Numbers(names.value[0], table), [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                at = np.array([number[w] for w in _words(text)], np.int64)
                a, b = at[:-1], at[1:]
                good = (a >= 0) & (b >= 0) & (a != b)
                a, b = a[good], b[good]
                held.append(np.minimum(a, b) << 32 | np.maximum(a, b))
                size += len(a)
                if size >= HELD:
                    yield _summed(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield _summed(np.concatenate(held))

    return run


def _strengths(names):
    """(h, degree, association) of both ends of pairs, put together over many pairs."""

    def of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        hashes, importance = names.value
        a, b = keys >> 32, keys & 0xFFFFFFFF
        strength = n / np.sqrt((importance[a] * importance[b]).astype(np.float64))
        ends, both = np.concatenate((a, b)), np.concatenate((strength, strength))
        order = np.argsort(ends, kind="stable")
        ends, both = ends[order], both[order]
        first = np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1])))
        degree = np.diff(np.append(first, len(ends)))
        return pa.RecordBatch.from_arrays([pa.array(hashes[ends[first]]), pa.array(degree.astype(np.int64)), pa.array(np.maximum.reduceat(both, first))], ["h", "degree", "association"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield of(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in ("key", "n")))
                held, size = [], 0
        if size:
            yield of(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in ("key", "n")))

    return run


def strongest(texts: DataFrame, text_col: str, importance: DataFrame, letters: dict[str, str] | None = None) -> DataFrame:
    """(name, degree, association), as refine.strongest() has it, of names (name, importance) that stand side by side in texts, letters written as others."""
    spark = texts.sparkSession
    live = settled(importance.filter("importance > 0 and name <> ''").select("name", F.col("importance").cast("long").alias("importance")).mapInArrow(_hashed, "name string, importance long, h long"))
    if live.count() > MOST:
        beside = neighbour_counts(texts, text_col).select(written(F.col("a"), letters).alias("a"), written(F.col("b"), letters).alias("b"), "count")
        return R.strongest(importance, beside.filter("a <> b and a <> '' and b <> ''").groupBy(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).agg(F.sum("count").alias("count")))
    rows = live.select("h", "importance").toArrow()
    h = rows["h"].to_numpy()
    order = np.argsort(h)
    names = spark.sparkContext.broadcast((h[order], rows["importance"].to_numpy()[order]))
    pairs = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_numbered(names, letters), "key long, n long")
    ends = pairs.groupBy("key").agg(F.sum("n").alias("n")).mapInArrow(_strengths(names), "h long, degree long, association double")
    return live.join(ends.groupBy("h").agg(F.sum("degree").alias("degree"), F.max("association").alias("association")), "h").select("name", "degree", "association")

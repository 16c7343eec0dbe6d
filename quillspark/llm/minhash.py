"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification.

Two permutations serve for all coordinates of a signature. The first scatters the shingles over
the integers below 2**32; the second is a bijection of those, and coordinate k is the least value
that it gives to the shingles' places shifted circularly by k.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, bound_batches, cut, id_of, mix64, windows, with_place
from .components import close_members, linked_components

SHINGLE, BANDS, ROWS = 5, 28, 5
#: 64-bit words of a set's parity sketch.
PARITY = 8


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct n-word shingles; the whole sequence if it has fewer words."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    all_ = windows(hashes, n)
    out = []
    for first, count in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if count >= n:
            x = np.sort(all_[first : first + count - n + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(windows(hashes[first : first + count], count) if count else np.empty(0, np.uint64))
    return out


_PARITIES = [f"p{k}" for k in range(PARITY)]


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """A row of k circulant MinHash values for each set; sets must not be empty."""
    out = np.empty((len(sets), k), np.uint32)
    if sets:
        places = (mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
        begin = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1]))
        for i in range(k):
            out[:, i] = np.minimum.reduceat(second_permutation(places + np.uint32(i)), begin)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    out = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), 1))
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for r in range(rows):
        out = mix64(out ^ parts[:, :, r])
    return out.view(np.int64)


def parity_sketch(shingles: np.ndarray) -> list[int]:
    """For each of 64 * PARITY bins of shingles whether it holds an odd number; two sets differ in no fewer shingles than bins."""
    bins = (mix64(shingles ^ np.uint64(PARITY)) % np.uint64(64 * PARITY)).astype(np.int64)
    odd = (np.bincount(bins, minlength=64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _signed(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_sets(part.column("text"), n)
                full = [x for x in sets if len(x)]
                keys = iter(band_keys(signatures(full, bands * rows), bands, rows))
                yield pa.RecordBatch.from_arrays([
                    part.column("did"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                    pa.array([next(keys) if len(x) else None for x in sets], pa.list_(pa.int64())),
                    pa.array([dict(zip(_PARITIES, parity_sketch(x), strict=True)) if len(x) else None for x in sets], pa.struct([(c, pa.int64()) for c in _PARITIES])),
                ], ["did", "size", "key", "bands", "parity"])

    return run


def _similar(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text_a"):
                left, right = shingle_sets(part.column("text_a"), n), shingle_sets(part.column("text_b"), n)
                keep = []
                for x, y in zip(left, right, strict=True):
                    both = np.sort(np.concatenate((x, y)))
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A document's set is its distinct n-word
    shingles, the whole sequence if it has fewer words, and empty without words or text. Documents
    are linked if 100 * intersection >= percent * union; an empty set is linked with nothing.
    component_id is the smallest id reachable; kept is doc_id = component_id.

    Rows of equal sets are one class, which its smallest id stands for, so copies are never
    paired. The classes' signatures are banded; a bucket's classes are compared on the full sets
    of their texts, all that matter but few pairs (linked_components). Parity sketches rule out
    only pairs that cannot be linked. A pair of similarity s shares a band with probability
    1 - (1 - s**rows)**bands: 0.99999 at 0.8.

    Rows without id are linked with nothing, have a null component_id and are kept. Rows that
    share an id are one document for component_id; each has its own n_shingles, and all are kept
    if the id is. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    placed = with_place(docs, id_col, text_col).drop("th")
    signed = cut(placed.mapInArrow(_signed(n, bands, rows), "did long, size long, key binary, bands array<long>, parity struct<" + ", ".join(f"{c}: long" for c in _PARITIES) + ">"))
    sets = signed.filter("size > 0").filter(id_of("did").isNotNull())
    classes = sets.groupBy("key").agg(F.min("did").alias("id"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    members = classes.select("id", F.struct("size", "parity.*").alias("data"), F.explode("bands").alias("bucket"))

    def near(x, y):
        # Linked sets differ in no more than (100 - percent) / (100 + percent) of their summed sizes.
        bins = sum((F.bit_count(x[c].bitwiseXOR(y[c])) for c in _PARITIES), F.lit(0))
        both = x["size"] + y["size"]
        sizes = 100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"])
        return sizes & ((100 + percent) * bins <= (100 - percent) * both)

    def prepare(ids: DataFrame):
        texts = cut(placed.withColumnRenamed("did", "id").join(ids.hint("shuffle_hash"), "id", "left_semi"))

        def linked(pairs: DataFrame) -> DataFrame:
            left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            return both.select("a", "b", "text_a", "text_b").mapInArrow(_similar(n, percent), "a long, b long").distinct()

        return linked

    # An id that several rows share links their classes.
    many = sets.groupBy("did").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("did")
    shared = sets.join(many, "did", "left_semi").join(classes.select("key", "id"), "key").select(F.col("did").alias("a"), F.col("id").alias("b"))
    labels = linked_components(cut(close_members(members, near)), near, prepare, shared)
    of_class = classes.select("key", "id").join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("did", "key", F.col("size").alias("n_shingles")).join(of_class, "key", "left")
    component = F.when(id_of("did").isNotNull(), F.coalesce("component_id", "did"))
    return out.select(id_of("did").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("did"), F.lit(True)).alias("kept"))

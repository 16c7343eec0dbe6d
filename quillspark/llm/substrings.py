"""Repeated passages: level-wise doubling of the windows of words that occur more than once.

A window of a level's length that occurs once cannot be part of a longer repeat, so only repeated
windows are extended to twice their length, up to the length asked for. At the first level not
every window is counted: of the windows of that length inside one of the length asked for, the one
of least hash (the leftmost of equals) stands for it. Equal long windows have equal ones at the
same offset, so no repeat is lost, and about 2 in (length - base + 2) windows are counted. The next level counts such
stand-ins of twice the size, and only for long windows whose last stand-in repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, blocks, bound_batches, id_of, mix64, windows, with_place

_SCHEMA = "key long, did long, th long, pos int, known int"


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes the position of the least, the leftmost of equals."""
    at = np.arange(len(hashes))
    span = 1
    while span < width:
        step = min(span, width - span)
        if len(at) <= step:
            return at[:0]
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] < hashes[left], right, left)
        span += step
    return at


def _marked(key: np.ndarray, row: np.ndarray, did: np.ndarray, th: np.ndarray, pos: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows for the windows of one block of texts, of which one or two have the same key, so a passage in very many texts is dealt out.

    A window's place is its text and position; it repeats if its key has two places. Of a key's
    windows in the block, the first and one of another place go by the key; others, which are
    known to repeat, go by a key of their own, and copies of the first's place not at all. At the
    last level only the first goes by the key; all later ones are known not to be the first.
    """
    place = mix64(mix64(th[row].view(np.uint64)) + pos.astype(np.uint64))
    order = np.lexsort((pos, did[row], key))
    key, row, pos, place = key[order], row[order], pos[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    if last:  # a place of equal id and position is as early
        known = (did[row] != did[row[first]]) | (pos != pos[first])
        keep = np.ones(len(key), bool)
    else:
        other = place != place[first]
        so_far = np.cumsum(other)
        nth = so_far - (so_far - other)[first]
        known = other & (nth > 1)
        keep = new | other
    own = mix64(key ^ place ^ did[row].view(np.uint64))
    columns = (np.where(known, own, key).view(np.int64), did[row], th[row], pos.astype(np.int32), known.astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["key", "did", "th", "pos", "known"])


def _flat(words: Words, length: int) -> np.ndarray:
    """The positions, over all texts, from which a window of length words lies in one text."""
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.starts))
    return np.flatnonzero(left >= length)


def _rows_of(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text that holds each word position, and the position in it."""
    row = np.searchsorted(words.first, at, "right") - 1
    return row, at - words.first[row]


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("did").to_numpy(zero_copy_only=False), part.column("th").to_numpy(zero_copy_only=False)


def _level(length: int, size: int, before: int):
    """The stand-ins of size words for the windows of length words that are still alive.

    before is the last level's size: a window is alive if its stand-in of that size is among the
    row's live positions. 0 at the first level, where all windows are alive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=2 << 20):
                words = Words(part.column("text"))
                at = _flat(words, length)
                if not len(at):
                    continue
                hashes = words.hashes()
                if before:
                    live = np.zeros(len(hashes), bool)
                    live[_positions(words, part.column("live"))] = True
                    at = at[live[anchors(windows(hashes, before), length - before + 1)[at]]]
                if size < length:
                    at = np.unique(anchors(windows(hashes, size), length - size + 1)[at])
                row, pos = _rows_of(words, at)
                yield from _marked(windows(hashes, size)[at], row, *_ids(part), pos, size == length)

    return run


def _positions(words: Words, lists: pa.Array) -> np.ndarray:
    """Word positions over all texts, from a list of positions in each text."""
    counts = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy() + np.repeat(words.first[:-1], counts)


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                words = Words(part.column("text"))
                n = len(words.starts)
                edge = np.zeros(n + length + 1, np.int64)
                at = _positions(words, part.column("live"))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                whole = np.flatnonzero(part.column("copy").to_numpy(zero_copy_only=False) & (words.counts >= length))
                np.add.at(edge, words.first[whole], 1)
                np.add.at(edge, words.first[whole + 1], -1)
                keep = np.cumsum(edge)[:n] == 0
                texts, removed = [], []
                for first, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    kept = np.flatnonzero(keep[first:end]) + first
                    removed.append(end - first - len(kept))
                    texts.append(b" ".join([words.data[s:e].tobytes() for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("did"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["did", "n_words", "n_removed", "kept_text"]
                )

    return run


def drop_repeated_passages(docs: DataFrame, length: int = 20, base: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of docs.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Every word that lies in a window of length words
    whose words also start earlier (smaller id, or same id and earlier start) is removed; the kept
    ones are joined by one space. Windows are judged on the input. length is base times a power of 2.

    A level's windows are counted by their hash in one shuffle; a passage in very many texts sends
    at most two rows from each block of texts, so no task gets a large share of them. A copy of a
    whole text with a smaller id loses all its words if it has a window at all; it is told by the
    text's hash, and copies make no windows repeat. Texts are shuffled once, by row, and that
    shuffle serves the levels and the result.

    A null text has no words. A null id counts as the smallest. Rows that share an id are one
    document whose texts start at the same place: neither is earlier than the other, so equal rows
    keep the same words. An empty table gives an empty result; other columns are ignored.
    """
    if length < base or base < 1 or length % base or (length // base) & (length // base - 1):
        raise ValueError("length must be base times a power of two")
    bound_batches(docs.sparkSession)
    placed = with_place(docs, id_col, text_col)
    firsts = placed.groupBy("th").agg(F.min("did").alias("first"))
    live, before, size = None, 0, base
    key = Window.partitionBy("key")
    while True:
        texts = placed if live is None else placed.join(live.hint("shuffle_hash"), ["did", "th"])
        found = texts.mapInArrow(_level(length, size, before), _SCHEMA)
        if size == length:
            found = found.withColumn("rank", F.rank().over(key.orderBy("did", "pos"))).filter("rank > 1 or known = 1")
        else:
            ends = {f"{f.__name__}_{c}": f(c).over(key) for c in ("th", "pos") for f in (F.min, F.max)}
            found = found.withColumns(ends).filter("min_th < max_th or min_pos < max_pos or known = 1")
        live = found.groupBy("did", "th").agg(F.collect_list("pos").alias("live"))
        if not before:  # of equal texts only the first one's windows are followed up
            live = live.join(firsts, "th").filter(F.col("did") == F.col("first")).drop("first")
        if size == length:
            break
        before, size = size, 2 * size
    copies = placed.select("did", "th").join(firsts, "th").filter(F.col("did") != F.col("first")).select("did", "th").distinct()
    none = F.array().cast("array<int>")
    lost = live.select("did", "th", "live", F.lit(False).alias("copy")).union(copies.select("did", "th", none, F.lit(True)))
    flagged = placed.join(lost.hint("shuffle_hash"), ["did", "th"], "left").withColumns({"live": F.coalesce("live", none), "copy": F.coalesce("copy", F.lit(False))})
    out = flagged.mapInArrow(_kept(length), "did long, n_words long, n_removed long, kept_text string")
    return out.select(id_of("did").alias("doc_id"), "n_words", "n_removed", "kept_text")

"""Periodic runs of words: an online sparse dynamic programme over the diagonals of a text against itself.

A word's earlier occurrence at distance q lengthens the match on diagonal (lag) q; when a diagonal
ends, the match and the q words before it are a stretch of period q, which is emitted if it is long
enough. Taken word by word, a frequent word has all its earlier occurrences, so the work grows with
the square of its count. Here an occurrence counts only with its context: a run of period q has at
least k words matched in a row on its diagonal, where k >= q is a power of two, and of the earlier
places with the same k words the nearest one is exactly q back (were a nearer one at r, the stretch
would have the smaller period gcd(q, r)). So at each scale k one lag for each word suffices, and
places whose k words occur once leave for good. Contexts are named exactly, by pairs of the names of
their halves; no hash decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import blocks, bound_batches, pick

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("collapsed", pa.string())])
_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"


def first_scale(least: int, times: int) -> int:
    """The largest power of two of words that any run of least words and times periods matches in a row on its diagonal."""
    matched = min(max(least - q, (times - 1) * q) for q in range(1, max(least, 1) + 1))
    return 1 << (max(matched, 1).bit_length() - 1)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and numbers that name those."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    keep = counts[names] > 1
    return keep, names[keep]


def diagonals(at: np.ndarray, names: np.ndarray, k: int, above: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ended diagonals of lags in (above, k]: first place of the match, its number of places, lag. at ascends; a place's nearest earlier one of its name lengthens that lag's match."""
    order = np.argsort(names, kind="stable")
    lag = np.zeros(len(at), np.int64)
    same = names[order[1:]] == names[order[:-1]]
    lag[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
    active = (lag > above) & (lag <= k)
    at, lag = at[active], lag[active]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), lag[first]


def find_runs(words: np.ndarray, longest: int, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs in a sequence of word numbers, by start, then period.

    A run is a stretch that no neighbour extends, of smallest period q and length >= max(least,
    times * q); times is 3 at least. Texts that lie one after the other are parted by numbers that
    occur once; longest is the length of the longest text.
    """
    if times < 3 or least < 1:
        raise ValueError("times must be 3 or more, least 1 or more")
    base, k, found = first_scale(least, times), 1, [np.empty((0, 3), np.int64)]
    at = np.arange(len(words))
    keep, names = _repeated(words)
    at = at[keep]
    while len(at):
        if k >= base:
            begin, count, lag = diagonals(at, names, k, 0 if k == base else k // 2)
            length = count + (k - 1) + lag
            enough = length >= np.maximum(least, times * lag)
            found.append(np.stack([(begin - lag)[enough], length[enough], lag[enough]], axis=1))
            if times * (k + 1) > longest:  # no longer period has room
                break
        # a context of twice the length is the pair of its halves
        name_of = np.full(len(words) + k, -1, np.int64)
        name_of[at] = names
        both = name_of[at + k] >= 0
        at, pairs = at[both], names[both] * (len(words) + 1) + name_of[at[both] + k]
        keep, names = _repeated(pairs)
        at, k = at[keep], 2 * k
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def strongest_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length over period, of equals the first, then the one of least period."""
    return min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)


def _block(part: pa.RecordBatch, least: int, times: int) -> pa.RecordBatch:
    texts = [t.split() for t in pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()]  # on \x20\x09-\x0D
    counts = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])  # after each text one place that parts it from the next
    flat = np.empty(offsets[-1], object)
    for text, at in zip(texts, offsets.tolist(), strict=False):
        flat[at : at + len(text)] = text
        flat[at + len(text)] = None
    names = pd.factorize(flat)[0].astype(np.int64)
    parting = offsets[1:] - 1
    names[parting] = len(flat) + np.arange(len(parting))
    runs = find_runs(names, int(counts.max(initial=0)), least, times)
    text_of = np.searchsorted(offsets, runs[:, 0], "right") - 1
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edge)[:-1] == 0
    runs[:, 0] -= offsets[text_of]
    ends = np.searchsorted(text_of, np.arange(len(texts) + 1))
    rows = list(map(tuple, runs.tolist()))
    lists, best, collapsed = [], [], []
    for i, text in enumerate(texts):
        own = rows[ends[i] : ends[i + 1]]
        lists.append(own)
        best.append(strongest_of(own))
        kept = text if not own else [w for w, k in zip(text, keep[offsets[i] : offsets[i] + len(text)].tolist(), strict=True) if k]
        collapsed.append(b" ".join(kept).decode("utf-8", "replace"))
    as_run = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
    columns = [part.column("doc_id"), pa.array(counts), pa.array([[as_run(r) for r in x] for x in lists], pa.list_(_RUN)), pa.array([as_run(r) for r in best], _RUN), pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed) for each row of docs.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A run is a stretch of words with smallest
    period q (words q apart are equal) and length >= max(least, times * q) that no neighbouring word
    extends keeping period q. runs has all runs by start, then period; strongest is the one of
    greatest length / period (ties: smallest start, then period), null if there is none; collapsed
    are the words that no run contains after that run's first q words, joined by one space.

    Each row stands alone, so nothing is shuffled, rows that repeat give equal rows, and a lost task
    is only run again. A text of any length is worked on whole, in memory for its words and time for
    sorting them once a scale. A null or empty text has no words, no runs and an empty collapsed
    text; a null id stays null. An empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield _block(part, least, times)

    if times < 3 or least < 1:
        raise ValueError("times must be 3 or more, least 1 or more")
    bound_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.select(rows.doc_id.cast("long"), rows.text.cast("string")).mapInArrow(run, _DDL)

"""Ranked lexical search: hybrid of term-at-a-time and document-at-a-time evaluation over shards of documents.

One pass over the texts makes an inverted file of the queries' terms for each shard of documents, a
row each, kept as a table. Counts over all rows give the weights. In each shard a query's short
lists are summed into accumulators first; these then are one iterator with a bound among the long
lists, which go document at a time: lists whose bounds together cannot reach the k-th best score so
far are only probed for documents that others bring up. The k-th best travels on from shard to shard
of a task; the tasks' best rows meet at the end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Words, blocks, bound_batches, cut, id_of, scratch, text_buffers

#: A term: digits, letters and all beyond ASCII; only A-Z are lower-cased.
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = {k: k + 32 for k in range(65, 91)}
#: Each byte as a term has it, those between terms as a space.
_AS_TERMS = np.array([b + 32 if 65 <= b < 91 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
#: Bytes of text in a shard (a longer text comes alone), characters of queries answered in one pass.
SHARD_BYTES, QUERY_CHARS = 32 << 20, 32 << 20
#: A list is short if it has at most this share of a shard's documents.
SHORT = 1 / 32
#: Documents of a shard between two looks at the k-th best score.
STRIDE = 1024

_SHARD = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("did", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("term", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("doc", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
_SHARD_DDL = "n_docs long, n_terms long, did array<long>, n array<long>, term array<int>, df array<long>, doc array<int>, tf array<long>"


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, in order."""
    return [t.translate(_LOWER) for t in TERM.findall(text or "")]


class Vocabulary:
    """Terms found by hash among the words of texts, and compared byte by byte."""

    def __init__(self, terms: list[str]):
        self.data, ends = np.frombuffer(" ".join(terms).encode(), np.uint8), None
        words = Words.of(self.data, np.array([0, len(self.data)]))
        hashes = words.hashes()
        self.order = np.argsort(hashes)
        self.hashes, self.starts, self.ends = hashes[self.order], words.starts[self.order], words.ends[self.order]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and the terms' numbers."""
        if not len(self.hashes) or not len(words.starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = words.hashes()
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero((self.hashes[k] == hashes) & (self.ends[k] - self.starts[k] == words.ends - words.starts))
        k, sizes = k[at], (words.ends - words.starts)[at]
        if len(at):
            first = np.cumsum(sizes) - sizes
            inside = np.arange(sizes.sum()) - np.repeat(first, sizes)
            equal = words.data[np.repeat(words.starts[at], sizes) + inside] == self.data[np.repeat(self.starts[k], sizes) + inside]
            same = np.logical_and.reduceat(equal, first)
            at, k = at[same], k[same]
        return at, self.order[k]


class _Shard:
    """Postings of some documents, gathered text by text."""

    def __init__(self):
        self.bytes, self.n_docs, self.n_terms, self.size, self.parts = 0, 0, 0, 0, []

    def add(self, part: pa.RecordBatch, vocabulary: Vocabulary) -> None:
        data, offsets = text_buffers(part.column("text"))
        words = Words.of(_AS_TERMS[data], offsets)
        self.bytes += len(data)
        self.n_docs += int((words.counts > 0).sum())
        self.n_terms += len(words.starts)
        at, term = vocabulary.find(words)
        row = np.searchsorted(words.first, at, "right") - 1
        rows, row = np.unique(row, return_inverse=True)
        key, tf = np.unique(term * max(len(rows), 1) + row, return_counts=True)
        self.parts.append((part.column("did").to_numpy(zero_copy_only=False)[rows], words.counts[rows], key // max(len(rows), 1), key % max(len(rows), 1) + self.size, tf))
        self.size += len(rows)

    def row(self) -> pa.RecordBatch:
        did, n, term, doc, tf = (np.concatenate(x).astype(np.int64) for x in zip(*self.parts, strict=True))
        order = np.argsort(did, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        doc = place[doc]
        by = np.lexsort((doc, term))
        terms, df = np.unique(term, return_counts=True)
        lists = [[self.n_docs], [self.n_terms], [did[order]], [n[order]], [terms], [df], [doc[by]], [tf[by]]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(lists, _SHARD, strict=True)], schema=_SHARD)


def _index(vocabulary, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for part in blocks(batch, limit=1 << 20):
                if shard.parts and shard.bytes + (part.column("text").nbytes) > shard_bytes:
                    yield shard.row()
                    shard = _Shard()
                shard.add(part, vocabulary.value)
        if shard.parts:
            yield shard.row()

    return run


class Best:
    """The k best (score, did) of a query so far; of equal scores the smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.did = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """The score that a document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, did: np.ndarray) -> None:
        score, did = np.concatenate([self.score, score]), np.concatenate([self.did, did])
        order = np.lexsort((did, -score))[: self.k]
        self.score, self.did = score[order], did[order]


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The documents of some lists, ascending, and the sums of their gains."""
    if len(lists) == 1:
        return lists[0]
    doc, at = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    total = np.zeros(len(doc), np.int64)
    np.add.at(total, at, np.concatenate([g for _, g in lists]))
    return doc, total


def evaluate(lists: list[tuple[np.ndarray, np.ndarray]], did: np.ndarray, best: Best, short: float = SHORT, stride: int = STRIDE) -> int:
    """Adds a shard's best documents to best; each list has documents, ascending, and their gains, above 0. did ascends. Gives the number of gains that were read from long lists."""
    few = max(1, short * len(did))
    accumulators = [x for x in lists if len(x[0]) <= few]
    iterators = [x for x in lists if len(x[0]) > few]
    if accumulators:  # term at a time
        iterators.append(_summed(accumulators))
    iterators.sort(key=lambda x: int(x[1].max()))
    reach = np.cumsum([int(g.max()) for _, g in iterators])  # of a list and all of lower bounds together
    read = 0
    for begin in range(0, len(did), stride):  # documents in order
        least = best.least()
        passive = int(np.searchsorted(reach, least, "left"))  # these together stay below
        if passive == len(iterators):
            break
        active = []
        for doc, gain in iterators[passive:]:
            a, b = np.searchsorted(doc, (begin, begin + stride))
            if a < b:
                active.append((doc[a:b], gain[a:b]))
                read += int(b - a)
        if not active:
            continue
        doc, total = _summed(active)
        for j in range(passive - 1, -1, -1):
            keep = total + reach[j] >= least
            doc, total = doc[keep], total[keep]
            if not len(doc):
                break
            other, gain = iterators[j]
            k = np.minimum(np.searchsorted(other, doc), len(other) - 1)
            hit = other[k] == doc
            total = total + np.where(hit, gain[k], 0)
            read += int(hit.sum())
        keep = total >= least
        if keep.any():
            best.add(total[keep], did[doc[keep]])
    return read


def _search(queries, weights, n_all: int, terms_all: int, k: int):
    """The k best documents of each query over a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = queries.value, weights.value
        found = [Best(k) for _ in asked]
        slot = np.full(len(weight), -1, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                did, n, term, df, doc, tf = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("did", "n", "term", "df", "doc", "tf"))
                if not len(term):
                    continue
                m = 75 + (25 * n * n_all) // terms_all
                gain = np.repeat(weight[term], df) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                ends = np.cumsum(df)
                slot[term] = np.arange(len(term))
                lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for j, s in enumerate(zip((ends - df).tolist(), ends.tolist(), strict=True)):
                    d, g = doc[s[0] : s[1]], gain[s[0] : s[1]]
                    above = g > 0
                    lists[j] = (d, g) if above.all() else (d[above], g[above])
                for (own, times), best in zip(asked, found, strict=True):
                    at = slot[own]
                    its = [(lists[j][0], lists[j][1] * c) if c > 1 else lists[j] for j, c in zip(at.tolist(), times, strict=True) if j >= 0 and len(lists[j][0])]
                    if its:
                        evaluate(its, did, best)
                slot[term] = -1
        sizes = [len(b.score) for b in found]
        columns = [np.repeat(np.arange(len(found)), sizes).astype(np.int32), *(np.concatenate([np.empty(0, np.int64), *(getattr(b, c) for b in found)]) for c in ("did", "score"))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "did", "score"])

    return run


def _answer(rows: list, docs: DataFrame, k: int, shard_bytes: int, written) -> DataFrame:
    """The ranking of one block of queries, rows of (id, text)."""
    spark = docs.sparkSession
    counts = [Counter(terms_of(text)) for _, text in rows]
    terms = sorted(set().union(*counts))
    number = {t: j for j, t in enumerate(terms)}
    queries = [(np.array([number[t] for t in c], np.int64), list(c.values())) for c in counts]
    shards = written(docs.mapInArrow(_index(spark.sparkContext.broadcast(Vocabulary(terms)), shard_bytes), _SHARD_DDL))
    n_all, terms_all = (int(x or 0) for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    lists = shards.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    weights = np.zeros(max(len(terms), 1), np.int64)
    for term, df in lists.collect():  # a row for each of the queries' terms
        weights[term] = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1)))
    share = spark.sparkContext.broadcast
    return shards.drop("n_docs", "n_terms").mapInArrow(_search(share(queries), share(weights), n_all, max(terms_all, 1), k), "query int, did long, score long")


def search(queries: DataFrame, docs: DataFrame, k: int = 20, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, query_chars: int = QUERY_CHARS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents of highest score above 0 for each row of queries, of equal scores the smaller ids first.

    Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are
    lower-cased. With N documents that have a term, L terms in all, n in a document, df documents
    with a term and tf in one, a term's weight is w = floor(1000 ln((2N + 2) / (2df + 1))), a
    document's m is 75 + 25nN div L, and its score the sum of w * (10^9 tf div (1000 tf + 12 m))
    over the query's terms, repeats included.

    Queries are the stated set: they are answered in blocks of about query_chars characters, each by one pass over all
    documents; a block's terms and their counts are held by the driver and every task. Texts are
    never shuffled. Shards hold about shard_bytes of text; a task's memory is bounded by one shard
    and k rows a query, and what meets at the end by k rows a query and task.

    A null text has no terms, a query without terms no rows. A null document id counts as the
    smallest and stays null. Rows that repeat are each ranked, and each row of queries is answered.
    Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    asked = queries.select(F.col(f"`{query_id}`").alias("id"), F.col(f"`{query_text}`").cast("string").alias("text"))
    kind = asked.schema["id"].dataType.simpleString()
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("did"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks, parts = 1 + chars // query_chars, []
    with scratch(spark) as written:
        for block in range(n_blocks):
            rows = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block).collect()]
            if not rows:
                continue
            found = _answer(rows, texts, k, shard_bytes, written)
            order = Window.partitionBy("query").orderBy(F.desc("score"), "did")
            found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            ids = spark.createDataFrame([(j, r[0]) for j, r in enumerate(rows)], f"query int, id {kind}")
            parts.append(cut(found.join(F.broadcast(ids), "query").select(F.col("id").alias(query_id), "rank", id_of("did").alias("doc_id"), "score")))
    if not parts:
        return spark.createDataFrame([], f"`{query_id}` {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

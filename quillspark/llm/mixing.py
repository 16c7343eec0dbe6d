"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Every document is cut into blocks of words. A source's quota is filled by whole passes over its
blocks and by one partial pass. A pass permutes the blocks by hash, and the permutation deals them
to the output shards. How much of a partial pass each shard takes is drawn by a tree: a node splits
the sources' quotas over its halves by hypergeometric draws without replacement from what the
halves hold, down to the shards, so that the quotas stay exact and no shard is asked for more than
it holds. A shard then takes its permuted blocks until its leaf's quota is met, which draws
disjoint blocks, and shuffles them. Quotas are counted in words, as a document's last block is short.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, id_of

WEIGHTS, MOST, BLOCK_WORDS, SEED = (5.0, 2.0, 1.0), 3.0, 1024, 0
#: An output shard has about so many blocks, as one task shuffles it.
SHARD_BLOCKS = 1 << 15
#: The tree has at least so many levels.
LEAST_DEPTH = 3
#: So many of a shard's rows lie together, in order.
RUN = 2048
#: The table of shards and sources is drawn on the driver and sent to all: shards are larger rather than its cells more.
MAX_CELLS = 1 << 20
_WORD = r"[^\x20\x09-\x0D]+"
#: numpy draws from populations below that.
_POPULATION = 10**9


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, most: float = MOST) -> list[float]:
    """Each source's share of all sizes by weight (repeating), none above most times its size; excess is reshared by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    live = [k for k, n in enumerate(sizes) if n > 0]
    rest = total
    while live:
        share = rest / sum(weight[k] for k in live)
        full = [k for k in live if share * weight[k] > most * sizes[k]]
        if not full:
            for k in live:
                out[k] = share * weight[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            rest -= out[k]
        live = [k for k in live if k not in set(full)]
    return out


def halved(left: np.ndarray, right: np.ndarray, quota: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of quota words, drawn from left and right without replacement, come from left; for all cells at once.

    Beyond numpy's range words are drawn in bundles of one size, and what they leave over goes where there is room.
    """
    most = max(int(left.max(initial=0)), int(right.max(initial=0)))
    bundle = 1 + most // _POPULATION
    good, bad = left // bundle, right // bundle
    drawn = rng.hypergeometric(good, bad, np.minimum(quota // bundle, good + bad)) * bundle
    return np.clip(drawn, np.maximum(0, quota - right), np.minimum(quota, left))


def split(held: np.ndarray, quotas: np.ndarray, seed: int = SEED) -> np.ndarray:
    """(shard, source) quotas: each source's quota over the shards, a power of two, that hold (shard, source) words."""
    levels = [np.asarray(held, np.int64)]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][::2] + levels[-1][1::2])
    level = np.asarray(quotas, np.int64)[None, :]
    for d, below in enumerate(reversed(levels[:-1])):
        left = halved(below[::2], below[1::2], level, np.random.default_rng([seed, d]))
        level = np.stack((left, level - left), 1).reshape(below.shape)
    return level


def depth_of(blocks: int, sources: int, shard_blocks: int = SHARD_BLOCKS) -> int:
    """The tree's depth: as many shards, a power of two, as keep each to about shard_blocks and the table to MAX_CELLS."""
    wanted = max(LEAST_DEPTH, int(np.ceil(np.log2(max(1, blocks) / shard_blocks))))
    return min(wanted, max(0, int(np.log2(MAX_CELLS / max(1, sources)))))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(did, th, source, size, copies) of the distinct rows; size is the text's number of words."""
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text, source).alias("th"), source.alias("source"), size.alias("size"))
    return rows.groupBy("did", "th", "source", "size").agg(F.count("*").alias("copies"))


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, sid, source_size, target, passes, rest) for each source of measured rows, by code point, null last. The driver holds a row for each source."""
    stats = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    stats.sort(key=lambda r: (r.source is None, r.source or ""))
    quota = targets([r.n for r in stats], weights, most)
    out = [(r.source, k, r.n, t, round(t) // r.n if r.n else 0, round(t) % r.n if r.n else 0) for k, (r, t) in enumerate(zip(stats, quota, strict=True))]
    return rows.sparkSession.createDataFrame(out, "source string, sid int, source_size long, target double, passes long, rest long")


def draw(rows: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(did, th, sid, pass, block, first_word, words, copies, shard, position): the blocks that the shards take.

    A pass's permutation, by hash, deals a source's blocks to the shards; of whole passes they take
    all, of the partial pass what the tree draws for them, the last block trimmed to the quota. So
    the words taken come to the source's target but for rounding. Copies of a row are drawn together.
    The driver holds a cell for each shard and source, at most MAX_CELLS.
    """
    known = rows.filter("size > 0").join(F.broadcast(sources), rows.source.eqNullSafe(sources.source)).drop("source")
    last = F.col("passes") - F.when(F.col("rest") == 0, 1).otherwise(0)
    n_blocks = F.floor((F.col("size") - 1) / block_words) + 1
    count = known.filter(last >= 0).agg(F.sum(n_blocks * (last + 1)).alias("n"), F.max("sid").alias("top")).first()
    n_sources = 1 + (-1 if count.top is None else count.top)
    depth = depth_of(count.n or 0, n_sources, shard_blocks)
    passes = known.filter(last >= 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = passes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    blocks = blocks.withColumns({"first_word": F.col("block") * block_words, "h": F.xxhash64(F.lit(seed), "pass", "did", "th", "block")})
    shard = F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)
    blocks = blocks.withColumns({"words": F.least(F.lit(block_words), F.col("size") - F.col("first_word")), "shard": shard})
    partial = blocks.filter(F.col("pass") == F.col("passes"))

    # Down the tree, from what the shards hold of each source to what they take.
    held, quotas = np.zeros((1 << depth, n_sources), np.int64), np.zeros(n_sources, np.int64)
    cells = partial.groupBy("sid", "shard", "rest").agg(F.sum(F.col("words") * F.col("copies")).alias("w")).toArrow()
    sid, at, rest, words = (cells[c].to_numpy() for c in ("sid", "shard", "rest", "w"))
    held[at, sid], quotas[sid] = words, rest
    leaves = split(held, quotas, seed)
    drawn = rows.sparkSession.createDataFrame([(k, leaves[:, k].tolist()) for k in range(n_sources)], "sid int, leaves array<long>")

    here = Window.partitionBy("sid", "shard").orderBy("h", "did", "th", "block").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum(F.col("words") * F.col("copies")).over(here), F.lit(0))
    ranked = partial.withColumn("upto", upto).join(F.broadcast(drawn), "sid")
    left = F.floor((F.element_at("leaves", F.col("shard") + 1) - F.col("upto")) / F.col("copies"))
    columns = ["did", "th", "sid", "pass", "block", "first_word", "words", "copies", "shard", "h"]
    taken = ranked.withColumn("words", F.least("words", left)).filter("words > 0").select(columns)
    taken = taken.unionByName(blocks.filter(F.col("pass") < F.col("passes")).select(columns))
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), F.lit("shuffle"), "h"), "did", "th", "pass", "block")
    return taken.withColumn("position", F.row_number().over(shuffled) - 1).drop("h")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix of docs' sources: (documents, blocks).

    documents: (doc_id, size, source, source_size, target, taken, shards) for each row of docs; taken
    is the number of its words that the shards take, repeats counted, no more than most times its
    size rounded up to whole passes, and shards those that take any. blocks: (doc_id, th, pass, block, first_word, words, shard, position), the
    mix itself; a block is words first_word to first_word + words of its document.

    Targets share all words by weight, see targets(); taken words of a source come to its rounded
    target, less in each shard at most the copies of one row. A null text has no words; a row without words is
    never taken; a null source is a source, the last; a null id is allowed. Rows of equal id, text
    and source are drawn alike. An empty table gives empty results; other columns are ignored. The
    same rows give the same mix, however they are partitioned.
    """
    rows = cut(measured(docs, id_col, text_col, source_col))
    sources = plan(rows, weights, most)
    blocks = draw(rows, sources, block_words, shard_blocks, seed)
    taken = blocks.groupBy("did", "th").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    known = rows.join(F.broadcast(sources), rows.source.eqNullSafe(sources.source)).drop(sources.source)
    out = known.join(taken, ["did", "th"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    documents = out.select(id_of("did").alias("doc_id"), "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    return documents, blocks.select(id_of("did").alias("doc_id"), "did", "th", "pass", "block", "first_word", "words", "shard", "position")


def mixed_texts(docs: DataFrame, blocks: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The shards of the mix, in order and shuffled within: docs once for each shard and pass that takes part of a row, with the words taken as text.

    A wholly taken text is unchanged, of others the words are joined by one space. All columns of
    docs pass through, whatever their names.
    """
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    parts = blocks.groupBy("did", "th", "pass", "shard").agg(F.array_sort(F.collect_list(F.struct("first_word", "words"))).alias("parts"), F.sum("words").alias("taken"), F.min("position").alias("position"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text, source).alias("th"), text.alias("text"), F.struct(F.lit(None).alias(text_col), *rest).alias("row"))
    some = F.transform(F.array(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))), lambda w: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(w, (p["first_word"] + 1).cast("int"), p["words"].cast("int")))), " "))
    whole = F.regexp_count("text", F.lit(_WORD)) == F.col("taken")
    out = rows.join(parts, ["did", "th"]).withColumn("text", F.when(whole, F.col("text")).otherwise(F.element_at(some, 1)))
    laid = out.repartition("shard", F.floor(F.col("position") / RUN)).sortWithinPartitions("shard", "position")
    return laid.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])

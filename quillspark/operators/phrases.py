"""Phrases that a text repeats and sentences that run on, by the family of its language.

Both work where the text lies: a phrase never leaves its text, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .checks import SPACED, WORD

CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
#: Words or characters that are looked at together.
TOKENS = 1 << 20


def best_repeats(ids: np.ndarray, run: np.ndarray, row: np.ndarray, chars: np.ndarray, gap: int, sizes: Sequence[int], least: int, alive: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(row, at, size, count) of the most repeated gram of each row, ties to the longest and then the earliest.

    Tokens have an id, a run that grams do not cross, a row, a length; gap characters lie between
    two of a gram. A gram is repeated least times only if the gram before its last token is, so each
    size looks at what is left of the size before.
    """
    upto = np.concatenate(([0], np.cumsum(chars)))
    at = np.arange(len(ids)) if alive is None else np.flatnonzero(alive)
    code, top, found = row[at].astype(np.int64), 1 + int(ids.max(initial=0)), []
    for n in range(1, max(sizes) + 1):
        fits = at + n <= len(ids)
        at, code = at[fits], code[fits]
        fits = run[at + n - 1] == run[at]
        at, code = at[fits], code[fits]
        _, first, code, count = np.unique(code * top + ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        if n in sizes:
            winners = np.flatnonzero(count >= least)
            p = at[first[winners]]
            found.append(np.stack((row[p], -count[winners], -(upto[p + n] - upto[p] + gap * (n - 1)), p, np.full(len(p), n))))
        kept = count[code] >= least
        at, code = at[kept], code[kept]
    rows = np.concatenate(found, 1)
    rows = rows[:, np.lexsort(rows[3::-1])]
    rows = rows[:, np.unique(rows[0], return_index=True)[1]]
    return [(int(r), int(p), int(n), -int(c)) for r, c, _, p, n in rows.T]


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about TOKENS together; one row may be more."""
    marks = np.cumsum(sizes) // TOKENS
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def _of_words(words: pa.ListArray, sizes: Sequence[int], least: int) -> Iterator[tuple[int, str, int]]:
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    flat = words.flatten().dictionary_encode()
    ids, names = flat.indices.to_numpy(), flat.dictionary
    chars, row = pc.utf8_length(names).to_numpy()[ids], np.repeat(np.arange(len(n)), n)
    for r, at, size, count in best_repeats(ids, row, row, chars, 1, sizes, least):
        yield r, " ".join(names.take(pa.array(ids[at : at + size])).to_pylist()), count


def _of_characters(runs: pa.StringArray, sizes: Sequence[int], least: int) -> Iterator[tuple[int, str, int]]:
    texts = [f"{t or ''}\n" for t in runs.to_pylist()]
    whole = "".join(texts)
    ids = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = ids == ord("\n")
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for r, at, size, count in best_repeats(ids, np.cumsum(ends), row, np.ones(len(ids), np.int64), 0, sizes, least, ~ends):
        yield r, whole[at : at + size], count


def repeated_phrases(texts: DataFrame, id_col: str, text_col: str, family: Column, words: Sequence[int] = (3, 4, 5), characters: Sequence[int] = (3, 4, 5, 6), least: int = 3) -> DataFrame:
    """(version, family, gram, count): for each row of texts the most repeated run of words and of CJK characters.

    family is whitespace (lower-case words), cjk (characters, within runs of them) or both, which
    may give a row of each; null is both. Occurrences may overlap. Ties go to the longest phrase and then the
    earliest. A null or empty text has none; rows that share an id are texts of their own. Whole texts, without a shuffle.
    """
    text, kind = F.col(f"`{text_col}`").cast("string"), F.coalesce(family, F.lit("both"))
    spoken = F.when(kind != "cjk", F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    written = F.when(kind != "whitespace", F.array_join(F.regexp_extract_all(text, F.lit(CJK + "++"), F.lit(0)), "\n"))
    rows = texts.select(F.col(f"`{id_col}`").alias("version"), spoken.alias("w"), written.alias("c"))
    schema = StructType([rows.schema["version"], *(StructType().add("family", StringType()).add("gram", StringType()).add("count", LongType()))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.add(pc.fill_null(pc.list_value_length(batch["w"]), 0), pc.fill_null(pc.utf8_length(batch["c"]), 0))
            for a, b in _parts(size.to_numpy()):
                part = batch.slice(a, b - a)
                hits = [("whitespace", *x) for x in _of_words(part["w"], words, least)] + [("cjk", *x) for x in _of_characters(part["c"], characters, least)]
                versions = part["version"].take(pa.array([h[1] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([versions, pa.array([h[0] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.string()), pa.array([h[3] for h in hits], pa.int64())], names=["version", "family", "gram", "count"])

    return rows.mapInArrow(found, schema)


def abnormal_sentences(texts: DataFrame, id_col: str, text_col: str, family: Column, words: int = 60, characters: int = 200) -> DataFrame:
    """(version, unit, sentence, length): ended sentences with too many words (words) or CJK characters (cjk_chars), numbered in their text from 0.

    CJK sentences end at marks of either width or an ellipsis, others at ASCII marks, and neither
    crosses a line; what has no mark at its end is no sentence. family as in repeated_phrases().
    """
    text, kind = F.col(f"`{text_col}`").cast("string"), F.coalesce(family, F.lit("both"))
    rows = texts.select(F.col(f"`{id_col}`").alias("version"), text.alias("text"), kind.alias("kind"))

    def of(unit: str, other: str, ends: str, piece: str, most: int) -> DataFrame:
        # An end is optional in the pattern, so that a text without one is passed over once.
        found = F.filter(F.regexp_extract_all("text", F.lit(rf"[^{ends}\n]++[{ends}]?"), F.lit(0)), lambda s: s.rlike(f"[{ends}]$"))
        sentences = rows.filter(F.col("kind") != other).select("version", F.posexplode(found).alias("sentence", "s"))
        counted = sentences.select("version", F.lit(unit).alias("unit"), F.col("sentence").cast("long").alias("sentence"), F.regexp_count("s", F.lit(piece)).cast("long").alias("length"))
        return counted.filter(F.col("length") > most)

    return of("cjk_chars", "whitespace", "。！？.!?…", CJK, characters).unionByName(of("words", "cjk", ".!?", SPACED, words))

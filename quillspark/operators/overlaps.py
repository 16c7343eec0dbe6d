"""All dictionary names inside texts, overlapping ones too, without token borders where a language has none.

A text's substrings of every length that a name has are told by rolling hashes; those whose hash is
not among the dictionary's, in a bit map of bounded size, are passed over where the text lies. What is
left meets the dictionary in an equi-join on the string itself, so the map only saves work: the
result is exact for a dictionary of any size, and no text is shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import match_key
from ..session import settled

#: The bit map's least and largest size as powers of two, 2 and 16 MB, and its bits a name in between: with two bits set a name, about one in 1,000 other strings is in it.
MAP_BITS, MOST_MAP_BITS, PER_NAME = 24, 27, 64
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Hashes of all substrings of a text, from its code points."""

    def __init__(self, text: str | np.ndarray):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if isinstance(text, str) else text
        n = len(self.points)
        up = np.full(n + 1, _BASE)
        down = np.full(n + 1, _INVERSE)
        up[0] = down[0] = 1
        self.down = np.cumprod(down, dtype=_U)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_mixed(self.points.astype(_U) + _U(1)) * np.cumprod(up, dtype=_U)[:-1], out=self.sums[1:], dtype=_U)

    def hashes(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """The hash of the substring of that length, one for all or one each, at each start."""
        return _mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts] + _U(length))


def _listed(hashes: np.ndarray, bit_map: np.ndarray) -> np.ndarray:
    """The places of the hashes whose two bits, by their upper and lower bits, the map has."""
    bits = (64 * len(bit_map)).bit_length() - 1
    has = lambda slot: (bit_map[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63)).astype(np.int64)) & 1 == 1
    found = np.flatnonzero(has(hashes >> _U(64 - bits)))
    return found[has(hashes[found] & _U((1 << bits) - 1))]


#: Of each code point whether it is part of a word, -1 where that was not looked up yet.
_WORDS = np.full(0x110000, -1, np.int8)


def in_word(points: np.ndarray) -> np.ndarray:
    """Which code points are letters, digits, _ or -."""
    new = points[_WORDS[points] < 0]
    for c in np.unique(new).tolist():
        _WORDS[c] = chr(c) in "_-" or unicodedata.category(chr(c))[0] in "LN"
    return _WORDS[points] == 1


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, length) of names."""
    for batch in batches:
        names = batch.column("alias").to_pylist()
        hashes = np.array([int(Rolling(n).hashes(np.zeros(1, np.int64), len(n))[0]) for n in names], _U)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array([len(n) for n in names], pa.int32())], ["hash", "length"])


def _hits(texts: list[str], cjk: np.ndarray, lengths: list[int], bit_map: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the substrings that the map has and that stand alone where words have borders; start counts from the first text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    roll, owner = Rolling("".join(texts)), np.repeat(np.arange(len(texts)), sizes)
    n, first = len(owner), np.concatenate([[0], np.cumsum(sizes)])
    upto, found = first[owner + 1], []

    def look(at: np.ndarray, size: int | np.ndarray) -> None:
        hit = _listed(roll.hashes(at, size), bit_map)
        found.append((at[hit], np.broadcast_to(size, len(at))[hit]))

    at = np.flatnonzero(cjk[owner])
    for length in lengths:
        at = at[at + length <= upto[at]]  # lengths rise
        look(at, length)
    # Elsewhere a name may begin after a border and end before one, so the borders behind a start are gone through.
    word, longest = in_word(roll.points), max(lengths, default=0)
    open_ = np.ones(n + 1, bool)
    open_[:n] = ~word
    open_[first] = True
    begins = np.ones(n, bool)
    begins[1:] = ~word[:-1]
    begins[first[:-1][sizes > 0]] = True
    borders, at = np.append(np.flatnonzero(open_), n + 1), np.flatnonzero(begins & ~cjk[owner])
    wanted = np.zeros(longest + 1, bool)
    wanted[lengths] = True
    k = np.cumsum(open_)[at]
    while len(at):
        size = borders[k] - at
        keep = (size <= longest) & (borders[k] <= upto[at])
        at, k, size = at[keep], k[keep] + 1, size[keep]
        fits = wanted[size]
        look(at[fits], size[fits])
    at, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    return owner[at], at, size


#: Characters of texts that are looked through at once; a longer text comes alone.
BLOCK = 1 << 18


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring texts of about BLOCK characters."""
    begin = total = 0
    for k, text in enumerate(texts):
        if k > begin and total + len(text) > BLOCK:
            yield begin, k
            begin, total = k, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _candidates(lengths: list[int], bit_map, around: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cjk = batch.column("cjk").to_numpy(zero_copy_only=False).astype(bool)
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for begin, stop in _blocks(texts):
                part = texts[begin:stop]
                row, at, size = _hits(part, cjk[begin:stop], lengths, bit_map.value)
                if not len(at):
                    continue
                at = at - np.concatenate([[0], np.cumsum([len(t) for t in part])])[row]
                end = at + size
                keys = [batch.column(c).take(pa.array(row + begin)) for c in batch.schema.names if c not in ("text", "cjk")]
                places = list(zip(row.tolist(), at.tolist(), end.tolist(), strict=True))
                names = pa.array([part[r][a:e] for r, a, e in places], pa.string())
                columns = [*keys, pa.array(at), pa.array(end), names]
                if around:
                    columns.append(pa.array([part[r][max(0, a - around) : a] for r, a, _ in places], pa.string()))
                    columns.append(pa.array([part[r][e : e + around] for r, _, e in places], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*[c for c in batch.schema.names if c not in ("text", "cjk")], "start", "end", "alias", *["before", "after"] * bool(around)])

    return run


def _map_of(names: DataFrame) -> tuple[list[int], np.ndarray]:
    """The lengths of names (alias) and their bit map."""
    hashes = settled(names.select("alias").distinct().mapInArrow(_hashes, "hash long, length int"))
    bits = min(MOST_MAP_BITS, max(MAP_BITS, (PER_NAME * hashes.count()).bit_length()))
    slots = hashes.select(F.explode(F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()  # 2 ** 21 rows at most
    bit_map = np.zeros(1 << (bits - 6), np.int64)
    bit_map[words["word"].to_numpy()] = words["bits"].to_numpy()
    return sorted(r[0] for r in hashes.select("length").distinct().collect()), bit_map


def _inner(lengths: list[int], bit_map):
    """(alias, most) of the substrings of names that the map has, without the names themselves, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = batch.column("name").to_pylist(), batch.column("count").to_numpy(zero_copy_only=False)
            text, sizes = "".join(names), np.array([len(n) for n in names], np.int64)
            roll, owner = Rolling(text), np.repeat(np.arange(len(names)), sizes)
            upto = np.cumsum(sizes)[owner]
            for length in lengths:
                at = np.arange(max(0, len(text) - length + 1))
                at = at[(at + length <= upto[at]) & (sizes[owner[at]] > length)]
                at = at[_listed(roll.hashes(at, length), bit_map.value)]
                if not len(at):
                    continue
                most: dict[str, int] = {}
                for a, n in zip(at.tolist(), counts[owner[at]].tolist(), strict=True):
                    piece = text[a : a + length]
                    if n > most.get(piece, -1):
                        most[piece] = n
                yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.string()), pa.array(list(most.values()), pa.int64())], ["alias", "most"])

    return run


def most_inside(names: DataFrame, pieces: DataFrame) -> DataFrame:
    """(alias, most): for each piece (alias) that lies in a longer one of names (name, count), the highest count of those.

    A batch of names is looked through at once, and of each piece only the highest count leaves it.
    """
    pieces = pieces.select("alias").filter("alias <> ''").distinct()
    lengths, bit_map = _map_of(pieces)
    rows = names.filter("name is not null").select("name", F.col("count").cast("long").alias("count"))
    found = rows.mapInArrow(_inner(lengths, names.sparkSession.sparkContext.broadcast(bit_map)), "alias string, most long")
    return found.groupBy("alias").agg(F.max("most").alias("most")).join(pieces, "alias")


def overlap_matches(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, cjk: Column, folded: bool = False, variants: dict[str, str] | None = None, around: int = 0) -> DataFrame:
    """(id, start, end, alias, target_id): every place of a text where an alias (alias, target_id) stands, overlaps included.

    Where cjk is true any substring counts; elsewhere no letter, digit, _ or - may stand beside it. Places are
    code points from 0. folded compares texts and aliases by match_key, with places in the folded
    text; then alias is the key. An alias that means several targets gives a row for each. Null and
    empty texts and aliases match nothing; texts that share an id each give their rows.
    With around, columns before and after have up to that many characters of the text on either side.
    """
    spark = texts.sparkSession
    names = aliases.select(F.col("alias").cast("string").alias("alias"), "target_id").filter("alias <> ''")
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(cjk, F.lit(False)).alias("cjk"))
    if folded:
        base = F.when(F.col("cjk"), "zh").otherwise("")
        names = names.withColumn("alias", match_key(F.col("alias"), F.lit("zh"), variants)).filter("alias <> ''").distinct()
        rows = rows.withColumn("text", match_key(F.col("text"), base, variants))
    names = settled(names)  # read for the map's bits, for its lengths and for the join
    lengths, bit_map = _map_of(names)
    kind = rows.schema["id"].dataType.simpleString()
    sides = ["before", "after"] if around else []
    ddl = f"id {kind}, start long, end long, alias string" + "".join(f", {c} string" for c in sides)
    found = rows.mapInArrow(_candidates(lengths, spark.sparkContext.broadcast(bit_map), around), ddl)
    return found.join(names, "alias").select("id", "start", "end", "alias", "target_id", *sides)

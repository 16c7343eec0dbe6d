"""Counts over Han texts, made where a text lies: neighbouring pairs, grown surfaces, and blocks that hold surfaces together.

A block's places are worked out side by side in arrays and only counts leave the task, so what is
shuffled grows with the different surfaces, not with the texts. Surfaces are told apart by 64-bit
hashes. Blocks that share an id go by the rows of grown_occurrences() instead, as they need each other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from . import zh_names as Z
from .overlaps import _U, Rolling

HAN = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
#: Characters that are worked on at once; no character, where a block ends; bits of the map of seeds; rows of counts that a task holds.
PART, NONE, SEED_BITS, HELD = 1 << 20, 0x110000, 20, 1 << 21
#: Codes of a surface's blocks, and of those where it is a seed, among those of what stands on its sides.
ANY, OWN = -1, -2
#: By how many characters a seed grows to the left and to the right.
GROWTHS = ((0, 1), (0, 2), (1, 0), (1, 1), (2, 0))
BLOCK_IDS = 10_000_000


def is_han(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for lo, hi in HAN:
        out |= (points >= lo) & (points <= hi)
    return out


class Form:
    """How texts are read: cut into blocks of size characters (0: each is a block), with letters written as others or, if those are empty, left out."""

    def __init__(self, size: int = 0, letters: dict[str, str] | None = None):
        self.size, self.table = size, None
        if letters:
            self.table = np.arange(max(map(ord, letters)) + 1, dtype=np.uint32)
            for c, other in letters.items():
                self.table[ord(c)] = ord(other) if other else NONE

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' characters in one, and each block's start with the end."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([0, *map(len, texts)])
        if self.table is not None:
            points = np.where(points < len(self.table), self.table[np.minimum(points, len(self.table) - 1)], points)
            stays = points != NONE
            ends = np.concatenate(([0], np.cumsum(stays)))[ends]
            points = points[stays]
        if not self.size:
            return points, ends
        n = -(-np.diff(ends) // self.size)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return points, np.append(np.repeat(ends[:-1], n) + inner * self.size, ends[-1])


def cut(texts: DataFrame, size: int) -> DataFrame:
    """(id, text) of blocks of size characters; a block's id is the text's times BLOCK_IDS and its number."""
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return texts.select("id", F.posexplode(blocks).alias("k", "text")).select((F.col("id") * BLOCK_IDS + F.col("k")).alias("id"), "text")


def written(text: Column, letters: dict[str, str] | None) -> Column:
    if not letters:
        return text
    order = sorted(letters, key=lambda c: letters[c] == "")  # what has no counterpart is left out
    return F.translate(text, "".join(order), "".join(letters[c] for c in order))


def _parts(batches: Iterator[pa.RecordBatch], form: Form) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts' characters in one, and each block's start with the end, for about PART characters; a longer text comes in parts if it is cut into blocks."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= PART):
                size += len(texts[stop])
                stop += 1
            points, begin = form.read(texts[at:stop])
            step = max(PART // form.size, 1) if form.size else len(begin)
            for k in range(0, len(begin) - 1, step):
                some = begin[k : k + step + 1]
                yield points[some[0] : some[-1]], some - some[0]
            at = stop


def _string(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _values(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and how often each is there, by a hash table, as few keys repeat often."""
    found = pc.value_counts(pa.array(keys))
    return found.field(0).to_numpy(), found.field(1).to_numpy()


def _begins(points: np.ndarray, word: str) -> np.ndarray:
    """Where a word begins, whatever the borders."""
    out = np.zeros(len(points), bool)
    n = len(points) - len(word) + 1
    if n > 0:
        out[:n] = True
        for k, c in enumerate(word):
            out[:n] &= points[k : k + n] == ord(c)
    return out


def _split(points: np.ndarray, begin: np.ndarray, han: np.ndarray, rules: Z.NameRules) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of what the expression of split_names() finds from left to right."""
    ends = np.repeat(begin[1:], np.diff(begin))
    single = np.flatnonzero(np.isin(points, np.array(sorted(map(ord, set(rules.singles))), np.uint32)))
    compounds = [(np.flatnonzero(_begins(points, w)), len(w)) for w in sorted(rules.compounds, key=lambda w: (-len(w), w))]
    size = np.zeros(len(points), np.int64)
    for n in (4, 3, 2):
        common = np.zeros(len(points), bool)
        for w in rules.common:
            if len(w) == n:
                common |= _begins(points, w)
        ways = [(single, 1, n - 1)] if n < 4 else []
        ways += [(there, own, n - 2) for there, own in compounds] if n > 2 else []
        for at, own, more in ways:
            at = at[(size[at] == 0) & (at + own + more <= ends[at])]
            for k in range(more):
                at = at[han[at + own + k]]
            # A common word that goes on in the next text is none.
            size[at[~(common[at] & (at + n <= ends[at]))]] = own + more
    at = np.flatnonzero(size)
    taken, upto = [], 0
    for k, (a, n) in enumerate(zip(at.tolist(), size[at].tolist(), strict=True)):
        if a >= upto:
            taken.append(k)
            upto = a + n
    at = at[taken]
    return at, size[at]


def _names(form: Form, rules: Z.NameRules | None):
    """(name, split, count): neighbouring pairs, and people's names where rules are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for points, begin in _parts(batches, form):
            han = is_han(points)
            beside = han[:-1] & han[1:]
            inner = begin[1:-1]
            beside[inner[(inner > 0) & (inner < len(points))] - 1] = False
            wide = points.astype(np.int64)
            keys, n = _values((wide[:-1] << 21 | wide[1:])[beside])
            names = [chr(k >> 21) + chr(k & 0x1FFFFF) for k in keys.tolist()]
            pairs = len(names)
            if rules is not None:
                at, size = _split(points, begin, han, rules)
                short, text = size <= 3, _string(points)
                at_short, third = at[short], size[short] == 3
                keys, m = _values(wide[at_short] << 42 | wide[at_short + 1] << 21 | np.where(third, wide[np.minimum(at_short + 2, len(wide) - 1)], 0))
                found = Counter(text[a : a + k] for a, k in zip(at[~short].tolist(), size[~short].tolist(), strict=True))
                names += ["".join(chr(k >> b & 0x1FFFFF) for b in (42, 21, 0) if b or k & 0x1FFFFF) for k in keys.tolist()] + [*found]
                n = np.concatenate((n, m, np.array([*found.values()], np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.arange(len(names)) >= pairs), pa.array(n.astype(np.int64))], ["name", "split", "count"])

    return run


def name_counts(texts: DataFrame, text_col: str, rules: Z.NameRules | None = None, letters: dict[str, str] | None = None) -> DataFrame:
    """(name, split, count) of all neighbouring pairs of characters in Han runs, and with rules of what split_names() finds (split), in one look at the texts."""
    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_names(Form(letters=letters), rules), "name string, split boolean, count long")
    return rows.groupBy("name", "split").agg(F.sum("count").alias("count"))


def pair_counts(texts: DataFrame, text_col: str, letters: dict[str, str] | None = None) -> DataFrame:
    """(name, count) of all neighbouring pairs of characters in Han runs."""
    return name_counts(texts, text_col, None, letters).select("name", "count")


class Seeds:
    """Seeds and their kinds as arrays in the order of their hashes, to be sent to all tasks: a shortlist of names."""

    def __init__(self, rows: pa.Table, follow: dict[str, str]):
        names = rows["alias"].to_pylist()
        self.lengths = sorted({len(n) for n in names})
        hashes = np.array([int(hashes_of(Rolling(n), np.zeros(1, np.int64), np.array([len(n)]))[0]) for n in names], _U)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.kinds = {k: rows[k].to_numpy(zero_copy_only=False)[order] for k in rows.column_names if k != "alias"}
        # By the upper bits of a hash the first seed that has them, or -1, and how many seeds can have the same ones.
        slots = (self.hashes >> _U(64 - SEED_BITS)).astype(np.int64)
        self.first = np.full(1 << SEED_BITS, -1, np.int32)
        self.first[slots[::-1]] = np.arange(len(slots))[::-1]
        self.depth = int(np.unique(slots, return_counts=True)[1].max(initial=0))
        self.follow = {k: np.array(sorted(map(ord, set(v))), np.uint32) for k, v in follow.items()}
        self.allowed = self._allowed()

    def _allowed(self) -> np.ndarray:
        """The bits of GROWTHS that each seed may make, by state: Han characters before (0 to 2) and after, whether a character follows, whether it is weak, or of a role."""
        kind = {k: v[:, None] for k, v in self.kinds.items()}
        left, right, stands, weak, role = (x.ravel()[None, :] for x in np.indices((3, 3, 2, 2, 2)))
        stands, weak, role = stands == 1, weak == 1, role == 1
        generic = stands & ~weak & (~kind["weak_seed"] | role)
        fits = np.where(kind["free"], True, np.where(kind["generic"], generic, np.where(~kind["person_like"], True, stands & weak)))
        out = np.zeros(fits.shape, np.uint8)
        for bit, (p, q) in enumerate(GROWTHS):
            may = (kind["budget"] >= p + q) & (left >= p) & (right >= q)
            if p:
                may = may & kind["leftward"]
            if q:
                may = may & kind["rightward"] & (kind["both_ways"] if p else fits)
            out |= may.astype(np.uint8) << np.uint8(bit)
        return out


def hashes_of(roll: Rolling, starts: np.ndarray, length) -> np.ndarray:
    """The 64-bit hash of the substring of that length, or those lengths, at each start."""
    return (roll.sums[starts + length] - roll.sums[starts]) * roll.down[starts] + np.asarray(length).astype(_U)


def _occurrences(points: np.ndarray, begin: np.ndarray, seeds: Seeds) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes, and (start, length, block, seed) once for each place of a seed or a grown seed, by length and start."""
    roll, n = Rolling(points), len(points)
    lengths = np.diff(begin)
    block = np.repeat(np.arange(len(lengths)), lengths)
    upto = np.repeat(begin[1:], lengths)
    han = is_han(points)
    begins = np.ones(n + 1, bool)  # no character of the same block stands before
    begins[1:n] = block[1:] != block[:-1]
    # How many Han characters, up to two, lie before and from each place, in its block; what follows a surface that ends at a place.
    left, right = np.zeros(n + 1, np.uint8), np.zeros(n + 1, np.uint8)
    one = han & ~begins[1:]  # counts for the place after it
    left[1:] = one
    left[2:] += one[1:] & one[:-1]
    right[:n] = han
    right[: n - 1] += han[:-1] & han[1:] & ~begins[1:n]
    state = np.zeros(n + 1, np.uint8)
    weak, role = (np.isin(points, seeds.follow[k]) for k in ("weak", "role"))
    state[:n] = np.where(begins[:n], 0, right[:n] * np.uint8(8) + np.uint8(4) + weak * np.uint8(2) + role)
    left *= np.uint8(24)
    places: dict[int, np.ndarray] = {}  # of each length, where a surface begins
    own: dict[int, np.ndarray] = {}
    mark = lambda where, length, at: where.setdefault(length, np.zeros(n, bool)).__setitem__(at, True)
    for length in seeds.lengths:
        if length > n:
            continue
        h = (roll.sums[length:] - roll.sums[:-length]) * roll.down[: n - length + 1] + _U(length)
        which = seeds.first[(h >> _U(64 - SEED_BITS)).astype(np.int64)]
        at = np.flatnonzero((which >= 0) & (upto[: n - length + 1] - length >= np.arange(n - length + 1)))
        which, h = which[at], h[at]
        same = seeds.hashes[which] == h
        for k in range(1, seeds.depth):
            next_ = np.minimum(which + k, len(seeds.hashes) - 1)
            other = ~same & (seeds.hashes[next_] == h)
            which, same = np.where(other, next_, which), same | other
        at, which = at[same], which[same]
        may = seeds.allowed[which, left[at] + state[at + length]]
        mark(places, length, at)
        mark(own, length, at)
        for bit, (p, q) in enumerate(GROWTHS):
            mark(places, length + p + q, at[may & np.uint8(1 << bit) != 0] - p)
    starts = {k: np.flatnonzero(v) for k, v in sorted(places.items())}
    start = np.concatenate([np.zeros(0, np.int64), *starts.values()])
    size = np.repeat(np.array([*starts], np.int64), [len(v) for v in starts.values()])
    seed = np.concatenate([np.zeros(0, bool), *[own[k][v] if k in own else np.zeros(len(v), bool) for k, v in starts.items()]])
    return roll, start, size, block[start], seed


class Counts:
    """Counts (hash of a surface, code) of a task, put together as they come and given out when so many different ones are held."""

    def __init__(self):
        self.words: dict[int, str] = {}
        self.rows: list[pa.Table] = []
        self.size = self.merged = 0

    def add(self, hashes: np.ndarray, codes: np.ndarray, n: np.ndarray) -> None:
        self.rows.append(pa.table({"h": hashes.view(np.int64), "code": codes.astype(np.int64), "n": n.astype(np.int64)}))
        self.size += len(hashes)
        if self.size > HELD:
            self.merge()

    def merge(self) -> None:
        self.rows = [pa.concat_tables(self.rows).group_by(["h", "code"], use_threads=False).aggregate([("n", "sum")]).select(["h", "code", "n_sum"]).rename_columns(["h", "code", "n"]).combine_chunks()]
        self.size = self.merged = self.rows[0].num_rows

    def given(self) -> pa.RecordBatch:
        self.merge()
        h, code, n = (self.rows[0][k].to_numpy() for k in ("h", "code", "n"))
        surface = pa.array([self.words[k] for k in h.tolist()], pa.string())
        sided = code >= 0
        char = code >> 1 & 0x1FFFFF
        names = {c: None if c == NONE else chr(c) for c in np.unique(char[sided]).tolist()}
        c = pa.array([names[k] if s else None for k, s in zip(char.tolist(), sided.tolist(), strict=True)], pa.string())
        side = pa.array(["left", "right"], pa.string()).take(pa.array(np.where(sided, code >> 22, 0), mask=~sided))
        numbers = [pa.array(np.where(k, n, 0)) for k in (sided, code == ANY, code == OWN)]
        self.__init__()
        return pa.RecordBatch.from_arrays([surface, side, c, pa.array(sided & (code & 1 == 1)), *numbers], ["surface", "side", "c", "seed", "n", "any", "own"])


def _once(keys: np.ndarray) -> np.ndarray:
    """The different keys in order."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _sided(which: np.ndarray, c: np.ndarray, seed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys which << 22 | c << 1 | seed, and how often each is there; counted in a table where few characters are in use."""
    used = np.zeros(NONE + 1, bool)
    used[c] = True
    chars = np.flatnonzero(used)
    if size * len(chars) * 2 > 4 * PART:
        return _values((which << 22) + (c << 1) + seed)
    number = np.zeros(NONE + 1, np.int64)
    number[chars] = np.arange(len(chars))
    n = np.bincount((which * len(chars) + number[c]) * 2 + seed)
    rows = np.flatnonzero(n)
    return (rows // (2 * len(chars)) << 22) + (chars[(rows >> 1) % len(chars)] << 1) + (rows & 1), n[rows]


def _counted(seeds, form: Form):
    """(surface, side, c, seed, n, any, own): occurrences by what stands on a side; blocks with any, and with one that is a seed, have no side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for points, begin in _parts(batches, form):
            roll, start, size, block, seed = _occurrences(points, begin, seeds.value)
            if not len(start):
                continue
            coded = pa.array(hashes_of(roll, start, size).view(np.int64)).dictionary_encode()
            which, hashes = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()
            one = np.zeros(len(hashes), np.int64)
            one[which] = np.arange(len(which))
            text = _string(points)
            counts.words |= {h: text[a : a + k] for h, a, k in zip(hashes.tolist(), start[one].tolist(), size[one].tolist(), strict=True)}
            end, wide = start + size, np.append(points.astype(np.int64), NONE)
            sides = np.where(start > begin[block], wide[start - 1], NONE), np.where(end < begin[block + 1], wide[end], NONE)
            for side, c in enumerate(sides):
                keys, n = _sided(which, c, seed, len(hashes))
                counts.add(hashes[keys >> 22], (side << 22) + (keys & 0x3FFFFF), n)
            blocks = len(begin)
            for code, k in ((ANY, slice(None)), (OWN, seed)):
                n = np.bincount(_once(which[k] * blocks + block[k]) // blocks, minlength=len(hashes))
                counts.add(hashes, np.full(len(hashes), code), n)
            if counts.merged > HELD // 2:
                yield counts.given()
        if counts.rows:
            yield counts.given()

    return run


class Growth:
    """What grown_occurrences() finds for seeds (name) in blocks (id, text), counted where the blocks lie."""

    def __init__(self, texts: DataFrame, seeds: DataFrame, rules: Z.NameRules, size: int = 0, letters: dict[str, str] | None = None):
        """texts are the blocks; with a size, blocks are cut from them as cut() does, and letters are written as others, where the texts lie."""
        self.rules, self.spark, self.form = rules, texts.sparkSession, Form(size, letters)
        kinds = Z.seed_kinds(F.col("alias"), rules)
        self.names = seeds.filter(F.col("name").rlike(f"^{Z.CJK}{{2,}}$")).select(F.col("name").alias("alias")).distinct()
        follow = {"weak": Z.FUNCTION_CHARS + Z.LOW_SUFFIXES + rules.noise, "role": Z.ROLE_SUFFIXES}
        self.seeds = self.spark.sparkContext.broadcast(Seeds(self.names.select("alias", *[c.alias(k) for k, c in kinds.items()]).toArrow(), follow))
        again = texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
        self.alone, self.others = texts.select("text"), None
        if not again.isEmpty():
            again = settled(again)
            shared = texts.join(again, texts["id"].eqNullSafe(again["id"]), "left_semi").withColumn("text", written(F.col("text"), letters))
            self.alone = texts.join(again, texts["id"].eqNullSafe(again["id"]), "left_anti").select("text")
            self.others = settled(Z.grown_occurrences(cut(shared, size) if size else shared, seeds, rules))

    def _low(self, surface: Column) -> Column:
        return Z.not_counted(surface, self.rules)

    def sides(self) -> tuple[DataFrame, DataFrame]:
        """(surface, side, c, n) and (surface, blocks)."""
        rows = self.alone.mapInArrow(_counted(self.seeds, self.form), "surface string, side string, c string, seed boolean, n long, any long, own long")
        rows = settled(rows.groupBy("surface", "side", "c", "seed").agg(*[F.sum(c).alias(c) for c in ("n", "any", "own")]))
        low = self._low(F.col("surface"))
        symbol = F.coalesce(Z._symbol(F.col("c")), F.when(F.col("side") == "left", "^").otherwise("$"))
        each = rows.filter(F.col("side").isNotNull() & (F.col("seed") | ~low)).select("surface", "side", symbol.alias("c"), "n")
        blocks = rows.filter("side is null").select("surface", F.when(low, F.col("own")).otherwise(F.col("any")).alias("blocks")).filter("blocks > 0")
        if self.others is not None:
            more, held = Z.surface_sides(self.others)
            each, blocks = each.unionByName(more), blocks.unionByName(held)
        return each.groupBy("surface", "side", "c").agg(F.sum("n").alias("n")), blocks.groupBy("surface").agg(F.sum("blocks").alias("blocks"))

    def both(self, pairs: DataFrame) -> DataFrame:
        """(short, long, both): blocks that hold both, for pairs of surfaces; their number is that of a vocabulary."""
        rows = pairs.select("short", "long").distinct().toArrow()
        out = self._counts(rows["short"].to_pylist(), rows["long"].to_pylist(), _together)
        out = out.groupBy("a", "b").agg(F.sum("n").alias("both")).select(F.col("a").alias("short"), F.col("b").alias("long"), "both")
        if self.others is not None:
            out = out.unionByName(Z._overlaps(pairs.select("short", "long").distinct(), self.others.select("surface", "id").distinct())).groupBy("short", "long").agg(F.sum("both").alias("both"))
        return out

    def held(self, canonical: DataFrame) -> DataFrame:
        """(canonical, blocks): blocks that hold a surface of each canonical one, from (surface, canonical)."""
        rows = canonical.select("surface", "canonical").toArrow()
        out = self._counts(rows["surface"].to_pylist(), rows["canonical"].to_pylist(), _holding)
        out = out.select(F.col("b").alias("canonical"), F.col("n").alias("blocks"))
        if self.others is not None:
            out = out.unionByName(self.others.select("surface", "id").join(canonical, "surface").select("canonical", "id").distinct().groupBy("canonical").agg(F.count("*").alias("blocks")))
        return out.groupBy("canonical").agg(F.sum("blocks").alias("blocks"))

    def _counts(self, a: list[str], b: list[str], how) -> DataFrame:
        words = sorted({*a, *b})
        if not words:
            return self.spark.createDataFrame([], "a string, b string, n long")
        low = self.spark.createDataFrame(pa.table({"surface": words})).select("surface", self._low(F.col("surface")).alias("low")).toArrow()
        low = dict(zip(low["surface"].to_pylist(), low["low"].to_pylist(), strict=True))
        hashes = np.array([int(hashes_of(Rolling(w), np.zeros(1, np.int64), np.array([len(w)]))[0]) for w in words], _U)
        order = np.argsort(hashes)
        number = {words[k]: i for i, k in enumerate(order.tolist())}
        names = [words[k] for k in order.tolist()]
        mine = np.array([number[w] for w in a]), np.array([number[w] for w in b])
        by = np.argsort(mine[1], kind="stable") if how is _together else np.argsort(mine[0], kind="stable")
        sent = self.spark.sparkContext.broadcast((hashes[order], np.array([low[w] for w in names], bool), names, mine[0][by], mine[1][by]))
        return self.alone.mapInArrow(how(self.seeds, sent, self.form), "a string, b string, n long")


def _present(batches, form: Form, seeds: Seeds, hashes: np.ndarray, low: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted keys block * surfaces + number of the wanted surfaces that blocks hold."""
    wanted = pa.array(hashes.view(np.int64))
    for points, begin in _parts(batches, form):
        roll, start, size, block, seed = _occurrences(points, begin, seeds)
        h = hashes_of(roll, start, size)
        which = pc.fill_null(pc.index_in(pa.array(h.view(np.int64)), value_set=wanted), -1).to_numpy()
        good = (which >= 0) & (seed | ~low[which])
        yield _once(block[good] * len(hashes) + which[good])


def _expanded(of: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of of, the rows that it has, n from lo on: (index into of, row)."""
    lo, n = lo[of], n[of]
    index = np.repeat(np.arange(len(of)), n)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n) + lo[index]


def _rows_of(sorted_by: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number below size, where its rows begin and how many there are."""
    lo = np.searchsorted(sorted_by, np.arange(size + 1))
    return lo[:-1], np.diff(lo)


def _sums(n: np.ndarray, names: list[str], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    row = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array([names[k] for k in a[row].tolist()], pa.string()), pa.array([names[k] for k in b[row].tolist()], pa.string()), pa.array(n[row].astype(np.int64))], ["a", "b", "n"])


def _together(seeds, sent, form: Form):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, low, names, short, long = sent.value
        n = np.zeros(len(short), np.int64)
        rows = _rows_of(long, len(hashes))
        for keys in _present(batches, form, seeds.value, hashes, low):
            index, row = _expanded(keys % len(hashes), *rows)
            other = keys[index] // len(hashes) * len(hashes) + short[row]
            at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
            n += np.bincount(row[keys[at] == other], minlength=len(n)) if len(keys) else 0
        yield _sums(n, names, short, long)

    return run


def _holding(seeds, sent, form: Form):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, low, names, surface, canonical = sent.value
        n = np.zeros(len(names), np.int64)
        rows = _rows_of(surface, len(hashes))
        for keys in _present(batches, form, seeds.value, hashes, low):
            index, row = _expanded(keys % len(hashes), *rows)
            held = _once(keys[index] // len(hashes) * len(hashes) + canonical[row])
            n += np.bincount(held % len(hashes), minlength=len(n))
        yield _sums(n, names, np.arange(len(names)), np.arange(len(names)))

    return run

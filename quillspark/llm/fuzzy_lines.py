"""Line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line kept per group.

A line is normalised by lower-casing A-Z, turning digits into 0 and ASCII punctuation into blanks.
Each bit of its SimHash, 128 in all, is what most of its words' hashes have there, by weight.
Each half's bits are cut into nine blocks, of which blocks k, k + 1 and k + 3 around the circle are
a key, so a differing block spoils three keys: halves that differ in two bits share a key for
certain, and of others most do (the README has the shares). Lines that share a key of one half and
differ in few bits of the other are near, and the edit similarity of the lines decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, NULL_ID, Words, bound_batches, cut, mix64, powers, scratch, text_buffers
from .components import linked_components

MOST_BITS, SIMILARITY, MIN_CHARS = 9, 0.9, 20
#: Bits of a block. A key has three blocks; 2 ** (3 * WIDTH) keys should not be far fewer than the different lines.
WIDTH = 7
#: Words of so many bytes count twice, and words that are among so many before them not at all.
LONG, AGAIN = 4, 4
#: Words of more bytes are cut where their bytes say so, and each character of three bytes or more is a word.
LONG_WORD = 64
#: Ratio of the lengths from one class to the next.
CLASS = 1.04
#: Bits of the map of wanted lines that is sent to all; once it is full, more lines than needed are looked at.
MAP_BITS = 24

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48
for _lo, _hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _NORMAL[_lo:_hi] = 32
_U = np.uint64
#: A byte's bits as eight counters of eight bits, for each weight.
_SPREAD = np.outer((0, 1, 2), np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(_U).ravel()).ravel().astype(_U)


def normal(line: str) -> str:
    """A line's normalised words, joined by one space."""
    return b" ".join(_NORMAL[np.frombuffer(line.encode(), np.uint8)].tobytes().split()).decode("utf-8", "replace")


def simhashes(hashes: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(run, 2): the 128 bits of each run of words; first has each run's first word, and the end.

    Words of LONG bytes or more count twice, as most lines share the shorter ones; words that are
    among the AGAIN before them do not count, or a phrase said over and over would outweigh the rest.
    """
    counts, weights = np.diff(first), np.where(sizes >= LONG, 2, 1)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
    for k in range(1, AGAIN + 1):
        weights[k:][(hashes[k:] == hashes[:-k]) & (place[k:] >= k)] = 0
    parts = np.maximum(1, -(-counts // 127))  # as many words as a counter holds
    row = np.repeat(np.arange(len(counts)), parts)
    begin = first[:-1][row] + 127 * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.minimum(begin + 127, first[1:][row])
    sums = np.empty((len(row), 128), np.uint8)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(end, begin[at] + (1 << 16), "right")))
        lo, hi = begin[at], end[stop - 1]
        heavy, lane = 256 * weights[lo:hi], np.zeros(hi - lo + 1, _U)
        for half, own in enumerate((hashes[lo:hi], mix64(hashes[lo:hi] + _U(1)))):
            for j in range(8):
                np.cumsum(np.take(_SPREAD, ((own >> _U(8 * j)) & _U(255)).view(np.int64) + heavy), out=lane[1:])
                sums[at:stop, 64 * half + 8 * j : 64 * half + 8 * j + 8] = (lane[end[at:stop] - lo] - lane[begin[at:stop] - lo]).view(np.uint8).reshape(-1, 8)
        at = stop
    if len(row) > len(counts):
        sums = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int32)
    all_ = np.concatenate(([0], np.cumsum(weights)))
    return np.packbits(sums > ((all_[first[1:]] - all_[first[:-1]]) // 2)[:, None], axis=1).view(_U)


def _tokens(words: Words) -> Words:
    """The words' pieces: characters of three bytes or more, parts of long words, and all other words as they are."""
    data, starts, ends = words.data, words.starts, words.ends
    wide = data >= 0xE0
    if not len(starts) or not (wide.any() or (ends - starts).max() > LONG_WORD):
        return words
    lead = (data & 0xC0) != 0x80
    last = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
    cuts = lead & wide
    cuts[1:] |= lead[1:] & wide[last[:-1]]
    if len(data) > 1:
        pair = mix64(data[1:].astype(_U) << _U(8) | data[:-1])
        word = np.clip(np.searchsorted(starts, np.arange(1, len(data)), "right") - 1, 0, None)
        cuts[1:] |= lead[1:] & ((pair & _U(3)) == 0) & ((ends - starts) > LONG_WORD)[word]
    cuts &= data != 32
    cuts[starts] = True
    out = Words.__new__(Words)
    out.data, out.offsets, out.starts = data, words.offsets, np.flatnonzero(cuts & _inside(data, starts, ends))
    word = np.searchsorted(starts, out.starts, "right") - 1
    out.ends = np.minimum(ends[word], np.append(out.starts[1:], len(data)))
    out.first = np.searchsorted(out.starts, out.offsets)
    out.counts = np.diff(out.first)
    return out


def _inside(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each byte lies in a word."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _runs_hashed(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each run of items."""
    counts = np.diff(first)
    up, _ = powers(int(counts.max(initial=0)) + 1)
    at = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(hashes * up[at], dtype=_U)))
    return mix64(sums[first[1:]] - sums[first[:-1]] + counts.astype(_U))


def _line_starts(batch: pa.RecordBatch):
    """The texts' bytes, and each line's start, row and number in its text."""
    data, offsets = text_buffers(batch.column("text"))
    breaks = np.flatnonzero(data == 10) + 1
    # A break that ends a text comes before the next text's own start.
    starts = np.concatenate((offsets[:-1], breaks))
    row = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks - 1, "right") - 1))
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    return data, starts, row, np.arange(len(row)) - np.searchsorted(row, row)


def _lines(min_chars: int):
    """Of each text's lines with words: place, hash, SimHash (sim, sim2) and length, 0 for those too short to be compared; known: an equal line of this block is earlier.

    Lines, not texts, make the blocks that are worked on at once, so a very long text takes no more memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts, row, number = _line_starts(batch)
            dids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            ends = np.append(starts[1:], len(data))
            at = 0
            while at < len(starts):
                stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
                base, own = starts[at], slice(at, stop)
                raw = data[base : ends[stop - 1]]
                yield from _block(raw, np.append(starts[own] - base, len(raw)), dids[row[own]], ths[row[own]], number[own], min_chars)
                at = stop

    return run


def _block(raw: np.ndarray, offsets: np.ndarray, did: np.ndarray, th: np.ndarray, line: np.ndarray, min_chars: int) -> Iterator[pa.RecordBatch]:
    words = Words.of(_NORMAL[raw], offsets)
    full = np.flatnonzero(words.counts > 0)
    if not len(full):
        return
    hashes = words.hashes()
    lead = np.concatenate(([0], np.cumsum(((words.data & 0xC0) != 0x80) & _inside(words.data, words.starts, words.ends), dtype=np.int32)))
    chars = (lead[offsets[1:]] - lead[offsets[:-1]] + words.counts - 1)[full]
    key = _runs_hashed(hashes, words.first)[full]
    short = chars < min_chars
    if short.any():  # these are told by their own words, not the normalised ones
        length = np.diff(offsets)
        own = np.zeros(len(length), bool)
        own[full[short]] = True
        plain = Words.of(raw[np.repeat(own, length)], np.concatenate(([0], np.cumsum(length[own]))))
        key[short] = mix64(_runs_hashed(plain.hashes(), plain.first) + _U(1))
    sim = np.zeros((len(full), 2), np.int64)
    if not short.all():
        tokens = _tokens(words)
        sim[:] = simhashes(hashes if tokens is words else tokens.hashes(), tokens.ends - tokens.starts, tokens.first)[full].view(np.int64)
    sim[short], chars[short] = 0, 0
    did, th, line = did[full], th[full], line[full]
    order = np.lexsort((line, did, key))
    k, d, n = key[order], did[order], line[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], k[1:] != k[:-1])), np.arange(len(k)), 0))
    known = (d != d[first]) | (n != n[first])
    columns = (d, th[order], n.astype(np.int32), k.view(np.int64), sim[order, 0], sim[order, 1], chars[order].astype(np.int32), known)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["did", "th", "line", "id", "sim", "sim2", "chars", "known"])


def distance(a: str, b: str) -> int:
    """Levenshtein distance, by Myers's bit vectors in Python's integers."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, score = mask, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = eq | less
        h = (((eq & more) + more) ^ more) | eq
        up, down = less | (mask & ~(h | more)), more & h
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & mask
        down = down << 1 & mask
        more, less = down | (mask & ~(x | up)), up & x
    return score


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, one after the other, and where each begins, with the end."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, texts)])


def distances(left: list[str], right: list[str], most: np.ndarray) -> np.ndarray:
    """The Levenshtein distances of many pairs of texts at once; one above most may come out larger than it is.

    Myers's bit vectors in blocks of 64 rows (Hyyro), for all pairs side by side. Of each column only
    the blocks within most of the diagonal are worked out.
    """
    p, (x, x0), (y, y0) = len(left), _points(left), _points(right)
    n, m = np.diff(x0), np.diff(y0)
    kinds, code = np.unique(np.concatenate((x, y)), return_inverse=True)
    blocks, one = int(n.max(initial=0) + 63) // 64, _U(1)
    where = np.zeros(p * len(kinds) * blocks, _U)
    row, at = np.repeat(np.arange(p), n), np.arange(len(x)) - np.repeat(x0[:-1], n)
    np.add.at(where, (row * len(kinds) + code[: len(x)]) * blocks + at // 64, one << (at % 64).astype(_U))
    where = where.reshape(p * len(kinds), blocks)
    steps = int(m.max(initial=0))
    text = np.zeros((p, steps), np.int64)
    text[np.repeat(np.arange(p), m), np.arange(len(y)) - np.repeat(y0[:-1], m)] = code[len(x) :]
    more, less = np.full((blocks, p), ~_U(0)), np.zeros((blocks, p), _U)
    score = np.tile((np.arange(blocks) + 1)[:, None] * 64, p)
    band, base, first, last = int(most.max(initial=0)) + 1, np.arange(p) * len(kinds), 0, 0
    out = np.where(m == 0, n, 0)
    mine, top = np.maximum(n - 1, 0) // 64, _U(63)
    beyond = ~_U(0) << (np.maximum(n - 1, 0) % 64).astype(_U) << one  # rows of the last block that are not the text's
    for j in range(steps):
        first = max(first, (j - band) // 64)
        while last < blocks and 64 * last <= j + band:
            if last:  # what lies below the band is taken to grow by one a row
                score[last] = score[last - 1] + 64
            last += 1
        up, down = np.ones(p, _U), np.zeros(p, _U)
        eqs = where[base + text[:, j]]
        for w in range(first, last):
            v, u = more[w], less[w]
            eq = eqs[:, w]
            across = eq | u
            eq = eq | down
            h = (((eq & v) + v) ^ v) | eq
            plus, minus = u | ~(h | v), v & h
            next_up, next_down = plus >> top, minus >> top
            plus, minus = plus << one | up, minus << one | down
            more[w], less[w] = minus | ~(across | plus), plus & across
            score[w] += next_up.astype(np.int64) - next_down.astype(np.int64)
            up, down = next_up, next_down
        done = np.flatnonzero(m == j + 1)
        if len(done):
            k = mine[done]
            over = np.bitwise_count(more[k, done] & beyond[done]).astype(np.int64) - np.bitwise_count(less[k, done] & beyond[done])
            out[done] = np.where(k < last, score[k, done] - over, n[done] + m[done])
    return np.where(n == 0, m, out)


def at_most(a: str, b: str, most: float) -> float:
    """A bound on the distance of two texts from above: words that are not equal are passed over up to the next equal ones. It may stop beyond most."""
    x, y = a.split(" "), b.split(" ")
    i, j, cost, n, m = 0, 0, 0, len(x), len(y)
    while i < n and j < m and cost <= most:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        down, over = next(((p, q) for p, q in _STEPS if i + p < n and j + q < m and x[i + p] == y[j + q]), (1, 1))
        cost += max(sum(map(len, x[i : i + down])) + down, sum(map(len, y[j : j + over])) + over)
        i, j = i + down, j + over
    return cost + sum(map(len, x[i:])) + n - i + sum(map(len, y[j:])) + m - j


_STEPS = ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2), (2, 0), (0, 2))


def _common(a: str, b: str) -> int:
    """The number of characters that a and b begin with alike."""
    low, high = 0, min(len(a), len(b)) + 1
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _matrix(texts: list[str]) -> np.ndarray:
    """(text, place): the texts' code points side by side, filled up with 0."""
    return np.array(texts, f"U{max(1, max(map(len, texts)))}").view(np.uint32).reshape(len(texts), -1)


def within(left: list[str], right: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of each pair of texts, the left one no shorter, is at most most, which is below 64 and at least the difference of their lengths.

    Myers's bit vectors along a band (Hyyro), for all pairs side by side: a path of cost most that ends
    n - m rows off the diagonal leaves no more than most + 1 diagonals, so one word of 64 bits has them
    for texts of any length. Rows below the last match nothing; what they add is taken off at the end.
    """
    p, one, top = len(left), _U(1), _U(63)
    n, m = (np.fromiter(map(len, texts), np.int64, p) for texts in (left, right))
    x, y = _matrix(left), _matrix(right)
    seen = np.zeros(int(max(x.max(), y.max())) + 1, bool)
    seen[x], seen[y] = True, True
    code = np.cumsum(seen) - 1
    # Row r's bit lies where column r - ahead has its last one, so all pairs look at the same places.
    ahead = (n - m) + (most - (n - m)) // 2
    where = np.zeros((int((n + 63 - ahead).max()) // 64 + max(int(m.max()) // 64 + 2, 2), int(code[-1] + 1) * p), _U)
    row = np.repeat(np.arange(p), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    spot = at + (63 - ahead)[row]
    np.add.at(where.reshape(-1), (spot >> 6) * where.shape[1] + code[x[row, at]] * p + row, one << (spot & 63).astype(_U))
    base = np.ascontiguousarray(code[y].T) * p + np.arange(p)
    live, last, out = np.arange(p), m, np.zeros(p, bool)
    more, less, saved, slack = ~_U(0) << (63 - ahead).astype(_U), np.zeros(p, _U), np.zeros(p, _U), most + ahead - (n - m) - ahead
    for j in range(int(m.max()) + 1):
        done = last == j
        if done.any():
            now = live[done]
            below = (one << top) - (one << (63 - (ahead - n + m)[now]).astype(_U))
            rest = np.bitwise_count(more[done] & below).astype(np.int64) - np.bitwise_count(less[done] & below)
            out[now] = ahead[now] + j - saved[done].astype(np.int64) - rest <= most[now]
        if j % 32 == 0 or done.all():  # pairs that are through, or too far apart already
            keep = (last > j) & (j - saved.astype(np.int64) <= slack)
            if 4 * np.count_nonzero(keep) < 3 * len(keep):
                live, last, base, more, less, saved, slack = live[keep], last[keep], base[:, keep], more[keep], less[keep], saved[keep], slack[keep]
        if not len(live):
            break
        if j == len(base):
            break
        low, slot = _U(j & 63), base[j]
        eq = where[j >> 6][slot] >> low
        if low:
            eq |= where[(j >> 6) + 1][slot] << (_U(64) - low)
        down = (((eq & more) + more) ^ more) | eq | less
        plus, minus = less | ~(down | more), down & more
        saved += down >> top
        down >>= one
        more, less = minus | ~(down | plus), down & plus
    return out


def _in_band(left: list[str], right: list[str], similarity: float) -> np.ndarray:
    """alike() for pairs whose bound is below 64: what lies between the common ends, for many pairs side by side."""
    n, m = (np.fromiter(map(len, texts), np.int64, len(texts)) for texts in (left, right))
    most = np.floor((1 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)
    keep, open_ = np.zeros(len(n), bool), []
    order = np.flatnonzero(np.abs(n - m) <= most)
    order = order[np.argsort(np.maximum(n, m)[order], kind="stable")]
    while len(order):
        size = 4 * int(max(n[order[-1]], m[order[-1]]) + 1)
        part, order = order[-max(1, MANY // size) :], order[: -max(1, MANY // size)]
        a, b = [left[k] for k in part], [right[k] for k in part]
        least, ends = np.minimum(n[part], m[part]), []
        for x, y in ((a, b), ([t[::-1] for t in a], [t[::-1] for t in b])):
            x, y = _matrix(x), _matrix(y)
            width = min(x.shape[1], y.shape[1])
            ends.append(np.minimum(least, np.argmax(np.pad(x[:, :width] != y[:, :width], ((0, 0), (0, 1)), constant_values=True), axis=1)))
        head, tail = ends[0], np.minimum(least - ends[0], ends[1])
        near = np.maximum(n[part], m[part]) - head - tail <= most[part]
        keep[part[near]] = True
        for k in np.flatnonzero(~near).tolist():
            x, y = a[k][head[k] : len(a[k]) - tail[k]], b[k][head[k] : len(b[k]) - tail[k]]
            open_.append((part[k], x, y) if len(x) >= len(y) else (part[k], y, x))
    open_.sort(key=lambda r: len(r[2]))
    kinds = len(set().union(*[x + y for _, x, y in open_]))
    while open_:
        size = 8 * (kinds + 64) * (len(open_[-1][1]) // 64 + len(open_[-1][2]) // 64 + 4)
        part, open_ = open_[-max(1, 4 * MANY // size) :], open_[: -max(1, 4 * MANY // size)]
        ids, x, y = zip(*part, strict=True)
        keep[list(ids)] = within(x, y, most[list(ids)])
    return keep


def alike(left: list[str], right: list[str], similarity: float) -> np.ndarray:
    """Whether each pair's edit similarity is high enough: along a band for many pairs at once; pairs of longer texts by cheap bounds, then by the distance of what lies between the common ends."""
    keep, open_ = np.zeros(len(left), bool), []
    bounds = [(1 - similarity) * max(len(a), len(b)) + 1e-9 for a, b in zip(left, right, strict=True)]
    if band := [k for k, most in enumerate(bounds) if most < 64]:
        keep[band] = _in_band([left[k] for k in band], [right[k] for k in band], similarity)
    for k, most in enumerate(bounds):
        a, b = left[k], right[k]
        if most < 64 or abs(len(a) - len(b)) > most:
            continue
        head = _common(a, b)
        a, b = a[head:], b[head:]
        tail = _common(a[::-1], b[::-1])
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if max(len(a), len(b)) <= most or at_most(a, b, most) <= most:
            keep[k] = True
        else:
            open_.append((k, a, b, most))
    open_.sort(key=lambda r: max(len(r[1]), len(r[2])))
    kinds = len(set().union(*[a + b for _, a, b, _ in open_]))
    while open_:
        # Side by side if enough pairs are of about one length, else one by one in Python's integers.
        size = max(len(open_[-1][1]), len(open_[-1][2])) + 1
        most = max(1, MANY // (8 * kinds * (size // 64 + 1)))
        at = next((k for k in range(len(open_) - 1, -1, -1) if len(open_) - k > most or 2 * max(len(open_[k][1]), len(open_[k][2])) < size - 60), -1) + 1
        part, open_ = open_[at:], open_[:at]
        ids, a, b, bound = zip(*part, strict=True)
        columns = 2 * max(bound) // 64 + 2
        found = distances(a, b, np.array(bound)) if len(part) > 8 * columns else np.array([distance(x, y) for x, y in zip(a, b, strict=True)])
        keep[list(ids)] = found <= np.array(bound)
    return keep


#: Bound on the bytes of the tables of distances().
MANY = 1 << 22


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("text_a", "text_b"))
            yield batch.select(["a", "b"]).filter(pa.array(alike(left, right, similarity), pa.bool_()))

    return run


def block_keys_of(sims: np.ndarray, width: int) -> np.ndarray:
    """(line, key): block_keys() of SimHashes (line, half)."""
    n = 64 // width
    parts = (sims.view(_U)[:, :, None] >> (np.arange(n, dtype=_U) * _U(width))) & _U((1 << width) - 1)
    keys = np.zeros((len(sims), 2, n), _U)
    keys |= np.arange(2 * n, dtype=_U).reshape(2, n)
    for step in (0, 1, 3):
        keys = keys << _U(width) | parts[:, :, (np.arange(n) + step) % n]
    return keys.reshape(-1, 2 * n)


class _Groups:
    """Which of some components have become one."""

    def __init__(self, components: np.ndarray):
        kinds, self.own = np.unique(components, return_inverse=True)
        self.parent = list(range(len(kinds)))

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def roots(self) -> np.ndarray:
        """Each member's component by now."""
        return np.array([self.root(k) for k in range(len(self.parent))])[self.own]

    def join(self, i: int, j: int) -> bool:
        """Whether members i and j were apart until now."""
        a, b = self.root(int(self.own[i])), self.root(int(self.own[j]))
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _met(most_bits: int, apart: int, similarity: float, width: int):
    """Links that connect what is linked in meetings, which come in order and are no rows each of another task's."""

    def near_pairs(t: dict[str, np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, chars, first = t["data"].view(_U) >> _U(8), t["data"] & 255, t["first"]
        x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        left = np.arange(len(group))
        for d in range(1, len(group)):
            left = left[: np.searchsorted(left, len(group) - d)]
            left = left[group[left + d] == group[left]]
            if not len(left):
                break
            to = left + d
            ok = (t["component"][left] != t["component"][to]) & ((first[left] < 0) | (first[left] != first[to]))
            ok &= (np.bitwise_count(data[left] ^ data[to]) <= most_bits) & (np.abs(chars[left] - chars[to]) <= apart)
            x.append(left[ok])
            y.append(to[ok])
        return np.concatenate(x), np.concatenate(y)

    def settle(rows: pa.Table) -> pa.RecordBatch:
        t = {c: rows.column(c).to_numpy() for c in ("bucket", "meeting", "id", "component", "data", "sim", "sim2", "size")}
        t["first"] = rows.column("first").cast(pa.int8()).fill_null(-1).to_numpy()
        group = np.cumsum(np.concatenate(([0], (t["bucket"][1:] != t["bucket"][:-1]) | (t["meeting"][1:] != t["meeting"][:-1]))))
        x, y = near_pairs(t, group)
        sims = np.stack([t["sim"], t["sim2"]], axis=1)
        keys, n = block_keys_of(sims, width), 64 // width
        counts = rows.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, 32)
        chosen = []
        for at in range(0, len(x), 1 << 16):
            i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
            # A pair that is near in an earlier bucket, too, is that one's.
            bits = np.bitwise_count((sims[i] ^ sims[j]).view(_U) >> _U(8))
            shared = (keys[i] == keys[j]) & np.repeat((bits[:, ::-1] <= most_bits) & (bits[:, ::-1] > 0), n, axis=1)
            first = np.where(shared.any(axis=1), keys[i, np.argmax(shared, axis=1)].view(np.int64), t["bucket"][i])
            most, differ = (1 - similarity) * np.maximum(t["size"][i], t["size"][j]) + 1e-9, np.abs(t["size"][i] - t["size"][j])
            ok = (first == t["bucket"][i]) & (differ <= most) & (np.abs(counts[i] - counts[j]).sum(axis=1) + differ <= 2 * most)
            chosen.append((i[ok], j[ok], bits[ok].sum(axis=1)))
        i, j, bits = (np.concatenate(c) for c in zip(*chosen, strict=True)) if chosen else (x, y, x)
        order = np.argsort(bits, kind="stable")
        i, j = i[order], j[order]
        groups, texts, found = _Groups(t["component"]), rows.column("text"), []
        while len(i):
            # Pairs that other links have joined by now need no look.
            roots = groups.roots()
            apart_ = roots[i] != roots[j]
            i, j = i[apart_], j[apart_]
            a, b, i, j = i[:MEET], j[:MEET], i[MEET:], j[MEET:]
            if len(a):
                linked = alike(texts.take(a).to_pylist(), texts.take(b).to_pylist(), similarity)
                found += [(p, q) for p, q in zip(a[linked].tolist(), b[linked].tolist(), strict=True) if groups.join(p, q)]
        p, q = (t["id"][[f[k] for f in found]] if found else np.empty(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < MEET:
                continue
            rows = pa.Table.from_batches(held)
            # The last meeting may go on in the next batch.
            bucket, meeting = rows.column("bucket").to_numpy(), rows.column("meeting").to_numpy()
            whole = int(np.argmax((bucket == bucket[-1]) & (meeting == meeting[-1])))
            if whole:
                yield settle(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


#: Pairs of meetings that are compared at once, and rows that are gathered for that.
MEET = 4096


def signature(sim: Column, chars: Column) -> Column:
    """56 bits of a half of a SimHash, and the class of the line's length in place of the last byte."""
    length = F.least(F.lit(255), F.floor(F.log(chars) / float(np.log(CLASS)))).cast("long")
    return F.shiftleft(F.shiftrightunsigned(sim, 8), 8).bitwiseOR(length)


def letter_counts(text: str) -> np.ndarray:
    """How many characters of each of 32 kinds a text has."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(points & 31, minlength=32).astype(np.int32)


def in_reach(x: Column, y: Column, similarity: float) -> Column:
    """Whether lengths (size) and letter_counts() (counts) leave the edit similarity high enough: an edit changes the length by one, or the counts by two."""
    most, apart = (1 - similarity) * F.greatest(x["size"], y["size"]) + 1e-9, F.abs(x["size"] - y["size"])
    differ = F.aggregate(F.zip_with(x["counts"], y["counts"], lambda p, q: F.abs(p - q)), F.lit(0), lambda total, n: total + n)
    return (apart <= most) & (differ + apart <= 2 * most)


def block_keys(sim: Column, sim2: Column, width: int = WIDTH) -> Column:
    """The keys of a SimHash: three blocks of width bits of one half, with the key's number, which is below 64 // width for the first half."""
    n, keys = 64 // width, []
    for at, half in enumerate((sim, sim2)):
        parts = [F.shiftrightunsigned(half, width * k).bitwiseAND(F.lit((1 << width) - 1)) for k in range(n)]
        for k in range(n):
            key = F.lit(at * n + k).cast("long")
            for j in (k, k + 1, k + 3):
                key = F.shiftleft(key, width).bitwiseOR(parts[j % n])
            keys.append(key.cast("int") if 3 * width + (2 * n).bit_length() < 32 else key)
    return F.array(*keys)


def _spot(did, th, line, bits: int = MAP_BITS):
    """A wanted line's bit in the map, alike for columns and numpy."""
    if isinstance(th, np.ndarray):
        return (th ^ (line.astype(np.int64) * 2654435761) ^ (did << 3)) & ((1 << bits) - 1)
    return th.bitwiseXOR(line.cast("long") * F.lit(2654435761)).bitwiseXOR(F.shiftleft(did, 3)).bitwiseAND(F.lit((1 << bits) - 1))


def _texts_of(wanted: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, sim, sim2, text, size, counts) of the wanted lines (did, th, line, id, sim, sim2), normalised, with length and letter_counts(): a map of fixed size picks them out of the texts, and a join decides."""
    spark = wanted.sparkSession
    spot = _spot(F.col("did"), F.col("th"), F.col("line"))
    found = wanted.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts, row, number = _line_starts(batch)
            did, th = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("did", "th"))
            spot = _spot(did, th, number)
            keep = np.flatnonzero((bits[spot >> 6] >> (spot & 63)) & 1)
            ends = np.append(starts[1:], len(data))
            texts = [normal(data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")) for k in keep]
            counts = np.array([letter_counts(t) for t in texts], np.int32).ravel()
            columns = (did[keep], th[keep], number[keep].astype(np.int32), pa.array(texts, pa.string()), np.array([len(t) for t in texts], np.int32), pa.ListArray.from_arrays(np.arange(0, len(counts) + 1, 32, dtype=np.int32), counts))
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["did", "th", "line", "text", "size", "counts"])

    lines = placed.mapInArrow(picked, "did long, th long, line int, text string, size int, counts array<int>")
    # Rows of equal id and text have the same lines.
    once = lines.groupBy("did", "th", "line").agg(*[F.first(c).alias(c) for c in ("text", "size", "counts")])
    return once.join(wanted, ["did", "th", "line"]).select("id", "sim", "sim2", "text", "size", "counts")


def drop_fuzzy_lines(docs: DataFrame, min_chars: int = MIN_CHARS, most_bits: int = MOST_BITS, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's repeated lines removed, and n_lines and n_removed.

    Lines are what lies between newlines; those without words (blank, punctuation alone) stay. Lines
    of fewer than min_chars normalised characters are linked if their words are the same. Two
    others are linked if they are equal once normalised, or if they share a key of one half of their
    SimHashes, whose other halves' first 56 bits differ in at most most_bits, and their edit
    similarity, 1 - distance / longer length, is at least similarity. Of each connected group the
    first by (id, line, hash of the text) stays.

    A null text stays null with no lines, an empty one has one, which stays. A null id counts as the
    smallest. Rows of equal id and text keep the same lines; of rows that share an id with other texts each stands for itself. An empty table gives an empty result.
    Columns of docs named n_lines or n_removed are replaced; all others pass through, whatever their
    names. Lines are told apart by 64-bit hashes. A line in very many texts is counted once per block
    of texts; texts are shuffled once, for the result, and lines in question once more.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.col(f"`{text_col}`").cast("string")
    own = {"did": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)), "th": F.xxhash64(text)}
    placed = docs.select(*[c.alias(k) for k, c in own.items()], text.alias("text"))
    # A line's length is kept in classes, in place of its SimHash's last byte; similar lengths are few classes apart.
    apart = int(np.ceil(np.log(similarity) / -np.log(CLASS))) if similarity > 0 else 255

    def near(x, y):
        return (F.bit_count(F.shiftrightunsigned(x.bitwiseXOR(y), 8)) <= most_bits) & (F.abs(x.bitwiseAND(F.lit(255)) - y.bitwiseAND(F.lit(255))) <= apart)

    with scratch(spark) as written:
        found = written(placed.mapInArrow(_lines(min_chars), "did long, th long, line int, id long, sim long, sim2 long, chars int, known boolean"))
        first = F.min(F.struct("did", "line", "th")).alias("first")
        lines = written(found.filter("not known").groupBy("id").agg(first, F.first("sim").alias("sim"), F.first("sim2").alias("sim2"), F.first("chars").alias("chars"), F.count("*").alias("n")))
        # Only keys and what decides nearness are shuffled for all lines; the rest is joined to the few that have a near one.
        long = lines.filter("chars > 0").withColumns({"sig": signature(F.col("sim"), F.col("chars")), "sig2": signature(F.col("sim2"), F.col("chars"))})
        keyed = long.select(F.explode(block_keys(F.col("sim"), F.col("sim2"), width)).alias("bucket"), "sig", "sig2")
        # A key of one half goes with the signature of the other.
        keyed = keyed.select("bucket", F.when(F.shiftright("bucket", 3 * width) < 64 // width, F.col("sig2")).otherwise(F.col("sig")).alias("sig"))
        x, y = F.col("x.sig"), F.col("y.sig")
        close = keyed.alias("x").join(keyed.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (x != y) & near(x, y), "left_semi")
        # Lines alike in both signatures meet in a bucket of their own.
        twins = long.groupBy("sig", "sig2").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("sig", "sig2").alias("bucket"), "sig")
        shared = close.distinct().select(F.col("bucket").cast("long").alias("bucket"), "sig").union(twins)
        owners = long.select("id", F.explode(F.array("sig", "sig2")).alias("sig"))
        members = written(shared.join(owners, "sig").select("bucket", "id", F.col("sig").alias("data")))

        texts = None

        def prepare(ids: DataFrame):
            nonlocal texts
            texts = written(_texts_of(lines.join(ids, "id").select("first.did", "first.th", "first.line", "id", "sim", "sim2"), placed))
            a, b = (texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"), F.struct("size", "counts").alias(f"sketch_{k}")) for k in "ab")

            def linked(pairs: DataFrame) -> DataFrame:
                # Pairs that lengths or letters rule out are no rows of the join.
                left = pairs.join(a, "a")
                both = left.join(b, (left["b"] == b["b"]) & in_reach(F.col("sketch_a"), F.col("sketch_b"), similarity))
                return both.select("a", left["b"], "text_a", "text_b").mapInArrow(_alike(similarity), "a long, b long").distinct()

            return linked

        def met_links(rows: DataFrame) -> DataFrame:
            # A meeting is one task's, and of bounded size.
            met = rows.join(texts, "id").repartition("bucket", "meeting").sortWithinPartitions("bucket", "meeting")
            return met.mapInArrow(_met(most_bits, apart, similarity, width), "a long, b long").distinct()

        none = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
        labels = linked_components(members, near, prepare, none, written, met_links)
        # Only lines that occur again or are linked have a winner to lose to.
        group = lines.select("id", "first", "n").join(labels, "id", "left").filter("n > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
        winners = group.groupBy("component").agg(F.min("first").alias("best"))
        winner = group.select("id", "component").join(winners, "component").select("id", F.col("best.did").alias("best_did"), F.col("best.line").alias("best_line"), F.col("best.th").alias("best_th"))
        lost = found.filter("not known").select("did", "th", "line", "id").join(winner, "id").filter("did != best_did or line != best_line or th != best_th").select("did", "th", "line")
        removed = cut(written(lost.union(found.filter("known").select("did", "th", "line")).groupBy("did", "th").agg(F.collect_set("line").alias("lost"))))

    # The row is kept as one column, so that its own columns' names cannot clash.
    rows = docs.select(*[c.alias(k) for k, c in own.items()], F.struct(F.lit(None).alias(text_col), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), text.alias("text"))
    joined = rows.join(removed, ["did", "th"], "left")
    split = F.split("text", "\n", -1)
    # Inside the function the lines are an argument, so they are found once a row.
    kept = F.transform(F.array(split), lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col("lost")), lambda k: F.element_at(s, k + 1)), "\n"))
    new = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.element_at(kept, 1))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1)
    n_removed = F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost"))
    rest = [F.col("row")[c].alias(c) if c != text_col else new.alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*rest, n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))

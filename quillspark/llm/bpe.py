"""BPE encoding and decoding of texts with a public vocabulary file, in batched numpy merge rounds.

The vocabulary's file has a normalizer (NFC, white space, lower case), a splitting pattern, byte
symbols and merges with a word-end suffix. All new words of a block of texts are merged at once:
their symbols lie in one flat array, the ranks of neighbouring pairs come from a binary search over
the sorted pair keys, and each round merges every word's pair of lowest rank.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bound_batches

#: White space as Unicode has it (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
#: The splitting pattern for lower-case text whose characters all lie below U+0100, where NFC changes nothing.
LATIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\t-\\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
#: Words that a worker remembers; beyond it forgets all and starts anew.
REMEMBERED = 200_000
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """A vocabulary file's symbols and merges, and what it has made of the words seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*self.ids.values(), *self.added.values()]) + 1
        self.strings = [""] * self.size
        for text, i in [*self.ids.items(), *self.added.items()]:
            self.strings[i] = text
        self.split = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{WHITE}\\p{{L}}\\p{{N}}]+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([self.ids[x] for x in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        if self.size**2 > 2**32:
            raise ValueError("pair keys of this vocabulary do not fit 32 bits")
        self.keys, self.ranks, self.made = keys[order].astype(np.uint32), order, made
        # A merge whose result is part of a pair of lower rank would have to be followed at once.
        least = np.full(self.size, len(pairs))
        np.minimum.at(least, left, np.arange(len(pairs)))
        np.minimum.at(least, right, np.arange(len(pairs)))
        self.one_by_one = bool((least[made] < np.arange(len(pairs))).any())
        symbols = byte_symbols()
        self.inner = np.array([self.ids[s] for s in symbols])
        self.last = np.array([self.ids[s + self.suffix] for s in symbols])
        self.forget()

    def forget(self) -> None:
        """Back to the added tokens alone."""
        self.known = {token: k for k, token in enumerate(self.added)}
        self.text = list(self.added)
        self.store = np.array([*self.added.values()], np.int32)
        self.end = np.arange(len(self.added) + 1)  # where the ids of each word end in the store

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and the first of each word, with the end."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        found = np.full(len(symbols), _NONE)  # the rank of the pair that begins here
        changed = np.arange(len(symbols) - 1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            found[changed] = self.find(symbols, word, changed)
            new = np.empty(len(word), bool)
            new[0] = True
            np.not_equal(word[1:], word[:-1], out=new[1:])
            begin = np.flatnonzero(new)
            least = np.minimum.reduceat(found, begin)
            lengths = np.diff(np.append(begin, len(symbols)))
            bar = np.repeat(least, lengths)
            over = bar == _NONE
            at = np.flatnonzero((found == bar) & ~over)
            if self.one_by_one:  # the leftmost of each word
                at = at[np.append(True, word[at[1:]] != word[at[:-1]])] if len(at) else at
            elif len(at):  # of hits that overlap, every other one from the left
                run = np.append(True, np.diff(at) > 1)
                start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if over.any():
                done.append((symbols[over], word[over]))
            symbols[at] = self.made[found[at]]
            keep = ~over
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, found = symbols[keep], word[keep], found[keep]
            at = moved[at]
            if len(symbols):
                found[-1] = _NONE
                changed = np.concatenate((at, at[at > 0] - 1))
                changed = changed[changed < len(symbols) - 1]
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
        ids, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.int32), np.searchsorted(word[order], np.arange(len(words) + 1))

    def find(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each position, found by binary search; _NONE without one."""
        keys = (symbols[at] * self.size + symbols[at + 1]).astype(np.uint32)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[place] == keys) & (word[at] == word[at + 1]), self.ranks[place], _NONE)

    def learn(self, words: list[str]) -> None:
        ids, first = self.merge([w.encode() for w in words])
        self.known.update(zip(words, range(len(self.text), len(self.text) + len(words)), strict=True))
        tokens, ends = [self.strings[i] for i in ids.tolist()], first.tolist()
        self.text += [" ".join(tokens[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.end = np.concatenate((self.end, self.end[-1] + first[1:]))
        self.store = np.concatenate((self.store, ids))

    def words(self, text: str) -> list[str]:
        """The pieces of a text that are merged each by itself; added tokens stand as they are."""
        if self.specials and "<|" in text:
            parts, at = [], 0
            for m in self.specials.finditer(text):
                parts += [*self.plain(text[at : m.start()]), m[0]]
                at = m.end()
            return parts + self.plain(text[at:])
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return LATIN_SPLIT.findall(text.lower())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids in one array, the first of each text with the end, and each text's decoding."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = [self.words(t) for t in texts]
        if new := list(set(chain.from_iterable(split)).difference(self.known)):
            self.learn(new)
        index = [list(map(self.known.__getitem__, ws)) for ws in split]
        flat = np.array(list(chain.from_iterable(index)), np.int64)
        begin, end = self.end[flat], self.end[flat + 1]
        after = np.cumsum(end - begin)
        ids = self.store[np.repeat(end - after, end - begin) + np.arange(after[-1] if len(after) else 0)]
        ends = np.concatenate(([0], after))[np.cumsum([0, *map(len, index)])]
        return ids, ends, [" ".join(map(self.text.__getitem__, ws)) for ws in index]


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each worker."""
    return Vocabulary(path)


def _encoded(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for part in blocks(batch):
                ids, first, decoded = own.encode([t or "" for t in part.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                rest = [part.column(c) for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*rest, lists, *[pa.array(decoded, pa.string())] * decode], [*[c for c in part.schema.names if c != "text"], "ids", *["decoded"] * decode])

    return run


def encode(docs: DataFrame, path: str, decode: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row of docs, in one narrow pass.

    ids are those that the vocabulary file at path (on every executor) gives to the whole text
    without special tokens added; strings of added tokens in a text are those tokens. decoded is the
    ids' tokens joined by one space; without decode it is left out. A null text is empty and has
    no ids. Ids and rows may repeat; an empty table gives an empty result; other columns are
    ignored. The file must be of the kind the module describes.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encoded(path, decode), f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, decoded) for rows of ids: their tokens joined by one space; null or no ids give an empty string, ids outside the vocabulary nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary(path).strings
        for batch in batches:
            texts = [" ".join([strings[i] for i in ids or [] if i is not None and 0 <= i < len(strings)]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    bound_batches(rows.sparkSession)
    picked = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, decoded string")

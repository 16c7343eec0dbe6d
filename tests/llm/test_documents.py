"""Operators on documents, each beside a brute-force version, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, fuzzy_lines, langid, minhash, mixing, queries, substrings
from quillspark.llm.common import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, th string, live int"


@pytest.fixture(scope="module")
def docs(spark):
    """Prose with exact and near copies, long shared passages, empty, null and long texts, repeated rows, null ids, and columns whose names clash."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgëñß") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = prose(60)
    texts = [prose(rnd.randint(1, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " x", prose(30) + "\n" + shared + "\n" + prose(10), prose(5) + " " + shared + " " + prose(9)]
    base = prose(200).split()
    for _ in range(25):
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(len(copy))] = prose(1)
        texts.append(" ".join(copy))
    texts += ["", None, " \n\t ", "one", "A b C D", "a b c d", prose(4000), "same " * 90]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = [(i, t, None if i % 9 == 0 else ("en", "de")[i % 2], ("a", "b", None, "é")[i % 4], 0, "x", "y", 1) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[0], rows[0], rows[63], (None, texts[5], "en", "a", 1, None, None, None), (None, None, None, None, None, None, None, None), (ids[7], texts[8], "en", "b", 1, "x", "y", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def place(i):
    return -(2**63) if i is None else i


def test_words_are_those_of_the_pattern():
    texts = ["Hello  World\tx", None, "", " é\xa0b c\x1cd\x85 ", "A"]
    words = Words(pa.array(texts))
    assert words.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert [words.word(k).decode() for k in range(len(words.starts))] == [w for t in texts for w in WORD.findall(t or "")]


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, percent):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = Counter((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in rows)
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, percent).collect())
    assert got == want


def test_circulant_signatures_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64)
    s = minhash.signatures([a, a[:800]], 600)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.06
    assert len(np.unique(minhash.second_permutation(np.arange(1 << 16, dtype=np.uint32)))) == 1 << 16


def test_repeated_passages(docs):
    rows = [(place(r.doc_id), WORD.findall(r.text or ""), r.doc_id) for r in docs.collect()]
    first = {}
    for i, w, _ in rows:
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (i, k)), (i, k))
    want = Counter()
    for i, w, doc_id in rows:
        lost = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i, k):
                lost.update(range(k, k + 20))
        want[doc_id, len(w), len(lost), " ".join(x for k, x in enumerate(w) if k not in lost)] += 1
    for base in (5, 10, 20):
        assert Counter(tuple(r) for r in substrings.drop_repeated_passages(docs, 20, base).collect()) == want
    with pytest.raises(ValueError):
        substrings.drop_repeated_passages(docs, 20, 7)


def test_anchors_are_leftmost_least():
    h = np.array([5, 3, 3, 9, 1, 7, 1], np.uint64)
    for width in range(1, 8):
        want = [min(range(k, k + width), key=lambda j: (h[j], j)) for k in range(len(h) - width + 1)]
        assert substrings.anchors(h, width).tolist() == want


def groups_of_lines(rows, most_bits=fuzzy_lines.MOST_BITS):
    """What is left of rows (id, text) by brute force over all pairs of lines: Counter of (id, text, n_lines)."""
    def kind(x):
        m = fuzzy_lines.normal(x)
        return m if len(m) >= 20 or not m else ("short", *WORD.findall(x))

    import xxhash

    signed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63  # noqa: E731  what tells rows of one id apart
    occ = [((place(i), n, signed(t)), kind(x)) for i, t, *_ in rows if t is not None for n, x in enumerate(t.split("\n")) if kind(x)]
    kinds = sorted({m for _, m in occ if isinstance(m, str)})
    words = Words(pa.array(kinds, pa.string()))
    tokens = fuzzy_lines._tokens(words)
    sims = fuzzy_lines.simhashes(tokens.hashes(), tokens.ends - tokens.starts, tokens.first)
    keys = [[{(k, *(int(half) >> 7 * ((k + j) % 9) & 127 for j in (0, 1, 3))) for k in range(9)} for half in s] for s in sims]

    def near(a, b):
        return any(keys[a][h] & keys[b][h] and (int(sims[a][1 - h] ^ sims[b][1 - h]) >> 8).bit_count() <= most_bits for h in (0, 1))

    parent = {m: m for _, m in occ}

    def root(m):
        while parent[m] != m:
            m = parent[m]
        return m

    for a, x in enumerate(kinds):
        for b, y in enumerate(kinds[:a]):
            if near(a, b) and fuzzy_lines.distance(x, y) <= 0.1 * max(len(x), len(y)) + 1e-9:
                parent[root(x)] = root(y)
    best = {}
    for at, m in occ:
        best[root(m)] = min(best.get(root(m), at), at)
    lost = {at for at, m in occ if best[root(m)] != at}
    want = Counter()
    for i, t, *_ in rows:
        kept = None if t is None else [x for n, x in enumerate(t.split("\n")) if (place(i), n, signed(t)) not in lost]
        want[i, None if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1] += 1
    return want


def test_fuzzy_lines(spark):
    rnd = random.Random(2)
    line = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(n))
    lines = [line(rnd.randint(8, 60)) for _ in range(40)]
    lines += [x.upper() + " 12!" for x in lines[:5]] + [x + " 77." for x in lines[:5]] + [x.replace("a", "b", 1) for x in lines[5:25]] + ["short", "Short", "1.", "2.", "", " ", "---", "中文" * 30, "中文" * 29 + "文字", line(400), "ab" * 200]
    rows = [(k % 23 if k % 11 else None, None if k == 30 else "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 8))), k) for k in range(60)]
    rows += [rows[5], rows[6], (100, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int").repartition(4)
    got = Counter((r.doc_id, r.text, r.n_lines) for r in fuzzy_lines.drop_fuzzy_lines(df).collect())
    assert got == groups_of_lines(rows)


def test_rows_without_ids_lose_repeated_lines(spark):
    """Six rows with a null id and one common first line: five lose it."""
    df = spark.createDataFrame([(None, f"one and the same first line of a text\nanother line number {k} of words {'abcdef'[k] * 9}") for k in range(6)], "doc_id long, text string")
    got = [r.text.count("first line") for r in fuzzy_lines.drop_fuzzy_lines(df).collect()]
    assert sorted(got) == [0, 0, 0, 0, 0, 1]


def test_fuzzy_lines_keep_columns_and_take_very_long_texts(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    line = " ".join(word() for _ in range(40))
    long = "\n".join([" ".join(word() for _ in range(30)) for _ in range(25_000)] + [line])
    endless = " ".join(word() for _ in range(150_000))
    rows = [(1, line, "a", {"th": 1}), (2, long, "b", {"x": 2}), (3, endless, "c", None), (4, endless + " end\n" + line, "d", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, did string, `th` map<string,int>").withColumns({"row": F.lit(1), "lost": F.lit("x"), "a.b": F.lit(2)})
    got = {r.doc_id: r for r in fuzzy_lines.drop_fuzzy_lines(df).collect()}
    assert len(long) > 5_000_000 and got[1].text == line and got[2].text == long[: -len(line) - 1] and got[3].text == endless and got[4].text == ""
    assert [got[k].did for k in (1, 2, 3, 4)] == ["a", "b", "c", "d"] and got[1].th == {"th": 1} and got[1].row == 1 and got[1].lost == "x" and got[1]["a.b"] == 2
    assert [got[k].n_removed for k in (1, 2, 3, 4)] == [0, 1, 0, 2]


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for k, x in enumerate(a, 1):
            row, last = [k], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert fuzzy_lines.distance(a, b) == plain(a, b)
        a, b = (" ".join("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 6))) for _ in range(2))
        assert plain(a, b) <= fuzzy_lines.at_most(a, b, 1e9)
    left, right = [], []
    for n in [*range(12), 63, 64, 65, 127, 128, 129, 200, 300] * 3:
        a = "".join(rnd.choice("abcdé文") for _ in range(n))
        b = list(a)
        for _ in range(rnd.randint(0, 2 + n // 6)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 2)] = rnd.choice(["", "a", "xy", "文"])
        left.append(a)
        right.append("".join(b))
    for share in (0.02, 0.1, 0.5, 2):
        most = np.array([share * max(len(a), len(b)) for a, b in zip(left, right, strict=True)])
        got, want = fuzzy_lines.distances(left, right, most), np.array([plain(a, b) for a, b in zip(left, right, strict=True)])
        assert ((got == want) | ((want > most) & (got >= want))).all()
    assert (fuzzy_lines.alike(left, right, 0.9) == [plain(a, b) <= 0.1 * max(len(a), len(b)) + 1e-9 for a, b in zip(left, right, strict=True)]).all()


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    odd = ["<|endoftext|>It's</w> ΣΑΣ İstanbul ½x9 'LL 'sword", "é 　\u0085naïve 中文字 😀👍🏽 " + "ab" * 500, "a" * 3000, None, "<|startoftext|<|startoftext|>>"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(df, path).collect())
    want = Counter()
    for i, t in df.collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    again = bpe.decode(bpe.encode(df, path), path)
    assert Counter((r.doc_id, r.decoded) for r in again.collect()) == Counter((i, d) for i, _, d in want.elements())


def test_bpe_query_digests(spark, folder):
    row = queries.op5_bpe(spark, folder).orderBy("doc_id").first()
    assert len(row.ids_sha256) == len(row.decoded_sha256) == 64 and row.n_tokens > 0


def test_language(spark, docs, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    out = queries.op1_language(spark, folder).join(table.select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.collect())
    profiles = langid.learn(docs)
    got = {r.text: (r.lang_pred, r.score) for r in langid.predict(docs, profiles).collect()}
    assert got[""] == got[None] == got[" \n\t "] == ("und", 0.0)
    assert langid.predict(docs, langid.learn(docs.filter("false"))).filter("lang_pred <> 'und'").isEmpty()
    assert langid.predict(docs.filter("false"), profiles).count() == 0


def test_out_of_place_distance():
    profiles = langid.Profiles([("x", int(g.astype(np.int64)), k) for k, g in enumerate(langid.ranked(langid.grams("the cat the hat")))] + [("y", int(g.astype(np.int64)), k) for k, g in enumerate(langid.ranked(langid.grams("der hut die katze")))])
    assert profiles.predict("the cat the hat") == ("x", 1.0)
    assert profiles.predict("12 34") == ("und", 0.0)
    own = langid.ranked(langid.grams("the cut"))
    known = {int(g): k for k, g in enumerate(langid.ranked(langid.grams("the cat the hat")))}
    total = sum(abs(known[int(g)] - k) if int(g) in known else langid.TOP for k, g in enumerate(own))
    assert profiles.predict("the cut")[1] == pytest.approx(1 - total / (langid.TOP * len(own)))


def shares_by_hand(sizes, weights=(5, 2, 1), most=3):
    """Targets found by raising one level until all words are shared."""
    weight, low, high = [weights[k % 3] for k in range(len(sizes))], 0.0, most * sum(sizes) + 1.0
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(w * level, most * n) for w, n in zip(weight, sizes, strict=True)) < sum(sizes) else (low, level)
    return [min(w * low, most * n) for w, n in zip(weight, sizes, strict=True)]


def mixed_by_hand(spark, rows, block_words, depth, leaves):
    """The mix's blocks (did, th, pass, block, words, shard), drawn one by one; leaves are the tree's quotas."""
    distinct = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "source", F.xxhash64("text", "source").alias("th")).collect()
    copies = Counter((place(r.doc_id), r.th, r.source, len(WORD.findall(r.text or ""))) for r in distinct)
    sizes = Counter()
    for (_, _, source, n), c in copies.items():
        sizes[source] += n * c
    order, out = sorted(sizes, key=lambda s: (s is None, s or "")), set()
    for sid, t in enumerate(shares_by_hand([sizes[s] for s in order])):
        blocks = [(p, d, th, b, min(block_words, n - b * block_words), c) for (d, th, s, n), c in copies.items() if s == order[sid] for p in range(4) for b in range(-(-n // block_words))]
        hashed = spark.createDataFrame(blocks, "p long, did long, th long, b long, w long, c long").select("p", "did", "th", "b", "w", "c", F.xxhash64(F.lit(0), "p", "did", "th", "b").alias("h")).collect()
        whole = round(t) // max(1, sizes[order[sid]])
        left = [int(n) for n in leaves[:, sid]]
        for r in sorted(hashed, key=lambda r: (r.h, r.did, r.th, r.b)):
            shard, words = (r.h % 2**64) >> (64 - depth), r.w
            if r.p == whole:
                words = min(words, left[shard] // r.c)
                left[shard] -= r.w * r.c
            if r.p <= whole and words > 0:
                out.add((r.did, r.th, r.p, r.b, words, shard))
    return out


def test_mix(spark, docs, monkeypatch):
    split, seen = mixing.split, []
    monkeypatch.setattr(mixing, "split", lambda *a: seen.append((a, split(*a))) or seen[-1][1])
    out, blocks = mixing.mix(docs, block_words=16, shard_blocks=64)
    rows, whole = out.collect(), [tuple(r) for r in docs.collect()]
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, size(r.text)) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = shares_by_hand([by[s][0].source_size for s in order])
    for s, t in zip(order, want, strict=True):
        assert by[s][0].target == pytest.approx(t)
        assert abs(sum(r.taken for r in by[s]) - t) <= 3 * len(seen[0][1]) and by[s][0].source_size == sum(r.size for r in by[s])
    assert all(r.taken <= 3 * r.size for r in rows)
    parts = blocks.collect()
    (held, quotas, _), leaves = seen[0]
    assert leaves.sum(0).tolist() == quotas.tolist() and (leaves <= held).all() and (leaves >= 0).all() and len(leaves) >= 8
    assert {(r.did, r.th, r["pass"], r.block, r.words, r.shard) for r in parts} == mixed_by_hand(spark, whole, 16, int(np.log2(len(leaves))), leaves) and len(set(map(tuple, parts))) == len(parts)
    counts = Counter(r.shard for r in parts)
    assert len(counts) >= 8 and max(counts.values()) < 2 * min(counts.values())
    assert all(sorted(r.position for r in parts if r.shard == s) == list(range(n)) for s, n in counts.items())
    again = mixing.mix(docs.repartition(7), block_words=16, shard_blocks=64)[1]
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, parts), key=repr)
    texts = mixing.mixed_texts(docs.dropDuplicates(["doc_id", "text"]), blocks)
    assert texts.columns == docs.columns and {r.did for r in texts.collect()} <= {"x", None}
    assert sum(size(r.text) for r in texts.collect()) == sum(r.words for r in parts)
    assert mixing.mix(docs.filter("false"))[0].count() == 0


def test_taken_words_come_through_the_tree(spark, folder, monkeypatch):
    """Leaves that share the same quotas otherwise give other documents, the same words of each source."""
    table = spark.read.parquet(f"{folder}/documents.parquet")
    before, _ = mixing.mix(table)
    split = mixing.split

    def first_shards_first(held, quotas, seed):
        upto = np.cumsum(held, 0)
        out = np.diff(np.minimum(upto, quotas), axis=0, prepend=0)
        assert len(held) >= 8 and out.sum(0).tolist() == split(held, quotas, seed).sum(0).tolist()
        return out

    rows = {r.doc_id: r for r in before.collect()}
    monkeypatch.setattr(mixing, "split", first_shards_first)
    other = {r.doc_id: r for r in mixing.mix(table)[0].collect()}
    total = lambda m: {s: sum(r.taken for r in m.values() if r.source == s) for s in {r.source for r in m.values()}}
    assert total(rows) == total(other) and sum(rows[k].taken != other[k].taken for k in rows) > len(rows) // 20


def test_targets_and_tree():
    assert mixing.targets([10, 10, 10]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.targets([1, 100, 100, 0]) == pytest.approx([3, 132, 66, 0])
    held = np.array([[5, 0, 7], [1, 0, 9], [0, 0, 2], [6, 0, 1]])
    for quotas in ([0, 0, 19], [12, 0, 0], [5, 0, 11]):
        leaves = mixing.split(held, np.array(quotas))
        assert leaves.sum(0).tolist() == quotas and (leaves >= 0).all() and (leaves <= held).all()
    big = np.array([[10**12, 3], [10**12, 10**11], [5, 10**11], [10**12, 0]])
    leaves = mixing.split(big, np.array([2 * 10**12 + 1, 10**11 + 2]))
    assert leaves.sum(0).tolist() == [2 * 10**12 + 1, 10**11 + 2] and (leaves <= big).all() and abs(leaves[0, 0] / leaves[1, 0] - 1) < 0.01
    # The leaves' quotas are distributed as one multivariate hypergeometric draw.
    pool = np.array([4, 3, 2, 3])
    got = Counter(tuple(mixing.split(pool[:, None], np.array([5]), seed)[:, 0].tolist()) for seed in range(20_000))
    want = Counter(map(tuple, np.random.default_rng(1).multivariate_hypergeometric(pool, 5, 20_000).tolist()))
    assert all(abs(got[k] - want[k]) < 5 * (got[k] + want[k] + 9) ** 0.5 for k in got | want)
    assert mixing.depth_of(10, 3) == 3 and mixing.depth_of(1 << 23, 5) == 8 and mixing.depth_of(10**12, 5) == 17


def test_empty_table(docs):
    none = docs.filter("false")
    assert minhash.near_duplicates(none).count() == 0
    assert substrings.drop_repeated_passages(none).count() == 0
    assert fuzzy_lines.drop_fuzzy_lines(none).count() == 0
    assert bpe.encode(none, queries.vocabulary_path()).count() == 0


def test_digest_of_kept_words(spark, folder):
    rows = queries.op8_substrings(spark, folder).collect()
    assert any(r.n_removed for r in rows)
    assert all(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.n_removed == r.n_words)


def test_languages_of_null_columns(spark):
    df = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    assert langid.predict(df, langid.learn(df, ~held)).first().lang_pred == "und"


def test_share_of_edited_lines_found(spark):
    """Lines with one word replaced: nearly all differ in few enough bits, and most share a key."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    rows = []
    for k in range(300):
        words = [word() for _ in range(rnd.randint(15, 60))]
        at = rnd.randrange(len(words))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:at], word(), *words[at + 1 :]]))]
    got = fuzzy_lines.drop_fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    lost = {r.doc_id for r in got.filter("n_removed > 0").collect()}
    assert all(i % 2 for i in lost) and len(lost) >= 0.8 * 300


def test_equal_lines_have_one_id():
    line = "the same line of a good many words, wherever it lies"
    rows = pa.RecordBatch.from_pydict({"did": list(range(50)), "th": list(range(50)), "text": ["x " * k + "\n" + line for k in range(50)]})
    found = pa.Table.from_batches(fuzzy_lines._lines(20)(iter([rows])))
    same = [i for i, n in zip(found["id"].to_pylist(), found["line"].to_pylist(), strict=True) if n == 1]
    assert len(same) == 50 and len(set(same)) == 1


def test_pairs_out_of_reach_of_the_edit_similarity_are_not_made(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefg hé漢0") for _ in range(n))
    texts = [text(rnd.randint(20, 200)) for _ in range(12)] + ["a" * 600, "a" * 640]
    texts += [t[: len(t) // 2] + text(k % 9) + t[len(t) // 2 + k % 5 :] for k, t in enumerate(texts)]
    rows = [(k, t, len(t), fuzzy_lines.letter_counts(t).tolist()) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, size int, counts array<int>").select("id", F.struct("size", "counts").alias("data"))
    x, y = F.col("x.data"), F.col("y.data")
    got = {(r[0], r[1]) for r in df.alias("x").join(df.alias("y"), F.col("x.id") < F.col("y.id")).filter(fuzzy_lines.in_reach(x, y, 0.9)).select("x.id", "y.id").collect()}

    def reach(a, b):
        most, counts = 0.1 * max(len(a), len(b)) + 1e-9, [np.bincount([ord(c) & 31 for c in t], minlength=32) for t in (a, b)]
        return abs(len(a) - len(b)) <= most and np.abs(counts[0] - counts[1]).sum() + abs(len(a) - len(b)) <= 2 * most

    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    assert got == {(i, j) for i, j in pairs if reach(texts[i], texts[j])}
    similar = {(i, j) for i, j in pairs if fuzzy_lines.distance(texts[i], texts[j]) <= 0.1 * max(len(texts[i]), len(texts[j])) + 1e-9}
    assert similar and similar <= got and len(got) < len(pairs)


def test_members_of_a_bucket_meet_in_blocks_not_in_pairs(spark, monkeypatch):
    """One bucket of 300 lines of which few are linked: every two components meet once, and the pairs are no rows."""
    from quillspark.llm import components

    monkeypatch.setattr(components, "BLOCK", 40)
    component = lambda k: 0 if k < 90 else k - k % 2
    rows = spark.createDataFrame([(7, k, k, component(k)) for k in range(300)] + [(8, k, k, k) for k in range(5)], "bucket long, id long, data long, component long")
    met = {}
    for r in components.meetings(rows).collect():
        met.setdefault((r.bucket, r.meeting), []).append(r)
    made = sum(map(len, met.values()))
    assert made == components._copies(rows)[0] and made <= 300 * 10 + 5
    times = Counter()
    for (bucket, _), group in met.items():
        assert len(group) <= 4 * 40
        for x in group:
            for y in group:
                if x.id < y.id and x.component != y.component and (x.first is None or x.first != y.first):
                    times[bucket, x.id, y.id] += 1
    apart = [(7, x, y) for y in range(300) for x in range(y) if component(x) != component(y)] + [(8, x, y) for y in range(5) for x in range(y)]
    assert times == Counter(apart)

    asked = []

    def prepare(_):
        def linked(pairs):
            asked.append(pairs.count())
            return pairs.filter("(b - a) % 100 = 0")

        return linked

    def met_links(meetings):
        ids = meetings.select("bucket", "meeting", F.col("id").alias("a")).join(meetings.select("bucket", "meeting", F.col("id").alias("b")), ["bucket", "meeting"])
        return ids.filter("a < b and (b - a) % 100 = 0").select("a", "b").distinct()

    none = spark.range(0).selectExpr("id as a", "id as b")
    got = components.linked_components(rows.filter("bucket = 7").drop("component"), lambda x, y: F.lit(True), prepare, none, met_links=met_links)
    assert {r.id: r.component for r in got.collect()} == {k: k % 100 for k in range(300)}
    assert sum(asked) <= 5 * 300  # 44,550 pairs


def test_lines_of_one_passage_with_other_heads_are_linked_as_by_brute_force(spark, monkeypatch):
    """A passage under many heads: near lines, most of them not similar, that meet in several small blocks."""
    from quillspark.llm import components

    monkeypatch.setattr(components, "BLOCK", 6)
    monkeypatch.setattr(fuzzy_lines, "MEET", 16)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    passage = [word() for _ in range(45)]
    heads = [[word() for _ in range(6)] for _ in range(30)]
    lines = [" ".join([*rnd.choice(heads)[: rnd.randint(3, 6)], *passage[: rnd.randint(43, 45)]]) for _ in range(120)]
    rows = [(k, line) for k, line in enumerate(lines)]
    got = Counter((r.doc_id, r.text, r.n_lines) for r in fuzzy_lines.drop_fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == groups_of_lines(rows)


def test_distances_along_a_band():
    rnd = random.Random(3)
    for similarity in (0.0, 0.5, 0.9, 1.0):
        left, right = [], []
        for _ in range(400):
            letters = rnd.choice(("ab", "abcdefgh ", "a漢é😀\0b"))
            a = [rnd.choice(letters) for _ in range(rnd.choice((0, 1, 10, 63, 64, 65, 128, 300)))]
            b = list(a)
            for _ in range(rnd.randint(0, int(2.2 * (1 - similarity) * len(a)) + 2)):
                at = rnd.randint(0, len(b))
                b[at : at + rnd.randint(0, 1)] = rnd.choice(letters) * rnd.randint(0, 1)
            left.append("".join(a))
            right.append("".join(b))
        want = [fuzzy_lines.distance(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9 for a, b in zip(left, right, strict=True)]
        assert fuzzy_lines.alike(left, right, similarity).tolist() == want


def test_block_keys_in_numpy_are_those_of_spark(spark):
    sims = np.random.default_rng(1).integers(-(2**63), 2**63, (50, 2))
    df = spark.createDataFrame([tuple(map(int, s)) for s in sims], "sim long, sim2 long").select("sim", "sim2", fuzzy_lines.block_keys(F.col("sim"), F.col("sim2")).alias("keys"))
    for r in df.collect():
        assert fuzzy_lines.block_keys_of(np.array([[r.sim, r.sim2]]), 7).tolist() == [r["keys"]]

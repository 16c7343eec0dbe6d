"""Ranked search, periodic runs and main texts beside brute force and written-out pages."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import main_text, periodic, queries, ranked

TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranking(items, docs, k):
    """[(item, rank, doc, score)] of every document, straight from the definition."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_all = sum(1 for _, c in counts if c)
    whole = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 75 + 25 * c.total() * n_all // max(whole, 1)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, -math.inf if doc is None else doc, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for k in range(700)]
    docs += [(700, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (701, None), (702, ""), (703, " .,;"), (None, docs[5][1]), (704, "Élan STRASSE straße W1 w1"), (705, "w1 w2 " * 20000)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(3, 25)))) for k in range(20)]
    items += [(50, "w1 W1 w2 w1"), (51, None), (52, "?!"), (53, "nowhere"), (54, "élan Élan strasse STRASSE"), (None, "w3 w4"), (0, "w5")]
    return items, docs


def test_ranking_equals_definition(spark, corpus):
    items, docs = corpus
    asked = spark.createDataFrame([(i, t, 0.5, "x") for i, t in items], "item_id long, text string, score double, did string")
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, query int").repartition(5)
    want = sorted(ranking(items, docs, 7), key=repr)
    for shard_bytes, query_chars in ((1 << 25, 1 << 25), (4000, 300)):
        got = ranked.search(asked, table, k=7, shard_bytes=shard_bytes, query_chars=query_chars)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_ranking_of_empty_tables(spark, corpus):
    items, docs = corpus
    asked = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert ranked.search(asked, table.limit(0)).count() == 0
    assert ranked.search(asked.limit(0), table).count() == 0
    assert ranked.search(asked, table.filter("doc_id in (701, 702, 703)")).count() == 0


def test_long_lists_are_skipped():
    """The k-th best score spares postings of frequent terms, and results stay those of all sums."""
    rng = np.random.default_rng(1)
    did = np.arange(0, 60000, 2)
    lists = [(np.sort(rng.choice(len(did), n, replace=False)), rng.integers(1, top, n)) for n, top in ((20000, 40), (15000, 90), (9000, 300), (300, 3000), (40, 9000), (5, 9000))]
    whole = np.zeros(len(did), np.int64)
    for doc, gain in lists:
        whole[doc] += gain
    best = ranked.Best(20)
    read = ranked.evaluate(lists, did, best)
    order = np.lexsort((did, -whole))[:20]
    assert best.did.tolist() == did[order].tolist() and best.score.tolist() == whole[order].tolist()
    assert read < sum(len(d) for d, _ in lists) / 4


def runs_by_definition(words, least=24, times=3):
    found = set()
    for q in range(1, len(words) // times + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i - q
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - begin >= max(least, times * q):
                part = words[begin:i]
                if not any(all(part[j] == part[j - r] for j in range(r, len(part))) for r in range(1, q)):
                    found.add((begin, i - begin, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_by_definition(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def texts_with_runs():
    rnd = random.Random(5)
    out = [["a"] * 30, ["a"] * 23, ["a", "b"] * 12, ["a", "b"] * 11 + ["a"], list("abc") * 8 + list("abd") * 9, (["x"] * 9 + ["y"]) * 7, ((["x"] * 30 + ["y"]) * 5), []]
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    out.append(list(fib[-1]))
    for _ in range(150):
        words = []
        while len(words) < rnd.randint(0, 260):
            piece = [rnd.choice("ab" if rnd.random() < 0.4 else "abcdefgh") for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 17, 33, 50]))]
            words += (piece * rnd.choice([1, 1, 2, 3, 4, 12]))[: rnd.randint(1, 200)]
        out.append(words)
    return out


def test_runs_equal_definition(spark):
    texts = texts_with_runs()
    docs = spark.createDataFrame([(k, "\t".join(w), 0, "x") for k, w in enumerate(texts)], "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    for k, words in enumerate(texts):
        want = runs_by_definition(words)
        assert [tuple(r) for r in got[k].runs] == want, (k, words)
        best = min(want, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)
        assert (got[k].strongest and tuple(got[k].strongest)) == best
        assert got[k].collapsed == collapsed_by_definition(words, want) and got[k].n_words == len(words)


@pytest.mark.parametrize("least,times", [(1, 3), (5, 3), (40, 3), (10, 4), (24, 5)])
def test_runs_of_other_lengths(least, times):
    for words in texts_with_runs()[:60]:
        numbers = np.array([ord(w) for w in words] + [-1], np.int64)
        assert list(map(tuple, periodic.find_runs(numbers, len(words), least, times).tolist())) == runs_by_definition(words, least, times)


def test_runs_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "b " * 40), (4, "b " * 40), (4, "b " * 40), (5, "one two " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in periodic.periodic_runs(docs).collect()]
    b = (40, [(0, 40, 1)], (0, 40, 1), "b")
    assert sorted(got, key=repr) == sorted([(1, 0, [], None, ""), (2, 0, [], None, ""), (3, 0, [], None, ""), (None, *b), (4, *b), (4, *b), (5, 120000, [(0, 120000, 2)], (0, 120000, 2), "one two")], key=repr)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, times=2)


def test_periodic_query_on_whole_table(spark, folder):
    import hashlib
    import zlib

    rows = {r.doc_id: r for r in queries.op12_periodic(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    changed = 0
    for d in docs:
        words = re.findall("[^\x20\x09-\x0d]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            changed += 1
        runs = runs_by_definition(words) if n < 400 else None
        got = rows[d.doc_id]
        if runs is None:
            continue
        best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        milli = runs and 1000 * best[1] // best[2] or None
        assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (len(runs), *best, milli)
        assert got.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and got.collapsed_sha256 == digest(collapsed_by_definition(words, runs))
    assert changed > 5


ARTICLE = "<h1>Head</h1><p>First long paragraph of the article, with a number of words.</p><p>Short.</p><p><b>Second one is not closed.<br><p>Third &amp; last,&nbsp; with\n white   space &eacute;.</p>"
WANT = "Head\nFirst long paragraph of the article, with a number of words.\nShort.\nSecond one is not closed.\nThird & last, with white space é."
PAGES = {
    "around": f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav><div class='ad'>Buy this long and wonderful product now, all of you.</div><article>{ARTICLE}</article><footer>&copy; all rights</footer>",
    "inside": f"<body><main><div class='cookie-notice'>We use cookies, as everybody does these days.</div>{ARTICLE.replace('</p>', '<script>x()</script></p>', 1)}<aside>Also see this other article about things</aside><form>Name <input><button>Send this now</button></form><section id=comments><h3>Comments</h3><p>I liked this very much, and I read all of it twice.</p></section></main></body>",
    "header": f"<body><header><h2>The site</h2></header><article><header>{ARTICLE[:13]}</header>{ARTICLE[13:]}<footer>tags</footer></article>",
    "bare": f"<body><ul class=menu><li>One</ul><div>{ARTICLE}</div><div class='sidebar'><p>A sidebar of some length, to be left out of it.</p></div><div id='footer'>End</div>",
    "cut": f"<!DOCTYPE html><html><body><article>{ARTICLE}</article><div class='ad-box'><p>An advert that nobody has closed and that goes on for long",
    "inline": f"<body><article>{ARTICLE.replace('Short.', 'Sh<i>or</i>t<span class=ad>Buy</span><select><option>x</select>.')}</article>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text(name):
    assert main_text.text_of(PAGES[name]) == WANT


def test_thresholds_choose_regions():
    """Without an article element the ratio decides: a list of links with names of no meaning is left out."""
    links = "".join(f"<div><a href=x><b>l{k}</b></a></div>" for k in range(12))
    text = "".join(f"<p>{'words of the text ' * (k % 3 + 4)}</p>" for k in range(6))
    got = main_text.text_of(f"<body><div>{links}</div><div>{text}<p>end</p></div><div>{links}</div></body>")
    assert got.split("\n") == [("words of the text " * (k % 3 + 4)).strip() for k in range(6)] + ["end"]
    assert main_text.smoothed(np.array([3.0])).tolist() == [3.0]


def test_main_text_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (None, None, "<p>Text &lt;b&gt;"), (3, "u", "no tags at all"), (3, "u", "no tags at all"), (4, "u", "<nav>Menu"), (5, "u", "<article><p>" + "long text " * 200000), (6, "u", "<<<>&#xD800;</ <!-- x")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = [tuple(r) for r in main_text.main_text(pages).collect()]
    whole = ("long text " * 200000).strip()
    want = [(1, "u", "", 0), (2, "u", "", 0), (None, None, "Text <b>", 8), (3, "u", "no tags at all", 14), (3, "u", "no tags at all", 14), (4, "u", "", 0), (5, "u", whole, len(whole))]
    assert sorted([r for r in got if r[0] != 6], key=repr) == sorted(want, key=repr)
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_pages_of_the_table(spark, folder):
    """On the given pages all of the article and nothing else is found."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries.op13_main_text(spark, folder).collect():
        inner = re.search("<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)

"""Hard negatives, ranked search and URL rules against plain versions, on nulls, blanks, ties, repeats and clashing columns."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from bidlake.llm import hard_negatives, lexical_search, url_filter

# --- 11: hard negatives ---

VECTORS = "vec_id long, embedding array<float>, label int, q long, row string, dist int"
LABEL = "case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x", None) for i, v, y in rows], VECTORS).repartition(3)


def mined(spark, rows, step, **options):
    df = hard_negatives.hard_negatives(vectors_of(spark, rows), F.expr(LABEL), F.expr(f"vec_id % {step} = 0"), **options)
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_mined(rows, step, positives=5, negatives=5, low=80, high=100):
    kept = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y))
    first = lambda found, n: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:n]
    out = []
    for a, (i, v, y) in enumerate(kept):
        if i is None or i % step:
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), j, z) for b, (j, w, z) in enumerate(kept) if b != a]
        for p, j, _ in first([x for x in scored if x[2] == y], positives):
            near = first([x for x in scored if x[2] != y and low * p <= 100 * x[0] <= high * p], negatives)
            out += [(i, j, rank, n, p, s) for rank, (s, n, _) in enumerate(near, 1)]
    return sorted(out, key=str)


def test_hard_negatives_small_cells(spark, monkeypatch):
    """Many cells and rounds, with a vector that a third of the rows share, other ties, repeats and rows that take no part."""
    for name, value in {"CELL_ROWS": 4, "BLOCK": 4, "TILE": 3, "SHARE": 2, "GROWTH": (2, 4, 16, 4096), "SAMPLE": 64}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(1)
    centres = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(5)]
    single = [float(x) for x in (0.5, 0.25, 0, 0, -0.125, 0.5)]
    rows = [(i, single if i % 3 == 0 else [float(f"{c + rng.gauss(0, 0.2):.2f}") for c in rng.choice(centres)], rng.randrange(3)) for i in range(400)]
    rows = [(i, [round(x * 256) / 256 for x in v], y) for i, v, y in rows]  # so that floats of 32 bits hold them
    rows += [(7, rows[7][1], 1), (100, rows[100][1], 1), (100, rows[100][1], 1), (None, rows[5][1], 1), (900, None, 1), (901, rows[1][1], None), (902, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (903, [float("inf")] * 6, 1), (904, [None] * 6, 2), (-20, rows[9][1], 2)]
    assert mined(spark, rows, 20) == plain_mined(rows, 20)


def test_hard_negatives_edges(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(10, [1.0, 0.0], 1)], 10) == []
    few = [(10, [1.0, 0.0], 1), (11, [0.5, 0.5], 1), (12, [0.5, 0.25], 2), (13, [-1.0, 0.0], 1), (15, [0.0, 0.0], 2), (16, [0.0, 1.0], 1)]
    assert mined(spark, few, 10) == plain_mined(few, 10) != []
    large = [(i, [float(2.0**20 * (i % 5 - 2)), float(2.0**18 * i)], i % 2) for i in range(1, 30)]  # scores beyond the exact range of doubles
    assert mined(spark, large, 10, positives=3) == plain_mined(large, 10, positives=3) != []
    assert mined(spark, [(10, [3e38, 1.0], 1), (11, [1.0, 1.0], 1), (12, [1.0, 1.0], 2)], 10) == []  # too long for 64 bits
    assert mined(spark, [(10, [], 1), (11, [], 1), (12, [], 2)], 10) == [(10, 11, 1, 12, 0, 0)]
    padded = [(10, [1.0, 1.0], 1), (11, [1.0], 1), (12, [1.0, 0.0], 2)]
    assert mined(spark, padded, 10) == [(10, 11, 1, 12, 65536, 65536)]


# --- 12: ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    counts = [(i, collections.Counter(TERM.findall(fold(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(fold(text))) if c[t])
            scored += [(-score, i is None, i)] if score > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, 3, "x", None) for i, t in docs], "doc_id long, text string, score int, term string, item long").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical_search.ranked_search(d, b, k).collect()), key=str)


def corpus(n=240, seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "Of", "plate", "é", "ÉTÉ", "日本", "x1"] + [f"w{k}" for k in range(60)]
    prose = lambda size: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(size)) + rng.choice(["", ".", "\n"])
    docs = [(i, prose(rng.choice((1, 5, 30, 80)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(n // 2)]  # a third are copies of one text
    docs += [(5, docs[5][1]), (5, "another w3 text"), (None, docs[6][1]), (900, None), (901, ""), (902, " .,"), (903, "w7 " * 5000)]
    items = [(k, prose(rng.choice((1, 6, 25)))) for k in range(12)] + [(3, "w1 w2"), (None, "W59 w59 the"), (50, None), (51, "unknownword"), (52, "")]
    return docs, items


@pytest.mark.parametrize("held, few", [(True, None), (False, 0)])
def test_ranked_search(spark, monkeypatch, held, few):
    """With the items' words in the tasks and with joins, and with joins by broadcast and by shuffle."""
    if not held:
        monkeypatch.setattr(lexical_search, "VOCABULARY_BYTES", 10)
        monkeypatch.setattr("bidlake.llm.common.SMALL_ROWS", few)
    docs, items = corpus()
    assert searched(spark, docs, items, 7) == plain_search(docs, items, 7)


def test_ranked_search_edges(spark):
    assert searched(spark, [], [(1, "a")], 3) == searched(spark, [(1, "a")], [], 3) == searched(spark, [(1, None)], [(1, "a")], 3) == []
    assert searched(spark, [(1, "a"), (2, "a b")], [(1, "B"), (1, "B")], 3) == plain_search([(1, "a"), (2, "a b")], [(1, "B"), (1, "B")], 3)


# --- 13: URL rules ---


def plain_glob(glob, text):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), text, re.S) is not None


def plain_fit(host_glob, path_glob, host, path):
    labels = host.split(".")
    return any(plain_glob(host_glob, ".".join(labels[k:])) for k in range(len(labels))) and plain_glob(path_glob, path)


def test_automaton_against_plain_globs():
    rng = random.Random(2)
    piece = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    globs = [(piece("ab.*?", 5), piece("/ab*?é", 6)) for _ in range(90)]  # some 900 positions, so many words of 64 bits
    urls = [(piece("ab.c", 8), piece("/abé日", 9)) for _ in range(400)] + [("a.b" * 40, "/ab" * 300), ("", "")]
    automaton = url_filter.Automaton(globs)
    got = automaton.match(urls)
    assert automaton.words > 8
    assert got.tolist() == [[plain_fit(*g, *u) for g in globs] for u in urls]
    assert [automaton.match([u])[0].tolist() for u in urls[:40]] == got[:40].tolist()
    assert url_filter.Automaton([]).match([("a", "/")]).shape == (1, 0) and automaton.match([]).shape == (0, 90)


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://a.EXAMPLE.com/en/1?x=/#y", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://b.www.example.com/en/q", "b.www.example.com", "/en/q", "www.example.com/en/", "allow"), ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("https://example.com", "example.com", "", None, "allow"), ("https://example.com?/en/", "example.com", "", None, "allow"), ("x://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("x://net/fr", "net", "/fr", None, "allow"), ("http://x.org/a.example.com/en/", "x.org", "/a.example.com/en/", None, "allow"), ("http://www.casino-win.example.org/es/", "www.casino-win.example.org", "/es/", None, "block"),
    ("http://U@Spam-Farm.example.org.:80/", "u@spam-farm.example.org.:80", "/", None, "block"), ("http://antispam-farm.org/", "antispam-farm.org", "/", None, "allow"), ("http://x.org/a/%77p-login.php", "x.org", "/a/%77p-login.php", None, "block"),
    ("http://x.com/a/../wp-login.php", "x.com", "/a/../wp-login.php", "com/", "allow"), ("http://x.org/b/../affiliate/./q", "x.org", "/b/../affiliate/./q", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("www.example.com/en/", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("://com/é日", "com", "/é日", "com/", "allow"), ("http://x.org/" + "a" * 100_000, "x.org", "/" + "a" * 100_000, None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x", 5)], "page_id long, url string, host string, id int")
    got = url_filter.judge_urls(pages).collect()
    assert [tuple(r)[:5] for r in got] == [(1, host, path, rule, verdict)]


def test_url_rows(spark):
    rows = [(1, "http://a.net/es/"), (1, "http://a.net/es/"), (None, "http://a.net/es/"), (2, None)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(2)).collect()
    assert sorted((r.page_id, r.verdict) for r in got if r.page_id) == [(1, "block"), (1, "block"), (2, "allow")] and len(got) == 4
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    other = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=[("keep", "*", "/")], globs=[], default="ask").collect()
    assert sorted((r.verdict, r.rule) for r in other if r.rule) == [("keep", "*/")] * 3 and [r.verdict for r in other if not r.rule] == ["ask"]

"""Lexical search, hard negatives and page texts beside plain Python, with the awkward cases."""

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import lower
from pyspark.sql import functions as F

from traitsieve.llm import hard_negatives, html_text, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def searched(docs, items, k):
    """Rows (item number, item_id, rank, doc_id, score) by the definition."""
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall(lower(text)))
        rows = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms
                if t in c
            )
            if score > 0:
                rows.append((-score, float("inf") if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: x[:2])[:k])]
    return out


def made_texts(seed=0, n=240):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["Ünïcode", "x1y", "THE", "the"]
    weights = 1 / np.arange(1, len(words) + 1)
    text = lambda size: " ".join(rng.choice(words, size, p=weights / weights.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(80)]  # a third are copies of one text
    docs += [(5, docs[5][1]), (None, docs[7][1]), (None, docs[3][1]), (2000, None), (2001, ""), (2002, "!? -- .")]
    docs += [(2003, "the " * 700 + text(3000)), (2004, "Ｆｕｌｌ don't_stop; W1-w2 W3")]
    items = [(i, text(int(rng.integers(3, 25)))) for i in range(12)]
    items += [(50, docs[3][1]), (51, ""), (52, None), (53, "nowhere found"), (None, "w1 w2"), (0, items[0][1])]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_terms": 60}, {"width": 64}])
def test_search_equals_the_definition(spark, options):
    """Also with items in several blocks, and with narrow sketches, whose bounds are loose."""
    docs, items = made_texts()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, rank string, score int").repartition(5)
    i = spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, q int")
    got = lexical_search.search(d, i, k=20, **options)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(searched(docs, items, 20), key=repr)


@pytest.mark.parametrize("piece", [1, 7, 500])
def test_long_texts_are_counted_in_pieces(piece):
    text = made_texts()[0][-2][1].encode()
    assert lexical_search.term_counts(text, piece) == lexical_search.term_counts(text)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.search(docs, items.where("false")).count() == 0
    assert lexical_search.search(docs, items).collect()[0]["doc_id"] == 1


def test_bounds_are_bounds():
    counts = [Counter({b"t%d" % (k % 9): k + 1 for k in range(30)}), Counter({b"t1": 70_000})]
    for c in counts:
        spots, most = lexical_search.sketch(c)
        held = dict(zip(np.frombuffer(spots, "<u4"), np.frombuffer(most, np.uint8)))
        for term, tf in c.items():
            assert held[lexical_search.crc32(term) & (lexical_search.WIDTH - 1)] >= min(tf, 255)


def mined(rows, every=50, positives=5, negatives=3):
    usable = {}
    for i, x, label in rows:
        fine = x is not None and all(v is not None and math.isfinite(v) for v in x)
        if i is None or label is None or not fine:
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        usable[i] = min(usable.get(i, (label, x)), (label, x))
    usable = {i: (label, [math.floor(256 * v) for v in x]) for i, (label, x) in usable.items()}
    out = []
    for a, (label, x) in usable.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in usable.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if usable[i][0] == label][:positives]:
            inside = [i for i in order if usable[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(inside[:negatives])]
    return out


def labelled(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    x = (centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, width))).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are copies of one vector
    rows = [(int(i), [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in range(n)]
    rows += [rows[10], (11, rows[12][1], 3), (9000, None, 1), (9001, rows[1][1], None), (9002, [], 1), (9003, [1.0, 2.0], 2)]
    rows += [(9004, [float("nan")] * width, 1), (9005, [None] * width, 1), (9006, [float("inf")] * width, 1), (None, rows[3][1], 2)]
    return rows + [(9050, [0.0] * width, 1), (9100, [-1.0] * width, 8)]


SCHEMA = "vec_id long, embedding array<float>, label int, rank int, place string"


@pytest.mark.parametrize("sizes", [{}, {"block": 8, "part": 60}])
def test_hard_negatives_equal_the_definition(spark, sizes):
    rows = labelled(420, 12, 3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = hard_negatives.mine(df, every=10, **sizes)
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows, every=10))


def test_hard_negatives_of_few_rows_and_large_numbers(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert hard_negatives.mine(frame([]).where("false")).count() == 0
    alone = [(50, [1.0], 1)]
    assert hard_negatives.mine(frame(alone)).collect() == []
    large = [(50, [3e4, 1.0], 1), (51, [2.9e4, 3.0], 1), (52, [2.1e4, 7.0], 2), (53, [2.2e4, -5.0], 3), (54, [4e5, 0.0], 2)]
    assert sorted(map(tuple, hard_negatives.mine(frame(large)).collect())) == sorted(mined(large))
    whole = hard_negatives.products(np.array([[2.0**40, 3.0]]), np.array([2.0**20, 5.0]), 2.0**61)
    assert whole[0] == 2**60 + 15


def test_trees_rule_out_rows_of_clusters():
    """Anchors of tight clusters share the scores of their roots."""
    rng = np.random.default_rng(1)
    centres = 4_000 * rng.normal(size=(20, 16))
    anchors = np.floor(centres[np.arange(200) % 20] + 3 * rng.normal(size=(200, 16)))
    rows = np.floor(centres[rng.integers(0, 20, 3000)] + 3 * rng.normal(size=(3000, 16)))
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    top = {}

    def found(j, at, scores):
        top[j] = max(top.get(j, -np.inf), scores.max(initial=-np.inf))

    scored = hard_negatives.walk(
        anchors[order], parent, edge, rows, lambda j, low, high: high >= max(top.get(j, -np.inf), low.max()), found
    )
    exact = anchors[order] @ rows.T
    assert all(top[j] == exact[j].max() for j in range(200))
    assert scored < 0.2 * exact.size


def plain_article(page):
    """Text of the test tables' pages, whose article is marked."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (re.sub(r"</?(?:b|br)>", " ", b) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_pages_equal_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages.withColumn("text", F.lit(1))).collect()}
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        want = plain_article(page["html"])
        assert (got[page["page_id"]]["text"], got[page["page_id"]]["n_chars"]) == (want, len(want))


LONG = "running text of an article that goes on for a while, " * 6
MENU = "".join(f"<li><a href='/{k}'>Entry {k}</a></li>" for k in range(8))
PAGES = {
    "no article element": (
        f"<body><div id='top-nav'><ul>{MENU}</ul></div><div class='col'><h1>Title</h1><p>{LONG}</p><p>Short.</p>"
        f"<p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div><div id='footer'>Imprint</div></body>",
        f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}",
    ),
    "unnamed menu": (
        f"<body><ul>{MENU}</ul><div><p>{LONG}</p><p>{LONG}</p></div><ul>{MENU}</ul></body>",
        f"{LONG.strip()}\n{LONG.strip()}",
    ),
    "notices, forms and comments": (
        f"<main><div class='cookie-notice'><p>{LONG}</p></div><article><p>{LONG}</p><form><p>Your mail</p></form>"
        f"<p>Last.</p></article><section id='comments'><p>{LONG}</p></section></main>",
        f"{LONG.strip()}\nLast.",
    ),
    "inline advert and script": (
        f"<article><p>{LONG}<span class='ad'>Buy</span> now<script>var a = '<p>x</p>';</script> then</p></article>",
        f"{LONG.strip()} now then",
    ),
    "unclosed elements": (f"<article><h1>A<p>{LONG}<p><b>bold<br>next<ul><li>one<li>two</ul>", f"A\n{LONG.strip()}\nbold next\none\ntwo"),
    "references and space": (f"<article><p>{LONG}</p><p>a&nbsp;\n\t b&lt;c&gt; &eacute;&#233; &amp d</p></article>", f"{LONG.strip()}\na b<c> éé & d"),
    "list of links in an article": (f"<article><p>{LONG}</p><ul>{MENU}</ul><p>End</p></article>", f"{LONG.strip()}\nEnd"),
    "title in the article's header": (
        f"<header><p>Site</p></header><article><header><h1>T</h1><p>by me</p></header><p>{LONG}</p></article>", f"T\n{LONG.strip()}"),
    "title before the region": (
        f"<body><div><h1>T</h1></div><div class='text'><p>{LONG}</p><p>{LONG}</p></div></body>", f"T\n{LONG.strip()}\n{LONG.strip()}"),
    "bare text": ("one  two\nthree", "one two three"),
    "only a menu": (f"<nav><ul>{MENU}</ul></nav>", ""),
    "broken markup": ("<p>a <!-- never closed", "a <!-- never closed"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


def test_ratios_are_smoothed_and_clustered():
    ratios = np.array([1.0, 1, 1, 60, 2, 70, 80, 1, 1, 1, 1])
    assert html_text.smoothed(np.ones(7)) == pytest.approx(np.ones(7))
    hit = html_text.clustered(ratios)
    assert hit[3:7].all() and not hit[[0, 1, 9, 10]].any()
    assert html_text.clustered(np.zeros(3)).all()


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (None, None, "", 1), (1, "u", "<p>x</p>", 1), (1, "u", "<p>x</p>", 1), (3, "v", "<div>" * 30_000 + "deep", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "u", "", 0), (None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1), (3, "v", "deep", 4)], key=repr
    )
    assert html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n int").where("false")).count() == 0

"""Main text, filter audit and vector codes against literal pages and brute force."""

import hashlib
import html
import math
import random
import re
import time
from collections import Counter
from itertools import permutations

import pytest

from stagecraft.llm import filteraudit, htmltext, veccodes
from stagecraft.llm import queries as Q

SF = "/root/testdata/sf0.001"
LINE = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor. "
PAGES = {
    "<html><head><title>T &amp; x</title><style>a{}</style><script>if(a<b){'<p>x</p>'}</script></head><body class='has-sidebar'>"
    "<header class='site-header'><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id='cookie-notice'>We use cookies, please accept them.</div>"
    f"<main><article><header><h1>Head &lt;one&gt;</h1></header><p>{LINE * 3}<a href=x>link</a> more.</p><h2>Sub</h2><ul><li>one<li>two</ul>"
    "<table><tr><td>a<td>b</table><blockquote>Quote.</blockquote><div class='ad'>Buy now, please.</div><aside>Aside.</aside>"
    f"<p>End&nbsp;&nbsp;of\n it.</p><div class='share-buttons'><a>Tweet</a></div></article><section class='related'><p>{LINE}</p></section></main>"
    f"<div class='sidebar'><p>{LINE * 2}</p></div><section id='comments'><article class='comment'><p>{LINE * 9}</p></article>"
    "<form><textarea>x</textarea><button>Send</button></form></section><footer>&copy; 2020</footer></body></html>":
        f"Head <one>\n{LINE * 3}link more.\nSub\none\ntwo\na\nb\nQuote.\nEnd of it.",
    f"<body><div><a href=1>Home</a> <a href=2>About</a></div><div><h1>Title</h1><p>{LINE * 4}</p><p>Short.</p></div></body>": f"Title\n{LINE * 4}".strip() + "\nShort.",
    "hello &lt;world&gt;  x\n y": "hello <world> x y",
    f"<form id=f><div role=main><p>{LINE * 3}</p><p>Two.</p></div><div><p>Out.</p></div></form>": f"{LINE * 3}".strip() + "\nTwo.",
    f"<p>{LINE * 3}</p><form><p>Your name, please:</p><input><label>Mail</label></form>": f"{LINE * 3}".strip(),
    "": "", "<nav>a</nav>": "", "<p>  </p>": "",
    "<article><p>Abc def.</p><p>cut off <a hre": "Abc def.\ncut off",
    "<p>3 < 4 and 5 > 2 <b>bold</b> x<br>y</p>": "3 < 4 and 5 > 2 bold x y",
    "<p><![CDATA[a &amp; b]]></p><p>c<!-- <p>no</p> -->d</p>": "a &amp; b\ncd",
    "<article><p><b>Bold.<br><p>Next.</p></article>": "Bold.\nNext.",
}


def test_pages():
    for source, text in PAGES.items():
        assert htmltext.main_text(source) == text


def test_pages_of_any_shape_take_linear_time():
    shapes = ["<div>" * 20000 + "x", "<p>a" * 20000, "<ul><li>x" * 10000, "</div>" * 20000 + "x", "<a \"" * 20000 + ">x", "<" * 20000,
              "<b>" * 20000 + "x" + "</i>" * 20000, "<!--" * 20000, "<article><h1>a" * 10000, "".join(f"<x{i}>a</x{i}>" for i in range(20000))]
    for s in shapes:
        t = time.time()
        htmltext.main_text(s)
        assert time.time() - t < 5, s[:20]


def test_main_text_of_given_pages(spark):
    """The article of the given pages, by patterns that hold for them only."""
    rows = {r.page_id: r for r in Q.queries()["op11_main_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside))
        text = "\n".join(b for b in blocks if b)
        assert (rows[p.page_id].url, rows[p.page_id].text, rows[p.page_id].n_chars) == (p.url, text, len(text))


def test_main_text_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "t", 1), (None, None, "<p>Some text.</p>", None, None), (2, "u", "<p>Some text.</p>", "t", 1), (2, "u", "<p>Some text.</p>", "t", 1)]
    got = htmltext.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "", 0), (None, None, "Some text.", 10), (2, "u", "Some text.", 10), (2, "u", "Some text.", 10)], key=str)
    assert htmltext.extract(spark.createDataFrame([], schema)).collect() == []


def audited(docs, labels):
    """{(part, order, step): figures} document by document."""
    first, out = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    flags = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and first[t] < i}
        own = [x for x in labels if x[0] == i and i is not None]
        flags.append((part or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    shapley = Counter()
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = [d for d in own if d[1][f]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(d[1].values()) == 1 for d in failing),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("cells", [filteraudit.MAX_CELLS, 1 << 16])
def test_filter_audit(spark, cells, monkeypatch):
    rng = random.Random(3)
    words = lambda n, m: " ".join(f"w{rng.randrange(m)}" for _ in range(n))
    texts = [None, "", " ", "A B", words(100, 10**6), words(120, 50), words(99, 10**6), "x # y", "É" * 10, "ABC" * 9, words(30000, 10**9)]
    docs = [(i if i % 7 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)] + [(3, "x # y", "en"), (3, "x # y", "en"), (3, "other", "en")]
    docs += [(1000 + i, words(110, 10**6), "fr") for i in range(40)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(2, 1, 1), (None, 1, 1), (9999, 1, 1)]
    clash = "doc_id long, text string, lang string, part string, h long, mask int, n long, good int, quality int"
    frame = spark.createDataFrame([(*d, "p", 1, 1, 1, 1, 1) for d in docs], clash).repartition(5)
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    if cells == 1 << 16:  # a sketch that is full clears nothing and loses nothing
        monkeypatch.setattr(filteraudit, "cells_of", lambda h, n: filteraudit.np.tile(filteraudit.np.arange(4)[:, None], (1, len(h))))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filteraudit.filter_audit(frame, marks, most_cells=cells).collect()}
    assert got == audited(docs, labels)
    assert filteraudit.filter_audit(frame.limit(0), marks).collect() == []


def test_sketch_clears_only_unique_texts(spark):
    hashes = spark.range(3000).selectExpr("xxhash64(id % 2500) AS h")
    cells = filteraudit.sketch_cells(3000)
    again = filteraudit.np.frombuffer(filteraudit.merged_sketch(hashes.repartition(7), cells), filteraudit.np.uint8)
    n = Counter(r.h for r in hashes.collect())
    at = filteraudit.cells_of(filteraudit.np.array(list(n)), cells)
    maybe = ((again[at >> 3] >> (7 - (at & 7)).astype("uint8")) & 1).all(axis=0)
    assert all(m for m, c in zip(maybe, n.values()) if c > 1)
    assert sum(m for m, c in zip(maybe, n.values()) if c == 1) < 200


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd with full scans over exact integers."""
    kept = sorted(((i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows
                   if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min((dist(c[p], e), k) for k, e in enumerate(book[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = near()
        for p in range(parts):
            for k in range(len(book[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if own:
                    book[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = near()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] += e
    text = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[lab], text) for (i, _, lab), f, e in zip(kept, found, errors))


def test_vector_codes_of_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(map(tuple, Q.queries()["op13_vector_codes"](spark, SF).collect())) == lloyd(rows)


def test_vector_codes_of_odd_rows(spark):
    rng = random.Random(8)
    grid = lambda: [rng.randrange(-3, 4) / 4096 * rng.choice([1, 1, 0.5]) for _ in range(16)]  # noqa: E731  many ties
    rows = [(i, grid(), rng.choice([1, 2, None])) for i in range(200)] + [(i, rows_v, 1) for i, rows_v in [(300, [0.0] * 16), (301, [0.0] * 16), (None, [1.5] * 16)]]
    bad = [(-5, None, 1), (-4, [None] + [0.0] * 15, 1), (-3, [float("nan")] * 16, 2), (-2, [0.0] * 15 + [float("-inf")], 1), (900, [0.0] * 8, 1), (901, [], 2)]
    schema = "vec_id long, embedding array<float>, label int, code string, x string, sums string, error long, v string"
    frame = spark.createDataFrame([(*r, "c", "x", "s", 1, "v") for r in rows + bad], schema).repartition(6)
    assert Counter(map(tuple, veccodes.vector_codes(frame).collect())) == lloyd(rows)
    few = [(2, [0.5] * 16, None), (1, [-0.5] * 16, 3), (2, [0.5] * 16, None)]
    frame = spark.createDataFrame([(*r, "c", "x", "s", 1, "v") for r in few], schema)
    assert Counter(map(tuple, veccodes.vector_codes(frame).collect())) == lloyd(few)
    assert veccodes.vector_codes(frame.limit(0)).collect() == []


def test_active_entries_equal_full_scans():
    np = veccodes.np
    rng = np.random.default_rng(4)
    x = rng.integers(-4, 5, (500, 2, 3))
    book = rng.integers(-4, 5, (2, 9, 3))
    code, dist = np.zeros((500, 2), np.uint8), np.zeros((500, 2), np.int64)
    veccodes.assign(x, book, None, code, dist)
    for _ in range(30):
        new = book.copy()
        at = rng.random((2, 9)) < 0.3
        new[at] = rng.integers(-4, 5, (int(at.sum()), 3))
        veccodes.assign(x, new, (new != book).any(axis=2), code, dist)
        book = new
        full_code, full_dist = np.zeros((500, 2), np.uint8), np.zeros((500, 2), np.int64)
        veccodes.assign(x, book, None, full_code, full_dist)
        assert (code == full_code).all() and (dist == full_dist).all()

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from airsift.llm import extraction, neighbours, queries, urls
from airsift.llm.queries import URL_RULES


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a.net/x": ("", "", None, "allow"),
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "http://x.example.com/de/porn": ("x.example.com", "/de/porn", "example.com/de/", "block"),
        "http://q.org?porn": ("q.org", "", None, "block"),
        "http://q.org/fr/porn": ("q.org", "/fr/porn", "org/fr/", "allow"),
        "http://q.org/pornography": ("q.org", "/pornography", None, "allow"),
        "http://q.org/casino/casino": ("q.org", "/casino/casino", None, "allow"),
        "http://q.org/casino-poker": ("q.org", "/casino-poker", None, "block"),
        "http://q.org/" + "z" * 100_000: ("q.org", "/" + "z" * 100_000, None, "allow"),
    }
    pages = spark.createDataFrame([(u, "keep", 1) for u in cases], "url string, host string, extra int")
    pages = pages.union(pages)
    rows = urls.filter_urls(pages, URL_RULES).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r.url
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0


PAGE = """<html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home page</a></li></ul></nav><!-- note <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b><br>text.<p>Second&nbsp;one<script>var a="<p>x";</script></p>
<aside>Side</aside><form><input><button>Send</button></form><p>Last</p>
<section id="comments"><p>A reader said</p></section></article><footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    want = "Head & line\nFirst bold text.\nSecond one\nLast"
    assert extraction.extract(PAGE) == want
    body = "".join(f"<div>{'long words of an article ' * 6}{i}</div>" for i in range(4))
    bare = f"<div><a href=x>Menu one</a></div><div><a href=y>Menu two</a></div>{body}<div><a href=z>More</a></div>"
    assert extraction.extract(bare).split("\n") == [("long words of an article " * 6 + str(i)) for i in range(4)]
    assert extraction.extract("<nav>open <article><p>kept") == "kept"
    assert extraction.extract("a < b <!-- open") == "a < b"
    assert extraction.extract("&am</p>&a") == "&am\n&a"
    rows = [(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<p>" + "y " * 300_000, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    found = sorted((r.page_id, r.n_chars, r.text[:9]) for r in extraction.main_text(pages).collect())
    assert found == [(1, len(want), "Head & li")] * 2 + [(2, 0, ""), (3, 0, ""), (4, 599_999, "y y y y y")]
    assert extraction.main_text(pages.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 16))
    vectors = (centres[rng.integers(0, 8, 400)] + 0.3 * rng.standard_normal((400, 16))) * rng.uniform(0.5, 2, (400, 1))
    vectors = vectors.astype(np.float32)
    vectors[100:160] = vectors[100]  # a group of copies
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(7, vectors[7].tolist(), "again"), (500, None, "x"), (520, [], "x"), (540, [0.0] * 16, "x")]
    rows += [(560, [float("nan")] * 16, "x"), (580, [1.0, None], "x"), (None, vectors[3].tolist(), "x")]
    rows += [(600, [1.0, 2.0], "other length"), (601, [2.0, 1.0], "other length")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    asks = F.col("vec_id") % 20 == 0
    found = neighbours.nearest_neighbours(frame, asks).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {*range(0, 400, 20), 600}
    assert [(r.vec_id, r["rank"]) for r in by[600]] == [(601, 1)]
    wide, hit = vectors.astype(float), 0
    for q in range(0, 400, 20):
        score = (wide * wide[q]).sum(1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(400), -score))[:20]
        got = by[q]
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hit += len({r.vec_id for r in got} & set(want.tolist()))
    assert hit >= 0.9 * 20 * 20
    assert neighbours.nearest_neighbours(frame.limit(0), asks).count() == 0
    # Buckets cut into small parts of vectors and of queries lose and repeat nothing.
    cut = neighbours.nearest_neighbours(frame, asks, tables=neighbours.Tables(part=30, asked=5))
    assert sorted(cut.collect()) == sorted(found)


def test_extraction_keeps_whole_articles():
    said = [f"{'long words of an article ' * 6}{i}" for i in range(4)]
    body = "".join(f"<p>{x}</p>" for x in said)
    # Words inside a name, wrappers of the whole page, and marked articles of such a class.
    for attrs in (
        'class="content no-sidebar"',
        'class="has-comments"',
        'class="post-share-enabled"',
        'class="with-sidebar"',
        'class="sidebar"',
        'role=main class="sidebar"',
        'itemprop=articleBody class="widget"',
    ):
        page = f"<body><nav>Menu</nav><div {attrs}>{body}</div></body>"
        assert extraction.extract(page).split("\n") == said, attrs
    aside = f'<div class="sidebar-left">Our other papers</div><article>{body}</article>'
    assert extraction.extract(aside).split("\n") == said
    many = f'<article>{body}<div class="comment-list">{"<p>A reader said so</p>" * 90}</div></article>'
    assert extraction.extract(many).split("\n") == said
    # Elements that end without an end tag.
    for page, want in {
        '<article><p class="notice">Note<p>One</p><p>Two</p></article>': "One\nTwo",
        '<article><ul><li class="ad">Buy<ul><li>x<li>y</ul><li>One<li>Two</ul><p>End</article>': "One\nTwo\nEnd",
        '<article>Top<ul><li class="ad">Buy</ul><p>End</p></article>': "Top\nEnd",
        '<article><table><tr><td class="ad">Buy<td>A<tr><td>B</table></article>': "A\nB",
        '<article><dl><dt class="ad">Buy<dd>D</dl><p>End</p></article>': "D\nEnd",
    }.items():
        assert extraction.extract(page) == want, page


def test_neighbours_of_small_tables_skewed_norms_and_ties(spark):
    rng = np.random.default_rng(6)
    kind = "vec_id bigint, embedding array<double>"
    rows = []
    for dims, n in ((8, 5), (9, 12), (10, 21)):  # small tables, one per length
        rows += [(100 * dims + i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, dims)))]
    sizes = {800: 5, 900: 12, 1000: 21}
    # One long vector among many short ones, and ties beyond k.
    short = rng.standard_normal((600, 64))
    short /= np.linalg.norm(short, axis=1, keepdims=True)
    short[0] *= 100
    rows += [(10_000 + i, v.tolist()) for i, v in enumerate(short)]
    rows += [(20_000 + i, [1.0, float(i % 60)] + [0.0] * 10) for i in range(60)]
    rows += [(30_000, [1.0] + [0.0] * 11)]
    frame = spark.createDataFrame(rows, kind)
    asks = F.col("vec_id").isin(*sizes, 30_000) | (F.col("vec_id").between(10_000, 10_599) & (F.col("vec_id") % 20 == 0))
    by = {}
    for r in neighbours.nearest_neighbours(frame, asks).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    for query, n in sizes.items():
        assert len(by[query]) == min(20, n - 1), query
    hit = 0
    for q in range(0, 600, 20):
        score = short @ short[q]
        score[q] = -np.inf
        hit += len(by[10_000 + q] & {10_000 + int(i) for i in np.argsort(-score)[:20]})
    assert hit >= 0.9 * 30 * 20
    every = neighbours.Tables(width=1e9)  # one bucket: all are compared
    tied = neighbours.nearest_neighbours(frame.where("vec_id >= 20000"), F.col("vec_id") == 30_000, tables=every)
    assert sorted(r.vec_id for r in tied.collect()) == list(range(20_000, 20_020))


def test_neighbours_of_very_small_and_large_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((500, 16))
    sizes = np.ones(500)
    sizes[:100], sizes[100:200], sizes[200:210] = 1e-200, 1e150, 1e-320
    vectors = base * sizes[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, [1e-200] * 4), (901, [1e200] * 4), (902, [-1e200, 1e200, 0.0, 1.0]), (903, [5e-324, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asks = F.col("vec_id") % 20 == 0
    by = {}
    for r in neighbours.nearest_neighbours(frame, asks | F.col("vec_id").between(900, 903)).collect():
        by.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert by[900][901] == 4.0 and by[901][902] == -np.inf and len(by[903]) == 3
    hit = 0
    for q in range(0, 500, 20):
        exact = (vectors * vectors[q]).sum(1)
        exact[q] = -np.inf
        best = np.lexsort((np.arange(500), -exact))[:20]
        assert len(by[q]) == 20 and all(by[q][i] == exact[i] or abs(by[q][i] - exact[i]) <= 1e-9 * abs(exact[i]) for i in by[q])
        # Products that underflow to nothing tie; any of them will do.
        hit += sum(by[q].get(i) is not None or exact[i] == 0 for i in best.tolist())
    assert hit >= 0.9 * 25 * 20


# Written without a look at the vocabulary.
SPAM_URLS = """
http://www.bestcasino.example/online-casino-bonus
http://win-big.example/jackpots/slots
https://loans4u.example/payday-loans/instant-cash
http://rx.example/buy/cheap-viagra-online
http://shop.example/replica-rolex-watches
http://hot.example/nude-webcams/
http://dl.example/photoshop-crack-serial
http://seo.example/cheap-backlinks
http://free-bets.example/
http://cheap-pills.example/x
http://m.casino-win.example/en/4033.html
http://q.example/free-xxx-videos
http://poker.example/roulette
https://meet.example/sexy-singles
http://essay.example/cheap-essays
""".split()
CLEAN_URLS = """
https://www.example.org/news/2024/05/city-council-votes-on-budget
https://university.example/courses/statistics/lecture-12.html
https://docs.example.net/spark/latest/sql-ref-functions.html
https://en.example.org/wiki/History_of_mathematics
https://health.example/articles/how-vaccines-work
https://shop.example/garden/hoses?color=green&size=20m
https://travel.example/italy/rome/where-to-stay
https://code.example/project/issues/4127#comment-3
https://recipes.example/hot-chocolate-with-cream
https://library.example/books/free-lending-program
https://sussex.example/essex/middlesex-county-map
https://weather.example/forecast/tomorrow.html
https://press.example/scunthorpe-united-win-again
""".split()


def test_vocabulary_on_written_urls(spark):
    words = urls.Vocabulary()
    assert all(words.limit / 2 <= w < words.limit for w in words.soft.values()) and len(words.soft) > 140
    listed = spark.createDataFrame([(u,) for u in SPAM_URLS + CLEAN_URLS], "url string")
    found = {r.url: r.verdict for r in urls.filter_urls(listed).collect()}
    assert [u for u in SPAM_URLS if found[u] != "block"] == []
    assert [u for u in CLEAN_URLS if found[u] != "allow"] == []
    # Forms of one term are one hit, and a term inside a word is none.
    terms = urls.Terms(words)
    assert terms.judge("http://a.b/casino/casinos")[:2] == (0, 1) and not terms.judge("http://a.b/casino/casinos")[3]
    assert terms.judge("http://a.b/Free/lotteries")[1:] == (2, 2.5, True)
    assert terms.judge("http://freecasino.b/xbet")[:2] == (0, 0)
    assert urls.Terms(urls.Vocabulary((), {})).judge("http://casino.b/xxx") == (0, 0, 0.0, False)


def test_vocabulary_rejects_given_pages(spark):
    pages = queries.table(spark, "/root/testdata/sf0.1", "pages").select("url")
    found = urls.filter_urls(pages).where("verdict = 'block'").select("url").collect()
    hosts = {r.url.split("/")[2] for r in found}
    assert found and all(any(w in h for w in ("casino", "bets", "pills", "adult", "ads", "spam", "farm")) for h in hosts)

import math
import time
from collections import Counter, defaultdict

import pytest

from corpuslens.llm import queries, site_style
from corpuslens.llm.common import bounded_batches

FRAME = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a>About</a></ul></nav><div id="cookie-bar">We use cookies</div><!-- note <p>x</p> -->
<div class="ad">Buy {n}</div><form><p>Search</p><input></form>{main}<aside>Side {n}</aside><section class="comments"><h2>Comments</h2><article class="comment"><p>First!</p></article></section>
<footer>&copy; site</footer></body></html>"""


def test_keeps_the_article_only():
    page = FRAME.format(n=1, main="<article><header><h1>Ti&eacute;tle  &amp; co</h1></header><p>One <b>bold</b>\n two<br>three<p>Next &lt;p&gt;<ul><li>a<li>b</ul><div class='share'>Share</div><table><tr><td>x<td>y</table></article>")
    assert site_style.Page(page).text(set()) == "Tiétle & co\nOne bold two three\nNext <p>\na\nb\nx\ny"


def test_broken_and_odd_mark_up():
    for h, want in [("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("a < b", "a < b"), ("<p title=\"x>y\">q</p>", "q"), ("<p title=\"open>q</p>", "q"), ("<script>never closed", ""), ("<div><b>x</div>y", "x\ny"), ("</p></div>z", "z"), ("&#x41;&nbsp;B&notareference;", "A B¬areference;"), ("<p>a<!-- open", "a"), ("<div hidden>x</div><p style='display: none'>y</p>z", "z"), ("<p>" + "deep <div>" * 500, "deep\n" * 500)]:
        assert site_style.Page(h).text(set()) == want.strip()


def test_what_only_looks_like_a_mark_stays():
    for h, want in [
        ("<p title='the hidden gem'>a</p>", "a"),
        ("<p class='social history'>a</p>", "a"),
        ("<section class='related-work'><p>a</p></section>", "a"),
        ("<div class='post-content main'>a</div><div class='related-posts'>b</div><div id='comment-form-area'>c</div>", "a"),
        ("<p>so <math><mi>x</mi></math> is</p>", "so x is"),
        ("<p>Use the <button>Enter</button> key <svg><text>no</text></svg>now</p>", "Use the Enter key now"),
        ("<p>a <span hidden>b</span>c <em aria-hidden=true>d</em></p>", "a c"),
        ("<main><p>before the card</p><article><h2>card</h2></article><p>and after it</p></main>", "before the card\ncard\nand after it"),
        ("<div><p>A long story that fills the page.</p></div><article>card</article>", "A long story that fills the page.\ncard"),
        ("<div>teaser</div><article><header>Title</header><p>A long story that fills the page.</p></article>", "Title\nA long story that fills the page."),
    ]:
        assert site_style.Page(h).text() == want, h


def test_the_tree_alone_removes_unmarked_frames(spark):
    """Links that differ from page to page, and texts that repeat, go without any mark; stories stay."""
    def page(i):
        links = "".join(f"<li><a href='/{i}{k}'>topic {i * 7 + k}</a></li>" for k in range(6))
        story = "".join(f"<p>Sentence {i * 31 + k} of the story.</p>" for k in range(2 + i % 5))
        return f"<body><div class='a'><ul>{links}</ul></div><div class='b'><h2>Story {i}</h2>{story}<p>See <a href='/x'>this page {i}</a></p></div><div class='c'>All rights with the site</div></body>"

    df = spark.createDataFrame([(i, "http://h/%d" % i, page(i)) for i in range(12)], "page_id long, url string, html string")
    for marks in (True, False):
        for r in site_style.extract(df, marks=marks).collect():
            assert r.text.startswith(f"Story {r.page_id}\nSentence") and r.text.endswith(f"See this page {r.page_id}")
    links_only = [b for b in site_style.Page(page(1)).blocks if b.linked == len(b.text)]
    assert len(links_only) == 6


def test_the_tree_alone_removes_menus_of_the_query_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    df = spark.createDataFrame([(r.page_id, "http://one.host/", r.html) for r in pages], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in site_style.extract(df, marks=False).collect()}
    menus = {r.page_id: [b.text for b in site_style.Page(r.html, marks=False).blocks if b.linked and b.linked == len(b.text)] for r in pages}
    assert all(menus.values())
    for i, links in menus.items():
        assert "\n".join(links) not in out[i]


@pytest.mark.parametrize("html", ["<a " * 1_700_000, '<a title="x ' * 400_000, "<a '> \" " * 500_000, '<a "> " ' * 600_000, "<b>" * 500_000 + "</i>" * 500_000, "<div>" * 100_000, "<div><p>x" * 100_000, "<ul><li><ul>" + "<b>" * 100_000 + "<li>x</li>" * 100_000, "<" * 3_000_000, "<script>" * 600_000, "<!-- " * 1_000_000])
def test_broken_pages_of_any_size_take_linear_time(html):
    began = time.time()
    page = site_style.Page(html)
    page.text({1})
    assert sum(1 for _ in page.features()) < 10_000
    assert time.time() - began < 60  # seconds here, hours if it were quadratic


def pages_without_mark_up(n=12):
    return [(i, "http://h.example/%d" % i, f"<html><body><div class='top'>Same words everywhere</div><div class='box'><p>Story {i} begins</p><p>and goes {i * 7} on</p></div><div class='end'>All the same</div></body></html>") for i in range(n)]


def test_repeated_branches_go(spark):
    bounded_batches(spark)
    rows = pages_without_mark_up() + [(50, "http://other/", pages_without_mark_up()[0][2]), (51, None, None), (52, "http://h.example/", ""), (3, "http://h.example/3", pages_without_mark_up()[3][2])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, host string")
    for bound in (200_000, 0):
        out = {r.page_id: r for r in site_style.extract(df, broadcast_nodes=bound).collect()}
        assert out[5].text == "Story 5 begins\nand goes 35 on" and out[5].n_chars == len(out[5].text)
        assert "Same words everywhere" in out[50].text  # a single page says nothing about its site
        assert out[51].text == "" and out[52].text == ""
    assert site_style.extract(df).count() == len(rows)
    assert site_style.extract(df.limit(0)).count() == 0


def test_a_site_of_copies_is_kept(spark):
    html = "<body><div><p>The same article on every page.</p></div></body>"
    df = spark.createDataFrame([(i, "http://c/", html) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in site_style.extract(df).collect()} == {"The same article on every page."}


def brute_importance(htmls):
    styles, texts, size, linked = defaultdict(list), defaultdict(lambda: defaultdict(set)), Counter(), Counter()
    for i, h in enumerate(htmls):
        p = site_style.Page(h)
        for node, kind, feature, _ in p.features():
            if kind == 0:
                styles[node].append(feature)
        for b in p.blocks:
            for n in p.chain(b.node):
                texts[n][b.node, b.text].add(i)
                size[n] += len(b.text)
                linked[n] += b.linked if b.inside == 0 else 0
    out = {}
    for n, s in styles.items():
        m, kinds = len(s), set(s)
        pres = -sum(s.count(k) / m * math.log(s.count(k) / m, m) for k in kinds) if m > 1 else 1.0
        own = texts[n]
        cont = max(0.0, 1 - sum(math.log(len(x)) for x in own.values()) / len(own) / math.log(m)) * (1 - linked[n] / size[n]) if own and m > 1 else 1.0
        g = 0.9 ** len(kinds)
        out[n] = (1 - g) * pres + g * cont
    return out


def test_importance_matches_brute_force(spark):
    htmls = [r[2] for r in pages_without_mark_up()] + [FRAME.format(n=i % 2, main="<article><p>x</p></article>" * i) for i in range(5)]
    df = spark.createDataFrame([(1, h) for h in htmls], "host long, html string").repartition(3)
    got = {r.node: r.importance for r in site_style.importance(df).collect()}
    want = brute_importance(htmls)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_query_matches_a_plain_reading(spark, small):
    """The generated pages have one article of headings and paragraphs, read here by another parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.runs = 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.runs += [[]] if tag in ("p", "h1", "h2", "ul", "li", "div") else []
            self.runs[-1] += [" "] if tag == "br" else []

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.runs += [[]] if tag in ("p", "h1", "h2", "ul", "li", "div") else []

        def handle_data(self, data):
            self.runs[-1] += [data] if self.depth else []

    out = {r.page_id: r.text for r in queries.op1_site_style_tree(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        reader = Article()
        reader.feed(r.html)
        reader.close()
        texts = [" ".join("".join(x).split()) for x in reader.runs]
        assert out[r.page_id] == "\n".join(t for t in texts if t)


def test_query_returns_every_page(spark, small):
    out = queries.op1_site_style_tree(spark, small).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(out) == len(pages)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) > 0 for r in out)

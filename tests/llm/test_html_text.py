from __future__ import annotations

import pytest

from fretwork.llm import html_text as ht

SCHEMA = "page_id long, url string, html string, host string, marks int"


def text_of(page):
    return ht.main_text(ht.parse(page))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("no tags &amp; all", "no tags & all"),
        ("<p>a<p>b <b>c</b>d<br>e", "a b cd e"),
        ("<article><h1>T</h1><p><b>one<br><p>two</p></article><footer>f</footer>", "T one two"),
        ("<nav>m</nav><header>h</header><article><header><h1>T</h1></header>x<footer>by</footer></article><aside>s</aside>", "T x"),
        ("<article>a<script>var t='</p>';if(a<b){}</script><style>p{}</style>b</article>", "ab"),
        ("<article>a<div class='ad slot-3'>buy</div><section id=comments><p>me</p></section><form>q<input>r</form>z</article>", "a z"),
        ("<body class='with-sidebar'><div class='content with-sidebar'>text</div><div class=sidebar>x</div></body>", "text"),
        ("<main>m <div role=navigation>n</div><p hidden>h</p><p style='display: none'>i</p></main>other", "m"),
        ("<article>1 &lt; 2 &eacute;&#233;&#xe9; &nbsp; x < y <3</article>", "1 < 2 ééé x < y <3"),
        ("<!-- <p>gone</p> --><ARTICLE>Up<!-- x -->per</ARTICLE><!doctype html>", "Upper"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>", "a b c d e"),
        ("<article><p>cut off <a href='x", "cut off <a href='x"),
        ("<div><article>one</article><article class=comment>no</article><article>two</article></div>", "one two"),
        ("</div></p><article>a</span>b</article></article>", "ab"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
        ("<article><a title='x > y' href=\"a'b\">in</a>line</article>", "inline"),
        ("<article>a<div class='sponsored-content'>b</div><ol class='commentlist'>c</ol><p class='lead-text post'>d</p></article>", "a d"),
        ("<title>head only</title><script>never closed", ""),
    ],
)
def test_main_text(page, want):
    assert text_of(page) == want


def test_long_and_odd_pages_end():
    assert len(text_of("<article>" + "<p>word \"'< " * 200_000)) > 1_000_000
    assert text_of("<" * 50_000 + "a " + "\"'" * 50_000)


def test_odd_pages_take_linear_time():
    """Stray end tags below many open elements, and quotes and tags that never close: eight times the page is not 64 times the work."""
    import time

    for made in (lambda k: "<div>" * k + "</b>" * k, lambda k: '<a b="' * k, lambda k: "<p><span>" * k + "</i>" * k, lambda k: "<li><b>" * k, lambda k: "< " * k + "<!x"):
        times = []
        for k in (4000, 32000):
            started = time.process_time()
            ht.parse(made(k))
            times.append(time.process_time() - started)
        assert times[1] < 24 * max(times[0], 0.02)


def test_what_never_closes():
    assert text_of("a<b c=d") == "a<b c=d" and text_of("a > b < c <!-- x") == "a > b < c" and text_of('t<a b="<i>x</i>" c') == 'tx" c'


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def result(spark, rows, **kwargs):
    return {r.page_id: r.text for r in ht.extract(pages_of(spark, rows), **kwargs).collect()}


def test_site_templates(spark):
    """Subtrees that recur on a host go there, and only there; copies of one article do not make a template."""
    box = "<div class=x17>Best <b>site</b> of all</div>"
    rows = [(i, f"http://A.example/{i}", f"<body>{box}<div><p>own {i}</p><p>often</p></div></body>") for i in range(12)]
    rows += [(100 + i, "https://b.example/", f"<body>{box}<p>same article</p></body>") for i in range(30)]
    rows += [(200 + i, None, f"<body>{box}<p>p{i}</p></body>") for i in range(12)]
    rows += [(300 + i, "http://c.example", f"<body>{box if i < 7 else ''}<p>p{i}</p></body>") for i in range(20)]
    got = result(spark, rows)
    assert all(got[i] == f"own {i}" for i in range(12))
    assert all(got[100 + i] == "Best site of all same article" for i in range(30))
    assert got[200] == "Best site of all p0" and got[300] == "Best site of all p0"
    kept = ht.extract(pages_of(spark, rows), share=0.3, least=5).where("page_id = 300").first()
    assert kept.text == "p0" and kept.url == "http://c.example"


def test_templates_of_small_hosts(spark):
    """With three to nine pages a subtree must stand on all of them; with fewer there are no templates."""
    box = "<div class=x17>Best site</div>"
    rows = [(10 * n + i, f"http://h{n}.example/", f"<body>{box}{'<i>most</i>' if i else ''}<p>own {i}</p></body>") for n in (2, 3, 9) for i in range(n)]
    got = result(spark, rows)
    assert got[20] == "Best site own 0"
    assert [got[30 + i] for i in range(3)] == ["own 0", "most own 1", "most own 2"] and got[98] == "most own 8"


def test_counts_equal_brute_force(spark):
    rows = [(i, f"http://h{i % 3}.example/", f"<div>{i % 4}</div><p>t{i % 11}</p><i>all</i>") for i in range(90)]
    seen, pages = {}, {}
    for _, url, page in rows:
        elements = ht.parse(page)
        ht.mark(elements)
        text = ht.main_text(elements)
        pages.setdefault(url, set()).add(text)
        for e in elements[1:]:
            seen.setdefault((url, e.mark), set()).add(text)
    want = {(url[7:-1], m) for (url, m), texts in seen.items() if len(texts) >= max(5, 0.2 * len(pages[url]))}
    found = ht.templates(pages_of(spark, rows), 0.2, 5).collect()
    assert {(r.host, m) for r in found for m in r.marks} == want and want


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, None), (1, None, None), (None, "x", "<p>a"), (2, "http://", "")]
    got = [tuple(r) for r in ht.extract(pages_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, None, ""), (1, None, ""), (None, "x", "a"), (2, "http://", "")], key=str)
    assert ht.extract(pages_of(spark, [])).count() == 0


def test_given_pages(spark):
    """On the given pages the text is what stands between the article tags."""
    import html
    import re

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = ht.query(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        plain = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", inner))).split())
        assert r.text == plain and r.n_chars == len(plain)

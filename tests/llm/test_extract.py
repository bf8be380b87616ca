import re
from html import unescape

import pytest

from tensorframe.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="post-17"><h1>Title &amp; more</h1><p>First   paragraph&nbsp;is
here, with <a href=x>a link</a> and <b>bold<br>text.<p>Second one 3 < 4 &lt;b&gt; ok.<!-- gone --><ul><li>one<li>two</ul>
<div class="ad-slot">Buy now</div><form><input value=x>Your name</form><table><tr><td>a<td>b</tr><tr><td>c</table></div>
<div class="sidebar">Other stories</div><section id="comments"><p>Nice article, I think, and a long comment it is.</p></section></div>
<footer>&copy; x</footer></body></html>"""
WANT = "Title & more\n\nFirst paragraph is here, with a link and bold text.\n\nSecond one 3 < 4 <b> ok.\n\none\n\ntwo\n\na b\n\nc"


def test_page():
    assert extract.read_page(PAGE, None) == WANT
    best, _ = extract.best_container(extract.parse(PAGE))
    assert extract.path(best) == "html>body.has-sidebar>div"
    assert extract.path(extract.best_container(extract.parse(PAGE.replace("Other stories", "<p>unrelated text</p>" * 4).replace("sidebar", "side")))[0]) == "html>body.has-side>div>div.post-#"


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>a<p>b", "a\n\nb"),
        ("<article><p>x</article><!-- open", "x"),
        ("<p>x</p><script>never closed", "x"),
        ("<body><p>a &#233; &unknown; &amp;amp;</p><a href='", "a é &unknown; &amp;"),
        ("<article><header><h1>T</h1></header><p>x</p></article>", "T\n\nx"),
        ("<nav>menu</nav>", ""),
        ("<div class='post'><div class='entry-header'><h1>T</h1></div><p>x</p></div>", "T\n\nx"),
        ("<div class='site-header'>My site</div><div class='post'><p>x</p></div>", "x"),
    ],
)
def test_odd_pages(html, text):
    assert extract.read_page(html, None) == text


ARTICLE = "<h1>Title</h1><p>" + "An article of some length, in words. " * 8 + "</p>"
READ = "Title\n\n" + ("An article of some length, in words. " * 8).strip()


@pytest.mark.parametrize("name", ["content with-sidebar", "post has-comments", "entry ad-free", "no-sidebar", "layout-nav-left", "article-share-enabled", "post", "related-work", "search-result", "disclaimer", "lead ad_free", "hasComments"])
def test_names_that_only_mention_noise(name):
    page = f"<body><nav>Home</nav><div class='{name}'>{ARTICLE}</div><footer>end</footer></body>"
    assert extract.read_page(page, None) == READ
    assert extract.read_page(page.replace("class", "id"), None) == READ


@pytest.mark.parametrize("name", ["ad", "ads", "ad-slot", "site-footer", "cookie-notice", "comments-area", "commentlist", "left-sidebar", "mainMenu", "nav_bar sidebar", "sidebar-2", "adsense top", "page-header"])
def test_names_of_noise(name):
    assert extract.read_page(f"<body><div class='x'>{ARTICLE}<div class='{name}'>Buy this or else, now</div></div></body>", None) == READ


def test_element_with_the_article_stays():
    assert extract.read_page(f"<form id=aspnet>{ARTICLE}<input value=x></form>", None) == READ
    assert extract.read_page(f"<div class='notice'><article>{ARTICLE}</article></div><p>small</p>", None) == READ
    assert extract.read_page(f"<div id=comments><p>{'all there is on the page ' * 20}</p></div>", None) == ("all there is on the page " * 20).strip()
    long = "<p>" + "A comment longer than the article. " * 100 + "</p>"
    assert extract.read_page(f"<div>{ARTICLE}</div><section id=comments>{long}</section>", None) == READ


def test_nothing_else_is_dropped():
    inner = "<div hidden>a</div><dialog open>b</dialog><video>c</video> <object>d</object> <audio>e</audio><div class=related>f</div><div class='search'>g</div><div class=pager>h</div><p style='display:none'>i</p>"
    assert extract.read_page(f"<article>{ARTICLE}{inner}</article>", None) == READ + "\n\na\n\nb\n\nc d e\n\nf\n\ng\n\nh\n\ni"


def test_articles_side_by_side():
    page = "<body><nav>n</nav>" + "".join(f"<article class='post-{i} kind{'x' * i}'><p>{i} {'words of it ' * 9 * i}</p></article>" for i in (1, 2, 3)) + "<footer>f</footer></body>"
    want = "\n\n".join(f"{i} {'words of it ' * 9 * i}".strip() for i in (1, 2, 3))
    assert extract.read_page(page, None) == want
    assert extract.read_page(page, "html>body>article.kindx.post-#") == want


def test_long_names_tell_paths_apart():
    page = "<body><div class='aaaaaaaaaaaaaaaaaaaaaaaaaaaa-one'><p>x y</p></div><div class='aaaaaaaaaaaaaaaaaaaaaaaaaaaa-two'><p>z</p></div></body>"
    assert extract.read_page(page, "body>div.aaaaaaaaaaaaaaaaaaaaaaaaaaaa-two") == "z"


def test_deep_and_long_pages_are_linear():
    extract.read_page("<div>" * 50_000 + "x", None)
    extract.read_page("<b>" * 50_000 + "</i>" * 50_000, None)
    extract.read_page("<p>" * 100_000, None)
    extract.read_page("<header>" * 50_000 + "x", None)
    extract.read_page("<form>" * 50_000 + "x" + "<div class=comments>" * 20_000, None)
    extract.read_page("<!--" * 100_000, None)
    assert len(extract.read_page("<p>" + "word " * 200_000, None)) == 999_999


def test_hosts_vote(spark):
    page = "<body><div class='{a}'>{x}</div><div class='{b}'>{y}</div></body>"
    long, short = "an article of some length " * 4, "teaser " * 10
    rows = [(i, "http://a.com/" + str(i), page.format(a="text", b="more", x=f"<p>{i} {long}</p>", y=f"<p>{short}</p>"), "p") for i in range(6)]
    rows.append((6, "http://a.com:80/6", page.format(a="text", b="more", x="<p>6 brief</p>", y=f"<p>{short * 3}</p>"), "p"))  # its own best would be the teaser
    rows += [(7, None, None, "p"), (8, "http://b.org", "", None), (9, "http://a.com/9", "<body><p>other layout</p></body>", "p"), (9, "http://a.com/9", "<body><p>other layout</p></body>", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = sorted((r.page_id, r.text) for r in extract.extract(df).collect())
    assert got == [(i, f"{i} {long}".strip()) for i in range(6)] + [(6, "6 brief"), (7, ""), (8, ""), (9, "other layout"), (9, "other layout")]
    assert extract.extract(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    from tensorframe.llm.queries import op4_host_path_extraction

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op4_host_path_extraction(spark, sf).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.DOTALL)[1]
        parts = [" ".join(unescape(re.sub(r"<[a-z/!][^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"<p>|</p>|<h1>|</h1>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert r.text == want and r.n_chars == len(want) and r.url == pages[r.page_id].url

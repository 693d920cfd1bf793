"""Main text of hand-written pages, and of the given ones."""

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from replytime.llm import html_text
from replytime.llm.queries import op3_html_text

from ..conftest import SF0001

TREE = html_text.trained()
BODY = "This is a paragraph of the article that has quite a few words in it, as articles do."


def text(page):
    return html_text.main_text(page, TREE)


def test_tree_knows_its_table():
    import numpy as np
    table = np.array(html_text.EXAMPLES, float)
    out = np.zeros(len(table), bool)
    html_text._mark(TREE, table[:, :-1], np.arange(len(table)), out)
    assert (out == table[:, -1].astype(bool)).all()


@pytest.mark.parametrize("furniture", [
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>',
    "<header><p>Site of many things, all of them described on this site</p></header>",
    "<footer>&copy; 2024 the owners of this site and all of their friends and relations</footer>",
    '<aside><h2>Related</h2><p>Another article that you may like to read after this one is done.</p></aside>',
    '<div class="sidebar"><p>A longer text in the side bar that is not part of the article at all.</p></div>',
    '<div id="cookie-notice">We use cookies to make this site work and to see how it is used by you.</div>',
    '<div class="ad">Buy this thing now because it is the best thing that you could ever buy.</div>',
    '<form><label>Your mail address</label><input name="m"><button>Send it</button></form>',
    "<script>var x = '<p>not a text</p>';</script><style>p { color: red }</style>",
    '<section id="comments"><h3>Comments</h3><article class="comment"><p>I liked this article very much, '
    "thank you for writing it.</p></article></section>",
    "<!-- a comment <p>with tags</p> -->", '<div hidden>This text is hidden from all readers of the page.</div>',
])
def test_furniture_goes_and_the_article_stays(furniture):
    for page in (f"<html><body>{furniture}<article><h1>Title of it</h1><p>{BODY}</p><p>Short.</p></article></body></html>",
                 f"<html><body><article><h1>Title of it</h1><p>{BODY}</p><p>Short.</p></article>{furniture}</body></html>",
                 f'<body><div class="content"><h1>Title of it</h1><p>{BODY}<p>Short.</div>{furniture}'):
        assert text(page) == f"Title of it\n\n{BODY}\n\nShort."


def test_white_space_references_and_lines():
    page = "<article><p> a&amp;b \n\t <b>c</b>d&nbsp;e<br>f &lt;g&gt; &#228;&eacute;</p><p>x</p>\n<p>y</article>"
    assert text(page) == "a&b cd e f <g> äé\n\nx\n\ny"


def test_links_in_a_paragraph_stay():
    page = f'<article><p>{BODY} <a href="#">See this page</a> for more.</p><p><a href="#">One link</a></p><p>{BODY}</p></article>'
    assert "See this page for more." in text(page) and "One link" in text(page)


def test_head_of_the_article_stays():
    for head in ('<header><h1>Title of it</h1></header>', '<div class="article-header"><h1>Title of it</h1></div>',
                 '<header class="entry-header"><h1>Title of it</h1></header>'):
        assert text(f"<body><header><p>The site</p></header><article>{head}<p>{BODY}</p></article></body>") == (
            f"Title of it\n\n{BODY}")


def test_page_without_marked_article():
    page = ('<body><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul>'
            f"<h1>The title</h1><p>{BODY}</p><p>{BODY} {BODY}</p></body>")
    assert text(page) == f"The title\n\n{BODY}\n\n{BODY} {BODY}"


def test_words_and_links_decide_where_containers_do_not():
    long = " ".join([BODY] * 15)
    menu = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul>'
    body = f"<h1>The title</h1><p>{long}</p><p>A short line.</p><p>{long}</p>"
    want = f"The title\n\n{long}\n\nA short line.\n\n{long}"
    # a small block with an article word does not take the page from the plain text
    got = text(f'<body>{menu}<div class="main-title">Site news</div><div>{body}</div></body>')
    assert got.endswith(want) and "Home" not in got
    # nor does a furniture word on the container of the whole article
    for attributes in ('class="has-sidebar"', 'id="page-with-banner"', 'class="search social"'):
        page = f'<body><nav><p>{long}</p></nav><div {attributes}>{menu}{body}</div><footer><p>{long}</p></footer></body>'
        assert text(page) == want, attributes
        assert text(page.replace("</div><footer>", "<p>A last line.</p></div><footer>")) == want + "\n\nA last line."
    assert text(f"<body><form>{body}</form></body>") == want
    # long furniture beside a long article goes, marked or not
    for article in (f"<article>{body}</article>", f"<div>{body}</div>"):
        assert text(f'<body>{article}<div class="comments"><p>{long}</p><p>{long}</p></div></body>') == want
    assert text(f"<body><article>{body}</article><div><p>{long}</p></div></body>") == want
    assert text(f"<body><div hidden><p>{long}</p></div><p>Closed today.</p></body>") == "Closed today."


def test_end_tag_closes_at_any_depth():
    for count in (63, 64, 500):
        for tag, attributes in (("nav", ""), ("section", ' class="sidebar"')):
            page = f"<{tag}{attributes}>{'<div>' * count}Home</{tag}><article><p>{BODY}</p></article><div>End of page</div>"
            assert text(page) == BODY, (tag, count)
            assert text(f"<{tag}{attributes}>{'<div>' * count}Home</{tag}><p>{BODY}</p>") == BODY, (tag, count)


def test_edge_pages(spark):
    assert text(None) == text("") == text("<html></html>") == text("<p") == ""
    assert text("<") == "<" and text("a < b") == "a < b"
    assert text("plain words without any tag") == "plain words without any tag"
    assert text("<article><p>breaks off in the mid") == "breaks off in the mid"
    assert text('<article><p title="a > b">quoted</p><p title="open>loose</p></article>').startswith("quoted")
    assert text("<article>" + "<div>" * 3000 + "deep") == "deep"
    long = "<article>" + f"<p>{BODY}</p>" * 3000 + "</article>"
    assert text(long) == "\n\n".join([BODY] * 3000)
    rows = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y")], "page_id long, html string, text string")
    assert [r[0] for r in rows.select(html_text.extract(F.col("html"))).collect()] == ["", "", ""]
    assert rows.limit(0).select(html_text.extract(F.col("html"))).count() == 0


def test_given_pages(spark):
    got = {r["page_id"]: r for r in op3_html_text(spark, SF0001).collect()}
    for r in spark.read.parquet(f"{SF0001}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", " ", p))).strip()
                 for p in re.split(r"</?(?:p|h1)[^>]*>", inside)]
        assert got[r["page_id"]]["text"] == "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])

"""Main text of pages: against the standard library's parser on the table, and by cases."""

from html.parser import HTMLParser

import pytest

from ruleloom.llm import op7_pages

FOLDER = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """Blocks of the article element of the test pages: headings and paragraphs."""

    def __init__(self):
        super().__init__()
        self.inside, self.out, self.run = False, [], []

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag in ("p", "h1"):
            self.flush()
        elif tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.run.append(data)


def plain(html):
    reader = Article()
    reader.feed(html)
    reader.close()
    reader.flush()
    return "\n\n".join(reader.out)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in op7_pages.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == plain(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(plain(r["html"]))
        assert got[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("just text &amp; more &lt;b&gt;", "just text & more <b>"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>one<p>two<ul><li>x<li>y</ul>", "one\n\ntwo\n\nx\n\ny"),
        ("<article><h1>T</h1><p>a<br>b  \n c</p><aside>no</aside><div class='share'>no</div></article>", "T\n\na b c"),
        ("<header>menu</header><main><p>text</p><form>f<input></form></main><footer>no</footer>", "text"),
        ("<div class='cookie-notice'>c</div><div id=comments><p>first!</p></div><p>body", "body"),
        ("<script>var a='<p>x</p>'</script><style>p{}</style><p>k<!-- <p>gone</p> --></p>", "k"),
        ("<article><header><h1>Head</h1><nav>n</nav></header><p>t</p><footer>f</footer></article>", "Head\n\nt"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<p>un<b>closed <i>tags</p><p>next", "unclosed tags\n\nnext"),
        ("<p>&eacute;&#233;&#xe9;&nbsp;x&unknown;</p>", "ééé x&unknown;"),
        ("<div hidden>h</div><div style='display: none'>h</div><div role='navigation'>h</div>t", "t"),
        ("<p title='a > b'>q</p>" + "<div>" * 3000 + "deep", "q\n\ndeep"),
        ("</p></div><article>x</article></article>y", "x"),
        ("<title>no</title><body>t<textarea><p>no</textarea>", "t"),
    ],
)
def test_cases(html, want):
    assert op7_pages.main_text(html, frozenset()) == want


def test_templates_of_a_host_are_deleted(spark):
    rows = []
    for k in range(12):
        body = f"<div class=box><div><p>Read our magazine</p></div><p>story {k} of the day</p><p>a passage all share</p></div>"
        rows.append((k, f"https://News.example.org:80/{k}", f"<body><div><ul><li>Home<li>About</ul></div>{body}<section>All rights</section>"))
    # Copies of one page are one page: nothing of them is a template.
    rows += [(100 + k, f"http://copy.example.org/{k}", "<div><p>same text</p></div><div>tail</div>") for k in range(20)]
    rows += [(200 + k, f"http://art.example.org/{k}", f"<article><div><p>shared</p></div><p>own {k}</p></article>") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in op7_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k] == f"story {k} of the day\n\na passage all share"
        assert got[200 + k] == f"own {k}"
    assert all(got[100 + k] == "same text\n\ntail" for k in range(20))


def test_rotating_templates_of_a_large_host(spark):
    """Adverts in three variants inside articles, and sidebars of a dozen sections: each below the host's share, yet on many pages."""
    rows = []
    for k in range(360):
        side = f"<div><ul><li>Section {k % 12}<li>News</ul></div>"
        rows.append((k, f"http://big.example.org/{k}", f"<article><p>own {k}</p><div><p>Buy number {k % 3}</p></div><div><p>box {k // 5}</p></div></article>"))
        rows.append((1000 + k, f"http://wide.example.org/{k}", f"<body>{side}<div><p>story {k}</p></div></body>"))
    got = {r["page_id"]: r["text"] for r in op7_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(360):
        assert got[k] == f"own {k}\n\nbox {k // 5}"
        assert got[1000 + k] == f"story {k}"


def test_odd_pages(spark):
    rows = [(None, None, "<p>x"), (1, "no url", None), (2, "", ""), (3, "http://a/", "<p>t</p>"), (3, "http://a/", "<p>t</p>"), (4, "http://a/", "w " * 200_000)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = sorted((tuple(r) for r in op7_pages.extract(pages).collect()), key=str)
    want = [(None, None, "x", 1), (1, "no url", "", 0), (2, "", "", 0), (3, "http://a/", "t", 1), (3, "http://a/", "t", 1), (4, "http://a/", ("w " * 200_000).strip(), 399_999)]
    assert got == sorted(want, key=str)
    assert op7_pages.extract(pages.where("page_id < 0")).count() == 0


def test_wrappers_with_telling_names_keep_their_article():
    """A name that says what the page has not, or a form around all, deletes no article; lists of comments stay away."""
    article = "<article><h1>Title</h1><p>First part.</p><section class='comments'><article>Not this.</article></section></article>"
    for wrapper in ("div class='content no-sidebar'", "div class='layout with-sidebar'", "form action='/'", "div id='page-header'"):
        page = f"<body><nav>Menu</nav><{wrapper}>{article}</{wrapper.split()[0]}><div class='sidebar'><p>Side.</p></div></body>"
        assert op7_pages.main_text(page, frozenset()) == "Title\n\nFirst part."
    unseen = f"<body><div class='no-sidebar' style='display: none'>{article}</div><article><p>Seen.</p></article></body>"
    assert op7_pages.main_text(unseen, frozenset()) == "Seen."

"""Main text against a slow extractor that knows a page's parts, and against pages composed of known parts."""

import html.parser
import random

import pytest

from tidemark.llm import htmlmain

DROP = {"nav", "footer", "aside", "form", "script", "style", "button", "menu", "dialog", "head"}
INLINE = {"a", "b", "i", "em", "strong", "span", "sup", "sub", "math", "mi", "mo", "mn"}


class Slow(html.parser.HTMLParser):
    """All text below the first `article`, block by block, as a plain walk over start and end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attributes):
        if tag not in INLINE:
            self.out.append(" ")
        if tag not in ("br", "hr", "img", "input", "meta", "link"):
            while tag in ("p", "h1", "h2", "li") and self.open and self.open[-1] in ("p", "li"):
                self.open.pop()
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.out.append(" ")
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "article" in self.open and not DROP & set(self.open[self.open.index("article") :]):
            self.out.append(data)


def slow(source):
    parser = Slow()
    parser.feed(source)
    parser.close()
    return " ".join("".join(parser.out).split())


def test_equals_the_slow_extractor_on_all_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmlmain.extract(pages).collect()}
    assert got == {r["page_id"]: slow(r["html"] or "") for r in pages.collect()}


WORDS = "river stone light house market letter garden winter morning street paper window".split()


def words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def furniture(r, n, within=False):
    """A part that is not the article, of about n words, in or out of paragraphs; within it, a header or noscript would be the article's own."""
    text = words(r, n).upper()
    inner = text if r.random() < 0.5 else f"<p>{text}</p><p>{text}</p>"
    return r.choice(
        [f"<nav>{inner}</nav>", f"<aside>{inner}</aside>", f"<footer>{inner}</footer>", f"<form>{inner}<input></form>", f"<div class='sidebar'>{inner}</div>", f"<div class='cookie-notice'>{inner}</div>", f"<div id=ad-7>{inner}</div>",
         f"<div class='comments'>{inner}</div>", f"<script>{text}</script>", f"<div class='newsletter box'>{inner}</div>"] + ([] if within else [f"<header>{text}</header>", f"<header><h1>{text}</h1><nav>{inner}</nav></header>", f"<noscript>{text}</noscript>"])
    )


def composed(r, wrap):
    """A page and its article: blocks of known text in one of several wrappers, furniture of any length around it and inside."""
    blocks, want = [], []
    for _ in range(r.randint(1, 6)):
        text = words(r, r.choice([1, 4, 30, 120]))
        blocks.append(r.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</ul>", "<fieldset>{}</fieldset>", "<p><b>{}</b></p>"]).format(text))
        want.append(text)
        if r.random() < 0.15:
            blocks.append(furniture(r, r.choice([2, 40]), True))
    title = words(r, 3)
    head = {"article": f"<header><h1>{title}</h1></header>", "main": f"<h1>{title}</h1>", "post": f"<header><h1>{title}</h1></header>", "entry": f"<div class='post-header'><h1>{title}</h1></div>"}[wrap]
    blocks.insert(0, "<p>" + (lead := words(r, 60)) + "</p>")
    want.insert(0, lead)
    inner = head + "".join(blocks)
    body = {"article": f"<article>{inner}</article>", "main": f"<main>{inner}</main>", "post": f"<div class='post'>{inner}</div>", "entry": f"<div class='entry'>{inner}</div>"}[wrap]
    around = [furniture(r, r.choice([1, 10, 400])) for _ in range(r.randint(0, 4))]
    at = r.randint(0, len(around))
    return "<html><body>" + "".join(around[:at]) + body + "".join(around[at:]) + "</body></html>", " ".join([title, *want])


@pytest.mark.parametrize("wrap", ["article", "main", "post", "entry"])
def test_pages_of_known_parts(wrap):
    r = random.Random(wrap)
    for _ in range(300):
        source, want = composed(r, wrap)
        assert htmlmain.Page(source).choose(None)[1] == want, source


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "ad", "comments"])
@pytest.mark.parametrize("n", [1, 5, 200])
def test_furniture_goes_whatever_its_length(name, n):
    for post in ("<div class=post><p>A short post here.</p></div>", "<article>A short post here.</article>", "<p>A short post here.</p>"):
        for box in (f"<div class='{name}'>{'buy this ' * n}</div>", f"<div class='{name}'><p>{'buy this ' * n}</p></div>"):
            assert htmlmain.Page(f"<body>{post}{box}</body>").choose(None)[1] == "A short post here."
            assert htmlmain.Page(f"<body>{box}{post}</body>").choose(None)[1] == "A short post here."


@pytest.mark.parametrize("n", [1, 10, 22, 25, 26, 34, 300])
def test_text_without_a_telling_name_stays_whatever_its_length(n):
    box = "x" * n
    page = f"<body><div class=body><p>{'long text ' * 30}</p></div><div class=more>{box}</div></body>"
    assert htmlmain.Page(page).choose(None)[1] == ("long text " * 30) + box


def test_formulas_and_fallbacks_of_the_article_stay():
    page = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p><object data=a><p>Fallback.</p></object><noscript>Plain.</noscript><fieldset><legend>Key</legend>A box.</fieldset></article>"
    assert htmlmain.Page(page).choose(None)[1] == "So x=1 holds. Fallback. Plain. Key A box."


def test_headers_of_the_site_go_and_those_of_the_article_stay(spark):
    long = "<p>" + "long text " * 30 + "</p>"
    site = "<header><h1>Site</h1></header>"
    for header in ("<header><h1>Title</h1></header>", "<div class=post-header><h1>Title</h1></div>", "<div class='masthead'><h2>Title</h2></div>"):
        page = f"<body>{site}<div class=post>{header}{long}</div><footer>x</footer></body>"
        assert htmlmain.Page(page).choose(None)[1] == "Title " + ("long text " * 30).strip()
    assert htmlmain.Page(f"<body>{site}{long}</body>").choose(None)[1] == ("long text " * 30).strip()
    assert htmlmain.Page(f"<div class=page><header><h1>Site</h1><nav>menu</nav></header>{long}</div>").choose(None)[1] == ("long text " * 30).strip()
    pages = [(i, f"http://a.org/{i}", f"<body>{site}<div class=post><header><h1>Title {i}</h1></header>{long}</div></body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in htmlmain.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} " + ("long text " * 30).strip() for i in range(4)}

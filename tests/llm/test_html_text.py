"""Articles out of pages with known parts, and pages that are broken."""

import random
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyward.llm import html_text

BODY = ["Title of it", "A first paragraph with quite a few words in it, as articles have.", "Short.", "Another paragraph & its <b>words</b>, long enough to count as text."]
ARTICLE = f"<article><h1>{BODY[0]}</h1><p>{BODY[1]}<p>{BODY[2]}</p><p>{BODY[3].replace('&', '&amp;')}</p></article>"
EXPECTED = "\n".join(BODY).replace("<b>", "").replace("</b>", "")

AROUND = {
    "menu": "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>All the news of the day in one place</a></li></ul></nav>",
    "header": "<header><h2>The site's name</h2><p>and its long line of words that says what it is all about</p></header>",
    "footer": "<footer>&copy; somebody &middot; a long sentence at the foot of the page that is not text.</footer>",
    "sidebar": "<aside><p>Read also this other piece, which has many words in its teaser.</p></aside>",
    "advert": "<div class='ad'>Buy now, a very good offer for everybody who reads long sentences.</div>",
    "notice": "<div id='cookie-notice'><p>We use cookies to make this page a better one for all of us.</p><button>OK</button></div>",
    "form": "<form><label>Your name, please</label><input name=q><textarea>some text</textarea></form>",
    "script": "<script>var t = '</p><p>no text at all, though it looks like it';</script><style>p{margin:0}</style>",
    "comments": "<section class='comments'><h3>Comments</h3><article><p>I read it all and it is a very fine article indeed.</p></article></section>",
    "markup": "<!-- a comment with many words that nobody should see --><noscript>Switch it on</noscript>",
}


@pytest.mark.parametrize("part", sorted(AROUND))
def test_part_is_left_out(part):
    for page in (AROUND[part] + ARTICLE, ARTICLE + AROUND[part], ARTICLE.replace("</article>", AROUND[part] + "</article>")):
        if part == "header" and page.endswith(AROUND[part] + "</article>"):
            continue  # an article's own header is its title
        assert html_text.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>") == EXPECTED


def test_all_parts_at_once():
    around = "".join(AROUND.values())
    assert html_text.main_text(f"<html><body>{around}{ARTICLE}{around}") == EXPECTED


def test_page_without_an_article_element():
    text = "".join(f"<p>Paragraph {i} with a number of words that make it a line of text, no menu.</p>" for i in range(8))
    got = html_text.main_text(f"<body>{AROUND['menu'] * 3}<div><h1>Head</h1>{text}</div>{AROUND['footer']}").split("\n")
    assert got[-8:] == [f"Paragraph {i} with a number of words that make it a line of text, no menu." for i in range(8)]
    assert len(got) <= 9


@pytest.mark.parametrize("page", ["", " ", "<html></html>", "<nav><a>x</a></nav>", "<<<>>><p", "<script>", "&", "<!--"])
def test_nothing_there(page):
    assert html_text.main_text(page) in ("", "&", "<<<>>>", "<<>>")


def test_cut_off_page():
    assert html_text.main_text(ARTICLE[: ARTICLE.index("</p></article")] + "</p><div cla") == EXPECTED


def test_white_space_and_references():
    page = "<article><p>one\n\t two&nbsp;three&#8212;four &lt;five&gt; &eacute;<br>six</p><p>" + "long words here " * 5000 + "</p></article>"
    assert html_text.main_text(page).split("\n")[0] == "one two three—four <five> é six"


def test_smoothing_keeps_a_constant():
    assert np.allclose(html_text.smoothed(np.full(9, 3.0)), 3.0)


def test_rows(spark):
    rows = [(1, "u", None, 5), (1, "u", "", 5), (None, None, f"<body>{ARTICLE}", 5), (1, "u", f"<body>{ARTICLE}", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").coalesce(1)
    got = [tuple(r) for r in html_text.report(frame).collect()]
    assert got == [(1, "u", "", 0), (1, "u", "", 0), (None, None, EXPECTED, len(EXPECTED)), (1, "u", EXPECTED, len(EXPECTED))]
    assert html_text.report(frame.limit(0)).count() == 0


MARKED = [
    "<body class='has-sidebar'>{}", "<body class='search-page'>{}", "<body class='no-comments left-sidebar'>{}", "<html class='menu'><body>{}",
    "<body><main class='with-sidebar'>{}</main>", "<body><div class='page-with-sidebar'>{}</div>", "<body><div id='search'>{}</div>",
    "<body><form action='/' method='post'>{}</form>", "<body><form id='f'><div class='modal'><div class='layout--has-menu'>{}</div></div></form>",
]


@pytest.mark.parametrize("page", MARKED)
def test_marks_around_the_page(page):
    """What is around the page is content, whatever its class says; what is marked inside it is left out as ever."""
    around = "".join(part for name, part in AROUND.items() if name != "header" or "<main" not in page)  # the main element's own header is text
    for article in (ARTICLE, ARTICLE.replace("<article>", "<article class='post comments-open'>"), ARTICLE.replace("<article>", "<article class='related'>")):
        assert html_text.main_text(page.format(around + article + around)) == EXPECTED
    plain = ARTICLE.replace("article>", "div>")
    assert html_text.main_text(page.format(AROUND["menu"] + plain + AROUND["sidebar"] + AROUND["form"])) == EXPECTED
    assert html_text.main_text(page.format(AROUND["menu"] + plain.replace("h1>", "p>") + AROUND["comments"])) == EXPECTED


def test_long_marked_elements():
    """Comments and menus that are longer than the article are no article."""
    comments = "<div class='comment-list'>" + "<article class='comment'><p>I read it all and it is a very fine article indeed.</p></article>" * 20 + "</div>"
    menu = "<div class='menu'><ul>" + "<li><a href='/a'>All the news of the day in one place</a></li>" * 50 + "</ul></div>"
    for article in (ARTICLE, ARTICLE.replace("article>", "div>")):
        assert html_text.main_text(f"<body>{menu}{article}{comments}{AROUND['form'] * 30}") == EXPECTED
    assert html_text.main_text(f"<body>{menu}<p>Not found.</p>") == "Not found."
    assert html_text.main_text(f"<body><article><form>{ARTICLE[9:-10]}</form>{comments}</article>") == EXPECTED


def test_large_pages_take_linear_time():
    many = "".join(f"<div class='widget'><p>Some words in widget {i}.</p></div><form><b>x</b></form>" for i in range(20_000))
    assert html_text.main_text(f"<body>{ARTICLE}{many}") == EXPECTED
    assert html_text.main_text("<div class='menu'>" * 20_000 + ARTICLE) == EXPECTED


def test_edges_of_a_page_without_an_article_element():
    """The container's first and last lines are kept, however short."""
    text = "".join(f"<p>Paragraph {i} with a number of words that make it a line of text, no menu.</p>" for i in range(8))
    lines = [f"Paragraph {i} with a number of words that make it a line of text, no menu." for i in range(8)]
    page = "<h1>Head</h1><p>By</p><p>Me</p><p>Today</p><p>At</p><p>Noon</p>" + text + "<p>So</p><p>it</p><p>was.</p><p>The</p><p>End</p>"
    expected = ["Head", "By", "Me", "Today", "At", "Noon", *lines, "So", "it", "was.", "The", "End"]
    for whole in (f"<body>{AROUND['menu'] * 3}<div>{page}</div>{AROUND['footer']}", f"<body><div class='ad'>x</div>{page}", page):
        assert html_text.main_text(whole).split("\n") == expected
    long = "<p>" + "one very long paragraph " * 99 + "</p>"
    assert html_text.main_text(f"<body><div><h1>Head</h1>{long}<p>End</p></div>").split("\n")[::2] == ["Head", "End"]


KEPT = [
    "<h2 id='search-algorithms'>Kept</h2>", "<h2 id='social-history'>Kept</h2>", "<p class='ad-hoc'>Kept</p>", "<p class='share-price'>Kept</p>",
    "<section id='related-work'><p>Kept</p></section>", "<h3 class='comment'>Kept</h3>", "<section id='search'><p>Kept</p></section>", "<p id='menu'>Kept</p>",
    "<ul><li class='share-holder'>Kept</li></ul>", "<p><span class='comment'>Kept</span></p>", "<p>Ke<svg><text>no</text></svg>pt</p>", "<p><label>Kept</label></p>",
    "<p>Kept<button>no</button></p>", "<noscript><p>no</p><p>no</p></noscript><p>Kept</p>", "<p>Kept<object><div>no</div> no</object></p>",
    "<p><svg>no</p><p>Kept</p>", "<p>Kept</p></svg></object>",
]


@pytest.mark.parametrize("part", KEPT)
def test_parts_of_an_article_stay(part):
    """What only looks like a menu or a notice by a word of its class or id, and what stands around something skipped."""
    page = f"<body>{ARTICLE.replace('</article>', part + '<p>' + BODY[1] + '</p></article>')}"
    assert html_text.main_text(page).split("\n") == [*EXPECTED.split("\n"), "Kept", BODY[1]]


@pytest.mark.parametrize("name", ["ad", "ad-slot", "cookie-notice", "comment-list", "share-buttons", "main-nav x", "x sidebar_left", "related-posts", "ad-x"])
def test_marked_parts_go(name):
    part = f"<div class='{name}'><p>A line of words that is no part of what the article says.</p></div>"
    assert html_text.main_text(f"<body>{ARTICLE.replace('</article>', part + '</article>')}") == EXPECTED


def test_deep_pages_take_linear_time():
    began = time.process_time()
    assert len(html_text.main_text("<div>x" * 50_000)) == 2 * 50_000 - 1
    html_text.main_text("<div>" * 50_000 + "</b></section>" * 50_000)
    html_text.main_text("<p>" + "<svg>" * 50_000 + "</object></svg>" * 50_000 + "<div class='menu'><form>" * 20_000)
    assert time.process_time() - began < 6


class Node:
    """An element of the whole tree; text is that of its lines, in the order of the page."""

    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up, self.lines = tag, attrs, up, []

    def chain(self):
        return [self, *(self.up.chain() if self.up else [])]


class Tree(HTMLParser):
    """The page as a tree, with the lines in order: [text, tags, node]."""

    def __init__(self, html):
        super().__init__()
        self.root = self.at = Node("", [], None)
        self.nodes, self.lines, self.text, self.tags, self.raw = [], [], "", 0, False
        self.feed(html_text._OPEN_TAG.sub("", html))
        self.close()
        self.line()

    def line(self):
        if self.text.split():
            self.lines.append((" ".join(self.text.split()), max(1, self.tags), self.block()))
            self.tags = 0
        self.text = ""

    def block(self):
        return next(n for n in self.at.chain() if n.tag not in html_text.SKIPPED)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in html_text.RAW:
            self.raw = True
        elif tag == "br":
            self.text += " "
        elif tag in html_text.SKIPPED:
            self.at = Node(tag, attrs, self.at)
        elif tag in html_text.BLOCKS and tag not in html_text.VOID:
            self.line()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and self.block().tag == tag:
                self.at = self.block().up
            self.at = Node(tag, attrs, self.root if tag == "body" else self.at)
            self.nodes.append(self.at)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in html_text.RAW:
            self.raw = False
            return
        open_ = [n for n in self.at.chain() if n.tag == tag]
        if tag in html_text.BLOCKS:
            self.line()
        if open_ and tag in html_text.SKIPPED:
            # Blocks inside stay open: they hang on what is around the skipped element.
            node = self.at
            inside = []
            while node is not open_[0]:
                inside.append(node)
                node = node.up
            blocks = [n for n in inside if n.tag not in html_text.SKIPPED]
            if blocks:
                blocks[-1].up = open_[0].up
                self.at = blocks[0]
                for below, above in zip(blocks, blocks[1:]):
                    below.up = above
            else:
                self.at = open_[0].up
        elif open_:
            self.at = open_[0].up

    def handle_data(self, data):
        if not self.raw and not any(n.tag in html_text.SKIPPED for n in self.at.chain()):
            self.text += data


def plain_text(html):
    """The rules once more, each answered by walking the tree."""
    tree = Tree(html)
    tags = lambda n: {x.tag for x in n.chain()}
    main_tags, number = ("article", "main"), {id(n): i for i, n in enumerate(tree.nodes)}
    marks = {id(n): html_text._marks(n.tag, n.attrs, bool(n.up and tags(n.up) & {*main_tags})) for n in [*tree.nodes, tree.root]}
    comments = lambda n: bool(marks[id(n)] & html_text.COMMENTS)

    def counted(n):
        """The lines that count for an element: not those of comments inside it, nor what is never content."""
        for text, _, owner in tree.lines:
            chain = owner.chain()
            if n in chain and not tags(owner) & html_text.NEVER and not any(comments(x) for x in chain[: chain.index(n)]):
                yield text, owner

    def sums(n):
        own = list(counted(n))
        return [sum(len(t) for t, _ in own), sum(len(t) for t, o in own if o.tag in ("li", "dt", "dd")), sum(bool(tags(o) & {"h1", "main"}) for _, o in own), sum(bool(tags(o) & {*main_tags}) for _, o in own)]

    def element(n):
        return html_text.Element(n.tag, marks[id(n)], None, False, False, False, *sums(n))

    page, dropped, main = element(tree.root), set(), []
    for n in tree.nodes:
        around = [x for x in n.up.chain() if x.tag in main_tags]
        header = n.tag == "header" and not any(x in main for x in n.up.chain())
        marked = marks[id(n)] and not html_text._around_page(element(n), element(around[-1]) if around else None, page)
        if n.up in dropped or n.tag in html_text.NEVER or header or marked:
            dropped.add(n)
        elif n.tag in main_tags:
            main.append(n)
    content = [owner not in dropped for _, _, owner in tree.lines]
    if not tree.lines:
        return ""
    level = html_text.smoothed(np.array([len(t) / k if c else 0.0 for (t, k, _), c in zip(tree.lines, content)]))
    chosen = [c and v >= html_text.THRESHOLD * level.std() for c, v in zip(content, level)]
    weight = lambda n: sum(len(t) for (t, _, owner), c in zip(tree.lines, chosen) if c and n in owner.chain())
    if not any(chosen):
        return ""
    best = max(map(weight, main), default=0)
    if best:
        homes = [n for n in main if weight(n) >= 0.2 * best]
        return "\n".join(t for (t, _, owner), c in zip(tree.lines, content) if c and any(h in owner.chain() for h in homes))
    homes = [n for n in tree.nodes if n.tag not in html_text.PIECES and weight(n) >= 0.75 * weight(tree.root)]
    home = max(homes, key=lambda n: number[id(n)], default=tree.root)
    return "\n".join(t for (t, _, owner), c, p in zip(tree.lines, content, chosen) if c and (p or home in owner.chain()))


def test_all_pages_against_the_plain_version():
    pages = [h for sf in ("sf0.001", "sf0.01") for h in pq.read_table(f"/root/testdata/{sf}/pages.parquet")["html"].to_pylist()]
    assert len(pages) == 300
    for page in pages:
        assert html_text.main_text(page or "") == plain_text(page or "")


def test_random_pages_against_the_plain_version():
    random.seed(8)
    parts = [*AROUND.values(), ARTICLE, *KEPT, "<div>", "</div>", "<p>", "</p>", "<section class='comments'>", "</section>", "<main>", "</main>", "<li>", "<ul class='menu'>",
             "</ul>", "<form>", "</form>", "<header>", "</header>", "<body class='x'>", "</body>", "<svg>", "</svg>", "<noscript>", "</noscript>", "some text of a few words", "x", "<br>",
             "<article>", "</article>", "<div class='ad-slot'>", "<div id='search'>", "<script>", "</script>", "long text " * 30]
    for _ in range(1500):
        page = "".join(random.choices(parts, k=random.randrange(1, 25)))
        assert html_text.main_text(page) == plain_text(page), page

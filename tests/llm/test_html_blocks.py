"""Main text against the pages' own articles, read by Python's HTML parser, and what each pass decides."""

from collections import Counter
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from farglass.llm import html_text

BLOCK = set("article aside body div footer form h1 h2 h3 head header html li main nav ol p section table td title tr ul".split())
BARE = (("article>", "div>"), ("nav>", "div>"), ("footer>", "div>"), (' class="ad"', ""))


class Article(HTMLParser):
    """Text within article elements, without scripts, styles and what else is marked within."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text = [], []

    def handle_starttag(self, tag, attrs):
        self.text += [" "] * (tag in BLOCK or tag == "br")
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
        if tag not in ("meta", "br"):
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        self.text += [" "] * (tag in BLOCK)
        tags = [t for t, _ in self.open]
        if tag in tags:
            del self.open[len(tags) - 1 - tags[::-1].index(tag) :]

    def handle_data(self, data):
        if "article" in (t for t, _ in self.open) and not any(t in ("script", "style", "nav", "footer", "aside", "form") or c in ("ad", "notice", "comments") for t, c in self.open):
            self.text.append(data)


def article(html):
    reader = Article()
    reader.feed(html)
    reader.close()
    return " ".join("".join(reader.text).split())


def pages_of(folder):
    return [p for p in pq.read_table(f"/root/testdata/{folder}/pages.parquet", columns=["html"]).column(0).to_pylist() if p]


def without_marks(html):
    for old, new in BARE:
        html = html.replace(old, new)
    return html


def found_share(pages, extract=html_text.extract):
    """Recall and precision of words, without marks, against the articles."""
    hits = wanted = got = 0
    for p in pages:
        want, have = Counter(article(p).split()), Counter(extract(without_marks(p)).split())
        hits, wanted, got = hits + sum((want & have).values()), wanted + sum(want.values()), got + sum(have.values())
    return hits / wanted, hits / max(got, 1)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_text_is_that_of_the_article(folder):
    for html in pages_of(folder):
        assert html_text.extract(html) == article(html)


def test_without_marks_density_and_neighbours_find_the_article():
    recall, precision = found_share(pages_of("sf0.1"))
    assert recall >= 0.97 and precision >= 0.97


def test_each_part_of_the_classifier_is_needed(monkeypatch):
    """With one part off, many pages change for the worse."""
    pages = pages_of("sf0.01")
    good = [html_text.extract(p) for p in pages]
    with monkeypatch.context() as m:  # every block taken as good: menus, adverts and footers come in
        m.setattr(html_text, "first_pass", lambda b, known: "good")
        outside = [html_text.blocks(p) for p in pages]
        assert all(all(html_text.classify([b for b in found if not b.scope])) for found in outside)
    with monkeypatch.context() as m:  # links unseen: entries of menus are open and join the text beside them
        m.setattr(html_text, "measure", lambda b, measure=html_text.measure: (measure(b), setattr(b, "linked", 0)))
        assert sum(html_text.extract(without_marks(p)) != html_text.extract(p) for p in pages) > 0.8 * len(pages)
    with monkeypatch.context() as m:  # no neighbours: open blocks go
        m.setattr(html_text, "second_pass", lambda *a: False)
        assert found_share(pages)[0] < 0.9
    with monkeypatch.context() as m:  # nothing is long enough: no good blocks, so nothing to inherit from
        m.setattr(html_text, "GOOD", {k: (1 << 30, 0.0) for k in html_text.GOOD})
        assert found_share(pages)[0] < 0.5
    assert good == [html_text.extract(p) for p in pages]


def test_stop_words_decide_most_of_the_text():
    inside = [b for p in pages_of("sf0.01") for found in [html_text.blocks(without_marks(p))] for b, kept in zip(found, html_text.classify(found)) if kept]
    assert sum(b.n for b in inside if b.label == "good") > 0.65 * sum(b.n for b in inside)


def test_low_blocks_need_neighbours_even_in_an_article():
    keywords = "<p>" + " ".join(f"word{i}" for i in range(40)) + "</p>"
    links = "<p>" + " ".join(f'<a href="{i}">link number {i} of a list</a>' for i in range(9)) + "</p>"
    assert "word3" not in html_text.extract(f"<article>{PROSE}<p>One two.<p>Three.{keywords}{links}</article>")
    assert "word3" in html_text.extract(f"<article>{PROSE}{keywords}{PROSE}</article>")


PROSE = "<p>This is the text of the page and it has a number of the words that are to be seen in it as it goes on for some time in a page."
KEYWORDS = "<p>python spark cluster engine query planner storage column vector index hash partition shuffle broadcast driver executor memory disk network thread lock queue stack heap cache</p>"


def test_stop_words_decide(monkeypatch):
    html = f"<body><div>{PROSE}{PROSE}</div>{KEYWORDS}{KEYWORDS}</body>"
    assert html_text.extract(html) == " ".join([PROSE[3:]] * 2)
    monkeypatch.setattr(html_text, "STOP_WORDS", frozenset())
    assert html_text.extract(html).endswith("cache")


@pytest.mark.parametrize(
    "html,text",
    [
        ('<div class="content has-sidebar"><article><p>Body of it.</article></div>', "Body of it."),
        ('<div class="sidebar-left"><main><p>Body of it.</main></div>', "Body of it."),
        ('<main class="no-ads"><p>Body text</main>', "Body text"),
        ('<article class="tag-social post"><p>Body text</article>', "Body text"),
        ('<article><div class="post-header"><h1>Head</h1></div><p>Text of it</article>', "Head Text of it"),
        ("<body><div><p>" + "中文文本段落" * 30 + "</p></div></body>", "中文文本段落" * 30),
        ('<article><p>Body</article><div class="comments"><article class="comment"><p>Nice one</article></div>', "Body"),
        ('<article><p>Body<div class="ad">' + PROSE + "</div><p>End</article>", "Body End"),
        (f"<article>{PROSE}</article><div>{PROSE}</div>", PROSE[3:]),
        (f"<article><p>Card</article><div>{PROSE}</div>", "Card " + PROSE[3:]),
        ("<article><p>read more words in this one <a href=x>a link with many words in it that go on and on for longer than text</a></article>", ""),
        (f"<body><h2>Title</h2>{PROSE}<h2>Links</h2><ul><li><a href=1>one</a><li><a href=2>two</a></ul></body>", "Title " + PROSE[3:]),
    ],
)
def test_marks_and_neighbours(html, text):
    assert html_text.extract(html) == text


def test_pages_of_nothing_and_long_pages(spark):
    schema = "page_id long, url string, html string, n_chars string, found string"
    assert html_text.extract_pages(spark.createDataFrame([], schema)).collect() == []
    long = "the words of it " * 100_000
    row = html_text.extract_pages(spark.createDataFrame([(1, None, f"<article><p>{long}</article>", "x", "y")], schema)).first()
    assert (row.text, row.n_chars, row.url) == (long.strip(), len(long) - 1, None)

"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by the density of
links, its length and the density of stop words, whatever element it is in: blocks of links are bad;
long blocks with many stop words are good; all others are open: near-good ones (enough stop words),
low ones (few) and those too short to judge. Where stop words can say nothing (a script without
spaces, or a page in a language that is not in the list) length and links decide alone.

Marks only move the thresholds. Within ``article`` or ``main`` a block is long with fewer words and
needs fewer stop words. What menus, headers, footers, forms, notices, adverts and comments mark as
theirs (element, role, or a class or id of such a name) is good only with very many words and stop
words, and bad below, as it is never in doubt. A name on a wrapper says nothing about an article or main element
within, unless it names other texts (comments, related pages).

The second pass gives open blocks the label of the nearest decided neighbours. The page's ends are bad
neighbours, and blocks of the same main element are nearer than those beyond its border. Between two
good neighbours a block is good, between two bad ones it is bad. On a page without any good block long ones without links count as good. With neighbours that differ a
long block is good if near-good and bad if low, another one has the nearer one's label, the bad one's at equal distance; a
heading goes with the block below it. Only what both passes leave open is settled by the mark: a block
that has no decided neighbour in its main element, or only bad ones, stays with the element. Where the
good blocks of main elements have at least as many words as those outside, what is outside is dropped.

Texts have their character references decoded and white space within a block made one space;
blocks come in page order with one space between. Nothing is cut. Null and empty pages give an
empty text, broken markup is read to its end, repeated rows stay, an empty table gives no rows, and
other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form head button select menu dialog header canvas object audio video map label fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form status".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "disqus feedback footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification paywall popup promo "
    "promoted promotion reactions recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags teaser toc toolbar tooltip tracking widget widgets".split()
)
#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    "a an and are as at be by for from had has have he her his i in is it its not of on or that the their they this to was were which with you "
    "als auf aus bei das dass dem den der des die ein eine einer er es für hat im ist mit nicht sich sie sind und von wie wird zu zum zur "
    "al como con de del el en es esta la las lo los más no o para pero por que se sin su sus un una y "
    "au aux avec ce cette ces dans des du elle est et il ils la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous".split()
)

#: Names of texts that are not the page's own, even where they are articles themselves.
OTHER_TEXTS = frozenset("comment comments disqus feedback promo promoted promotion reactions recommended related replies reply respond sponsor sponsored teaser".split())
#: First parts of class names that tell of something else than the element's own content.
MODIFIERS = frozenset("category cat has no non not tag with without".split())
#: Punctuation that is cut from words before they are looked up.
MARKS = str.maketrans("", "", ".,;:!?\"'()[]%*#$&|<>")

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

SHORT_WORDS = 8
#: Words and share of stop words from which on a block is good: anywhere, in main elements, in what is marked as something else.
GOOD = {"": (25, 0.25), "main": (12, 0.15), "other": (200, 0.5)}
STOP_LOW = 0.12
LINKS_BAD = 0.5
#: A page of so few stop words among its words is in a language that the list does not hold.
STOP_KNOWN = 0.02
#: Characters a word from which on a script is taken to have no spaces; there so many make a word.
UNSPACED, WORD_CHARS = 24, 4
LAYOUT, OTHERS = 1, 2


class Block:
    __slots__ = ("parts", "linked", "scope", "bad", "heading", "text", "label", "n", "stops")

    def __init__(self, scope: int, bad: bool, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.scope, self.bad, self.heading = scope, bad, heading
        self.text = self.label = ""
        self.n = self.stops = 0


def named(value: str, whole: bool, scope: int) -> int:
    """What a class or id says: 0, LAYOUT or OTHERS. With ``whole`` only whole names count."""
    says = 0
    for name in value.split():
        parts = NAME_PARTS.findall(CAMEL.sub(" ", name).lower())
        if whole and len(parts) > 1 or not parts or parts[0] in MODIFIERS and len(parts) > 1:
            continue
        if not OTHER_TEXTS.isdisjoint(parts):
            return OTHERS
        if any(x in BAD_NAMES and not (scope and x == "header") for x in parts):
            says = LAYOUT
    return says


def marked(attributes: str, main: bool, scope: int) -> tuple[bool, int]:
    """Whether attributes hide an element or give it a boilerplate role, and what its names say."""
    names = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names = max(names, named(value, main, scope))
        elif name == "role":
            if value.lower() in BAD_ROLES:
                return True, names
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN_STYLE.search(value)):
            return True, names
    return False, names


def blocks(html: str) -> list[Block]:
    """Non-empty blocks in page order. ``scope`` is the number of the main element, 0 outside."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # open elements, and what held around them: bad, names, scope
    bad, names, scope, scopes, links = False, 0, 0, 0, 0
    block = Block(0, False, False)
    at, n = 0, len(html)

    def add(text: str) -> None:
        block.parts.append(text)
        if links:
            block.linked += len(text.strip())

    def cut(heading: bool = False) -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = Block(scope, bad or names > 0, heading)

    while at < n:
        found = TAG.search(html, at)
        if found is None:
            add(html[at:])
            break
        if found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if not found[1]:
            if tag in RAW_TAGS:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at) if not found[3].endswith("/") else None
                if end:
                    at = end.end()
                elif not found[3].endswith("/") and tag not in ("svg", "math"):
                    at = n
                if tag in BLOCK_TAGS:
                    cut()
                continue
            if tag == "br":
                add("\n")
                continue
            if tag == "a":
                links = 1
            if tag in VOID_TAGS:
                if tag == "hr":
                    cut()
                continue
            attributes, main = found[3], tag in MAIN_TAGS
            if tag == "p" or tag in HEADINGS or tag == "li":
                while stack and stack[-1][0] == tag:  # an end tag that may be left out
                    _, bad, names, scope = stack.pop()
            says = marked(attributes, main, scope) if ("=" in attributes or "hidden" in attributes) and tag not in ("html", "body") else (False, 0)
            worse = bad or says[0] or (tag in BAD_TAGS and not (tag == "header" and scope))
            called = max(0 if main and names == LAYOUT else names, says[1])
            if tag in BLOCK_TAGS or worse != bad or called != names:
                stack.append((tag, bad, names, scope))
                bad, names = worse, called
                if main and not bad and not names and not scope:
                    scopes += 1
                    scope = scopes
                links = 0 if tag != "a" else links
                cut(tag in HEADINGS)
        else:
            if tag == "a":
                links = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    _, bad, names, scope = stack[k]
                    del stack[k:]
                    cut()
                    break
            else:
                if tag in BLOCK_TAGS:
                    cut()
    if block.parts:
        out.append(block)
    kept = []
    for b in out:
        b.text = " ".join(unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept


def measure(b: Block) -> None:
    """Words and stop words; ``stops`` is -1 in a script without spaces."""
    words = b.text.split(" ")
    b.n = len(words)
    if len(b.text) > UNSPACED * b.n:
        b.n, b.stops = max(b.n, len(b.text) // WORD_CHARS), -1
    else:
        b.stops = sum(map(STOP_WORDS.__contains__, b.text.lower().translate(MARKS).split(" ")))


def first_pass(b: Block, known: bool) -> str:
    """good, bad or open (near, low or short). ``known`` says whether the page's language is in the list."""
    if b.linked > LINKS_BAD * len(b.text):
        return "bad"
    words, stops = GOOD["other" if b.bad else "main" if b.scope else ""]
    telling = known and b.stops >= 0
    if b.n >= words and (not telling or b.stops >= stops * b.n):
        return "good"
    if b.bad or b.n < SHORT_WORDS and b.linked and not b.scope:
        return "bad"
    if b.n < SHORT_WORDS or b.heading:
        return "short"
    return "near" if not telling or b.stops >= STOP_LOW * b.n else "low"


def second_pass(k: int, b: Block, labels: list[str], left: int, right: int) -> bool | None:
    """Whether an open block is main text, by its nearest decided neighbours; None leaves it open.

    ``left`` and ``right`` are their places; -1 and the number of blocks are the page's ends.
    """
    good = [0 <= j < len(labels) and labels[j] == "good" for j in (left, right)]
    if good[0] == good[1]:
        return good[0]
    if b.heading:
        return good[1]
    if b.n >= GOOD[""][0]:
        return b.label == "near"
    return k - left < right - k if good[0] else right - k < k - left


def classify(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    for b in found:
        measure(b)
    judged = [b for b in found if not b.bad and not b.linked and b.stops >= 0]
    known = sum(b.stops for b in judged) >= STOP_KNOWN * sum(b.n for b in judged)
    for b in found:
        b.label = first_pass(b, known)
    if not any(b.label == "good" for b in found):  # a page without prose: long blocks without links stand for it
        for b in found:
            if b.label in ("near", "low") and not b.linked and (b.n >= GOOD[""][0] or b.scope):
                b.label = "good"
    labels = [b.label for b in found]
    n = len(found)
    left, right, inner_left, inner_right = [-1] * n, [n] * n, [-1] * n, [n] * n
    for places, inner, order in ((left, inner_left, range(n)), (right, inner_right, range(n - 1, -1, -1))):
        last, own, scope = places[0] if n and order.step > 0 else n, None, None
        for k in order:
            if found[k].scope != scope:
                own, scope = None, found[k].scope
            places[k], inner[k] = last, -2 if own is None else own
            if labels[k] in ("good", "bad"):
                last = own = k
    out = []
    for k, b in enumerate(found):
        if labels[k] in ("good", "bad"):
            out.append(labels[k] == "good")
            continue
        if b.scope:
            # Neighbours in the element are nearer than any beyond its border; without a good one there it decides.
            sides = [j for j in (inner_left[k], inner_right[k]) if j >= 0]
            good = [labels[j] == "good" for j in sides]
            if not any(good) or all(good):
                out.append(True)
                continue
            out.append(bool(second_pass(k, b, labels, *sides)))
        else:
            out.append(bool(second_pass(k, b, labels, left[k], right[k])))
    inside = sum(b.n for b, good in zip(found, out) if good and b.scope)
    outside = sum(b.n for b, good in zip(found, out) if good and not b.scope)
    return [good and (b.scope > 0 or inside < outside) for b, good in zip(found, out)] if inside else out


def extract(html: str | None) -> str:
    found = blocks(html or "")
    return " ".join(b.text for b, good in zip(found, classify(found)) if good)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows ``<id_col>, <url_col>, text, n_chars``."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)) + ", text string"

    def compute(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    made = pages.select(id_col, url_col, html_col).mapInArrow(compute, schema)
    return made.withColumn("n_chars", F.char_length("text").cast("long"))

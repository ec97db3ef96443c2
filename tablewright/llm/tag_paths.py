"""Main text of web pages by tag-path ratios.

Text is gathered in blocks, and every block stands on a root-to-leaf tag path. Per path, text length and
punctuation are added up over its blocks; the two ratios are smoothed over the page's block order, fused, and
a threshold from their spread chooses content blocks. The element that holds most of the chosen text, and
what around it adds only headings, leads and more chosen text, is the article, and its blocks, short ones too,
are the main text.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import col

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WHITE = re.compile(r"[\x20\t-\r]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
NAME_PARTS = re.compile(r"[^a-z]+")

# Element names by their role, and words in class, id or role attributes that mark no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr br".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
NOT_ARTICLE = frozenset("aside button canvas dialog footer form head iframe input menu nav noscript object select svg".split())
NOT_ARTICLE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist comments consent contentinfo cookie cookies copyright disqus footer gdpr "
    "header masthead menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo recommended related replies reply respond search share sharing sidebar "
    "sidenav signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets complementary".split()
)
# Inside an article these name parts of it.
ARTICLE_WORDS = frozenset("header masthead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


# What a name that begins with one of the words may end with, to name a part of the page: "share-buttons", "widget-area".
PART_WORDS = frozenset("area bar block blocks bottom box button buttons container content form group header heading holder icons inner items links list lists panel posts section top wrap wrapper".split())


class Element:
    """An element of a page, numbered in page order; ``path`` is the number of its tag path, ``last`` that of the last element in it."""

    __slots__ = ("name", "parent", "number", "last", "path", "depth", "skipped", "marked", "chars", "mass", "prose", "in_article")

    def __init__(self, name: str, parent: Element | None, number: int, path: int, skipped: bool, marked: bool):
        self.name, self.parent, self.number, self.last, self.path = name, parent, number, number, path
        self.depth = parent.depth + 1 if parent else 0
        self.skipped = skipped or (parent is not None and parent.skipped)
        self.marked = marked
        self.in_article = name in ("article", "main") or (parent is not None and parent.in_article)
        self.chars = self.mass = self.prose = 0


def hidden(name: str, attributes: str, parent: Element) -> bool:
    """Whether an element is never part of an article: by its name, or because it isn't shown."""
    if name in NOT_ARTICLE or (name == "header" and not parent.in_article):
        return True
    if name in ("html", "body", "article", "main"):
        return False
    if "=" in attributes:
        for a in ATTRIBUTE.finditer(attributes):
            key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                return True
        attributes = ATTRIBUTE.sub("", attributes)
    return "hidden" in attributes.lower().split()


def named_apart(name: str, attributes: str, parent: Element) -> bool:
    """Whether a class, id or role says that an element is no article: a word for it whole, at its end, or before a word for a part."""
    if name in ("html", "body", "article", "main") or "=" not in attributes:
        return False
    words = NOT_ARTICLE_WORDS - ARTICLE_WORDS if parent.in_article else NOT_ARTICLE_WORDS
    for a in ATTRIBUTE.finditer(attributes):
        if a[1].lower() in ("class", "id", "role"):
            for value in (a[2] or a[3] or a[4] or "").lower().split():
                parts = [x for x in NAME_PARTS.split(value) if x]
                if parts and (parts[-1] in words or (parts[-1] in PART_WORDS and not words.isdisjoint(parts[:-1]))):
                    return True
    return False


def blocks(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """The elements of a page, and its text blocks in order, each with the element it stands in; hidden elements are left out."""
    root = top = Element("", None, 0, 0, False, False)
    elements, paths, unclosed = [root], {}, Counter()
    out: list[tuple[Element, str]] = []
    buffer: list[str] = []
    owner = root

    def flush() -> None:
        if buffer:
            text = WHITE.sub(" ", references.unescape("".join(buffer))).strip("\t\n\x0b\x0c\r ")
            buffer.clear()
            if text and not owner.skipped:
                out.append((owner, text))

    def block_of(e: Element) -> Element:
        while e.parent is not None and e.name in INLINE:
            e = e.parent
        return e

    def put(text: str) -> None:
        nonlocal owner
        if top.skipped:
            return
        if not buffer:
            owner = block_of(top)
        buffer.append(text)

    at = 0
    while (m := TAG.search(page, at)) is not None:
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        attributes = m[3] or ""
        while attributes.count('"') % 2 and (more := page.find(">", at)) >= 0 and '"' in page[at:more]:
            attributes += ">" + page[at:more]
            at = more + 1
        if name not in INLINE:
            flush()
        elif name == "br":
            put("\n")
        if m[1]:
            # An end tag of nothing that is open means nothing.
            if unclosed[name]:
                while top.name != name:
                    unclosed[top.name] -= 1
                    top = top.parent
                unclosed[name] -= 1
                top = top.parent
            continue
        if name in VOID:
            continue
        if name in CLOSES_PARAGRAPH or name in SAME_LEVEL:
            ends = SAME_LEVEL.get(name, {"p"})
            e, last = top, None
            while e is not root and (e.name in INLINE or e.name in ends or e.name == "p"):
                last = e if e.name not in INLINE else last
                e = e.parent
            if last is not None:
                while top is not last.parent:
                    unclosed[top.name] -= 1
                    top = top.parent
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not attributes.rstrip().endswith("/") or name not in ("path", "rect", "circle"):
            path = paths.setdefault((top.path, name), len(paths) + 1)
            top = Element(name, top, len(elements), path, top.skipped or hidden(name, attributes, top), named_apart(name, attributes, top))
            elements.append(top)
            unclosed[name] += 1
    if at < len(page):
        rest = page[at:]
        # An unfinished tag at the end is markup.
        cut = re.search(r"<[A-Za-z/!?][^<>]*\Z", rest)
        put(rest[: cut.start()] if cut else rest)
    flush()
    # Numbers follow the page, so an element's parts lie in one stretch of them.
    for e in reversed(elements[1:]):
        e.parent.last = max(e.parent.last, e.last)
    return elements, out


def without_named_parts(elements: list[Element], found: list[tuple[Element, str]]) -> list[tuple[Element, str]]:
    """The blocks outside elements whose class, id or role says that they are no article.

    A name doesn't count against most of the page: an element that holds over half of the punctuated text, in several
    blocks, is what the page is about, whatever a word in its classes says; on a page with an article or main element,
    it must hold that one or lie in it.
    """
    for e, text in found:
        if PUNCTUATION.search(text):
            e.mass += len(text)
            e.prose += 1
    total = sum(e.mass for e in elements)
    for e in reversed(elements[1:]):
        e.parent.mass += e.mass
        e.parent.prose += e.prose
    articles = [e for e in elements if e.name in ("article", "main") and e.mass]
    for e in elements[1:]:
        most = e.marked and 2 * e.mass > total and e.prose > 1
        most = most and (not articles or e.in_article or any(within(a, e) for a in articles))
        e.marked = e.parent.marked or (e.marked and not most)
    return [block for block in found if not block[0].marked]


def smooth(values: list[float]) -> list[float]:
    """Gaussian weights 1, 4, 6, 4, 1 over neighbouring blocks, those beyond the page left out."""
    weights = (1, 4, 6, 4, 1)
    out = []
    for i in range(len(values)):
        near = [(w, values[i + d]) for d, w in zip(range(-2, 3), weights, strict=True) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def within(e: Element, container: Element) -> bool:
    return container.number <= e.number <= container.last


def widened(found: list[tuple[Element, str]], picked: list[bool], article: Element, start: int, stop: int) -> tuple[int, int]:
    """The article's blocks ``start`` to ``stop`` and those of the elements around it that belong to it.

    An element around it does if all it adds are headings, chosen blocks, and short blocks of its own from a heading
    down to the article, such as a lead or a byline; the page's body has no such blocks. Nothing outside an
    article or main element belongs to it. The blocks of an element lie next to each other.
    """
    sure, waiting = (start, stop), False
    while (parent := article.parent) is not None and (parent.in_article or not article.in_article):
        low, high = start, stop
        while low and within(found[low - 1][0], parent):
            low -= 1
        while high < len(found) and within(found[high][0], parent):
            high += 1
        headed = unheaded = False
        for i in [*range(low, start), *range(stop, high)]:
            e = found[i][0]
            heading = e.name in HEADINGS
            headed = (headed or heading) and i < start
            if not heading and not picked[i]:
                if i >= stop or parent.name in ("", "html", "body") or e.parent is not parent or e.name not in ("p", "div", "time", "figcaption"):
                    return sure
                unheaded = unheaded or not headed
        # Short blocks without a heading wait for one in an element further out.
        waiting = unheaded or (waiting and not headed)
        article, start, stop = parent, low, high
        if not waiting:
            sure = start, stop
    return sure


def main_text(page: str | None) -> str:
    """The main text of one page: its blocks joined by blank lines; empty for an empty page or one without text."""
    elements, found = blocks(page or "")
    found = without_named_parts(elements, found)
    if not found:
        return ""
    totals: dict[int, list[float]] = {}
    for e, text in found:
        t = totals.setdefault(e.path, [0.0, 0.0, 0.0])
        t[0] += 1
        t[1] += len(text)
        t[2] += len(PUNCTUATION.findall(text))
    length = [totals[e.path][1] / totals[e.path][0] for e, _ in found]
    point = [1 + totals[e.path][2] / totals[e.path][0] for e, _ in found]
    lengths, points = smooth(length), smooth(point)
    fused = [a * b for a, b in zip(lengths, points, strict=True)]
    mean = sum(fused) / len(fused)
    threshold = min(math.sqrt(sum((v - mean) ** 2 for v in fused) / len(fused)), mean)
    chosen = [block for block, v in zip(found, fused, strict=True) if v >= threshold]
    # Text of chosen blocks, added up to the root; a block's own element is no container.
    total = 0
    for e, text in chosen:
        total += len(text)
        up = e.parent if (e.name in HEADINGS or e.name in ("p", "li", "pre", "blockquote", "td", "dd")) and e.parent else e
        up.chars += len(text)
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
    # Elements with most of it lie within each other; the root is one of them.
    article = max((e for e in elements if e.chars >= 0.85 * total), key=lambda e: e.depth) if chosen else None
    # Lists, quotations and table parts belong to what they stand in.
    while article is not None and article.name in ("ul", "ol", "li", "table", "tbody", "tr", "td", "blockquote", "dl", "p", "pre") and article.parent is not None and article.parent.parent is not None:
        article = article.parent
    if article is not None and article.in_article:
        while article.parent is not None and article.parent.in_article and article.name not in ("article", "main"):
            article = article.parent
    if article is None:
        return ""
    # Smoothing lends the article's weight to its neighbours; outside it a block needs weight of its own.
    picked = [v >= threshold and a * b >= threshold for v, a, b in zip(fused, length, point, strict=True)]
    inside = [i for i, (e, _) in enumerate(found) if within(e, article)]
    start, stop = widened(found, picked, article, inside[0], inside[-1] + 1)
    return "\n\n".join(text for _, text in found[start:stop])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``.

    White space inside a block becomes one space; a line break element is white space. Null and empty pages
    and pages without text have an empty text. A page is read whole, one page at a time, whatever its
    length and however deep its elements; time and memory grow in proportion to its length; repeated rows give repeated rows and an empty table an empty result.
    """
    read = F.pandas_udf(lambda texts: pd.Series([main_text(t) for t in texts], dtype=object), "string")
    out = pages.select(col(key).alias("page_id"), col(url).alias("url"), read(F.coalesce(col(html), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_tag_paths(spark, folder: str) -> DataFrame:
    from tablewright.plans.tables import table

    return extract(table(spark, folder, "pages"))

"""HTML extraction: two-pass block rules.

A page is cut into blocks of text at block tags. First pass: a block inside a boilerplate container
(menu, header, footer, sidebar, notice, advert, form, comments: by tag, role, or a word of its class
or id) is bad; a block made mostly of links is bad; a block outside the article is good if it is
long and dense in stop words, bad if it is long and has hardly any, and else undecided; inside an
article or main container a long block is good whatever its stop words. Second pass: undecided short
blocks inherit the label of the nearest decided neighbours of the same container: the one both
share, else the nearer one's, bad if both are as near; the edges of an article count as good, those of the page as bad. A
heading inherits from the block below it.

Result: the good blocks in page order, white space inside a block as one space, joined by an empty
line. Null or empty html: empty text. Cut-off or badly nested markup is read as far as it goes. Null
page_id or url: kept. Repeated rows: each gets the same result. Empty table: no rows. Other columns
are ignored.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that for it was on are as with be by at this from or an not have but they which you
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an
    le la les de des et un une du en est que pour dans qui sur pas plus par au ce
    el los las y del que en un una por con no para su al lo como más pero""".split()
)
#: Tags that part blocks, tags whose content is no text, and void tags.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary
    table tbody td tfoot th thead title tr ul""".split()
)
DROPPED_TAGS = frozenset(
    "script style noscript template textarea iframe svg math canvas audio video object select button title".split()
)
RAW_TAGS = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template"])
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog head".split())
GOOD_TAGS = frozenset(["article", "main"])
BAD_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split()
)
#: Words of a class or an id that mark a boilerplate container.
BAD_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies disqus footer form gdpr header login masthead menu menus modal nav navbar navigation
    newsletter notice notices overlay pager pagination popup promo related replies reply respond search share sharing
    sidebar signup social sponsor sponsored subscribe toolbar widget widgets""".split()
)
LONG = 70  # characters from which a block is judged by itself
LINKED = 0.5  # share of a block's characters inside links above which it is bad
STOP_GOOD, STOP_BAD = 0.20, 0.08  # shares of stop words

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)  # a comment; one that isn't closed runs to the end
      | <[!?][^>]*(?:>|$)  # doctype, processing instruction
      | <(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)(?:>|$)  # a tag; quotes may lack their end""",
    re.S | re.X,
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


_RAW_END = {tag: re.compile(rf"</{tag}\s*>|\Z", re.I) for tag in RAW_TAGS}
#: Words that mark boilerplate outside an article only: inside, they name parts of it.
PAGE_WORDS = frozenset(["header", "footer", "banner", "masthead"])


class Block:
    __slots__ = ("text", "linked", "heading", "bad", "article")

    def __init__(self, text, linked, heading, bad, article):
        self.text, self.linked, self.heading, self.bad, self.article = text, linked, heading, bad, article


def _bad_container(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BAD_TAGS or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in BAD_ROLES:
            return True
        if name in ("class", "id") and any(
            w in BAD_WORDS and not (in_article and w in PAGE_WORDS) for w in map(str.lower, _WORD.findall(value))
        ):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: tag, bad, number of the article or 0
    linked, in_link, at, articles = 0, 0, 0, 0

    def state():
        return (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def take(raw):
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len("".join(text.split()))

    def end():
        nonlocal linked
        if text := " ".join("".join(parts).split()):
            out.append(Block(text, linked, bool(stack) and stack[-1][0] in HEADINGS, *state()))
        parts.clear()
        linked = 0

    while m := _TOKEN.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue  # comment, doctype
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag in RAW_TAGS:
            at = _RAW_END[tag].search(page, at).end()
            if tag in BLOCK_TAGS:
                end()
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK_TAGS:
            end()
        if tag in VOID_TAGS or (tag not in BLOCK_TAGS and tag not in DROPPED_TAGS and tag not in ("span", "section")):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    in_link = 0 if tag in BLOCK_TAGS else in_link
                    break
            continue
        if tag in ("p", "li") and stack and stack[-1][0] == tag:
            stack.pop()  # a paragraph or list item ends the one before it
        bad, article = state()
        if tag in GOOD_TAGS and not bad and not article:
            articles += 1
            article = articles
        bad = bad or tag in DROPPED_TAGS or _bad_container(tag, m[3], bool(article))
        stack.append((tag, bad, article))
    rest = page[at:]
    take(rest)
    end()
    return out


def first_pass(b: Block) -> bool | None:
    """True: good, False: bad, None: undecided."""
    size = len(b.text) - b.text.count(" ")
    if b.bad or (size and b.linked > LINKED * size):
        return False
    words = b.text.lower().split()
    share = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(len(words), 1)
    if len(b.text) >= LONG:
        if b.article or share >= STOP_GOOD:
            return True
        return False if share < STOP_BAD else None
    return True if b.article and share >= STOP_GOOD else None


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks inherit from the nearest decided neighbours in their container."""
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None  # label, place, container
        for k in order:
            if last is None or last[2] != found[k].article:
                # a container's edge: good for an article, bad for the page
                last = (bool(found[k].article), k, found[k].article)
            side[k] = last
            # links and adverts in an article say nothing about the text around them
            if labels[k] or (labels[k] is False and not found[k].article):
                last = (labels[k], k, found[k].article)
    out = []
    for k in range(n):
        if labels[k] is not None:
            out.append(labels[k])
            continue
        (a, i, _), (b, j, _) = before[k], after[k]
        if found[k].heading and j > k:
            out.append(b)
            continue
        out.append(a if a == b else a if k - i < j - k else b if j - k < k - i else False)
    return out


def extract(page: str | None) -> str:
    found = blocks(page or "")
    labels = second_pass(found, [first_pass(b) for b in found])
    return "\n\n".join(b.text for b, good in zip(found, labels, strict=True) if good)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    @F.pandas_udf("string")
    def main_text(pages_html: pd.Series) -> pd.Series:
        return pages_html.map(extract)

    rows = pages.select("page_id", "url", main_text("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Main text of web pages: site templates and page furniture removed, the article kept.

Every element of a page gets a hash of its subtree (names, classes, texts). Spark counts per host in how many pages each
subtree occurs; pages with the same text count once, so that copies of an article make no template of it. A subtree found
in at least ``TEMPLATE_SHARE`` of the host's pages, and in ``TEMPLATE_PAGES`` at least, is deleted wherever it stands; on a host of fewer
pages, ``FEWEST_PAGES`` at least, it must stand on all of them.

Whatever is furniture by its name goes as well: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments, told by tag, role, class or id. If articles remain, the text is theirs; else that of the main
element, else that of the whole page. A header inside an article belongs to it.

Blocks are joined by one space; white space is any Unicode white space. Unclosed, crossed and stray tags are read as a
browser would, in outline. The templates of a host are few by construction (a page's elements divided by the share), so
they travel as one list per host.

Nulls and ties: a null html is empty, its text too. Pages without a host in the url have no templates. Rows that repeat
each get their result. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.llm.common import prepare, table
from fretwork.session import materialize

TEMPLATE_SHARE = 0.6
TEMPLATE_PAGES = 10
FEWEST_PAGES = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"),
}
SCOPES = frozenset("ul ol dl table select article section div body html main aside nav".split())
FURNITURE_TAGS = frozenset(
    "head nav header footer aside form script style noscript template iframe textarea title button select option menu dialog "
    "object embed svg canvas audio video map".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie "
    "cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popover popup promo promoted promotion recommended recommendations related replies respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
# Words that may stand beside those in one class name without changing its meaning.
PLACE_NAMES = frozenset(
    "area article bar block body bottom box button buttons card container content form global group icons inner item items left links list "
    "main message module outer page panel placeholder post primary reader region right row secondary section site slot space sticky text "
    "thread top unit user wrap wrapper zone".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
_UNCLOSED = re.compile(r"<[!?]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Za-z0-9]+")


class Element:
    __slots__ = ("tag", "attributes", "children", "mark")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.mark = tag, attributes, [], 0


def parse(page: str | None) -> list[Element]:
    """All elements of a page in the order of their start tags; the first is the page itself."""
    page = page or ""
    root = Element("#page")
    elements, stack, opened, at, look = [root], [root], Counter(), 0, 0
    last = page.rfind(">")
    while at < len(page):
        start = page.find("<", look)
        if start < 0 or start > last:
            # No tag can end from here on; an unclosed comment or declaration swallows the rest.
            cut = _UNCLOSED.search(page, look)
            stack[-1].children.append(page[at : cut.start() if cut else len(page)])
            break
        found = _TAG.match(page, start)
        if not found:
            look = start + 1
            continue
        if start > at:
            stack[-1].children.append(page[at:start])
        at = look = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            _close(stack, opened, (tag,), frozenset())
            continue
        if tag in CLOSES_P:
            _close(stack, opened, ("p",), SCOPES)
        if tag in SIBLINGS:
            _close(stack, opened, SIBLINGS[tag], SCOPES)
        element = Element(tag, found[3] or found[6] or "")
        elements.append(element)
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            element.children.append(page[at : end.start() if end else len(page)])
            at = look = end.end() if end else len(page)
        elif tag not in VOID:
            stack.append(element)
            opened[tag] += 1
    return elements


def _close(stack: list[Element], opened: Counter, tags: tuple[str, ...], bounds: frozenset) -> None:
    """Close the innermost open element of ``tags`` and all inside it, unless one of ``bounds`` is met first.

    ``opened`` counts the open elements by tag, so that an end tag without a start costs nothing.
    """
    if not any(opened[t] for t in tags):
        return
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            for element in stack[depth:]:
                opened[element.tag] -= 1
            del stack[depth:]
            return
        if stack[depth].tag in bounds:
            return


def mark(elements: list[Element]) -> None:
    """Give each element the hash of its subtree."""
    for element in reversed(elements):
        own = [element.tag, element.attributes]
        own += [str(c.mark) if isinstance(c, Element) else " ".join(c.split()) for c in element.children]
        element.mark = xxhash.xxh64_intdigest("\x00".join(own)) - (1 << 63)


def _furniture(element: Element, in_article: bool) -> bool:
    if element.tag in FURNITURE_TAGS:
        return not (in_article and element.tag == "header")
    if not element.attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(element.attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in FURNITURE_ROLES:
            return True
        if name in ("class", "id") and element.tag not in ("html", "body", "main"):
            for word in value.split():
                parts = set(_NAME.findall(word)) - PLACE_NAMES
                if parts and parts <= FURNITURE_NAMES and not (in_article and parts == {"header"}):
                    return True
    return False


def _main_elements(root: Element, gone: frozenset) -> list[Element]:
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            element = stack.pop()
            if element.mark in gone or _furniture(element, False):
                continue
            if element.tag == tag:
                found.append(element)
            else:
                stack.extend(c for c in reversed(element.children) if isinstance(c, Element))
        if found:
            return found
    return [root]


def main_text(elements: list[Element], gone: frozenset = frozenset()) -> str:
    """Text of the article, without subtrees whose hash is in ``gone``."""
    parts = []
    for top in _main_elements(elements[0], gone):
        in_article = top.tag == "article"
        stack: list = [" ", top, " "]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(entities.unescape(item) if "&" in item else item)
                continue
            edge = [] if item.tag in INLINE or item.tag in RAW else [" "]
            if item is top or not (item.mark in gone or _furniture(item, in_article)):
                stack.extend([*edge, *reversed(item.children), *edge])
            else:
                parts.extend(edge)
    return " ".join("".join(parts).split())


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def templates(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """(host, marks): the subtree hashes that make up the template of each host."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hosts, marks, texts = [], [], []
            for host, page in zip(frame["host"], frame["html"], strict=True):
                elements = parse(page)
                mark(elements)
                text = xxhash.xxh64_intdigest(main_text(elements)) - (1 << 63)
                found = {e.mark for e in elements if e.tag not in ("#page", "html", "body", "article", "main") and e.children}
                # Under mark 0 every page counts, for the number of pages of its host.
                for value in (0, *found):
                    hosts.append(host)
                    marks.append(value)
                    texts.append(text)
            yield pd.DataFrame({"host": hosts, "mark": marks, "page": texts}).drop_duplicates()

    rows = pages.select(host_of().alias("host"), "html").where("host <> ''")
    seen = rows.mapInPandas(run, "host string, mark long, page long").distinct()
    counts = seen.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEWEST_PAGES)
    counts = materialize(counts, "page-subtrees")
    sizes = counts.where("mark = 0").select("host", F.col("n").alias("pages"))
    needed = F.greatest(F.least(F.lit(least), F.col("pages")), share * F.col("pages"))
    found = counts.where("mark <> 0").join(sizes, "host").where(F.col("n") >= needed)
    return found.groupBy("host").agg(F.collect_list("mark").alias("marks"))


def extract(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html)."""
    prepare(pages.sparkSession)
    found = materialize(templates(pages, share, least), "page-templates").withColumnRenamed("host", "_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, gone in zip(batch.column("html").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                elements = parse(page)
                if gone:
                    mark(elements)
                texts.append(main_text(elements, frozenset(gone or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html", host_of().alias("_at"))
    rows = rows.join(found, rows["_at"] == found["_host"], "left").select("page_id", "url", "html", "marks")
    kind = pages.select("page_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))

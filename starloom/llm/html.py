"""Main text of web pages: subtrees that recur across a host's pages are removed, then what the markup names as surroundings."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.urls import url_host
from starloom.session import durable

LEAST_PAGES = 8  # of a host, for a template; a passage that fewer pages share is text
BROADCAST_TEMPLATES = 500_000  # hashes of 8 bytes: 4 MB at most; more are joined by shuffling
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|(\bhidden\b)""")
# Fixed names of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# What surrounds an article, by element, role, and word of a class or id.
OUTSIDE = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg canvas object audio video dialog menu title search".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe sidebar navbar nav navigation menu breadcrumb breadcrumbs pagination footer comment comments commentlist respond disqus reply replies".split()
)
# Compound names of layouts: no-sidebar, page-with-banner, content-sidebar-wrap.
LAYOUT_BEFORE = frozenset("no not has have with without".split())
LAYOUT_LAST = frozenset("wrap wrapper layout".split())
WORD = re.compile(r"[^a-z0-9]+")


@dataclass
class Node:
    """An open element: whether its text counts, what it held when it opened, and the running hash of its subtree."""

    tag: str
    skip: bool
    named: tuple[int, ...]  # numbers of the elements around it, itself included, that a word of a class or id names surroundings
    article: int  # articles around the element, itself included
    main: int
    blocks: int
    inline: int
    hashed: xxhash.xxh3_64 | None
    text: bool = False
    holds: bool = False  # an article or main element is in it


@dataclass
class Page:
    """Subtree hashes of a page, and its blocks of text: (text, in an article, in a main element)."""

    subtrees: set[int] = field(default_factory=set)
    blocks: list[tuple[str, bool, bool]] = field(default_factory=list)
    around_main: set[int] = field(default_factory=set)  # elements named surroundings that hold a main element
    articles: list[list] = field(default_factory=list)  # outermost articles that do not count: elements named surroundings around it, characters


def _names_surroundings(value: str) -> bool:
    """Whether a name of a class or id has a word of ``OUTSIDE_WORDS``, other than in the compound name of a layout."""
    if OUTSIDE_WORDS.isdisjoint(WORD.split(value)):
        return False
    for name in value.split():
        words = [w for w in WORD.split(name) if w]
        if not words or words[-1] in LAYOUT_LAST:
            continue
        for word in words:
            if word in LAYOUT_BEFORE:
                break
            if word in OUTSIDE_WORDS:
                return True
    return False


def _outside(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no text of the page by its kind, role or being hidden; and whether a word of a class or id says so."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True, False
    named = False
    if not attributes.strip():
        return False, False
    for m in ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5]).lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True, False
        if name == "role" and value.strip() in OUTSIDE_ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("body", "html", "article", "main", "header") and _names_surroundings(value):
            named = True
    return False, named


def parse_page(source: str | None, templates: frozenset[int] | set[int] = frozenset()) -> Page:
    """Read a page, and once more if a word of a class or id would take its main element or its chief article.

    Elements that a word names surroundings count nevertheless if they hold a main element or the chief article: where no article
    outside them has text, the longest of theirs, if it is longer than all the text that counts without it.
    """
    page = read_page(source, templates)
    lifted = page.around_main
    if lifted:
        page = read_page(source, templates, lifted)
    if page.articles and not any(b[1] for b in page.blocks):
        named, chars = max(page.articles, key=lambda a: a[1])
        if chars > sum(len(b[0]) for b in page.blocks):
            page = read_page(source, templates, lifted | set(named))
    return page


def read_page(source: str | None, templates: frozenset[int] | set[int] = frozenset(), lifted: frozenset[int] | set[int] = frozenset()) -> Page:
    """Read a page once, with repairs for what is not closed. The elements whose numbers are ``lifted`` count whatever their class or id says.

    Subtrees of elements outside any article or main element, and with none in them, are hashed by their tags and their text (not their
    addresses). A subtree whose hash is in ``templates`` is deleted. Text in an article's ``header`` counts only in headings.
    """
    page = Page()
    stack = [Node("", False, (), 0, 0, 0, 0, xxhash.xxh3_64())]
    number = 0
    inline: list[str] = []
    source = source or ""

    def flush() -> None:
        if inline:
            text = " ".join("".join(inline).split())
            inline.clear()
            if text:
                page.blocks.append((text, stack[-1].article > 0, stack[-1].main > 0))

    def close() -> None:
        node = stack[-1]
        if node.tag in BLOCK:
            flush()
        stack.pop()
        if node.hashed is None or node.holds:
            stack[-1].holds = True  # what surrounds an article is no template, however alike the rest of it is
            return
        if stack[-1].hashed is not None:
            stack[-1].hashed.update(node.hashed.digest())
            stack[-1].text |= node.text
        if node.text and not node.skip and node.tag in BLOCK:
            value = node.hashed.intdigest() - (1 << 63)
            page.subtrees.add(value)
            if value in templates:
                del page.blocks[node.blocks :]

    def text(raw: str) -> None:
        node = stack[-1]
        if "&" in raw:
            raw = entities.unescape(raw)
        if node.hashed is not None and (bare := raw.strip()):
            node.hashed.update(bare.encode("utf-8", "surrogatepass"))
            node.hashed.update(b"\x00")
            node.text = True
        if node.skip:
            return
        if not node.named:
            inline.append(raw)
        elif node.article and page.articles and page.articles[-1][0] == node.named:
            page.articles[-1][1] += len(" ".join(raw.split()))

    def open_tag(tag: str, attributes: str) -> None:
        nonlocal number
        if tag in BLOCK:
            for at in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[at].tag == "p" or (tag == "body" and stack[at].tag == "head"):
                    while len(stack) > at:
                        close()
                    break
                if stack[at].tag in BLOCK and stack[at].tag != "head":
                    break
        if tag in CLOSED_BY_ITSELF:
            alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in alike:
                    while len(stack) > at:
                        close()
                    break
                if stack[at].tag in CLOSED_BY_ITSELF[tag]:
                    break
        if tag in BLOCK:
            flush()
        elif tag == "br" and not stack[-1].skip and not stack[-1].named:
            inline.append(" ")
        above = stack[-1]
        if tag in VOID:
            return
        article, main = above.article + (tag == "article"), above.main + (tag == "main")
        number += 1
        outside, word = _outside(tag, attributes, above.article > 0)
        skip, named = above.skip or outside, above.named
        if word and number not in lifted:
            named += (number,)
        if named and not skip:
            if tag == "main":
                page.around_main.update(named)
            elif tag == "article" and not above.article:
                page.articles.append([named, 0])
        if tag == "header" and not above.skip and above.article:
            skip = True
        if tag in HEADINGS and above.tag in ("header", "hgroup") and above.article and not any(n.skip and n.tag != "header" for n in stack):
            skip = False
        hashed = None
        if above.hashed is not None and not article and not main:
            hashed = xxhash.xxh3_64(tag.encode("utf-8", "surrogatepass"))
        stack.append(Node(tag, skip, named, article, main, len(page.blocks), len(inline), hashed))

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag == tag:
                    while len(stack) > place:
                        close()
                    break
            continue
        open_tag(tag, m[3])
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]|\Z", re.I).search(source, at)
            at = source.find(">", stop.start()) + 1 or end if stop.group() else end
            stack.pop()  # what it holds is no text of the page
    while len(stack) > 1:
        close()
    flush()
    return page


def main_text(page: Page) -> str:
    """The blocks of the article, or else of the main element, or else of all that is left, one to a line."""
    for place in (1, 2):
        chosen = [b[0] for b in page.blocks if b[place]]
        if chosen:
            return "\n".join(chosen)
    return "\n".join(b[0] for b in page.blocks)


def subtree_pages(pages: DataFrame) -> DataFrame:
    """host, page (hash of the whole source), subtree: one row per page and different subtree.

    ``pages`` has host, page and html. Subtrees whose text never counts (navigation, scripts, what is hidden) have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, subtrees = [], [], []
            for host, key, source in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                found = read_page(source).subtrees
                hosts += [host] * len(found)
                keys += [key] * len(found)
                subtrees += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(subtrees, pa.int64())], ["host", "page", "subtree"])

    return pages.select("host", "page", "html").mapInArrow(run, "host string, page long, subtree long").distinct()


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host and subtree (hash): one row per subtree on ``least_pages`` or more different pages of the host, however many pages the host has.

    ``pages`` has host, page and html. Pages of equal source count once, so that copies of a page are no template.
    """
    return subtree_pages(pages).groupBy("host", "subtree").agg(F.count("*").alias("c")).where(F.col("c") >= least_pages).select("host", "subtree")


def extract_main_text(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    First, element subtrees that recur on a host (``site_templates``) are deleted, outside article and main elements.
    From what is left, elements that name themselves surroundings are dropped (by a word of a class or id only if the main element
    or the chief article is not in them, see ``parse_page``), and the text of the article (or the
    main element, or the whole page) is read: character references decoded, white space inside a block made one
    space, blocks joined by a line break. Empty text if there is none. A null html is empty, a null or malformed url has the empty host; repeated
    rows give equal rows. Other columns are ignored.

    The pages are read twice and never shuffled while the templates are few enough to be broadcast, as an array per host. Beyond that, the templates
    stay rows and are joined to the subtrees of each page (a third reading), so that a page gets only its own; the pages are then shuffled once.
    """
    keyed = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"))
    templates = durable(site_templates(keyed, least_pages))
    if templates.count() <= BROADCAST_TEMPLATES:
        source = keyed.join(F.broadcast(templates.groupBy("host").agg(F.collect_list("subtree").alias("templates"))), "host", "left")
    else:
        own = subtree_pages(keyed).join(templates, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_list("subtree").alias("templates"))
        source = keyed.join(own, ["host", "page"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, hashes in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist()):
                texts.append(main_text(parse_page(source, set(hashes or ()))))
            columns = [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return source.select("page_id", "url", "html", "templates").mapInArrow(run, "page_id long, url string, text string, n_chars long")

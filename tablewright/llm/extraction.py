"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator, Set
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: What stands around the densest part is link-dense, and no text, if more than this part of its characters are links.
LINK_SHARE = 0.5

# Names from the HTML standard, and words that sites use in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg button select option textarea input dialog object canvas audio video head title menu".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
CLOSE_LIMITS = frozenset("ul ol dl table tbody thead tfoot select body html article section div".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget "
    "footer header masthead topbar comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login social share sharing related recommended toolbar pagination pager legal copyright disclaimer form search skip hidden".split())
CONTENT = frozenset("content article main post entry story body text page".split())
ALWAYS_NOISE = frozenset("ad ads advert adverts advertisement comment comments cookie consent newsletter".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|svg)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Elements in page order, and the pieces of text (or breaks) with the element they stand in."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    noise: list[bool] = field(default_factory=lambda: [False])
    pieces: list[tuple[int, str]] = field(default_factory=list)


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            words = set(_NAME.findall(value))
            if words & ALWAYS_NOISE or (words & NOISE and not words & CONTENT):
                return True
    return False


def parse(source: str) -> Page:
    """A forgiving parse: end tags close up to their start, those without one are passed over, open elements end where HTML says."""
    page, stack, at = Page(), [0], 0

    def text(piece: str) -> None:
        if piece:
            page.pieces.append((stack[-1], html.unescape(piece) if "&" in piece else piece))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if page.tag[node] not in INLINE:
                page.pieces.append((page.parent[node], " "))

    for m in _TOKEN.finditer(source):
        text(source[at:m.start()])
        at = m.end()
        closing, tag, attributes = m[2], (m[3] or "").lower(), m[4] or ""
        if not tag:
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] == tag:
                    pop_to(depth)
                    break
            continue
        closes = CLOSES.get(tag)
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = page.tag[stack[depth]]
            if (closes and open_tag in closes) or (tag in ENDS_P and open_tag == "p"):
                pop_to(depth)
                break
            if open_tag in CLOSE_LIMITS:
                break
        if tag not in INLINE:
            page.pieces.append((stack[-1], " "))
        if tag in VOID:
            continue
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.noise.append(page.noise[stack[-1]] or _is_noise(tag, attributes, any(page.tag[n] == "article" for n in stack)))
        if not attributes.endswith("/"):
            stack.append(len(page.parent) - 1)
    text(source[at:])
    return page


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters per tag, less where much of them are links."""
    if not chars:
        return 0.0
    tags, link_chars, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_ratio * chars + math.e)
    value = chars / link_chars * tags / link_tags
    return chars / tags * math.log(max(value, 1.0 + 1e-9)) / math.log(max(base, 1.0 + 1e-9))


def _text(page: Page, first: int, last: int, left_out: Set[int] = frozenset()) -> str:
    """The text of the elements ``first`` to ``last``, without noise and those ``left_out``."""
    return " ".join("".join(piece for node, piece in page.pieces if first <= node <= last and not page.noise[node] and node not in left_out).split())


def main_text(source: str | None) -> str:
    """The article of a page: blocks in page order, white space as one space; empty if there is none.

    Elements whose name, role, class or id says that they are no article are left out first. If one article or main element is left, all of
    its text is the article. On other pages every element gets a composite density, and the sum of its children's (with its own text as one of
    them). From the element with the largest sum, the least density on its path to the body is the threshold; elements above it add the largest
    sum below them, and the smallest subtree with all of these is the article, along with what stands around it up to the body, of any size.
    Only where an ancestor adds mostly links, those of its children that are mostly links are left out.
    """
    if not source:
        return ""
    page = parse(source)
    count = len(page.parent)
    chars, tags, link_chars, link_tags = [0] * count, [1] * count, [0] * count, [0] * count
    own, last = [0] * count, list(range(count))
    for node, piece in page.pieces:
        if not page.noise[node] and piece != " ":
            own[node] += len(" ".join(piece.split()))
    for n in range(count - 1, -1, -1):
        chars[n] += own[n]
        if page.noise[n]:
            tags[n] = 0
        elif page.tag[n] == "a":
            link_chars[n], link_tags[n] = chars[n], link_tags[n] + 1
        if (p := page.parent[n]) >= 0:
            last[p] = max(last[p], last[n])
            if not page.noise[n]:
                chars[p] += chars[n]
                tags[p] += tags[n]
                link_chars[p] += link_chars[n]
                link_tags[p] += link_tags[n]
    articles = [n for n in range(count) if page.tag[n] in ("article", "main") and not page.noise[n] and chars[n]]
    outer = [n for n in articles if not any(m != n and m < n <= last[m] for m in articles)]
    bodies = [n for n in range(count) if page.tag[n] == "body"]
    root = outer[0] if len(outer) == 1 else bodies[0] if bodies else 0
    if not chars[root]:
        root = 0
    if not chars[root]:
        return ""
    if root in outer:
        return _text(page, root, last[root])
    ratio = link_chars[root] / chars[root]
    density = [_density(chars[n], tags[n], link_chars[n], link_tags[n], ratio) for n in range(count)]
    sums = [_density(own[n], 1, 0, 0, ratio) for n in range(count)]
    best = list(range(count))
    for n in range(count - 1, root, -1):
        if not page.noise[n]:
            sums[page.parent[n]] += density[n]
    for n in range(count - 1, root, -1):
        p = page.parent[n]
        if not page.noise[n] and sums[best[n]] > sums[best[p]]:
            best[p] = best[n]
    path, n = [], best[root]
    while n != page.parent[root]:
        path.append(n)
        n = page.parent[n]
    threshold = min(density[n] for n in path)
    chosen = {best[n] for n in range(root, last[root] + 1) if not page.noise[n] and density[n] >= threshold}
    top = min(chosen)
    while not all(top <= n <= last[top] for n in chosen):
        top = page.parent[top]
    inner: dict[int, int] = {}
    while top != root:
        up = page.parent[top]
        if link_chars[up] - link_chars[top] > LINK_SHARE * (chars[up] - chars[top]):
            inner[up] = top
        top = up
    left_out: set[int] = set()
    for n in range(root + 1, last[root] + 1):
        p = page.parent[n]
        if p in left_out or (inner.get(p, n) != n and link_chars[n] > LINK_SHARE * chars[n]):
            left_out.add(n)
    return _text(page, root, last[root], left_out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; NULL html gives an empty text, equal rows have a row each."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(source.as_py()) for source in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.selectExpr("CAST(page_id AS bigint) AS page_id", "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")

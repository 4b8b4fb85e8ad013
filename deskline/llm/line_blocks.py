"""Main text of web pages by the distribution of text over lines.

Markup is stripped in one pass that leaves one line per block of text and takes
out what is no article text (menus, adverts, forms ...).  Such parts, the edges of
article and main and a window of lines without weight separate stretches of
lines.  Text lengths are summed over a sliding window of lines; a stretch counts
where the sum surges above a bound that the page's fullest window sets, and all
its lines are kept whole up to where the weight dives to nothing.  Lines weigh
less on the side of article and main (inside or outside) that has less of the
page's text.  Parts that were taken out do not cut a text in two: shorter
stretches between those that count or under the same element as one, and headings
before the first, are kept too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.llm.frames import mapped

WINDOW = 3  # lines
SURGE = 80  # characters in a window at least, or
SURGE_SHARE = 0.25  # of the page's fullest window, if that is less
FEW = 60  # characters of text that a list of buttons may have
MAX_LINK_SHARE = 0.5  # of a line outside articles; more is a menu

_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements whose text is never the article's.  Without an end tag the first two go on to the end of the page, the others to the next block.
_SCRIPTS = {"script", "style"}
_SKIPPED = _SCRIPTS | set("noscript template textarea title iframe svg math select button object canvas audio video".split())
_PARTS = {"nav", "footer", "aside", "form", "menu", "dialog"}
_PARTS_OUTSIDE = {"header"}
_CONTAINERS = {"div", "section", "aside", "ul", "ol", "dl", "p", "span", "table", "li", "header", "figure", "a", "details"}
_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner "
    "popup modal overlay newsletter subscribe signup sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer footnav "
    "copyright share sharing social related recommended recommendations comment comments commentlist respond replies reply disqus pagination pager toolbar".split()
)
# Of these names the part is taken out however much text it has.
_COMMENTS = {"comment", "comments", "commentlist", "respond", "replies", "reply", "disqus"}
# These are lists of links or buttons; a part of that name with other text is none of them.
_LINK_LISTS = {"share", "sharing", "social", "related", "recommended", "recommendations", "widget"}
_NAMES_OUTSIDE = {"header", "masthead", "topbar", "search", "login", "hidden", "side", "skip"}
_ARTICLES = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_LEAVES = _HEADINGS | {"p", "br", "hr"}  # hold no other blocks

_MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
# Attributes up to the tag's end.  A quoted value with a "<" in it is read within LONG characters: what never
# ends must not be read to the end of the page from each tag anew.
_ATTRIBUTES = re.compile(r"""((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""")
_ATTRIBUTES_LONG = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_UP_TO_TAG = re.compile(r"[^<>]*+>?")
LONG = 2048
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCKS))})\b", re.I)


class Token(NamedTuple):
    start: int
    stop: int
    tag: str  # "" for what is no tag, or an element that is skipped whole
    closing: bool
    attributes: str


def tokens_of(page: str) -> list[Token]:
    """The tags of a page in one scan from its beginning to its end."""
    found: list[Token] = []
    last_end: dict[str, int] = {}  # where the last end tag of a skipped element is
    lower = page.lower()
    if len(lower) != len(page):  # a few letters grow when folded; places have to stay the same
        lower = "".join(c.lower() if c.isascii() else c for c in page)
    head: int | None = None  # where the head that is being skipped began
    at = 0
    while mark := _MARK.search(page, at):
        start, at = mark.start(), mark.end()
        if head is not None and mark[3]:  # its end tag may be left out
            tag = mark[3].lower()
            if tag == "head" and mark[2]:
                head_end = at = _UP_TO_TAG.match(page, at).end()
            elif tag in _BLOCKS - {"html", "head"} and not mark[2]:
                head_end = start
            else:
                head_end = None
            if head_end is not None:
                found.append(Token(head, head_end, "", False, ""))
                head = None
                if head_end == at:
                    continue
        if mark[1]:
            stop = page.find("-->", at)
            at = len(page) if stop < 0 else stop + 3
            if head is None:
                found.append(Token(start, at, "", False, ""))
            continue
        rest = None
        if mark[3]:
            rest = _ATTRIBUTES.match(page, at) or _ATTRIBUTES_LONG.match(page, at, min(len(page), at + LONG))
        attributes = rest[1] if rest else ""
        at = rest.end() if rest else _UP_TO_TAG.match(page, at).end()
        tag, closing = (mark[3] or "").lower(), bool(mark[2])
        if tag == "head" and not closing:
            head = start if head is None else head
            continue
        if closing or attributes.endswith("/") or tag not in _SKIPPED:
            if head is None:
                found.append(Token(start, at, tag if tag not in _SKIPPED else "", closing, attributes))
            continue
        if tag not in last_end:
            last_end[tag] = lower.rfind(f"</{tag}")
        if last_end[tag] >= at:
            at = _UP_TO_TAG.match(page, lower.index(f"</{tag}", at) + 1).end()
        else:
            end = None if tag in _SCRIPTS else _BLOCK.search(page, at)
            at = end.start() if end else len(page)
        if head is None:
            found.append(Token(start, at, "", False, ""))
    if head is not None:
        found.append(Token(head, len(page), "", False, ""))
    return found


_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def _is_part(tag: str, attributes: str, inside: bool, most: bool, linked: bool) -> bool:
    """Whether an element is taken out; `most`: it has most of the page's text; `linked`: most of its own is in links, or there is little."""
    if tag in _PARTS or (tag in _PARTS_OUTSIDE and not inside):
        return True
    if tag not in _CONTAINERS or not attributes:
        return False
    if _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", lambda m: m[0] if "none" in m[0] or "true" in m[0] else '""', attributes)):
        return True
    words = {w for value in _ATTRIBUTE.findall(attributes) for w in _WORD.findall(value.lower())}
    if words & _COMMENTS:
        return True
    if most:
        return False
    named = words & _NAMES
    return bool(named if linked else named - _LINK_LISTS) or (not inside and bool(words & _NAMES_OUTSIDE))


class Line(NamedTuple):
    text: str
    linked: int  # characters of it in links
    inside: bool  # an article
    heading: bool
    parent: int  # number of the element around the block
    apart: bool  # something was taken out before it


def _ends(tokens: list[Token]) -> dict[int, int]:
    """The token that ends an element, by the one that begins it; not of unclosed elements."""
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for i, token in enumerate(tokens):
        tag = token.tag
        if tag and not token.closing:
            if not token.attributes.endswith("/"):
                begun.setdefault(tag, []).append(i)
        elif begun.get(tag):
            ends[begun[tag].pop()] = i
    return ends


def _sizes(page: str, tokens: list[Token]) -> tuple[list[int], list[int]]:
    """How many characters of text, and of text in links, come before each token and before the end."""
    size, in_links = [], []
    text = linked = depth = at = 0
    for token in tokens:
        n = len("".join(page[at : token.start].split()))
        at = token.stop
        text += n
        linked += n if depth else 0
        if token.tag == "a":
            depth = 0 if token.closing else 1
        size.append(text)
        in_links.append(linked)
    n = len("".join(page[at:].split()))
    return [*size, text + n], [*in_links, linked + (n if depth else 0)]


def lines_of(page: str, whole_parts: bool = True) -> list[Line]:
    """The lines of text.  A part is left out up to its own end; without one, up to where an article begins or ends.

    whole_parts: False ends every part at the next article, for pages that have all their text in a part.
    """
    lines: list[Line] = []
    text: list[str] = []
    linked = 0
    articles = links = 0
    apart, heading = False, False
    open_: list[tuple[str, int]] = [("", 0)]
    count: Counter[str] = Counter()
    tokens = tokens_of(page)
    ends = _ends(tokens)
    size, in_links = _sizes(page, tokens)
    marks = [i for i, token in enumerate(tokens) if token.tag in _ARTICLES]
    limits = [len(tokens)]  # where the open articles end; no part in one goes on beyond it
    until = -1  # the token that ends the part being left out
    part = False  # in one without an end

    def end() -> None:
        nonlocal linked, apart
        whole = " ".join("".join(text).split())
        if whole:
            lines.append(Line(whole, linked, articles > 0, heading, open_[-1][1], apart))
            apart = False
        text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not part:
            plain = html.unescape(raw)
            text.append(plain)
            if links:
                linked += len(plain)

    at = 0
    for i, token in enumerate(tokens):
        if i <= until:
            at = token.stop
            continue
        add(page[at : token.start])
        at = token.stop
        tag = token.tag
        if not tag:
            continue
        closing = token.closing
        if part:
            if not (tag in _ARTICLES and closing == (articles > 0)):
                continue
            part = False
        attributes = token.attributes
        stop = ends.get(i, len(tokens))
        own = size[stop] - size[i]
        linked_part = own < FEW or 2 * (in_links[stop] - in_links[i]) > own
        if not closing and not attributes.endswith("/") and _is_part(tag, attributes, articles > 0, 2 * own > size[-1], linked_part):
            if tag in _BLOCKS:
                end()
                apart = True
            if stop >= limits[-1] or (not whole_parts and bisect_right(marks, i) < bisect_right(marks, stop)):
                part = True
            else:
                until = stop
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag in _BLOCKS:
            end()
            links = 0
            heading = tag in _HEADINGS and not closing
            if tag in _ARTICLES:
                articles = max(0, articles + (-1 if closing else 1))
                if not closing:
                    limits.append(min(limits[-1], ends.get(i, len(tokens))))
                elif len(limits) > 1:
                    limits.pop()
            if tag not in _LEAVES and not attributes.endswith("/"):
                if not closing:
                    open_.append((tag, i + 1))
                    count[tag] += 1
                elif count[tag]:
                    while True:
                        last, _ = open_.pop()
                        count[last] -= 1
                        if last == tag:
                            break
    add(page[at:])
    end()
    return lines


def _stretches(lines: list[Line], weights: list[float]) -> list[tuple[int, int]]:
    """(first, stop) of the lines that go together; a stretch begins and ends with a line that weighs something."""
    found: list[tuple[int, int]] = []
    for i, (line, weight) in enumerate(zip(lines, weights)):
        if not weight:
            continue
        if found:
            first, stop = found[-1]
            if i - stop < WINDOW and lines[first].inside == line.inside and not any(x.apart for x in lines[stop : i + 1]):
                found[-1] = first, i + 1
                continue
        found.append((i, i + 1))
    return found


def _main_lines(lines: list[Line]) -> list[Line]:
    body = [0 if not x.inside and x.linked > MAX_LINK_SHARE * len(x.text) else len(x.text) for x in lines]
    sides = [sum(n for x, n in zip(lines, body) if x.inside == side) for side in (False, True)]
    factor = [min(1.0, sides[side] / max(sides[not side], 1)) for side in (False, True)]
    weights = [n * factor[x.inside] for x, n in zip(lines, body)]
    stretches = _stretches(lines, weights)
    fullest = [max(sum(weights[i : min(i + WINDOW, stop)]) for i in range(first, stop)) for first, stop in stretches]
    surge = min(SURGE, SURGE_SHARE * max(fullest, default=0))
    counts = [k for k, most in enumerate(fullest) if most >= surge]
    if not counts:
        return []
    parents = {x.parent for k in counts for x in lines[slice(*stretches[k])]}
    kept: list[Line] = []
    for k, (first, stop) in enumerate(stretches):
        own = lines[first:stop]
        if k not in counts and not counts[0] < k < counts[-1]:
            own = [x for x in own if x.parent in parents or (x.heading and k == counts[0] - 1)]
        if k and k - 1 >= counts[0] and k <= counts[-1]:  # linked lines in the middle of one element's text
            own = [x for x in lines[stretches[k - 1][1] : first] if x.parent in parents] + own
        kept += own
    return kept


def main_text(page: str | None) -> str:
    kept = _main_lines(lines_of(page)) if page else []
    if page and not kept:
        kept = _main_lines(lines_of(page, whole_parts=False))
    return "\n".join(x.text for x in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` per page; n_chars counts code points.

    A null or empty page, or one without text, has the empty text.  Broken or cut
    off markup is read as far as it goes.  Every row gives one row; columns besides
    page_id, url, html are ignored.
    """

    def extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    own = pages.select("page_id", "url", "html")
    schema = own.drop("html").limit(0).withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("long")}).schema
    return mapped(own, extract, schema)

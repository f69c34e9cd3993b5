"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: its length, the
share of stop words, the share of its characters inside links, and the element it stands in. Blocks in menu
and form elements, readers' comments and blocks of links are boilerplate; long enough prose is content; what is
too short or has too few stop words stays undecided. Names that hint at boilerplate (class, id, role) are
evidence: long dense prose with few links outvotes them (not those of adverts and cookie or newsletter notices), and
so does an element that holds most of the page's prose. The second pass lets undecided blocks inherit from the nearest decided blocks on either side, first of
all those of the same article element. Article elements count only where they hold most of the page's prose;
long dense prose outside of them is content even then.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.llm.common import bounded_batches, chunks

# Frequent function words.
STOP_WORDS = {
    "en": "the of and to in a is that it for was with be on by at are this from as have or an not which his he but they you we had her she their were been has".split(),
    "fr": "le la les de des du un une et en est que qui dans pour sur au aux par il elle pas plus avec ce cette se sont ou mais son sa ses à d l".split(),
    "de": "der die das und in zu den von mit ist im für auf nicht ein eine einer es dem des sich als auch an er sie wird sind bei aus nach wie".split(),
    "es": "el la los las de del y en que un una es por con para se no su al lo como más o pero sus le ha este esta son entre".split(),
}

# Elements by what they mean for the text.
HIDDEN = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "map", "title"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "textarea", "label", "fieldset", "dialog", "menu"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "textarea", "tfoot",
    "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ARTICLE = {"article", "main"}
HINTS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination sidebar "
    "side footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social follow "
    "related recommended widget copyright legal disclaimer header".split())
READERS = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "discussion"}
# What stands in readers' comments besides.
READER_PARTS = {"comment", "comments", "commentlist"}, set("author avatar body children content count date entry footer form header holder meta metadata text time title tree".split())
# Hints that prose does not outvote, however long: only what holds most of the page's prose does.
FIRM = set("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors cookie cookies consent gdpr newsletter popup".split())
# Words that say nothing beside a hint: "related-posts" hints as "related" does, "page-header" or "has-sidebar" do not.
NEUTRAL = set("area bar block bottom box button buttons container icons inner item items left links list module outer panel post posts right section site slot thread top unit user wrap wrapper".split())

LEAST_WORDS = 8
LEAST_STOP_SHARE = 0.12
MOST_LINK_SHARE = 0.4
# What prose must have to outvote a hint or an article elsewhere on the page.
STRONG_WORDS = 40
STRONG_STOP_SHARE = 0.2
STRONG_LINK_SHARE = 0.1
# Characters of prose from which an element can be what the page is about.
LEAST_HELD = 200
# Nested hinting elements that are told apart; any deeper ones count with these.
MOST_HINTS = 16

_STOP = {k: frozenset(v) for k, v in STOP_WORDS.items()}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attr>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HINT_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

GOOD, BAD, OPEN = 1, 0, -1
WEAK, STRONG = 1, 2
_FOREIGN = {"svg", "math"}


class Block:
    __slots__ = ("text", "linked", "article", "hints", "firm", "label")

    def __init__(self, text: str, linked: int, article: int, boilerplate: bool, hints: tuple[int, ...] = (), firm: tuple[int, ...] = ()):
        self.text, self.linked, self.article, self.hints, self.firm = text, linked, article, hints, firm
        self.label = BAD if boilerplate else OPEN


def _hinted(attributes: str) -> str:
    """What an element's class, id or role says: ``readers``, ``firm``, ``boilerplate`` or nothing. Whole names count, not parts of them."""
    said = ""
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _HINT_WORDS.findall(name)}
            if words <= HINTS | READERS | NEUTRAL:
                if words & READERS:
                    return "readers"
                if words & FIRM:
                    said = "firm"
                elif words & HINTS:
                    said = said or "boilerplate"
            elif words & READER_PARTS[0] and words <= HINTS | READERS | NEUTRAL | READER_PARTS[1]:
                return "readers"
    return said


_UPPER = {c: c + 32 for c in range(65, 91)}


def _lower(page: str) -> str:
    """A-Z in lower case; every character keeps its place."""
    return page.translate(_UPPER)


def cut(page: str) -> list[Block]:
    """The blocks of a page in order, each with its white space as single spaces and references decoded."""
    blocks: list[Block] = []
    text: list[str] = []
    linked, in_link, articles, hinted = 0, 0, 0, 0
    # Open elements: (name, inside boilerplate, number of the article or 0, what the element says, numbers of the hinting elements around).
    stack: list[tuple[str, bool, int, str, tuple[int, ...]]] = []
    # Open elements that hide their text: (name, open elements around). They end with the element around them at the latest.
    hidden: list[tuple[str, int]] = []
    last_end: dict[str, int] = {}
    firm: set[int] = set()

    def close() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            top = stack[-1] if stack else ("", False, 0, "", ())
            blocks.append(Block(joined, linked, top[2], top[1], top[4], tuple(h for h in top[4] if h in firm)))
        text.clear()
        linked = 0

    def data(part: str) -> None:
        nonlocal linked
        if part and not hidden:
            text.append(part)
            if in_link:
                linked += len("".join(html.unescape(part).split()))

    at = 0
    lowered = ""
    for m in _TAG.finditer(page):
        data(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                if m["raw"].lower() == "textarea":
                    close()
            elif m.group().startswith("<![CDATA["):
                data(html.escape(m.group()[9:-3]))
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                in_link = 0
            elif name in HIDDEN:
                for i in range(len(hidden) - 1, -1, -1):
                    if hidden[i][0] == name:
                        del hidden[i:]
                        break
            elif name in BLOCKS or name in BOILERPLATE:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            while hidden and hidden[-1][1] > len(stack):
                hidden.pop()
            continue
        if name == "br":
            text.append(" ")
        elif name == "a":
            in_link = 1
        elif name == "head" or (name in HIDDEN and not (name in _FOREIGN and m["attr"].endswith("/"))):
            # An element that never ends hides nothing; a head needs no end, its first block ends it.
            if name != "head" and name not in last_end:
                lowered = lowered or _lower(page)
                last_end[name] = lowered.rfind(f"</{name}")
            if name == "head" or last_end[name] > at:
                hidden.append((name, len(stack)))
        elif name in ("body", "article", "main"):
            hidden.clear()  # a head or object left open does not hide the page
        elif hidden and hidden[0][0] == "head" and name != "html" and (name in BLOCKS or name in BOILERPLATE):
            hidden.clear()
        if name not in BLOCKS and name not in BOILERPLATE:
            continue
        close()
        if name in VOID:
            continue
        bad, article, said, hints = stack[-1][1:] if stack else (False, 0, "", ())
        own = ""
        if name in ARTICLE and not bad:
            own = _hinted(m["attr"])
            if not article:
                articles += 1
                article = articles
        elif name in BOILERPLATE or (name == "header" and not article):
            bad, said = True, "element"
        elif name not in ("html", "body") and not (name == "header" and article):
            own = _hinted(m["attr"])
        if own == "readers" and not bad:
            bad, said = True, own
        elif own in ("boilerplate", "firm") and len(hints) < MOST_HINTS:
            hinted += 1
            hints = (*hints, hinted)
            if own == "firm":
                firm.add(hinted)
        if name in ("p", "li", "dd", "dt", "option", "tr", "td", "th"):
            # These end where the next one begins, whether they were closed or not.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body"):
                    break
        stack.append((name, bad, article, said, hints))
    data(page[at:])
    close()
    return blocks


def prose(block: Block) -> int:
    """The words of a block by themselves: ``STRONG``, ``WEAK`` or 0 (not prose)."""
    words = re.findall(r"[^\W\d_]+", block.text.lower())
    if len(words) < LEAST_WORDS:
        return 0
    stops, solid = max(sum(w in stop for w in words) for stop in _STOP.values()), len(block.text) - block.text.count(" ")
    if len(words) >= STRONG_WORDS and stops >= STRONG_STOP_SHARE * len(words) and block.linked <= STRONG_LINK_SHARE * solid:
        return STRONG
    return WEAK if stops >= LEAST_STOP_SHARE * len(words) and block.linked <= MOST_LINK_SHARE * solid else 0


def decide(blocks: list[Block]) -> list[int]:
    """First pass: each block by itself, then hints and articles by what they hold of the page's prose."""
    kinds = [0 if b.label == BAD else prose(b) for b in blocks]
    out = [b.label == BAD or b.linked > MOST_LINK_SHARE * (len(b.text) - b.text.count(" ")) for b in blocks]
    # Characters of prose, and of all text that is not out, on the page and in each hinting element.
    held: dict[int, list[int]] = {0: [0, 0]}
    for b, k, gone in zip(blocks, kinds, out, strict=True):
        for h in () if gone else (0, *b.hints):
            mine = held.setdefault(h, [0, 0])
            mine[0] += len(b.text) if k else 0
            mine[1] += len(b.text)
    most = {h for h, mine in held.items() if mine[0] >= LEAST_HELD and all(2 * x > y for x, y in zip(mine, held[0], strict=True))}
    labels = []
    for b, k, gone in zip(blocks, kinds, out, strict=True):
        if gone:
            labels.append(BAD)
        elif not most.issuperset(b.firm if k == STRONG else b.hints):
            labels.append(BAD)
        else:
            labels.append(GOOD if k else OPEN)
    inside = sum(len(b.text) for b, x in zip(blocks, labels, strict=True) if x == GOOD and b.article)
    good = sum(len(b.text) for b, x in zip(blocks, labels, strict=True) if x == GOOD)
    undecided = sum(len(b.text) for b, x in zip(blocks, labels, strict=True) if x == OPEN and b.article)
    if 2 * inside < good and (inside or undecided < good):
        # The prose stands elsewhere: article elements are cards here and say nothing.
        for b in blocks:
            b.article = 0
    elif any(b.article and x != BAD for b, x in zip(blocks, labels, strict=True)):
        # Short prose outside of the article is teaser, notice or comment.
        labels = [BAD if not b.article and k != STRONG else x for b, x, k in zip(blocks, labels, kinds, strict=True)]
    return labels


def inherit(blocks: list[Block], labels: list[int]) -> list[int]:
    """Second pass: undecided blocks follow the nearest decided ones.

    Inside an article element only its own blocks count, and without any decided one it is content as a
    whole. Elsewhere the nearer of both sides wins, content on a draw between different labels only if the
    block is not at the page's edge; with an article on the page, nothing outside it becomes content this way.
    """
    out, n = labels.copy(), len(labels)
    any_article = any(b.article and x != BAD for b, x in zip(blocks, labels, strict=True))
    before, last = [None] * n, {}
    for i in range(n):
        before[i] = last.get(blocks[i].article)
        if labels[i] != OPEN:
            last[blocks[i].article] = i
    after, last = [None] * n, {}
    for i in range(n - 1, -1, -1):
        after[i] = last.get(blocks[i].article)
        if labels[i] != OPEN:
            last[blocks[i].article] = i
    for i in range(n):
        if labels[i] != OPEN:
            continue
        a, b = before[i], after[i]
        if blocks[i].article:
            near = [labels[j] for j in (a, b) if j is not None]
            out[i] = GOOD if not near or GOOD in near else BAD if all(x == BAD for x in near) and len(near) == 2 and i - a == 1 and b - i == 1 else GOOD
        elif any_article or (a is None and b is None):
            out[i] = BAD
        elif a is None or b is None:
            out[i] = labels[b if a is None else a]
        elif labels[a] == labels[b]:
            out[i] = labels[a]
        else:
            out[i] = labels[a] if i - a < b - i else labels[b] if b - i < i - a else GOOD
    return out


def main_text(page: str) -> tuple[str, int]:
    """(content blocks joined by single spaces, their number).

    A page on which nothing is content by these rules falls back to its blocks outside of boilerplate.
    """
    blocks = cut(page)
    labels = decide(blocks)
    final = inherit(blocks, labels)
    if GOOD not in final:
        final = [GOOD if x == OPEN else BAD for x in labels]
    kept = [b.text for b, x in zip(blocks, final, strict=True) if x == GOOD]
    return " ".join(kept), len(kept)


def _extract(batches):
    for batch in batches:
        at = 0
        for _, pages in chunks([batch]):
            found = [main_text(p.decode()) for p in pages]
            n = len(pages)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks"])
            at += n


def extract_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page row: page_id, url, text, n_chars (code points), n_blocks.

    A null or empty page has an empty text; text without any tag is one block. Repeated rows each get their row.
    """
    bounded_batches(pages.sparkSession)
    source = pages.select(
        F.col(f"`{key}`").cast("bigint").alias("page_id"), F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("")).cast("binary").alias("html"), F.col(f"`{url}`").cast("string").alias("url"))
    return source.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint")

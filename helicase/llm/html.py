"""Main text of web pages by scores in the tree.

Paragraphs give points for their length and commas to the containers above them, less with each step up. A
container's points are discounted by the share of its text that stands in links. An <article> or <main> goes first if it holds most
of the best container's unlinked text. The best container and its siblings of few links are kept in page order; parts that are never text (menus, forms, comments ...) are skipped. A name of
boilerplate skips no heading, no paragraph and nothing that holds the larger part of the page's unlinked text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helicase.llm.common import ship

ship(__name__)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])", re.S)

#: Elements by what they are.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = RAW | {"nav", "footer", "aside", "form", "button", "select", "option", "svg", "math", "canvas", "object", "audio", "video", "dialog", "menu", "head", "map", "applet", "fieldset", "label", "datalist", "input", "embed", "frameset"}
BLOCK = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | NEVER
PARAGRAPH = {"p", "pre", "blockquote", "td", "dd", "li", "h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINER = {"article", "main", "section", "div", "td", "body", "html", "center", "blockquote", "dl", "ul", "ol", "table", "tbody", "tr", "details"}
#: Elements that end an open <p>.
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: Words of classes, ids and roles. A name of these words (with FILLER) alone is boilerplate, in prose too.
HARD = re.compile(
    r"ads?|advert\w*|adbox|adsense|adslot|sponsor\w*|promos?|promoted|promotions?|nav|navbar|navigation|breadcrumbs?|sidebars?|widgets?|footer|comments?|commentlist|disqus|"
    r"newsletter|subscribe|signup|login|popup|modal|pagination|pager|toolbar|complementary|contentinfo|paywall|outbrain|taboola|hidden|masthead|tracking|gdpr"
)
#: Words that are topics too: boilerplate as a class or role, not as an id, which may be a section's anchor.
TOPIC = re.compile(r"menus?|share|sharing|social|related|recommend\w*|search|rail|cookies?|consent|tags|banner|overlay|reply|replies|respond|subscription|notifications?")
#: Words that say nothing about prose; what bears them goes if it is mostly links, or short and without heading and paragraph.
SOFT = re.compile(r"header|foot|discussion|notices?|alert|disclaimer|copyright")
FILLER = {
    "site", "page", "main", "top", "bottom", "left", "right", "primary", "secondary", "global", "wrapper", "wrap", "container", "box", "area", "block", "section", "list", "item", "items", "bar", "inner",
    "outer", "col", "column", "group", "slot", "unit", "panel", "post", "posts", "article", "articles", "entry", "story", "stories", "links", "buttons", "icons", "media", "form", "google", "user", "the",
}
COMMENTS = re.compile(r"comments?|commentlist|disqus")
#: Classes that, standing alone or with FILLER, make even a paragraph or heading boilerplate.
PLAIN = re.compile(r"notices?|alerts?|ads?|advert\w*|sponsor\w*|disclaimers?|announcements?|promos?")
#: Names of what readers wrote, and their companions.
VOICES, READERS = re.compile(r"comments?|commentlist|disqus|discussions?|responses|replies"), {"reader", "readers", "user", "users", "guest", "guests", "visitor", "visitors", "public", "community"}
#: Words that make a name a layout's or a state's.
MODIFIER_FIRST, MODIFIER_LAST = {"has", "no", "with", "without", "is", "not", "hide", "show", "js"}, {"enabled", "disabled", "on", "off", "open", "opened", "closed", "active", "visible", "ready", "loaded"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
GOOD = re.compile(r"article|content|entry|story|post|main|body|text|blog", re.I)


class _Node:
    __slots__ = ("tag", "parent", "children", "skip", "weight", "length", "linked", "score", "commas", "doubt", "factor")

    def __init__(self, tag, parent, skip, weight, doubt=0):
        self.tag, self.parent, self.skip, self.weight, self.doubt = tag, parent, skip, weight, doubt
        self.children, self.length, self.linked, self.score, self.commas, self.factor = [], 0, 0, 0.0, 0, 1.0


def _doubt(value: str, anchor: bool) -> int:
    """What a class, role or id (`anchor`) says: 0 nothing, 1 a word of boilerplate among others, 2 boilerplate, 3 comments, 4 a notice or advert."""
    most = 0
    for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        words = [w for w in (re.sub(r"\d+$", "", w) for w in re.split(r"[-_:]+", token)) if w]
        if not words or words[0] in MODIFIER_FIRST or words[-1] in MODIFIER_LAST:
            continue
        if token in ("side-bar", "sr-only", "skip-link"):
            most = max(most, 2)
            continue
        if not anchor and (own := [w for w in words if w not in FILLER]):
            if all(PLAIN.fullmatch(w) for w in own):
                most = max(most, 4)
                continue
            if any(VOICES.fullmatch(w) for w in own) and all(VOICES.fullmatch(w) or w in READERS for w in own):
                most = max(most, 3)
                continue
        hard = [bool(HARD.fullmatch(w) or not anchor and TOPIC.fullmatch(w)) for w in words]
        if any(hard) and all(h or w in FILLER or TOPIC.fullmatch(w) or SOFT.fullmatch(w) for w, h in zip(words, hard)):
            most = max(most, 3 if any(COMMENTS.fullmatch(w) for w in words) else 2)
        elif any(h or TOPIC.fullmatch(w) or SOFT.fullmatch(w) for w, h in zip(words, hard)):
            most = max(most, 1)
    return most


def _open(tag: str, attrs: str, parent: _Node) -> _Node:
    skip, weight, doubt = tag in NEVER, 0.0, 0
    if attrs.strip(" /\t\r\n"):
        names = ""
        for m in ATTRIBUTE.finditer(attrs):
            key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                names += " " + value
                doubt = max(doubt, _doubt(value, key == "id"))
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                skip = True
        if tag in ("html", "body", "article", "main") or (tag in ("p", "pre") or tag in HEADING) and doubt < 4:
            doubt = 0
        if names and GOOD.search(names):
            weight = 25.0
    if tag == "header" and not _inside(parent, ("article", "main")):
        skip = True
    return _Node(tag, parent, skip, weight, doubt)


def _inside(node: _Node, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _close_to(here: _Node, tags: set[str], stop: set[str]) -> _Node:
    """The parent of the nearest open element of `tags`, or `here` if `stop` comes first."""
    n = here
    while n.parent is not None and n.tag not in stop:
        if n.tag in tags:
            return n.parent
        n = n.parent
    return here


def _tree(html: str) -> _Node:
    root = here = _Node("#root", None, False, 0.0)
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                here.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in ENDS_P:
            here = _close_to(here, {"p"}, {"div", "td", "th", "li", "article", "section", "table", "blockquote", "body", "main", "aside", "button"})
        elif tag == "li":
            here = _close_to(here, {"li"}, {"ul", "ol", "menu"})
        elif tag in ("dd", "dt"):
            here = _close_to(here, {"dd", "dt"}, {"dl"})
        elif tag in ("td", "th"):
            here = _close_to(here, {"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            here = _close_to(here, {"tr"}, {"table", "tbody", "thead", "tfoot"})
        elif tag == "body":
            here = _close_to(here, {"head"}, {"html"})
        node = _open(tag, m[3] or "", here)
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            here = node
    return root


def _lengths(root: _Node) -> list[_Node]:
    """Lengths of all elements that aren't skipped, parents first."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        if not x.skip:
            order.append(x)
            todo += [c for c in x.children if type(c) is _Node]
    for x in reversed(order):
        x.length = x.linked = x.commas = 0
        for c in x.children:
            if type(c) is str:
                s = c.strip()
                x.length += len(s)
                x.commas += s.count(",") + s.count("，") + s.count("、")
            elif not c.skip:
                x.length += c.length
                x.linked += c.linked
                x.commas += c.commas
        if x.tag == "a":
            x.linked = x.length
    return order


def _holds(x: _Node, tags: set[str]) -> bool:
    todo = [x]
    while todo:
        y = todo.pop()
        if y.tag in tags and y.length and not y.skip:
            return True
        todo += [c for c in y.children if type(c) is _Node and not c.skip]
    return False


def _judge(root: _Node, order: list[_Node]) -> bool:
    """Skip doubtful elements by their names and by what they hold, parents first; whether there were any.

    What holds the larger part of the page's unlinked text stays, but counts less than other containers; if it holds no h1,
    article or main itself, it gives way to one elsewhere.
    """
    doubtful = [x for x in order if x.doubt]
    text = root.length - root.linked
    for x in doubtful:
        own = x.length - x.linked
        if x.doubt == 1:
            x.skip = not _holds(x, {"h1"}) and (_density(x) >= 0.33 or own < 80 and not _holds(x, HEADING | {"p", "pre"}))
        else:
            rest = text - own
            stays = own > rest
            if stays and not _holds(x, {"h1", "article", "main"}):
                stays = not _holds(root, {"article", "main"}) and (own > 10 * rest or not _holds(root, {"h1"})) and (x.doubt != 3 or rest < 140)
            x.skip, x.factor = not stays, 0.25
    for x in order:
        if x.parent is not None:
            x.factor *= x.parent.factor
    return bool(doubtful)


def _measure(root: _Node) -> list[_Node]:
    """Lengths and points of all elements that aren't skipped, parents first."""
    order = _lengths(root)
    if _judge(root, order):
        order = _lengths(root)
    for x in order:
        own = x.tag in PARAGRAPH or x.tag in CONTAINER and any(type(c) is str and len(c.strip()) >= 25 for c in x.children)
        if own and x.length >= 10:
            points = (1 + x.commas + min(x.length / 100, 3)) * (1 - x.linked / x.length)
            up, share = (x if x.tag not in PARAGRAPH else x.parent), 1.0
            while up is not None and up.tag != "#root":
                if up.tag in CONTAINER:
                    up.score += points * share
                    share /= 2
                    if share < 0.2:
                        break
                up = up.parent
    return order


def _density(x: _Node) -> float:
    return x.linked / x.length if x.length else 0.0


def _unlinked(x: _Node) -> int:
    return x.length - x.linked


def _best(root: _Node) -> list[_Node]:
    order = _measure(root)
    named = [x for x in order if x.tag == "article" or x.tag == "main"]
    pool = [x for x in order if x.tag in CONTAINER and x.length]
    if not pool:
        return [root]
    value = lambda x: (x.score + x.weight * (x.score > 0)) * (1 - _density(x)) * x.factor
    top = max(pool, key=value)
    whole = max(named, key=_unlinked, default=None)
    if whole is not None and _unlinked(whole) and 2 * _unlinked(whole) > _unlinked(top):
        top = whole
    if top.parent is None or top.tag in ("body", "html"):
        return [top]
    limit, kept, run = max(10.0, value(top) * 0.2), [], []

    def loose():
        """Text between elements stays with its inline elements unless most of it is links."""
        length = sum(len(c.strip()) if type(c) is str else c.length for c in run)
        if length and 2 * sum(c.linked for c in run if type(c) is _Node) < length:
            kept.extend(run)
        run.clear()

    for c in top.parent.children:
        if type(c) is str or c.tag not in BLOCK and c is not top:
            if type(c) is str or not c.skip:
                run.append(c)
            continue
        loose()
        if c is top:
            kept.append(c)
        elif c.skip or not c.length:
            continue
        elif c.tag == "h1" or _density(c) < (0.5 if c.tag in PARAGRAPH else 0.25):
            # an article says itself where it ends: beside it, other boxes stay if they score
            if top.tag in ("article", "main") and c.tag in CONTAINER - {top.tag, "section", "blockquote", "ul", "ol", "dl", "table"} and value(c) < limit:
                continue
            kept.append(c)
    loose()
    return kept


def _blocks(nodes: list[_Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is str:
            run.append(unescape(x))
        elif x.skip:
            if x.tag in BLOCK:
                flush()
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The page's main text; blocks are joined by one blank. Null, empty and broken markup give what text there is."""
    if not html:
        return ""
    return " ".join(_blocks(_best(_tree(html))))


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row of `pages` (column html) and its main `text` (never null) with its length `n_chars` in code points.

    Repeated rows stay; an empty table gives none; other columns do not matter, whatever their names.
    """

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(main_text)

    rows = pages.select(*keep, text_of("html").alias("__text"))
    return rows.select(*keep, F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))

"""Main-text extraction by tree scoring.

A page is read into a tree by a tolerant tokenizer (unclosed and stray tags, comments, CDATA, raw-text elements,
attributes without quotes, cut-off pages). Text lies in blocks. A paragraph-like block passes points to its ancestors:
one, one for each comma, and one for each 100 characters (three at most) go to the parent in full, to the grandparent by
half, further up by 1 / (3 x distance), in Readability's way. A candidate's points are multiplied by 1 - link density.
The best container is kept with those siblings that score enough or read like prose; elements that are never article
text (navigation, forms, scripts, adverts, notices, reader comments by their names) are left out throughout. A name
counts for less than what an element holds: one around the marked article, or with most of the page's text, stays.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|$)""", re.S)
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "noframes", "xmp", "noembed", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements that hold no article text.
NEVER = {"script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "menu", "dialog", "map", "noframes", "noembed", "label", "fieldset"}
#: An open <p> ends where one of these begins; others end their own kind.
_ENDS_P = BLOCK - {"html", "head", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of a class or id that name what isn't article text; what starts with a state or a topic (no-sidebar, has-header, tag-python) names nothing.
_UNLIKELY = re.compile(r"(?:ad|ads|adv|advert\w*|banner\w*|breadcrumb\w*|comment\w*|community|cookie\w*|consent|disqus|disclaimer|disclosure|dropdown|flyout|footer|footnav|gdpr|header|masthead|menu\w*|modal|nav|navbar|navigation|newsletter|notice\w*|notification|outbrain|overlay|pager|pagination|popup|popular|promo\w*|recommend\w*|related\w*|remark|replies|reply|respond|rss|share|sharing|shoutbox|sidebar\w*|skyscraper|social|sponsor\w*|subscribe|subscription|taboola|tags?|teaser|toolbar|topbar|tweet|widget\w*|alert|toc|login|signup|search|copyright|feedback|discussion)(?:$|\d)")
_STATES = {"no", "not", "non", "without", "with", "has", "have", "is"}
_TOPICS = {"tag", "category", "cat", "term", "topic"}
#: What readers and notices write is prose, but never the article, however long it is.
_TALK = re.compile(r"(?:comment\w*|disqus|remark|replies|reply|respond|shoutbox|cookie\w*|consent|gdpr)(?:$|\d)")
_LIKELY = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|post|text|blog|story", re.I)
_LIKELY_WORDS = {"article", "body", "content", "entry", "hentry", "h", "main", "page", "post", "text", "blog", "story"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alertdialog", "alert", "form", "toolbar"}
_START = {"article": 10, "main": 8, "div": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "parent", "children", "score", "chars", "linked", "commas", "drop", "depth", "marked")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.marked = parent is not None and (parent.marked or parent.tag in ("article", "main"))  # inside an article
        self.names, self.role, self.hidden = "", "", False
        if attrs and not attrs.isspace():
            for key, a, b, c in _ATTR.findall(attrs):
                key, value = key.lower(), a or b or c
                if key in ("class", "id"):
                    self.names += " " + value
                elif key == "role":
                    self.role = value.strip().lower()
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.hidden = True
        self.score, self.chars, self.linked, self.commas, self.drop = 0.0, 0, 0, 0, False


_CONTAINERS = ("article", "main", "table", "td", "th", "body")


def parse(page: str) -> Node:
    """The page's tree; text is str among the children. Never fails.

    The open elements of each name are kept on a stack of their own, so the one that a tag closes is found without
    climbing; elements are left once each, and the time is in proportion to the page.
    """
    root = Node("html", None)
    at, here = 0, root
    opened: dict[str, list[Node]] = {}
    blocks = [root]  # open blocks but <p>
    find, n = _TAG.search, len(page)

    def depth(names) -> int:
        return max((opened[x][-1].depth for x in names if opened.get(x)), default=0)

    def leave(node: Node) -> Node:
        """Close everything down to `node`, it too; the element that is open then."""
        up = here
        while up is not node.parent:
            opened[up.tag].pop()
            if blocks[-1] is up:
                blocks.pop()
            up = up.parent
        return up

    while at < n:
        m = find(page, at)
        if m is None:
            here.children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            here.children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            here.children.append(m["cdata"])
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            # a stray inline end doesn't leave its container
            if opened.get(name) and (name in BLOCK or opened[name][-1].depth >= depth(_CONTAINERS)):
                here = leave(opened[name][-1])
            continue
        if name in _ENDS_P and opened.get("p") and opened["p"][-1].depth > blocks[-1].depth:
            here = leave(opened["p"][-1])
        if name in _ENDS:
            kinds, fence = _ENDS[name]
            low = depth(fence)
            for kind in ("td", "th", "tr") if name == "tr" else (max(kinds, key=lambda k: depth((k,))),):
                if depth((kind,)) > low:
                    here = leave(opened[kind][-1])
        child = Node(name, here, m["attrs"])
        here.children.append(child)
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            if name in ("textarea", "title"):
                child.children.append(entities.unescape(page[at : end.start() if end else n]))
            at = end.start() if end else n
            if not end:
                continue
        opened.setdefault(name, []).append(child)
        if name in BLOCK and name != "p":
            blocks.append(child)
        here = child
    return root


def _dropped(node: Node) -> bool:
    if node.tag in NEVER or node.hidden or node.role in _ROLES:
        return True
    return node.tag == "header" and not node.marked  # a page's header; an article's own header holds its heading


def _words(token: str) -> list[str]:
    """The words of one class or id that say what the element is."""
    words = [w for w in re.split(r"[_-]+", token.lower().split("--")[0]) if w]
    if len(words) > 1 and (words[0] in _TOPICS and words[1] not in ("cloud", "list", "links") or words[-1] == "header" and words[0] in ("article", "entry", "post", "story", "blog")):
        return []
    return words[: next((i for i, w in enumerate(words) if w in _STATES), len(words))]


def _unlikely(names: str, kinds: re.Pattern = _UNLIKELY) -> bool:
    return any(kinds.match(w) for token in names.split() for w in _words(token))


def _likely(names: str) -> bool:
    """Whether a whole class or id says article text, as in `post` or `entry-content`."""
    return any(words and _LIKELY_WORDS.issuperset(words) for words in map(_words, names.split()))


def _count(order: list[Node]) -> None:
    """Sets chars, linked and commas from the bottom up."""
    for node in reversed(order):
        node.chars = node.linked = node.commas = 0
        for c in node.children:
            if isinstance(c, str):
                t = c.strip()
                node.chars += len(t)
                node.commas += t.count(",") + t.count("،") + t.count("、") + t.count("，")
            elif not c.drop:
                node.chars += c.chars
                node.linked += c.chars if c.tag == "a" else c.linked
                node.commas += c.commas


def _drop_by_name(order: list[Node], named: list[Node]) -> None:
    """Drop the nodes `named` but those around a main or the longest article, with a name for article text as well, or with most of the page's unlinked text."""
    prose = lambda x: x.chars - x.linked
    marked = [x for x in order if x.tag == "main" and x.chars]
    articles = [x for x in order if x.tag == "article" and x.chars and not _unlikely(x.names)]
    marked += [max(articles, key=prose)] if articles else []
    around: set[Node] = set()
    for x in marked:
        while x is not None and x not in around:
            around.add(x)
            x = x.parent
    for x in named:
        x.drop = x not in around and (_unlikely(x.names, _TALK) or not _likely(x.names) and 2 * prose(x) <= prose(order[0]))


def _measure(root: Node) -> list[Node]:
    """Nodes in page order without what is left out; sets chars, linked and commas from the bottom up."""

    def reached() -> list[Node]:
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += [c for c in node.children if isinstance(c, Node) and not c.drop]
        return order

    stack, named = [root], []
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node):
                c.drop = _dropped(c)
                if not c.drop:
                    stack.append(c)
                    if c.names and c.tag not in ("body", "article", "main", "html") and _unlikely(c.names):
                        named.append(c)
    order = reached()
    _count(order)
    if named:
        _drop_by_name(order, named)
        order = reached()
        _count(order)
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _own_text(node: Node) -> tuple[int, int]:
    """(characters, commas) of a block's own lines: its text and inline children, not blocks inside."""
    chars = commas = 0
    stack = [node]
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                t = c.strip()
                chars, commas = chars + len(t), commas + t.count(",")
            elif not c.drop and c.tag not in BLOCK:
                stack.append(c)
    return chars, commas


def _container(order: list[Node]) -> Node | None:
    scored: set[Node] = set()
    for node in order:
        if node.tag not in BLOCK or node.tag in ("html", "head", "li") or node.tag.startswith("h") and node.tag[1:].isdigit():
            continue
        chars, commas = _own_text(node)
        if chars < 25 and not (chars and node.tag == "p"):
            continue
        points = (1 if chars >= 25 else 0.2) + commas + min(chars / 100, 3)
        up, distance = (node.parent if node.tag in ("p", "pre", "td", "blockquote", "dd") else node), 0
        while up is not None and distance < 5:
            up.score += points if distance == 0 else points / 2 if distance == 1 else points / (3 * distance)
            scored.add(up)
            up, distance = up.parent, distance + 1
    best, top = None, 0.0
    for node in order:
        if node in scored:
            node.score += _START.get(node.tag, 0) + (25 if node.names and _LIKELY.search(node.names) else 0) * (node.score > 5)
            node.score *= 1 - _density(node)
            if best is None or node.score > top:
                best, top = node, node.score
    return best


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below the nodes, in page order, white space made single blanks."""
    out: list[str] = []
    line: list[str] = []

    def close():
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    for top in nodes:
        stack: list[tuple[Node | str, bool]] = [(top, False)]
        while stack:
            x, done = stack.pop()
            if isinstance(x, str):
                line.append(x)
            elif x.drop:
                continue
            elif done:
                close()
            else:
                if x.tag in BLOCK:
                    close()
                    stack.append((x, True))
                elif x.tag == "br":
                    line.append(" ")
                stack += [(c, False) for c in reversed(x.children)]
        close()
    return out


def main_text(page: str | None) -> str:
    """The page's article. A null or empty page, or one without text, has an empty text; any markup is accepted."""
    if not page:
        return ""
    root = parse(page.replace("\x00", ""))
    order = _measure(root)
    if not root.chars:
        return ""
    articles = [x for x in order if x.tag in ("article", "main") and x.chars]
    best = _container(order)
    if best is None:
        best = max(articles, key=lambda x: x.chars, default=root)
    # a part of a marked article stands for the whole of it
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent if up.marked else None
    if up is not None:
        outer = up.parent if up.marked else None
        while outer is not None and outer.tag not in ("article", "main"):
            outer = outer.parent
        best = outer if outer is not None and outer.tag == "article" else up
    elif best.tag in ("p", "pre", "td", "tr", "tbody", "ul", "ol", "blockquote") and best.parent is not None:
        best = best.parent
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body", "html"):
        fence = max(10.0, best.score * 0.2)
        kept = []
        for x in best.parent.children:
            if not isinstance(x, Node) or x.drop:
                continue
            prose = x.tag == "p" and (x.chars > 80 and _density(x) < 0.25 or 0 < x.chars <= 80 and not x.linked)
            title = x.tag in ("h1", "h2") and not x.linked
            alike = x.score + (best.score * 0.2 if x.names and x.names == best.names else 0) >= fence and _density(x) < 0.33
            if x is best or prose or title or alike:
                kept.append(x)
    elif best.tag == "article" and best.parent is not None:  # the other parts of an article in several
        fence = max(10.0, best.score * 0.2)
        kept = [x for x in best.parent.children if x is best or isinstance(x, Node) and not x.drop and x.tag == "article" and x.score >= fence and _density(x) < 0.33 and not _unlikely(x.names)]
    return " ".join(_blocks(kept))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of `pages`: page_id, url, text, n_chars.

    Defined results: a null or empty html has an empty text and 0 characters; rows that repeat, and null ids or urls,
    are returned as they are; an empty table gives no rows; other columns are ignored. Each page is read alone, whole,
    in time in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

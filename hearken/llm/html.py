"""Main text of web pages by tree scoring (operator 2).

A tolerant parser makes a tree: tags may be left open, closed twice or out of order, and scripts, styles and comments are
never text.  Every paragraph-like block scores points for its length and its commas, and passes them to its parent in
full, to its grandparent by half and to further ancestors by ever less; a container's points are discounted by its
link density, the share of its characters that lie in links, and by what its tag, class and id say.  The container
with the most points is kept, with those siblings that have a fifth of them or are text of the same kind.  Inside what is
kept, menus, headers of the page, footers, sidebars, notices, adverts, forms and reader comments are left out, by their tag,
role or name, and nothing else: links, captions and short blocks are the article's own.

Text: character references are decoded, white space in a block is one space, blocks follow in page order with one space
between them.

Nulls and odd input: a null or empty html, or one without text, gives an empty text; a page without markup is its text; a
null url stays null; repeated rows repeat results; an empty table gives none.  Very deep nesting is flattened at
MAX_DEPTH: further tags are taken as children of that depth, and no text is lost by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import table

MAX_DEPTH = 400
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object select button canvas audio video xmp noembed noframes".split())
#: Tags whose content is never part of the main text.
DROPPED = frozenset("nav footer aside form menu dialog head".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption dialog hgroup search".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open one of these kinds.
CLOSES = {
    **{b: ("p",) for b in BLOCKS if b not in ("html", "body")},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "body": ("head",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: Open tags beyond which CLOSES doesn't look.
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
_AT, _TO = r"(?:^|[\s_-])", r"(?=$|[\s_-]|\d)"
#: Names of what is never main text, in any place: adverts, menus, headers and footers of the page, sidebars, notices, forms,
#: reader comments.
NEVER = re.compile(
    _AT + r"(?:ad|ads|advert\w*|adsense|adbox|banner|sponsor\w*|promo|promotion|menu|menus|nav|navbar|navigation|breadcrumbs?|masthead|topbar|footer|sidebar|side-bar|"
    r"cookies?|consent|gdpr|notice|notices|notification|popup|modal|newsletter|subscribe|signup|login|comment|comments|commentlist|disqus)" + _TO, re.I
)
#: Names that tell against a container when it is chosen, but not against a block inside the chosen one.
DOUBTED = re.compile(
    _AT + r"(?:aside|discussion|replies|respond|response|foot|overlay|subscription|share|sharing|social|related|recommended|recommendations|widget|pager|pagination|toolbar|"
    r"skip|skip-link|tags|tagcloud|copyright|legal|disclaimer|outbrain|taboola|shoutbox|alert|announcement|paywall)" + _TO, re.I
)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|text|story|hentry|blog|column)(?=$|[\s_-]|\d)", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "depth", "score", "chars", "links", "commas")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.score, self.chars, self.links, self.commas = 0.0, 0, 0, 0

    def named(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(self.attrs)} if self.attrs else {}


def parse(html: str) -> Node:
    """The tree; children are nodes and strings with references still encoded."""
    root = Node("#root", "", None)
    now, at, end = root, 0, len(html)
    open_tags: dict[str, int] = {}
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            now.children.append(html[at:])
            break
        if m.start() > at:
            now.children.append(html[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                now.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if close:
            if tag in ("br", "p") and not open_tags.get(tag):
                now.children.append(Node(tag, "", now))
            elif open_tags.get(tag) and tag not in ("html", "body"):
                limit = now
                while limit.tag != tag:
                    limit = limit.parent
                if tag in BLOCKS or not _crosses_block(now, limit):
                    while now is not limit:
                        open_tags[now.tag] -= 1
                        now = now.parent
                    open_tags[tag] -= 1
                    now = now.parent
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            node = Node(tag, attrs, now)
            if attrs.rstrip().endswith("/") and tag in ("svg", "math", "iframe", "script") and not stop:
                continue
            now.children.append(node)
            if stop or tag in ("script", "style", "title", "textarea", "xmp"):
                at = stop.end() if stop else end
            continue
        for closed in CLOSES.get(tag, ()):
            if open_tags.get(closed):
                target, stops = now, SCOPES.get(tag, ())
                while target.tag != closed and target.tag not in stops and (closed != "p" or target.tag not in ("article", "section", "div", "td", "th", "li", "body", "main")):
                    if target.parent is None:
                        break
                    target = target.parent
                if target.tag == closed:
                    while now is not target:
                        open_tags[now.tag] -= 1
                        now = now.parent
                    open_tags[closed] -= 1
                    now = now.parent
        node = Node(tag, attrs, now)
        now.children.append(node)
        if tag not in VOID and now.depth < MAX_DEPTH:
            open_tags[tag] = open_tags.get(tag, 0) + 1
            now = node
    return root


def _crosses_block(now: Node, limit: Node) -> bool:
    while now is not limit:
        if now.tag in BLOCKS:
            return True
        now = now.parent
    return False


def dropped(node: Node) -> bool:
    """Whether a node is no part of any main text, by its tag and its names."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header":
        return not _inside(node, ("article", "main"))
    if not node.attrs:
        return False
    names = node.named()
    if "hidden" in names or names.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", names.get("style", "")):
        return True
    if names.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"):
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    return bool(NEVER.search(f"{names.get('class', '')} {names.get('id', '')}"))


def _inside(node: Node, tags: tuple[str, ...]) -> bool:
    up = node.parent
    while up:
        if up.tag in tags:
            return True
        up = up.parent
    return False


def blocks(node: Node, out: list[tuple[Node, str, int]], skip=dropped) -> None:
    """Appends (block node, text, characters in links) of each block below, in page order."""
    parts: list[str] = []
    linked = 0
    owner = node
    stack: list[tuple[Node, Iterator, bool]] = [(node, iter(node.children), node.tag == "a")]

    def flush(of: Node) -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append((of, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    while stack:
        top, children, in_link = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if top.tag in BLOCKS or not stack:
                flush(owner)
                owner = next((x for x, _, _ in reversed(stack) if x.tag in BLOCKS), node)
        elif isinstance(child, str):
            parts.append(child)
            if in_link:
                linked += len(child.strip())
        elif child.tag == "br":
            parts.append(" ")
        elif skip(child):
            if child.tag in BLOCKS or child.tag in DROPPED:
                flush(owner)
        else:
            if child.tag in BLOCKS:
                flush(owner)
                owner = child
            stack.append((child, iter(child.children), in_link or child.tag == "a"))


_WEIGHT = {"article": 25, "main": 25, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "form": -3, "header": -5, "h1": -5, "th": -5}


def _weight(node: Node) -> float:
    own, names = _WEIGHT.get(node.tag, 0), node.named()
    for k in ("class", "id"):
        if names.get(k):
            own += 25 * bool(GOOD.search(names[k])) - 25 * bool(NEVER.search(names[k]) or DOUBTED.search(names[k]))
    return own


def main_text(html: str | None) -> str:
    if not html or html.isspace():
        return ""
    root = parse(html)
    found: list[tuple[Node, str, int]] = []
    blocks(root, found)
    if not found:
        return ""
    candidates: dict[int, Node] = {}
    for node, text, linked in found:
        up = node
        while up:
            up.chars += len(text)
            up.links += linked
            up = up.parent
        if len(text) < 25 and node.tag not in ("p", "pre"):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= 25 else 0.2
        if linked > 0.5 * len(text):
            points *= 0.1
        # a paragraph's points go to its ancestors; text that stands in a container itself counts for that container
        up, level = (node.parent if node.tag in PARAGRAPHS and node.parent else node), 0
        while up and up.tag not in ("#root", "html"):
            if id(up) not in candidates:
                candidates[id(up)] = up
                up.score += _weight(up)
            up.score += points / (1, 2, 3, 6, 9, 12)[min(level, 5)]
            up, level = up.parent, level + 1
    if not candidates:
        return " ".join(t for _, t, _ in found)
    of = {k: n.score * (1 - n.links / max(1, n.chars)) for k, n in candidates.items()}
    best = candidates[max(of, key=lambda k: (of[k], -candidates[k].depth))]
    # a container with nearly all of the best one's points around it holds the same article in pieces
    while best.tag in PARAGRAPHS or best.tag in ("ul", "ol", "table", "tbody", "tr", "dl"):
        if best.parent is None or best.parent.tag in ("#root", "html"):
            break
        best = best.parent
    kept = {id(best)}
    top = of.get(id(best), best.score)
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        for other in best.parent.children:
            if isinstance(other, str) or other is best or dropped(other):
                continue
            density = other.links / max(1, other.chars)
            same = best.named().get("class") and other.named().get("class") == best.named().get("class")
            if of.get(id(other), 0) + (0.2 * top if same else 0) >= max(10, 0.2 * top) or (other.tag in PARAGRAPHS and other.chars and density < 0.25):
                kept.add(id(other))
    out = []
    for node, text, _ in found:
        up = node
        while up and id(up) not in kept:
            up = up.parent
        if up:
            out.append(text)
    return " ".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))

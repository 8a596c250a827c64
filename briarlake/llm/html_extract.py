"""Main text of HTML pages by tree scoring.

A page becomes a tree (unclosed and stray tags are mended as browsers mostly do). Elements that are no text by their tag or
role are left out at once: raw text, forms, navigation, asides, page headers and footers. A class or id is read as a phrase:
its last telling word is its head, so `article-comments` are comments and `discussion-of-results` are results. Elements
whose head names page furniture are marked; a mark is lifted again where the element holds the page's heading or `main`,
or where nothing unmarked on the page has any points.

Each paragraph gives points for its length and its commas to its ancestors, the nearer the more; a container's points are
discounted by its link density. The best container is widened to the article or main element around it, or else to the
parents whose further text is not mainly links; its siblings that read like text are kept too. Inside, all unmarked text
stays, links and lists of links included; only outside article and main are menus (short links and nothing else) left out.

Null and empty pages, pages without text and pages that are all navigation give an empty text. Very deep pages are walked
without recursion.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.llm._arrow import frugal, slices

SCHEMA = "page_id long, url string, text string, n_chars long"

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = frozenset("script style textarea title noscript template iframe object svg math select xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split()
)
#: A start tag on the left ends an open element on the right, up to the nearest of the bounds.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_OUT = frozenset("nav aside form button input dialog menu footer audio video canvas label fieldset".split())
_HELD = frozenset("html body article main".split())
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form toolbar".split())
#: Words that name page furniture as the head of a class or id; of these, those that a page's layout may be named after.
_LAYOUT_WORDS = frozenset("sidebar side rail widget widgets header masthead banner related recommended social share sharing menu nav navbar".split())
_OUT_WORDS = _LAYOUT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising advertisements adsense adbox breadcrumb breadcrumbs comment comments commentary respond reply replies disqus consent "
    "cookie cookies gdpr notice notices alert alerts popup modal overlay menus navigation topnav footer foot recommendations sponsor sponsored sponsors promo promotion promotions "
    "newsletter subscribe subscription signup login pager pagination skip toolbar discussion discussions feedback outbrain taboola paywall".split()
)
#: Words that tell nothing of what an element is: the head is looked for before them.
_NEUTRAL = frozenset("area bar block blocks box container content group inner item items left link links list lists main outer panel right row section sections top bottom wrap wrapper wrappers thread".split())
#: A class like with-sidebar or comments-open tells of the page, not of the element.
_STATE = frozenset("with has no without is not open closed enabled disabled active inactive visible hidden on off".split())
_GOOD_WORDS = frozenset("article articles body content entry main post story text blog prose".split())
#: Letters that a link of a menu has at most, on average, and the links that a menu has at least.
MENU_LETTERS, MENU_LINKS = 20, 3
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("kids", "link", "links", "mark", "name", "out", "parent", "points", "size", "words")

    def __init__(self, name: str, parent: Node | None, words: frozenset = frozenset(), out: bool = False, mark: str = ""):
        self.name, self.parent, self.words, self.out, self.mark = name, parent, words, out, mark
        self.kids: list[Node | str] = []
        self.points = 0.0
        self.size = self.link = self.links = 0


def _head(words: list[str]) -> str:
    """The last word of a class or id that tells what the element is; empty if it tells of the page's state or of nothing."""
    if _STATE.intersection(words[:1] + words[-1:]):
        return ""
    return next((w for w in reversed(words) if w not in _NEUTRAL), "")


def _describe(name: str, rest: str) -> tuple[frozenset, bool, str]:
    """The words of class and id, whether the element is left out, and the word of furniture that marks it."""
    words, out, mark = set(), name in _OUT, ""
    if "=" in rest or "hidden" in rest:
        for key, value in _ATTR.findall(rest):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                for phrase in value.split():
                    own = [w.lower() for w in _WORD.findall(phrase)]
                    words.update(own)
                    mark = mark or (_head(own) if _head(own) in _OUT_WORDS else "")
            elif key == "role":
                out = out or value.lower() in _ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                out = True
    if name in ("html", "body", "main"):
        return frozenset(words), False, ""
    return frozenset(words), out, mark


def parse(page: str) -> Node:
    root = Node("html", None)
    now, at, in_article = root, 0, 0
    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            now.kids.append(page[at:])
            break
        if m.start() > at:
            now.kids.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if name in _VOID:
                continue
            up = now
            while up is not root and up.name != name and not (name not in _BLOCK and up.name in _BLOCK):
                up = up.parent
            if up is not root and up.name == name:
                now = up.parent
                if name in ("article", "main"):
                    in_article -= 1
            elif name == "p":
                now.kids.append(Node("p", now))
            continue
        rest = m["rest"]
        if not rest.endswith(">"):
            break
        if name in _RAW:
            if rest.endswith("/>") and name in ("svg", "math"):
                continue
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in ("html", "body"):
            continue
        if name in _BLOCK:
            up = now
            while up is not root and up.name not in ("p", "table", "td", "th", "article", "div", "section", "li"):
                up = up.parent
            if up.name == "p":
                now = up.parent
        if name in _ENDS:
            same, bounds = _ENDS[name]
            up = now
            while up is not root and up.name not in same and up.name not in bounds:
                up = up.parent
            if up.name in same:
                now = up.parent
        words, out, mark = _describe(name, rest)
        if name == "header":
            out = out or not in_article
        node = Node(name, now, words, out, mark)
        now.kids.append(node)
        if name not in _VOID and not rest.endswith("/>"):
            now = node
            if name in ("article", "main"):
                in_article += 1
    return root


def _walk(root: Node):
    """(node, False) before its children and (node, True) behind them; nodes that are out are not entered."""
    todo = [(root, False)]
    while todo:
        node, done = todo.pop()
        yield node, done
        if not done:
            todo.append((node, True))
            todo += [(k, False) for k in reversed(node.kids) if isinstance(k, Node) and not k.out]


def _settle(root: Node) -> None:
    """Leaves marked elements and forms out, but for those that hold the page's heading or main element."""
    held: set[int] = set()
    todo: list[Node] = [root]
    while todo:
        node = todo.pop()
        if node.name in ("main", "h1") and not node.mark:
            up = node.parent
            while up is not None and id(up) not in held:
                held.add(id(up))
                up = up.parent
        todo += [k for k in node.kids if isinstance(k, Node) and (not k.out or k.name == "form") and k.mark[:7] != "comment"]
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) in held:
            node.mark = ""
            node.out = node.out and node.name != "form"
        node.out = node.out or bool(node.mark)
        todo += [k for k in node.kids if isinstance(k, Node)]


def _lift(root: Node) -> bool:
    """Takes marks of layout words back; whether there were any."""
    found, todo = False, [root]
    while todo:
        node = todo.pop()
        if node.mark in _LAYOUT_WORDS and node.name not in _OUT:
            node.mark, node.out, found = "", False, True
        todo += [k for k in node.kids if isinstance(k, Node)]
    return found


def _score(root: Node) -> list[Node]:
    """Sizes, link sizes and points of all nodes; the nodes that have points."""
    scored = []
    for node, done in _walk(root):
        if not done:
            continue
        own = [k for k in node.kids if isinstance(k, str)]
        text = sum(len(k.strip()) for k in own)
        inner = [k for k in node.kids if isinstance(k, Node) and not k.out]
        node.size = text + sum(k.size for k in inner)
        node.link = node.size if node.name == "a" else sum(k.link for k in inner)
        node.links = 1 if node.name == "a" else sum(k.links for k in inner)
        if node.name in _BLOCK or node is root:
            inline = [k for k in inner if k.name not in _BLOCK]
            size = text + sum(k.size for k in inline)
            if size:
                commas = sum(k.count(",") + k.count("،") + k.count("、") + k.count("，") for k in own)
                links = sum(k.link for k in inline)
                points = (1 + commas + min(size / 100, 3)) * (1 - links / max(size, 1))
                if node.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    points /= 4
                up, share = node.parent if node.parent and node.name not in ("div", "section", "article", "main") else node, 1.0
                for _ in range(4):
                    if up is None:
                        break
                    if not up.points:
                        scored.append(up)
                    up.points += points * share
                    up, share = up.parent, share / 2.5
    return scored


def _value(node: Node) -> float:
    lift = 1.25 if node.name in ("article", "main") or node.words & _GOOD_WORDS else 1.0
    return node.points * lift * (1 - node.link / max(node.size, 1))


def _menu(node: Node) -> bool:
    """Short links and next to nothing else."""
    listed = node.name in ("ul", "ol", "div", "section", "table", "dl", "p", "center")
    return listed and node.links >= MENU_LINKS and node.link > 0.8 * node.size and node.link <= MENU_LETTERS * node.links


def _region(top: Node, root: Node) -> Node:
    """What belongs to the best container: the article or main around it, or the parents whose further text is not mainly links."""
    up = top
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    if up is not None:
        return up
    while (up := top.parent) is not None and up is not root:
        more, links = up.size - top.size, up.link - top.link
        if links > 0.25 * more:
            break
        top = up
    return top


def _reads(node: Node, in_page: bool) -> bool:
    """Whether a sibling of the article reads like text: few links; on the page's own level, more than a label."""
    if not node.size or node.link > 0.3 * node.size:
        return False
    return not in_page or node.name not in ("div", "section", "span", "center") or node.size >= 25


def _blocks(node: Node, whole: bool) -> list[str]:
    """The blocks of a subtree, each its inline text with single spaces; whole: menus stay."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = _BLANK.sub(" ", html.unescape("".join(now))).strip()
        if text:
            out.append(text)
        now.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(x)
        elif x.name in ("br", "hr", "wbr"):
            now.append("" if x.name == "wbr" else " ")
        elif not x.out and (whole or x is node or not _menu(x)):
            inside = list(reversed(x.kids))
            if x.name in _BLOCK:
                close()
                inside = [None, *inside]
            todo += inside
    close()
    return out


def extract(page: str | None) -> str:
    """The main text: blocks in page order, joined by blank lines."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    _settle(root)
    scored = _score(root)
    if not scored and _lift(root):
        scored = _score(root)
    if not scored:
        return ""
    top = _region(max(scored, key=_value), root)
    whole = top.name in ("article", "main")
    if top is root or top.parent is None:
        for k in top.kids:
            if isinstance(k, Node) and k.name in _BLOCK and not _reads(k, True):
                k.out = True
        return "\n\n".join(_blocks(top, whole))
    parts: list[str] = []
    for k in top.parent.kids:
        if k is top:
            parts += _blocks(k, whole)
        elif isinstance(k, Node):
            if not k.out and (k.name == top.name == "article" or _reads(k, top.parent is root)) and not _menu(k):
                parts += _blocks(k, k.name == "article")
        elif top.parent is not root and (text := _BLANK.sub(" ", html.unescape(k)).strip()):
            parts.append(text)
    return "\n\n".join(parts)


def extracted(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "html", 4 << 20):
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(frugal(run), SCHEMA)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))

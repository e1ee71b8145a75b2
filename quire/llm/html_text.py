"""Main text of web pages by tree scoring.

1. A page becomes a tree of its block elements and links, in one pass over the markup. Unclosed and misnested elements end
   where a browser would end them, as far as text is concerned.
2. Page furniture takes no part: elements that never hold an article's text (scripts, styles, menus, footers, asides,
   forms, what isn't shown), headers outside articles, and containers whose class or role is a name of furniture as a
   whole. Headings, paragraphs and table cells are never judged by name; an id counts on plain containers alone, as a whole,
   since ids of headings and sections are slugs of titles. A container or form around the page's heading or article is no furniture.
3. Each paragraph (an element with text of its own, headings aside) has points for its length and its commas, links left
   out: min(1, n / 25) + commas + min(3, n // 100). Its nearest container gets them whole, the next half, the k-th
   after that 1 / (3k). A container's worth is its points less its link density, half as much again for articles.
4. The container of the greatest worth is best. It widens to the article (or else the main element) that it lies in. Beside it, and beside
   each container that it lies in, other containers stay whose paragraphs have a fifth of the points of those in the best one, both less their
   link density; where no article bounds it, so do headings, paragraphs, lists and tables, and next to it all containers with paragraphs and few links.
5. Inside what stays, blocks that are mostly links (menus) are left out, and nothing else.

Defined cases: null or empty html gives an empty text; a page without any text outside furniture gives an empty text;
repeated rows are each extracted; an empty table gives an empty result; a page is read whole, in time linear in its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import common

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:"[^"]*"|'[^']*'|[^>"']+)*+>""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul noscript object canvas audio video".split()
)
_DROPPED = frozenset("nav footer aside form button select head template noscript dialog svg canvas audio video object menu fieldset search".split())
_ENDS_P = _BLOCK - frozenset("button option optgroup select svg template noscript object canvas audio video caption tbody thead tfoot tr td th legend".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_PROSE = frozenset(("p", "pre", "blockquote"))
_PIECES = _HEADING | _PROSE | frozenset(("ul", "ol", "table", "figure", "dl"))
_CONTAINERS = frozenset("div section article main body html #root center details form fieldset".split())
_CELLS = frozenset(("td", "th"))
#: Elements that a close tag inside doesn't reach beyond.
_SCOPES = ("td", "th", "table", "caption", "button", "object", "template")
#: What may be furniture by its name: class and role; and by id, on plain containers.
_NAMED = frozenset("div section article ul ol dl table header details center span".split())
_PLAIN = frozenset("div ul ol table".split())
_FURNITURE = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored promo promotion promotions sidebar menu nav navbar navigation breadcrumb
    breadcrumbs comment comments commentlist disqus respond replies reply cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup share sharing
    social related recommended recommendations footer masthead topbar toolbar pagination pager copyright widget widgets login alert teaser teasers outbrain taboola""".split()
)
#: Words that may stand beside those without another meaning.
_QUALIFIERS = frozenset(
    """a all area article articles bar block body bottom box button buttons by card cards center col column container content count desktop entry fixed floating footer form global group head header heading
    icon icons inline inner item items js left link links list main meta mobile module more outer page panel post posts primary reader readers right row secondary section site slot small
    sticky text thread title top unit user users wide wp wrap wrapper you""".split()
)
_HEADERS = frozenset(("header", "site-header", "page-header", "global-header", "main-header"))
_ROLES = frozenset("banner navigation complementary contentinfo search dialog alertdialog alert menu menubar toolbar".split())
_GOOD = frozenset("article body content entry main page post story text".split())
#: Start tags that end an open element of these kinds, unless one of the second group lies between.
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",)),
}
#: A sibling stays from this share of the best container's points on.
SHARE = 0.2


class Node:
    __slots__ = ("tag", "parent", "parts", "own", "good", "out", "wraps", "holds", "holder", "points", "mass", "size", "linked", "links", "prose", "taken", "path", "order")

    def __init__(self, tag: str, parent: Node | None, order: int) -> None:
        self.tag, self.parent, self.order = tag, parent, order
        self.parts: list[Node | str] = []
        self.own = 0  # 1: furniture unless it wraps the article, 2: furniture
        self.good = self.out = False  # named like an article; furniture or inside some
        self.wraps = self.holds = False  # whether the page's heading or an article is in it; whether a child is a paragraph or container
        self.holder: Node | None = None  # the nearest container, itself if it is one
        self.points = self.mass = 0.0  # what paragraphs pass on; what those in it have
        self.size = self.linked = self.links = 0
        self.prose = False  # whether a paragraph element with text is in it
        self.taken = self.path = False  # whether it is main text; whether some lies in it


def furniture(token: str) -> bool:
    """Whether one name of a class says furniture as a whole: such a word, and beside it only words that qualify it."""
    if token.lower() in _HEADERS:
        return True
    words = [w.lower() for w in _WORDS.findall(token)]
    return not _FURNITURE.isdisjoint(words) and all(w in _FURNITURE or w in _QUALIFIERS for w in words)


def _attributes(tag: str, rest: str) -> tuple[bool, bool, bool]:
    """Whether an element isn't shown, is furniture by its name, is named like an article."""
    unseen = bad = good = False
    for name, a, b, c in _ATTR.findall(rest):
        name, value = name.lower(), a or b or c
        if name == "class":
            tokens = value.split()
            bad = bad or tag in _NAMED and any(map(furniture, tokens))
            good = good or any(not _GOOD.isdisjoint(w.lower() for w in _WORDS.findall(t)) for t in tokens)
        elif name == "role":
            bad = bad or tag in _NAMED and value.strip().lower() in _ROLES
            good = good or value.strip().lower() in ("main", "article")
        elif name == "itemprop":
            good = good or value.strip() == "articleBody"
        elif name == "id":
            bad = bad or tag in _PLAIN and furniture(value.strip())
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSEEN.search(value.lower()):
            unseen = True
    return unseen, bad, good


class _Open:
    """The open elements, and where each kind of them was opened last."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]  # all but links
        self.solid = [0]  # all but links and paragraphs

    def last(self, *tags: str) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(k)
        if node.tag != "a":
            self.blocks.append(k)
            if node.tag != "p":
                self.solid.append(k)

    def close(self, k: int) -> None:
        """Closes what was opened k-th and all inside."""
        while len(self.stack) > k:
            self.places[self.stack.pop().tag].pop()
        for held in (self.blocks, self.solid):
            while held[-1] >= k:
                held.pop()

    def end(self, tag: str) -> None:
        """A close tag."""
        if self.stack[-1].tag == tag and len(self.stack) > 1:
            return self.close(len(self.stack) - 1)
        k = self.last(tag)
        if tag == "a":
            barred = self.solid[-1]
        elif tag in ("p", "li"):
            barred = self.last("article", "section", "body", *_SCOPES)
        else:
            barred = 0 if tag in _SCOPES or tag in ("tr", "tbody", "thead", "tfoot") else self.last(*_SCOPES)
        if k > barred:
            self.close(k)

    def start(self, tag: str) -> None:
        """Ends what a start tag of this kind ends."""
        if tag in _ENDS_P and (k := self.last("p")) > self.solid[-1]:
            self.close(k)
        if tag in _SIBLINGS:
            kinds, until = _SIBLINGS[tag]
            if (k := self.last(*kinds)) > self.last(*until):
                self.close(k)
        elif tag == "a" and (k := self.last("a")) > self.blocks[-1]:
            self.close(k)


def parse(page: str) -> list[Node]:
    """The page's elements that bound text, in page order; the first is the root."""
    root = Node("#root", None, 0)
    nodes, open_, at, done = [root], _Open(root), 0, 0
    size, last = len(page), page.rfind(">")
    closing_of: dict[str, re.Pattern] = {}

    def text(upto: int) -> None:
        if upto > done:
            open_.stack[-1].parts.append(html.unescape(page[done:upto]) if page.find("&", done, upto) >= 0 else page[done:upto])

    while True:
        at = page.find("<", at)
        if at < 0:
            text(size)
            return nodes
        if page.startswith("<!--", at):
            text(at)
            end = re.compile("--!?>").search(page, at + 2)
            at = done = end.end() if end and end.end() > at + 4 else size
            continue
        if at > last:  # no tag ends any more
            at = size
            continue
        mark = page[at + 1 : at + 2]
        if mark in ("!", "?"):
            text(at)
            at = done = page.index(">", at) + 1
            continue
        m = _NAME.match(page, at + 2 if mark == "/" else at + 1)
        if not m:
            at += 1
            continue
        tag = m[0].lower()
        whole = _REST.match(page, m.end())
        end = whole.end() if whole else page.index(">", m.end()) + 1
        rest = page[m.end() : end - 1]
        text(at)
        at = done = end
        if mark == "/":
            if tag in _BLOCK or tag == "a":
                open_.end(tag)
            continue
        if tag in _RAW:
            if tag not in closing_of:
                closing_of[tag] = re.compile(f"</{tag}(?=[\\s/>])", re.I)
            close = closing_of[tag].search(page, at)
            at = done = close.start() if close else size
            continue
        if tag in ("br", "hr"):
            open_.stack[-1].parts.append("\n")
        if tag in _VOID or tag not in _BLOCK and tag != "a":
            continue
        open_.start(tag)
        parent = open_.stack[-1]
        node = Node(tag, parent, len(nodes))
        parent.parts.append(node)
        nodes.append(node)
        unseen, bad, node.good = _attributes(tag, rest) if rest.strip(" /") else (False, False, False)
        if unseen or tag in _DROPPED and tag != "form" or tag == "header" and not open_.last("article", "main"):
            node.own = 2
        elif bad or tag == "form":
            node.own = 1
        node.good = node.good or tag in ("article", "main")
        parent.holds = parent.holds or tag in ("p", "div")
        if tag == "svg" and rest.endswith("/"):
            continue
        open_.push(node)


def judge(nodes: list[Node]) -> None:
    """Sets `out`: furniture, and what lies inside."""
    for x in reversed(nodes[1:]):
        if x.own < 2 and (x.wraps or x.tag in ("h1", "main") or x.tag == "article" and not x.own):
            x.parent.wraps = True
    for x in nodes[1:]:
        x.out = x.parent.out or x.own == 2 or x.own == 1 and not x.wraps


def points_of(text: str) -> float:
    n = len(text)
    return min(1.0, n / 25) + text.count(",") + text.count("，") + text.count("、") + min(3, n // 100)


def score(nodes: list[Node]) -> None:
    """Sets size, linked, links, prose and points of every node that isn't furniture."""
    for x in nodes:
        if x.out:
            continue
        x.holder = x if x.tag in _CONTAINERS or x.tag in _CELLS and x.holds else x.parent.holder
        own = "".join(p for p in x.parts if isinstance(p, str)).strip()
        x.size += len(own)
        if x.tag == "a":
            x.linked, x.links = x.linked + len(own), 1
        elif own and x.tag not in _HEADING:
            points = points_of(own)
            x.mass += points
            holder, level = x.holder, 0
            while holder is not None and level < 6:
                holder.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
                holder, level = holder.parent and holder.parent.holder, level + 1
    for x in reversed(nodes[1:]):
        if not x.out:
            up = x.parent
            up.size += x.size
            up.linked += x.size if x.tag == "a" else x.linked
            up.links += x.links
            up.mass += x.mass
            up.prose = up.prose or x.prose or x.size > 0 and x.tag in _PROSE


def density(x: Node) -> float:
    return x.linked / x.size if x.size else 0.0


def worth(x: Node) -> float:
    return x.points * (1 - density(x)) * (1.5 if x.good else 1.0)


def menu(x: Node) -> bool:
    """Whether a block is mostly links; a paragraph from three on."""
    if x.tag == "p":
        return x.links >= 3 and density(x) > 0.7
    return x.links >= 2 and density(x) > 0.6 and (x.tag in _CONTAINERS or x.tag in ("ul", "ol", "dl", "table", "p"))


def choose(nodes: list[Node]) -> None:
    """Sets `taken` of what is main text, and `path` of what it lies in."""
    holders = [x for x in nodes if not x.out and x.size and (x.holder is x)]
    best = max(holders, key=lambda x: (worth(x), -x.order), default=nodes[0])
    least = SHARE * best.mass * (1 - density(best))
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    fence = next((x for x in reversed(above) if x.tag == "article"), None) or next((x for x in above if x.tag == "main"), None)
    main = next((k for k in range(len(above) - 1, -1, -1) if above[k].tag == "main"), -1)
    at = above.index(fence) if fence else 0
    above[at].taken = True
    for level, k in enumerate(range(at + 1, len(above))):
        inner, outer = above[k - 1], above[k]
        outer.path = True
        for x in outer.parts:
            if isinstance(x, str) or x is inner or x.out or not x.size or x.tag == "a" or menu(x):
                continue
            if x.tag in _PIECES:
                x.taken = (fence is None or k <= main) and density(x) < 0.5
            else:
                x.taken = x.mass * (1 - density(x)) >= least > 0 and density(x) < 0.5 or fence is None and level == 0 and x.prose and density(x) < 0.25


def rendered(root: Node) -> str:
    """The text of what is taken: blocks in page order, white space as one space."""
    runs: list[list[str]] = [[]]
    work: list[tuple[Node, int, bool]] = [(root, 0, root.taken)]
    while work:
        x, k, inside = work.pop()
        if k == 0 and x.tag != "a" and runs[-1]:
            runs.append([])
        for k in range(k, len(x.parts)):
            p = x.parts[k]
            if isinstance(p, str):
                if inside:
                    runs[-1].append(p)
            elif not p.out and (p.taken or p.path or inside and not menu(p)):
                work += [(x, k + 1, inside), (p, 0, inside or p.taken)]
                break
        else:
            if x.tag != "a" and runs[-1]:
                runs.append([])
    return " ".join(" ".join(w) for r in runs if r and (w := "".join(r).split()))


def extract(page: str) -> str:
    nodes = parse(page)
    judge(nodes)
    score(nodes)
    choose(nodes)
    return rendered(nodes[0])


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, text and n_chars of every row."""
    schema = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            texts = [extract(x) if x else "" for x in b.column(len(keep)).to_pylist()]
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*(f"c{i}" for i in range(len(keep))), "text", "n_chars"])

    picked = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(html_col).alias("html"))
    return picked.mapInArrow(run, f"{schema}, text string, n_chars long").toDF(*keep, "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.read(spark, sf_dir, "pages"))

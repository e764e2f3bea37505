"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors; an ancestor's points are discounted by the share
of its text that stands in links. The best container is kept, with those siblings of it and of its ancestors that read
like text; of a page with an article element, the whole article is. Every step is linear in the length of the page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import texts_in_batches

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"=\s*[\"']|>")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f\v\xa0  -     　]+")

#: Elements by kind, and words in class, id or role that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg canvas object audio video select xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE_FORMAT = frozenset("a abbr b big cite code em font i kbd mark q s small span strike strong sub sup tt u".split())
DROPPED = frozenset("nav footer aside form fieldset dialog head menu input datalist".split()) | RAW
#: Controls, which are text where they stand inside a sentence.
CONTROLS = frozenset("label output button".split())
FIELDS = frozenset("input textarea select button form".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr popup modal overlay newsletter sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar sharing commentlist comments disqus respond toolbar paywall".split())
#: Words that mark it only where they are what the name is about: its last word but for a part such as "box".
BAD_HEADS = frozenset("notice notices notification alert banner banners promo promos promotion subscribe subscription signup side rail header related recommended recommendations share social comment reply replies discussion feedback widget widgets skip login".split())
#: Of all these, words that mark nothing if other words say what the part is about and it reads like text.
WEAK = frozenset("popup modal overlay menu menus toolbar sharing notification notifications banner banners signup side rail header recommendation recommendations share social reply replies discussion feedback widget widgets skip login".split())
#: Words that do not say what a part is about.
GENERIC = frozenset("site page social user top bottom main global article post left right sticky email mobile desktop app web the".split())
#: Who writes beneath an article, and what it is called then.
READERS, REMARKS = frozenset("user users reader readers visitor visitors guest guests member members".split()), frozenset("response responses review reviews opinion opinions message messages thought thoughts remark remarks reply replies feedback discussion".split())
#: Headings under which a list of links is a menu.
MENU_HEADS = re.compile(r"related|more|popular|recommend|also|latest|recent|tags|share|follow|menu|navigation|categor|mehr|ähnlich|relacionad|más|connexe|plus|aussi", re.I)
PARTS = frozenset("bar bars box boxes block wrap wrapper container inner outer area section list item items links link form text content panel".split())
GOOD_WORDS = frozenset("article body content entry main post story text page blog".split())
#: Elements whose start ends an open element of the given kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
_WALL = frozenset("article aside body button dialog footer form header html main nav section table td th blockquote div".split())
_PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
_WEIGHT = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "h4": -5.0, "h5": -5.0, "h6": -5.0, "th": -5.0, "body": -10.0, "html": -20.0}


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "parent", "children", "score", "chars", "link_chars", "links", "commas", "block_inside", "raw", "raw_links", "prose", "fields", "tail", "heading")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.names, self.role, self.hidden = [], "", False
        self.score, self.chars, self.link_chars, self.links, self.commas, self.block_inside = None, 0, 0, 0, 0, False
        self.raw, self.raw_links, self.prose, self.fields, self.tail, self.heading = 0, 0, 0, 0, "", False
        if "=" in attrs or "hidden" in attrs:
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id"):
                    self.names.extend(re.split(r"[_-]+", x) for x in value.split())
                elif name == "role":
                    self.role = value.strip()
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    self.hidden = True


class _Open:
    """The open elements of a page, outermost first, and where those of each kind stand."""

    def __init__(self, root: Node):
        self.stack, self.at, self.walls, self.blocks = [root], {}, [0], [0]

    def push(self, node: Node) -> None:
        depth = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(depth)
        if node.tag in _WALL:
            self.walls.append(depth)
        if node.tag in BLOCK:
            self.blocks.append(depth)

    def close(self, depth: int) -> None:
        """Close the element at depth and everything inside it."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in _WALL:
                self.walls.pop()
            if tag in BLOCK:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        """An end tag: ignored if nothing of its kind is open within reach."""
        depths = self.at.get(tag)
        if not depths or tag in INLINE_FORMAT and self.blocks[-1] > depths[-1] or tag in ("p", "li", "dd", "dt") and self.walls[-1] > depths[-1]:
            return
        self.close(depths[-1])

    def implied(self, tag: str) -> None:
        """Close what the start of an element ends without an end tag of its own."""
        ends = CLOSES.get(tag, ())
        limit = max([0, *(d[-1] for w in _SCOPE.get(tag, ("table",)) if (d := self.at.get(w)))]) if ends else self.walls[-1]
        inside = [d[k] for t in (*ends, "p") if (d := self.at.get(t)) and (k := bisect_right(d, limit)) < len(d)]
        if inside:
            self.close(min(inside))


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose attributes begin at `at`; a > inside a quoted value does not end it. -1 if it does not end."""
    begin = at
    while at <= last[">"]:
        m = _STOP.search(html, at)
        if m[0] == ">":
            return m.start()
        quote = m[0][-1]
        at = html.find(quote, m.end()) + 1 if m.end() <= last[quote] else m.end()
    return html.find(">", begin) if begin <= last[">"] else -1


def parse(html: str) -> Node:
    """A tree of elements and texts. Void, raw-text and implied-end rules of HTML hold; unknown ends are ignored."""
    root = Node("#root", "", None)
    opened, at, n, endless = _Open(root), 0, len(html), set()
    last = {c: html.rfind(c) for c in ">\"'"}
    while at < n:
        top, lt = opened.stack[-1], html.find("<", at)
        if lt < 0:
            top.children.append(html[at:])
            break
        m = _OPEN.match(html, lt)
        if not m:
            top.children.append(html[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            top.children.append(html[at:lt])
        if not m[2]:
            mark = "-->" if m[0] == "<!--" else ">"
            end = html.find(mark, m.end())
            at = n if end < 0 else end + len(mark)
            continue
        tag, end = m[2].lower(), _tag_end(html, m.end(), last)
        if end < 0:
            top.children.append(html[lt:])
            break
        attrs, at = html[m.end() : end], end + 1
        if m[1]:
            opened.end(tag)
            continue
        if tag in CLOSES or tag in BLOCK:
            opened.implied(tag)
        top = opened.stack[-1]
        node = Node(tag, attrs, top)
        top.children.append(node)
        if tag in RAW:
            close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if close:
                node.children.append(html[at : close.start()])
                at = close.end()
            elif tag in ("script", "style", "template", "noscript", "textarea", "title"):
                at = n
            else:
                endless.add(tag)
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            opened.push(node)
    return root


def _bad_names(names: list[list[str]], reads: bool, discusses: bool) -> set[str]:
    """The words of class and id that mark an element as something else than the article.

    reads: whether it reads like text, so that a weak word beside one that says what it is about marks nothing; discusses:
    whether it may be the article's own discussion.
    """
    bad = set()
    for words in names:
        own = set(BAD_WORDS.intersection(words))
        heads = [w for w in words if w not in PARTS]
        if heads and heads[-1] in BAD_HEADS:
            own.add(heads[-1])
        if READERS.intersection(words) and heads and heads[-1] in REMARKS:
            own.add("comments")
        elif reads and own <= WEAK and ({w for w in words if w == "text" or w not in PARTS} - BAD_WORDS - BAD_HEADS - GENERIC or own <= {"discussion"} and discusses):
            own = set()
        bad |= own
    return bad


def unwanted(node: Node, in_article: bool) -> bool:
    """Whether an element is something else than the article: by its name, role, visibility or the words of class and id.

    Weak words only count where the part reads like links or a form. A header counts as the article's if it stands in what
    is named as its content or is named so itself.
    """
    if node.tag in DROPPED or node.hidden or node.role in BAD_ROLES:
        return True
    parent = node.parent
    if node.tag in CONTROLS:
        return not any(isinstance(c, str) and any(map(str.isalnum, c)) for c in parent.children)
    if node.tag == "header" and not in_article:
        named = [*node.names, *(parent.names if parent and parent.tag not in ("body", "html") else [])]
        if not any((GOOD_WORDS - {"page", "text"}).intersection(words) for words in named):
            return True
    if node.tag in ("html", "body", "main"):
        return False
    reads = node.prose > 0 and not node.fields and node.raw_links < 0.33 * node.raw
    bad = _bad_names(node.names, reads, in_article or node.heading)
    if not bad:
        return False
    if node.tag == "article":
        return bool(bad & {"comment", "comments", "reply", "ad", "ads", "advert", "related"})
    good = any(GOOD_WORDS.intersection(words) - {"text", "page", "body", "content"} for words in node.names)
    return not good or bool(bad & {"comment", "comments", "ad", "ads"})


_SENTENCE = frozenset(".!?:;…。！？：\"'”’»)")


def _measure_raw(root: Node) -> None:
    """Before anything is dropped, bottom up: characters, those in links, fields, and characters of blocks that are sentences."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    blocks: set[int] = set()
    for node in reversed(order):
        if node.tag in RAW:
            node.fields = int(node.tag in FIELDS)
            continue
        words = 0
        for c in node.children:
            if isinstance(c, str):
                text = c.strip()
                node.raw += len(text)
                words += text.count(" ") + 1 if text else 0
                node.tail = text[-1:] or node.tail
            else:
                node.raw += c.raw
                node.raw_links += c.raw if c.tag == "a" else c.raw_links
                node.prose += c.prose
                node.fields += c.fields
                node.tail = c.tail or node.tail
                node.heading |= c.heading or c.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
                if id(c) in blocks or c.tag in BLOCK:
                    blocks.add(id(node))
        node.fields += node.tag in FIELDS
        if id(node) not in blocks and node.tag in BLOCK and words >= 4 and node.tail in _SENTENCE:
            node.prose = node.raw


def _prune_and_measure(root: Node) -> list[Node]:
    """Drop unwanted elements, add up texts bottom up, and return the elements in page order."""
    _measure_raw(root)
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not unwanted(c, inside)]
        stack.extend((c, inside) for c in reversed(node.children) if not isinstance(c, str))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                text = c.strip()
                node.chars += len(text)
                node.commas += text.count(",") + text.count("，") + text.count("、")
            else:
                node.chars += c.chars
                node.commas += c.commas
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.links += 1 if c.tag == "a" else c.links
                node.block_inside |= c.tag in BLOCK or c.block_inside
    return order


def _final(node: Node) -> float:
    return node.score * (1 - node.link_chars / max(1, node.chars))


def _menu(node: Node) -> bool:
    """Whether an element is a list of links."""
    return node.tag in ("ul", "ol", "div", "section", "table") and node.links >= 3 and node.link_chars > 0.8 * node.chars


def _without_menus(children: list) -> list:
    """children but for lists of links; one under a heading of its own, or after a colon, belongs to the text unless that
    heading announces other pages, when both go."""
    out: list = []
    before, at = None, 0
    for c in children:
        if isinstance(c, str):
            before = c if c.strip() else before
        else:
            if _menu(c):
                heading = before is not None and not isinstance(before, str) and before.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
                said = (before if isinstance(before, str) else before.tail) if before is not None else ""
                if heading and before.chars < 200 and MENU_HEADS.search(" ".join(blocks_of(before))):
                    out[at], before = "", None
                    continue
                if not heading and said.rstrip()[-1:] not in (":", "："):
                    continue
            before, at = c, len(out)
        out.append(c)
    return out


def _reads(part: Node | str, article: bool) -> bool:
    """Whether what stands beside the best container, or beside an ancestor of it, belongs to the text."""
    if isinstance(part, str):
        return not article and bool(part.strip())
    if not part.chars:
        return False
    if article:
        return part.tag == "h1" or part.tag == "article" and part.link_chars < 0.5 * part.chars
    if part.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return True
    return part.link_chars < 0.33 * part.chars and (part.score is not None or part.block_inside or part.tag not in BLOCK or part.tag in _PARAGRAPHS or part.chars >= 40)


def best_part(root: Node) -> Node:
    """The body with the best container, and beside it what reads like text; the rest of the tree is cut off."""
    order = _prune_and_measure(root)

    def add(node: Node | None, points: float) -> None:
        if node is None or node.tag == "#root":
            return
        if node.score is None:
            node.score = _WEIGHT.get(node.tag, 0.0) + 25.0 * any(GOOD_WORDS.intersection(words) for words in node.names)
        node.score += points

    for node in order:
        if not node.chars or not (node.tag in _PARAGRAPHS or node.tag in ("div", "section", "article", "main", "body")) or node.block_inside:
            continue
        points = (1 + node.commas + min(node.chars / 100, 3.0)) * (1 - node.link_chars / node.chars)
        if node.tag not in _PARAGRAPHS:
            add(node, points)
        up, share = node.parent, 1.0
        for _ in range(3):
            add(up, points * share)
            up, share = up.parent if up else None, share / 2
    top = next((n for n in order if n.tag == "body"), root)
    scored = [n for n in order if n.score is not None]
    if not scored:
        return top
    best = node = max(scored, key=_final)
    article = None
    while node is not None:
        if node.tag == "article":
            article = node
        node = node.parent
    node = article or best
    if not article:
        node.children = _without_menus(node.children)
    while node is not top and node.parent is not None:
        parent = node.parent
        parent.children = [c for c in parent.children if c is node or _reads(c, article is not None)]
        node = parent
    return node


def blocks_of(top: Node) -> list[str]:
    """Texts of the blocks under a node: character references decoded, white space folded, trimmed, empty ones left out."""
    blocks: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = _SPACES.sub(" ", unescape("".join(buffer))).strip(" ")
        buffer.clear()
        if text:
            blocks.append(text)

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            buffer.append(x)
        elif x.tag == "br":
            buffer.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return blocks


def main_text(html: str | None) -> str:
    return "\n".join(blocks_of(best_part(parse(html)))) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    r"""Main text of each whole page: id_col, url_col, text (blocks in page order joined by \n, empty if none), n_chars.

    Null and empty pages give an empty text; pages without paragraphs give what is left of the body. What is left out
    are elements whose name, role, class or id says that they are no article, lists of links and, on a page with an
    article element, what stands outside of articles; within an article nothing else goes, however short. Repeated rows stay
    repeated, other columns are not looked at, an empty table gives no rows. One pass without shuffle.
    """
    types = {c: pages.select(c).schema[0].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(page) for texts in texts_of(batch, "html") for page in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = texts_in_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {types[id_col]}, url {types[url_col]}, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")

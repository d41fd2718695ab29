"""Main text of HTML pages by tree scoring.

Paragraph-like blocks earn points for their length and commas and pass them to their ancestors, all
of it to the parent and less further up; a container's points are discounted by its link density and
by a name of boilerplate.  The best container and the siblings like it are kept.  A name alone drops
an element only if a class or id starts with it and the element holds no more than half of the page's
paragraph points.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .textkit import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes plaintext".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option br".split())
DROP = frozenset("script style noscript template iframe nav footer aside menu dialog button select textarea input svg canvas object embed audio video head title noembed noframes math datalist xmp".split())
CLOSES_P = BLOCK - {"br", "body", "html"}
LEAF_LIKE = frozenset("p pre td blockquote h1 h2 h3 h4 h5 h6 li dd dt figcaption".split())
CONTAINER = frozenset("html body article section main div td blockquote center form fieldset ul ol dl table tbody tr figure details".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl div section article main aside nav footer header form body html td th blockquote".split())
BAD_WORD = (
    r"(?:ads?|adverts?|advert(?:isement|ising)|adsense|adbox|banner|breadcrumbs?|comments?|comment-?list|disqus|replies|respond|cookies?|cookie-?(?:bar|notice|banner|consent)|consent|gdpr|footer|header|masthead|menu|navbar|nav|navigation|newsletter|notice|notification|alert|pager|pagination|popup|modal|promo(?:tion)?|related|recommend(?:ed|ations)?|share|sharing|social|sidebar|side-?bar|side|skip|sponsor(?:ed)?|subscribe|signup|login|tags|toolbar|widget|outbrain|taboola|rail|shoutbox|legal|copyright)(?:$|[_-]|\d)"
)
BAD_START, BAD_PART = re.compile(BAD_WORD, re.I), re.compile(r"[_-]" + BAD_WORD, re.I)
# says of an element what is beside or below it
MODIFIER = re.compile(r"(?:^|.*[_-])(?:has|no|not|with|without|is|in|hide|show)[_-]", re.I)
DISCOUNT, LONG = 0.25, 80
GOOD_NAME = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.I)
BAD_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar alert alertdialog dialog form toolbar".split())
# a quote opens a value only after the equals sign; elsewhere it is a character of a name or of a bare value
ATTRS = r"""((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+|=)*+)"""
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)" + ATTRS + r"(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S)
BLANK = re.compile(r"[ \t\n\r\f\v   -     　\x85]+")
COMMA = re.compile(r"[,،、，]")


class Node:
    __slots__ = ("tag", "parent", "kids", "name", "named", "dropped", "chars", "links", "points", "raw", "commas", "order")

    def __init__(self, tag: str, parent: Node | None, name: str = "", dropped: bool = False):
        self.tag, self.parent, self.name, self.dropped = tag, parent, name, dropped
        self.kids: list[Node | str] = []
        self.chars = self.links = self.commas = self.order = self.named = 0
        self.points = self.raw = 0.0


def named(name: str) -> int:
    """2 if a class or id starts with a word for boilerplate, 1 if one has such a word further on, otherwise 0."""
    out = 0
    for token in name.split():
        if BAD_START.match(token):
            return 2
        m = BAD_PART.search(token)
        if m and not MODIFIER.match(token[: m.start() + 1]):
            out = 1
    return out


def parse(source: str) -> Node:
    """A forgiving tree of elements and strings."""
    root = Node("html", None)
    at, place, n = root, 0, len(source)
    find = TOKEN.search
    stack = [root]
    while place < n:
        m = find(source, place)
        if m is None:
            at.kids.append(source[place:])
            break
        if m.start() > place:
            at.kids.append(source[place : m.start()])
        place = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                at.kids.append("")
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                at.kids.append(Node("br", at))
                continue
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in SCOPE:
                    break  # an inline end tag doesn't close blocks
            at = stack[-1]
            continue
        if tag in ("html", "body"):
            if tag == "body":  # whatever head left open ends here
                while len(stack) > 1 and stack[-1].tag in ("head", "title"):
                    stack.pop()
                at = stack[-1]
            continue
        if tag in CLOSES_P or tag in SAME:
            same = SAME.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t in same or (t == "p" and tag in CLOSES_P) or (tag[0] == "h" and tag[1:].isdigit() and t[0] == "h" and t[1:].isdigit()):
                    del stack[i:]
                    break
                if t in SCOPE:
                    break
        if stack[-1].tag == "head" and tag in BLOCK:
            stack.pop()
        at = stack[-1]
        name, dropped, bad = "", tag in DROP, 0
        if m[3] and not m[3].isspace():
            attrs = {k.lower(): (a or b or c or "") for k, a, b, c in ATTR.findall(m[3])}
            name = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
            dropped = dropped or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in BAD_ROLE or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))
            if name and tag not in ("article", "main", "p", "span", "b", "i", "em", "strong", "a", "h1"):
                bad = named(name)
        if tag == "header" and not any(x.tag in ("article", "main") for x in stack):
            dropped = True
        node = Node(tag, at, name, dropped)
        node.named = bad
        at.kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, place)
            place = end.end() if end else n
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "path", "math"):
            continue
        stack.append(node)
        at = node
    return root


def measure(root: Node) -> list[Node]:
    """Fill in the sizes bottom up and give the nodes in page order."""
    nodes, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.dropped:
            continue
        x.order = len(nodes)
        x.chars = x.links = x.commas = 0
        x.raw = 0.0
        nodes.append(x)
        todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    for x in reversed(nodes):
        for k in x.kids:
            if isinstance(k, str):
                k = k.strip()
                x.chars += len(k)
                x.commas += len(COMMA.findall(k))
            elif not k.dropped:
                x.chars += k.chars
                x.commas += k.commas
                x.links += k.chars if k.tag == "a" else k.links
    return nodes


def density(x: Node) -> float:
    return x.links / x.chars if x.chars else 0.0


def paragraphs(nodes: list[Node]) -> list[tuple[Node, Node | None, float]]:
    """(block, container, points) of every paragraph-like block; raw becomes the sum of points in each element."""
    out = []
    for x in nodes:
        own = sum(len(k.strip()) for k in x.kids if isinstance(k, str)) if x.tag in ("div", "section", "article", "main") else 0
        if x.tag in LEAF_LIKE or own > 0:
            size = x.chars if x.tag in LEAF_LIKE else own
            if size < 1:
                continue
            points = (1 + x.commas + min(size / 100, 3)) * (1 - density(x))
            if size < 25:
                points *= size / 25
            out.append((x, x if own else x.parent, points))
            x.raw += points
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.raw += x.raw
    return out


def inside(x: Node | None, outer: Node) -> bool:
    while x is not None and x is not outer:
        x = x.parent
    return x is outer


def wraps(form: Node, found: list[tuple[Node, Node | None, float]], root: Node) -> bool:
    """A form around the article, as some frameworks make it: most points, in long paragraphs."""
    return 2 * form.raw > root.raw and sum(x.chars for x, _, _ in found if x.chars >= LONG and density(x) < 0.25 and inside(x, form)) >= 3 * LONG


def best(root: Node) -> list[Node]:
    """The container with most points and the siblings that belong to it."""
    nodes = measure(root)
    found = paragraphs(nodes)
    drop = [x for x in nodes if (x.named == 2 and 2 * x.raw <= root.raw) or (x.tag == "form" and not wraps(x, found, root))]
    for x in drop:
        x.dropped = True
    if drop:
        nodes = measure(root)
        found = paragraphs(nodes)
    for x, up, points in found:
        if up is not x and x.named:
            points *= DISCOUNT
        level = 0
        while up is not None and level < 6:
            if up.named:
                points *= DISCOUNT
            up.points += points / (1 if level == 0 else 2 * level)
            up, level = up.parent, level + 1
    marked = [x for x in nodes if x.tag in ("article", "main") and x.chars]
    for x in nodes:
        bonus = {"article": 1.6, "main": 1.5}.get(x.tag, 1.0) * (1.25 if GOOD_NAME.search(x.name) else 1.0)
        x.points *= bonus * (1 - density(x))
    pool = [x for x in nodes if x.tag in CONTAINER or x.tag == "main"]
    top = max(pool, key=lambda x: (x.points, -x.order))
    if not top.points:
        return [root] if not marked else marked[:1]
    # boilerplate by name around which the container has its own paragraphs
    for x in nodes:
        if x.named and not inside(top, x):
            rest = top.raw - x.raw if inside(x, top) else top.raw
            x.dropped = rest >= DISCOUNT * x.raw if x.named == 2 else rest > 0 and (x.raw < 1 or density(x) >= 0.25)
    # an enclosing article or main element is the container the author named
    up = top
    while up is not None:
        if up.tag in ("article", "main"):
            top = up
            break
        up = up.parent
    bar = max(5.0, top.points * 0.2)
    if top.parent is None:
        return [top]
    keep = []
    for s in top.parent.kids:
        if not isinstance(s, Node) or s.dropped:
            continue
        if s is top:
            keep.append(s)
        elif s.tag == top.tag and s.name == top.name and s.points >= bar:
            keep.append(s)
        elif s.tag in CONTAINER and s.points >= bar and density(s) < 0.25:
            keep.append(s)
        elif s.tag in ("p", "pre", "blockquote", "h1", "h2") and s.chars and (density(s) == 0 if s.chars < 80 else density(s) < 0.25):
            keep.append(s)
    return keep


def text_of(parts: list[Node]) -> str:
    """Blocks in page order, white space made one space, joined by one space."""
    pieces: list[str] = []
    for root in parts:
        todo: list[Node | str] = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                pieces.append(x)
            elif not x.dropped:
                if x.tag in BLOCK:
                    pieces.append(" ")
                    todo.append(" ")
                todo += x.kids[::-1]
    return BLANK.sub(" ", entities.unescape("".join(pieces))).strip(" ")


def main_text(source: str | None) -> str:
    return text_of(best(parse(source))) if source else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars (code points); columns of those names are replaced.

    Null, empty and contentless pages give the empty text; nothing is dropped or cut, however long.
    Rows are independent: ties and repeated rows give equal results.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for b in pieces(batches, html_col):
            out = [main_text(x) for x in b.column(b.schema.get_field_index(html_col)).to_pylist()]
            cols = {c: b.column(b.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_pydict(cols | {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})

    return pages.select(*keep, F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))

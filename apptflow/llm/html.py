"""Main text of web pages by tree scoring.

A page is cut into tags and text, and built into a tree (open paragraphs, list
items and table cells close as browsers close them).  Subtrees that are never
article text are left out: by tag (menus, headers, footers, asides, forms,
scripts, styles ...) or by the words of their class, id and role.  Every
paragraph passes points to its ancestors: one, one for each comma and up to
three for its length; in full to its parent, half to the next, and less further
up.  Points of a container are discounted by its link density.  From the best
container on the article is widened: to the article or main element around it,
else to one parent after the other as long as their text is low in links; then by
the siblings that score like it or read like prose.  What stands between kept
siblings is kept.  A page of which nothing scores is read again with the marks off
that hide its text.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import tidy

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_TAG_START = re.compile(r"</?[A-Za-z]")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
SKIP_TAGS = frozenset("head nav header footer aside form button select option label fieldset input dialog menu "
                      "script style title textarea noscript iframe noembed noframes template svg math canvas "
                      "object embed audio video map".split())
#: Words of class, id or role that mark what is not the article.
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo "
                         "promos outbrain taboola".split())
STRONG_WORDS = COMMENT_WORDS | ADVERT_WORDS | frozenset(
    "nav navbar navigation navi menu menus breadcrumb breadcrumbs topbar foot footer sidebar sidebars aside rail cookie "
    "cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login pagination pager toolbar "
    "complementary contentinfo searchbox".split())
#: Words that may also be what an article or one of its sections is about.
WEAK_WORDS = frozenset("promotion banner banners header masthead widget widgets notice notices alert discussion share sharing "
                       "social related recommended recommendations copyright legal disclaimer search".split())
LEAST_PROSE = 3.0            # points of paragraphs that make a weakly marked part of an article stay
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody "
                  "td tfoot th thead tr ul".split())
#: An opening tag closes these open elements, up to the nearest of the barriers.
CLOSES = {**{t: (frozenset(["p"]), frozenset(["table", "td", "th", "button"])) for t in BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot"}},
          "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu", "dir"])),
          "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
          "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
          "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
          "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
          "tbody": (frozenset(["tr", "td", "th", "p", "thead", "tbody", "tfoot"]), frozenset(["table"])),
          "tfoot": (frozenset(["tr", "td", "th", "p", "thead", "tbody"]), frozenset(["table"])),
          "option": (frozenset(["option"]), frozenset(["select"]))}
CONTAINERS = frozenset("article main section div body td li blockquote html".split())


class Node:
    __slots__ = ("tag", "up", "kids", "skip", "marked", "weak", "rival", "title", "article", "inside", "points", "chars", "links")

    def __init__(self, tag: str, up: "Node | None", skip: bool, marked: bool):
        self.tag, self.up, self.kids, self.skip, self.marked = tag, up, [], skip, marked
        self.weak = self.rival = self.title = False
        self.article = tag == "article" or up is not None and up.article
        self.inside = tag in ("article", "main") or up is not None and up.inside
        self.points, self.chars, self.links = 0.0, 0, 0

    @property
    def off(self) -> bool:
        """Left out by its tag."""
        return self.tag in SKIP_TAGS and not self.title


def _words(attrs: str) -> set[str]:
    """The words of class, id and role."""
    out: set[str] = set()
    for _, a, b, c in _ATTR.findall(attrs):
        out.update(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c).lower()))
    return out


def parse(html: str) -> Node:
    """The page's tree; text is kept as strings among a node's kids."""
    root = Node("#root", None, False, False)
    at, pos, size = root, 0, len(html)
    while pos < size:
        m = _TOKEN.match(html, pos)
        if m.group() == "<" and _TAG_START.match(html, pos):     # a quote that never closes, or the page ends
            m = _LOOSE.match(html, pos)
            if m is None:
                break
        pos, name = m.end(), m.group(2)
        if name is None:
            t = m.group()
            if t[0] != "<" or t == "<":
                at.kids.append(t)
            continue
        name = name.lower()
        if m.group(1):
            n = at
            while n is not None and n.tag != name:
                n = n.up
            if n is not None and n.up is not None:
                at = n.up
            continue
        if name in CLOSES:
            which, barrier = CLOSES[name]
            n = at
            while n.up is not None and n.tag not in barrier:
                if n.tag in which:
                    at = n.up
                n = n.up
        attrs = m.group(3)
        node = Node(name, at, False, False)
        has = _words(attrs) if attrs else set()
        node.title = name == "header" and at.article
        if name in ("article", "main") and not at.article:      # words mark these only inside an article (a card)
            node.rival = not has.isdisjoint(COMMENT_WORDS | ADVERT_WORDS)
        elif has and name not in ("html", "body") and not node.title:
            weak = not has.isdisjoint(WEAK_WORDS)
            node.marked = not has.isdisjoint(STRONG_WORDS) or weak and not at.inside
            node.weak = weak and not node.marked
        node.skip = at.skip or node.marked or node.off
        at.kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, pos)
            pos = end.end() if end else size
        elif name not in VOID and not attrs.endswith("/"):
            at = node
        elif name not in VOID and name not in ("svg", "math"):
            at = node                      # a slash doesn't close an HTML element
    return root


def _measure(root: Node) -> list[Node]:
    """All kept nodes in page order, with characters and characters in links."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.skip:
            continue
        order.append(n)
        todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    for n in reversed(order):
        n.chars += sum(len(_SPACE.sub(" ", k).strip()) for k in n.kids if isinstance(k, str))
        if n.tag == "a":
            n.links = n.chars
        if n.up is not None:
            n.up.chars += n.chars
            n.up.links += n.links
    return order


def _blocks(top: Node) -> list[str]:
    """Text by block, in page order."""
    out, run = [], []

    def flush():
        if run:
            t = _SPACE.sub(" ", unescape("".join(run))).strip()
            if t:
                out.append(t)
            run.clear()

    todo: list = [top]
    while todo:
        k = todo.pop()
        if k is flush:
            flush()
        elif isinstance(k, str):
            run.append(k)
        elif not k.skip:
            if k.tag == "br":
                run.append("\n")
            if k.tag in BLOCK:
                flush()
                todo.append(flush)
            todo.extend(reversed(k.kids))
    flush()
    return out


def _is_paragraph(n: Node) -> bool:
    return n.tag in ("p", "pre", "blockquote", "dd", "td") or (
        n.tag in ("div", "section", "article", "main", "li")
        and any(isinstance(k, str) and not k.isspace() for k in n.kids))


def _own_points(n: Node) -> float:
    """A paragraph's points; 0 for what is none."""
    own = "".join(_own_text(n)) if _is_paragraph(n) else ""
    length = len(_SPACE.sub(" ", own).strip())
    return 1.0 + own.count(",") + own.count("、") + own.count("，") + min(length / 100, 3.0) if length else 0.0


def _settle(root: Node) -> None:
    """Decide what words alone don't: headers of articles keep their headings,
    weakly marked parts stay by their own score, and article elements of comments or
    adverts go where another article or main element has paragraphs."""
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        nodes.append(n)
        if n.title and not n.skip:
            # a line or two beside the title (names, dates) is usual; prose is a site's
            prose = sum(_own_points(k) for k in _below(n) if k.tag not in HEADINGS)
            n.kids = _headings(n) if prose < LEAST_PROSE else []
        todo.extend(k for k in n.kids if isinstance(k, Node))
    weak, rivals = [n for n in nodes if n.weak and not n.skip], [n for n in nodes if n.rival and not n.skip]
    if not weak and not rivals:
        return
    order = _measure(root)
    points = {id(n): _own_points(n) for n in order}
    total = dict(points)
    for n in reversed(order):
        if n.up is not None and id(n.up) in total:
            total[id(n.up)] += total[id(n)]
    for n in weak:
        density = n.links / n.chars if n.chars else 1.0
        n.marked = density >= 0.25 or total[id(n)] * (1 - density) < LEAST_PROSE
    if rivals:
        under = set()
        for n in order:                                   # parents come before kids
            if n.rival or id(n.up) in under:
                under.add(id(n))
        if any(n.inside and id(n) not in under and points[id(n)] for n in order):
            for n in rivals:
                n.marked = True
    _reset(root)


def _below(n: Node):
    todo = [n]
    while todo:
        k = todo.pop()
        yield k
        todo.extend(x for x in k.kids if isinstance(x, Node) and not x.skip)


def _headings(n: Node) -> list:
    out, todo = [], list(reversed(n.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, Node) and not k.skip:
            if k.tag in HEADINGS:
                out.append(k)
            else:
                todo.extend(reversed(k.kids))
    return out


def _best(root: Node) -> tuple[Node | None, float]:
    """The container that scores best, and its score."""
    order = _measure(root)
    for n in order:
        points = _own_points(n)
        if not points:
            continue
        up, level = (n.up, 1) if n.tag in ("p", "pre", "dd", "td") else (n, 1)
        while up is not None and level < 6:
            up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            up, level = up.up, level + 1
    best, most = None, 0.0
    for n in order:
        if n.tag in CONTAINERS or n.up is None:
            score = n.points * (1 - n.links / n.chars) if n.chars else 0.0
            if score > most:
                best, most = n, score
    return best, most


def _reset(root: Node, marks: bool = True) -> list[tuple[Node, int]]:
    """Nodes with nothing counted and skipped anew, by tag alone without ``marks``;
    with the number of marks on their way."""
    out, todo = [], [(root, 0)]
    while todo:
        n, depth = todo.pop()
        depth += n.marked
        n.points, n.chars, n.links = 0.0, 0, 0
        n.skip = n.up is not None and n.up.skip or marks and n.marked or n.off
        out.append((n, depth))
        todo.extend((k, depth) for k in n.kids if isinstance(k, Node))
    return out


def _unmarked(root: Node) -> tuple[Node | None, float]:
    """The best container with the fewest marks off under which something scores."""
    nodes = _reset(root, marks=False)
    least = min((d for n, d in nodes if not n.skip and _is_paragraph(n) and "".join(_own_text(n)).strip()), default=0)
    off = [n for n, d in nodes if n.marked and d <= least]
    for n in off:
        n.marked = False
    _reset(root)
    best, _ = _best(root)
    path, up = set(), best
    while up is not None:
        path.add(id(up))
        up = up.up
    for n in off:
        n.marked = id(n) not in path
    _reset(root)
    return _best(root)


def main_blocks(html: str) -> list[str]:
    """Blocks of the main text."""
    root = parse(html)
    _settle(root)
    best, most = _best(root)
    if best is None:
        best, most = _unmarked(root)
    if best is None:
        return _blocks(root) if root.chars else []
    at, around = best, {}
    while at is not None:
        if at.tag in ("article", "main"):
            around[at.tag] = at
        at = at.up
    at = around.get("article") or around.get("main")
    if at is None:
        at = best
        while at.up is not None and at.up.links < 0.25 * at.up.chars:
            at = _narrowed(at, _low_in_links)
    if at.up is not None:
        at = _narrowed(at, lambda k: isinstance(k, Node) and not k.skip and _joins(k, most))
    return _blocks(at)


def _narrowed(n: Node, belongs) -> Node:
    """The parent, cut to the kids from the first to the last that belongs to ``n``;
    a line of text is not cut."""
    kids = n.up.kids
    at = [i for i, k in enumerate(kids) if k is n or belongs(k)]
    first, last = at[0], at[-1]
    while first and _inline(kids[first]) and _inline(kids[first - 1]):
        first -= 1
    while last + 1 < len(kids) and _inline(kids[last]) and _inline(kids[last + 1]):
        last += 1
    n.up.kids = kids[first:last + 1]
    return n.up


def _inline(k) -> bool:
    return isinstance(k, str) or k.tag not in BLOCK and not k.skip


def _low_in_links(k) -> bool:
    if isinstance(k, str):
        return not k.isspace()
    return not k.skip and k.links < 0.25 * k.chars


def _own_text(n: Node):
    """Text of a paragraph without that of paragraphs inside it."""
    todo = list(reversed(n.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            yield k
        elif not k.skip and k.tag not in BLOCK:
            todo.extend(reversed(k.kids))


def _joins(n: Node, most: float) -> bool:
    """A sibling of the best container that belongs to the article."""
    density = n.links / n.chars if n.chars else 1.0
    if n.points * (1 - density) >= max(10.0, 0.2 * most):
        return True
    return n.tag == "p" and n.chars > 80 and density < 0.25


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple = ()) -> DataFrame:
    """One row per row of ``pages``: (id_col, the columns ``keep``, text).

    Character references are decoded, white space inside a block is one space,
    blocks are trimmed and joined in page order by two newlines.  Null and empty
    pages, and pages without text, give the empty text; markup that is cut off
    or wrongly nested is read as far as it goes.  Repeated rows and null ids are
    rows like others; other columns are not read."""
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"), *kept)

    def run(batches):
        for b in batches:
            texts = ["\n\n".join(main_blocks(h)) if (h := x.as_py()) else "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(texts, pa.string())], names)

    names = ["id", *src.columns[2:], "text"]
    out = src.mapInArrow(tidy(run), T.StructType([src.schema["id"], *src.schema.fields[2:], T.StructField("text", T.StringType())]))
    return out.select(F.col("id").alias(id_col), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "text")

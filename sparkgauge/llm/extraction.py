"""HTML extraction by minimum cut.

A page is split into blocks: runs of text between block-level tags, with the path of the elements around them. A linear
classifier gives each block a cost of being called content or boilerplate, bounded by ``LIMIT``; these are the capacities to
the two terminals. Its features are the elements of the path, names of classes and ids, the density of links, and the
length and punctuation of the text. Neighbours in page order, and successive blocks of the same parent element, are joined
by smoothness edges. The minimum cut, found by maximum flow, is the labelling: all edges of a block together outweigh a weak
sign, as a short line or a doubtful name, and don't outweigh what an element or a plain name says.

Names count whole: every part between hyphens must be a sign or neutral, so "article-comments" is a sign and
"no-sidebar", "side-by-side" or "post-meta-content" are none. Scripts, styles and comments are no text. Character references
are decoded, white space inside a block becomes one space, blocks that are content are joined in page order by one space.

Pages stream through ``mapInArrow``; nothing is shuffled, and memory follows the longest page. Defined cases: null and
empty html, and pages without content, give an empty text; tags that never close, or that the page's end cuts off, are
taken as browsers do; null URLs and ids pass unchanged; repeated rows give repeated results; an empty table gives an empty
table; pages of any length and depth are taken whole; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

NEAR, SAME_PARENT = 0.35, 0.35
#: Bound of the classifier's costs.
LIMIT = 5.0
#: Fixed list of HTML's block-level elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul video audio canvas iframe object button textarea label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg textarea title iframe select".split())
#: What never is part of the text of a page.
HIDDEN = frozenset("head script style template svg title iframe select textarea button".split())
#: Start tags that close an open element: tag -> elements.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tbody",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",),
}
_CLOSE_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "label", "button", "select", "li", "dd", "dt"} | {"ul", "li", "dd", "dt", "table"}
#: Weights of the classifier: what an element around a block says, against content or for it.
AGAINST = {"nav": -4.5, "footer": -4.5, "aside": -4.5, "form": -4.5, "menu": -4.5, "dialog": -4.5, "header": -3.5}
FOR = {"article": 1.5, "main": 1.2}
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "main": "main", "article": "article"}
#: A header inside an article or main element mostly holds its title.
OWN_HEADER = -1.0
#: What the block's own element says.
TAG_WEIGHTS = {"h1": 0.6, "h2": 0.5, "h3": 0.4, "p": 0.6, "blockquote": 0.5, "pre": 0.4, "figcaption": 0.2, "address": -1.5, "label": -1.5, "legend": -1.5}
#: Parts of names that are a sign against content; those that say nothing beside one; doubtful ones; those for content.
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars widget widgets "
    "related recommended recommendations recommendation share sharing social nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager "
    "cookie cookies consent gdpr newsletter subscribe subscription signup login popup popups modal overlay comment comments commentlist replies respond disqus copyright disclaimer "
    "notice notices header".split()
)
NEUTRAL = frozenset(
    "list lists form section sections bar bars box boxes slot unit container wrapper wrap inner outer item items link links button buttons block blocks body text title heading thread "
    "user users reader readers site page main top bottom left right side global primary secondary post posts article articles area panel group row content icon icons policy media entry story author count".split()
)
DOUBTFUL = frozenset("meta tags tag legal byline search form side foot reply skip alert info".split())
GOOD = frozenset("article post entry story content main text prose body article-body post-body entry-content main-content post-content article-content articlebody".split())
SIGN, DOUBT, GOOD_NAME = -4.5, -1.5, 0.8
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)?)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
#: A name and, after an equals sign, its value, as browsers part them.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)?""")
_SPACES = re.compile(r"\s+")


class Block:
    __slots__ = ("linked", "parent", "path", "tag", "text")

    def __init__(self, text: str, tag: str, path: Path, parent: int, linked: int):
        self.text, self.tag, self.path, self.parent, self.linked = text, tag, path, parent, linked


class Path(NamedTuple):
    """What the elements around a block say: against content, for it, and doubtful names."""

    against: float = 0.0
    good: float = 0.0
    doubt: float = 0.0
    hidden: bool = False


def _name_weight(name: str) -> float:
    parts = name.split("-")
    if any(p in SIGNS for p in parts) and all(p in SIGNS or p in NEUTRAL for p in parts):
        return SIGN
    return DOUBT if name in DOUBTFUL else GOOD_NAME if name in GOOD else 0.0


def _inside(path: Path, tag: str, attributes: str) -> Path:
    """The path of what is in an element."""
    if path.hidden or tag in HIDDEN:
        return path._replace(hidden=True)
    names: list[str] = []
    seen = set()
    role = tag
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = value.strip("\"'").strip().lower(), name.lower()
        if name in seen:  # the first counts
            continue
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return path._replace(hidden=True)
        if name == "role":
            role = ROLES.get(value, role)
        elif name in ("class", "id"):
            names += value.replace("_", "-").split()
    weights = [_name_weight(n) for n in names] if tag not in ("html", "body") else []
    within = path.good >= 1.2  # an article or main element
    against = OWN_HEADER if role == "header" and within else AGAINST.get(role, 0.0)
    if (SIGN in weights and role not in FOR) and not (within and set(names) <= {"header", "article-header", "post-header", "entry-header"}):
        against = min(against, SIGN)
    good = max(path.good, FOR.get(role, 0.0), GOOD_NAME if GOOD_NAME in weights else 0.0)
    return Path(min(path.against, against), good, min(path.doubt, DOUBT if DOUBT in weights else 0.0))


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    out: list[Block] = []
    stack: list[tuple[str, Path, int]] = [("", Path(), 0)]
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = made = links = 0

    def flush() -> None:
        nonlocal linked
        joined = _SPACES.sub(" ", html.unescape("".join(text))).strip()
        if joined and not stack[-1][1].hidden:
            at = _innermost()
            out.append(Block(joined, stack[at][0], stack[-1][1], stack[max(0, at - 1)][2], linked))
        text.clear()
        linked = 0

    def _innermost() -> int:
        """The place of the innermost block-level element."""
        at = len(stack) - 1
        while at > 0 and stack[at][0] not in BLOCKS:
            at -= 1
        return at

    def put(part: str) -> None:
        nonlocal linked
        if part:
            text.append(part)
            if links:
                linked += len(part)

    def pop(to: int) -> None:
        nonlocal links
        for tag, _, _ in stack[to:]:
            opened[tag] -= 1
            if tag == "a":
                links -= 1
        del stack[to:]

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag in BLOCKS or any(s[0] in BLOCKS for s in stack[k:]):
                        flush()
                    pop(k)
                    break
            continue
        if not m[4]:  # cut off by the page's end
            break
        if tag == "br":
            put("\n")
            continue
        if tag in BLOCKS:
            flush()
            if tag in _CLOSE_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES.get(tag, ()):
                    pop(k)
                elif stack[k][0] in BLOCKS:
                    break
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        made += 1
        stack.append((tag, _inside(stack[-1][1], tag, m[3]), made))
        opened[tag] += 1
        links += tag == "a"
    put(page[at:] if m is None else "")
    flush()
    return out


def score(b: Block) -> float:
    """The classifier: above 0 for content."""
    n = len(b.text)
    ends = sum(b.text.count(c) for c in ".!?")
    path = b.path.against + (b.path.good if b.path.against > -2 else 0.0) + b.path.doubt + TAG_WEIGHTS.get(b.tag, 0.0)
    return max(-LIMIT, min(LIMIT, path - 4.0 * min(1.0, b.linked / n) + min(1.5, n / 120) + min(1.0, 0.5 * ends) - 0.8))


def labels(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for each node on the source's side of the minimum cut: content.

    Nodes whose own cost outweighs all their edges have the label that cost asks for in every minimum cut; they are
    fixed first, and their edges become costs of their neighbours. Maximum flow by Dinic's method settles the rest.
    """
    n, cost = len(scores), list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(cost[i]) >= sum(near[i].values()):
            side[i] = cost[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                cost[j] += w if side[i] else -w
                if side[j] is None:
                    todo.append(j)
            near[i].clear()
    open_nodes = [i for i in range(n) if side[i] is None]
    if open_nodes:
        content = _cut(open_nodes, cost, near)
        for i in open_nodes:
            side[i] = i in content
    return [bool(x) for x in side]


def _cut(nodes: list[int], cost: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side after a maximum flow."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if cost[i] > 0:
            room[source][i], room[i][source] = cost[i], 0.0
        elif cost[i] < 0:
            room[i][sink], room[sink][i] = -cost[i], 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, r in room[u].items():
                if r > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return {i for i in nodes if i in level}
        ways = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                full = next(k for k in range(len(path) - 1) if room[path[k]][path[k + 1]] <= 1e-12)
                del path[full + 1 :]
                continue
            for v in ways[u]:
                if level.get(v) == level[u] + 1 and room[u][v] > 1e-12:
                    path.append(v)
                    break
            else:
                path.pop()


def labelled(page: str | None) -> tuple[list[Block], list[bool]]:
    """The blocks of a page and, by the minimum cut, whether each is content."""
    found = blocks(page or "")
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR))
        if b.parent in last:
            edges.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    return found, labels([score(b) for b in found], edges)


def extract(page: str | None) -> str:
    found, keep = labelled(page)
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([extract(x.as_py()) for x in batch.column("html")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return pages.mapInArrow(_extracted, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op4(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))

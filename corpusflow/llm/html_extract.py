"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text. A linear classifier over a block's words, links,
tag and the names around it gives each its cost of being called content or
boilerplate; the costs are capacities of edges from the source and to the sink.
Smoothness edges join blocks that are neighbours in page order or in the
element tree, and a node that stands for an article element to each of its blocks.
So a short line, a list or a line of links takes the label of
what surrounds it, which its own costs could not give. The minimum cut, found
by maximum flow, is the labelling of least cost. Nodes whose own cost is at
least that of all their edges keep their label in some minimum cut, so they
are settled first and only the rest goes through the flow.

Pages are handled row by row, nothing is shuffled. Null html and pages without
content have empty text; repeated rows get the same text; an empty table gives
no rows; extra columns are ignored. Broken markup is read as browsers do:
elements without an end go on to the end of their parent.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Comments, declarations and tags. Possessive throughout, so broken markup costs no backtracking; the last form takes tags whose quotes do not close.
#: Tags end at a < outside quotes, so at most three scans (outside, in double, in single quotes) pass over any character.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?+)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?+)([a-zA-Z][^\s/<>]*+)([^<>]*+)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

#: Fixed values of HTML: elements whose content is no text of the page, and those that begin a block.
SKIPPED = frozenset("head script style noscript template title textarea select option svg math canvas iframe object audio video map datalist button".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening of the first closes open ones of the second.
CLOSES = {k: frozenset(v.split()) for k, v in {"li": "li p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p"}.items()}
LISTS = frozenset("ul ol menu dl table".split())

_NEG = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|adslot|banner|sponsor(?:ed)?|promo(?:tion|ted)?|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|share|sharing|social|sidebar|side|rail|widget|related|recommend(?:ed|ations)?|trending|popular|more-stories|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|topbar|masthead|header|footer|copyright|legal|disclaimer|comments?|commentlist|disqus|respond|replies|reply|discussion|responses|search|tagcloud|tags|skip|hidden|paywall|donate)(?=$|[\s_-]|\d)",
    re.I,
)
_WITH = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|is|single|full)-\S+", re.I)
_POS = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text|prose|blog)(?=$|[\s_-])", re.I)
_END = re.compile(r"[.!?…:;\"'”’)]\s*$")


@dataclass(frozen=True)
class Weights:
    """Log-odds of content for each sign, and the strengths of the smoothness edges."""

    base: float = -1.2
    positive_name: float = 0.8
    negative: float = -6.0
    heading: float = 0.6
    paragraph: float = 0.8
    sentence: float = 0.5
    per_word: float = 0.06
    most_words: float = 3.0
    links: float = -4.0
    #: edges to the next block, to the next block of one parent and one tag, and from an article's node to its blocks
    adjacent: float = 0.6
    sibling: float = 1.2
    section: float = 5.5
    #: what each block adds to what speaks for its article: less than short links speak against it
    article: float = 4.5
    last_resort: float = 2.0


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    negative: bool = False
    positive: bool = False
    article: bool = False
    holds_article: bool = False


@dataclass
class Block:
    node: Node
    text: str
    link_chars: int
    score: float = 0.0
    edges: dict[int, float] = field(default_factory=dict)
    article: Node | None = None


_NEG_TAGS = frozenset("nav aside footer form dialog menu search".split())


def _node(tag: str, attrs: str, parent: Node | None) -> Node:
    n = Node(tag, parent, parent.depth + 1 if parent else 0)
    name = role = ""
    hidden = False
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                name += " " + value
            elif key in ("role", "itemprop"):
                role += " " + value.lower()
            elif key == "aria-hidden":
                hidden |= value.lower() == "true"
            elif key == "style":
                hidden |= "none" in value and "display" in value
        hidden |= bool(re.search(r"(?:^|\s)hidden(?:\s|$)", _ATTR.sub(" ", attrs)))
    n.article = tag in ("article", "main") or "main" in role or "articlebody" in role or "article" in role.split()
    if tag not in ("html", "body"):
        n.negative = tag in _NEG_TAGS or hidden or bool(name and _NEG.search(_WITH.sub(" ", name))) or bool(re.search(r"navigation|banner|contentinfo|complementary|search|dialog|alert|form", role))
        n.positive = bool(name and _POS.search(name))
        if tag == "header" and not n.negative:
            up = parent
            while up is not None and not up.article:
                up = up.parent
            n.negative = up is None  # the page's header, not an article's
    return n


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    here = root = Node("", None, 0)
    stack = [root]
    words: list[str] = []
    links = in_link = 0
    skip: list[tuple[str, int]] = []  # open skipped elements, and how many elements of the stack they are in
    at = 0

    def end() -> None:
        nonlocal links
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append(Block(here, text, links))
            words.clear()
        links = 0

    def put(raw: str) -> None:
        nonlocal links
        if raw and not skip:
            t = unescape(raw) if "&" in raw else raw
            words.append(t)
            if in_link:
                links += len(t.strip())

    def shut_at(k: int) -> None:
        """Ends stack[k] and all in it."""
        del stack[k:]
        for i, (name, depth) in enumerate(skip):
            if name == "object":
                break  # ends of elements around it do not count in it
            if depth > k:
                del skip[i:]
                break

    def unskip(name: str) -> None:
        for i in range(len(skip) - 1, -1, -1):
            if skip[i][0] == name:
                del skip[i:]
                break

    length = len(html)
    while at < length:
        m = _TAG.search(html, at)
        if m is None:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = close.end() if close else length
        elif tag in SKIPPED:
            again = tag == "select" and not closing and any(name == tag for name, _ in skip)  # ends the open one
            if closing or again or tag == "button" or (skip and skip[-1][0] == tag == "option"):
                unskip(tag)
            if not closing and not again and not attrs.rstrip().endswith("/"):
                skip.append((tag, len(stack)))
        elif tag == "body" and not closing:
            skip.clear()
        elif tag == "br":
            if not skip:
                words.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCKS and tag not in ("html", "body"):
            end()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        shut_at(k)
                        break
            else:
                if len(stack) > 1 and stack[-1].tag == "p":
                    stack.pop()
                shut = CLOSES.get(tag)
                if shut:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in LISTS:
                            break
                        if stack[k].tag in shut:
                            shut_at(k)
                            break
                n = _node(tag, attrs, stack[-1])
                if (n.article or n.positive) and not n.negative:
                    up = n.parent
                    while up is not None and not up.holds_article:
                        up.holds_article = True
                        up = up.parent
                if tag not in VOID:
                    stack.append(n)
            here = stack[-1]
            in_link = 0
    end()
    return out


def classify(bs: list[Block], w: Weights) -> None:
    """Log-odds of each block's being content, and the article element that it is in, if no boilerplate one is between."""
    memo: dict[int, tuple[float, Node | None]] = {}

    def above(n: Node | None) -> tuple[float, Node | None]:
        """What the ancestors' names say: a boilerplate one outweighs all; one around an article says nothing."""
        path = []
        while n is not None and id(n) not in memo:
            path.append(n)
            n = n.parent
        got, article = memo[id(n)] if n is not None else (0.0, None)
        for n in reversed(path):
            if n.negative and not n.holds_article:
                got, article = w.negative, None
            elif got > w.negative:
                got = max(got, w.positive_name if n.positive else got)
                article = n if n.article else article
            memo[id(n)] = got, article
        return got, article

    for b in bs:
        n = b.text.count(" ") + 1
        tag = b.node.tag
        names, b.article = above(b.node)
        s = w.base + names + min(w.most_words, w.per_word * n) + w.links * b.link_chars / len(b.text)
        if tag in ("p", "blockquote", "pre", "td", "figcaption"):
            s += w.paragraph
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            s += w.heading
        if n > 4 and _END.search(b.text):
            s += w.sentence
        b.score = s


def connect(bs: list[Block], w: Weights) -> list[Block]:
    """The blocks and behind them a node for each article, with their edges.

    Edges go to the next block, the weaker the more steps in the tree are
    between, and to the next block of the same tag and parent. An article that
    is content holds its blocks; text in one that is not stands for itself.
    """
    last: dict[tuple[int, str], int] = {}
    nodes, hubs = list(bs), {}

    def join(i: int, j: int, x: float) -> None:
        for a, b in ((i, j), (j, i)):
            nodes[a].edges[b] = nodes[a].edges.get(b, 0.0) + x

    for j, b in enumerate(bs):
        group = (id(b.node.parent), b.node.tag)
        if j:
            a, c, steps = bs[j - 1].node, b.node, 0
            while a is not c and steps < 12:
                if a.depth >= c.depth:
                    a = a.parent or a
                else:
                    c = c.parent or c
                steps += 1
            join(j - 1, j, w.adjacent / (1 + 0.5 * steps))
        if group in last:
            join(last[group], j, w.sibling)
        last[group] = j
        if b.article is not None:
            if id(b.article) not in hubs:
                hubs[id(b.article)] = len(nodes)
                nodes.append(Block(b.article, "", 0))
            hub = nodes[hubs[id(b.article)]]
            hub.score += w.article
            hub.edges[j] = w.section
    return nodes


def cut(bs: list[Block]) -> list[bool]:
    """Which nodes lie on the source's side (content) of a minimum cut; ``edges[j]`` is paid where a node is content and j is not."""
    n = len(bs)
    label: list[bool | None] = [None] * n
    score, out = [b.score for b in bs], [dict(b.edges) for b in bs]
    into: list[dict[int, float]] = [{} for _ in bs]
    for i, es in enumerate(out):
        for j, x in es.items():
            into[j][i] = x
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and (score[i] >= sum(out[i].values()) or -score[i] >= sum(into[i].values())):
            label[i] = score[i] > 0
            for j, x in out[i].items():
                del into[j][i]
                score[j] += x if label[i] else 0.0
                todo.append(j)
            for j, x in into[i].items():
                del out[j][i]
                score[j] -= 0.0 if label[i] else x
                todo.append(j)
            out[i], into[i] = {}, {}
    free = [i for i in range(n) if label[i] is None]
    if free:
        side = max_flow({i: score[i] for i in free}, {i: out[i] for i in free})
        for i in free:
            label[i] = i in side
    return [bool(x) for x in label]


_EPS = 1e-9


def max_flow(score: dict[int, float], edges: dict[int, dict[int, float]]) -> set[int]:
    """Blocking flows over shortest paths; returns the nodes that the source still reaches.

    Nodes of positive score are fed by the source, of negative score drained by
    the sink; what is left of either is kept as the node's supply or demand.
    """
    cap = {i: dict(es) for i, es in edges.items()}
    for i, es in edges.items():
        for j in es:
            cap[j].setdefault(i, 0.0)
    supply = {i: x for i, x in score.items() if x > _EPS}
    demand = {i: -x for i, x in score.items() if x < -_EPS}
    while True:
        level = dict.fromkeys(supply, 0)
        queue, deep = deque(supply), None
        while queue:
            i = queue.popleft()
            if i in demand:
                deep = level[i] if deep is None else deep
            if deep is not None and level[i] >= deep:
                continue
            for j, c in cap[i].items():
                if c > _EPS and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if deep is None:
            return set(level)
        ways, at = {i: list(cap[i]) for i in level}, dict.fromkeys(level, 0)
        for s in list(supply):
            path = [s]
            while path:
                i = path[-1]
                if i in demand:
                    flow = min(supply[s], demand[i], *(cap[a][b] for a, b in zip(path, path[1:], strict=False)))
                    for a, b in zip(path, path[1:], strict=False):
                        cap[a][b] -= flow
                        cap[b][a] += flow
                    for of, k in ((supply, s), (demand, i)):
                        of[k] -= flow
                        if of[k] <= _EPS:
                            del of[k]
                    if s not in supply:
                        break
                    for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                        if cap[a][b] <= _EPS:
                            del path[k + 1 :]
                            break
                    continue
                while at[i] < len(ways[i]) and not (cap[i][ways[i][at[i]]] > _EPS and level.get(ways[i][at[i]]) == level[i] + 1):
                    at[i] += 1
                if at[i] < len(ways[i]):
                    path.append(ways[i][at[i]])
                else:
                    path.pop()  # nothing more goes through i in this phase
                    level[i] = -1


def extract(html: str | None, w: Weights = Weights()) -> tuple[str, int, int]:
    """Text, number of blocks and number of content blocks of a page."""
    bs = blocks(html or "")
    if not bs:
        return "", 0, 0
    classify(bs, w)
    nodes = connect(bs, w)
    ok = cut(nodes)[: len(bs)]
    if not any(ok):  # no block speaks for itself: what no ancestor speaks against
        for b in bs:
            b.score += w.last_resort
        ok = cut(nodes)[: len(bs)]
    kept = [b.text for b, good in zip(bs, ok, strict=True) if good]
    return "\n".join(kept), len(bs), len(kept)


def extract_pages(pages: DataFrame, w: Weights = Weights()) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_content of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(h, w) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_content"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int, n_content int")

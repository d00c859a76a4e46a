"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks.  A linear classifier over structure, names, links and words says for each
block how much it costs to call it content or boilerplate: the capacities of its edges from the source and to
the sink.  It is fitted to a sample of the pages themselves: where a page marks its article, the blocks tell
which they are, and the classifier learns to tell them with the mark taken away.  Blocks next to each other and blocks of one parent are joined by edges that are the stronger the
nearer they are in the document tree.  The minimum cut is the labelling of least total cost, found by
maximum flow; blocks on the source side are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.llm.bytetext import slices
from boxmill.llm.ship import ship

# fixed values: HTML elements by what they do
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr nobr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset(
    "script style noscript template svg math head title textarea select option button iframe object audio video canvas map".split()
)
RAW = frozenset("script style textarea title iframe noscript".split())
# start tags that leave a head open; any other one ends it, as text does
HEAD_TAGS = frozenset("html head title meta link base bgsound style script noscript template".split())
# unread elements that do not nest and whose end tag is often missing
CHOICES = frozenset("option button".split())
CLOSED_BY_THEIR_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
SIDE = frozenset("nav footer aside menu dialog".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
SIDE_NAMES = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer bottom sidebar aside rail ad ads adv advert adverts"
    " advertisement advertising banner promo promotion promoted sponsor sponsored cookie cookies consent gdpr notice notification"
    " alert popup modal overlay subscribe subscription newsletter signup login register social share sharing sharer follow comment"
    " comments commentlist reply replies respond disqus discussion related recommended recommendations trending breadcrumb"
    " breadcrumbs pagination pager widget widgets toolbar search searchbox copyright legal disclaimer skip tags tagcloud hidden"
    " form".split()
)
MAIN_NAMES = frozenset("article content post entry story main body text maincontent articlebody".split())

# what the classifier takes for granted before it has seen a page; positive is content
TAGS = {"p": 1.2, "h1": 1.5, "h2": 0.8, "h3": 0.6, "blockquote": 1.0, "pre": 1.0, "li": -0.3, "td": -0.3}
PRIOR = {"bias": -2.4, "length": 0.7, "links": -4.0, "stop": 0.5, **TAGS, "named": 2.0, "article": 1.5, "beside": -9.0}
# the sample the classifier is fitted to, and how many of its blocks outweigh the prior
SAMPLE_PAGES, BLOCKS_A_PAGE, EVIDENCE = 400, 200, 400.0
# strength of the edges
NEXT, SIBLING = 2.4, 1.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Element:
    """``side`` is what tags and roles say; ``aside`` the nearest element inside the article, and ``beyond`` the
    nearest one around it, that is named like something beside the text.  ``words`` and ``core`` (those in
    articles or under names of main content) are of the whole element once the page is read."""

    __slots__ = ("tag", "parent", "depth", "side", "main", "named", "form", "article", "aside", "beyond", "apart", "chief", "words", "core")

    def __init__(self, tag: str, attributes: str, parent: _Element | None):
        self.tag, self.parent, self.words, self.core, self.apart, self.chief = tag, parent, 0, 0, False, False
        self.depth = parent.depth + 1 if parent else 0
        self.side, self.main, self.named, self.form = (parent.side, parent.main, parent.named, parent.form) if parent else (False, False, False, None)
        self.article, self.aside, self.beyond = (parent.article, parent.aside, parent.beyond) if parent else (None, None, None)
        role, names = "", set()
        if tag in ("article", "main"):
            self.main = True
        elif tag in SIDE or tag == "header" and not self.main:
            self.side = True
        elif tag == "form":
            self.form = self
        if attributes:
            told = {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(attributes)}
            role = told.get("role", "").lower()
            if role in SIDE_ROLES or told.get("aria-hidden") == "true" or "display:none" in told.get("style", "").replace(" ", ""):
                self.side = True
            elif role in ("main", "article"):
                self.main = True
            names = {x.lower() for x in _NAME.findall(told.get("class", "") + " " + told.get("id", ""))}
        if tag in ("article", "main") or role in ("article", "main"):
            self.article, self.beyond, self.aside = self, self.aside or self.beyond, None
            # a comment or a teaser, say
            self.apart = not names.isdisjoint(SIDE_NAMES)
            self.chief = "main" in (tag, role)
        if names and tag not in ("body", "html", "article", "main") and role != "main" and not names.isdisjoint(SIDE_NAMES):
            # names such as "post-header" or "entry-header" inside the article belong to it
            if not (self.main and names & {"header"} and not names & (SIDE_NAMES - {"header"})):
                self.aside = self
        elif names and not names.isdisjoint(MAIN_NAMES):
            self.named = True


class _Block:
    __slots__ = ("parent", "text", "links")

    def __init__(self, parent: _Element, text: str, links: int):
        self.parent, self.text, self.links = parent, text, links


def _raw_end(page: str, tag: str, position: int) -> int:
    """Where the end tag of a raw text element is, -1 without one."""
    end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, position)
    return end.start() if end else -1


def _unclosed(page: str, tag: str, position: int) -> bool:
    """Whether the next tag of this name is no end tag."""
    found = re.compile(rf"<(/?){tag}[\s/>]", re.I).search(page, position)
    return not (found and found[1])


class _Open:
    """The elements open at a place of the page, by name, so that no end tag climbs to the top in vain."""

    def __init__(self, top: _Element):
        self.top = self.at = top
        self.named: dict[str, list[_Element]] = {}

    def enter(self, one: _Element):
        self.at = one
        self.named.setdefault(one.tag, []).append(one)

    def last(self, tag: str) -> _Element | None:
        found = self.named.get(tag)
        return found[-1] if found else None

    def innermost(self, tags) -> _Element | None:
        return max(filter(None, map(self.last, tags)), key=lambda one: one.depth, default=None)

    def leave(self, one: _Element):
        """Close ``one`` and all inside it."""
        until = one.parent
        while self.at is not until:
            self.named[self.at.tag].pop()
            self.at = self.at.parent


def blocks(page: str) -> list[_Block]:
    """The text blocks of a page in order, white space made single, character references decoded."""
    top = at = _Element("", "", None)
    opened = _Open(top)
    endless: set[str] = set()
    made = [top]
    found: list[_Block] = []
    parts: list[str] = []
    in_link, linked, unread, position = False, 0, "", 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(_Block(at, text, min(linked, len(text))))
                at.words += (n := text.count(" ") + 1)
                if not at.side and (at.named or at.article is not None) and not (at.article is not None and at.article.apart):
                    at.core += n
            parts.clear()
        linked = 0

    depth, resume, loose, inner = 0, "", False, Counter()
    while (token := _TOKEN.match(page, position)) is not None:
        position = token.end()
        tag = token[2] or token[5]
        if not tag:
            text = token[0]
            read = not text.startswith(("<!", "<?", "</"))
            if unread == "head" and read and text.strip():
                unread = ""
            if not unread and read:
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                if in_link:
                    linked += len(text)
            continue
        tag, closing, attributes = tag.lower(), bool(token[1] or token[4]), token[3] or token[6] or ""
        if unread == "head":
            if closing and tag in ("head", "body", "html", "br") or not closing and tag not in HEAD_TAGS:
                unread = ""
            elif closing or tag not in UNREAD or tag == "head":
                continue
        elif unread:
            # inside an element that is not read its own tags count, and the end of the element around it
            empty = attributes.endswith("/")
            if tag == unread:
                if unread in CHOICES:
                    depth, loose = int(not closing), not closing and _unclosed(page, tag, position)
                    inner.clear()
                elif not empty:
                    depth += -1 if closing else 1
                if depth <= 0:
                    unread = resume
                continue
            if tag in RAW:
                # foreign elements hold markup; script and style in them have an end or are empty
                foreign = unread in ("svg", "math")
                if not closing and not empty and (not foreign or tag in ("script", "style")):
                    # once there is no end, there is none further on
                    end = -1 if tag in endless else _raw_end(page, tag, position)
                    if end < 0:
                        endless.add(tag)
                    position = end if end >= 0 else position if foreign else len(page)
                continue
            if tag in INLINE or tag in VOID or tag in UNREAD or not closing and empty:
                continue
            if loose or closing and not inner[tag] and opened.last(tag) is not None:
                unread = ""
            else:
                if not closing:
                    inner[tag] += 1
                elif inner[tag]:
                    inner[tag] -= 1
                continue
        if tag in UNREAD:
            if not closing and not attributes.endswith("/"):
                if tag in RAW:
                    end = _raw_end(page, tag, position)
                    position = end if end >= 0 else len(page)
                resume, unread, depth = unread, tag, 1
                loose = tag in CHOICES and _unclosed(page, tag, position)
                inner.clear()
                parts.append(" ")
        elif tag in INLINE or tag in VOID:
            if tag == "a":
                in_link = not closing
            elif tag in ("br", "wbr", "img", "input"):
                parts.append("" if tag == "wbr" else " ")
            elif tag == "hr":
                flush()
        elif closing:
            up = opened.last(tag)
            flush()
            if up is not None:
                opened.leave(up)
                at, in_link = opened.at, False
        else:
            flush()
            if (likes := CLOSED_BY_THEIR_LIKE.get(tag)) is not None:
                up = opened.innermost((*likes, "ul", "ol", "dl", "table"))
                if up is not None and up.tag in likes:
                    opened.leave(up)
            elif opened.at.tag == "p":
                opened.leave(opened.at)
            at = _Element(tag, attributes, opened.at)
            opened.enter(at)
            made.append(at)
    flush()
    # parents come before their children
    for one in reversed(made[1:]):
        one.parent.words += one.words
        one.parent.core += one.core
    return found


def _beside(own: _Element, words: int, core: int) -> bool:
    """Whether names put a block beside the text."""

    def small(one: _Element | None) -> bool:
        # what holds most of the page is a frame around the text, unless the text is elsewhere
        return one is not None and (2 * one.words < words or 2 * one.core < core)

    article = own.article
    # a <main>, or the article that most of the text is in, is no part of what a name around it says
    leads = article is not None and (article.chief or not article.apart and 2 * article.core >= core)
    return small(own.aside) or not leads and small(own.beyond)


def _measures(block: _Block, words: int, core: int) -> list[tuple[str, float]]:
    """What the classifier sees of one block, without what is zero."""
    text, own = block.text, block.parent
    found = [("bias", 1.0), ("length", math.log(text.count(" ") + 2))]
    if block.links:
        found.append(("links", block.links / len(text)))
    if own.tag in TAGS:
        found.append((own.tag, 1.0))
    if text[-1] in ".!?…:;\"”»":
        found.append(("stop", 1.0))
    if own.main:
        found.append(("article", 1.0))
    elif own.named:
        found.append(("named", 1.0))
    # a form around most of the page is a frame; a smaller one is a form
    if own.side or own.form is not None and 2 * own.form.words < words or _beside(own, words, core):
        found.append(("beside", 1.0))
    return found


def _totals(found: list[_Block]) -> tuple[int, int]:
    """Words of the whole page, and those of its core."""
    top = found[0].parent if found else None
    while top is not None and top.parent is not None:
        top = top.parent
    return (top.words, top.core) if top is not None else (0, 0)


_MARK = re.compile(r"(</?)(?:article|main)(?=[\s/>])|(\srole\s*=\s*[\"']?)(?:article|main)\b", re.I)


def unmarked(page: str) -> str:
    """The page with its articles called plain divisions."""
    return _MARK.sub(lambda m: m[1] + "div" if m[1] else m[2] + "none", page)


def lessons(page: str) -> list[tuple[list[tuple[str, float]], bool]]:
    """Blocks of a page that marks its article: their measures without the mark, and whether they are in it.

    Empty for a page that marks none, or that falls into other blocks without the mark.  A page of very many
    blocks gives every k-th of them.
    """
    told, found = blocks(page), blocks(unmarked(page))
    if [b.text for b in told] != [b.text for b in found]:
        return []
    totals = _totals(told)
    seen = [dict(_measures(b, *totals)) for b in told]
    inside = [
        "article" in m and "beside" not in m and not (b.parent.article is not None and b.parent.article.apart)
        for m, b in zip(seen, told)
    ]
    if not any(inside):
        return []
    totals = _totals(found)
    step = -(-len(found) // BLOCKS_A_PAGE)
    return [(_measures(b, *totals), inside[k]) for k, b in enumerate(found) if k % step == 0]


def fitted(taught: list[tuple[list[tuple[str, float]], bool]]) -> dict[str, float]:
    """Weights of least logistic loss near the prior, by Newton steps.

    The mean loss counts as ``EVIDENCE`` blocks, so the sample's size does not change how far the weights may
    go.  A measure that no block has keeps its prior, all do without blocks.
    """
    names = list(PRIOR)
    prior = np.array([PRIOR[n] for n in names])
    if not taught:
        return dict(PRIOR)
    place = {n: k for k, n in enumerate(names)}
    x = np.zeros((len(taught), len(names)))
    for row, (measures, _) in enumerate(taught):
        for name, value in measures:
            x[row, place[name]] = value
    y = np.array([inside for _, inside in taught], float)
    share = EVIDENCE / len(taught)

    def loss(w):
        z = x @ w
        return share * (np.logaddexp(0.0, z) - y * z).sum() + ((w - prior) ** 2).sum() / 2

    w, before = prior, loss(prior)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = share * (x.T @ (p - y)) + w - prior
        bend = share * (x.T * (p * (1 - p))) @ x + np.eye(len(names))
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(w - size * step) > before:
            size /= 2
        w = w - size * step if size > 1e-6 else w
        after = loss(w)
        if before - after < 1e-9:
            break
        before = after
    return {n: float(v) for n, v in zip(names, w)}


def _distance(a: _Element, b: _Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(leaning: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut: node i costs ``leaning[i]`` if cut off from the source (or, where it is
    negative, its absolute value if cut off from the sink), an edge its weight if its ends part.

    Shortest augmenting paths (by levels).  A node that nothing pulls either way goes to the sink.
    """
    n = len(leaning)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    # a node stronger than all its edges keeps its side; its edges then pull their other ends
    pull, hold, near = list(leaning), [0.0] * n, [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
        hold[a] += w
        hold[b] += w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if side[k] is None and abs(pull[k]) > hold[k]:
            side[k] = pull[k] > 0
            for other, w in near[k]:
                if side[other] is None:
                    pull[other] += w if side[k] else -w
                    hold[other] -= w
                    queue.append(other)
    left = [k for k in range(n) if side[k] is None]
    if not left:
        return [bool(s) for s in side]
    for k in left:
        if pull[k] > 0:
            join(source, k, pull[k], 0.0)
        elif pull[k] < 0:
            join(k, sink, -pull[k], 0.0)
    for a, b, w in edges:
        if side[a] is None and side[b] is None:
            join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
            while nxt[a] < len(out[a]) and not (room[out[a][nxt[a]]] > 1e-9 and level[to[out[a][nxt[a]]]] == level[a] + 1):
                nxt[a] += 1
            if nxt[a] < len(out[a]):
                path.append(out[a][nxt[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                nxt[a] += 1
            else:
                break
    for k in left:
        side[k] = level[k] >= 0
    return [bool(s) for s in side]


def main_text(page: str | None, weights: dict[str, float] = PRIOR) -> str:
    """The content blocks of a page, one a line; empty for a NULL or empty page."""
    if not page:
        return ""
    found = blocks(page)
    words, core = _totals(found)
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for k, block in enumerate(found):
        if k:
            edges.append((k - 1, k, NEXT / (1 + _distance(found[k - 1].parent, block.parent))))
        up = id(block.parent.parent)
        if last.get(up, k - 1) != k - 1:
            edges.append((last[up], k, SIBLING))
        last[up] = k
    leaning = [sum(weights[name] * value for name, value in _measures(b, words, core)) for b in found]
    side = min_cut(leaning, edges)
    return "\n".join(b.text for b, content in zip(found, side) if content)


def _taught(batches):
    names = list(PRIOR)
    for batch in batches:
        for piece in slices(batch, "page"):
            for page in piece.column(0).to_pylist():
                rows = [(dict(measures), inside) for measures, inside in lessons(page)]
                values = [[m.get(n, 0.0) for n in names] for m, _ in rows]
                columns = [pa.array(values, pa.list_(pa.float64())), pa.array([y for _, y in rows], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["measures", "inside"])


def learn(pages: DataFrame, page: str = "html", sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights fitted to the ``sample`` unlike pages whose hashes are least, at most ``BLOCKS_A_PAGE`` blocks each.

    Pages without a marked article teach nothing; with none at all, or an empty table, the prior stays.
    """
    ship()
    told = pages.select(pages[page].cast("string").alias("page")).where("page != ''")
    told = told.select("page", F.xxhash64("page").alias("key"))
    last = told.select("key").distinct().orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    if last is None:
        return dict(PRIOR)
    # copies of a page are one page
    drawn = told.where(F.col("key") <= last).groupBy("key").agg(F.any_value("page").alias("page"))
    rows = drawn.select("page").mapInArrow(_taught, "measures array<double>, inside boolean").collect()
    # in an order of their own, so that sums do not hang on that of the tasks
    rows = sorted((tuple(r.measures), r.inside) for r in rows)
    return fitted([(list(zip(PRIOR, values)), inside) for values, inside in rows])


def _extract(batches, page: str, out: str, weights: dict[str, float]):
    for batch in batches:
        for piece in slices(batch, page):
            at = piece.schema.get_field_index(page)
            texts = [main_text(x, weights) for x in piece.column(at).to_pylist()]
            rest = [(n, piece.column(k)) for k, n in enumerate(piece.schema.names) if k != at]
            columns = [*[c for _, c in rest], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*[n for n, _ in rest], out, "n_chars"])


def extract(
    pages: DataFrame, page: str = "html", text: str = "text", weights: dict[str, float] | None = None
) -> DataFrame:
    """``pages`` with its main text in ``text`` and its length in code points in ``n_chars``, without ``page``.

    Pages are independent; a NULL, empty or text-free page has the empty text.  White space inside a block is
    one space, ``<br>`` included; blocks come in page order.  Broken markup is read as far as it goes: an
    element without an end ends with the one around it.  Without ``weights`` they are learnt from the pages
    first (``learn``), which reads the pages twice more.  Columns already called ``text`` or n_chars are
    replaced.
    """
    ship()
    weights = learn(pages, page) if weights is None else weights
    kept = [c for c in pages.columns if c not in (page, text, "n_chars")]
    name = "_page"
    while name in pages.columns:
        name += "_"
    bare = pages.select(*[pages[c] for c in kept], pages[page].cast("string").alias(name))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in bare.schema if f.name != name)
    return bare.mapInArrow(lambda b: _extract(b, name, text, weights), schema + f"`{text}` string, n_chars long")

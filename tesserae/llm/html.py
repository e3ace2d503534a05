"""Main text of HTML pages by minimum-cut labelling.

A page is read once into blocks: runs of text between block-level tags, with the elements
around them. A linear classifier gives each block the cost of calling it boilerplate or
content; these costs are the capacities of its edges to the two terminals. Blocks next to
each other, and blocks with the same parent, are tied by smoothness edges that weaken with
their distance in the tree. The minimum cut labels all blocks at once: blocks on the source
side are the main text. Elements that never hold article text (scripts, styles, navigation,
forms and the like) get an infinite capacity to the boilerplate terminal.

Blocks whose own costs exceed all edges that they have are decided beforehand and folded
into their neighbours, so that the flow runs over the few that are open, whatever the page's
length.

Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one newline. Null and empty pages, and pages without content, give
an empty text. Rows are independent: repeated rows repeat their result, an empty table stays
empty; other columns pass through only if asked for.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head title script style noscript template nav footer button select option textarea input label fieldset iframe object svg canvas aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the given kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id, role or the like.
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising alert aside author-box banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies copyright disclaimer discussion disqus footer form legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion reader-comments recommended related reply replies respond search share sharing sidebar sign signup skip social sponsor sponsored subscribe subscription tagcloud teaser toc toolbar topbar widget widgets contentinfo complementary".split())
#: Last parts of names that say nothing, first parts that name a state of the page.
GENERIC = frozenset("area bar block box container content group inner item items link links list panel section text title wrap wrapper".split())
STATES = frozenset("after before has hide is no not with without".split())
#: Elements whose names describe the page, not a part of it; elements that make a form around them a wrapper.
WRAPPERS, WRAPPED = frozenset("html body main article".split()), frozenset("article main h1".split())
#: Elements nested deeper than this become siblings, as browsers do.
DEEPEST = 256
CONTENT = frozenset("article body content entry main post story text prose".split())
#: Weights of the linear classifier, in nats: above 0 speaks for content.
WEIGHTS = {"bias": -1.2, "article": 2.6, "main": 1.8, "paragraph": 1.0, "heading": 0.3, "list": -0.3, "words": 0.55, "stops": 0.25, "links": -4.0, "boilerplate": -9.0, "content": 0.8, "header": -4.0}
NEIGHBOUR, SIBLING = 0.8, 0.4
INFINITE = 1e6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe)\b[^>]*>.*?(?:</(?P=raw)\b[^>]*>|\Z)|<svg\b[^>]*?(?:/>|>.*?(?:</svg\b[^>]*>|\Z))"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>""",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label|data-component)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_DISPLAY_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)


def hides(rest: str) -> bool:
    """Do a tag's attributes hide it: hidden, aria-hidden=true, or a style of display:none?"""
    if not _MAY_HIDE.search(rest):
        return False
    held: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        held.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").strip())
    hidden = "hidden" in held and held["hidden"].lower() != "until-found"
    return hidden or held.get("aria-hidden", "").lower() == "true" or bool(_DISPLAY_NONE.search(held.get("style", "")))


def is_boilerplate(name: str) -> bool:
    """Is a class, id or role a name for boilerplate: one of the words, or a compound that ends in one (site-footer, comment-list)?"""
    if name in BOILERPLATE:
        return True
    parts = _PART.findall(name)
    while len(parts) > 1 and parts[-1] in GENERIC:
        parts.pop()
    return bool(parts) and parts[-1] in BOILERPLATE and parts[0] not in STATES


class Element:
    __slots__ = ("tag", "number", "never", "form", "article", "main", "bad", "good", "header", "depth", "up", "block", "links")

    def __init__(self, tag: str, number: int, up: Element | None, rest: str):
        self.tag, self.number, self.up = tag, number, up
        self.depth = up.depth + 1 if up else 0
        inline = tag in INLINE and up is not None
        self.block = up.block if inline else self
        self.links = (up.links if inline else 0) + (tag == "a")
        names: set[str] = set()
        if rest and "=" in rest:
            for m in _NAMED.finditer(rest):
                names.update((m[1] or m[2] or m[3] or "").lower().split())
        self.never = bool(up and up.never) or tag in NEVER or bool(rest) and hides(rest)
        # A form counts as one unless it wraps the page's article.
        self.form = [True] if tag == "form" else up.form if up else None
        if tag in WRAPPED and self.form:
            self.form[0] = False
        self.article = bool(up and up.article) or tag == "article"
        self.main = bool(up and up.main) or tag == "main" or "main" in names
        bad = tag not in WRAPPERS and any(map(is_boilerplate, names))
        self.bad = bool(up and up.bad) or bad
        self.good = bool(up and up.good) or not bad and any(n in CONTENT or CONTENT.intersection(_PART.findall(n)) for n in names)
        self.header = bool(up and up.header) or (tag == "header" or tag not in WRAPPERS and "header" in names) and not self.article


class Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


def blocks_of(page: str) -> list[Block]:
    """Blocks of text with the element around them, in page order."""
    here = Element("#root", 0, None, "")
    out: list[Block] = []
    parts: list[str] = []
    linked, links, count, at = 0, 0, 0, 0
    end = page.rfind(">") + 1  # no tag ends after it
    opened: Counter[str] = Counter()

    def ended(x: Element) -> None:
        nonlocal here
        while here is not x.up:
            opened[here.tag] -= 1
            here = here.up

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, linked, here.block))
        linked = 0

    for m in _TOKEN.finditer(page, 0, end):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        if m["cdata"] is not None:
            parts.append(html.escape(m["cdata"]))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in INLINE:
                flush()
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
        if m["end"] or m["end2"]:
            x = here if opened[tag] else None
            while x is not None and x.tag != tag:
                # A stray end tag of an inline element ends nothing beyond its block.
                x = None if tag in INLINE and x.block is x else x.up
            if x is not None and x.up is not None:
                ended(x)
        else:
            ends = ENDS.get(tag, ())
            if tag not in INLINE and not ends:
                ends = {"p"}
            if any(opened[t] for t in ends):
                x = here
                while x is not None and x.tag not in ends and (x.tag in INLINE or x.tag == "p"):
                    x = x.up
                if x is not None and x.tag in ends and x.up is not None:
                    ended(x)
            count += 1
            rest = m["rest"] if m["rest"] is not None else m["rest2"] or ""
            if not rest.endswith("/") or tag in ("a", "p", "div"):
                if here.depth >= DEEPEST:
                    ended(here)
                here = Element(tag, count, here, rest)
                opened[tag] += 1
        links = here.links
    if at < len(page):
        tail = page[at:]
        if "<" not in tail or ">" in tail:
            parts.append(tail)
        else:
            parts.append(tail[: tail.rindex("<")] if re.match(r"</?[a-zA-Z]", tail[tail.rindex("<") :]) else tail)
    flush()
    return out


def preference(block: Block) -> float:
    """Log-odds of content against boilerplate."""
    e, w = block.element, WEIGHTS
    if e.never or e.form and e.form[0]:
        return -INFINITE
    words = block.text.count(" ") + 1
    score = w["bias"] + w["words"] * math.log(words)
    score += w["stops"] * min(8, sum(block.text.count(c) for c in ".,;:!?")) / (1 + 0.05 * words)
    score += w["links"] * min(1.0, block.linked / max(1, len(block.text)))
    score += w["article"] * e.article + w["main"] * (e.main and not e.article) + w["content"] * e.good
    score += w["boilerplate"] * e.bad + w["header"] * e.header
    score += w["paragraph"] if e.tag in ("p", "blockquote", "pre") else w["heading"] if e.tag in HEADINGS else w["list"] if e.tag == "li" else 0
    return score


def distance(a: Element, b: Element) -> int:
    """Edges between two elements of the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth and a.up is not None:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(block, block, capacity) for neighbours and for the nearest earlier block with the same parent."""
    out, last = [], {}
    for j, b in enumerate(blocks):
        if j:
            out.append((j - 1, j, NEIGHBOUR / (1 + distance(blocks[j - 1].element, b.element))))
        parent = b.element.up.number if b.element.up else -1
        if parent in last and last[parent] < j - 1:
            out.append((last[parent], j, SIBLING))
        last[parent] = j
    return out


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise sum(-odds of the true ones) + sum(capacity of edges with two labels); false on ties."""
    n = len(odds)
    odds, near = list(odds), [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # nodes that no neighbour can turn
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) >= sum(near[i].values()) and (odds[i] or not near[i]):
            label[i] = odds[i] > 0
            for j, c in near[i].items():
                if label[j] is None:
                    odds[j] += c if label[i] else -c
                    del near[j][i]
                    todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow([odds[i] for i in rest], near, rest)):
            label[i] = side
    return [bool(x) for x in label]


def _flow(odds: list[float], near: list[dict[int, float]], rest: list[int]) -> list[bool]:
    """Dinic's maximum flow; True on the source side of the minimum cut."""
    at = {i: k for k, i in enumerate(rest)}
    n, source, sink = len(rest) + 2, len(rest), len(rest) + 1
    to, cap, out = [], [], [[] for _ in range(n)]

    def edge(a: int, b: int, c: float, back: float = 0.0) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, i in enumerate(rest):
        if odds[k] > 0:
            edge(source, k, odds[k])
        elif odds[k] < 0:
            edge(k, sink, -odds[k])
        for j, c in near[i].items():
            if i < j:
                edge(k, at[j], c, c)
    tiny = 1e-9
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[: len(rest)]]
        turn, path = [0] * n, []
        a = source
        while True:
            if a == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if not path:
                    break
                a = to[path.pop() ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    labels = minimum_cut([preference(b) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, x in zip(blocks, labels) if x)


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """``keep`` columns and ``text``. One pass, no shuffle."""
    common.shipped(pages.sparkSession)
    kept = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{column}`").alias("__html"))
    schema = pages.select(*(F.col(f"`{c}`") for c in keep)).schema.add("text", "string", False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "__html"):
            texts = pa.array(map(main_text, block.column(block.num_columns - 1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], texts], names=[*block.schema.names[:-1], "text"])

    return kept.mapInArrow(work, schema)


def op3_html(spark, sf_dir: str) -> DataFrame:
    out = extracted(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

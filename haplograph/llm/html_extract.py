"""Main text of web pages by minimum-cut labelling of their blocks.

A page's text is cut into blocks at elements that bound text. A linear classifier gives each
block log-odds of being content from its place (elements, class and id words, roles, whether the
page marks an article), its own text (length, sentences, links, capitals, digits) and its kind.
The log-odds are terminal capacities; blocks that follow one another, the more so the nearer
they are in the tree, and blocks of one parent are tied by edges. A minimum cut labels the page.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that bound a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not text of the page as shown (code, fallbacks, pictures) or belongs to a form; skipped up to their end tag.
RAW = frozenset("script style title template noscript iframe noembed noframes audio video canvas svg textarea select option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article's text.
CHROME = frozenset("nav footer aside form menu dialog search".split())
#: Class and id words that name boilerplate, whatever stands in it, and what may be joined to them: navbar, commentlist, sidebar2.
NAMES = "ad ads adsbygoogle adv advert advertisement advertising adsense breadcrumb comment cookie consent disqus discussion footer gdpr login masthead menu modal nav navigation newsletter notice notification popup promo promotion reply replies respond sidebar signup sponsor sponsored subscribe subscription toolbar topbar widget banner copyright dropdown overlay skyscraper alert"
JOINED = "s area bar block body box container content count feed form group holder inner item items link links list menu module panel row section slot text thread title top unit wrap wrapper"
MARKED = re.compile("(?:{})(?:{})*+".format(*("|".join(sorted(w.split(), key=len, reverse=True)) for w in (NAMES, JOINED))))
#: Words that often name boilerplate and sometimes a subject: the block's own text decides with them.
HINTS = frozenset("related share sharing social search tags toc links legal privacy rail recommend recommended recommendations skip warning print header pagination aside footnav trending popular".split())
CONTENT_WORD = frozenset("article content entry main post story text body".split())
CHROME_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: End tags of these close an open p, as their start tags do.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*>|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z))", re.S)
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
STOP = re.compile(r"[.!?…](?=\s|$)")

#: Log-odds of a block's place: boilerplate by name, a hint of it, beside or inside a marked article, a word for content.
NAMED, HINTED, OUTSIDE, INSIDE, WELCOME = -10.0, -2.5, -4.0, 3.0, 1.0
#: Log-odds of its text: by length (times ln of characters over 60, within bounds), for each sentence, its end, links, capitals, digits, a copyright line.
LENGTH, SHORT, LONG, SENTENCE, SENTENCES, ENDED, OPEN, LINKED, CAPITALS, DIGITS, RIGHTS = 0.8, -2.2, 2.2, 0.3, 1.2, 0.6, -0.4, -5.0, -1.0, -1.0, -4.0
#: Log-odds of its kind of element.
KIND = {"h1": 1.2, "h2": 1.2, "h3": 0.8, "h4": 0.8, "h5": 0.6, "h6": 0.6, "p": 0.8, "blockquote": 0.8, "pre": 0.8, "li": -0.2, "td": -0.2, "th": -0.2}
#: Capacities: of blocks that follow one another, divided by their distance in the tree, and of neighbours among one parent's blocks.
ADJACENT, SIBLING, FAR = 2.0, 1.5, 12


@dataclass
class Block:
    """A run of text between block boundaries; score: its log-odds of being content."""

    text: str
    linked: int
    element: int
    parent: int
    tag: str
    score: float
    in_main: bool


@dataclass
class _Open:
    tag: str
    number: int
    place: float
    welcome: float
    in_main: bool


def _marks(tag: str, attrs: str) -> tuple[float, float]:
    """(log-odds against, log-odds for) by an element's own tag, class, id, role and style."""
    place, welcome = (NAMED if tag in CHROME else 0.0), 0.0
    if not attrs or len(attrs) < 3:
        return place, welcome
    for name, a, b, c in ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name in ("class", "id"):
            if tag in ("html", "body"):
                continue
            for word in WORD.findall(value):
                word = word.lower()
                named = MARKED.fullmatch(word) is not None
                if tag in ("main", "article"):  # of these, only a reader's comment is no content
                    if named and word.startswith(("comment", "repl")):
                        place = NAMED
                elif named:
                    place = NAMED
                elif word in HINTS:
                    place = min(place, HINTED)
                if word in CONTENT_WORD:
                    welcome = WELCOME
        elif name == "role":
            if value.lower() in CHROME_ROLE:
                place = NAMED
            elif value.lower() in ("main", "article"):
                welcome = max(welcome, INSIDE)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            place = NAMED
    return place, welcome


#: Elements that end one another where an end tag is left out.
MATES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """(the text blocks of a page in order with their log-odds, the parent of each element by number)."""
    out: list[Block] = []
    stack = [_Open("", 0, 0.0, 0.0, False)]
    parents = [0]
    at, link_level, linked = 0, 0, 0  # link_level: open elements when the open link began, 0 without one
    parts: list[str] = []
    has_main = False

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if link_level:
                linked += len(raw.strip())

    def close() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            if "&" in raw:
                raw = html_lib.unescape(raw)
            raw = " ".join(raw.split())
            if raw:
                top = stack[-1]
                out.append(Block(raw, min(linked, len(raw)), top.number, parents[top.number], top.tag, top.place + top.welcome, top.in_main))
        linked = 0

    while True:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        end = bool(m["end"] or m["end2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if not end and not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if name in ("script", "style", "title", "textarea") or stop:
                    at = stop.end() if stop else len(page)
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            link_level = 0 if end else len(stack)
            continue
        if name not in BLOCK:
            continue
        close()
        if name == "hr":
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "article", "main", "body") and name not in ("html", "body", "article", "main", "table"):
                    break
            if link_level > len(stack):
                link_level = 0  # the link's own block has ended
            continue
        if stack[-1].tag == "p" or (stack[-1].tag in HEADINGS and name in HEADINGS):
            stack.pop()
        if name in MATES:
            while stack[-1].tag in MATES[name]:
                stack.pop()
        above = stack[-1]
        parents.append(above.number)
        place, welcome = _marks(name, attrs)
        main = name in ("article", "main") or above.in_main or welcome >= INSIDE
        has_main |= main
        if name == "header" and not above.in_main:
            place = NAMED
        stack.append(_Open(name, len(parents) - 1, min(above.place, place), max(above.welcome, min(welcome, WELCOME)), main))
    close()
    for b in out:
        b.score += _content(b)
        if has_main:
            b.score += INSIDE if b.in_main else OUTSIDE
    return out, parents


def _content(b: Block) -> float:
    """Log-odds by a block's own text and element."""
    n = len(b.text)
    score = min(max(LENGTH * math.log((n + 1) / 60), SHORT), LONG) + KIND.get(b.tag, 0.0)
    score += ENDED if b.text[-1] in ".!?…\"'»”:;" else OPEN
    score += min(SENTENCE * len(STOP.findall(b.text)), SENTENCES)
    score += LINKED * b.linked / n
    letters = sum(map(str.isalpha, b.text)) or 1
    score += CAPITALS * (sum(map(str.isupper, b.text)) > 0.6 * letters and n > 3) + DIGITS * (sum(map(str.isdigit, b.text)) > 0.5 * n)
    if b.text[0] == "©" or b.text.startswith(("Copyright", "All rights reserved")):
        score += RIGHTS
    return score


def distance(a: int, b: int, parents: list[int]) -> int:
    """Steps between two elements of the tree, at least 1; FAR where they are as far or farther. Numbers grow from parent to child."""
    steps = 0
    while a != b and steps < FAR:
        if a > b:
            a = parents[a]
        else:
            b = parents[b]
        steps += 1
    return max(steps, 1)


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    A positive score is a capacity from the source, a negative one to the sink. A node whose
    terminal outweighs all its edges stays with it in some minimum cut; such nodes are settled
    first and hand their edges on to their neighbours' terminals. Augmenting paths of least
    length (Dinic) settle the rest.
    """
    n = len(scores)
    terminal = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        x = queue.popleft()
        if side[x] is not None or abs(terminal[x]) < sum(near[x].values()):
            continue
        side[x] = terminal[x] > 0
        for y, c in near[x].items():
            terminal[y] += c if side[x] else -c
            del near[y][x]
            queue.append(y)
        near[x] = {}
    rest = [x for x in range(n) if side[x] is None]
    if rest:
        for x, s in zip(rest, _dinic(rest, terminal, near)):
            side[x] = s
    return [bool(s) for s in side]


def _dinic(nodes: list[int], terminal: list[float], near: list[dict[int, float]]) -> list[bool]:
    place = {x: i for i, x in enumerate(nodes)}
    n = len(nodes)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def link(a: int, b: int, c: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, x in enumerate(nodes):
        if terminal[x] > 0:
            link(s, i, terminal[x], 0.0)
        elif terminal[x] < 0:
            link(i, t, -terminal[x], 0.0)
        for y, c in near[x].items():
            if place[y] > i:
                link(i, place[y], c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in head[x]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                keep = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                del path[keep:]
                x = to[path[-1]] if path else s
                continue
            while turn[x] < len(head[x]):
                e = head[x][turn[x]]
                if cap[e] > tiny and level[to[e]] == level[x] + 1:
                    break
                turn[x] += 1
            if turn[x] < len(head[x]):
                path.append(head[x][turn[x]])
                x = to[path[-1]]
            elif not path:
                break
            else:
                level[x] = -1
                path.pop()
                x = to[path[-1]] if path else s


def ties(blocks: list[Block], parents: list[int]) -> list[tuple[int, int, float]]:
    """The smoothness edges of a page's blocks."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            apart = distance(blocks[i - 1].element, b.element, parents)
            if apart < FAR:
                edges.append((i - 1, i, ADJACENT / apart))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return edges


def main_text(page: str | None) -> str:
    """The article's blocks, white space made single spaces, joined by an empty line."""
    if not page:
        return ""
    blocks, parents = blocks_of(page)
    keep = minimum_cut([b.score for b in blocks], ties(blocks, parents))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text from the whole html.

    Null and empty pages, and pages without content, have an empty text. Blocks of the page are
    scored by place (element, class, id, role) and by their own text; costs become terminal
    capacities, adjacency and a common parent become edges, and a minimum cut labels all blocks
    of a page together. Repeated rows are treated alike; other columns are ignored.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(_extract_batches, f"page_id {dict(own.dtypes)['page_id']}, url string, text string, n_chars long")

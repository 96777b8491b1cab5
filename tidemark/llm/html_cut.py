"""Main text of web pages: blocks labelled by a minimum cut over classifier costs and DOM smoothness."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import scan

_REST = (
    r"<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|</?[a-zA-Z][^<>]*(?:>|\Z)"
)
_COMMENT = r"<!--(?:.*?-->|.*\Z)|"
_TAG = re.compile(_COMMENT + r"<!\[CDATA\[.*?\]\]>|" + _REST, re.S)
#: For what follows the last end of a marked section: an open one there is a comment up to the next ``>``.
_TAG_AFTER = re.compile(_COMMENT + _REST, re.S)
_HINT = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Fixed element sets: contents that are never text, that stand in blocks of their own, and that have no end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object select option button head".split())
UNPARSED = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html body p div section article main header footer nav aside form fieldset figure figcaption address blockquote pre h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption hr details summary menu dialog center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag ends when they are still open, looked for up to the nearest container.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body html nav aside form".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog fieldset label".split())
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup"
    r"|nav\w*|menu|breadcrumbs?|sidebar|widget|related|recommended|share|sharing|social|comments?|commentlist|disqus|reply|replies|respond|footer|header|masthead|topbar"
    r"|login|search\w*|pager|pagination|toolbar|copyright|legal|disclaimer|skip|tags|complementary|contentinfo|banner|alert\w*)(?=$|[\s_-])",
    re.I,
)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|body)(?=$|[\s_-])", re.I)
#: Weights of the block classifier (log odds of being content) and of the smoothness edges.
WEIGHTS = {"bias": -1.2, "words": 0.5, "links": -3.5, "sentence": 0.6, "content": 3.0, "furniture": -7.0, "header": -4.0, "heading": 0.6}
ADJACENT, SIBLING = 0.35, 0.35


class Block:
    __slots__ = ("parent", "depth", "parts", "linked", "content", "furniture", "header", "heading", "text")

    def __init__(self, frame: Frame):
        self.parent, self.depth = frame.serial, frame.depth
        self.content, self.furniture, self.header, self.heading = frame.content, frame.furniture, frame.header, frame.name in ("h1", "h2", "h3")
        self.parts: list[str] = []
        self.linked = 0
        self.text = ""


class Frame:
    __slots__ = ("name", "serial", "depth", "content", "furniture", "header", "silent", "link")

    def __init__(self, name: str, serial: int, up: Frame | None, attrs: str = ""):
        self.name, self.serial = name, serial
        self.depth = up.depth + 1 if up else 0
        self.content = bool(up and up.content)
        self.furniture = bool(up and up.furniture)
        self.header = bool(up and up.header)
        self.silent = bool(up and up.silent) or name in RAW
        self.link = bool(up and up.link) or name == "a"
        if name in ("article", "main"):
            self.content = True
        if name in FURNITURE_TAGS:
            self.furniture = True
        if name == "header" and not self.content:
            self.header = True
        if attrs:
            if _HIDDEN.search(attrs):
                self.silent = True
            if name in BLOCK and name not in ("html", "body"):
                hints = " ".join(a or b or c for a, b, c in _HINT.findall(attrs))
                if hints:
                    if FURNITURE.search(hints):
                        self.furniture = True
                    elif CONTENT.search(hints):
                        self.content = True


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order; a block ends where a block element begins or ends."""
    stack = [Frame("", 0, None)]
    out: list[Block] = []
    now: Block | None = None
    serial, at, n = 0, 0, len(html)
    marked = html.rfind("]]>")
    standing: Counter[str] = Counter()

    def leave(k: int) -> None:
        standing.subtract(f.name for f in stack[k:])
        del stack[k:]

    def say(text: str) -> None:
        nonlocal now
        frame = stack[-1]
        if frame.silent or not text:
            return
        if now is None:
            if text.isspace():
                return
            owner = next((f for f in reversed(stack) if f.name in BLOCK), stack[0])
            now = Block(owner)
            # hints of inline elements do not reach here; the block element decides
            out.append(now)
        now.parts.append(text)
        if frame.link:
            now.linked += len(text)

    while at < n:
        m = (_TAG if at < marked else _TAG_AFTER).search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            if m.re is _TAG and m.group(0).startswith("<![CDATA[") and m.group(0).endswith("]]>"):
                say(m.group(0)[9:-3])
            continue
        name = name.lower()
        if m.group("end"):
            for k in range(len(stack) - 1, 0, -1) if standing[name] > 0 else ():
                if stack[k].name == name:
                    if any(f.name in BLOCK for f in stack[k:]):
                        now = None
                    leave(k)
                    break
            else:
                if name in BLOCK:
                    now = None
            continue
        if name in UNPARSED:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else n
            continue
        if name in BLOCK:
            now = None
            if stack[-1].name != "" and name != "hr":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        leave(k)
                        break
                    if stack[k].name in SCOPE or stack[k].name in IMPLIED:
                        break
            ends = IMPLIED.get(name)
            if ends:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ends:
                        leave(k)
                        break
                    if stack[k].name in SCOPE:
                        break
        if name == "br":
            say(" ")
        if name in VOID or m.group("attrs").endswith("/") and name not in BLOCK:
            continue
        serial += 1
        standing[name] += 1
        stack.append(Frame(name, serial, stack[-1], m.group("attrs")))
    for b in out:
        b.text = " ".join(unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def log_odds(b: Block) -> float:
    """Log odds that a block is content, from its own text and its ancestors."""
    words = b.text.count(" ") + 1
    raw = sum(map(len, b.parts)) or 1
    w = WEIGHTS
    return (
        w["bias"] + w["words"] * math.log2(1 + words) + w["links"] * min(1.0, b.linked / raw) + w["sentence"] * (b.text[-1] in ".!?…\"”")
        + w["content"] * b.content + w["furniture"] * b.furniture + w["header"] * b.header + w["heading"] * b.heading
    )


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise the classifier costs plus the weights of edges between unlike labels.

    A positive score is what label False costs more, a negative one what True does. A node whose score outweighs all its
    edges has that label in every minimum, so it is fixed and its edges become terminal capacities; what is left goes through
    blocking flows from nodes with source capacity to nodes with sink capacity; of several minima it gives one.
    """
    n = len(scores)
    left = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(left[i]) >= sum(near[i].values()):
            label[i] = left[i] >= 0
            for j, w in near[i].items():
                left[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    free = [i for i in range(n) if label[i] is None]
    while True:
        level = {i: 0 for i in free if left[i] > 1e-12}
        queue, reached = deque(level), False
        while queue:
            i = queue.popleft()
            reached |= left[i] < -1e-12
            for j, w in near[i].items():
                if w > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            for i in free:
                label[i] = i in level
            return [bool(x) for x in label]
        open_ = {i: list(near[i]) for i in level}
        for source in [i for i in free if left[i] > 1e-12]:
            path = [source]
            while path and left[source] > 1e-12:
                i = path[-1]
                if left[i] < -1e-12:
                    flow = min(left[source], -left[i], *(near[a][b] for a, b in zip(path, path[1:])))
                    for a, b in zip(path, path[1:]):
                        near[a][b] -= flow
                        near[b][a] += flow
                    left[source] -= flow
                    left[i] += flow
                    path = [source]
                    continue
                while open_[i] and not (level.get(open_[i][-1]) == level[i] + 1 and near[i][open_[i][-1]] > 1e-12):
                    open_[i].pop()
                if open_[i]:
                    path.append(open_[i][-1])
                else:
                    path.pop()
                    if path:
                        open_[path[-1]].pop()


def main_text(html: str | None) -> tuple[str, list[tuple[str, bool]]]:
    """The content blocks joined by blank lines, and all blocks with their labels."""
    found = blocks(html or "")
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT / (1 + abs(b.depth - found[i - 1].depth))))
        k = last.get((b.depth, b.content, b.furniture))
        if k is not None:
            edges.append((k, i, SIBLING))
        last[b.depth, b.content, b.furniture] = i
    labels = min_cut([log_odds(b) for b in found], edges)
    return "\n\n".join(b.text for b, keep in zip(found, labels) if keep), [(b.text, keep) for b, keep in zip(found, labels)]


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every page with ``text`` and ``n_chars`` (its code points).

    Null or blank html gives an empty text. Unclosed, misnested and unknown tags are read as a browser would, roughly;
    nothing is cut off. Pages do not depend on each other, so there is no shuffle; repeated rows give repeated rows.
    """

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            html = batch.column(len(keep))
            for i in range(0, batch.num_rows, 256):
                texts = [main_text(x.as_py())[0] for x in html.slice(i, 256)]
                columns = [batch.column(k).slice(i, 256) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

        return work

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return scan(pages, [*keep, F.col(html_col).alias("_html")], f"{schema}, text string, n_chars long", make)

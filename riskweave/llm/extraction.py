"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf path of tags and classes. For every path the
text length and the punctuation of its blocks are averaged and multiplied, less what stands in links. Scores are
smoothed along the page among blocks of one container (so a heading takes part of its paragraphs' score), fused with
the score of the container, and paths below a share of the text-weighted mean are dropped.

What a page declares comes in two strengths. Elements that cannot be the article (navigation, footers, asides, forms, scripts,
hidden elements) give no blocks. Words of a class, id or role that name boilerplate are a weight on the paths below them, which
decides only between text with and text without it: a path that holds ``MOST`` of the page's text outside of links is
not boilerplate whatever its name, so the weight is left off there. With an ``article`` or ``main`` element the rest of
the page counts little.

Each page is worked on alone, in time linear in its length however deep it is: no shuffle, and any partitioning gives
the same text.

Defined results: null or empty html, or a page without content: ''. Broken markup is read as browsers do in the common
cases (open paragraphs, list items and cells end at the next one; stray end tags are ignored; an unfinished comment or
script runs to the end). Repeated rows are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import text_blocks

TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)
    |(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>
    |(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.X | re.S)
ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、！？；：]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th
    thead tr ul""".split())
NEVER = frozenset("head nav footer aside form button select option menu dialog svg object canvas audio video map fieldset".split()) | RAW
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("body div section center".split())
#: An open element of the left kind ends where one of the right kind starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
        "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words of class, id or role that name parts which are not the article.
BOILERPLATE = frozenset("""ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs captcha comment commentlist comments
    consent cookie cookies copyright dialog discussion disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter
    notice overlay pagination pager paywall popup promo promoted promotion recommended related replies respond search share sharing
    sidebar signup skip social sponsor sponsored subscribe subscription tags taglist toolbar widget complementary contentinfo""".split())
HEADER = frozenset("header masthead".split())
#: Words before one of those that turn it round, as in ``no-sidebar``.
TURNED = frozenset("no has with without hide is not".split())
KEPT, PART, GONE = 0, 1, 2  # what an element says of itself: content, a header (headings only, if in an article), no article
NAMED, HEADED = 3, 4  # its class, id or role names boilerplate, or a header
MOST = 0.85  # of a page's text: what holds that much is content
NEAR = frozenset("p td th button table".split())


def _says(tag: str, attrs: str) -> int:
    if tag in NEVER:
        return GONE
    state = PART if tag == "header" else KEPT
    if attrs and tag not in ("html", "body", "article", "main") and ("=" in attrs or "hidden" in attrs):
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                words = re.split(r"[^a-z0-9]+", value)
                words = {w for before, w in zip(["", *words], words, strict=False) if before not in TURNED}
                if words & BOILERPLATE and state == KEPT:
                    state = NAMED
                elif words & HEADER and state == KEPT:
                    state = HEADED
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return GONE
    return state


def _class(attrs: str) -> str:
    found = re.search(r"""class\s*=\s*["']?([^"'>]*)""", attrs) if attrs else None
    return "." + ".".join(sorted(re.sub(r"\d+", "", found[1]).split())) if found else ""


class Block(NamedTuple):
    path: int
    holder: int  # number of its container
    inside: bool  # an article
    linked: int  # characters in links
    text: str
    mark: int  # the innermost path above it that names boilerplate, or -1


class Open(NamedTuple):
    """An open element, with what follows from those around it."""

    tag: str
    says: int
    path: int
    holder: int
    near: int  # depth of the nearest element of NEAR, itself included
    block: int  # and of the nearest block element
    mark: int
    other: int  # the same without headers


def blocks(html: str) -> tuple[list[Block], list[int]]:
    """The blocks that are not declared to be no article, and for each path the next one above it that names boilerplate.

    Paths are numbers of (path above, name); every step looks at the open elements through their depths by tag."""
    out: list[Block] = []
    stack: list[Open] = []
    depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
    paths: dict[tuple[int, str], int] = {}
    above: list[int] = []  # of each path: the mark over it
    parts: list[str] = []
    linked = gone = part = article = links = heads = 0

    def end_block():
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            top = stack[-1] if stack else Open("", KEPT, -1, -1, -1, -1, -1, -1)
            # a heading in the header of an article belongs to it
            out.append(Block(top.path, top.holder, article > 0, min(linked, len(text)), text, top.other if article and heads else top.mark))
        linked = 0

    def pop_to(depth: int):
        nonlocal gone, part, article, links, heads
        while len(stack) > depth:
            top = stack.pop()
            depths[top.tag].pop()
            gone -= top.says == GONE
            part -= top.says == PART
            article -= top.tag in ("article", "main")
            links -= top.tag == "a"
            heads -= top.tag in HEADING

    def push(tag: str, attrs: str, place: int):
        nonlocal gone, part, article, links, heads
        says, over = _says(tag, attrs), stack[-1] if stack else None
        key = (over.path if over else -1, tag + _class(attrs) + ("!" if says in (NAMED, HEADED) else ""))
        path = paths.setdefault(key, len(paths))
        mark = over.mark if over else -1
        if path == len(above):
            above.append(mark)
        # The outermost article or main holds all in it; elsewhere the nearest container does.
        holder = place if tag in ("article", "main") or tag in CONTAINER else over.holder if over else -1
        depth = len(stack)
        stack.append(Open(tag, says, path, over.holder if article else holder, depth if tag in NEAR else over.near if over else -1,
                          depth if tag in BLOCK else over.block if over else -1, path if says in (NAMED, HEADED) else mark,
                          path if says == NAMED else over.other if over else -1))
        depths[tag].append(depth)
        gone += says == GONE
        part += says == PART
        article += tag in ("article", "main")
        links += tag == "a"
        heads += tag in HEADING

    def deepest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=-1)

    def take(raw: str):
        nonlocal linked
        if gone or (part and not (article and heads)):
            return
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    at, size = 0, len(html)
    while at < size:
        m = TAG.search(html, at)
        if m is None:
            take(html[at:])
            break
        if m.start() > at:
            take(html[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attrs = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if tag == "br":
            parts.append(" ")
        elif closing:
            if tag in BLOCK:
                end_block()
            k = deepest((tag,))
            # An inline end tag does not reach out of its block.
            if k >= 0 and (tag in BLOCK or stack[-1].block <= k):
                pop_to(k)
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else size
            if end:
                at = html.find(">", at) + 1 or size
        else:
            if tag in BLOCK:
                end_block()
                ended = [t for t, by in ENDS.items() if tag in by]
                while ended and (k := deepest(ended)) > deepest([*SCOPE.get(tag, ()), "table"]):
                    pop_to(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                if stack and stack[-1].near >= 0 and stack[stack[-1].near].tag == "p":
                    pop_to(stack[-1].near)
            if tag not in VOID and not attrs.endswith("/"):
                push(tag, attrs, at)
    end_block()
    return out, above


def demoted(found: list[Block], above: list[int]) -> list[bool]:
    """Which blocks lie below a path that names boilerplate and holds less than MOST of the page's text outside of links."""
    held: dict[int, int] = defaultdict(int)
    total = 0
    for b in found:
        total += len(b.text) - b.linked
        if b.mark >= 0:
            held[b.mark] += len(b.text) - b.linked
    marks = sorted(set(held), reverse=True)
    for m in marks:  # what a path holds, the paths above hold too; those have lower numbers
        while (m := above[m]) >= 0 and m not in held:
            held[m] = 0
    for m in sorted(held, reverse=True):
        if above[m] >= 0:
            held[above[m]] += held[m]
    low: dict[int, bool] = {-1: False}
    for m in sorted(held):
        low[m] = held[m] < MOST * total or low[above[m]]
    return [low[b.mark] for b in found]


def select(found: list[Block], above: list[int], share: float = 0.12, outside: float = 0.02, named: float = 0.001, blend: float = 0.5) -> list[str]:
    """The texts of the blocks on content paths."""
    if not found:
        return []
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    holders: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for b in found:
        free = len(b.text) - b.linked
        s = sums[b.path]
        s[0] += free * (free / len(b.text))
        s[1] += len(PUNCTUATION.findall(b.text)) * (free / len(b.text))
        s[2] += 1
    ratio = {p: n / k * (1 + c / k) for p, (n, c, k) in sums.items()}
    for b in found:
        holders[b.holder][0] += ratio[b.path] * len(b.text)
        holders[b.holder][1] += len(b.text)
    raw = [ratio[b.path] for b in found]
    any_inside = any(b.inside for b in found)
    fused: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for k, (b, low) in enumerate(zip(found, demoted(found, above), strict=True)):
        near = [(raw[j], w) for j, w in ((k - 2, 0.1), (k - 1, 0.2), (k, 0.4), (k + 1, 0.2), (k + 2, 0.1)) if 0 <= j < len(found) and found[j].holder == b.holder]
        smooth = sum(x * w for x, w in near) / sum(w for _, w in near)
        value = blend * smooth + (1 - blend) * holders[b.holder][0] / holders[b.holder][1]
        fused[b.path][0] += value * (1.0 if b.inside or not any_inside else outside) * (named if low else 1.0)
        fused[b.path][1] += 1
    scores = [fused[b.path][0] / fused[b.path][1] for b in found]
    chars = [len(b.text) for b in found]
    limit = share * sum(s * n for s, n in zip(scores, chars, strict=True)) / sum(chars)
    return [b.text for b, s in zip(found, scores, strict=True) if s >= limit and s > 0]


def main_text(html: str | None) -> str:
    return "\n\n".join(select(*blocks(html))) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: its id, url, main text and the text's code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for keys, htmls in text_blocks(rows, batch.column(2).to_pylist()):
                texts = [main_text(h) for h in htmls]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in keys], pa.int64()), pa.array([u for _, u in keys], pa.string()), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    only = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))
    return only.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by composite text density.

A page is cut into tags and texts and kept as parent pointers. For every node the characters and tags below it
and those inside links give its composite density; the node whose children's densities sum highest is the
anchor of the main text. From there the least density on the path to ``body`` is the threshold for taking in
other blocks of the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<[!?][^>]*+>"
    r"|<(?:/?[a-zA-Z][^<>]*+)\Z", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
LEAVES_OUT = frozenset("aside audio button canvas dialog embed footer form head input label map menu nav object option search video".split())
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: What an open tag closes, up to the tags that shield it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|promo|promotion|sponsor|sponsored|cookies?|consent|gdpr|notices?|alert|"
    r"popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|comments?|commentlist|disqus|respond|replies|reply|related|recommended|recommendations|widget|toolbar|"
    r"pagination|pager|search|skip)(?:$|[\s_-])", re.I)
HEAD_HINT = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
#: What a class or id hints at goes if it holds up to this share of the page's text outside links.
SMALL = 1 / 2
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu toolbar".split())


class Page:
    """Nodes of a page (tag, parent, left out or not) and its texts and block borders in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.hinted = ["html"], [-1], [False], [False]
        self.flow: list[tuple[int, str | None]] = []  # (node, text), or None for a border between blocks
        self.open = Counter()  # how many elements of each tag are open: the stack is searched only for what is on it
        stack = [0]
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.flow.append((stack[-1], source[at:m.start()]))
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if m[2]:
                self._end(stack, name)
            else:
                self._start(stack, name, m[4])
        if at < len(source):
            self.flow.append((stack[-1], source[at:]))

    def _pop(self, stack, to):
        while len(stack) > to:
            tag = self.tag[stack.pop()]
            self.open[tag] -= 1
            if tag in BLOCK:
                self.flow.append((stack[-1], None))

    def _end(self, stack, name):
        if name in ("body", "html") or not self.open[name]:
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag == name:
                self._pop(stack, i)
                return
            if name not in BLOCK and tag in BLOCK:
                return

    def _start(self, stack, name, attributes):
        if name == "br":
            self.flow.append((stack[-1], " "))
            return
        if name == "html":
            return
        closes, shields = CLOSES.get(name, ((), ()))
        if name in ENDS_P:
            closes, shields = {*closes, "p"}, {*shields, "td", "th", "button", "table"} - {name}
        if name == "body":
            closes, shields = {"head"}, set()
        lowest, left = None, sum(self.open[c] for c in closes)
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if not left or tag in shields:
                break
            if tag in closes:
                lowest, left = i, left - 1
        if lowest is not None:
            self._pop(stack, lowest)
        node = len(self.tag)
        up = stack[-1]
        self.tag.append(name)
        self.parent.append(up)
        out, hinted = self._left_out(name, attributes)
        self.out.append(self.out[up] or out)
        self.hinted.append(hinted)
        if name in BLOCK:
            self.flow.append((up, None))
        if name not in VOID and not attributes.endswith("/"):
            stack.append(node)
            self.open[name] += 1

    def _left_out(self, name, attributes) -> tuple[bool, bool]:
        """Whether a node is left out whatever it holds, and whether its class or id hints that it may be."""
        if name in ("html", "body"):
            return False, False
        if name in LEAVES_OUT:
            return True, False
        inside, hinted = self.open["article"] > 0 or self.open["main"] > 0, False
        if name == "header" and not inside:
            return True, False
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True, False
            if key == "role" and value.lower() in ROLES:
                return True, False
            if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, False
            if key in ("class", "id") and (HINT.search(value) or not inside and HEAD_HINT.search(value)):
                hinted = True
        return False, hinted and name not in ("article", "main")


def leave_hinted(page: Page) -> None:
    """Leaves out hinted nodes that are made of links or hold at most ``SMALL`` of the page's text outside links; none
    that is or holds an article or main."""
    if not any(page.hinted):
        return
    n = len(page.tag)
    chars, links, holds, in_link = [0] * n, [0] * n, [tag in ("article", "main") for tag in page.tag], [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    for node, text in page.flow:
        if text is not None and not page.out[node]:
            size = len("".join(text.split()))
            chars[node] += size
            links[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        if not page.out[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            holds[up] = holds[up] or holds[i]
    plain = chars[0] - links[0]
    for i in range(1, n):
        page.out[i] = page.out[i] or page.out[page.parent[i]] or page.hinted[i] and not holds[i] and (
            2 * links[i] > chars[i] or chars[i] - links[i] <= SMALL * plain)


def densities(page: Page) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite density of every node, the sum over its children, characters, characters in links."""
    n = len(page.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    for node, text in page.flow:
        if text is not None and not page.out[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if in_link[node]:
                links[node] += size
    for i in range(n - 1, 0, -1):
        if page.out[i]:
            continue
        up = page.parent[i]
        chars[up] += chars[i]
        links[up] += links[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    share = links[body] / max(chars[body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t = chars[i], max(tags[i], 1)
        if c and not page.out[i]:
            base = math.log(c / max(c - links[i], 1) * links[i] + share * c + math.e)
            value = c / max(links[i], 1) * t / max(link_tags[i], 1)
            density[i] = c / t * math.log(value) / math.log(base) if base > 1 and value > 1 else c / t * (value > 1 or base <= 1)
        if i and not page.out[i]:
            sums[page.parent[i]] += density[i]
    return density, sums, chars, links


def chosen(page: Page) -> list[bool]:
    """Which nodes belong to the main text."""
    n = len(page.tag)
    leave_hinted(page)
    density, sums, chars, links = densities(page)
    anchor = max(range(n), key=lambda i: (sums[i], -i))
    if sums[anchor] <= 0:
        anchor = max(range(n), key=lambda i: (density[i], -i))
    path = [anchor]
    while page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    roots = [i for i in path if page.tag[i] == "article"] or [i for i in path if page.tag[i] == "main"]
    keep = [False] * n
    keep[roots[-1] if roots else anchor] = True
    inner = path[:next((k for k, i in enumerate(path) if page.tag[i] == "body"), len(path) - 1) + 1]
    threshold = min(density[i] for i in inner)
    on_path = set(path)
    for i in range(1, n):  # blocks beside the path, dense enough and not made of links
        if page.parent[i] in on_path and i not in on_path and page.tag[i] in BLOCK and density[i] >= threshold > 0 \
                and 2 * links[i] <= chars[i]:
            keep[i] = True
    for i in range(1, n):
        keep[i] = keep[i] or keep[page.parent[i]]
    # lists of links are menus unless they stand in an article or main
    children, inside = Counter(page.parent), [False] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or page.tag[i] in ("article", "main")
        if page.tag[i] in ("ul", "ol", "div", "section", "table") and chars[i] and 3 * links[i] > 2 * chars[i] \
                and children[i] > 1 and i not in on_path and not inside[i]:
            page.out[i] = True
        page.out[i] = page.out[i] or page.out[page.parent[i]]
    return [k and not o for k, o in zip(keep, page.out)]


def main_text(source: str | None) -> str:
    """The main text of one page: blocks joined by a line feed; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    keep = chosen(page)
    blocks, held = [], []
    for node, text in page.flow:
        if text is None:
            if held:
                blocks.append("".join(held))
                held = []
        elif keep[node]:
            held.append(html.unescape(text) if "&" in text else text)
    if held:
        blocks.append("".join(held))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page. Null or empty html gives an empty text; repeated rows stay."""
    frame = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).cast("string").alias("html"))
    kind = frame.schema["page_id"].dataType.simpleString()

    def body(part, sources):
        texts = [main_text(s) for s in sources.to_pylist()]
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, type=pa.string()),
                "n_chars": pa.array(list(map(len, texts)), type=pa.int64())}
    return map_slices(frame, body, f"page_id {kind}, url string, text string, n_chars bigint", text="html")

"""Column functions over stored HTML, and a tag walker for nested templates."""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import let, strip

# Entities in replacement order, the ampersand last. Browsers read
# them without the semicolon as well.
ENTITIES = (
    ("&lt", "<"),
    ("&gt", ">"),
    ("&quot", '"'),
    ("&#39", "'"),
    ("&nbsp", "\u00a0"),
    ("&copy", "©"),
    ("&middot", "·"),
    ("&amp", "&"),
)

# Page parts that are never article text.
NOISE = (
    r"(?s)<!--.*?-->",
    r"(?is)<script\b.*?</script>",
    r"(?is)<style\b.*?</style>",
    r"(?is)<nav\b.*?</nav>",
    r'(?is)<div class="ad">.*?</div>',
)

_CSS_URL = r"""url\(["']?(.*?)["']?\)"""


def css_url(style: Column) -> Column:
    """Address inside `url(...)`, else the text itself."""
    return F.when(F.regexp_like(style, F.lit(_CSS_URL)), F.regexp_extract(style, _CSS_URL, 1)).otherwise(style)


def drop_noise(page: Column) -> Column:
    """Page without comments, scripts, styles, navigation and ad blocks."""
    for pattern in NOISE:
        page = F.regexp_replace(page, pattern, "")
    return page


def unescape(text: Column) -> Column:
    decoded = text
    for entity, character in ENTITIES:
        decoded = F.regexp_replace(decoded, f"{entity};?", character)
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def inner_text(fragment: Column) -> Column:
    """Text of a fragment: tags removed, entities decoded."""
    return unescape(F.regexp_replace(fragment, "<[^>]*>", ""))


def first_element(page: Column, tag: str) -> Column:
    """Inner HTML of the first `tag` element, '' when absent (no nesting)."""
    return F.regexp_extract(page, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def paragraphs(fragment: Column) -> Column:
    """Stripped texts of the paragraphs, blank ones left out.

    A paragraph ends where the next one starts, so an unclosed one keeps its text.
    """
    parts = let(F.split(fragment, "<p>"), lambda p: F.slice(p, 2, F.size(p)))
    return F.filter(F.transform(parts, lambda p: strip(inner_text(p))), lambda p: F.length(p) > 0)


# -- nested templates -----------------------------------------------------

# Elements without an end tag, and block starts that close an
# open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header "
    "hr main nav ol p pre section table ul".split()
)
_SKIPPED = re.compile(r"<(script|style)\b")
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)([^>]*)>")
_ATTR = re.compile(r"""(?<![\w-])([\w-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""")


class Node:
    """One element: tag, attributes, place in the source, and its stretches of elements and texts.

    Elements are numbered as they open, and an element's descendants have the
    numbers up to `last`; its text is a stretch of the page's texts.
    """

    __slots__ = ("tag", "attrs", "classes", "parent", "number", "last", "start", "end", "inner", "texts", "first_text", "end_text")

    def __init__(self, tag, attrs, parent, number, start, inner, texts):
        self.tag, self.attrs, self.parent, self.number = tag, attrs, parent, number
        self.classes = frozenset(attrs.get("class", "").split())
        self.start, self.inner, self.end = start, inner, None
        self.texts, self.first_text = texts, len(texts)
        self.last, self.end_text = number, len(texts)

    def has_class(self, name: str) -> bool:
        return name in self.classes

    def inside(self, other: "Node") -> bool:
        return other.number < self.number <= other.last

    @property
    def text(self) -> str:
        return " ".join("".join(self.texts[self.first_text : self.end_text]).split())


def _pieces(page: str):
    """(start, end, match of a tag or None) for the tags and texts of a page; comments, scripts and styles are left out.

    What never ends is text. Where an end is missing once it is not looked for again.
    """
    at, last_end = 0, page.rfind(">")
    missing: set[str] = set()

    def behind(end: str, start: int, pattern=None) -> int:
        if end in missing:
            return -1
        found = pattern.search(page, start) if pattern else None
        place = (found.end() if found else -1) if pattern else page.find(end, start)
        if place < 0:
            missing.add(end)
        return place if pattern or place < 0 else place + len(end)

    while at < len(page):
        opening = page.find("<", at)
        if opening != at:
            opening = len(page) if opening < 0 else opening
            yield at, opening, None
            at = opening
            continue
        if page.startswith("<!--", at) and (end := behind("-->", at + 4)) >= 0:
            at = end
            continue
        skipped = _SKIPPED.match(page, at)
        if skipped:
            name = skipped.group(1)
            end = behind(f"</{name}", skipped.end(), re.compile(rf"</{name}\s*>"))
            if end >= 0:
                at = end
                continue
        tag = _TAG.match(page, at) if at < last_end else None
        end = tag.end() if tag else at + 1
        yield at, end, tag
        at = end


def walk(page: str) -> list[Node]:
    """Elements of a page in document order, in time linear in the page."""
    nodes: list[Node] = []
    stack: list[Node] = []
    texts: list[str] = []
    open_tags: dict[str, int] = {}

    def close(at: int) -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        node.end, node.last, node.end_text = at, len(nodes) - 1, len(texts)

    def close_to(tag: str, at: int) -> None:
        if open_tags.get(tag):
            while stack[-1].tag != tag:
                close(at)
            close(at)

    for start, end, found in _pieces(page):
        if found is None:
            texts.append(_html.unescape(page[start:end]))
            continue
        tag = found.group(2).lower()
        if found.group(1):
            close_to(tag, start)
            continue
        if tag in CLOSES_P:
            close_to("p", start)
        attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(found.group(3))}
        node = Node(tag, attrs, stack[-1] if stack else None, len(nodes), start, end, texts)
        nodes.append(node)
        if tag in VOID or found.group(3).endswith("/"):
            node.end = end
        else:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    while stack:
        close(len(page))
    return nodes

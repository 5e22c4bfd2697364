"""Leaf blocks of a web page: white-space-clean texts with the tags above them."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|textarea|title|svg|iframe|object)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
#: Elements without content, and elements that stay inside a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
SPACE = frozenset("br wbr img input hr".split())


class Element:
    """An open element: its tag, the words of its class, id and role, and the element around it.

    ``slots`` and ``main`` are what a reader finds out about the whole path down to here.
    """

    __slots__ = ("tag", "marks", "up", "depth", "slots", "main")

    def __init__(self, tag: str, marks: list[str], up: Element | None) -> None:
        self.tag, self.marks, self.up = tag, marks, up
        self.depth: int = up.depth + 1 if up else 1
        self.slots: int | None = None
        self.main: bool | None = None


class Block(NamedTuple):
    text: str
    #: The innermost element around the block; the whole path up to the root hangs on it.
    path: Element | None
    #: Share of the characters that stand in links.
    linked: float


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page in page order; a null page has none.

    A block ends where an element other than an inline one begins or ends. Unclosed
    elements end with the element around them, ``p`` at the next block element.
    """
    page = page or ""
    found: list[Block] = []
    stack: list[Element] = []
    #: Where each tag, and any element that is not inline, is open in the stack.
    places: dict[str, list[int]] = {}
    outer: list[int] = []
    parts: list[str] = []
    path: Element | None = None
    inside = False
    linked = 0

    def add(raw: str) -> None:
        nonlocal path, inside, linked
        if raw:
            parts.append(raw)
            if not inside and not raw.isspace():
                path, inside = stack[-1] if stack else None, True
            if places.get("a"):
                linked += len(raw)

    def flush() -> None:
        nonlocal parts, path, inside, linked
        if parts:
            raw = "".join(parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                found.append(Block(text, path, min(1.0, linked / max(1, len(raw.strip())))))
        parts, path, inside, linked = [], None, False, 0

    def close(k: int) -> None:
        """Ends the elements from place ``k`` of the stack on."""
        while len(stack) > k:
            places[stack.pop().tag].pop()
        while outer and outer[-1] >= k:
            outer.pop()

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in SPACE:
                add(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        last = outer[-1] if outer else -1
        if m["end"]:
            if places.get(tag) and not (inline and places[tag][-1] < last):
                close(places[tag][-1])
            continue
        if not inline and outer:
            name = stack[last].tag
            if name == "p" or name == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                close(last)
        marks: list[str] = []
        if m["attrs"]:
            for _, a, b, c in ATTRIBUTE.findall(m["attrs"]):
                marks += WORD.findall((a or b or c).lower())
        if m["attrs"][-1:] != "/":
            places.setdefault(tag, []).append(len(stack))
            if not inline:
                outer.append(len(stack))
            stack.append(Element(tag, marks, stack[-1] if stack else None))
    add(page[at:])
    flush()
    return found

"""Leaf blocks of HTML pages and what describes them.

A page is read tag by tag into a tree of block elements; inline elements only add text. A
*leaf block* is the text between two block boundaries, with character references decoded,
white space turned into single spaces, and blanks at its ends cut off. It is described by its
ancestors (tags, and words of class, id and role) and by its text (length, links, punctuation,
place, neighbours).

Tags that are not closed are closed where HTML closes them, tags that never end and comments
that never end reach to the end of the page, and the content of scripts, styles and other
elements that are not text is skipped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Container
from dataclasses import dataclass, field

# Elements of HTML by their role in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd link map mark meta picture q "
    "rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template svg math object canvas audio video".split())
# Elements that end when one of their kind begins, and where that search stops.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
}
# Attributes whose words describe an element, and those that hide it.
NAMED = ("class", "id", "role", "aria-label")

_TAG = re.compile(
    r"<!--(?:-?>|.*?-->|.*)|<[!?][^>]*>|</(?:[^a-zA-Z>][^>]*)?>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|[^>]*>)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGIT = re.compile(r"\d")
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_COMMENT = re.compile(r"<!--(?:-?>|.*-->)", re.S)


@dataclass
class Element:
    """An open block element with what it and its ancestors are called.

    ``near`` are the words of the closest element that has any.
    """

    tag: str
    parent: "Element | None"
    names: frozenset = frozenset()
    near: frozenset = frozenset()


@dataclass
class Block:
    text: str
    element: Element
    link_chars: int = 0
    local: list = field(default_factory=list)


def _names(tag: str, attributes: str) -> list[str]:
    """What an element is called: its tag and the words of its attributes."""
    found = [] if tag in ("html", "body") else [f"in:{tag}"]
    if "=" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in NAMED:
                found += [f"is:{word.lower()}" for word in _WORD.findall(value)]
            elif key == "style" and re.search(r"display\s*:\s*none", value):
                found.append("is:hidden")
    if re.search(r"\shidden(\s|>|=|/|$)", attributes):
        found.append("is:hidden")
    return found


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks in the order of the page; of the names of elements only those in ``known`` are kept."""
    root = Element("", None)
    here, opened, blocks = root, {}, []
    pieces: list[str] = []
    linked, in_link, raw = 0, False, None

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append(Block(text, here, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(to: Element) -> None:
        nonlocal here
        while here is not to:
            opened[here.tag] -= 1
            here = here.parent
        opened[here.tag] -= 1
        here = here.parent

    at, stop = 0, page.rfind(">") + 1
    while at < stop:
        found = _TAG.search(page, at, stop)
        if found is None:
            break
        add(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            if found[0].startswith("<!--") and not _COMMENT.fullmatch(found[0]):
                at = len(page)
            continue
        tag, ends = name.lower(), bool(found["end"])
        if tag in RAW:
            if not ends and not found["attributes"].endswith("/>"):
                raw = re.compile(f"</{tag}[^>]*(>|$)", re.I).search(page, at)
                at = raw.end() if raw else len(page)
            flush()
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                in_link = not ends
            continue
        flush()
        if ends:
            if opened.get(tag):
                to = here
                while to.tag != tag:
                    to = to.parent
                close(to)
            continue
        if here.tag == "p":
            close(here)
        kinds, borders = SIBLINGS.get(tag, ((), ()))
        if any(opened.get(kind) for kind in kinds):
            to = here
            while to.tag not in kinds and to.tag not in borders and to.parent is not None:
                to = to.parent
            if to.tag in kinds:
                close(to)
        if tag not in VOID:
            own = _names(tag, found["attributes"])
            close_by = ["near:" + name[3:] for name in own if name.startswith("is:")]
            if known is not None:
                own = [name for name in own if name in known]
            names = here.names.union(own)
            near = here.near
            if close_by:
                near = frozenset(close_by if known is None else [name for name in close_by if name in known])
            here = Element(tag, here, here.names if names == here.names else names, near)
            opened[tag] = opened.get(tag, 0) + 1
    # What follows the last tag; a tag that has begun there never ends.
    if at < stop:
        add(page[at:stop])
    tail = page[max(at, stop) :]
    cut = _OPEN.search(tail)
    add(tail[: cut.start()] if cut else tail)
    flush()
    _describe(blocks)
    return blocks


def _size(words: int) -> str:
    for bound in (1, 2, 4, 8, 16, 32, 64):
        if words <= bound:
            return str(bound)
    return "more"


def _describe(blocks: list[Block]) -> None:
    """Features of each block's text, of its place, and of its neighbours."""
    sizes = [_size(b.text.count(" ") + 1) for b in blocks]
    # Where a page marks its article, what stands elsewhere is told apart.
    marked = [tag for tag in ("article", "main") if any(f"in:{tag}" in b.element.names for b in blocks)]
    for i, block in enumerate(blocks):
        text = block.text
        share = block.link_chars / len(text)
        own = sizes[i]
        links = "none" if share == 0 else "some" if share < 0.4 else "most" if share < 0.9 else "all"
        place = f"first{i}" if i < 2 else f"last{len(blocks) - i}" if len(blocks) - i <= 2 else "inner"
        block.local = [
            "any", f"tag:{block.element.tag}", f"words:{own}", f"links:{links}", f"words:{own} links:{links}",
            f"end:{text[-1] if text[-1] in '.!?:,' else 'w'}", f"place:{place}",
            f"before:{sizes[i - 1] if i else 'start'}", f"after:{sizes[i + 1] if i + 1 < len(blocks) else 'end'}",
        ]
        block.local += [f"out:{tag}" for tag in marked if f"in:{tag}" not in block.element.names]
        if "," in text:
            block.local.append("comma")
        if "©" in text or "(c)" in text:
            block.local.append("copyright")
        if text.isupper():
            block.local.append("upper")
        if _DIGIT.search(text):
            block.local.append("digit")


def same_place(a: Block, b: Block) -> int:
    """1 if two blocks lie in one element, or in siblings that are called the same but for their tags, else 0."""
    x, y = a.element, b.element
    if x is y:
        return 1
    return int(x.parent is y.parent and not any(name.startswith("is:") for name in x.names ^ y.names))

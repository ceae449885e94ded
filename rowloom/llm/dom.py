"""Leaf blocks of HTML pages: runs of text between the borders of block elements, with what encloses them.

The reader takes any text as HTML in time linear in its length: unclosed comments, raw text and quotes, tags that close
nothing and elements nested to any depth. What encloses a block is kept as one number per open element, a set of bits that
each element inherits and adds its own to, so deep nesting costs no more than flat.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Elements of HTML, by how they are laid out.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section"
    " select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NO_TEXT = frozenset("head script style textarea title iframe noembed noframes noscript template svg object select datalist".split())
# Elements that a new element of the key closes, up to the nearest of the barriers.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"), "option": ("option",),
    "body": ("head",),
}
BARRIERS = frozenset("ul ol dl table html body button select".split())
SCOPES = frozenset("table td th caption button".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption button body html".split())
# Elements whose own text is a block of the element around them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption caption summary legend".split())
LANDMARKS = frozenset("article main nav header footer aside form section table figure ul ol dl body".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+)(?:\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_CLASS_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW}
_GIVEN = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))


def class_marks(value: str) -> list[str]:
    """Lower-case parts of class names or an id, and the whole names."""
    marks = []
    for name in value.split():
        parts = [p.lower() for p in _CLASS_PART.findall(name)]
        marks += parts
        if len(parts) > 1:
            marks.append("-".join(parts))
    return marks


class Marks:
    """Numbers of marks (what an element or a text is described by); unknown ones are added only while learning."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.learning = True

    def place(self, mark: str) -> int:
        """The mark's number; -1 for an unknown one."""
        found = self.number.get(mark, -1)
        if found < 0 and self.learning:
            found = self.number[mark] = len(self.number)
        return found

    def bit(self, mark: str) -> int:
        found = self.place(mark)
        return 1 << found if found >= 0 else 0


@dataclass
class Block:
    """A run of text; ``around`` has a bit for each mark of what encloses it."""

    tag: str
    parent: str
    landmark: str
    container: int
    around: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class _Open:
    """An open element; ``own`` is the nearest block element, ``names`` has bits for the nearest class or id, both its own ones
    included."""

    __slots__ = ("tag", "around", "names", "named", "landmark", "number", "silent", "link", "outer", "own")

    def __init__(self, tag: str, around: int, names: int, number: int, outer: _Open | None):
        self.names, self.named = names or (outer.names if outer else 0), bool(names)
        self.tag, self.around, self.number, self.outer = tag, around, number, outer
        self.own = self if outer is None or tag in BLOCKS else outer.own
        self.landmark = tag if tag in LANDMARKS or outer is None else outer.landmark
        self.silent = tag in NO_TEXT or (outer is not None and outer.silent)
        self.link = tag == "a" or (outer is not None and outer.link)


class Reader:
    """Reads one page into blocks."""

    def __init__(self, marks: Marks):
        self.marks = marks
        self.blocks: list[Block] = []
        self.stack = [_Open("", 0, 0, 0, None)]
        self.open: dict[str, int] = {}
        self.count = 0
        self.block: Block | None = None

    def _end_block(self) -> None:
        if self.block:
            self.block.text = " ".join("".join(self.block.pieces).split())
            if self.block.text:
                self.blocks.append(self.block)
            self.block = None

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if not raw or top.silent:
            return
        text = unescape(raw)
        if self.block is None:
            if text.isspace():
                return
            own = top.own
            # a paragraph with a known name of its own is a container of its own
            outer = own.outer.own if own.tag in LEAVES and not own.named else own
            self.block = Block(own.tag, outer.tag, top.landmark, outer.number, top.around | top.names)
        self.block.pieces.append(text)
        if top.link:
            self.block.linked += len(text.split())

    def _pop(self) -> None:
        gone = self.stack.pop()
        self.open[gone.tag] -= 1
        if gone.tag in BLOCKS:
            self._end_block()

    def _close_open(self, names: tuple[str, ...]) -> None:
        if not any(self.open.get(n) for n in names):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in names:
                while len(self.stack) > at:
                    self._pop()
                self._close_open(names)
                return
            if tag in BARRIERS:
                return

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag in BLOCKS:
            self._end_block()
            if self.open.get("p"):
                self._close_open(("p",))
        if tag in CLOSES:
            self._close_open(CLOSES[tag])
        if tag in VOID:
            return
        top = self.stack[-1]
        around = top.around | self.marks.bit(f"in:{tag}")
        names = 0
        for name in ("class", "id"):
            for mark in class_marks(attributes.get(name, "")):
                around |= self.marks.bit(f"class:{mark}")
                names |= self.marks.bit(f"nearest:{mark}")
        if "role" in attributes:
            around |= self.marks.bit(f"role:{attributes['role'].strip().lower()}")
        unseen = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
        if unseen:
            around |= self.marks.bit("unseen")
        self.count += 1
        self.stack.append(_Open(tag, around, names, self.count, top))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        if not self.open.get(tag):
            return
        blocks = 0
        for at in range(len(self.stack) - 1, 0, -1):
            found = self.stack[at].tag
            if found == tag:
                break
            if found in SCOPES and tag not in TABLE_PARTS:
                return
            blocks += found in BLOCKS
        if tag not in BLOCKS and blocks:
            # an inline element that ends inside a later block leaves that block open
            del self.stack[at]
            self.open[tag] -= 1
            return
        while len(self.stack) > at:
            self._pop()

    def _attributes(self, html: str, at: int) -> tuple[dict[str, str], int]:
        found: dict[str, str] = {}
        while True:
            match = _ATTRIBUTE.match(html, at)
            if not match:
                end = html.find(">", at)
                return found, len(html) if end < 0 else end + 1
            name, at = match.group(1).lower(), match.end()
            value = ""
            if "=" in match.group(0) and at < len(html):
                quote = html[at]
                end = -1
                if quote in "\"'" and at < self.last_quote[quote]:
                    end = html.find(quote, at + 1)
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                else:
                    match = _UNQUOTED.match(html, at)
                    value, at = match.group(0), match.end()
            if name in _GIVEN and name not in found:
                found[name] = unescape(value)

    def read(self, html: str) -> list[Block]:
        at, size = 0, len(html)
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                self._text(html[at:])
                break
            self._text(html[at:mark])
            after = html[mark + 1 : mark + 2]
            closing = after == "/"
            name = _NAME.match(html, mark + 2 if closing else mark + 1)
            if name:
                tag = name.group(0).lower()
                attributes, at = self._attributes(html, name.end())
                if closing:
                    self._end(tag)
                    continue
                self._start(tag, attributes)
                if tag in RAW:
                    end = _RAW_END[tag].search(html, at)
                    if not end:
                        break
                    at = end.start()
            elif html.startswith("<!--", mark):
                end = html.find("-->", mark + 2)
                at = size if end < 0 else end + 3
            elif closing or (after and after in "!?"):
                end = html.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                self._text("<")
                at = mark + 1
        self._end_block()
        return self.blocks


def leaf_blocks(html: str | None, marks: Marks) -> list[Block]:
    """The blocks of a page in its order; those without text are left out, heads, scripts and styles too."""
    return Reader(marks).read(html or "")

"""A small document tree with the selectors that source configurations use."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_STEP = re.compile(r"([A-Za-z][A-Za-z0-9-]*|\*)?((?:\.[\w-]+|#[\w-]+|\[[^\]]+\])*)")
_PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*['\"]?([^'\"\]]*)['\"]?\s*)?\]")


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self):
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack += n.children[::-1]

    def strings(self):
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in ("script", "style"):
                stack += n.children[::-1]

    def text(self, separator: str = "") -> str:
        """Its strings, stripped, the empty ones left out, joined."""
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)

    def select(self, selector: str) -> list[Node]:
        """Nodes below that match a list of selectors, in document order."""
        wanted = [[_parsed(step) for step in one.split()] for one in selector.split(",") if one.strip()]
        return [n for n in self.walk() if any(_matches(n, steps) for steps in wanted)]

    def first(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)


def _parsed(step: str) -> tuple[str, list[tuple[str, str, str]]]:
    m = _STEP.fullmatch(step)
    if not m:
        raise ValueError(f"selector not known: {step}")
    tests = [("class", "~=", p[1]) if p[1] else ("id", "=", p[2]) if p[2] else (p[3].lower(), p[4] or "", p[5] or "") for p in _PART.finditer(m[2])]
    return (m[1] or "*").lower(), tests


def _fits(node: Node, step: tuple[str, list[tuple[str, str, str]]]) -> bool:
    tag, tests = step
    if tag not in ("*", node.tag):
        return False
    for name, how, value in tests:
        has = node.attributes.get(name)
        if has is None or not {"": True, "=": has == value, "*=": value in has, "^=": has.startswith(value), "$=": has.endswith(value), "~=": value in has.split()}[how]:
            return False
    return True


def _matches(node: Node, steps: list) -> bool:
    if not _fits(node, steps[-1]):
        return False
    rest, at = steps[:-1], node.parent
    while rest and at is not None:
        if _fits(at, rest[-1]):
            rest = rest[:-1]
        at = at.parent
    return not rest


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_-]+)", re.I)


_DECLARED = re.compile(rb"^\s*<\?xml[^>]*?\sencoding\s*=\s*[\"']([A-Za-z0-9._-]+)")


def decoded(body: bytes, encoding: str | None = None) -> str:
    """A page's or a feed's text: by the given encoding, a byte order mark, its meta element, its XML declaration, UTF-8, or
    what never fails."""
    found, declared = _CHARSET.search(body[:4096]), _DECLARED.search(body[:400])
    mark = "utf-8-sig" if body.startswith(b"\xef\xbb\xbf") else "utf-16" if body.startswith((b"\xff\xfe", b"\xfe\xff")) else None
    tries = [encoding, mark, found and found[1].decode("ascii"), declared and declared[1].decode("ascii"), "utf-8"]
    for name in filter(None, tries):
        try:
            return body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode(found[1].decode("ascii") if found and found[1].lower() in (b"shift_jis", b"euc-jp", b"iso-2022-jp") else "utf-8", "replace")

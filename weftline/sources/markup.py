"""A small tree of a page's elements, and the part of XPath that extraction rules use."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening element closes if it is the innermost open one.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


class Node:
    """An element: tag, attributes, parent, and children that are nodes or strings."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in page order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def own_text(self) -> str:
        """The text before the first child element."""
        return self.children[0] if self.children and isinstance(self.children[0], str) else ""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.now = self.root

    def handle_starttag(self, tag, attrs):
        if self.now.tag in CLOSES.get(tag, ()) or self.now.tag == "p" and tag in CLOSES_P:
            self.now = self.now.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.now.tag == tag:
            self.now = self.now.parent

    def handle_endtag(self, tag):
        node = self.now
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.now = node.parent

    def handle_data(self, data):
        kids = self.now.children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; an empty one for null or empty html."""
    b = _Builder()
    if html:
        b.feed(html)
        b.close()
    return b.root


_STEP = re.compile(r"(//|/)([\w*-]+)((?:\[[^\]]*\])*)")
_TEST = re.compile(r"\[\s*(?:@([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'))?|contains\(\s*@([\w:-]+)\s*,\s*(?:\"([^\"]*)\"|'([^']*)')\s*\))\s*\]")


@lru_cache(maxsize=256)
def compiled(selector: str) -> list[tuple[bool, str, list[tuple[str, str, str]]]]:
    """Steps of a selector: ``//tag[@a="v"][contains(@b, "v")]`` and such; anything else is an error."""
    said = selector.strip()
    said = said[1:] if said.startswith("./") else said
    steps, at = [], 0
    while at < len(said):
        m = _STEP.match(said, at)
        if not m:
            raise ValueError(f"this part of a selector isn't known: {selector!r} at {at}")
        tests, rest = [], m[3]
        while rest:
            t = _TEST.match(rest)
            if not t:
                raise ValueError(f"this test of a selector isn't known: {rest!r}")
            if t[4]:
                tests.append(("has", t[4], t[5] if t[5] is not None else t[6]))
            else:
                value = t[2] if t[2] is not None else t[3]
                tests.append(("any", t[1], "") if value is None else ("is", t[1], value))
            rest = rest[t.end() :]
        steps.append((m[1] == "//", m[2], tests))
        at = m.end()
    return steps


def matches(node: Node, step: tuple[bool, str, list[tuple[str, str, str]]]) -> bool:
    _, tag, tests = step
    if tag != "*" and node.tag != tag or node.tag.startswith("#"):
        return False
    for kind, name, value in tests:
        got = node.attrs.get(name)
        if got is None or kind == "is" and got != value or kind == "has" and value not in got:
            return False
    return True


def select(node: Node, selector: str) -> list[Node]:
    """Nodes below ``node``, in page order, each once."""
    found = [node]
    for step in compiled(selector):
        out, seen = [], set()
        for n in found:
            below = n.walk() if step[0] else (c for c in n.children if isinstance(c, Node))
            for x in below:
                if x is not n and id(x) not in seen and matches(x, step):
                    seen.add(id(x))
                    out.append(x)
        found = out
    return found


def climb(node: Node, selector: str) -> Node | None:
    """The nearest of ``node`` and its ancestors that the selector's last step matches."""
    step = compiled(selector)[-1]
    while node is not None and not node.tag.startswith("#"):
        if matches(node, step):
            return node
        node = node.parent
    return None

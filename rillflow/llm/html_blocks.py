"""Leaf blocks of an HTML page: runs of text between block-level boundaries.

A forgiving scanner, not a full tree builder: unclosed elements end with what
closes around them, a new block closes an open paragraph, and scripts, styles,
comments and markup give no text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements whose content a browser that runs scripts does not show as text of the page, or shows in a form.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "button", "option", "figcaption", "caption"}
#: An element that begins closes an open one of these, up to a boundary.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUOTED_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
LABELS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    inside: str  # the innermost block element's tag
    tags: frozenset[str]  # of all block elements around it
    labels: tuple[str, ...]  # tokens of all ancestors' class, id and role, each once
    parent: int  # a number for the block element around its own (a heading, paragraph, item or cell)
    linked: int = 0  # characters inside links
    inline: int = 0  # inline elements that begin in it


@dataclass
class _Open:
    tag: str
    labels: tuple[str, ...]
    number: int
    at: int  # its place on the stack


@dataclass
class _Scan:
    stack: list[_Open] = field(default_factory=list)
    found: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    inline: int = 0
    links: int = 0
    count: int = 0
    open: Counter = field(default_factory=Counter)  # of each tag on the stack
    boxes: list[_Open] = field(default_factory=list)  # the block elements on the stack
    names: dict[str, int] = field(default_factory=dict)  # how many elements on the stack have a label

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.links:
                self.linked += len(raw.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                inside = self.boxes[-1].tag if self.boxes else ""
                around = self.boxes[-2:-1] if inside in LEAF else self.boxes[-1:]
                tags = frozenset(t for t, n in self.open.items() if n and t in BLOCK)
                self.found.append(Block(text, inside, tags, tuple(self.names), around[0].number if around else 0, min(self.linked, len(text)), self.inline))
            self.parts = []
        self.linked = self.inline = 0

    def pop_to(self, at: int) -> None:
        for e in self.stack[at:]:
            self.links -= e.tag == "a"
            self.open[e.tag] -= 1
            for x in e.labels:
                self.names[x] -= 1
                if not self.names[x]:
                    del self.names[x]
        del self.stack[at:]
        while self.boxes and self.boxes[-1].at >= at:
            self.boxes.pop()

    def close(self, tags: set[str], within: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag in tags:
                self.pop_to(at)
                return
            if self.stack[at].tag in within:
                return

    def begin(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in BLOCK:
            self.flush()
            self.close({"p"}, {"button", "table", "td", "th", "object"})
            if tag in SIBLINGS:
                self.close(*SIBLINGS[tag])
        elif tag == "br":
            self.parts.append(" ")
        else:
            self.inline += 1
            if tag == "a":
                self.close({"a"}, BLOCK)
        if tag in VOID or closed and tag not in BLOCK and tag != "a":
            return
        labels = tuple({t: None for m in LABELS.findall(attributes) for x in m if x for t in TOKEN.findall(x.lower())}) if "=" in attributes else ()
        self.count += 1
        self.stack.append(_Open(tag, labels, self.count, len(self.stack)))
        self.open[tag] += 1
        if tag in BLOCK:
            self.boxes.append(self.stack[-1])
        for x in labels:
            self.names[x] = self.names.get(x, 0) + 1
        self.links += tag == "a"

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.open[tag]:
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                self.pop_to(at)
                return
            if tag not in BLOCK and self.stack[at].tag in BLOCK:
                return


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order, with character references decoded and
    white space runs as one space; blocks of nothing else are left out."""
    s, at, n = _Scan(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            s.text(page[at:])
            break
        s.text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = NAME.match(page, lt)
        if not m:
            s.text("<")
            at = lt + 1
            continue
        end = page.find(">", m.end())
        if end < 0:
            break  # a tag that never ends
        attributes = page[m.end() : end]
        if '"' in attributes or "'" in attributes:
            whole = QUOTED_END.match(page, m.end())
            if whole:
                end = whole.end() - 1
                attributes = page[m.end() : end]
        tag, at = m[1].lower(), end + 1
        if page[lt + 1] == "/":
            s.end(tag)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if tag == "noscript" or stop or tag in ("script", "style"):
                at = stop.end() if stop else n
            continue
        s.begin(tag, attributes, attributes.endswith("/"))
    s.flush()
    return s.found

"""Title and text of HTML pages, by a tokenizer that reads a page once.

``tokens`` goes from tag to tag. What a tag, comment or script takes up is read once and
never again: either it ends, or the page ends in it. So a page of any length takes time in proportion,
whatever is left open in it:

- a quote in a tag that never closes is no quote; a tag that never ends takes the rest of the page;
- a comment, script or style that never ends takes the rest of the page;
- a tag that ends with ``/>`` is an element without content, unless the ``/`` belongs to a value without quotes;
- ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text.

The open elements are a stack: an end tag closes the last element of its name and all
that is open in it, one without such an element is ignored, and what is never closed goes
to its parent's end. Every character reference of HTML is decoded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose whole content is dropped.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "noscript")
#: Elements without content.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
ROOTS = ("main", "article", "body")
#: Elements whose content is no markup.
RAW = ("script", "style")

TEXT, START, END, OTHER = range(4)
_NAME = re.compile(r"[^\s/>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_STOP = re.compile(r"[>\"']")
_VALUE = re.compile(r"=\s*[^\s\"'=]+\Z")  # without quotes, up to the tag's end
#: a numeric reference beyond all code points, which stands for U+FFFD; Python's decoder makes a number of its digits first
_FAR = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")


def decoded(text: str) -> str:
    return unescape(_FAR.sub("�", text)) if "&" in text else text


def tokens(page: str) -> Iterator[tuple[int, str]]:
    """Text (TEXT, decoded), tags (START and END, with their name) and what else parts texts (OTHER), in order."""
    at, n = 0, len(page)
    last = {c: page.rfind(c) for c in "\"'>"}
    while at < n:
        start = page.find("<", at)
        while 0 <= start < n - 1 and not (page[start + 1].isascii() and page[start + 1].isalpha() or page[start + 1] in "/!?"):
            start = page.find("<", start + 1)
        if start < 0 or start == n - 1:
            yield TEXT, decoded(page[at:])
            return
        if start > at:
            yield TEXT, decoded(page[at:start])
        sign = page[start + 1]
        if page.startswith("<!--", start):
            end = start + 5 if page.startswith("<!-->", start) else page.find("-->", start + 4) + 3
            at = end if end > 2 else n
            yield OTHER, ""
        elif sign in "!?" or sign == "/" and not page[start + 2 : start + 3].isalpha():
            end = page.find(">", start)
            at = end + 1 if end >= 0 else n
            yield OTHER, ""
        else:
            named = _NAME.match(page, start + 1 + (sign == "/"))
            at = _tag_end(page, named.end(), last)
            if at > n:
                return
            name = named[0].lower()
            if sign == "/":
                yield END, name
                continue
            yield START, name
            if page[at - 2] == "/" and not _VALUE.search(page, named.end(), at - 1):
                yield END, name
            elif name in RAW:
                found = _RAW_END[name].search(page, at)
                at = found.start() if found else n


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Behind a tag's end: the first > outside quotes that close; beyond the page if there is none."""
    while found := _STOP.search(page, at):
        sign, at = found[0], found.end()
        if sign == ">":
            return at
        if at <= last[sign] and _opens(page, found.start()):
            at = page.index(sign, at) + 1
    return len(page) + 1


def _opens(page: str, quote: int) -> bool:
    """A quote opens a value only behind an equals sign."""
    while quote and page[quote - 1].isspace():
        quote -= 1
    return quote > 0 and page[quote - 1] == "="


class _Page:
    """The text nodes outside dropped elements, and where the first elements of some names begin and end in them."""

    def __init__(self, page: str):
        self.nodes: list[str] = []
        self.spans: dict[str, list[int]] = {}
        self.open: list[tuple[str, bool, bool]] = []  # name, dropped, the first of its name
        self.count: Counter[str] = Counter()  # of the open elements' names
        self.pieces: list[str] = []
        for kind, what in tokens(page):
            if kind == TEXT:
                self.pieces.append(what)
                continue
            self.flush()
            if kind == START and what not in VOID:
                self.push(what)
            elif kind == END and self.count[what]:
                while self.pop() != what:
                    pass
        self.flush()
        while self.open:
            self.pop()

    def flush(self) -> None:
        text = "".join(self.pieces).strip()
        if text and not (self.open and self.open[-1][1]):
            self.nodes.append(text)
        self.pieces.clear()

    def push(self, name: str) -> None:
        dropped = bool(self.open) and self.open[-1][1] or name in DROPPED
        first = not dropped and name not in self.spans and (name in ROOTS or name == "title")
        if first:
            self.spans[name] = [len(self.nodes), len(self.nodes)]
        self.open.append((name, dropped, first))
        self.count[name] += 1

    def pop(self) -> str:
        name, _, first = self.open.pop()
        self.count[name] -= 1
        if first:
            self.spans[name][1] = len(self.nodes)
        return name

    def text(self) -> str:
        """Of the first main, else the first article, else the body, else all, even an empty one."""
        start, end = next((self.spans[r] for r in ROOTS if r in self.spans), (0, len(self.nodes)))
        return "\n".join(x for node in self.nodes[start:end] for line in node.splitlines() if (x := line.strip()))

    def title(self) -> str | None:
        return " ".join(self.nodes[slice(*self.spans["title"])]) if "title" in self.spans else None


_PARSED = "struct<title:string,text:string>"


def _parsed(pages: pa.Array) -> pa.Array:
    made = [None if p is None else _Page(p) for p in pages.to_pylist()]
    columns = [pa.array([m and m.title() for m in made], pa.string()), pa.array([m and m.text() for m in made], pa.string())]
    return pa.StructArray.from_arrays(columns, ["title", "text"], mask=pa.array([m is None for m in made]))


def html_parsed(page: Column) -> Column:
    """title (null without the element) and text of a page, from one pass over it; null for null."""
    return F.arrow_udf(_parsed, _PARSED)(page)


def html_text(page: Column) -> Column:
    """Every text node a line, stripped, blank ones dropped."""
    return html_parsed(page)["text"]


def html_title(page: Column, stem: Column) -> Column:
    """The title's text; a page without the element has the file's stem."""
    return F.coalesce(html_parsed(page)["title"], stem)


def decoded_text(content: Column) -> Column:
    """UTF-8 bytes as text: no byte order mark, line ends as \\n; null if the bytes are invalid."""
    text = F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8"))
    return F.regexp_replace(F.regexp_replace(text, r"\A\x{feff}", ""), r"\r\n?", "\n")

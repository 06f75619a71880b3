"""Main text of web pages by two-pass block rules.

Markup is cut into blocks of text. First pass: a block is bad if it lies in
boilerplate (navigation, header, footer, aside, form and the like, by tag, role or the
words of its class and id), outside the page's ``main`` or ``article`` where there is
one (an article whose class names a comment, a related piece and the like counts only
where there is no other), or if most of it is links or it claims copyright; it is good if it is long enough
and dense in function words, or in another script or language if its punctuation is that of sentences. Second pass: what is left, short or poor in function
words, takes the label of the nearest decided block. Inside a main or article only
blocks of the same one are asked, and without any there the block is good; elsewhere the page's
ends count as bad; of two at one distance a heading follows the later, others that of
their own element, else the bad one. If a
page has no good block, its undecided ones are good.

A class, an id or a form around most of a page may be its layout. It does not condemn a
main inside, nor an article with more long dense text than all good blocks outside such
wrappers have; nor does a form, or a name that is not of comments and does not begin with the hint (``content-sidebar-wrap``), condemn
an element with more of it. If nothing of a page would stay, such wrappers are undecided and the
block rules decide, where they find a good block. Inside a main or article a name with a subject of its own
(``search-algorithms``) condemns an element only if no block in it is long and dense. Tags, roles and hidden parts condemn always.

A link is an ``a`` with an address, up to its end; one that another ``a`` comes before the end of goes no
further than its block.

Character references are decoded, white space in a block becomes one space, blocks are
joined by a line feed in page order. Two ``br`` in a row end a block, one is a space;
a table row is a block.

Defined cases: a null or empty page has the text "". Unclosed and stray tags are
tolerated, an unclosed script, style or comment runs to the end. Repeated rows are
extracted each. A null page_id or url stays null. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.quality_rules import FUNCTION_WORDS

LONG, DENSE, LINKED = 70, 0.1, 0.5
MOST_WRAPPERS = 16  # a block counts for so many of the elements around it that may be spared, from the innermost out
# outside quotes a tag stops at the next <, else many tags that nothing closes would each be read to the end
_TAG = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: HTML elements by what they do to blocks.
UNSEEN = set("script style template noscript textarea iframe object svg math canvas audio video select datalist title head".split())
RAW = set("script style textarea title iframe noscript template".split())
BOILERPLATE = set("nav footer aside form button menu dialog fieldset label".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd link mark meta q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words of a class or id that mark boilerplate.
HINTS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply "
    "replies respond social share sharing related recommended newsletter subscribe signup login search form pagination pager toolbar copyright "
    "disclaimer skip".split()
)
#: Words beside those that say nothing of an element's subject.
STRUCTURE = frozenset(
    "area author bar block body bottom box btn button buttons buttonset col column container content entry field fixed global group head header holder icon icons id "
    "inline inner input item items js layout left link links list main media message meta mobile module name news outer page panel policy post posts primary row right "
    "secondary section site slot small sticky tabs text thread title toggle top ui unit view wp wrap wrapper zone".split()
)
QUALIFIERS = frozenset("has have no not with without free enabled disabled open opened closed on off allowed".split())
#: Hints at what readers say, which may be longer than the page's own text.
SAID = frozenset("comment comments disqus reply replies respond".split())
#: Marks that end or part sentences, in several scripts.
MARKS = frozenset(".,;:!?…،؛؟۔।。，、；：！？")
_FULL = frozenset(".!?…؟۔।。！？")
_CLOSING = "\"'”’»)]」』"
_HREF = re.compile(r"\bhref\s*=", re.I)
_ANCHOR = re.compile(r"<a[\s/>]", re.I)
_ANCHOR_END = re.compile(r"</a(?![A-Za-z0-9:-])", re.I)
_FUNCTION = frozenset(FUNCTION_WORDS)


def _hinted(attributes: str) -> tuple[bool, bool, bool, bool, bool, bool]:
    """Does a start tag's class or id mark boilerplate; only by a name with a subject of its own (``search-algorithms``); does one begin so; does it say header; does role or visibility mark boilerplate; may the names be those of a layout.

    A name that says with or without something (``has-sidebar``, ``no-comments``) says
    nothing of the element itself.
    """
    bad = plain = leads = header = sure = False
    layout = True
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            for i, part in enumerate(value.split()):
                words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", part)]
                if QUALIFIERS.isdisjoint(words):
                    hints = not HINTS.isdisjoint(words)
                    bad |= hints
                    plain |= hints and (HINTS | STRUCTURE).issuperset(words)
                    leads |= not i and bool(words) and words[0] in HINTS
                    layout &= not hints or words[0] not in HINTS and SAID.isdisjoint(words)
                    header |= "header" in words
        elif name == "role":
            sure |= value.lower() in ROLES
        elif name == "style":
            sure |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            sure |= value.lower() != "false" and (name == "hidden" or value.lower() == "true")
    return bad, bad and not plain, leads, header, sure, layout


#: text, characters in links, in boilerplate, number of its content root (negative: an article named as boilerplate), heading, element
Block = tuple[str, int, bool, int, bool, str]
_OUTSIDE = ("", False, False, 0, False, ())


def _long_and_dense(text: str) -> bool:
    if len(text) < LONG // 3:
        return False
    words = _WORD.findall(text.lower())
    if len(text) >= LONG and sum(w in _FUNCTION for w in words) >= DENSE * max(1, len(words)):
        return True
    return _sentences(text, words)


def _sentences(text: str, words: list[str]) -> bool:
    """Is a text without listed function words prose: it ends as a sentence does and has enough marks for its length.

    A script without spaces says more in a character. In the Latin script most words must be in small letters, which those of titles and
    lists of names are not, and the text twice as long, since most languages of this script are listed.
    """
    bare = text.rstrip(_CLOSING)
    if not bare or bare[-1] not in _FULL:
        return False
    letters, marks = sum(map(len, words)), sum(c in MARKS for c in text)
    latin = sum(len(w) for w in words if w[0] < "\u0250")
    if 2 * latin > letters:
        small = sum(map(str.islower, (w[0] for w in _WORD.findall(text))))
        return len(text) >= 2 * LONG and marks >= 2 and marks * 100 >= len(text) and 10 * small >= 7 * len(words)
    dense = letters >= 8 * max(1, len(words))  # long runs of letters: no spaces between words
    return len(text) >= (LONG // 3 if dense else LONG) and marks * (40 if dense else 100) >= len(text)


class _Page:
    """Blocks of one page.

    spared are the numbers of elements (of their start tags) that no name condemns; lenient, no
    element is condemned by its name or as a form.
    """

    def __init__(self, page: str, spared: frozenset[int] = frozenset(), lenient: bool = False):
        self.blocks: list[Block] = []
        self.spared, self.lenient = spared, lenient
        # name, boilerplate, in a header, content root, surely boilerplate, numbers of the elements around that may be spared
        self.open: list[tuple[str, bool, bool, int, bool, tuple[int, ...]]] = []
        self.names: Counter[str] = Counter()  # of the open elements
        self.unseen = 0  # how many of them are not shown
        self.wrapped: dict[int, int] = {}  # long dense text of elements that may be spared
        self.sections: set[int] = set()  # those of them inside a main or article
        self.pieces: list[str] = []
        self.linked = self.in_link = self.breaks = self.roots = self.tags = 0
        self.anchor = self.anchor_end = -1  # where the next ones are
        self.page = page
        self.heading = False
        at, low, last = 0, None, page.rfind(">") + 1  # every tag ends there at the latest
        while m := _TAG.search(page, at, last):
            self.text(page[at : m.start()])
            at = self.at = m.end()
            if m[0] == "<!--":
                at = page.find("-->", at - 2) + 3
                if at < 3:
                    at = len(page)
                continue
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if name in RAW and not closing and not attributes.endswith("/"):
                low = low or page.lower()
                end = low.find(f"</{name}", at)
                at = len(page) if end < 0 else max(page.find(">", end) + 1, end + 2)
                if name not in INLINE and name != "script" and name != "style":
                    self.flush()
            elif closing:
                self.end(name)
            else:
                self.start(name, attributes)
        comment = page.find("<!--", at)
        self.text(page[at : comment if comment >= 0 else len(page)])
        self.flush()

    def text(self, raw: str) -> None:
        if raw and not self.unseen:
            if not raw.isspace():
                self.breaks = 0
            piece = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(piece)
            if self.in_link:
                self.linked += len("".join(piece.split()))

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            _, bad, in_header, root, sure, inside = self.open[-1] if self.open else _OUTSIDE
            if inside and not sure and self.linked <= LINKED * (len(text) - text.count(" ")) and _long_and_dense(text):
                for k in inside:
                    self.wrapped[k] += len(text)
            boilerplate = bad or in_header and not (root and self.heading)
            self.blocks.append((text, self.linked, boilerplate, root, self.heading, self.open[-1][0] if self.open else ""))
        self.pieces.clear()
        self.linked = self.breaks = 0

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.breaks += 1
            self.pieces.append(" ")
            if self.breaks > 1:
                self.flush()
            return
        if name in ("td", "th"):
            self.pieces.append(" ")
        self.tags += 1
        named, subject, leads, says_header, surely, layout = _hinted(attributes) if attributes and not attributes.isspace() else (False,) * 6
        hinted = named or surely
        if name == "a":
            self.in_link = self.link() if _HREF.search(attributes) else 0
        if name in INLINE and not hinted:
            return
        if name not in ("td", "th"):
            self.flush()
        if name not in INLINE and self.in_link == 2:
            self.in_link = 0
        if name in VOID or attributes.endswith("/"):
            return
        if name not in INLINE:
            self.close_implied(name)
        _, bad, in_header, root, sure, inside = self.open[-1] if self.open else _OUTSIDE
        aside = name == "article" and leads  # a comment, a related piece and the like
        if (bad or in_header) and not sure and (name == "main" or name == "article" and not aside):
            if name == "article":
                inside = self.measured(inside)
            if name == "main" or self.tags in self.spared:
                bad = in_header = False
        bad = bad or aside and root != 0
        if name in ("main", "article") and not bad and not root:
            self.roots += 1
            root = -self.roots if aside else self.roots
        self.heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        # the body's own class describes the page
        own = name not in ("html", "body", "main", "article")
        sure = sure or name == "header" or name in BOILERPLATE and name != "form" or surely and own or aside and root != 0
        if self.lenient:
            named = says_header = False
        if not bad and own and not surely and (named and subject and root or not root and (named and layout or name == "form" and (layout or not named))):
            inside = self.measured(inside)  # a section of the text may be about what the word says, a wrapper be the page's layout
            if root:
                self.sections.add(self.tags)
        if self.tags in self.spared:
            named = False
        bad = bad or name in BOILERPLATE and not (name == "form" and (self.lenient or self.tags in self.spared)) or (named or surely) and own
        self.open.append((name, bad, in_header or name == "header" or says_header and not root, root, sure, inside))
        self.names[name] += 1
        self.unseen += name in UNSEEN

    def measured(self, inside: tuple[int, ...]) -> tuple[int, ...]:
        self.wrapped[self.tags] = 0
        return (*inside[-MOST_WRAPPERS:], self.tags)

    def link(self) -> int:
        """1 for a link that ends before another begins, else 2."""
        if self.anchor_end < self.at:
            found = _ANCHOR_END.search(self.page, self.at)
            self.anchor_end = found.start() if found else len(self.page)
        if self.anchor < self.at:
            found = _ANCHOR.search(self.page, self.at)
            self.anchor = found.start() if found else len(self.page)
        return 1 if self.anchor_end < min(self.anchor, len(self.page)) else 2

    def close_implied(self, name: str) -> None:
        """A new block ends an open paragraph; a list item, cell or row ends the one before."""
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
        while self.open and (self.open[-1][0] == "p" or self.open[-1][0] in same or self.open[-1][0] in INLINE):
            self.pop()

    def pop(self) -> str:
        name = self.open.pop()[0]
        self.names[name] -= 1
        self.unseen -= name in UNSEEN
        return name

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = 0
        if name in INLINE and not self.names[name]:
            return
        if name in ("td", "th"):
            self.pieces.append(" ")
        else:
            self.flush()
            if self.in_link == 2 and name not in INLINE:
                self.in_link = 0
        if self.names[name]:
            while self.pop() != name:
                pass
        self.heading = bool(self.open) and self.open[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")


def _first_pass(blocks: list[Block]) -> list[int]:
    """1 good, -1 bad, 0 undecided."""
    rooted = any(root for _, _, bad, root, _, _ in blocks if not bad)
    plain = any(root > 0 for _, _, bad, root, _, _ in blocks if not bad)
    out = []
    for text, linked, bad, root, _, _ in blocks:
        chars = len(text) - text.count(" ")
        if bad or rooted and not root or plain and root < 0 or linked > LINKED * chars or not root and "©" in text[:80]:
            out.append(-1)
            continue
        out.append(1 if _long_and_dense(text) else 0)
    return out


def _second_pass(blocks: list[Block], first: list[int]) -> list[bool]:
    n, far = len(blocks), len(blocks) + 2
    nearest: list[list[tuple[int, int, str]]] = [[], []]  # distance, label, element
    for side, order in enumerate((range(n), range(n - 1, -1, -1))):
        seen: dict[int, tuple[int, int]] = {}
        for i in order:
            root = blocks[i][3]
            edge = (far, 1, "") if root else ((i if side == 0 else n - 1 - i) + 1, -1, "")
            at = seen.get(root)
            nearest[side].append((abs(i - at[0]), at[1], blocks[at[0]][5]) if at else edge)
            if first[i] and not (root and blocks[i][2]):  # boilerplate inside a root says nothing of its neighbours
                seen[root] = (i, first[i])
    nearest[1].reverse()
    out = []
    for i, (_, _, _, root, heading, element) in enumerate(blocks):
        (before, left, of_left), (after, right, of_right) = nearest[0][i], nearest[1][i]
        if first[i]:
            out.append(first[i] > 0)
        elif before != after:
            out.append((left if before < after else right) > 0)
        elif heading:
            out.append(right > 0)
        elif (of_left == element) != (of_right == element):
            out.append((left if of_left == element else right) > 0)
        else:
            out.append((max(left, right) if root else min(left, right)) > 0)
    return out if any(out) else [x == 0 for x in first]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    made = _Page(page)
    first = _first_pass(made.blocks)
    good = sum(len(b[0]) for b, label in zip(made.blocks, first, strict=True) if label > 0)
    spared = frozenset(k for k, n in made.wrapped.items() if n > (0 if k in made.sections else good))
    if spared:
        made = _Page(page, spared)
        first = _first_pass(made.blocks)
    keep = _second_pass(made.blocks, first)
    if made.blocks and not any(keep):
        lenient = _Page(page, lenient=True)
        first = _first_pass(lenient.blocks)
        if any(label > 0 for label in first):
            made, keep = lenient, _second_pass(lenient.blocks, first)
    return "\n".join(b[0] for b, stays in zip(made.blocks, keep, strict=True) if stays)


def _texts(column: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in column], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    text = F.arrow_udf(_texts, T.StringType())("html")
    made = pages.select("page_id", "url", text.alias("text"))
    return made.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))

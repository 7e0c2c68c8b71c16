"""A forgiving HTML reader: block elements with their text, as flat lists.

Reading takes time in proportion to the page, whatever its errors: every search either moves on or finds
that the page holds no more of what it looks for. Elements nested deeper than ``MAX_DEPTH`` blocks become
siblings at that depth, as in browsers; their text stays.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html import unescape

# Element names by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
DROPPED = frozenset("head title script style template select option optgroup datalist button textarea".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i iframe ins kbd label map mark math meter nobr object output picture progress q rp rt ruby s samp small span strike strong sub sup svg time tt u var video".split())
IN_HEAD = frozenset("head html base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
MAX_DEPTH = 512
# Fixed values end.

#: What may begin a tag or a comment; any other bracket is text.
_OPEN = re.compile(r"<[a-zA-Z/!?]")
#: A start tag without angle brackets in quotes; all others are read piece by piece.
_PLAIN = re.compile(r"<([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r">|=\s*[\"']")
_NAMES = re.compile(r"(?:^|[\s\"'/])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass
class Block:
    """A block element: its place in the tree, its own runs of text, and how much of that is linked."""

    tag: str
    names: str
    parent: int
    depth: int
    linked: int = 0
    chars: int = 0


@dataclass
class Page:
    """The blocks in page order (parents first) and the runs of text: (block, text)."""

    blocks: list[Block] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


class _Tags:
    """Cuts a page into text and tags."""

    def __init__(self, html: str):
        self.html, self.size = html, len(html)
        self.quotes = {'"': True, "'": True}  # whether any may still come

    def end_of_start(self, at: int) -> int:
        """Where the start tag whose name ends at ``at`` has its closing bracket, or the page's end.

        A quote opens a value only after an equals sign; a value that never closes ends at the bracket.
        """
        html = self.html
        while stop := _STOP.search(html, at):
            if stop[0] == ">":
                return stop.start()
            quote = stop[0][-1]
            end = html.find(quote, stop.end()) if self.quotes[quote] else -1
            if end < 0:
                self.quotes[quote] = False
                end = html.find(">", stop.end())
                return end if end >= 0 else self.size
            at = end + 1
        return self.size


def parse(html: str) -> Page:
    """Read a page; errors are mended as browsers commonly do, nothing raises."""
    page = Page([Block("#page", "", -1, 0)])
    blocks, tags = page.blocks, _Tags(html)
    stack: list[tuple[str | None, int]] = [("#page", 0)]  # open elements (None: closed while others are open in it) and the block their text belongs to
    places: dict[str, list[int]] = {"#page": [0]}  # by name: the open elements' places in the stack
    solid = [0]  # the places of elements that are not inline
    links = dropped = 0
    buffer: list[str] = []
    owner = 0

    def flush() -> None:
        nonlocal buffer
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                page.runs.append((owner, text))
                blocks[owner].chars += len(text)
            buffer = []

    def add(text: str) -> None:
        nonlocal owner
        if stack[-1][0] == "head" and text.strip():
            close("head")
        if dropped or not text:
            return
        block = stack[-1][1]
        if block != owner:
            flush()
            owner = block
        if "&" in text:
            text = unescape(text)
        buffer.append(text)
        if links:
            blocks[block].linked += len(text)

    def ended(tag: str) -> None:
        nonlocal links, dropped
        places[tag].pop()
        if tag == "a":
            links -= 1
        elif tag in DROPPED:
            dropped -= 1
        if tag not in INLINE:
            solid.pop()
            flush()

    def cut(place: int) -> None:
        """Close everything from a place of the stack on."""
        while len(stack) > place:
            tag, _ = stack.pop()
            if tag is not None:
                ended(tag)

    def close(tag: str) -> None:
        if own := places.get(tag):
            place = own[-1]
            if place < solid[-1] and tag in INLINE:  # blocks stay open that began within it
                stack[place] = (None, stack[place][1])
                ended(tag)
            else:
                cut(place)

    def imply(tag: str) -> None:
        """Close what a new element ends, up to the list or table that it stands in."""
        scope = max((own[-1] for s in SCOPES[tag] if (own := places.get(s))), default=0)
        found = [own[k] for t in IMPLIED[tag] if (own := places.get(t)) and (k := bisect_right(own, scope)) < len(own)]
        if found:
            cut(min(found))

    at, size = 0, len(html)
    while at < size:
        opened = _OPEN.search(html, at)
        if not opened:
            add(html[at:])
            break
        begin = opened.start()
        if begin > at:
            add(html[at:begin])
        m = _PLAIN.match(html, begin)
        if m:
            tag, rest, at = m[1].lower(), m[2], m.end()
        else:
            sign = html[begin + 1]
            if sign == "/" and (m := _NAME.match(html, begin + 2)):
                end = html.find(">", m.end())
                at = end + 1 if end >= 0 else size
                close(m[0].lower())
                continue
            if sign in "!?/":
                if html.startswith("<!--", begin):
                    ends = [e for mark in ("-->", "--!>") if (e := html.find(mark, begin + 2)) >= 0]
                    at = html.index(">", min(ends)) + 1 if ends else size
                else:
                    end = html.find(">", begin)
                    at = end + 1 if end >= 0 else size
                continue
            m = _NAME.match(html, begin + 1)
            end = tags.end_of_start(m.end())
            if end >= size:
                break  # a tag that never ends
            tag, rest, at = m[0].lower(), html[m.end() : end], end + 1
        if tag == "body" or (stack[-1][0] == "head" and tag not in IN_HEAD):
            close("head")
        if tag == "br" or tag == "hr":
            flush()
        if tag in CLOSES_P and places.get("p"):
            close("p")
        if tag in IMPLIED:
            imply(tag)
        if tag in VOID:
            continue
        if tag == "a":
            close("a")
            links += 1
        block = stack[-1][1]
        if tag in DROPPED:
            dropped += 1
            solid.append(len(stack))
        elif tag not in INLINE:
            flush()
            names = " ".join(x or y or z for x, y, z in _NAMES.findall(rest)).lower() if "=" in rest else ""
            parent = block if blocks[block].depth < MAX_DEPTH else blocks[block].parent
            blocks.append(Block(tag, names, parent, blocks[parent].depth + 1))
            block = len(blocks) - 1
            solid.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, block))
        if tag in RAW:
            end = _RAW_ENDS[tag].search(html, at)
            stop = end.start() if end else size
            if not dropped:
                add(html[at:stop].replace("&", "&amp;") if tag == "xmp" else html[at:stop])
            at = stop
    flush()
    return page

"""HTML to leaf blocks, and blocks to vectors.

A leaf block is the text between two block-level boundaries, with white space folded and character
references decoded.  Each has the path of open tags with their class, id and role words, and the
share of its characters inside links.  Comments, scripts, styles and other raw elements give no text;
unclosed elements end with their parents, and an unclosed raw element or comment ends with the page.
A comment ends as the page standard says: also at ``<!-->``, ``<!--->`` and ``--!>``.  A quote opens an
attribute's value behind an equals sign only; if it is never closed, the tag ends at the next ``>``.

Time and memory are linear in the page: the page is scanned once by position, open tags are found by
their names, blocks share the nodes of their paths, and the path's vector is kept up to date with
each opened and closed tag instead of being made from the path.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Elements that do not interrupt a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not page text.
RAW = frozenset("script style noscript template textarea svg math iframe object select option title".split())
#: An opening tag closes an open one of these in the same parent.
_CLOSES = {
    **{t: frozenset(["p"]) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
}
_SCOPE = frozenset("html body table ul ol dl div section article aside main nav header footer form td th".split())
_MARKUP = re.compile(r"<(?=[!?/a-zA-Z])")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_IN_TAG = re.compile(r"[>\"']")
_COMMENT_END = re.compile(r"--!?>")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME_WORD = re.compile(r"[a-z]+")
#: Numeric references that only leading zeros make long, and ones beyond all code points.
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_TOO_LARGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")

PATH_DIMS, WORD_DIMS, PLAIN_DIMS = 128, 48, 10
DIMS = PATH_DIMS + WORD_DIMS + PLAIN_DIMS


@dataclass(slots=True)
class Node:
    """An open element that is not inline: its parent, tag and name words."""

    parent: "Node | None"
    tag: str
    names: tuple[str, ...]


@dataclass(slots=True)
class Block:
    text: str
    node: Node | None
    mark: bytes  # the path's vector as 32-bit integers
    linked: float

    @property
    def path(self) -> tuple[str, ...]:
        """Open tags and their name words, from the outermost on."""
        nodes, node = [], self.node
        while node:
            nodes.append(node)
            node = node.parent
        return tuple(x for n in reversed(nodes) for x in (n.tag, *("." + w for w in n.names)))


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = []
    for m in _NAMES.finditer(attributes):
        found += _NAME_WORD.findall((m[2] or m[3] or m[4] or "").lower())
    return tuple(found)


def decoded(text: str) -> str:
    """Text with its character references replaced; numbers of any length are allowed."""
    if "&#" in text:
        text = _TOO_LARGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return entities.unescape(text) if "&" in text else text


@lru_cache(maxsize=100_000)
def _path_slot(token: str) -> tuple[int, int]:
    h = zlib.crc32(token.encode("utf-8"))
    return h % PATH_DIMS, 1 if h >> 31 else -1


class _Path:
    """The open elements, with the last place of each tag and the vector of the distinct path tokens."""

    def __init__(self):
        self.tags: list[str] = []
        self.nodes: list[Node | None] = []  # the innermost element that is not inline, at each depth
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []
        self.open: dict[str, int] = {}
        self.vector = array("i", bytes(4 * PATH_DIMS))
        self.links = 0

    def node(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _count(self, token: str, by: int) -> None:
        n = self.open.get(token, 0)
        if n + by:
            self.open[token] = n + by
        else:
            del self.open[token]
        if n == 0 or n + by == 0:
            slot, sign = _path_slot(token)
            self.vector[slot] += sign * by

    def push(self, tag: str, attributes: str) -> None:
        at, node = len(self.tags), self.node()
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(at)
        if tag in _SCOPE:
            self.scopes.append(at)
        if tag in INLINE:
            self.links += tag == "a"
        else:
            self.blocks.append(at)
            node = Node(node, tag, _names(attributes))
            self._count(tag, 1)
            for w in node.names:
                self._count("." + w, 1)
        self.nodes.append(node)

    def close(self, at: int) -> None:
        """Close the element at this depth and all inside it."""
        while len(self.tags) > at:
            tag, node = self.tags.pop(), self.nodes.pop()
            self.places[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()
            if tag in INLINE:
                self.links -= tag == "a"
            else:
                self.blocks.pop()
                self._count(tag, -1)
                for w in node.names:
                    self._count("." + w, -1)


def _tag_end(page: str, at: int, none_left: dict[str, bool]) -> int:
    """Where the tag whose attributes begin here has its >; the page's end if it has none."""
    first = -1
    while True:
        m = _IN_TAG.search(page, at)
        if not m:
            return len(page) if first < 0 else first
        c, k = m[0], m.start()
        if c == ">":
            return k
        at = k + 1
        before = k - 1
        while page[before] in " \t\n\r\f":
            before -= 1
        if page[before] != "=":
            continue
        end = -1 if none_left.get(c) else page.find(c, at)
        if end < 0:
            none_left[c] = True  # nor behind any later place
        else:
            at = end + 1


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order; empty ones are left out."""
    page = page or ""
    blocks: list[Block] = []
    path = _Path()
    line: list[str] = []
    chars_linked = chars = 0
    none_left: dict[str, bool] = {}

    def flush() -> None:
        nonlocal chars, chars_linked
        if line:
            text = " ".join(decoded("".join(line)).split())
            if text:
                blocks.append(Block(text, path.node(), path.vector.tobytes(), chars_linked / max(1, chars)))
            line.clear()
        chars = chars_linked = 0

    def text_of(a: int, b: int) -> None:
        nonlocal chars, chars_linked
        if b > a:
            piece = page[a:b]
            line.append(piece)
            n = len(piece.strip())
            chars += n
            if path.links:
                chars_linked += n

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if not m:
            text_of(at, size)
            break
        begin = m.start()
        text_of(at, begin)
        if page.startswith("<!--", begin):
            inner = begin + 4
            if page.startswith((">", "->"), inner):
                at = page.index(">", inner) + 1
            else:
                end = _COMMENT_END.search(page, inner)
                at = end.end() if end else size
            continue
        if page.startswith("<![CDATA[", begin):
            end = page.find("]]>", begin + 9)
            text_of(begin + 9, size if end < 0 else end)
            at = size if end < 0 else end + 3
            continue
        closing = page.startswith("</", begin)
        name = _TAG_NAME.match(page, begin + 1 + closing)
        if not name:
            if closing and not page.startswith("</>", begin) and page[begin + 2 : begin + 3] in ("", " "):
                text_of(begin, begin + 2)
                at = begin + 2
                continue
            end = page.find(">", begin)  # <!doctype>, <?xml> and the like
            at = size if end < 0 else end + 1
            continue
        tag = name[0].lower()
        end = _tag_end(page, name.end(), none_left)
        attributes = page[name.end() : end]
        at = end + 1
        if closing:
            if tag not in INLINE:
                flush()
            k = path.last(tag)
            # an inline end tag reaches no further than the innermost element that is not inline
            if k >= 0 and (tag not in INLINE or not path.blocks or k > path.blocks[-1]):
                path.close(k)
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in RAW:
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            stop = _raw_end(tag).search(page, at)
            end = page.find(">", stop.end()) if stop else -1
            at = size if end < 0 else end + 1
            continue
        closes = _CLOSES.get(tag)
        if closes:
            k = max(path.last(t) for t in closes)
            if k >= 0 and k >= (path.scopes[-1] if path.scopes else -1):
                path.close(k)
        path.push(tag, attributes)
    flush()
    return blocks


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?![^\\s/>])", re.I)


@lru_cache(maxsize=100_000)
def _word_slot(word: str) -> int:
    return zlib.crc32(b"w" + word.encode("utf-8")) % WORD_DIMS


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row for each block: tag path, hashed words, and plain measures."""
    n = len(blocks)
    out = np.zeros((n, DIMS), np.float32)
    if n:
        out[:, :PATH_DIMS] = np.frombuffer(b"".join(b.mark for b in blocks), np.int32).reshape(n, PATH_DIMS)
    for i, b in enumerate(blocks):
        words = b.text.lower().split()
        counts = np.bincount([_word_slot(w) for w in words], minlength=WORD_DIMS)
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / len(words)
        size = len(b.text)
        out[i, -PLAIN_DIMS:] = (
            np.log1p(size) / 8, np.log1p(len(words)) / 6, b.linked, b.text[-1:] in ".!?", sum(b.text.count(c) for c in ".,;:") / size * 10,
            i / n, (n - i) / n, "©" in b.text, len(words) <= 3, any(c.isdigit() for c in b.text),
        )
    return out

"""HTML pages as sequences of leaf blocks: text with the path of tags above it."""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser

import numpy as np

# Fixed values of the HTML language: tags without content, tags of formulas, tags inside a line of text, tags whose text is not
# shown, those of them that only formulas hold, tags that leave an open head open, tags that end an open paragraph, tags that
# end an open tag of their own kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("annotation annotation-xml maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
                 "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none "
                 "semantics".split())
INLINE = MATH | frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub "
                          "sup time tt u var".split())
HIDDEN = frozenset("script style noscript template head title svg object iframe canvas audio video select option textarea".split())
MATH_HIDDEN = frozenset(("annotation", "annotation-xml"))
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                   "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ENDS_SELF = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",)}

#: sizes of the hashed vectors of tags and names on the path, of the innermost tags, and of words; plain measures follow them
PATH_DIM, TAG_DIM, WORD_DIM, PLAIN_DIM = 512, 64, 32, 24
DIM = PATH_DIM + TAG_DIM + WORD_DIM + PLAIN_DIM
_NAME = re.compile(r"[a-z]+[0-9]*|[0-9]+")


def _slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


_bits: dict[tuple[str, ...], int] = {}


def _bits_of(names: tuple[str, ...]) -> int:
    bits = _bits.get(names)
    if bits is None:
        bits = 0
        for name in names:
            bits |= 1 << _slot(name, PATH_DIM)
        if len(_bits) >= 20_000:
            _bits.clear()
        _bits[names] = bits
    return bits


class Node:
    """An open element: its tag and names, and what its path holds, as bits; a page's nodes share their paths."""

    __slots__ = ("parent", "names", "bits", "depth")

    def __init__(self, parent: "Node | None", names: tuple[str, ...]):
        self.parent, self.names = parent, names
        self.bits = _bits_of(names) | (parent.bits if parent else 0)
        self.depth = (parent.depth if parent else 0) + 1

    def path(self) -> tuple[str, ...]:
        out, node = [], self
        while node:
            out.append(node.names)
            node = node.parent
        return tuple(name for names in reversed(out) for name in names)


_nodes: dict[tuple[str, ...], Node] = {}


def node_of(path: tuple[str, ...]) -> Node | None:
    """The node of a path written as tags, each followed by its names (``.name``); equal paths have one node."""
    if not path:
        return None
    node = _nodes.get(path)
    if node is None:
        at = max(i for i, name in enumerate(path) if name[0] != ".")
        node = Node(node_of(path[:at]), path[at:])
        if len(_nodes) >= 20_000:
            _nodes.clear()
        _nodes[path] = node
    return node


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, path: "tuple[str, ...] | Node | None", text: str, linked: int):
        self.node = node_of(path) if isinstance(path, tuple) else path
        self.text, self.linked = text, linked

    @property
    def path(self) -> tuple[str, ...]:
        return self.node.path() if self.node else ()


class _Reader(HTMLParser):
    """Collects blocks; white space inside one is a single space.

    The places of open tags are kept by tag, so that no tag looks through
    the whole path: time and memory follow the page's length, however deep."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Node | None, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.outside: list[int] = []  # places of open tags that are not inline
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.hidden = self.links = 0
        self.at: Node | None = None

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(self.at, text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _pop_to(self, index: int) -> None:
        for tag, _, hides in reversed(self.open[index:]):
            self.hidden -= hides
            self.links -= tag == "a"
            self.places[tag].pop()
            if tag not in INLINE:
                self.outside.pop()
        del self.open[index:]

    def _close(self, tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        at = self._last(tags)
        if at >= 0 and at > self._last(until):
            self._pop_to(at)

    def _has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def _end_head(self) -> None:
        if self._has("head"):
            self._pop_to(self.places["head"][0])

    def handle_starttag(self, tag, attrs):
        if self.hidden and (tag == "body" and not self._has("template") or self.open[-1][0] == "head" and tag not in IN_HEAD):
            self._end_head()
        if tag == "br":
            if self.parts:
                self.parts.append(" ")
            return
        if tag not in INLINE:
            self.end_block()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._close(("p",), ("button", "td", "th", "table", "object"))
        if tag in ENDS_SELF:
            self._close(("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,), ENDS_SELF[tag])
        hides = tag in HIDDEN or tag in MATH_HIDDEN and self._has("math")
        node = self.open[-1][1] if self.open else None
        if tag not in INLINE:
            names = [tag]
            for key, value in attrs:
                if key in ("class", "id", "role") and value:
                    names += [f".{w}" for w in _NAME.findall(value.lower())]
            node = Node(node, tuple(names))
            self.outside.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node, hides))
        self.hidden += hides
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML, but ends drawings and formulas and the tags of them
        if tag not in VOID and (tag in ("svg", "math") or self._has("svg") or tag in MATH and self._has("math")):
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "p" and not self._has("p"):
            self.end_block()
        if not self._has(tag):
            return
        at = self.places[tag][-1]
        if tag in INLINE:
            if self.outside and self.outside[-1] > at:
                return  # formatting that a block has already ended
        else:
            self.end_block()
        self._pop_to(at)

    def handle_data(self, data):
        if self.hidden and self.open[-1][0] == "head" and data.strip():
            self._end_head()
        if self.hidden > 0 or not data:
            return
        if not self.parts:
            self.at = self.open[-1][1] if self.open else None
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def read_blocks(html: str | None) -> list[Block]:
    """The page's non-empty text blocks in order."""
    if not html:
        return []
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.end_block()
    return reader.blocks


_vectors: dict[tuple[int, str, str], np.ndarray] = {}


def path_vector(node: Node | None) -> np.ndarray:
    """Hashed names on the path, then the innermost tag and, weaker, the one around it."""
    if node is None:
        return np.zeros(PATH_DIM + TAG_DIM, np.float32)
    key = node.bits, node.names[0], node.parent.names[0] if node.parent else ""
    v = _vectors.get(key)
    if v is None:
        v = np.zeros(PATH_DIM + TAG_DIM, np.float32)
        raw = np.frombuffer(node.bits.to_bytes(PATH_DIM // 8, "little"), np.uint8)
        v[:PATH_DIM] = np.unpackbits(raw, bitorder="little")
        if key[2]:
            v[PATH_DIM + _slot(key[2], TAG_DIM)] = 0.5
        v[PATH_DIM + _slot(key[1], TAG_DIM)] = 1.0
        if len(_vectors) >= 20_000:
            _vectors.clear()
        _vectors[key] = v
    return v


def _containers(keys: np.ndarray, chars: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each block how its container, ``keys``, stands on the page: its part of the page's text
    outside of links, its part of text in links, its blocks, whether it is the one with most text, and the block's place before
    (-1), in (0) or behind (1) the blocks of that one."""
    plain = np.bincount(keys, chars - linked)
    all_ = np.bincount(keys, chars)
    best = int(plain.argmax())
    inside = np.flatnonzero(keys == best)
    at = np.arange(len(keys))
    where = np.where(at < inside[0], -1.0, np.where(at > inside[-1], 1.0, 0.0))
    return np.stack([(plain / max(plain.sum(), 1))[keys], 1 - (plain / np.maximum(all_, 1))[keys], np.log1p(np.bincount(keys))[keys] / 5,
                     keys == best, where], axis=1)


def features(blocks: list[Block]) -> np.ndarray:
    """One row for each block: path vector, hashed words, and measures of the block and of its place on the page."""
    x = np.zeros((len(blocks), DIM), np.float32)
    if not blocks:
        return x
    at, words_at = PATH_DIM + TAG_DIM, PATH_DIM + TAG_DIM + WORD_DIM
    heading = False
    for i, (row, b) in enumerate(zip(x, blocks)):
        row[:at] = path_vector(b.node)
        words = b.text.lower().split()
        slots = np.fromiter((_slot(w, WORD_DIM) for w in words), np.int64, len(words))
        row[at:words_at] = np.sqrt(np.bincount(slots, minlength=WORD_DIM) / max(len(words), 1))
        tag = b.node.names[0] if b.node else ""
        heading = heading or tag in ("h1", "h2")
        size = len(b.text)
        row[words_at:words_at + 9] = (np.log1p(size) / 8, b.linked / size, b.text[-1] in ".!?:", np.log1p(len(words)) / 6,
                                      min(b.node.depth if b.node else 0, 32) / 16, i / len(blocks), heading, "\u00a9" in b.text or "(c)" in b.text,
                                      sum(map(str.isdigit, b.text)) / size)
    chars, linked = np.array([len(b.text) for b in blocks], float), np.array([b.linked for b in blocks], float)
    around, number = [b.node for b in blocks], {}
    for k in range(3):  # the elements one, two and three above a block's own
        around = [node.parent or node if node else None for node in around]
        keys = np.array([number.setdefault(id(node), len(number)) for node in around])
        row = words_at + 9 + 5 * k
        x[:, row:row + 5] = _containers(keys, chars, linked)
    return x

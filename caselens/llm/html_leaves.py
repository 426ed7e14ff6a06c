"""A page's leaf blocks: its runs of visible text between block tags, each with the path of open elements."""

from __future__ import annotations

import html
import re
import zlib
from typing import NamedTuple

PATH_BUCKETS = 1024
#: Elements of a path that describe a leaf: so many from the top and from the leaf up.
_TOP, _NEAR = 3, 10

# Fixed values of HTML: names by what they do to text.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_HIDDEN = frozenset("audio canvas head math noscript object svg template video".split())
_METADATA = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
_ENDS_P_SCOPE = frozenset("button caption object table td template th".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}

_TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_PLAIN = re.compile(r"[^>\"']*+")
_NAMED = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Leaf(NamedTuple):
    path: tuple[int, ...]
    text: str
    linked: float


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % PATH_BUCKETS


class _Page:
    def __init__(self):
        self.frames: list[tuple[str, tuple[int, ...]]] = []
        self.open: dict[str, int] = {}
        self.hidden = 0
        self.pieces: list[str] = []
        self.linked = 0
        self.leaves: list[Leaf] = []

    def text(self, piece: str) -> None:
        if piece and not self.hidden:
            piece = html.unescape(piece) if "&" in piece else piece
            self.pieces.append(piece)
            if self.open.get("a"):
                self.linked += len("".join(piece.split()))

    def flush(self) -> None:
        if self.pieces:
            words = "".join(self.pieces).split()
            if words:
                self.leaves.append(Leaf(self._path(), " ".join(words), self.linked / sum(map(len, words))))
            self.pieces, self.linked = [], 0

    def _path(self) -> tuple[int, ...]:
        frames = self.frames if len(self.frames) <= _TOP + _NEAR else self.frames[:_TOP] + self.frames[-_NEAR:]
        blocks = [name for name, _ in self.frames[-_NEAR:] if name not in _INLINE][-2:]
        own = [_bucket(f"leaf {blocks[-1]}"), _bucket(" > ".join(blocks))] if blocks else [_bucket("leaf")]
        return tuple(dict.fromkeys([*own, *(i for _, ids in frames for i in ids)]))

    def pop_to(self, names: set[str] | frozenset[str], scope: set[str] | frozenset[str] = frozenset()) -> None:
        """Closes the innermost of ``names`` and all in it, unless an element of ``scope`` lies between."""
        for name in names:
            if self.open.get(name):
                break
        else:
            return
        for at in range(len(self.frames) - 1, -1, -1):
            name = self.frames[at][0]
            if name in names:
                for gone, _ in self.frames[at:]:
                    self.open[gone] -= 1
                    self.hidden -= gone in _HIDDEN
                del self.frames[at:]
                return
            if name in scope:
                return

    def start(self, name: str, attributes: str) -> None:
        if name not in _INLINE:
            self.flush()
        if name not in _METADATA and self.open.get("head"):
            self.pop_to({"head"})
        if name not in _INLINE and name not in _METADATA and self.open.get("p"):
            self.pop_to({"p"}, _ENDS_P_SCOPE)
        if name in _CLOSES:
            self.pop_to(*_CLOSES[name])
        if name == "br":
            self.pieces.append(" ")
        if name in _VOID:
            return
        features = [f"in {name}"]
        if "=" in attributes:
            for _, *values in _NAMED.findall(attributes):
                features += [f"name {p.lower()}" for p in _PART.findall("".join(values)) if len(p) > 1]
        self.frames.append((name, tuple(_bucket(f) for f in features)))
        self.open[name] = self.open.get(name, 0) + 1
        self.hidden += name in _HIDDEN

    def end(self, name: str) -> None:
        if name not in _INLINE:
            self.flush()
        self.pop_to({name}, _ENDS_P_SCOPE if name in _INLINE or name == "p" else frozenset())


def leaves(page: str | None) -> list[Leaf]:
    """The leaf blocks of a page in order. Scripts, styles, comments and whatever is never shown aren't text; white space
    (Unicode's, references decoded) inside a block is one space; a tag that never ends is closed by the page's end."""
    if not page:
        return []
    out, at, size = _Page(), 0, len(page)
    low = None
    quoted = {'"': True, "'": True}
    while at < size:
        tag = _TAG.search(page, at)
        if not tag:
            out.text(page[at:])
            break
        out.text(page[at : tag.start()])
        name = tag[2]
        if name is None:
            stop = page.find("-->", tag.end() - 2) if tag[0] == "<!--" else page.find(">", tag.end())
            at = size if stop < 0 else stop + (3 if tag[0] == "<!--" else 1)
            continue
        name, stop = name.lower(), _PLAIN.match(page, tag.end()).end()
        while stop < size and page[stop] != ">":
            close = page.find(page[stop], stop + 1) if quoted[page[stop]] else -1
            if close < 0:
                # No such quote follows: this one is an ordinary character.
                quoted[page[stop]] = False
                close = stop
            stop = _PLAIN.match(page, close + 1).end()
        attributes, at = page[tag.end() : stop], min(stop + 1, size)
        if tag[1]:
            if name not in _RAW:
                out.end(name)
        elif name in _RAW:
            if name not in _METADATA:
                out.flush()
            low = page.lower() if low is None else low
            # Lower-casing may lengthen a text; then the end is sought by a pattern.
            stop = low.find(f"</{name}", at) if len(low) == size else next((m.start() for m in [re.compile(f"</{name}", re.I).search(page, at)] if m), -1)
            at = size if stop < 0 else stop
        else:
            out.start(name, attributes)
    out.flush()
    return out.leaves

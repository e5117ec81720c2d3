"""From HTML to a tree of structural elements with numbered text blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<start2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Levels of nesting that are told apart. Deeper elements are open until their own ends, but their content counts to the
#: last level, except that noise, headers, articles and main parts that begin there stay elements of their own.
DEPTH = 150

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output picture q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An open element of the second kind ends when an element of the first kind starts.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "thead": {"tr", "td", "th", "p"}, "body": {"head"},
    "tbody": {"thead", "tr", "td", "th", "p"}, "tfoot": {"tbody", "tr", "td", "th", "p"},
}
#: A bit for each tag that an implied end can reach.
ENDABLE = {tag: 1 << i for i, tag in enumerate(sorted({"p"}.union(*CLOSES.values())))}
#: Implied ends don't reach past these.
FENCES = frozenset("ul ol dl table div article section main aside body html nav header footer form select".split())

#: Elements that never hold article text.
NOISE_TAGS = frozenset(
    "head script style nav footer aside form button select option textarea input iframe object embed noscript template "
    "svg canvas audio video dialog menu title xmp noembed noframes datalist".split()
)
NOISE_ROLES = frozenset(
    "navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar tablist status".split()
)
#: Words in class or id names that mark what is not the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion "
    "breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond cookie cookies consent gdpr "
    "notice notices alert alerts popup modal overlay toolbar nav navbar navigation menu menus sidebar sidebars "
    "footer footers masthead topbar login signin search pagination pager skip skiplink skiplinks outbrain taboola copyright disclaimer".split()
)
#: Words that are a hint only: the wrapper's counts decide.
HINT_WORDS = frozenset(
    "banner banners widget widgets related recommended recommendations share sharing social subscribe subscription newsletter signup".split()
)
#: Words that mark a page's header unless it stands inside the article.
HEADER_WORDS = frozenset("header head".split())


def _plain(name: str) -> str:
    return re.sub(r"\d+", "0", name.lower())


class Element:
    """A structural element: its key, what it is, and its children (elements and block numbers)."""

    __slots__ = ("children", "depth", "endable", "key", "marks", "noise", "parent", "root", "tag")

    def __init__(self, tag: str, key: str, noise: str, root: int, parent: Element | None):
        self.tag, self.key, self.noise, self.root, self.parent = tag, key, noise, root, parent
        self.children: list[Element | int] = []
        self.depth = 0 if parent is None else parent.depth + 1
        #: What it and the elements around it are marked as.
        self.marks = (0 if parent is None else parent.marks) | _MARKS[noise] | root << 3
        #: Tags, from here up to a fence, that an implied end can reach.
        self.endable = 0 if parent is None or tag in FENCES else parent.endable | ENDABLE.get(tag, 0)


_MARKS = {"": 0, "noise": 1, "header": 2, "hint": 4}


_kinds: dict[tuple[str, str], tuple[str, str, int]] = {}


def describe(tag: str, attrs: str) -> tuple[str, str, int]:
    """(key, noise, root): noise is '', 'noise', 'hint' or 'header'; root is 2 for an article, 1 for a main part."""
    known = _kinds.get((tag, attrs))
    if known is None:
        values = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
        names = values.get("class", "").split() + values.get("id", "").split()
        words = {w.lower() for n in names for w in _SPLIT.findall(n)} | {n.lower() for n in names}
        role = values.get("role", "").lower()
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
        root = 0
        if tag == "article" or role == "article" or values.get("itemprop", "").lower() == "articlebody":
            root = 2
        elif tag == "main" or role == "main":
            root = 1
        noise = "noise" if tag in NOISE_TAGS or role in NOISE_ROLES or hidden or (words & NOISE_WORDS and tag not in ("html", "body")) else ""
        if not noise and (tag == "header" or (words & HEADER_WORDS and tag not in ("html", "body"))):
            noise = "header"
        if not noise and words & HINT_WORDS and tag not in ("html", "body"):
            noise = "hint"
        key = ".".join([tag, *sorted({_plain(n) for n in names})]) + ("!" if noise else "") + ("^" * root)
        known = key, noise, root
        if len(_kinds) > 50_000:
            _kinds.clear()
        _kinds[tag, attrs] = known
    return known


class Page:
    """The element tree of a page, and its blocks: text (characters of links apart) in page order."""

    def __init__(self, source: str):
        self.root = Element("#page", "#page", "", 0, None)
        self.blocks: list[str] = []
        self.links: list[int] = []
        self._pieces: list[str] = []
        self._link_chars = 0
        self._at = self.root
        self._open: Counter[str] = Counter()
        self._in_link = False
        self._dropped: str | None = None  # an inline element that is noise
        for kind, name, value in _tokens(source):
            if kind == "text":
                self._text(value)
            elif kind == "start":
                self._start(name, value)
            else:
                self._end(name)
        self._close_block()

    def _text(self, raw: str) -> None:
        if self._dropped is None:
            text = html.unescape(raw)
            self._pieces.append(text)
            if self._in_link:
                self._link_chars += len(text.strip())

    def _close_block(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                self._at.children.append(len(self.blocks))
                self.blocks.append(text)
                self.links.append(min(self._link_chars, len(text)))
            self._pieces, self._link_chars = [], 0
        self._dropped = None

    def _start(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                if tag == "br" and self._dropped is None:
                    self._pieces.append(" ")
                return
            if tag == "a":
                self._in_link = True
            if self._dropped is None and attrs and describe(tag, attrs)[1] in ("noise", "hint"):
                self._dropped = tag
            return
        self._close_block()
        self._in_link = False
        ends = CLOSES.get(tag) or {"p"}
        reach = sum(ENDABLE[e] for e in ends)
        node = self._at
        while node.parent is not None and node.endable & reach:
            if node.tag in ends:
                self._leave(node)
            node = node.parent
        key, noise, root = describe(tag, attrs)
        element = Element(tag, key, noise, root, self._at)
        if element.depth <= DEPTH or element.marks != self._at.marks:
            self._at.children.append(element)
        else:
            element.children = self._at.children
        if tag not in VOID:
            self._at = element
            self._open[tag] += 1

    def _leave(self, node: Element) -> None:
        """Close what is open up to and with ``node``."""
        while self._at is not node.parent:
            self._open[self._at.tag] -= 1
            self._at = self._at.parent

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._in_link = False
            if tag == self._dropped:
                self._dropped = None
            return
        if not self._open[tag]:
            return
        node = self._at
        while node.tag != tag:
            node = node.parent
        self._close_block()
        self._in_link = False
        self._leave(node)


def _tokens(source: str) -> Iterator[tuple[str, str, str]]:
    at, n = 0, len(source)
    while at < n:
        hit = _TOKEN.search(source, at)
        if hit is None:
            yield "text", "", source[at:]
            return
        if hit.start() > at:
            yield "text", "", source[at : hit.start()]
        at = hit.end()
        if hit["end"]:
            yield "end", hit["end"].lower(), ""
            continue
        name, attrs = (hit["start"], hit["attrs"]) if hit["start"] else (hit["start2"], hit["attrs2"])
        if not name:
            if hit[0].startswith("<![CDATA["):
                yield "text", "", html.escape(hit[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        yield "start", name, attrs or ""
        if name in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
            at = end.end() if end else n
            yield "end", name, ""
        elif attrs and attrs.endswith("/") and name not in VOID and name in ("svg", "path", "use"):
            yield "end", name, ""

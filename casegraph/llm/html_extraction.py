"""HTML extraction with wrappers inferred as union-free regular expressions.

1. A page's token stream (balanced start and end tags, text) is read as a tree
   of structural elements and text blocks. Neighbouring repeats fold into
   repeated groups, of one to three elements a period; what is left is the
   page's own expression: elements, repeated groups ``( )+``, text slots.
2. Expressions of one host are aligned one after the other (longest common
   subsequence of element keys, level by level, by bit-parallel rows: pages of
   tens of thousands of blocks take seconds and megabytes). Equal elements are merged,
   elements that one side lacks become optional ``( )?``, differing text
   becomes a slot. The result has no unions: it is the host's wrapper. Slots
   carry counts: pages, characters, characters in links, and their text while
   it is the same on all pages.
   Equal expressions are counted once per task before any shuffle; a host's
   expressions are merged as they stream past, at most ``FAN`` of them by one
   task, and the merged ones again until one is left, so a host with a third of
   all pages is spread over tasks and no task ever holds its pages.
3. Slots are labelled on the wrapper, with all the host's pages behind the
   counts: the article element (else the main one, else the element that holds
   most of the text outside links and outside what is marked as noise), without
   noise. What a class name only hints at (a "widget", "related" things) is noise
   by the counts: unless it holds most of the text around it, or is prose (long,
   hardly a link). Where no element is marked as the article, link lists and
   texts that are the same on every page of the host are template and go, too.
4. Every page is aligned with its host's wrapper, and the blocks in slots
   labelled as content are its text. If a page has none there, its own
   expression is used as a wrapper of one page.

Wrappers are broadcast if their measured size is at most ``BROADCAST_BYTES``;
otherwise pages and wrappers meet in a salted shuffle. Both give the same rows.

Blocks are the texts between structural tags; ``br`` is white space inside a
block. Headings inside an article's own ``header`` belong to the article.

Results for odd input: null or empty html gives an empty text; html without
markup is one block; broken markup is read as far as it goes and never raises;
pages of any length are read whole; of two alignments of equal length the same
one is taken each time; elements nested below ``html_tree.DEPTH`` levels are
judged with what is around them unless they are marked;
a page whose url is null or has no host is its own wrapper; repeated rows and
null ids are extracted each; an empty table gives an empty result; other
columns pass through, and one named like an output column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm.common import broadcast_if_small, fresh, text_of, worker_memory
from casegraph.llm.html_tree import Element, Page
from casegraph.scratch import materialize

#: Wrappers are broadcast up to this many characters together.
BROADCAST_BYTES = 64_000_000
SALTS = 16
#: Expressions of a host that one task merges.
FAN = 1_000
#: Share of the text around it, and characters a page with hardly a link, by which an element with a hint of noise is none.
MOST, PROSE = 0.6, 400
#: Longest period, in elements, of a repeated group.
PERIOD = 3
TEXT = "#"
#: Distinct expressions that a task counts before it passes them on.
COUNTED = 2_000
#: Texts of slots up to this length are kept as they are, longer ones as hashes.
TEXT_CHARS = 200


class Item:
    """One position of an expression: an element, a repeated group "( )", or a text slot."""

    __slots__ = ("blocks", "chars", "content", "key", "kids", "linked", "many", "noise", "optional", "pages", "root", "text")

    def __init__(self, key: str, noise: str = "", root: int = 0):
        self.key, self.noise, self.root = key, noise, root
        self.kids: list[Item] = []
        self.many = self.optional = self.content = False
        self.pages, self.chars, self.linked = 1, 0, 0
        self.text: str | None = None
        self.blocks: list[int] = []

    def pack(self) -> list[Any]:
        flags = self.many + 2 * self.optional + 4 * self.content
        counts = [self.pages, self.chars, self.linked, self.text]
        return [self.key, self.noise, self.root, flags, counts, [k.pack() for k in self.kids]]

    @staticmethod
    def unpack(packed: list[Any]) -> Item:
        item = Item(packed[0], packed[1], packed[2])
        item.many, item.optional, item.content = bool(packed[3] & 1), bool(packed[3] & 2), bool(packed[3] & 4)
        item.pages, item.chars, item.linked, item.text = packed[4]
        item.kids = [Item.unpack(k) for k in packed[5]]
        return item

    def walk(self) -> Iterator[Item]:
        yield self
        for kid in self.kids:
            yield from kid.walk()

    def expression(self) -> str:
        """The union-free regular expression, for people."""
        body = " ".join(k.expression() for k in self.kids)
        if self.key == TEXT:
            out = "#" if self.text is None else json.dumps(self.text)
        elif self.key.startswith("("):
            out = f"( {body} )"
        else:
            out = f"<{self.key}> {body} </>" if body else f"<{self.key}/>"
        return out if not (self.many or self.optional) else f"({out}){'*' if self.many and self.optional else '+' if self.many else '?'}"


def _merge_into(a: Item, b: Item, same_page: bool) -> None:
    """Merge ``b``, an item with the same key, into ``a``."""
    a.many |= b.many
    a.optional |= b.optional
    a.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    a.chars += b.chars
    a.linked += b.linked
    a.blocks += b.blocks
    if a.text != b.text:
        a.text = None
    a.kids = align(a.kids, b.kids, same_page)


def common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as places in both.

    Equal ends are cut off. For the rest each row of the usual table is one number with a bit for each place of ``right``
    (0 where the row's length grows), which a few whole-number operations turn into the next row. Every so many rows are
    kept, and the rows between are computed again on the way back.
    """
    n, m, start = len(left), len(right), 0
    while start < n and start < m and left[start] == right[start]:
        start += 1
    while n > start and m > start and left[n - 1] == right[m - 1]:
        n, m = n - 1, m - 1
    head = [(i, i) for i in range(start)]
    tail = [(n + i, m + i) for i in range(len(left) - n)]
    rows, columns = left[start:n], right[start:m]
    if not rows or not columns:
        return head + tail
    places: dict[str, list[int]] = {}
    for j, key in enumerate(columns):
        places.setdefault(key, []).append(j)
    wanted, whole = set(rows), (1 << len(columns)) - 1
    masks = {k: sum(1 << j for j in p) for k, p in places.items() if k in wanted and len(p) > 3}

    def following(row: int, key: str) -> int:
        mask = masks.get(key)
        if mask is None:
            mask = sum(1 << j for j in places.get(key, ()))
        grown = row & mask
        return ((row + grown) | (row - grown)) & whole

    stride = math.isqrt(len(rows)) + 1
    row, kept = whole, []
    for i, key in enumerate(rows):
        if i % stride == 0:
            kept.append(row)
        row = following(row, key)
    block, first = [], len(rows)

    def flat(i: int, j: int) -> int:
        """Whether the length stays the same at place ``j`` of row ``i``."""
        nonlocal block, first
        if not first <= i < first + len(block):
            first = i // stride * stride
            block, at = [], kept[i // stride]
            for key in rows[first : first + stride]:
                at = following(at, key)
                block.append(at)
        return block[i - first] >> j & 1

    found, i, j = [], len(rows), len(columns)
    while i and j:
        if flat(i - 1, j - 1):
            j -= 1
            continue
        i -= 1
        if i and not flat(i - 1, j - 1):
            continue
        j -= 1
        found.append((start + i, start + j))
    return head + found[::-1] + tail


def align(left: list[Item], right: list[Item], same_page: bool = False) -> list[Item]:
    """One expression for both: equal keys merge, all else becomes optional."""
    out, i, j = [], 0, 0
    for a, b in [*common([x.key for x in left], [x.key for x in right]), (len(left), len(right))]:
        for alone in [*left[i:a], *right[j:b]]:
            alone.optional = True
            out.append(alone)
        if a < len(left):
            _merge_into(left[a], right[b], same_page)
            out.append(left[a])
        i, j = a + 1, b + 1
    return out


def fold(items: list[Item]) -> list[Item]:
    """Neighbouring repeats become repeated groups, shortest period first."""
    for period in range(1, PERIOD + 1):
        out: list[Item] = []
        i = 0
        while i < len(items):
            keys = [x.key for x in items[i : i + period]]
            times = 1
            while len(keys) == period and [x.key for x in items[i + times * period : i + (times + 1) * period]] == keys:
                times += 1
            if times == 1 or (period > 1 and len(set(keys)) == 1):
                out.append(items[i])
                i += 1
                continue
            group = items[i : i + period]
            for k in range(1, times):
                for a, b in zip(group, items[i + k * period : i + (k + 1) * period], strict=True):
                    _merge_into(a, b, True)
            if period == 1:
                group[0].many = True
                out.append(group[0])
            else:
                whole = Item("(" + " ".join(keys) + ")")
                whole.kids, whole.many = group, True
                out.append(whole)
            i += times * period
        items = out
    return items


def page_expression(page: Page) -> Item:
    """The page's own expression; items know the numbers of their blocks."""

    def build(element: Element) -> Item:
        item = Item(element.key, element.noise, element.root)
        kids = []
        for child in element.children:
            if isinstance(child, int):
                slot = Item(TEXT)
                slot.text, slot.chars, slot.linked, slot.blocks = page.blocks[child], len(page.blocks[child]), page.links[child], [child]
                kids.append(slot)
            else:
                kids.append(build(child))
        item.kids = fold(kids)
        return item

    return build(page.root)


def _mass(item: Item, inside: bool = False) -> int:
    """Characters outside links and outside noise."""
    if item.noise == "noise" or (item.noise == "header" and not inside):
        return 0
    if item.key == TEXT:
        return item.chars - item.linked
    return sum(_mass(k, inside or item.root > 0) for k in item.kids)


def _judge_hints(wrapper: Item) -> None:
    """Elements that are noise by a hint become noise or none, by what the host's pages hold there."""
    sizes: dict[int, tuple[int, int]] = {}

    def measure(item: Item) -> tuple[int, int]:
        chars, linked = (item.chars, item.linked) if item.key == TEXT else (0, 0)
        for kid in item.kids:
            if (kid_size := measure(kid)) and kid.noise != "noise":
                chars, linked = chars + kid_size[0], linked + kid_size[1]
        sizes[id(item)] = chars, linked
        return chars, linked

    def judge(item: Item, around: int) -> None:
        chars, linked = sizes[id(item)]
        if item.root:
            around = chars - linked
        if item.noise == "hint":
            prose = chars >= PROSE * item.pages and linked * 10 < chars
            item.noise = "" if prose or (chars - linked) >= MOST * max(around, 1) else "noise"
        for kid in item.kids:
            judge(kid, around)

    measure(wrapper)
    judge(wrapper, sizes[id(wrapper)][0] - sizes[id(wrapper)][1])


def label(wrapper: Item) -> Item:
    """Mark the slots that hold the article (module docstring, 3)."""
    for item in wrapper.walk():
        item.content = False
    _judge_hints(wrapper)
    whole = _mass(wrapper)

    def roots(item: Item, rank: int) -> Iterator[Item]:
        if item.noise == "noise":
            return
        if item.root == rank:
            yield item
            return
        for kid in item.kids:
            yield from roots(kid, rank)

    for rank in (2, 1):
        found = list(roots(wrapper, rank))
        if found and sum(_mass(f, True) for f in found) * 5 >= whole:
            for root in found:
                _mark(root, True, None)
            return wrapper
    root = wrapper
    while True:
        # A repeated element or one that holds text only is a paragraph of the article, not its frame.
        frames = [k for k in root.kids if not k.many and any(x.key != TEXT for x in k.kids)]
        heavy = [k for k in frames if _mass(k) * 10 >= 6 * _mass(root) > 0]
        if not heavy:
            break
        root = heavy[0]
    varied = any(s.key == TEXT and s.text is None and not s.noise for s in root.walk())
    _mark(root, False, wrapper.pages if varied and wrapper.pages >= 3 else None)
    return wrapper


def _mark(item: Item, marked: bool, template_pages: int | None) -> None:
    """Slots below ``item`` are content unless noise; without a marked article, template goes as well."""
    if item.noise == "noise" or (item.noise == "header" and not marked):
        return
    if item.key == TEXT:
        menu = not marked and item.linked * 10 > 6 * item.chars
        fixed = template_pages is not None and item.text is not None and item.pages == template_pages
        item.content = not menu and not fixed
    for kid in item.kids:
        _mark(kid, marked, template_pages)


def _content_blocks(page: list[Item], wrapper: list[Item]) -> Iterator[int]:
    """Numbers of the page's blocks that lie in content slots of the wrapper."""
    for i, j in common([x.key for x in page], [x.key for x in wrapper]):
        if wrapper[j].content:
            yield from page[i].blocks
        yield from _content_blocks(page[i].kids, wrapper[j].kids)


def _same_shape(page: Item, wrapper: Item) -> Iterator[tuple[Item, Item]]:
    yield page, wrapper
    for a, b in zip(page.kids, wrapper.kids, strict=True):
        yield from _same_shape(a, b)


def extract(source: str, wrapper: Item | None) -> str:
    """The main text of a page, by its host's wrapper."""
    page = Page(source)
    if not page.blocks:
        return ""
    own = page_expression(page)
    found = sorted(set(_content_blocks([own], [wrapper]))) if wrapper is not None else []
    if not found:
        found = sorted(set(_content_blocks([own], [label(own)])))
    return "\n".join(page.blocks[i] for i in found)


def merge_wrappers(packed: Iterable[str], merged: Item | None = None) -> Item | None:
    for one in packed:
        item = Item.unpack(json.loads(one))
        if merged is None:
            merged = item
        else:
            _merge_into(merged, item, False)
            merged.kids = _refold(merged.kids)
    return merged


def _refold(items: list[Item]) -> list[Item]:
    """Repeats that an alignment has put side by side, as elements optional on one side each."""
    out: list[Item] = []
    for item in items:
        if out and out[-1].key == item.key and (out[-1].optional or item.optional):
            optional = out[-1].optional and item.optional
            _merge_into(out[-1], item, False)
            out[-1].many, out[-1].optional = True, optional
        else:
            out.append(item)
    return out


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    return F.when(host != "", host)


def _shape_key(item: Item) -> str:
    return f"{item.key}{'+' if item.many else ''}[{' '.join(map(_shape_key, item.kids))}]"


def _short(text: str | None) -> str | None:
    """The text, or a hash of a long one: wrappers ask only whether texts are equal."""
    if text is None or len(text) <= TEXT_CHARS:
        return text
    return "\x00" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): one labelled wrapper per host, as JSON of ``Item.pack``."""
    source = pages.select(host_of(F.col(url_col)).alias("host"), text_of(html_col).alias("html")).filter("host is not null and html <> ''")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[tuple[str, str], Item] = {}

        def flush() -> pa.RecordBatch:
            hosts, shapes, packed = [], [], []
            for (host, shape), item in counted.items():
                hosts.append(host)
                shapes.append(shape)
                packed.append(json.dumps(item.pack(), ensure_ascii=False, separators=(",", ":")))
            counted.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (hosts, shapes, packed)], names=["host", "shape", "wrapper"])

        for batch in batches:
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                own = page_expression(Page(source))
                for item in own.walk():
                    item.blocks = []
                    item.text = _short(item.text)
                key = host, _shape_key(own)
                if key in counted:
                    for a, b in _same_shape(counted[key], own):
                        a.pages += b.pages
                        a.chars += b.chars
                        a.linked += b.linked
                        if a.text != b.text:
                            a.text = None
                else:
                    counted[key] = own
                if len(counted) >= COUNTED:
                    yield flush()
        if counted:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
        host, merged = None, None

        def row() -> pa.RecordBatch:
            if final:
                label(merged)
                for item in merged.walk():
                    item.text = None  # labels are set; texts aren't needed any more
            packed = json.dumps(merged.pack(), ensure_ascii=False, separators=(",", ":"))
            return pa.RecordBatch.from_pydict({"host": [host[0]], "wrapper": [packed]})

        for batch in batches:
            for *key, packed in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper")), strict=True):
                if key != host and merged is not None:
                    yield row()
                    merged = None
                host, merged = key, merge_wrappers([packed], merged)
        if merged is not None:
            yield row()

    found = materialize(source.mapInArrow(read, "host string, shape string, wrapper string").select("host", "wrapper"), "html-expressions")
    while True:
        counts = materialize(found.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAN)).cast("int").alias("salts")), "html-hosts")
        final = (counts.agg(F.max("salts")).first()[0] or 1) == 1
        salted = found.withColumn("salt", F.lit(0))
        if not final:
            salted = found.join(broadcast_if_small(counts), "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.col("salts")).cast("int"))
        parts = salted.select("host", "salt", "wrapper").repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
        following = parts.mapInArrow(lambda b, last=final: merge(b, last), "host string, wrapper string")
        if final:
            return following
        found = materialize(following, "html-expressions")


def extract_main_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``pages`` with the main text of each page in ``text_col`` (module docstring: method, odd input)."""
    wrappers = materialize(infer_wrappers(pages, url_col, html_col), "html-wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    kept = [c for c in pages.columns if c.lower() != text_col.lower()]
    host, source, wrapper, salt = fresh(pages, "host", "source", "wrapper", "salt")
    rows = pages.select(*[pages[c] for c in kept], host_of(pages[url_col]).alias(host), text_of(pages[html_col]).alias(source))
    found = wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper))
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(found), host, "left")
    else:
        spread = found.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        dealt = rows.withColumn(salt, F.pmod(F.xxhash64(source), F.lit(SALTS)).cast("int"))
        joined = dealt.join(spread, [host, salt], "left")
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(text_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Item] = worker_memory("html")
        for batch in batches:
            texts = []
            for page, packed in zip(batch.column(source).to_pylist(), batch.column(wrapper).to_pylist(), strict=True):
                if packed is not None and packed not in known:
                    if len(known) > 500:
                        known.clear()
                    known[packed] = Item.unpack(json.loads(packed))
                texts.append(extract(page, known.get(packed)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, text_col])

    return joined.select(*kept, source, wrapper).mapInArrow(run, schema)

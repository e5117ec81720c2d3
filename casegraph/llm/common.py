"""Small helpers that the operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a regular expression class.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The column as text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"_{name}"
        while candidate.lower() in taken:
            candidate = "_" + candidate
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where a lambda inside ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_text(column: Column) -> Column:
    """An id as a join key that is never null; ``version`` keeps null and empty ids apart."""
    return F.coalesce(column.cast("string"), F.lit(""))


def version(id_col: str, text_col: str) -> Column:
    """A hash that tells apart rows with one id and different texts."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(text_col))


#: A table of at most so many narrow rows (keys, counts) may be broadcast.
BROADCAST_ROWS = 400_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it has at most ``rows`` rows, else as it is.

    ``df`` should be a written table with narrow rows: it is counted first.
    """
    return F.broadcast(df) if df.count() <= rows else df


class Remembered(dict):
    """key (a text) -> value, computed on first use.

    Bounded by entries and by characters, over two generations: when half of either bound is full, the entries become
    the old ones and the old ones before them are forgotten; an old entry that is used again is kept. A key of more than
    ``LONG_KEY`` characters is computed each time.
    """

    LONG_KEY = 200

    def __init__(self, compute: Callable, limit: int = 200_000, chars: int = 8_000_000):
        super().__init__()
        self.compute, self.limit, self.chars, self.held, self.old = compute, limit // 2, chars // 2, 0, {}

    def __missing__(self, key):
        size = len(key)
        if size > self.LONG_KEY:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit or self.held + size > self.chars:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self[key] = value
        return value


_held: dict[str, dict] = {}


def worker_memory(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks.

    A worker runs one task at a time, and workers are used again by later stages: asking for one
    operator's memory drops all others'.
    """
    if owner not in _held:
        _held.clear()
        gc.collect()
        _held[owner] = {}
    return _held[owner]

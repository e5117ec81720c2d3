"""Connected components by randomised contraction, and work on groups that arrive as sorted runs.

``connected_components`` maps every node to the neighbour (or itself) with the
least hash in this round's random order, relabels the edges with it, and goes
on with what is left; the number of nodes falls geometrically. Each round is a
grouped minimum with map-side combining and two equi-joins, so a hub with a
third of all edges is combined or split, never gathered. Once at most
``LOCAL_EDGES`` edges are left, one task joins them: that bound is checked, and
holds whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.scratch import materialize, release

#: Edges that one task may join at the end.
LOCAL_EDGES = 200_000


class UnionFind:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        """The smaller index becomes the root."""
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def _join_local(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict = {}
        pairs = []
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                pairs.append((place.setdefault(a, len(place)), place.setdefault(b, len(place))))
        if not place:
            return
        groups = UnionFind(len(place))
        for i, j in pairs:
            groups.union(i, j)
        nodes = list(place)
        roots = [nodes[groups.find(i)] for i in range(len(nodes))]
        kind = batch.schema.field("a").type
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(roots, kind)], names=["node", "component"])

    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
    return edges.repartition(1).mapInArrow(run, schema)


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES, written: bool = False) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: one type, not null).

    ``component`` is some node of the component, the same for all its nodes. Self-edges are allowed.
    ``written``: the edges are columns of a written table already and needn't be written again.
    """
    current = edges if written else materialize(edges.select("a", "b").distinct(), "edges")
    parents: list[DataFrame] = []
    while current.count() > local_edges:
        order = len(parents)
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = both.select("a", F.struct(F.xxhash64(F.lit(order), "b").alias("r"), F.col("b").alias("p")).alias("c"))
        itself = both.select("a", F.struct(F.xxhash64(F.lit(order), "a").alias("r"), F.col("a").alias("p")).alias("c"))
        best = ranked.union(itself).groupBy("a").agg(F.min("c").alias("c"))
        parent = materialize(best.select(F.col("a").alias("node"), F.col("c.p").alias("parent")), "parents")
        parents.append(parent)
        left = current.join(parent.withColumnRenamed("node", "a"), "a").select(F.col("parent").alias("x"), "b")
        moved = left.join(parent.withColumnRenamed("node", "b"), "b").select(F.col("x").alias("a"), F.col("parent").alias("b"))
        following = materialize(moved.filter("a <> b").distinct(), "edges")
        release(current)
        current = following
    found = materialize(_join_local(current), "components")
    release(current)
    for parent in reversed(parents):
        labels = found.withColumnsRenamed({"node": "parent"})
        joined = parent.join(labels, "parent", "left")
        following = materialize(joined.select("node", F.coalesce("component", "parent").alias("component")), "components")
        release(found)
        release(parent)
        found = following
    return found


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that are equal in ``keys``, from batches sorted by them, one table per group."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        rows = list(zip(*columns, strict=True))
        for i, row in enumerate(rows):
            if row != last:
                if i > start:
                    waiting.append(batch.slice(start, i - start))
                if waiting:
                    yield pa.Table.from_batches(waiting)
                waiting, start, last = [], i, row
        waiting.append(batch.slice(start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def block_pairs(members: DataFrame, blocks: str, node: str) -> DataFrame:
    """Deal the members of large groups to pairs of blocks.

    ``members`` has the number of blocks of a row's group in ``blocks``. A row gets a block by hash
    and is copied to each pair (i <= j) with that block: columns ``i``, ``j`` and ``block``.
    """
    own = F.pmod(F.xxhash64(F.lit("block"), F.col(node)), F.col(blocks)).cast("int")
    dealt = members.withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    dealt = dealt.withColumn("other", other)
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def component_roots(hits: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    roots = np.full(len(hits), -1)
    for first in range(len(hits)):
        if roots[first] >= 0:
            continue
        front = np.array([first])
        while len(front):
            roots[front] = first
            front = np.flatnonzero(hits[front].any(axis=0) & (roots < 0))
    return roots


def linked_counts(
    tables: Iterator[pa.Table], linked: Callable[[pa.Table], np.ndarray], node: str, weight: str, kind: pa.DataType
) -> Iterator[pa.RecordBatch]:
    """(node, links, root) for each member of a unit (one run) that is linked with another.

    ``linked`` gives a symmetric boolean matrix for the unit's rows. Pairs inside a block count only
    in the unit (i, i). ``links`` sums the weights of the linked members, ``root`` is a member of
    the same component inside the unit.
    """
    for table in tables:
        n = table.num_rows
        if n < 2:
            continue
        if table.column("i")[0] != table.column("j")[0]:
            side = np.asarray(table.column("block"))
            apart = side[:, None] != side[None, :]
        else:
            apart = ~np.eye(n, dtype=bool)
        hits = linked(table) & apart
        links = hits @ np.asarray(table.column(weight), dtype=np.float64)
        roots = component_roots(hits)
        some = np.flatnonzero(hits.any(axis=1))
        if len(some) == 0:
            continue
        nodes = table.column(node).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([nodes[k] for k in some], kind),
                pa.array(np.rint(links[some]).astype(np.int64), pa.int64()),
                pa.array([nodes[roots[k]] for k in some], kind),
            ],
            names=["node", "links", "root"],
        )

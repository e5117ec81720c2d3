"""Embedding near-dedup by sorted projection passes.

1. Vectors become unit vectors in double precision. Equal vectors with equal
   labels are one class, so copies cost nothing later.
2. A pass hashes a class by the signs of random projections, concatenated into
   one 64-bit key, and sorts classes by (label, key) with a range shuffle.
   Neighbours within a bounded window are compared; a task streams through its
   rows and keeps the last ``WINDOW`` of a label only. Rows at a task's ends meet
   those of the tasks around it in a small second step.
   What is sorted is narrow whatever the vectors' length: a class carries a
   sketch of ``SKETCH`` sign bits and the greatest number of bits in which a
   partner at the threshold differs from it (``reach_of``; a partner differs in
   more with probability below 4e-6), and neighbours within that are candidates.
   Vectors themselves are shuffled for candidates only, to be verified.
3. Components over all passes' candidates are the candidate groups, and every
   pair inside one is verified in blocks by its exact cosine (matrix products);
   the pairs that hold are united. The number of links is exact there, however
   large the group: a window bounds what a pass compares, not what is counted.
4. Vectors of one label often share a direction; signs are taken of what is left
   after subtracting the label's mean, so that keys cut dense labels too.
   The number of passes of a label is measured, not assumed: probes (sampled
   vectors, each with a partner exactly at the threshold in a random direction)
   get keys, the label's vectors between the two are counted over the whole
   table, and passes are added until the estimated share of probes missed by
   all passes is at most ``MISS``. The sample decides on passes only.
5. A label is compared exactly, every pair in blocks, if it is so small that the
   blocks copy no more rows than the least number of passes, or so dense that
   they copy no more rows than the passes it would need.

Ties: rows with equal keys are ordered by their class, so reruns agree; a cosine
of exactly the threshold is a link.

Results for odd input: a vector that is null, empty, zero, or holds a null or
non-finite component is linked with nothing, and so is one whose label is null;
such a vector is a component of its own and kept. Vectors of different lengths
are linked with nothing of another length. Repeated rows are linked with each
other; ids that repeat count as rows of their own. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import broadcast_if_small
from casegraph.llm.components import UnionFind, block_pairs, connected_components, linked_counts, runs
from casegraph.scratch import materialize

THRESHOLD = 0.98
WINDOW = 32
MISS = 1e-3
BITS = 64
#: Bits of the sketch that a pass carries, and how many standard deviations a partner's differing bits may lie above their mean.
SKETCH, SPREAD = 512, 4.5
SEED = 20
BLOCK_ROWS = 512
LEAST_PASSES = 4
#: Probes of a label, about, and of all labels together; labels with fewer than ``OWN_PROBES`` share an estimate by size.
PROBES, ALL_PROBES, OWN_PROBES = 512, 16_384, 256
#: A table of label means of at most so many rows may be broadcast.
CENTRES = 20_000


def passes_for(vectors: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes needed so that a pair at the threshold is missed by all of them with probability ``miss`` at most.

    This holds where every bit halves the vectors; ``measured_passes`` starts from it and measures the rest.
    """
    cut_bits = max(1, math.ceil(math.log2(max(2, vectors) / window)))
    found = (1 - math.acos(threshold) / math.pi) ** cut_bits
    return max(4, math.ceil(math.log(miss) / math.log1p(-found))) if found < 1 else 4


def usable(vector: Column) -> Column:
    """Whether a vector can have a direction: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0.0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column that all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def projections(dims: int, turn: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, turn, dims]).standard_normal((dims, BITS))


def sort_keys(unit: np.ndarray, turn: int, seed: int = SEED) -> np.ndarray:
    """Concatenated sign bits, most significant first, as an order-preserving signed integer."""
    bits = (unit @ projections(unit.shape[1], turn, seed) >= 0).astype(np.uint8)
    keys = np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return (keys ^ np.uint64(1 << 63)).view(np.int64)


def _centres(classes: DataFrame) -> DataFrame:
    """(grp, centre): the mean of each group's unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, place = np.unique(np.asarray(batch.column("grp")).astype(str), return_inverse=True)
            sizes = np.asarray(batch.column("dims"))
            for dims in np.unique(sizes):
                mine = sizes == dims
                unit, at = _unit(_matrix(batch.filter(pa.array(mine)).column("vector"))), place[mine]
                order = np.argsort(at, kind="stable")
                some, starts = np.unique(at[order], return_index=True)
                sums = np.add.reduceat(unit[order], starts, axis=0)
                counts = np.diff(np.append(starts, len(at)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[some].tolist(), pa.string()), pa.array(counts, pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))], names=["grp", "n", "sums"]
                )

    parts = classes.select("grp", "dims", "vector").mapInArrow(run, "grp string, n long, sums array<double>")
    cells = parts.select("grp", "n", F.posexplode("sums").alias("pos", "x")).groupBy("grp", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return cells.groupBy("grp").agg(F.transform(listed, lambda c: c["x"]).alias("centre"))


def _partners(unit: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """For each unit vector another one exactly at the threshold, in a random direction."""
    away = np.random.default_rng([seed, len(unit)]).standard_normal(unit.shape)
    away -= (away * unit).sum(axis=1, keepdims=True) * unit
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    away = np.where(length > 1e-9, away / np.maximum(length, 1e-9), 0.0)
    return threshold * unit + math.sqrt(max(0.0, 1 - threshold * threshold)) * away


def _between(rows: DataFrame, probes: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], turns: range, seed: int) -> DataFrame:
    """(grp, probe, turn, n): how many vectors of the group lie between the keys of a probe and its partner, both ends counted.

    ``probes``: for each group the probes, their partners (both centred) and the probes' numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[str, list] = {}
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.asarray(batch.column("grp")).astype(str)
            for grp in np.unique(names):
                if grp not in probes:
                    continue
                one, other, _ = probes[grp]
                if grp not in ends:
                    both = [(sort_keys(one, t, seed), sort_keys(other, t, seed)) for t in turns]
                    ends[grp] = [(np.minimum(a, b), np.maximum(a, b)) for a, b in both]
                    counts[grp] = np.zeros((len(turns), len(one)), np.int64)
                part = batch.filter(pa.array(names == grp))
                rest = _unit(_matrix(part.column("vector"))) - _matrix(part.column("centre"))
                for k, turn in enumerate(turns):
                    keys, (low, high) = np.sort(sort_keys(rest, turn, seed)), ends[grp][k]
                    counts[grp][k] += np.searchsorted(keys, high, "right") - np.searchsorted(keys, low, "left")
        for grp, found in counts.items():
            for k, turn in enumerate(turns):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(probes[grp][2], pa.int32()), pa.array(np.full(found.shape[1], turn, np.int32)), pa.array(found[k])], names=["probe", "turn", "n"]
                )

    counted = rows.select("grp", "vector", "centre").mapInArrow(run, "probe int, turn int, n long")
    return counted.groupBy("probe", "turn").agg(F.sum("n").alias("n"))


def needed_passes(hits: np.ndarray, trials: int, miss: float = MISS) -> int | None:
    """The least number of passes, up to half the trials, by which the share of probes missed is ``miss`` at most.

    ``hits``: in how many trials each probe was found. The share missed by k passes is averaged over all choices of k trials.
    """
    missed = np.ones(len(hits))
    for k in range(trials // 2):
        missed *= np.maximum(trials - hits - k, 0) / (trials - k)
        if k + 1 >= LEAST_PASSES and missed.mean() <= miss:
            return k + 1
    return None


def measured_passes(rows: DataFrame, groups: dict[str, tuple[int, int]], window: int, threshold: float, seed: int = SEED) -> dict[str, int]:
    """Passes for each group that passes serve better than blocks; ``groups`` has the sizes and numbers of blocks.

    ``rows``: (grp, node, vector, centre, n).
    """
    if not groups:
        return {}
    each = min(PROBES, max(1, ALL_PROBES // len(groups)))
    picked = F.pmod(F.xxhash64(F.lit("probe"), "node"), F.ceil(F.col("n") / F.lit(each)).cast("long")) == 0
    table = rows.filter(picked).select("grp", "node", "vector", "centre").toArrow().sort_by([("grp", "ascending"), ("node", "ascending")])
    probes, cell_of, at = {}, {}, 0
    for part in runs(iter(table.to_batches()), ["grp"]):
        grp, unit, centre = part.column("grp")[0].as_py(), _unit(_matrix(part.column("vector"))), _matrix(part.column("centre"))
        probes[grp] = unit - centre, _partners(unit, threshold, seed) - centre, np.arange(at, at + len(unit), dtype=np.int32)
        at += len(unit)
    for grp, (n, _) in groups.items():
        cell_of[grp] = ("own", grp) if each >= OWN_PROBES else ("size", n.bit_length())
    hits = np.zeros(at, np.int64)
    turns: dict[str, int] = {}
    open_groups, done = dict(groups), 0
    trials = 2 * passes_for(max(n for n, _ in groups.values()), threshold, window)
    while open_groups:
        cells = {cell_of[g] for g in open_groups}
        asked = {g: p for g, p in probes.items() if cell_of[g] in cells}
        if not asked:
            break
        found = _between(rows, asked, range(done, trials), seed).filter(F.col("n") <= window)
        for r in found.groupBy("probe").count().collect():
            hits[r["probe"]] += r["count"]
        need = {}
        for cell in cells:
            numbers = [p[2] for g, p in asked.items() if cell_of[g] == cell]
            need[cell] = needed_passes(hits[np.concatenate(numbers)], trials) if numbers else None
        for grp, (_, blocks) in list(open_groups.items()):
            k = need[cell_of[grp]]
            if k is not None and k < blocks:
                turns[grp] = k
            if k is not None or trials // 2 >= blocks:
                del open_groups[grp]
        done, trials = trials, 2 * trials
    return turns


def sketch_of(rest: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Sign bits of further projections, as rows of 64-bit words."""
    turns = range(10**6, 10**6 + SKETCH // BITS)
    return np.stack([sort_keys(rest, t, seed).view(np.uint64) for t in turns], axis=1)


def reach_of(rest: np.ndarray, threshold: float) -> np.ndarray:
    """In how many sketch bits a vector at the threshold may differ.

    Unit vectors at the threshold are ``d`` apart, and so are they after the label's mean is taken from both: seen from
    the mean the angle between them has a sine of ``d / length`` at most. A bit differs with probability angle / pi.
    """
    length = np.sqrt((rest * rest).sum(axis=1))
    d = math.sqrt(max(0.0, 2 - 2 * threshold))
    share = np.where(length > d, np.arcsin(np.minimum(d / np.maximum(length, 1e-300), 1.0)) / math.pi, 1.0)
    return np.ceil(SKETCH * share + SPREAD * np.sqrt(SKETCH * share * (1 - share)) + 1).astype(np.int32)


def _keyed(classes: DataFrame, passes: int | dict[str, int], threshold: float, seed: int) -> DataFrame:
    """Every class once per pass of its group: (turn, grp, sortkey, node, sketch, reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("dims"))
            for dims in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dims))
                rest = _unit(_matrix(part.column("vector"))) - _matrix(part.column("centre"))
                own = np.array([passes if isinstance(passes, int) else passes.get(g, 0) for g in part.column("grp").to_pylist()])
                if not own.any():
                    continue
                sketches = pa.array([row.tobytes() for row in sketch_of(rest, seed)], pa.binary())
                reach = pa.array(reach_of(rest, threshold))
                for turn in range(own.max(initial=0)):
                    mine = pa.array(own > turn)
                    keys = sort_keys(rest[own > turn], turn, seed)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), turn, np.int32)), part.column("grp").filter(mine), pa.array(keys),
                            part.column("node").filter(mine), sketches.filter(mine), reach.filter(mine),
                        ],
                        names=["turn", "grp", "sortkey", "node", "sketch", "reach"],
                    )

    return classes.mapInArrow(run, "turn int, grp string, sortkey long, node binary, sketch binary, reach int")


def _window_pairs(sketches: np.ndarray, reach: np.ndarray, window: int, first_new: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) within the window that differ in no more bits than either allows, j at or after ``first_new``."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lag in range(1, min(window, len(sketches) - 1) + 1):
        start = max(0, first_new - lag)
        differ = np.bitwise_count(sketches[start:-lag] ^ sketches[start + lag :]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(differ <= np.minimum(reach[start:-lag], reach[start + lag :])) + start
        left.append(hit)
        right.append(hit + lag)
    return np.concatenate(left), np.concatenate(right)


_EDGE = "a binary, b binary, turn int, grp string, part int, place long, sketch binary, reach int"


def _swept(batches: Iterator[pa.RecordBatch], window: int, ends: bool) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) among neighbours of each (turn, grp) run, batch by batch; with ``ends`` also the run's first and last rows (b null)."""
    part, names = TaskContext.get().partitionId(), [f.split()[0] for f in _EDGE.split(", ")]
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]
    last, held, place, carried = None, None, 0, None

    def tail() -> Iterator[pa.RecordBatch]:
        if ends and last is not None:
            yield rows_of(last, carried, place - carried.num_rows)

    def rows_of(run: tuple, table: pa.Table, first: int) -> pa.RecordBatch:
        n = table.num_rows
        columns = [table.column("node"), pa.nulls(n, pa.binary()), [run[0]] * n, [run[1]] * n, [part] * n, range(first, first + n), table.column("sketch"), table.column("reach")]
        return pa.RecordBatch.from_arrays(
            [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
        )

    for table in _stretches(batches):
        run = table.column("turn")[0].as_py(), table.column("grp")[0].as_py()
        rows = table.select(["node", "sketch", "reach"])
        if run != last:
            yield from tail()
            last, place, carried = run, 0, rows.slice(0, 0)
        if ends and place < window:
            yield rows_of(run, rows.slice(0, window - place), place)
        held = pa.concat_tables([carried, rows])
        nodes = held.column("node").to_pylist()
        sketches = np.frombuffer(b"".join(held.column("sketch").to_pylist()), np.uint64).reshape(len(nodes), -1)
        left, right = _window_pairs(sketches, np.asarray(held.column("reach")), window, carried.num_rows)
        # A star to the first member of each linked stretch keeps the edges few and the paths short.
        groups = UnionFind(len(nodes))
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            groups.union(i, j)
        linked = [k for k in np.unique(np.concatenate([left, right])).tolist() if groups.find(k) != k]
        if linked:
            pairs = [pa.array([nodes[k] for k in linked], pa.binary()), pa.array([nodes[groups.find(k)] for k in linked], pa.binary())]
            yield pa.RecordBatch.from_arrays([*pairs, *(pa.nulls(len(linked), k) for k in kinds[2:])], names=names)
        place += rows.num_rows
        carried = held.slice(max(0, held.num_rows - window))
    yield from tail()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The parts of each batch that belong to one (turn, grp)."""
    for batch in batches:
        if batch.num_rows:
            yield from runs(iter([batch]), ["turn", "grp"])


def _sorted_pass(ordered: DataFrame, window: int) -> DataFrame:
    """Candidates inside each task (a, b), and each task's first and last rows of a run (b null) for the tasks around it."""
    return ordered.select("turn", "grp", "node", "sketch", "reach").mapInArrow(lambda b: _swept(b, window, True), _EDGE)


def _seams(ends: DataFrame, window: int) -> DataFrame:
    """Candidates among the rows at the tasks' ends, which are neighbours across tasks."""
    once = ends.select("turn", "grp", "part", "place", F.col("a").alias("node"), "sketch", "reach").dropDuplicates(["turn", "grp", "part", "place"])
    dealt = once.repartition("turn", "grp").sortWithinPartitions("turn", "grp", "part", "place")
    found = dealt.select("turn", "grp", "node", "sketch", "reach").mapInArrow(lambda b: _swept(b, window, False), _EDGE)
    return found.select("a", "b")


def embedding_dedup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    window: int = WINDOW,
    passes: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept (module docstring: method, odd input)."""
    # Single precision stays as it is in tables and shuffles; every sum is in double precision.
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(
        F.col(id_col).alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"),
    )
    good = F.col("label").isNotNull() & usable(F.col("vector"))
    # Adding 0.0 makes -0.0 and 0.0 one value.
    body = F.concat_ws(",", F.transform("vector", lambda x: (x + 0.0).cast("string")))
    rows = rows.withColumn("node", F.when(good, F.unhex(F.md5(F.concat(F.col("label"), F.lit("\n"), body)))))
    keyed = materialize(rows, "vectors")
    classes = materialize(
        keyed.filter("node is not null").groupBy("node").agg(
            F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"), F.first("vector").alias("vector"),
        ).withColumn("dims", F.size("vector")).withColumn("grp", F.concat_ws(" ", F.col("dims").cast("string"), "label")),
        "vector-classes",
    )
    counted = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int"))
    counted = materialize(counted, "vector-groups")
    large = counted if passes else counted.filter(F.col("blocks") > LEAST_PASSES)
    centres = materialize(_centres(classes.join(broadcast_if_small(large), "grp")).join(large, "grp"), "vector-centres")
    rows = classes.join(broadcast_if_small(centres, CENTRES), "grp")
    turns, exact = passes, counted.limit(0)
    if not passes:
        turns = measured_passes(rows, {r["grp"]: (r["n"], r["blocks"]) for r in large.select("grp", "n", "blocks").collect()}, window, threshold, seed)
        swept_groups = classes.sparkSession.createDataFrame([(g,) for g in turns], "grp string")
        exact = counted.filter("n > 1").join(broadcast_if_small(swept_groups), "grp", "left_anti")
    ordered = _keyed(rows, turns, threshold, seed).repartitionByRange("turn", "grp", "sortkey", "node")
    ordered = ordered.sortWithinPartitions("turn", "grp", "sortkey", "node")
    swept = materialize(_sorted_pass(ordered, window), "vector-passes")
    edges = swept.filter("b is not null").select("a", "b").union(_seams(swept.filter("b is null"), window))
    groups = connected_components(edges)
    members = groups.join(classes.select("node", "copies", "vector"), "node")
    whole = classes.join(broadcast_if_small(exact.select("grp")), "grp")
    members = members.unionByName(whole.select("node", F.unhex(F.md5("grp")).alias("component"), "copies", "vector"))
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    units = block_pairs(members.join(sizes, "component"), "blocks", "node")
    units = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(table: pa.Table) -> np.ndarray:
            unit = _unit(_matrix(table.column("vector")))
            return unit @ unit.T >= threshold

        yield from linked_counts(runs(batches, ["component", "i", "j"]), linked, "node", "copies", pa.binary())

    found = materialize(units.mapInArrow(verify, "node binary, links long, root binary"), "vector-links")
    joined = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = materialize(joined.join(links, "node"), "vector-linked")
    # Only classes with links meet by component; any other one is its own.
    result = classes.select("node", "least", "copies").join(broadcast_if_small(linked), "node", "left")
    least = materialize(result.filter("component is not null").groupBy("component").agg(F.min("least").alias("first")), "vector-least")
    result = materialize(
        result.join(broadcast_if_small(least), "component", "left").select(
            "node", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "vector-result",
    )
    out = keyed.select("id", "node").join(result, "node", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))

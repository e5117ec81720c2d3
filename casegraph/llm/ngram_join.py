"""N-gram Jaccard join: MinHash banding to find candidates, full n-gram sets to verify them.

1. One pass over the texts turns each into its set of hashed word n-grams and
   emits a 128-bit key of the set, a MinHash signature of one byte a bin, and the
   set's size. A band is a stretch of the signature. Rows with the same key are one class; only a class's smallest
   id goes on (combined on the map side, so copies cost nothing later).
2. Classes are shuffled on band hashes. Inside a band's bucket of up to
   ``BUCKET`` members, members are joined where their whole signatures agree in
   as many bins as those of a pair at the threshold do (less ``SPREAD`` standard
   deviations: a linked pair fails that with probability below 4e-6), searched
   from member to member, so that chance collisions don't chain groups together.
   A larger bucket links its members to its smallest one without that look.
   Either gives one edge a member, never all pairs. The components of these
   edges are the candidate groups.
3. The full n-gram sets of the candidates, and only of these, are verified:
   every pair inside a candidate group, also pairs that no band found. A large
   group is cut into blocks and each pair of blocks is a unit of its own with
   bounded memory, so no group has to fit anywhere.
4. Components of the verified links are the result's groups.

The signature is a sketch that throws every n-gram of a set into one bin per
round until no bin is empty, so each bin agrees with probability equal to the
Jaccard similarity (and, cut to a byte, in 1/256 of the other cases) at a cost of
about one hash per n-gram. Bands and rows come
from the target recall at the threshold (``choose_bands``).

Results for odd input: a null or empty text (no words) has no n-grams, is
linked with nothing and is a class of its own; a text with fewer words than n
has its whole word sequence as its one n-gram; texts of any length are used
whole; repeated rows count as documents of their own that are copies; null ids
take part (a class's id is its smallest id that isn't null); of rows that tie as
a group's first, all equal in id and text, one is kept; an empty table gives an
empty result; other columns, whatever their names, are ignored by ``ngram_join``
and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm.common import BROADCAST_ROWS, Remembered, broadcast_if_small, fresh, id_text, text_of, version, worker_memory
from casegraph.llm.components import block_pairs, connected_components, linked_counts, runs
from casegraph.scratch import materialize, release

WORDS = 5
THRESHOLD = 0.8
#: Probability that a pair exactly at the threshold shares a band.
RECALL = 0.9995
ROWS = 8
#: Members of a bucket that are compared by signature, and how far below its mean a linked pair's agreement may fall.
BUCKET, SPREAD = 4_096, 4.5
#: A block holds about so many classes and n-grams at most.
BLOCK_ROWS = 256
BLOCK_GRAMS = 400_000

_U = np.uint64
#: Odd multipliers, one per place in an n-gram, from a fixed seed.
_PLACES = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` rows that finds a pair at the threshold with that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes() -> Remembered:
    return worker_memory("ngrams").setdefault("words", Remembered(xxhash.xxh64_intdigest))


def ngram_set(text: str, n: int = WORDS) -> np.ndarray:
    """The sorted set of 64-bit n-gram hashes of a text; words stand between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, _U(width))
    for k in range(width):
        out += h[k : len(h) - width + 1 + k] * _PLACES[k]
    return np.unique(mix64(out))


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` values per set; a bin of two sets agrees with probability equal to their similarity."""
    full = np.full((len(sets), bins), np.iinfo(np.uint64).max)
    flat = full.reshape(-1)
    if not sets:
        return full
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn in range(2 * bins):
        if len(items) == 0:
            break
        h = mix64(items + _U((turn + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        if turn < bins:
            place = ((h >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
        else:
            place = np.full(len(items), turn - bins)
        np.minimum.at(flat, owner * bins + place, (_U(turn) << _U(32)) | (h & _U(0xFFFFFFFF)))
        open_sets = (full == np.iinfo(np.uint64).max).any(axis=1)
        still = open_sets[owner]
        items, owner = items[still], owner[still]
    return full


def _sketch_rows(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(id, rv, key, grams, sig) of every row; key is null without n-grams, sig holds a byte for each bin of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Parts of a batch, so that the working arrays stay small whatever the texts' lengths.
            texts, start = batch.column("t").to_pylist(), 0
            while start < len(texts):
                end, held = start, 0
                while end < len(texts) and end - start < 2000 and held < 4_000_000:
                    held += len(texts[end])
                    end += 1
                sets = [ngram_set(t, n) for t in texts[start:end]]
                bins = mix64(signatures(sets, bands * rows)).astype(np.uint8)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(start, end - start),
                        batch.column("rv").slice(start, end - start),
                        pa.array(keys, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([b.tobytes() for b in bins], pa.binary()),
                    ],
                    names=["id", "rv", "key", "grams", "sig"],
                )
                start = end

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, rv long, key binary, grams long, sig binary")


def least_agreement(bins: int, threshold: float) -> float:
    """In how many of ``bins`` bins a pair at the threshold agrees, less ``SPREAD`` standard deviations."""
    return bins * threshold - SPREAD * np.sqrt(bins * threshold * (1 - threshold))


def agreeing_groups(sigs: np.ndarray, least: float) -> np.ndarray:
    """For each row its group's first row; groups are connected by rows that agree in ``least`` bins or more."""
    roots = np.full(len(sigs), -1)
    for first in range(len(sigs)):
        if roots[first] >= 0:
            continue
        roots[first], front = first, [first]
        while front:
            apart = np.flatnonzero(roots < 0)
            if not len(apart):
                break
            near = apart[(sigs[apart] == sigs[front.pop()]).sum(axis=1) >= least]
            roots[near] = first
            front += near.tolist()
    return roots


def _bucket_edges(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) from rows (band, key, sig): an edge for each member of an agreeing group to its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["band"]):
            keys, packed = table.column("key").to_pylist(), table.column("sig").to_pylist()
            sigs = np.frombuffer(b"".join(packed), np.uint8).reshape(len(keys), -1)
            roots = agreeing_groups(sigs, least_agreement(sigs.shape[1], threshold))
            linked = np.flatnonzero(roots != np.arange(len(keys))).tolist()
            if linked:
                ends = [[keys[i] for i in linked], [keys[roots[i]] for i in linked]]
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.binary()) for e in ends], names=["a", "b"])

    return rows.repartition("band").sortWithinPartitions("band", "key").mapInArrow(run, "a binary, b binary")


def _gram_rows(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with the text ``t`` replaced by its n-gram ``set``."""
    kept = [c for c in docs.columns if c != "t"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [ngram_set(t, n).astype(np.int64) for t in part.column("t").to_pylist()]
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [grams], names=[*kept, "set"])

    return docs.mapInArrow(run, schema)


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Symmetric matrix: which pairs of the sets have a Jaccard similarity of at least ``threshold``."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    items, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else np.empty(0, int)
    counts = np.diff(np.append(starts, len(items)))
    column = np.repeat(np.arange(len(starts)), counts)
    common = np.zeros((n, n))
    # n-grams in few sets: pair each with its next neighbours of the same n-gram.
    few = counts[column] <= 8
    rare, of = owner[few], column[few]
    for lag in range(1, 8):
        hit = of[lag:] == of[:-lag]
        if not hit.any():
            break
        np.add.at(common, (rare[:-lag][hit], rare[lag:][hit]), 1)
    common += common.T
    # n-grams in many sets: matrix products over bounded stretches of n-grams.
    wide = np.flatnonzero(counts > 8)
    for k in range(0, len(wide), 4096):
        chosen = wide[k : k + 4096]
        number = np.full(len(starts), -1)
        number[chosen] = np.arange(len(chosen))
        own = number[column]
        seen = np.zeros((n, len(chosen)), np.float32)
        seen[owner[own >= 0], own[own >= 0]] = 1
        common += seen @ seen.T
    either = sizes[:, None] + sizes[None, :] - common
    return common >= threshold * either - 1e-9


def _grouped(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float = THRESHOLD,
    n: int = WORDS,
    recall: float = RECALL,
    rows: int = ROWS,
) -> DataFrame:
    """(id, rv, first, n_links, copies) of every row; ``first`` (none, id, rv) is its group's first row."""
    bands = choose_bands(threshold, recall, rows)
    source = docs.select(F.col(id_col).alias("id"), version(id_col, text_col).alias("rv"), text_of(text_col).alias("t"))
    sketched = materialize(_sketch_rows(source, bands, rows, n), "ngram-sketches")
    filled = sketched.filter("key is not null")
    classes = materialize(
        filled.groupBy("key").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rv")).alias("one"), F.count(F.lit(1)).alias("copies"),
            F.first("grams").alias("grams"), F.first("sig").alias("sig"),
        ),
        "ngram-classes",
    )
    # 2. Buckets: members that agree are linked; in a very large bucket all are, to the smallest key.
    dealt = classes.select("key", "sig", F.explode(F.array(*[F.lit(b) for b in range(bands)])).alias("b"))
    dealt = dealt.select("key", F.xxhash64("b", F.substring("sig", F.col("b") * rows + 1, F.lit(rows))).alias("band"))
    heads = dealt.groupBy("band").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialize(dealt.join(heads, "band"), "ngram-buckets")
    close = shared.filter(F.col("size") <= BUCKET).select("key", "band")
    looked = _bucket_edges(classes.select("key", "sig").join(broadcast_if_small(close), "key"), threshold)
    plain = shared.filter((F.col("size") > BUCKET) & (F.col("key") != F.col("head"))).select(F.col("key").alias("a"), F.col("head").alias("b"))
    groups = connected_components(looked.union(plain))
    release(shared)
    few = groups.count() <= BROADCAST_ROWS

    def hinted(df: DataFrame) -> DataFrame:
        """For tables with no more rows than ``groups`` has."""
        return F.broadcast(df) if few else df

    # 3. Sizes of the candidate groups decide into how many blocks they are cut.
    members = classes.select(F.col("key").alias("node"), "grams", "copies", "one").join(hinted(groups), "node")
    totals = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("grams").alias("g"))
    blocks = F.ceil(F.greatest(F.col("m") / F.lit(BLOCK_ROWS), F.col("g") / F.lit(BLOCK_GRAMS))).cast("int")
    members = members.join(hinted(totals.select("component", blocks.alias("blocks"))), "component")
    # The text of one row of each candidate class: rows of a class all have the same set.
    chosen = materialize(
        members.select("component", F.col("node"), "copies", "blocks", id_text(F.col("one.id")).alias("rid"), F.col("one.rv").alias("rv")), "ngram-chosen"
    )
    texts = source.select(id_text(F.col("id")).alias("rid"), "rv", "t").join(hinted(chosen), ["rid", "rv"])
    units = block_pairs(_gram_rows(texts.select("component", "node", "copies", "blocks", "t"), n), "blocks", "node")
    units = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(table: pa.Table) -> np.ndarray:
            return similar([np.asarray(s.values).astype(np.uint64) for s in table.column("set")], threshold)

        def distinct(table: pa.Table) -> pa.Table:
            # Rows that are repeated in the input arrive once each; they are neighbours here.
            nodes = table.column("node").to_pylist()
            first = [i for i in range(len(nodes)) if i == 0 or nodes[i] != nodes[i - 1]]
            return table if len(first) == len(nodes) else table.take(first)

        units_of = map(distinct, runs(batches, ["component", "i", "j"]))
        yield from linked_counts(units_of, linked, "node", "copies", pa.binary())

    found = materialize(units.mapInArrow(verify, "node binary, links long, root binary"), "ngram-links")
    release(chosen)
    release(groups)
    # 4. Components of verified links.
    joined = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), written=True)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = joined.join(links, "node").withColumnRenamed("node", "key")
    # Only classes with links or copies differ from a row that stands alone.
    special = classes.select("key", "one", "copies").join(hinted(linked), "key", "left")
    special = special.filter("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "key"))
    least = materialize(special.groupBy("component").agg(F.min("one").alias("first")), "ngram-firsts")
    result = materialize(
        special.join(broadcast_if_small(least), "component").select(
            "key", "first", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        ),
        "ngram-result",
    )
    for done in (classes, found, joined, least):
        release(done)
    alone = F.struct(F.col("id").isNull().alias("none"), "id", "rv")
    return sketched.select("id", "rv", "key").join(broadcast_if_small(result), "key", "left").select(
        "id", "rv", F.coalesce("first", alone).alias("first"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, class_id (smallest id of its group), n_links, copies.

    ``n_links`` counts the other rows whose n-gram set is similar enough, ``copies`` the rows with
    the same set, itself included. Options: threshold, n, recall, rows (module docstring: odd input).
    """
    plan = _grouped(docs, id_col, text_col, **options)
    return plan.select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "n_links", "copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group, the one with the smallest id. Same columns.

    Rows without any word are groups of their own and stay. Of repeated rows (same id and text) one
    stays.
    """
    rid, rv = fresh(docs, "rid", "rversion")
    plan = _grouped(docs, id_col, text_col, **options)
    gone = plan.filter((F.col("first.rv") != F.col("rv")) | ~F.col("first.id").eqNullSafe(F.col("id")))
    gone = materialize(gone.select(id_text(F.col("id")).alias(rid), F.col("rv").alias(rv)).distinct(), "ngram-dropped")
    keyed = docs.withColumns({rid: id_text(F.col(id_col)), rv: version(id_col, text_col)})
    return keyed.join(broadcast_if_small(gone), [rid, rv], "left_anti").dropDuplicates([rid, rv]).drop(rid, rv)

"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

1. Sizes (words) are summed per source, sources get weights, and a budget of
   words is shared by weight; a source whose share is above its cap stops
   there and the excess is shared among the others by weight (water filling:
   sort by cap / weight, prefix sums, one row per source).
2. A source reads its documents in a pseudo-random order (a seeded hash of id
   and text), again from the start for each further epoch, until its target is
   reached; the document at the end is taken in part, by its first words. Where
   a document stands in that order comes from a three-level prefix sum: buckets
   of the hash within a source, sized by the source's number of documents, a
   running sum inside each bucket, and one over buckets inside each block of
   them, so that no task holds more than a bucket's or a block's rows. A source
   with a third of all documents is spread over as many more buckets. Equal rows
   are counted first and stand side by side in that order, so a row that a third
   of all rows repeat is one row until its copies are dealt out again.
3. Each source has a schedule: its weight as a piecewise-linear function of
   training time in [0, 1]. The integral of the schedule is its cumulative
   demand for tokens; inverting that at the middle of a document's words gives
   the document's training position. The mix is sorted by position (range
   partitioning, no single task).

Results for odd input: a null or empty text has size 0 and takes 0 words; a
null source is a source of its own, the last; null ids and repeated rows take
part, each row for itself (equal rows may exchange their shares); a table whose
texts are all empty, or an empty table, gives targets of 0; very long texts are
counted whole; rows at one position are ordered by id; other columns are ignored
by ``plan_mix`` and passed through by ``mix_documents``, whatever their names
(of rows equal in id, text and source, one row's).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from casegraph.llm.common import ASCII_SPACE, ASCII_WORD, broadcast_if_small, fresh, id_text, text_of, version
from casegraph.scratch import materialize

WEIGHTS = (5, 2, 1)
#: Weight of a source over training time, at equally spaced times from 0 to 1, by place in WEIGHTS:
#: heavy sources come early, light ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
BUDGET = 1.5
CAP = 2
#: Documents of one bucket of a source's reading order, about.
BUCKET = 2_000
#: Words of one part of the mix, at most about.
PART_WORDS = 16_000_000
#: Buckets of one block, and copies of a row that are dealt out together.
BLOCK, LOT = 1_000, 1_000
#: Hash values are spread over this many slots, which buckets divide.
SLOTS = 1 << 30


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ASCII_WORD)).cast("long")


def _cycle(values: Sequence, position: Column) -> Column:
    """values[position mod len], position from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position % len(values) + 1).cast("int"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, cap: float = CAP
) -> DataFrame:
    """(source, source_size, n_docs, place, weight, target) from rows (source, size).

    One row per source; the windows below run over these rows only, never over documents.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    placed = totals.withColumn("place", place).withColumn("weight", _cycle([float(w) for w in weights], F.col("place")))
    capped = placed.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rising = Window.orderBy(F.col("most") / F.col("weight"), "place")
    everything = Window.partitionBy(F.lit(0))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(budget))
        - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # In rising order of cap per weight: a source is capped while the level of the rest is at or above its own.
    filled = capped.withColumn("level", level).withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    water = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("place"), F.col("level"))))
    water = water.over(everything)["level"]
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * water)
    return filled.select("source", "source_size", "n_docs", "place", "weight", target.cast("double").alias("target"))


def _before(column: str, window: WindowSpec) -> Column:
    """The sum of the rows before this one."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def training_position(share: Column, knots: Column) -> Column:
    """The time in [0, 1] by which a source has been asked for ``share`` of its words.

    ``knots`` (array of double) is the schedule at equally spaced times. Its integral is piecewise
    quadratic; the segment is found by its cumulative area and its quadratic is solved for the time.
    """
    n = F.size(knots) - 1
    segments = F.sequence(F.lit(1), n)
    areas = F.transform(segments, lambda i: (F.element_at(knots, i) + F.element_at(knots, i + 1)) / 2)
    total = F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)
    want = share * total
    start = F.struct(F.lit(0.0).alias("area"), F.lit(None).cast("double").alias("time"))

    def step(state: Column, i: Column) -> Column:
        left, right = F.element_at(knots, i), F.element_at(knots, i + 1)
        area = (left + right) / 2
        need = want - state["area"]
        slope = right - left
        # left*u + slope*u*u/2 = need, 0 <= u <= 1
        root = F.sqrt(F.greatest(left * left + 2 * slope * need, F.lit(0.0)))
        u = F.when(left + root > 0, 2 * need / (left + root)).otherwise(F.lit(0.0))
        here = (i - 1 + F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))) / n
        time = F.when(state["time"].isNull() & ((need <= area) | (i == n)), here).otherwise(state["time"])
        return F.struct((state["area"] + area).alias("area"), time.alias("time"))

    return F.aggregate(segments, start, step, lambda s: s["time"])


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    budget: float = BUDGET,
    cap: int = CAP,
    seed: int = 17,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: id, version, source, size, source_size, target, taken, positions.

    ``version`` is a hash of the text, so that rows with one id and different texts stay apart.
    ``positions`` is an array with a struct (position, words) for each epoch that takes words of it.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        version(id_col, text_col).alias("version"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_of(text_col)).alias("size"),
        key.alias("key"),
    )
    sized = materialize(rows, "mix-sizes")  # texts are read and counted once
    targets = materialize(source_targets(sized, weights, budget, cap), "mix-targets")
    plan = targets.withColumn("buckets", F.ceil(F.col("n_docs") / F.lit(bucket)).cast("long"))
    single = sized.groupBy("id", "version", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies"))
    placed = single.withColumnRenamed("source", "own").join(plan, F.col("own").eqNullSafe(F.col("source")))
    slot = F.pmod(F.col("key"), F.lit(SLOTS))
    placed = placed.drop("own").withColumn("bucket", F.floor(slot * F.col("buckets") / F.lit(SLOTS)).cast("long"))
    placed = materialize(placed.withColumn("words", F.col("size") * F.col("copies")), "mix-placed")
    inside = Window.partitionBy("place", "bucket").orderBy("key", "id", "version")
    running = placed.withColumn("inner", _before("words", inside))
    block = F.floor(F.col("bucket") / F.lit(BLOCK)).alias("block")
    sums = placed.groupBy("place", "bucket").agg(F.sum("words").alias("held")).select("*", block)
    whole = sums.groupBy("place", "block").agg(F.sum("held").alias("held"))
    first = whole.select("place", "block", _before("held", Window.partitionBy("place").orderBy("block")).alias("first"))
    offsets = sums.select("place", "bucket", "block", _before("held", Window.partitionBy("place", "block").orderBy("bucket")).alias("later"))
    offsets = offsets.join(first, ["place", "block"]).select("place", "bucket", (F.col("first") + F.col("later")).alias("outer"))
    located = running.join(offsets, ["place", "bucket"])
    most = placed.agg(F.max("copies")).first()[0] or 1
    # Copies are dealt out in lots, and the lots of a row with very many copies to many tasks.
    lots = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / F.lit(LOT)).cast("int"))).alias("lot")
    dealt = located.select("*", lots)
    if most > 100 * LOT:
        dealt = dealt.repartition("key", "lot")
    own = F.sequence(F.col("lot") * LOT, F.least((F.col("lot") + 1) * LOT, F.col("copies").cast("int")) - 1)
    located = dealt.select("*", F.explode(own).alias("copy")).withColumn("inner", F.col("inner") + F.col("copy") * F.col("size"))
    at = F.col("inner") + F.col("outer")
    quota = F.round("target").cast("long")

    def epoch(k: Column) -> Column:
        begin = k * F.col("source_size") + at
        words = F.greatest(F.least(quota - begin, F.col("size")), F.lit(0)).cast("long")
        share = (begin + words / 2) / F.greatest(F.col("target"), F.lit(1.0))
        place = training_position(share, _cycle([F.array(*[F.lit(float(x)) for x in s]) for s in schedules], F.col("place")))
        return F.struct(place.alias("position"), words.alias("words"))

    epochs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), epoch), lambda e: e["words"] > 0)
    taken = F.aggregate(F.col("positions"), F.lit(0).cast("long"), lambda a, e: a + e["words"])
    return (
        located.withColumn("positions", epochs)
        .withColumn("taken", taken)
        .select("id", "version", "source", "size", "source_size", "target", "taken", "positions")
    )


def _in_training_order(rows: DataFrame, position: str, id_col: str) -> DataFrame:
    return rows.repartitionByRange(position, id_col).sortWithinPartitions(position, id_col)


def ordered_plan(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``plan_mix`` by way of the mix's order: a document's entries, one for each epoch that takes words of it, are
    range-sorted by training position and written in that order, then gathered by document again."""
    row = F.monotonically_increasing_id()
    # The plan is written first: range boundaries are sampled, and rows must keep their numbers meanwhile.
    plan = materialize(plan_mix(docs, id_col, **options).withColumn("row", row), "mix-plan")
    entries = plan.select("row", "id", F.posexplode("positions").alias("epoch", "e")).select("row", "id", "epoch", "e.position", "e.words")
    ordered = materialize(_in_training_order(entries, "position", "id"), "mix-order")
    listed = F.array_sort(F.collect_list(F.struct("epoch", "position", "words")))
    own = ordered.groupBy("row").agg(F.transform(listed, lambda e: F.struct(e["position"].alias("position"), e["words"].alias("words"))).alias("positions"))
    kind = plan.schema["positions"].dataType
    positions = F.coalesce("positions", F.array().cast(kind)).alias("positions")
    columns = [c for c in plan.columns if c not in ("row", "positions")]
    return plan.drop("positions").join(own, "row", "left").select(*columns, positions)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: ``docs``' columns, one row per document and epoch that takes words of it.

    Rows are range-sorted by training position. A document taken in part holds its first words.
    Documents that take no words are not in the mix. Repeated rows share their plans: together they
    appear as often as the plan says.

    Positions are known before texts are read again: the narrow plan is range-sorted and written with the number of each
    row's part, and texts, once they have met it, go straight to their parts. They meet it by broadcast if it is small.
    """
    rid, rv, pos, words, size, part = fresh(docs, "rid", "rversion", "position", "words", "size", "part")
    plan = plan_mix(docs, id_col, text_col, source_col, **options).filter("taken > 0")
    own = F.xxhash64("version", "source")
    entries = plan.select(F.col("id"), id_text(F.col("id")).alias("rid"), own.alias("rv"), "size", F.explode("positions").alias("e"))
    entries = materialize(entries.select("id", "rid", "rv", "size", "e.position", "e.words"), "mix-entries")
    # Parts are as many as the cluster's shuffles have, or as hold ``PART_WORDS`` each: the plan is too narrow to tell.
    held = entries.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // PART_WORDS))
    ordered = entries.repartitionByRange(wanted, "position", "id").sortWithinPartitions("position", "id")
    routed = materialize(ordered.withColumn("part", F.spark_partition_id()), "mix-order").drop("id")
    parts = (routed.agg(F.max("part")).first()[0] or 0) + 1
    routed = routed.withColumnsRenamed({"rid": rid, "rv": rv, "position": pos, "words": words, "size": size, "part": part})
    keyed = docs.withColumns({rid: id_text(F.col(id_col)), rv: F.xxhash64(version(id_col, text_col), F.col(source_col).cast("string"))})
    # Rows listed several times are taken once each: only these are shuffled for it.
    again = materialize(keyed.groupBy(rid, rv).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(rid, rv), "mix-repeats")
    once = keyed
    if not again.isEmpty():
        listed = broadcast_if_small(again)
        once = keyed.join(listed, [rid, rv], "left_anti").unionByName(keyed.join(listed, [rid, rv], "left_semi").dropDuplicates([rid, rv]))
    rows = once.join(broadcast_if_small(routed), [rid, rv])
    body = F.regexp_replace(F.col(text_col), "^" + ASCII_SPACE, "")
    rest = F.element_at(F.split(body, ASCII_SPACE, (F.col(words) + 1).cast("int")), -1)
    first = F.regexp_replace(F.substring(body, F.lit(1), F.length(body) - F.length(rest)), ASCII_SPACE + "$", "")
    text = F.when(F.col(words) >= F.col(size), F.col(text_col)).otherwise(first)
    out = rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], pos, part)
    return out.repartitionById(parts, part).sortWithinPartitions(pos, id_col).drop(pos, part)

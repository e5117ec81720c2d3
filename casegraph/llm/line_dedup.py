"""Line dedup over overlapping three-line windows. DataFrame operations only.

Every run of three consecutive lines is hashed (128 bits, two seeded 64-bit
hashes). A window whose hash occurs more than once in the corpus is a repeat;
its first occurrence, by (document id, document text hash, position), stays and
all later ones are removed. A document loses the union of the lines that its
later occurrences cover.

Windows are built row by row with array functions and written once, 40 bytes
each. They are grouped with map-side combining, so a passage that a third of all
documents share sends one row per task. Repeated windows, and then the lines to
remove by document, are broadcast if a count shows that they are few; then texts
are not shuffled at all. Otherwise both are equi-joins, which adaptive execution
splits where one key is hot, and texts are shuffled once.

Results for odd input:

* a null text stays null; a text of fewer than three lines has no window and
  stays as it is; lines end at ``\\n`` and a ``\\r`` belongs to its line;
* a window of three lines without any non-blank character is never a repeat;
* in a run of equal lines the windows overlap, and only the first line stays;
* a document whose lines are all covered stays as a row with an empty text;
* ids may be null or repeated: rows with the same id *and* text are one
  document that is listed twice, and keep or lose the same lines; rows with the
  same id and different texts are different documents;
* a very long text or line is hashed whole; of equal windows the first one, in
  the order above, stays, so reruns agree;
* an empty table gives an empty result; all other columns are passed through,
  whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import broadcast_if_small, fresh, let
from casegraph.scratch import materialize

WINDOW = 3
#: The lines to remove are broadcast if they are at most so many windows' lines together.
BROADCAST_STARTS = 1_000_000


def _windows(lines: Column, width: int) -> Column:
    """One struct per window: position and two 64-bit hashes; blank windows are left out."""

    def starts(ls: Column) -> Column:
        n = F.size(ls) - (width - 1)
        return F.arrays_zip(*[F.slice(ls, k + 1, n) for k in range(width)])

    def at(block: Column, i: Column) -> Column:
        # Lines hold no line feed, so the joined text tells every sequence of lines apart.
        joined = F.concat_ws("\n", *[block[str(k)] for k in range(width)])
        return F.struct(
            i.alias("pos"),
            F.xxhash64(joined).alias("h1"),
            F.xxhash64(F.lit("second"), joined).alias("h2"),
            F.trim(F.translate(joined, "\n\r\t", "   ")).alias("body"),
        )

    made = let(lines, lambda ls: F.when(F.size(ls) >= width, F.transform(starts(ls), at)))
    return F.filter(made, lambda w: w["body"] != "")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` with the later occurrences of repeated windows removed from ``text_col``.

    Same columns, same number of rows (module docstring: odd input).
    """
    lines = F.split(F.col(text_col), "\n", -1)
    base = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("version"),
        F.explode(_windows(lines, width)).alias("w"),
    ).select("id", "version", "w.pos", "w.h1", "w.h2")
    base = materialize(base, "line-windows")
    first = base.groupBy("h1", "h2").agg(
        F.min(F.struct("id", "version", "pos")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    repeated = materialize(first.filter("n > 1").drop("n"), "line-repeats")
    later = base.join(broadcast_if_small(repeated), ["h1", "h2"]).filter(~F.struct("id", "version", "pos").eqNullSafe(F.col("first")))
    # Positions covered by later occurrences, merged: pos .. pos + width - 1.
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + F.lit(width - 1)))))
    removed = materialize(later.groupBy("id", "version").agg(F.collect_set("pos").alias("starts")), "line-removed")
    n_starts = removed.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]

    v, rid, rv, gone = fresh(docs, "version", "rid", "rversion", "removed")
    lost = removed.select(F.col("id").alias(rid), F.col("version").alias(rv), covered.alias(gone))
    out = docs.withColumn(v, F.xxhash64(text_col)).join(
        F.broadcast(lost) if n_starts <= BROADCAST_STARTS else lost,
        F.col(id_col).eqNullSafe(F.col(rid)) & (F.col(v) == F.col(rv)),
        "left",
    )

    def without(ls: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone))
        return F.array_join(F.transform(kept, lambda i: F.element_at(ls, i + 1)), "\n")

    new = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(let(lines, without))
    return out.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])

"""Bounded, repeatable samples of labelled rows, and models fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.scratch import materialize

def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def sample_ids(ids: DataFrame, size: int, seed: int) -> DataFrame:
    """At most ``size`` rows of ``ids`` (id, ...), which has a row for each id: those with the least hash of the id."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(size)


def sample_texts(rows: DataFrame, size: int, chars: int, seed: int, total: int | None = None) -> DataFrame:
    """``rows`` (id, t, ...) cut to a sample that one task can hold: at most ``size`` rows and ``chars`` characters, with ``slot``.

    The rows with the least hash of id *and* text are taken. Rows that are repeated count once, so an id that a
    third of all rows share is sampled like any other; of two that share a hash the lesser text counts. Slots are
    chosen on hashes and lengths alone; texts of chosen slots are combined on the map side, so that no task sends
    more than the sample. With ``total``, the number of rows, hashes that are too great are left out early.
    """
    slot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "t"), 1)
    keyed = rows.withColumn("slot", slot)
    share = 1.0 if total is None else min(1.0, (1.1 * size + 8 * size**0.5) / max(total, 1))
    likely = keyed if share >= 1.0 else keyed.filter(F.col("slot") < int(share * 2**63))
    least = likely.groupBy("slot").agg(F.min(F.length("t")).alias("n")).orderBy("slot").limit(size)
    before = F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    chosen = materialize(least.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") + F.col("n") <= chars).select("slot"), "sample")
    others = [c for c in rows.columns if c != "t"]
    drawn = likely.join(F.broadcast(chosen), "slot").groupBy("slot")
    return drawn.agg(F.min("t").alias("t"), *[F.min(c).alias(c) for c in others])


def fit_in_one_task(rows: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """``fit`` over all of ``rows`` (a bounded sample) in one executor task; its model comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or table.num_rows == 0:
            model = None
        else:
            model = fit(table)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "model binary").first()[0])

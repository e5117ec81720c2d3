"""Ranking: the priority queue as a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_pushes(items: DataFrame, key: str = "path_id", seq: str = "seq") -> DataFrame:
    """The first arrival per key; later ones are refused, also after the first has been popped."""
    columns = [c for c in items.columns if c != key]
    picked = items.groupBy(key).agg(F.min_by(F.struct(*columns), seq).alias("_i"))
    return picked.select(key, "_i.*").select(*items.columns)


def top(items: DataFrame, k: int, priority: str = "priority", seq: str = "seq", key: str = "path_id") -> DataFrame:
    """The k items that the queue would pop first: priority down, then arrival."""
    return first_pushes(items, key, seq).orderBy(F.col(priority).desc(), F.col(seq)).limit(k)


def pop_order(items: DataFrame, by: list[str], priority: str = "priority", seq: str = "seq", key: str = "path_id") -> DataFrame:
    """Items with ``rank``, their place in the queue of their group (one queue per scan, say).

    Of items equal in priority and arrival the smaller key comes first, so reruns agree.
    """
    window = Window.partitionBy(*by).orderBy(F.col(priority).desc(), F.col(seq), F.col(key))
    return first_pushes(items, key, seq).withColumn("rank", F.row_number().over(window).cast("long"))

"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Two passes over the table, so that unique texts are never shuffled twice:

1. every row becomes (id, hash, sha256), which is written, and hashes are counted
   with map-side combining; hashes that occur once are settled there;
2. only texts whose hash repeats are compared: the smallest and the greatest
   text of each hash are aggregated (again combined on the map side, so a
   group with a third of all rows sends one pair per task). If they differ the
   hash has collided, and its rows are grouped by hash *and* text (its SHA-256)
   instead.

Results for odd input: a null text is an empty text; empty texts are equal to
each other; a null id takes part like any other and is kept only if its whole
group has null ids (nulls sort last); repeated rows with the same id are all
marked kept when that id is the group's; texts of any length are hashed and
compared whole; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import ASCII_SPACE, broadcast_if_small, text_of
from casegraph.scratch import materialize


#: A hash is hot from one row in so many.
HOT_SHARE = 1000
SALTS = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, ASCII_SPACE, " ")


def content_hash(text: Column) -> Column:
    """128 bits, as 32 hex digits."""
    return F.md5(text)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = normalised,
    hasher: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (module docstring: odd input).

    ``hasher`` can be replaced to test collisions; the result doesn't depend on it.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalise(text_of(text_col)).alias("t"))
    # Texts are normalised and hashed once; only those with a repeated hash are read again, to be compared.
    keyed = materialize(rows.select("id", hasher(F.col("t")).alias("k"), F.sha2(F.col("t"), 256).alias("sha")), "hashes")
    groups = materialize(_groups(keyed), "hash-groups")
    compared = _compare(rows.select("id", hasher(F.col("t")).alias("k"), "t"), groups)
    collided = materialize(compared.filter("first <> last").select("k"), "collided-hashes")
    if not collided.isEmpty():
        split = keyed.join(collided.withColumn("hit", F.lit(True)), "k", "left")
        keyed = split.select("id", F.when(F.col("hit"), F.concat("k", "sha")).otherwise(F.col("k")).alias("k"), "sha")
        groups = materialize(_groups(keyed), "hash-groups")
    return keyed.join(groups, "k").select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _compare(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(k, first, last): the smallest and the greatest text of every repeated hash.

    A hash with more than a thousandth of all rows is hot; there are fewer than a thousand such
    hashes, so they may be broadcast. Their texts are dealt to ``SALTS`` parts, compared part by
    part, and the parts' ends are compared after that.
    """
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * HOT_SHARE > total
    repeated = groups.filter("group_size > 1").select("k", F.when(hot, SALTS).otherwise(1).alias("salts"))
    salted = repeated.select("k", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salts = F.broadcast(repeated.filter("salts > 1"))
    dealt = texts.join(salts, "k", "left").select(
        "k", "t", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    )
    parts = dealt.join(broadcast_if_small(salted), ["k", "salt"], "left_semi").groupBy("k", "salt")
    ends = parts.agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return ends.groupBy("k").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _groups(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("k").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

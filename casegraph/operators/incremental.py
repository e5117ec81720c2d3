"""What a change touches, and what can be used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(rel_path, status) from two snapshots (rel_path, file_hash): ADDED, MODIFIED, DELETED, UNCHANGED."""
    old = previous.select("rel_path", F.col("file_hash").alias("_old"), F.lit(True).alias("_was"))
    new = current.select("rel_path", F.col("file_hash").alias("_new"), F.lit(True).alias("_is"))
    status = (
        F.when(F.col("_was").isNull(), "ADDED").when(F.col("_is").isNull(), "DELETED")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "UNCHANGED").otherwise("MODIFIED")
    )
    return old.join(new, "rel_path", "full").select("rel_path", status.alias("status"))


def change_feed(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """Changed names (rel_path), distinct, with forward slashes."""
    both = tracked.select("rel_path").union(untracked.select("rel_path"))
    return both.select(F.replace("rel_path", F.lit("\\"), F.lit("/")).alias("rel_path")).filter("rel_path <> ''").distinct()


def all_changed(present: DataFrame) -> DataFrame:
    """(rel_path) of everything that is there: what a change feed is where nothing is known of changes."""
    return present.select("rel_path").filter(~F.array_contains(F.split("rel_path", "/"), ".audit")).distinct()


def reusable_dossiers(dossiers: DataFrame, paths: DataFrame, sinks: DataFrame, files: DataFrame, changed: DataFrame, fingerprint: str) -> DataFrame:
    """(dossier_id, rel_path) of results of this engine whose sink lies in an unchanged file."""
    own = dossiers.filter(F.col("engine_fingerprint") == fingerprint).select("dossier_id", "path_id")
    located = own.join(paths.select("path_id", "sink_id"), "path_id").join(sinks.select("sink_id", "file_id"), "sink_id")
    located = located.join(files.select("file_id", "rel_path"), "file_id")
    return located.join(changed.select("rel_path"), "rel_path", "left_anti").select("dossier_id", "rel_path")


def impact_plan(changed: DataFrame, present: DataFrame, indexed: DataFrame) -> DataFrame:
    """(rel_path, status, file_id): each changed or indexed path with its fate.

    CHANGED: changed and still there; DELETED: changed and gone; UNAFFECTED: indexed and not changed.
    ``file_id`` is null for a path that was never indexed. Only CHANGED and DELETED rows need work.
    """
    is_changed = changed.select("rel_path").distinct().withColumn("_c", F.lit(True))
    is_there = present.select("rel_path").distinct().withColumn("_p", F.lit(True))
    known = indexed.groupBy("rel_path").agg(F.min("file_id").alias("file_id"))
    rows = known.join(is_changed, "rel_path", "full").join(is_there, "rel_path", "left")
    status = F.when(F.col("_c").isNull(), "UNAFFECTED").when(F.col("_p"), "CHANGED").otherwise("DELETED")
    return rows.select("rel_path", status.alias("status"), "file_id")


def latest_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order (latest first, say)."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_k", place).filter("_k = 1").drop("_k")


def cached_results(wanted: DataFrame, dossiers: DataFrame) -> DataFrame:
    """For each (path_id, engine_fingerprint) wanted, the newest dossier with both; none if there is none."""
    hits = dossiers.join(wanted.select("path_id", "engine_fingerprint").distinct(), ["path_id", "engine_fingerprint"], "left_semi")
    return latest_by(hits, ["path_id", "engine_fingerprint"], [F.col("created_at").desc(), F.col("dossier_id").desc()])

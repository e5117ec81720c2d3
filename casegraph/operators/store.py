"""Keyed tables: upserts, invalidation, cascades, on versioned Parquet.

Plain Parquet has no MERGE. An upsert is a full outer join of the base with the
last arrival per key. Tables are dealt to parts by a hash of the key, so a merge
reads, joins and writes the parts of its own keys and leaves all others as they
are. New versions are written beside the old ones and take their place together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from copy import deepcopy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.scratch import materialize, release


def last_arrivals(delta: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row per key, without ``seq``; the order of arrival must be a column."""
    others = [c for c in delta.columns if c not in (*key, seq)]
    if not others:
        return delta.select(*key).distinct()
    picked = delta.groupBy(*key).agg(F.max_by(F.struct(*others), seq).alias("_v"))
    return picked.select(*key, "_v.*")


def upsert(base: DataFrame, delta: DataFrame, key: list[str], kept: list[str] = (), seq: str | None = None) -> DataFrame:
    """``base`` with ``delta`` merged in by ``key``; ``kept`` columns of existing rows stay as they are.

    Columns of ``base`` that ``delta`` lacks keep their values, and are null in new rows. Keys compare null-safe.
    """
    new = last_arrivals(delta, key, seq) if seq else delta
    renamed = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_new"))
    old = base.withColumn("_old", F.lit(True))
    on: Column | None = None
    for k in key:
        part = F.col(k).eqNullSafe(F.col(f"_n_{k}"))
        on = part if on is None else on & part
    joined = old.join(renamed, on, "full")
    columns = []
    for c in base.columns:
        if c in key:
            columns.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
        elif c not in new.columns:
            columns.append(F.col(c))
        elif c in kept:
            columns.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
        else:
            columns.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*columns)


def surrogate(key: list[str]) -> Column:
    """A stable id from the natural key: the same row has the same id in every run."""
    return F.xxhash64(*key)


def shaped(table: str, delta: DataFrame, seq: str | None = None) -> DataFrame:
    """``delta`` as rows of the named table: its columns and types, defaults, ids, what writers normalise, and ``seq``."""
    spec = S.TABLES[table]
    if not spec.key:
        return S.evolve(delta, table)
    # D4 and D3: what writers normalise.
    if table == "endpoints":
        delta = delta.withColumn("http_method", F.upper("http_method"))
    if table == "candidate_sinks":
        delta = delta.withColumn("triage_severity", F.upper(F.coalesce("triage_severity", F.lit("MEDIUM"))))
    order = [seq] if seq else []
    out = S.evolve(delta, table).select("*") if not seq else None
    if seq:
        columns = {c.lower() for c in delta.columns}
        missing = [f.name for f in spec.schema.fields if f.name not in columns]
        out = delta.select("*", *[F.lit(None).cast(spec.schema[m].dataType).alias(m) for m in missing])
        out = out.select(
            *[
                (F.coalesce(F.col(f.name).cast(f.dataType), F.lit(spec.defaults[f.name]).cast(f.dataType)) if f.name in spec.defaults
                 else F.col(f.name).cast(f.dataType)).alias(f.name)
                for f in spec.schema.fields
            ],
            *order,
        )
    ident = spec.schema.fields[0]
    if ident.name not in spec.key and ident.dataType.simpleString() == "bigint":
        out = out.withColumn(ident.name, F.coalesce(ident.name, surrogate(list(spec.key))))
    return out


def upsert_table(table: str, base: DataFrame, delta: DataFrame, seq: str | None = None) -> DataFrame:
    """``upsert`` by the data model: defaults, key and kept columns of the named table; rows of a table without key are added."""
    spec, rows = S.TABLES[table], shaped(table, delta, seq)
    return upsert(base, rows, list(spec.key), list(spec.kept), seq) if spec.key else base.unionByName(rows)


def invalidated(edges: DataFrame, paths: DataFrame, symbols: DataFrame, sinks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge_id), (path_id) that depend on the given files (file_id).

    Edges that touch a symbol of the files, and paths to their sinks. The condition on caller *or* callee is a union of
    two semi-joins, not one join on a disjunction.
    """
    touched = symbols.join(files.select("file_id"), "file_id", "left_semi").select("symbol_id")
    by_caller = edges.join(touched, edges["caller_symbol_id"] == touched["symbol_id"], "left_semi").select("edge_id")
    by_callee = edges.join(touched, edges["callee_symbol_id"] == touched["symbol_id"], "left_semi").select("edge_id")
    own_sinks = sinks.join(files.select("file_id"), "file_id", "left_semi").select("sink_id").distinct()
    return by_caller.union(by_callee).distinct(), paths.join(own_sinks, "sink_id", "left_semi").select("path_id").distinct()


def _where(rows: DataFrame, keys: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` in ``column`` where ``keys`` has the row's key."""
    marked = rows.join(keys.withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).select(*rows.columns)


def deactivate(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """``evidence`` with that of the given edges (edge_id) inactive."""
    return _where(evidence, edges, "edge_id", "is_active", F.lit(False))


def reopen(paths: DataFrame, hit: DataFrame) -> DataFrame:
    """``paths`` with the given ones (path_id) unresolved."""
    return _where(paths, hit, "path_id", "state", F.lit("UNRESOLVED"))


def invalidate_files(edges: DataFrame, evidence: DataFrame, paths: DataFrame, symbols: DataFrame, sinks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, paths) after the given files (file_id) have changed."""
    hit_edges, hit_paths = invalidated(edges, paths, symbols, sinks, files)
    return deactivate(evidence, hit_edges), reopen(paths, hit_paths)


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after the files in ``gone`` (file_id) are deleted: rows that depend on them go, loose references become null."""
    out = dict(tables)

    def without(name: str, column: str, keys: DataFrame, key: str) -> None:
        dead = keys.select(F.col(key).alias("_k")).distinct()
        out[name] = out[name].join(dead, F.col(column) == F.col("_k"), "left_anti")

    def nulled(name: str, column: str, keys: DataFrame, key: str) -> None:
        dead = keys.select(F.col(key).alias("_k")).distinct().withColumn("_dead", F.lit(True))
        joined = out[name].join(dead, F.col(column) == F.col("_k"), "left")
        fixed = F.when(F.col("_dead"), F.lit(None).cast(out[name].schema[column].dataType)).otherwise(F.col(column))
        out[name] = joined.withColumn(column, fixed).select(*tables[name].columns)

    dead_files = gone.select("file_id").distinct()
    dead_symbols = tables["symbols"].join(dead_files, "file_id", "left_semi").select("symbol_id")
    dead_endpoints = tables["endpoints"].join(dead_files, "file_id", "left_semi").select("endpoint_id")
    dead_sinks = tables["candidate_sinks"].join(dead_files, "file_id", "left_semi").select("sink_id")
    for name in ("files", "symbols", "endpoints", "candidate_sinks"):
        without(name, "file_id", dead_files, "file_id")
    nulled("endpoints", "handler_symbol_id", dead_symbols, "symbol_id")
    nulled("candidate_sinks", "symbol_id", dead_symbols, "symbol_id")
    edges = tables["graph_edges"]
    touched = dead_symbols.select(F.col("symbol_id").alias("_k")).distinct()
    dead_edges = edges.join(touched, edges["caller_symbol_id"] == touched["_k"], "left_semi").select("edge_id").union(
        edges.join(touched, edges["callee_symbol_id"] == touched["_k"], "left_semi").select("edge_id")
    ).distinct()
    without("graph_edges", "edge_id", dead_edges, "edge_id")
    without("graph_edge_evidence", "edge_id", dead_edges, "edge_id")
    paths = tables["scan_candidate_paths"]
    dead_paths = paths.join(dead_sinks, "sink_id", "left_semi").select("path_id").union(
        paths.join(dead_endpoints, "endpoint_id", "left_semi").select("path_id")
    ).distinct()
    without("scan_candidate_paths", "path_id", dead_paths, "path_id")
    nulled("scan_dossiers", "path_id", dead_paths, "path_id")
    return out


#: Parts of a new table. A table keeps the number that it was made with.
PARTS = 64


def part_of(table: str, parts: int) -> Column:
    """The part of a row: a hash of its key, or of what it refers to where the table has no key."""
    spec = S.TABLES[table]
    return F.pmod(F.xxhash64(*(spec.key or spec.foreign)), F.lit(parts)).cast("int").alias("part")


class Store:
    """Tables in a folder, dealt to parts; a version of the parts that a write touches.

    What is current is named by the last commit, a file that lists the versions of every part and appears whole
    (written beside, then renamed). What is written inside one ``transaction`` is therefore seen together: a writer that
    dies in between leaves the state before it. One writer at a time.
    """

    COMMITS = "_commits"

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._staged: dict | None = None
        self._made: set[str] = set()

    def _names(self, folder: str, prefix: str, suffix: str = "") -> list[int]:
        """The numbers in the names prefix + number + suffix of a folder's entries."""
        where = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(where):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(where)]
        return sorted(int(n.removeprefix(prefix).removesuffix(suffix)) for n in names if n.startswith(prefix) and n.endswith(suffix))

    def _commit_file(self, number: int) -> dict:
        """table -> {"parts": how many, "at": part -> versions}."""
        stream = self._fs.open(self._path(f"{self.root}/{self.COMMITS}/c{number}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _current(self) -> tuple[int, dict]:
        commits = self._names(self.COMMITS, "c", ".json")
        return (commits[-1], self._commit_file(commits[-1])) if commits else (0, {})

    @staticmethod
    def _folders(state: dict, table: str, only: list[int] | None = None) -> list[str]:
        """Folders below the root that hold a table's parts, or some of them."""
        at = state.get(table, {"at": {}})["at"]
        return [f"{table}/v{v}/part={p}" for p, versions in at.items() if only is None or int(p) in only for v in versions]

    def read(self, table: str, only: list[int] | None = None) -> DataFrame:
        """The current rows, or those of some parts, in the current shape: columns that an older version lacks have their defaults."""
        folders = self._folders(self._staged if self._staged is not None else self._current()[1], table, only)
        schema = S.TABLES[table].schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return S.evolve(self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]), table)

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """All that is written inside becomes current together, at the end, or not at all; reads inside see it at once.

        A transaction inside another is part of it.
        """
        if self._staged is not None:
            yield
            return
        number, before = self._current()
        self._staged, self._made = deepcopy(before), set()
        try:
            yield
            self._publish(number, before)
        finally:
            self._staged = None

    def _publish(self, number: int, before: dict) -> None:
        beside = self._path(f"{self.root}/{self.COMMITS}/_new-{uuid.uuid4().hex}")
        out = self._fs.create(beside)
        out.write(bytearray(json.dumps(self._staged, sort_keys=True).encode()))
        out.close()
        target = f"{self.root}/{self.COMMITS}/c{number + 1}.json"
        if not self._fs.rename(beside, self._path(target)):
            raise OSError(f"{target} could not be written")
        # Readers of the state before may still be at work; what only earlier states or dead writers have left goes.
        kept = self._made | {f for state in (before, self._staged) for table in state for f in self._folders(state, table)}
        for table in {f.split("/")[0] for f in self._made}:
            for version in self._names(table, "v"):
                parts = [f"{table}/v{version}/part={p}" for p in self._names(f"{table}/v{version}", "part=")]
                gone = [f for f in parts if f not in kept] if any(f in kept for f in parts) else [f"{table}/v{version}"]
                for folder in gone:
                    self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        for old in self._names(self.COMMITS, "c", ".json"):
            if old < number:
                self._fs.delete(self._path(f"{self.root}/{self.COMMITS}/c{old}.json"), False)

    def _write(self, table: str, df: DataFrame) -> tuple[dict, int]:
        """Write ``df``'s rows by parts as a new version: what is staged of the table, and the version."""
        own = self._staged.setdefault(table, {"parts": self.parts, "at": {}})
        version = max(self._names(table, "v"), default=0) + 1
        dealt = S.evolve(df, table).withColumn("part", part_of(table, own["parts"]))
        # One shuffle by part; Spark splits a part that is much larger than others and joins small ones.
        dealt.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.root}/{table}/v{version}")
        self._made |= {f"{table}/v{version}/part={p}" for p in self._names(f"{table}/v{version}", "part=")}
        return own, version

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """These tables anew, whole, current at once."""
        with self.transaction():
            for table, df in tables.items():
                own, version = self._write(table, df)
                own["at"] = {str(p): [version] for p in self._names(f"{table}/v{version}", "part=")}

    def write(self, table: str, df: DataFrame) -> DataFrame:
        self.commit({table: df})
        return self.read(table)

    def merged(self, table: str, delta: DataFrame, seq: str | None = None) -> DataFrame:
        """The table as it would be with ``delta`` merged in."""
        return upsert_table(table, self.read(table), delta, seq)

    def merge(self, table: str, delta: DataFrame, seq: str | None = None) -> DataFrame:
        """Merge ``delta`` in: only the parts of its keys are read and written. Rows of a table without key are added as they are."""
        spec = S.TABLES[table]
        with self.transaction():
            if not spec.key:
                own, version = self._write(table, shaped(table, delta))
                for p in self._names(f"{table}/v{version}", "part="):
                    own["at"].setdefault(str(p), []).append(version)
                return self.read(table)
            rows = materialize(shaped(table, delta, seq), "merge-delta")
            parts = self._staged.get(table, {"parts": self.parts})["parts"]
            touched = [r["part"] for r in rows.select(part_of(table, parts)).distinct().collect()]  # at most so many numbers
            if touched:
                own, version = self._write(table, upsert(self.read(table, touched), rows, list(spec.key), list(spec.kept), seq))
                own["at"] |= {str(p): [version] for p in touched}
            release(rows)
            return self.read(table)

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], touched: DataFrame | None = None) -> DataFrame:
        """The table after ``change``; with ``touched`` (rows that have the table's key, or what it refers to), only their parts are read and written.

        ``change`` must keep the rows of a part in it.
        """
        if touched is None:
            return self.write(table, change(self.read(table)))
        with self.transaction():
            own = self._staged.get(table)
            if own is not None:
                parts = [r["part"] for r in touched.select(part_of(table, own["parts"])).distinct().collect()]
                parts = [p for p in parts if str(p) in own["at"]]
                if parts:
                    own, version = self._write(table, change(self.read(table, parts)))
                    own["at"] |= {str(p): [version] for p in parts}
            return self.read(table)


def resolve_paths(paths: DataFrame, found: DataFrame) -> DataFrame:
    """``paths`` after those in ``found`` (path_id, reachability_confidence) are resolved; the others stay as they are."""
    new = found.select("path_id", F.col("reachability_confidence").alias("_reach"), F.lit(True).alias("_hit"))
    joined = paths.join(new, "path_id", "left")
    columns = {"state": F.lit("RESOLVED"), "reachability_confidence": F.col("_reach"), "updated_at": F.current_timestamp()}
    own = {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in columns.items() if c in paths.columns}
    return joined.withColumns(own).select(*paths.columns)


def close_scan(scans: DataFrame, scan_id: str, status: str, stats: dict[str, str] | None = None) -> DataFrame:
    """The status of one scan; it is completed now only in a terminal state, and old stats stay without new ones."""
    own = F.col("scan_id") == scan_id
    new_stats = F.create_map(*[F.lit(x) for pair in (stats or {}).items() for x in pair]) if stats else F.col("stats")
    return scans.withColumns({
        "status": F.when(own, status).otherwise(F.col("status")),
        "completed_at": F.when(own & F.lit(status in S.TERMINAL_STATES), F.current_timestamp()).otherwise(F.col("completed_at")),
        "stats": F.when(own, new_stats).otherwise(F.col("stats")),
    })

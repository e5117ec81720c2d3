"""What changed since the last scan, and reports of a scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions.scoring import engine_fingerprint
from casegraph.operators.graph import edges_with_evidence, graph_scope
from casegraph.operators.incremental import all_changed, change_feed, impact_plan, reusable_dossiers, snapshot_diff
from casegraph.operators.matching import of_scan
from casegraph.operators.report import graph_lines, markdown_lines, sarif_lines, severity_order
from casegraph.operators.store import Store, deactivate, delete_files, invalidated, reopen
from casegraph.scratch import materialize, release
from casegraph.sources.files import scan_repository
from casegraph.sources.sinks import write_document

FORMATS = ("md", "sarif", "graph")


@dataclass
class DiffPlan:
    """The fate of every path, and the dossiers that can be used again."""

    paths: DataFrame
    reusable: DataFrame
    engine_fingerprint: str


def diff(
    spark: SparkSession, root: str, audit: str, config: dict[str, str] | None = None, lockfile: bytes | None = None,
    tracked: DataFrame | None = None, untracked: DataFrame | None = None, everything: bool = False,
) -> DiffPlan:
    """Compare the repository with the index; deactivate what changed, delete what is gone.

    What changed is the difference of content hashes, which needs no version control; or the names (rel_path) that
    version control gives, ``tracked`` against the base and ``untracked``; or ``everything``, where nothing is known.
    """
    store = Store(spark, audit)
    current = scan_repository(spark, root).select("rel_path", "file_hash")
    indexed = store.read("files")
    if everything:
        named = all_changed(current)
    elif tracked is not None or untracked is not None:
        none = current.select("rel_path").limit(0)
        named = change_feed(tracked if tracked is not None else none, untracked if untracked is not None else none)
    else:
        named = snapshot_diff(indexed.select("rel_path", "file_hash"), current).filter("status <> 'UNCHANGED'").select("rel_path")
    changed = materialize(named, "diff-changed")
    plan = materialize(impact_plan(changed, current, indexed), "diff-plan")
    fingerprint = engine_fingerprint(config or {"mode": "FULL"}, lockfile)

    gone = plan.filter("status = 'DELETED' and file_id is not null").select("file_id")
    names = ("files", "symbols", "endpoints", "candidate_sinks", "graph_edges", "graph_edge_evidence", "scan_candidate_paths", "scan_dossiers")
    tables = {n: store.read(n) for n in names}
    after: dict[str, DataFrame] = {}
    if not gone.isEmpty():
        after = {n: materialize(d, f"diff-{n}") for n, d in delete_files(tables, gone).items()}
        tables |= after
    touched = plan.filter("status = 'CHANGED' and file_id is not null").select("file_id")
    found = invalidated(tables["graph_edges"], tables["scan_candidate_paths"], tables["symbols"], tables["candidate_sinks"], touched)
    edges, paths = (materialize(rows, "diff-invalid") for rows in found)
    with store.transaction():  # all tables change together, or none does
        if after:
            store.commit(after)
        # Only the parts that hold what is invalid are rewritten.
        store.update("graph_edge_evidence", lambda rows: deactivate(rows, edges), touched=edges)
        store.update("scan_candidate_paths", lambda rows: reopen(rows, paths), touched=paths)
    reusable = reusable_dossiers(
        store.read("scan_dossiers"), store.read("scan_candidate_paths"), store.read("candidate_sinks"), store.read("files"), changed, fingerprint
    )
    return DiffPlan(plan, reusable, fingerprint)


def report_lines(spark: SparkSession, audit: str, scan_id: str | None, kind: str = "md", scope: str = "repository", key: str | None = None) -> DataFrame:
    """(part, ord, text): a scan's report in pieces: Markdown, SARIF, or a graph of the given scope."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    store = Store(spark, audit)
    if kind == "graph":
        nodes = graph_scope(store.read, scope, key)
        edges = None
        if scope in ("repository", "symbol"):
            edges = edges_with_evidence(store.read("graph_edges"), store.read("graph_edge_evidence")).drop("edge_id")
        return graph_lines(nodes.withColumnRenamed("node_kind", "kind"), edges)
    dossiers = severity_order(of_scan(store.read("scan_dossiers"), scan_id))
    return markdown_lines(dossiers, scan_id) if kind == "md" else sarif_lines(dossiers)


def report_pieces(spark: SparkSession, audit: str, scan_id: str | None, kind: str = "md", scope: str = "repository", key: str | None = None) -> Iterator[str]:
    """A scan's report piece by piece, for standard output: range-sorted by tasks, and a part at a time at the driver."""
    pieces = materialize(report_lines(spark, audit, scan_id, kind, scope, key), "report")
    ordered = pieces.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("text")
    yield from (row["text"] for row in ordered.toLocalIterator())


def report_file(spark: SparkSession, audit: str, scan_id: str | None, path: str, kind: str = "md", scope: str = "repository", key: str | None = None) -> None:
    """A scan's report as a file in any store: tasks write the sorted pieces, the commit publishes the document."""
    pieces = materialize(report_lines(spark, audit, scan_id, kind, scope, key), "report")
    write_document(pieces, path, "part", "ord")
    release(pieces)


def report(spark: SparkSession, audit: str, scan_id: str | None, kind: str = "md", scope: str = "repository", key: str | None = None) -> str:
    """``report_pieces`` as one text."""
    return "".join(report_pieces(spark, audit, scan_id, kind, scope, key))

"""A scan from files to dossiers, and resuming one.

Stages up to detection are independent DataFrames over one table of files;
matching, gating and reporting are one plan with the path search in its middle.
All tables of a scan are committed together: one that dies leaves the state before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.functions.scoring import LOCKFILES, engine_fingerprint, finding_fingerprint, scan_priority
from casegraph.functions.text import basename
from casegraph.operators.classify import authz_relevant, classify_scope, eligible
from casegraph.operators.detect import SINKS, analyze_authorization, detect, veto_sinks
from casegraph.operators.graph import graph_edges
from casegraph.operators.indexer import calls_of, index_files, link_calls, symbols_of
from casegraph.operators.matching import first_endpoints, gated_items, indexable, innermost_symbols, of_scan, pending_paths, placeholder_files
from casegraph.operators.report import blueprints, dossier_records
from casegraph.operators.routes import RESOLVERS, identify_framework
from casegraph.operators.store import Store, close_scan, resolve_paths, surrogate
from casegraph.operators.verify import gate_bundles
from casegraph.scratch import materialize
from casegraph.sources.files import lines_of, scan_repository, stripped_code_lines
from casegraph.sources.tools import read_tools
from casegraph.streaming.events import StoreEventLog


def lockfile_of(spark: SparkSession, root: str) -> bytes | None:
    """The first lockfile of the repository, wherever Spark can read it."""
    jvm = spark.sparkContext._jvm
    for name in LOCKFILES:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            stream = fs.open(path)
            try:
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
    return None


def index_repository(spark: SparkSession, store: Store, root: str) -> None:
    """Files, endpoints, sinks, symbols and edges of a repository into the store."""
    described = materialize(scan_repository(spark, root), "scan-files")
    scoped = classify_scope(described)
    files = store.merge("files", scoped.drop("text"))
    known = scoped.join(files.select("rel_path", "file_id"), "rel_path")
    code = materialize(indexable(known), "scan-code")

    symbols_found = index_files(code.select("rel_path", "language", "text"))
    symbols_found = materialize(symbols_found.join(code.select("rel_path", "file_id"), "rel_path"), "scan-index")
    store.merge("symbols", symbols_of(symbols_found).join(code.select("rel_path", "file_id"), "rel_path").drop("rel_path"), "seq")
    symbols = store.read("symbols")

    framework = identify_framework(described.select("rel_path", "text")).first()
    resolver = RESOLVERS.get(framework["framework"]) if framework else None
    if resolver is not None:
        routes = resolver(described.select("rel_path", "text")).join(files.select("rel_path", "file_id"), "rel_path")
        named = symbols.groupBy("file_id", "name").agg(F.max("symbol_id").alias("handler_symbol_id"))
        routes = routes.join(named, (routes["handler_symbol"] == named["name"]) & (routes["file_id"] == named["file_id"]), "left").drop(named["file_id"], named["name"])
        routes = routes.withColumns({"auth_required": F.col("auth_state") == "REQUIRED", "tool_provenance": F.lit("ExpressResolver")})
        store.merge("endpoints", routes.select("file_id", "http_method", "route_pattern", "handler_symbol_id", "line_number", "auth_state", "auth_required", "tool_provenance", "seq"), "seq")

    lines = stripped_code_lines(lines_of(code.select("rel_path", "text")))
    hits = veto_sinks(detect(lines, SINKS)).join(code.select("rel_path", "file_id", "execution_domain"), "rel_path")
    hits = hits.filter(eligible(F.col("execution_domain"), F.col("name")))
    sinks = hits.select(
        "file_id", F.col("name").alias("vuln_class"), F.col("severity").alias("triage_severity"), F.col("line").cast("int").alias("line_number"),
        F.col("cwe").alias("cwe_id"), F.col("expression").alias("sink_expression"), F.concat(F.lit("SEMANTIC_"), "name").alias("raw_rule_id"),
        F.lit("SemanticDetector").alias("tool_provenance"), "ord",
    )
    # Authorization gaps look at whole files, whatever their scope; their line is 1.
    handlers = code.filter(authz_relevant(F.col("rel_path"))).select("file_id", F.col("rel_path").alias("route"), F.col("text").alias("code"))
    gaps = analyze_authorization(handlers).filter("has_gap").select(
        "file_id", F.lit("BOLA_IDOR").alias("vuln_class"), F.lit("HIGH").alias("triage_severity"), F.lit(1).alias("line_number"),
        F.lit("CWE-639").alias("cwe_id"), F.col("retrieval_op").alias("sink_expression"), F.lit("AUTHZ_GAP").alias("raw_rule_id"),
        F.lit("AuthorizationAnalyzer").alias("tool_provenance"), F.lit(0).cast("long").alias("ord"),
    )
    found = sinks.unionByName(gaps)
    # A sink belongs to the innermost symbol around its line.
    store.merge("candidate_sinks", innermost_symbols(found, symbols), "ord")

    calls = calls_of(symbols_found).join(code.select("rel_path", "file_id"), "rel_path")
    links = link_calls(calls.select("file_id", "caller_scope", "callee_name"), symbols.select("file_id", "name", "symbol_id", F.struct("start_line", "start_col").alias("seq")))
    edges = store.merge("graph_edges", links.withColumn("edge_type", F.lit("CALLS")))
    known_evidence = store.read("graph_edge_evidence").filter("is_active").select("edge_id")
    fresh = edges.join(known_evidence, "edge_id", "left_anti").select(
        surrogate(["edge_id"]).alias("evidence_id"), "edge_id", F.lit("DETERMINISTIC_AST").alias("resolution_method"), F.lit(0.95).alias("confidence"),
        F.lit(True).alias("is_active"), F.current_timestamp().alias("created_at"),
    )
    store.merge("graph_edge_evidence", fresh)


def merge_tool_output(store: Store, endpoints: DataFrame | None = None, findings: DataFrame | None = None, secrets: DataFrame | None = None) -> None:
    """Rows of the tool readers into the store.

    Items in files that are out of scope for their class are dropped (endpoints have no class); a file
    that was never discovered is allowed, and gets a placeholder row. Secrets leave placeholders only.
    """
    given = [df for df in (endpoints, findings, secrets) if df is not None]
    if not given:
        return
    discovered = materialize(store.read("files").select("rel_path", "execution_domain"), "tool-files")
    names = None
    for df in given:
        own = df.select("rel_path")
        names = own if names is None else names.union(own)
    store.merge("files", placeholder_files(names, discovered))
    known = store.read("files").select("rel_path", "file_id")

    if endpoints is not None:
        kept = gated_items(endpoints, discovered, F.lit("")).join(known, "rel_path")
        store.merge("endpoints", kept.select("file_id", "http_method", "route_pattern", "line_number", "auth_required", "parameters", "tool_provenance", F.lit(0).alias("seq")), "seq")
    if findings is not None:
        kept = gated_items(findings, discovered, F.col("vuln_class")).join(known, "rel_path")
        store.merge("candidate_sinks", kept.select("file_id", "vuln_class", "triage_severity", "line_number", "cwe_id", "sink_expression", "raw_rule_id", "tool_provenance", F.lit(0).alias("seq")), "seq")


def match_sinks(store: Store, sinks: DataFrame, same_file: bool = True) -> DataFrame:
    """``first_endpoints`` over the store's graph."""
    endpoints = store.read("endpoints")
    edges = graph_edges(endpoints, store.read("candidate_sinks"), store.read("graph_edges"), store.read("graph_edge_evidence"))
    return first_endpoints(sinks, endpoints, edges, same_file)


def judge(matched: DataFrame, files: DataFrame, endpoints: DataFrame, scan_id: str, fingerprint: str) -> DataFrame:
    """Dossiers of matched sinks: verdict, blueprint, fingerprint, trace."""
    rows = matched.join(files.select("file_id", "rel_path", "execution_domain"), "file_id")
    rows = rows.join(endpoints.select("endpoint_id", "http_method", "route_pattern", "auth_state"), "endpoint_id", "left")
    found = F.col("endpoint_id").isNotNull()
    rows = rows.withColumns({
        "source_node": F.when(found, F.concat(F.lit("ep_"), "endpoint_id")), "sink_node": F.concat(F.lit("sink_"), "sink_id"),
        "path_trace": F.when(found, F.col("nodes")), "effective": F.lit(False), "partial": F.lit(False), "agent_turns": F.lit(0),
        "bypass_reasoning": F.lit(""), "reach": F.coalesce("reach", F.lit(0.0)),
    })
    judged = gate_bundles(rows)
    name = F.when(F.col("vuln_class") == "SSRF", "url").when(F.col("vuln_class") == "BOLA_IDOR", "id").otherwise("q")
    judged = judged.withColumns({
        "method": F.col("http_method"), "route": F.col("route_pattern"), "param_name": name,
        "param_location": F.when(F.col("http_method") == "GET", "QUERY").otherwise("BODY"),
        "siblings": F.lit(None).cast("array<struct<location:string,name:string,dummy:string>>"), "sink": F.col("sink_expression"),
    })
    shown = blueprints(judged)
    endpoint = F.when(found, F.concat_ws(" ", "http_method", "route_pattern")).otherwise("NONE")
    place = F.concat_ws(":", "rel_path", F.col("line_number").cast("string"))
    records = dossier_records(
        shown.withColumns({
            "dossier_id": F.concat(F.lit(f"dos_{scan_id}_"), "sink_id"), "path_id": F.concat(F.lit(f"path_{scan_id}_"), "sink_id"),
            "title": F.concat("vuln_class", F.lit(" in "), basename(F.col("rel_path")), F.lit(":"), F.col("line_number").cast("string")),
            "severity": F.col("triage_severity"), "reachability_confidence": F.col("reach"),
            "finding_fingerprint": finding_fingerprint(F.col("vuln_class"), endpoint, F.lit("HTTP"), F.col("sink_expression"), place),
            "source_trace": F.array(F.struct(F.col("rel_path").alias("file"), F.col("line_number").alias("line"))),
            "sanitizer_analysis": F.create_map(F.lit("bypass_analysis"), F.col("reasoning")),
            "evidence_bundle": F.create_map(F.lit("path_trace_len"), F.coalesce(F.size("path_trace"), F.lit(0)).cast("string")),
            "repro_curl_template": F.col("curl_command"), "mitigation_notes": F.lit(""),
        }),
        scan_id, fingerprint, ("sink_id", "endpoint_id", "hops", "nodes", "triage_severity"),
    )
    return records


def _record(store: Store, found: DataFrame, scan_id: str, known: bool = False) -> None:
    """Paths and dossiers into the store, together; ``known``: the paths are there and are resolved."""
    paths = found.select(
        "path_id", "scan_id", "endpoint_id", "sink_id", F.coalesce("hops", F.lit(0)).alias("hop_count"),
        F.coalesce("nodes", F.array().cast("array<string>")).alias("call_sequence"), scan_priority(F.col("triage_severity")).alias("priority_score"),
        "reachability_confidence", F.lit("RESOLVED").alias("state"), F.lit(0).alias("retry_count"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )
    dossiers = found.drop("sink_id", "endpoint_id", "hops", "nodes", "triage_severity")
    with store.transaction():
        if known:
            # Only the rows that are resolved are merged, not all paths of all scans.
            waiting = store.read("scan_candidate_paths").join(paths.select("path_id"), "path_id", "left_semi")
            paths = resolve_paths(waiting, paths)
        store.merge("scan_candidate_paths", paths)
        store.merge("scan_dossiers", dossiers)


def _close(store: Store, scan_id: str, status: str) -> None:
    store.merge("scans", close_scan(of_scan(store.read("scans"), scan_id), scan_id, status))


def scan(
    spark: SparkSession, root: str, audit: str, config: dict[str, str] | None = None,
    endpoints: DataFrame | None = None, findings: DataFrame | None = None, secrets: DataFrame | None = None,
    tools: dict[str, DataFrame] | None = None,
) -> str:
    """Scan the repository at ``root`` into the store at ``audit``; the scan's id.

    ``endpoints``, ``findings`` and ``secrets`` are rows of the tool readers, if tools have run; or ``tools`` has the
    tools' raw output by name.
    """
    store = Store(spark, audit)
    config = {"mode": "FULL", **(config or {})}
    fingerprint = engine_fingerprint(config, lockfile_of(spark, root))
    scan_id = f"scan_{uuid.uuid4().hex[:12]}"
    log = StoreEventLog(spark, f"{audit}/events/{scan_id}", scan_id)
    log.log("Scan", "SCAN_STARTED", {"root": root})
    head = spark.createDataFrame(
        [(scan_id, root, "FULL", fingerprint, "INITIALIZING")], "scan_id string, target_path string, scan_mode string, engine_fingerprint string, status string"
    ).withColumns({"started_at": F.current_timestamp(), "config": F.create_map(*[F.lit(x) for p in config.items() for x in p])})
    store.merge("scans", head)
    if tools:
        read = read_tools(tools)
        endpoints, findings, secrets = (given if given is not None else read.get(kind) for given, kind in ((endpoints, "endpoints"), (findings, "findings"), (secrets, "secrets")))
    with store.transaction():
        index_repository(spark, store, root)
        merge_tool_output(store, endpoints, findings, secrets)
        matched = match_sinks(store, store.read("candidate_sinks"))
        found = materialize(judge(matched, store.read("files"), store.read("endpoints"), scan_id, fingerprint), "scan-dossiers")
        _record(store, found, scan_id)
        _close(store, scan_id, "COMPLETED")
    log.log("Scan", "PATH_TRANSITION", {"state": "RESOLVED"})
    return scan_id


def resume(spark: SparkSession, audit: str, scan_id: str) -> int:
    """Resolve a scan's pending paths by graph paths alone; how many there were."""
    store = Store(spark, audit)
    sinks = store.read("candidate_sinks")
    waiting = pending_paths(store.read("scan_candidate_paths"), sinks, store.read("files"), scan_id)
    count = waiting.count()
    with store.transaction():
        _resume(store, sinks, waiting, scan_id, count)
    return count


def _resume(store: Store, sinks: DataFrame, waiting: DataFrame, scan_id: str, count: int) -> None:
    if count:
        chosen = sinks.join(waiting.select("sink_id"), "sink_id", "left_semi")
        fingerprint = store.read("scans").filter(F.col("scan_id") == scan_id).select("engine_fingerprint").first()[0]
        matched = match_sinks(store, chosen, same_file=False)
        found = materialize(judge(matched, store.read("files"), store.read("endpoints"), scan_id, fingerprint), "resume-dossiers")
        _record(store, found, scan_id, known=True)
    _close(store, scan_id, "COMPLETED")


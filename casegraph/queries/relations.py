"""Joins, upserts, invalidation, ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.functions.scoring import finding_fingerprint, priority_score, scan_priority
from casegraph.operators.graph import active, edges_with_evidence
from casegraph.operators.incremental import cached_results, impact_plan, latest_by, reusable_dossiers
from casegraph.operators.indexer import link_calls
from casegraph.operators.matching import innermost_symbols, located, pending_paths, placeholder_files, symbol_by_name, symbols_by_name
from casegraph.operators.store import close_scan, delete_files, invalidate_files, resolve_paths, upsert_table
from casegraph.operators.triage import first_pushes, pop_order, top
from casegraph.operators.verify import gate_arguments, gate_bundles
from casegraph.queries import register, table
from casegraph.queries.standins import SEVERITY_SQL


@register("join_inner", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks = table(spark, sf_dir, "supplier").withColumn("file_id", F.col("s_nationkey"))
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("rel_path"))
    return located(sinks, files).select("s_suppkey", "s_name", F.col("rel_path").alias("n_name"))


def _pending(spark: SparkSession, sf_dir: str, scan_id: str) -> DataFrame:
    """Orders as paths of one scan per priority, customers as sinks, nations as files."""
    state = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("RESOLVED")
    paths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path_id"), F.col("o_orderpriority").alias("scan_id"), F.col("o_custkey").alias("sink_id"), state.alias("state"))
    sinks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sink_id"), F.col("c_nationkey").alias("file_id"), "c_name")
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("rel_path"))
    return pending_paths(paths, sinks, files, scan_id)


@register("join_chain3", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT'")
def join_chain3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir, "1-URGENT").select(F.col("path_id").alias("o_orderkey"), "c_name", F.col("rel_path").alias("n_name"))


@register("join_chain4", "SELECT l_orderkey * 10 + l_linenumber AS dossier_id, n_name AS rel_path FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' AND n_nationkey % 5 <> 0")
def join_chain4(spark: SparkSession, sf_dir: str) -> DataFrame:
    dossiers = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("dossier_id"), F.col("l_orderkey").alias("path_id"), F.col("l_returnflag").alias("engine_fingerprint")
    )
    paths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path_id"), F.col("o_custkey").alias("sink_id"))
    sinks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sink_id"), F.col("c_nationkey").alias("file_id"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("rel_path"))
    return reusable_dossiers(dossiers, paths, sinks, nations, nations.filter("file_id % 5 = 0"), "R")


def _edges_and_evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("caller_symbol_id"))
    evidence = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(
        F.col("l_orderkey").alias("edge_id"), F.concat(F.lit("M"), "l_linestatus").alias("resolution_method"),
        (1 - F.col("l_discount")).alias("confidence"), (F.col("l_returnflag") != "R").alias("is_active"),
    )
    return edges, evidence


EVIDENCE_SQL = """SELECT o_orderkey AS edge_id, o_custkey AS caller_symbol_id, coalesce('M' || l_linestatus, 'DETERMINISTIC') AS provenance, coalesce(1 - l_discount, 1.0) AS confidence
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 AND l_returnflag <> 'R'"""


@register("left_on_predicate_coalesce", EVIDENCE_SQL)
def left_on_predicate_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_with_evidence(*_edges_and_evidence(spark, sf_dir))


@register("edges_for_caller", f"SELECT * FROM ({EVIDENCE_SQL}) WHERE caller_symbol_id = 7")
def edges_for_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_with_evidence(*_edges_and_evidence(spark, sf_dir)).filter("caller_symbol_id = 7")


@register("active_evidence", "SELECT l_orderkey AS edge_id, 1 - l_discount AS confidence FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R'")
def active_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active(_edges_and_evidence(spark, sf_dir)[1]).select("edge_id", "confidence")


@register("evidence_of_edge", "SELECT l_orderkey AS edge_id, 1 - l_discount AS confidence FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R' AND l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R')")
def evidence_of_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _edges_and_evidence(spark, sf_dir)[1]
    return active(evidence, active(evidence).agg(F.min("edge_id")).first()[0]).select("edge_id", "confidence")


def _impact(spark: SparkSession, sf_dir: str, changed: DataFrame) -> DataFrame:
    """Customers as files, all indexed and all there."""
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("rel_path"), F.col("c_custkey").alias("file_id"))
    return impact_plan(changed.select(F.col("o_custkey").cast("string").alias("rel_path")), files, files)


@register("anti_unaffected", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_unaffected(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _impact(spark, sf_dir, table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"))
    return plan.filter("status = 'UNAFFECTED'").select(F.col("file_id").alias("c_custkey"))


@register("anti_reusable", """SELECT 'd' || CAST(o_orderkey AS VARCHAR) AS dossier_id, c_name AS rel_path FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1
JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '2-HIGH' AND c_custkey % 5 <> 0""")
def anti_reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    dossiers = orders.select(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("dossier_id"), F.col("o_orderkey").alias("path_id"), F.col("o_orderpriority").alias("engine_fingerprint"))
    paths = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("path_id"), F.col("l_orderkey").alias("sink_id"))
    sinks = orders.select(F.col("o_orderkey").alias("sink_id"), F.col("o_custkey").alias("file_id"))
    files = customer.select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("rel_path"))
    changed = customer.filter("c_custkey % 5 = 0").select(F.col("c_name").alias("rel_path"))
    return reusable_dossiers(dossiers, paths, sinks, files, changed, "2-HIGH")


@register("semi_modified", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')")
def semi_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _impact(spark, sf_dir, table(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'"))
    return plan.filter("status = 'CHANGED'").select(F.col("file_id").alias("c_custkey"))


def _model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Suppliers as files, parts as symbols, lineitems as edges with evidence, first lines as sinks and paths."""
    line = table(spark, sf_dir, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id")
    first = line.filter("l_linenumber = 1")
    return {
        "files": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id")),
        "symbols": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 50 + 1).alias("file_id")),
        "endpoints": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("endpoint_id"), (F.col("c_custkey") % 50 + 1).alias("file_id"), (F.col("c_custkey") % 500 + 1).alias("handler_symbol_id")),
        "candidate_sinks": first.select(F.col("l_orderkey").alias("sink_id"), (F.col("l_suppkey") % 50 + 1).alias("file_id"), F.col("l_partkey").alias("symbol_id")),
        "graph_edges": line.select(key, F.col("l_partkey").alias("caller_symbol_id"), (F.col("l_partkey") % 97 + 1).alias("callee_symbol_id")),
        "graph_edge_evidence": line.select(key, F.lit(True).alias("is_active")),
        "scan_candidate_paths": first.select(F.col("l_orderkey").cast("string").alias("path_id"), F.col("l_orderkey").alias("sink_id"), (F.col("l_orderkey") % 900 + 1).alias("endpoint_id"), F.lit("QUEUED").alias("state")),
        "scan_dossiers": first.select(F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("dossier_id"), F.col("l_orderkey").cast("string").alias("path_id")),
    }


MODEL_SQL = """e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_partkey AS a, l_partkey % 97 + 1 AS b FROM lineitem),
sy AS (SELECT p_partkey AS s, p_partkey % 50 + 1 AS f FROM part), snk AS (SELECT l_orderkey AS k, l_suppkey % 50 + 1 AS f, l_partkey AS s FROM lineitem WHERE l_linenumber = 1)"""


@register("semi_disjunctive", f"WITH {MODEL_SQL} SELECT edge_id, edge_id NOT IN (SELECT edge_id FROM e WHERE a IN (SELECT s FROM sy WHERE f IN (3, 4)) OR b IN (SELECT s FROM sy WHERE f IN (3, 4))) AS is_active FROM e")
def semi_disjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _model(spark, sf_dir)
    evidence, _ = invalidate_files(m["graph_edges"], m["graph_edge_evidence"], m["scan_candidate_paths"], m["symbols"], m["candidate_sinks"], m["files"].filter("file_id in (3, 4)"))
    return evidence.select("edge_id", "is_active")


@register("invalidate_file", f"WITH {MODEL_SQL} SELECT CAST(k AS VARCHAR) AS path_id, CASE WHEN k IN (SELECT k FROM snk WHERE f IN (3, 4)) THEN 'UNRESOLVED' ELSE 'QUEUED' END AS state FROM snk")
def invalidate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _model(spark, sf_dir)
    _, paths = invalidate_files(m["graph_edges"], m["graph_edge_evidence"], m["scan_candidate_paths"], m["symbols"], m["candidate_sinks"], m["files"].filter("file_id in (3, 4)"))
    return paths.select("path_id", "state")


def _deleted(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    m = _model(spark, sf_dir)
    return delete_files(m, m["files"].filter("file_id in (3, 4)"))


@register("delete_cascade", f"""WITH {MODEL_SQL}, ds AS (SELECT s FROM sy WHERE f IN (3, 4)), de AS (SELECT edge_id FROM e WHERE a IN (SELECT s FROM ds) OR b IN (SELECT s FROM ds)),
dp AS (SELECT k FROM snk WHERE f IN (3, 4) UNION SELECT k FROM snk WHERE (k % 900 + 1) % 50 + 1 IN (3, 4) AND k % 900 + 1 IN (SELECT c_custkey FROM customer))
SELECT 'edges' AS t, count(*) AS n FROM e WHERE edge_id NOT IN (SELECT edge_id FROM de)
UNION ALL SELECT 'symbols', count(*) FROM sy WHERE f NOT IN (3, 4) UNION ALL SELECT 'sinks', count(*) FROM snk WHERE f NOT IN (3, 4)
UNION ALL SELECT 'paths', count(*) FROM snk WHERE k NOT IN (SELECT k FROM dp)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = _deleted(spark, sf_dir)
    names = {"edges": "graph_edges", "symbols": "symbols", "sinks": "candidate_sinks", "paths": "scan_candidate_paths"}
    out = None
    for short, name in names.items():
        row = after[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(short).alias("t"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@register("set_null", f"""WITH {MODEL_SQL} SELECT 'd' || CAST(k AS VARCHAR) AS dossier_id, CASE WHEN k IN (SELECT k FROM snk WHERE f IN (3, 4)) OR (k % 900 + 1 IN (SELECT c_custkey FROM customer) AND (k % 900 + 1) % 50 + 1 IN (3, 4)) THEN NULL ELSE CAST(k AS VARCHAR) END AS path_id FROM snk""")
def set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)["scan_dossiers"].select("dossier_id", "path_id")


@register("intrafile_link", """WITH n AS (SELECT conv_id, role, arg_max(turn, turn) AS id FROM conversations GROUP BY ALL),
p AS (SELECT conv_id, role AS callee, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS caller FROM conversations)
SELECT DISTINCT p.conv_id * 1000 + a.id AS caller_symbol_id, p.conv_id * 1000 + b.id AS callee_symbol_id FROM p JOIN n a ON a.conv_id = p.conv_id AND a.role = p.caller
JOIN n b ON b.conv_id = p.conv_id AND b.role = p.callee WHERE a.id <> b.id""")
def intrafile_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    symbols = turns.select(F.col("conv_id").alias("file_id"), F.col("role").alias("name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("symbol_id"), F.col("turn").alias("seq"))
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    calls = turns.select(F.col("conv_id").alias("file_id"), F.concat(F.lit("global."), before).alias("caller_scope"), F.col("role").alias("callee_name"))
    return link_calls(calls.filter("caller_scope is not null"), symbols)


@register("placeholder_rows", """SELECT DISTINCT CAST(l_suppkey * 2 AS VARCHAR) AS rel_path, 'unknown' AS language, 'unknown' AS file_hash, CAST(1 AS BIGINT) AS loc FROM lineitem WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)""")
def placeholder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).cast("string").alias("rel_path"))
    return placeholder_files(names, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("rel_path")))


@register("innermost_symbols", """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS file_id, CAST(l_quantity AS INTEGER) * 3 AS line FROM lineitem),
s AS (SELECT p_partkey AS k, p_partkey % 40 + 1 AS file_id, p_size * 2 AS a, p_size * 2 + p_partkey % 90 AS b FROM part),
h AS (SELECT DISTINCT f.file_id, line, k, a FROM f JOIN s ON s.file_id = f.file_id AND line BETWEEN a AND b),
o AS (SELECT file_id, line, k FROM h QUALIFY row_number() OVER (PARTITION BY file_id, line ORDER BY a DESC, k) = 1)
SELECT id, k AS symbol_id FROM f LEFT JOIN o ON o.file_id = f.file_id AND o.line = f.line""")
def innermost_symbols_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("file_id"), (F.col("l_quantity").cast("int") * 3).alias("line_number")
    )
    start = F.col("p_size").cast("int") * 2
    symbols = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 40 + 1).alias("file_id"), start.alias("start_line"), (start + (F.col("p_partkey") % 90).cast("int")).alias("end_line")
    )
    return innermost_symbols(found, symbols).select("id", "symbol_id")


# One upsert per table of the model: columns with the value in base, in delta, and, where the model normalises it, what is stored of the delta.
_UPSERTS: dict[str, dict[str, tuple[str, ...]]] = {
    "files": {"file_id": ("o_orderkey", "-1"), "rel_path": ("CAST(o_orderkey AS VARCHAR(20))",) * 2, "file_hash": ("o_orderstatus", "o_orderpriority"), "loc": ("o_custkey", "o_custkey + 1"), "runtime_role": ("'MIDDLEWARE'", "CAST(NULL AS VARCHAR(20))", "'UNKNOWN'")},
    "symbols": {"symbol_id": ("o_orderkey", "-1"), "file_id": ("o_custkey",) * 2, "name": ("CAST(o_orderkey AS VARCHAR(20))",) * 2, "kind": ("'CLASS'", "'CLASS'"), "start_line": ("3", "3"), "start_col": ("4", "4"), "end_line": ("5", "6"), "scope": ("'a'", "o_orderpriority")},
    "endpoints": {"endpoint_id": ("o_orderkey", "-1"), "file_id": ("o_custkey",) * 2, "route_pattern": ("CAST(o_orderkey AS VARCHAR(20))",) * 2, "http_method": ("'GET'", "'get'", "'GET'"), "line_number": ("7", "7"), "auth_state": ("'REQUIRED'", "CAST(NULL AS VARCHAR(20))", "'UNKNOWN'")},
    "candidate_sinks": {"sink_id": ("o_orderkey", "-1"), "file_id": ("o_custkey",) * 2, "line_number": ("CAST(o_orderkey AS INTEGER)",) * 2, "raw_rule_id": ("'r'", "'r'"), "cwe_id": ("'CWE-1'", "'CWE-2'"), "symbol_id": ("o_custkey", "-2"), "vuln_class": ("'RCE'", "'SQLI'"), "triage_severity": ("'LOW'", "'high'", "'HIGH'")},
    "graph_edges": {"edge_id": ("o_orderkey", "-1"), "caller_symbol_id": ("o_orderkey",) * 2, "callee_symbol_id": ("o_custkey",) * 2, "edge_type": ("'CALLS'", "'CALLS'")},
    "vendor_signatures": {"sig_id": ("o_orderkey", "-1"), "package_name": ("o_orderpriority",) * 2, "api_name": ("CAST(o_orderkey AS VARCHAR(20))",) * 2, "potential_sink_class": ("'RCE'", "'SSRF'")},
    "scans": {"scan_id": ("CAST(o_orderkey AS VARCHAR(20))",) * 2, "status": ("'INDEXING'", "'COMPLETED'"), "target_path": ("o_orderstatus", "o_orderpriority")},
    "scan_candidate_paths": {"path_id": ("CAST(o_orderkey AS VARCHAR(20))",) * 2, "sink_id": ("o_custkey", "-1"), "state": ("'QUEUED'", "'RESOLVED'"), "hop_count": ("1", "9"), "priority_score": ("CAST(0.5 AS DOUBLE)", "CAST(0.9 AS DOUBLE)")},
    "scan_dossiers": {"dossier_id": ("CAST(o_orderkey AS VARCHAR(20))",) * 2, "title": ("'old'", "'new'"), "severity": ("'LOW'", "'HIGH'"), "verdict": ("'SAFE_PROVEN'", "'EXPLOITABLE'"), "confidence": ("CAST(0.5 AS DOUBLE)", "CAST(0.9 AS DOUBLE)")},
}


def _upsert_sql(name: str) -> str:
    columns, spec = _UPSERTS[name], S.TABLES[name]
    base = ", ".join(f"{v[0]} AS {c}" for c, v in columns.items())
    delta = ", ".join(f"{v[-1]} AS {c}" for c, v in columns.items())
    on = " AND ".join(f"b.{k} = d.{k}" for k in spec.key)
    first = spec.key[0]
    out = []
    for c in columns:
        if c in spec.key:
            out.append(f"coalesce(b.{c}, d.{c}) AS {c}")
        elif c in spec.kept:
            out.append(f"CASE WHEN b.{first} IS NOT NULL THEN b.{c} ELSE d.{c} END AS {c}")
        else:
            out.append(f"CASE WHEN d.{first} IS NOT NULL THEN d.{c} ELSE b.{c} END AS {c}")
    return (
        f"WITH b AS (SELECT {base} FROM orders WHERE o_orderkey % 3 <> 0), d AS (SELECT {delta} FROM orders WHERE o_orderkey % 2 = 0) "
        f"SELECT {', '.join(out)} FROM b FULL JOIN d ON {on}"
    )


def _upsert_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns, key = _UPSERTS[name], S.TABLES[name].key
        orders = table(spark, sf_dir, "orders")
        base = S.evolve(orders.filter("o_orderkey % 3 <> 0").selectExpr(*[f"{v[0]} AS {c}" for c, v in columns.items()]), name)
        # Every row arrives twice; the first arrival differs and must lose.
        changed = orders.filter("o_orderkey % 2 = 0")
        late = changed.selectExpr(*[f"{v[1]} AS {c}" for c, v in columns.items()], "2 AS seq")
        early = changed.selectExpr(*[f"{v[1] if c in key else 'CAST(NULL AS ' + late.schema[c].dataType.simpleString() + ')'} AS {c}" for c, v in columns.items()], "1 AS seq")
        return upsert_table(name, base, late.unionByName(early), "seq").select(*columns)

    return run


for _name in _UPSERTS:
    register(f"upsert_{_name}", _upsert_sql(_name))(_upsert_query(_name))


@register("surrogate_ids", "SELECT CAST(o_orderkey AS VARCHAR) AS rel_path, true AS stable, CAST(1 AS BIGINT) AS n FROM orders")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows get ids from their keys: the same in every run, and one row each."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("rel_path"))
    empty = S.evolve(rows.limit(0), "files")
    once, again = (upsert_table("files", empty, df).select("rel_path", "file_id") for df in (rows, rows.repartition(3, "rel_path")))
    both = once.join(again.withColumnRenamed("file_id", "other"), "rel_path")
    shared = once.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return both.join(shared, "file_id").select("rel_path", (F.col("file_id") == F.col("other")).alias("stable"), "n")


@register("append_evidence", "SELECT edge_id, count(*) AS n, bool_and(is_active) AS is_active FROM (SELECT l_orderkey AS edge_id, l_returnflag <> 'R' AS is_active FROM lineitem UNION ALL SELECT l_orderkey, true FROM lineitem WHERE l_linenumber = 1) GROUP BY edge_id")
def append_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    base = S.evolve(line.select(F.col("l_orderkey").alias("edge_id"), (F.col("l_returnflag") != "R").alias("is_active")), "graph_edge_evidence")
    both = upsert_table("graph_edge_evidence", base, line.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("edge_id")))
    return both.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("is_active").alias("is_active"))


@register("resolve_paths", "SELECT o_orderkey AS path_id, CASE WHEN o_orderkey % 3 = 0 THEN 'RESOLVED' ELSE 'QUEUED' END AS state, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS reachability_confidence, o_orderkey % 3 = 0 AS touched FROM orders")
def resolve_paths_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("path_id"), F.lit("QUEUED").alias("state"), F.lit(1.0).alias("reachability_confidence"), F.lit(None).cast("timestamp").alias("updated_at")
    )
    found = paths.filter("path_id % 3 = 0").select("path_id", F.lit(0.75).alias("reachability_confidence"))
    return resolve_paths(paths, found).select("path_id", "state", "reachability_confidence", F.col("updated_at").isNotNull().alias("touched"))


@register("status_transition", "SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, CASE WHEN o_orderkey = 32 THEN 'COMPLETED' ELSE 'INDEXING' END AS status, o_orderkey = 32 AS closed, 'old' AS stat FROM orders")
def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("scan_id"), F.lit("INDEXING").alias("status"), F.lit(None).cast("timestamp").alias("completed_at"),
        F.create_map(F.lit("k"), F.lit("old")).alias("stats"),
    )
    out = close_scan(scans, "32", "COMPLETED")
    return out.select("scan_id", "status", F.col("completed_at").isNotNull().alias("closed"), F.col("stats")["k"].alias("stat"))


@register("resume_pending", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS state FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND o_orderpriority = '5-LOW'""")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir, "5-LOW").select(F.col("path_id").alias("o_orderkey"), "state")


@register("latest_cached", """SELECT o_orderkey AS dossier_id, o_custkey AS path_id, o_orderpriority AS engine_fingerprint FROM orders WHERE o_custkey % 2 = 0
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    dossiers = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dossier_id"), F.col("o_custkey").alias("path_id"), F.col("o_orderpriority").alias("engine_fingerprint"), F.col("o_orderdate").alias("created_at")
    )
    wanted = dossiers.filter("path_id % 2 = 0").select("path_id", "engine_fingerprint")
    return cached_results(wanted, dossiers).drop("created_at")


@register("latest_order", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("name"))


@register("lookup_by_name", "SELECT min(p_partkey) AS symbol_id, p_brand AS name FROM part GROUP BY p_brand")
def lookup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols_by_name(_symbols(spark, sf_dir))


@register("lookup_first", "SELECT p_partkey AS symbol_id, p_brand AS name FROM part WHERE p_brand = 'Brand#13' ORDER BY p_partkey LIMIT 1")
def lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbol_by_name(_symbols(spark, sf_dir), "Brand#13")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("path_id"), F.col("l_discount").alias("priority"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_returnflag"
    )


ITEMS_SQL = "SELECT l_partkey AS path_id, l_discount AS priority, l_orderkey * 10 + l_linenumber AS seq, l_returnflag FROM lineitem"


@register("priority_dedupe", f"SELECT path_id, priority, seq FROM ({ITEMS_SQL}) QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY seq) = 1")
def priority_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_pushes(_items(spark, sf_dir)).select("path_id", "priority", "seq")


@register("triage_topk", f"SELECT path_id, priority, seq FROM (SELECT * FROM ({ITEMS_SQL}) QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY seq) = 1) ORDER BY priority DESC, seq LIMIT 100")
def triage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(_items(spark, sf_dir), 100).select("path_id", "priority", "seq")


@register("queue_order", f"""WITH f AS (SELECT * FROM ({ITEMS_SQL}) QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY seq) = 1)
SELECT path_id, row_number() OVER (PARTITION BY path_id % 100 ORDER BY priority DESC, seq) AS rank FROM f""")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("queue", F.col("path_id") % 100)
    return pop_order(items, ["queue"]).select("path_id", "rank")


@register("priority_score", f"""SELECT o_orderkey, round((CASE s WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.5 WHEN 'LOW' THEN 0.2 ELSE 0.1 END)::DOUBLE * 0.7::DOUBLE
* (CASE o_orderstatus WHEN 'O' THEN 1.5 WHEN 'F' THEN 1.0 ELSE 1.1 END)::DOUBLE * (CASE WHEN o_custkey % 2 = 0 THEN 0.1 ELSE 1.0 END)::DOUBLE / sqrt(greatest(1, o_orderkey % 5)::DOUBLE), 9) AS score
FROM (SELECT *, {SEVERITY_SQL} AS s FROM orders)""")
def priority_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    auth = F.when(F.col("o_orderstatus") == "O", "NOT_REQUIRED").when(F.col("o_orderstatus") == "F", "REQUIRED").otherwise("UNKNOWN")
    domain = F.when(F.col("o_custkey") % 2 == 0, "TEST_MOCK").otherwise("APPLICATION_RUNTIME")
    score = priority_score(F.expr(SEVERITY_SQL), F.lit(0.7), F.col("o_orderkey") % 5, auth, F.lit(True), domain)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(score, 9).alias("score"))


@register("cli_priority", f"SELECT o_orderkey, CAST(CASE WHEN ({SEVERITY_SQL}) IN ('CRITICAL','HIGH') THEN 0.9 ELSE 0.5 END AS DOUBLE) AS priority FROM orders")
def cli_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scan_priority(F.expr(SEVERITY_SQL)).alias("priority"))


@register("finding_fingerprint", "SELECT doc_id, sha256('v1|' || upper(lang) || '|' || source || '|' || coalesce(lang, '') || '|' || CAST(doc_id AS VARCHAR) || '|src/' || source || '.py') AS fingerprint FROM documents")
def finding_fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat(F.lit(" src/"), "source", F.lit(".py:"), F.col("n_chars").cast("string"))
    fingerprint = finding_fingerprint(F.concat(F.lit(" "), "lang"), F.col("source"), F.concat("lang", F.lit("\t")), F.col("doc_id").cast("string"), place)
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint.alias("fingerprint"))


@register("evidence_gate", """SELECT l_orderkey, l_linenumber, CASE WHEN stop THEN 'INSUFFICIENT_CONTEXT' WHEN l_returnflag = 'A' THEN 'SAFE_PROVEN' WHEN l_returnflag = 'N' THEN 'LIKELY_EXPLOITABLE_PARTIAL_SANITIZATION' ELSE 'EXPLOITABLE' END AS verdict,
CAST(CASE WHEN stop THEN 0 ELSE round_even(least(r, CASE l_returnflag WHEN 'A' THEN 0.95 WHEN 'N' THEN 0.75 ELSE 0.9 END::DOUBLE), 2) END AS DOUBLE) AS confidence
FROM (SELECT *, l_quantity / 50.0 AS r, l_quantity / 50.0 < 0.6 OR l_linenumber = 3 AS stop FROM lineitem)""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "EFFECTIVE").when(F.col("l_returnflag") == "N", "PARTIAL").otherwise("FAILED")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, "ASSUMED").otherwise("CONFIRMED").alias("source_control"), (F.col("l_quantity") / 50.0).alias("reach"), status.alias("transform_status")
    )
    return gate_arguments(rows).select("l_orderkey", "l_linenumber", "verdict", "confidence")


@register("evidence_bundles", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 > 8 OR l_linenumber = 2 OR r < 0.6 THEN 'INSUFFICIENT_CONTEXT' WHEN l_returnflag = 'A' THEN 'SAFE_PROVEN' WHEN l_returnflag = 'N' THEN 'LIKELY_EXPLOITABLE_PARTIAL_SANITIZATION' ELSE 'EXPLOITABLE' END AS verdict
FROM (SELECT *, 1 - l_discount * 8 AS r FROM lineitem)""")
def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit("s").alias("source_node"), F.lit("k").alias("sink_node"),
        F.when(F.col("l_linenumber") == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("s"), F.lit("k"))).alias("path_trace"),
        (1 - F.col("l_discount") * 8).alias("reach"), (F.col("l_returnflag") == "A").alias("effective"), (F.col("l_returnflag") == "N").alias("partial"),
        (F.col("l_orderkey") % 11).cast("int").alias("agent_turns"), F.lit("<thought>x").alias("bypass_reasoning"),
    )
    return gate_bundles(rows).select("l_orderkey", "l_linenumber", "verdict")


@register("constraint_fk", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0)")
def constraint_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 0")
    return S.orphans(table(spark, sf_dir, "lineitem"), "l_suppkey", parents, "s_suppkey").select("l_orderkey", "l_linenumber")


@register("constraint_unique", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def constraint_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@register("constraint_enum", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def constraint_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.outside_enum(table(spark, sf_dir, "orders"), "o_orderstatus", ("O", "F")).select("o_orderkey")


@register("schema_evolution", "SELECT CAST(o_orderkey AS VARCHAR) AS rel_path, false AS is_vendor, 'APPLICATION_RUNTIME' AS execution_domain, CAST(0.8 AS DOUBLE) AS classification_confidence FROM orders")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("rel_path"))
    return S.evolve(old, "files").select("rel_path", "is_vendor", "execution_domain", "classification_confidence")

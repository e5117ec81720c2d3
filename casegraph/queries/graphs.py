"""The graph: nodes, edges, paths, reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.operators.graph import (
    best_reach, collapse_edges, edges_with_evidence, endpoint_nodes, first_paths_between, graph_edges, graph_nodes, graph_scope, path_step_nodes, paths_to_targets,
    simple_paths, simple_paths_sql, subgraph_nodes, trace_nodes,
)
from casegraph.operators.matching import first_endpoints
from casegraph.operators.report import graph_document
from casegraph.queries import register, table
from casegraph.scratch import materialize


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as symbols, customers as endpoints (handled by their first order), suppliers as sinks, order -> next order as edges."""
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("h"))
    symbols = orders.select(
        F.col("o_orderkey").alias("symbol_id"), F.lit("FUNCTION").alias("kind"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("file_id"),
        F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit("sig").alias("signature"),
    )
    endpoints = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("endpoint_id"), F.lit("GET").alias("http_method"), F.col("c_name").alias("route_pattern"), F.col("c_custkey").alias("file_id"),
        F.lit(1).alias("line_number"), F.col("h").alias("handler_symbol_id"),
    )
    sinks = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sink_id"), F.lit("RCE").alias("vuln_class"), F.lit("HIGH").alias("triage_severity"), F.col("s_suppkey").alias("file_id"),
        F.lit(3).alias("line_number"), F.col("s_name").alias("sink_expression"), F.col("s_suppkey").alias("symbol_id"),
    )
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = orders.select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderkey").alias("caller_symbol_id"), following.alias("callee_symbol_id"), F.lit("CALLS").alias("edge_type"))
    evidence = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("edge_id"), F.lit("AST").alias("resolution_method"), F.lit(0.75).alias("confidence"), (F.col("o_orderkey") % 2 == 0).alias("is_active"))
    return symbols, endpoints, sinks, edges.filter("callee_symbol_id is not null"), evidence


NODES_SQL = """SELECT 'sym_' || CAST(o_orderkey AS VARCHAR) AS id, 'SYMBOL' AS node_kind, o_orderpriority AS name, NULL AS route, o_custkey AS file_id FROM orders
UNION ALL SELECT 'ep_' || CAST(c_custkey AS VARCHAR), 'ENDPOINT', NULL, c_name, c_custkey FROM customer UNION ALL SELECT 'sink_' || CAST(s_suppkey AS VARCHAR), 'SINK', NULL, NULL, s_suppkey FROM supplier"""


@register("graph_nodes", NODES_SQL)
def graph_nodes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, endpoints, sinks, *_ = _model(spark, sf_dir)
    return graph_nodes(symbols, endpoints, sinks).select("id", "node_kind", "name", "route", "file_id")


@register("subgraph_symbol", f"SELECT * FROM ({NODES_SQL}) WHERE node_kind <> 'SYMBOL' OR name = '1-URGENT'")
def subgraph_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subgraph_nodes(graph_nodes_query(spark, sf_dir), "1-URGENT")


@register("subgraph_endpoint", f"SELECT * FROM ({NODES_SQL}) WHERE node_kind = 'ENDPOINT' AND route = (SELECT min(c_name) FROM customer)")
def subgraph_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = table(spark, sf_dir, "customer").agg(F.min("c_name")).first()[0]
    return endpoint_nodes(graph_nodes_query(spark, sf_dir), route)


@register("subgraph_path", "SELECT 'path_step_' || CAST(k AS VARCHAR) AS id, 'PATH_STEP' AS node_kind, ['a', 'b', 'c'][k] AS node_reference, 'p7' AS path_id FROM (SELECT unnest([1, 2, 3]) AS k)")
def subgraph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path_id"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("call_sequence"))
    return path_step_nodes(paths.withColumn("path_id", F.when(F.col("path_id") == table(spark, sf_dir, "orders").agg(F.concat(F.lit("p"), F.min("o_orderkey").cast("string"))).first()[0], "p7").otherwise("x")), "p7")


@register("subgraph_finding", "SELECT 'trace_1' AS id, 'TRACE_NODE' AS node_kind, s_name AS file, CAST(s_nationkey AS INTEGER) AS line, 't' AS finding_title FROM supplier WHERE s_suppkey = 1")
def subgraph_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dossiers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("dossier_id"), F.lit("t").alias("title"), F.array(F.struct(F.col("s_name").alias("file"), F.col("s_nationkey").cast("int").alias("line"))).alias("source_trace")
    )
    return trace_nodes(dossiers, "1")


EDGES_SQL = """WITH f AS (SELECT o_custkey, min(o_orderkey) AS h FROM orders GROUP BY o_custkey), n AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx FROM orders)
SELECT 'ep_' || CAST(o_custkey AS VARCHAR) AS src, 'sym_' || CAST(h AS VARCHAR) AS dst, 'HANDLER' AS edge_type, CAST(1.0 AS DOUBLE) AS confidence, 'DETERMINISTIC' AS provenance FROM f
UNION ALL SELECT 'sym_' || CAST(s_suppkey AS VARCHAR), 'sink_' || CAST(s_suppkey AS VARCHAR), 'CONTAINS_SINK', 1.0, 'DETERMINISTIC' FROM supplier
UNION ALL SELECT 'sym_' || CAST(o_orderkey AS VARCHAR), 'sym_' || CAST(nx AS VARCHAR), 'CALLS', CASE WHEN o_orderkey % 6 = 0 THEN 0.75 ELSE 1.0 END, CASE WHEN o_orderkey % 6 = 0 THEN 'AST' ELSE 'DETERMINISTIC' END FROM n WHERE nx IS NOT NULL"""


@register("graph_edges", EDGES_SQL)
def graph_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, endpoints, sinks, edges, evidence = _model(spark, sf_dir)
    return graph_edges(endpoints, sinks, edges, evidence).drop("ord")


# Each order's next one has a greater key, so a path from a customer's first order is unique.
@register("reach_endpoints_to_sinks", f"""WITH RECURSIVE e AS ({EDGES_SQL}), w AS (SELECT src AS source, dst AS node, 1 AS hops, confidence AS c FROM e WHERE src LIKE 'ep%'
UNION ALL SELECT w.source, e.dst, w.hops + 1, least(w.c, e.confidence) FROM w JOIN e ON e.src = w.node WHERE w.hops < 20)
SELECT source, node AS target, hops, c AS confidence FROM w WHERE node LIKE 'sink%'""")
def reach_endpoints_to_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, endpoints, sinks, edges, evidence = _model(spark, sf_dir)
    whole = materialize(collapse_edges(graph_edges(endpoints, sinks, edges, evidence)), "reach-input")  # read for the starts, the ends and the steps
    starts = whole.filter("src like 'ep%'").select(F.col("src").alias("source"))
    ends = whole.filter("dst like 'sink%'").select(F.col("dst").alias("target"))
    return paths_to_targets(whole, starts, ends, ordered=False).select("source", "target", "hops", "confidence")


def _first_sql(same_file: bool) -> str:
    """Each sink's first endpoint among those that reach it, and, with ``same_file``, those of its file."""
    near = " UNION ALL SELECT c_custkey, s_suppkey, 1, 1, CAST(0.85 AS DOUBLE) FROM customer JOIN supplier ON c_custkey = s_suppkey" if same_file else ""
    return f"""WITH RECURSIVE e AS ({EDGES_SQL}), w AS (SELECT src AS source, dst AS node, 1 AS hops, confidence AS c FROM e WHERE src LIKE 'ep%'
UNION ALL SELECT w.source, e.dst, w.hops + 1, least(w.c, e.confidence) FROM w JOIN e ON e.src = w.node WHERE w.hops < 20),
o AS (SELECT CAST(substring(source, 4) AS BIGINT) AS endpoint_id, CAST(substring(node, 6) AS BIGINT) AS sink_id, 0 AS rank, hops, c AS reach FROM w WHERE node LIKE 'sink%'{near}),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY sink_id ORDER BY endpoint_id, rank) = 1)
SELECT s_suppkey AS sink_id, endpoint_id, hops, reach FROM supplier LEFT JOIN f ON sink_id = s_suppkey"""


def _first(spark: SparkSession, sf_dir: str, same_file: bool) -> DataFrame:
    _, endpoints, sinks, edges, evidence = _model(spark, sf_dir)
    return first_endpoints(sinks, endpoints, graph_edges(endpoints, sinks, edges, evidence), same_file).select("sink_id", "endpoint_id", "hops", "reach")


@register("first_match_endpoint", _first_sql(True))
def first_match_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir, True)


@register("first_match_resume", _first_sql(False))
def first_match_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir, False)


_SCOPES_SQL = {
    "symbol": f"""SELECT '{{"id":"sym_' || CAST(o_orderkey AS VARCHAR) || '","kind":"SYMBOL","symbol_kind":"FUNCTION","name":"' || o_orderpriority || '","file_id":' || CAST(o_custkey AS VARCHAR) || ',"start_line":1,"end_line":2,"signature":"sig"}}' AS j FROM orders""",
    "endpoint": """SELECT '{"id":"ep_' || CAST(c_custkey AS VARCHAR) || '","kind":"ENDPOINT","file_id":' || CAST(c_custkey AS VARCHAR) || ',"method":"GET","route":"' || c_name || '","line":1}' AS j FROM customer""",
    "sink": """SELECT '{"id":"sink_' || CAST(s_suppkey AS VARCHAR) || '","kind":"SINK","file_id":' || CAST(s_suppkey AS VARCHAR) || ',"line":3,"vuln_class":"RCE","severity":"HIGH","expression":"' || s_name || '"}' AS j FROM supplier""",
    "edge": """SELECT '{"caller_symbol_id":' || CAST(o_orderkey AS VARCHAR) || ',"callee_symbol_id":' || CAST(nx AS VARCHAR) || ',"edge_type":"CALLS","provenance":"' || CASE WHEN o_orderkey % 6 = 0 THEN 'AST","confidence":0.75}' ELSE 'DETERMINISTIC","confidence":1.0}' END AS j
FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx FROM orders) WHERE nx IS NOT NULL""",
}


def _document_sql(scope: str, nodes: str, edges: str | None = None) -> str:
    listed = "coalesce((SELECT string_agg(j, ',' ORDER BY j) FROM ({})), '')"
    right = listed.format(edges) if edges else "''"
    return f"""SELECT '{scope}' AS scope, '{{"nodes":[' || {listed.format(nodes)} || '],"edges":[' || {right} || ']}}' AS document"""


_WITHOUT_SYMBOLS = f"{_SCOPES_SQL['endpoint']} UNION ALL {_SCOPES_SQL['sink']}"


@register("graph_documents", " UNION ALL ".join([
    _document_sql("repository", f"{_SCOPES_SQL['symbol']} UNION ALL {_WITHOUT_SYMBOLS}", _SCOPES_SQL["edge"]),
    _document_sql("symbol", f"{_SCOPES_SQL['symbol']} WHERE o_orderpriority = '1-URGENT' UNION ALL {_WITHOUT_SYMBOLS}", _SCOPES_SQL["edge"]),
    _document_sql("endpoint", f"{_SCOPES_SQL['endpoint']} WHERE c_name = (SELECT min(c_name) FROM customer)"),
    _document_sql("path", """SELECT '{"id":"path_step_' || CAST(k AS VARCHAR) || '","kind":"PATH_STEP","node_reference":"' || ['a', 'b'][k] || '","path_id":"p"}' AS j FROM (SELECT unnest([1, 2]) AS k)"""),
    _document_sql("finding", """SELECT '{"id":"trace_1","kind":"TRACE_NODE","file":"' || s_name || '","line":4,"finding_title":"t"}' AS j FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)"""),
]))
def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as a document in each of its five scopes."""
    symbols, endpoints, sinks, edges, evidence = _model(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier")
    tables = {
        "symbols": symbols, "endpoints": endpoints, "candidate_sinks": sinks,
        "scan_candidate_paths": table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "p").otherwise("q").alias("path_id"), F.array(F.lit("a"), F.lit("b")).alias("call_sequence")),
        "scan_dossiers": suppliers.select(F.col("s_suppkey").cast("string").alias("dossier_id"), F.lit("t").alias("title"), F.array(F.struct(F.col("s_name").alias("file"), F.lit(4).alias("line"))).alias("source_trace")),
    }
    keys = {
        "repository": None, "symbol": "1-URGENT", "endpoint": table(spark, sf_dir, "customer").agg(F.min("c_name")).first()[0], "path": "p",
        "finding": str(suppliers.agg(F.min("s_suppkey")).first()[0]),
    }
    out = None
    for scope, key in keys.items():
        nodes = graph_scope(tables.__getitem__, scope, key).withColumnRenamed("node_kind", "kind")
        links = edges_with_evidence(edges, evidence).drop("edge_id") if scope in ("repository", "symbol") else None
        one = graph_document(nodes, links, scope=scope)
        out = one if out is None else out.unionByName(one)
    return out


TRANSITIONS_SQL = """t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM events),
g AS (SELECT src, dst, round(1 - 1.0::DOUBLE / (count(*) + 1), 9) AS confidence FROM t WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), following.alias("dst")).filter("dst is not null and src <> dst")
    edges = pairs.groupBy("src", "dst").agg(F.round(1 - 1.0 / (F.count(F.lit(1)) + 1), 9).alias("confidence"))
    return edges.withColumns({"edge_type": F.lit("NEXT"), "ord": F.struct("src", "dst")})


def _pairs(spark: SparkSession, edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.limit(1).select(F.lit(source).alias("source"), F.lit(target).alias("target"))


_WALK = """w AS (SELECT '{s}' AS node, ['{s}'] AS nodes, 0 AS hops, 1.0::DOUBLE AS c UNION ALL
SELECT g.dst, list_append(w.nodes, g.dst), w.hops + 1, least(w.c, g.confidence) FROM w JOIN g ON g.src = w.node WHERE w.node <> '{t}' AND w.hops < {h} AND NOT list_contains(w.nodes, g.dst))"""


def _paths_sql(hops: int) -> str:
    return f"WITH RECURSIVE {TRANSITIONS_SQL}, {_WALK.format(s='view', t='purchase', h=hops)} SELECT array_to_string(nodes, '>') AS path, hops, c AS confidence FROM w WHERE node = 'purchase'"


def _paths(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    edges = transitions(spark, sf_dir)
    return simple_paths(edges, _pairs(spark, edges, "view", "purchase"), hops)


@register("paths_exact", _paths_sql(20))
def paths_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, 20).select(F.array_join("nodes", ">").alias("path"), "hops", "confidence")


@register("paths_recursive_sql", _paths_sql(20))
def paths_recursive_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    transitions(spark, sf_dir).createOrReplaceTempView("casegraph_transitions")
    found = spark.sql(simple_paths_sql("casegraph_transitions", "view", "purchase", 20))
    return found.select(F.array_join("nodes", ">").alias("path"), "hops", "confidence")


@register("hop_cap", _paths_sql(2))
def hop_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, 2).select(F.array_join("nodes", ">").alias("path"), "hops", "confidence")


@register("weakest_link", f"SELECT max(confidence) AS best, min(confidence) AS worst FROM ({_paths_sql(20)})")
def weakest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, 20).agg(F.max("confidence").alias("best"), F.min("confidence").alias("worst"))


# Edges are ordered by the name of their end, so the first path is the least one by names.
@register("first_path", f"SELECT path, hops FROM ({_paths_sql(20)}) ORDER BY path LIMIT 1")
def first_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transitions(spark, sf_dir)
    return first_paths_between(edges, _pairs(spark, edges, "view", "purchase"), 20).select(F.array_join("nodes", ">").alias("path"), "hops")


REACH_SQL = """co AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS o FROM orders), os AS (SELECT l_orderkey AS o, l_suppkey AS s, max(1 - l_discount) AS conf FROM lineitem GROUP BY ALL)"""


def _reach_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    to_order = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit(1.0).alias("confidence"))
    to_supplier = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max(1 - F.col("l_discount")).alias("confidence"))
    to_supplier = to_supplier.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "confidence")
    return to_order.unionByName(to_supplier).withColumns({"edge_type": F.lit("E"), "ord": F.struct("src", "dst")})


@register("reach_multi_source", f"WITH {REACH_SQL} SELECT 'c' || CAST(c AS VARCHAR) AS source, 's' || CAST(s AS VARCHAR) AS target, 'o' || CAST(co.o AS VARCHAR) AS via, 2 AS hops, conf AS confidence FROM co JOIN os ON co.o = os.o")
def reach_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(_reach_edges(spark, sf_dir), "reach-input")  # read for the starts, the ends and the steps
    starts = edges.filter("src like 'c%'").select(F.col("src").alias("source"))
    ends = edges.filter("dst like 's%'").select(F.col("dst").alias("target"))
    return paths_to_targets(edges, starts, ends, 3, ordered=False).select("source", "target", F.col("nodes")[1].alias("via"), "hops", "confidence")


@register("first_paths_all", f"""WITH {REACH_SQL} SELECT 'c' || CAST(c AS VARCHAR) AS source, 's' || CAST(s AS VARCHAR) AS target, min('o' || CAST(co.o AS VARCHAR)) AS via,
arg_min(conf, 'o' || CAST(co.o AS VARCHAR)) AS confidence FROM co JOIN os ON co.o = os.o GROUP BY ALL""")
def first_paths_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first way from every customer to every supplier in reach, customers apart."""
    edges = materialize(_reach_edges(spark, sf_dir), "reach-input")
    supplied = edges.filter("dst like 's%'").select("src", F.col("dst").alias("target"))
    placed = edges.filter("src like 'c%'").select(F.col("src").alias("source"), F.col("dst").alias("o"))
    pairs = placed.join(supplied, F.col("o") == F.col("src")).select("source", "target")
    return first_paths_between(edges, pairs, 3).select("source", "target", F.col("nodes")[1].alias("via"), "confidence")


@register("best_path", f"""WITH {REACH_SQL} SELECT 'c' || CAST(c AS VARCHAR) AS source, 's' || CAST(s AS VARCHAR) AS node, max(conf) AS confidence, 2 AS hops FROM co JOIN os ON co.o = os.o GROUP BY ALL
UNION ALL SELECT 'c' || CAST(c AS VARCHAR), 'o' || CAST(o AS VARCHAR), 1.0, 1 FROM co UNION ALL SELECT DISTINCT 'c' || CAST(c AS VARCHAR), 'c' || CAST(c AS VARCHAR), 1.0, 0 FROM co""")
def best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(_reach_edges(spark, sf_dir), "reach-input")
    return best_reach(edges, edges.filter("src like 'c%'").select(F.col("src").alias("source")), 3).select("source", "node", "confidence", "hops")

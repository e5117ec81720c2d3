"""The code property graph: nodes, edges, bounded simple paths, weakest links.

Three ways to reach:

* ``simple_paths`` enumerates every cycle-free path up to a number of edges, in
  the order of a depth-first search (exact, and as large as the answer);
* ``first_routes`` keeps, per node and number of edges, only the path that such a
  search finds first, and so stays within hops x nodes however many paths there are;
* ``best_reach`` keeps, per source and node, the best weakest-link confidence
  and the least hops, and so stays within sources x nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.scratch import materialize, release


def graph_nodes(symbols: DataFrame, endpoints: DataFrame, sinks: DataFrame) -> DataFrame:
    """(id, kind, ...) of all nodes; attributes that a kind lacks are null."""
    sym = symbols.select(
        F.concat(F.lit("sym_"), "symbol_id").alias("id"), F.lit("SYMBOL").alias("node_kind"), F.col("kind").alias("symbol_kind"),
        "name", "file_id", "start_line", "end_line", "signature",
    )
    end = endpoints.select(
        F.concat(F.lit("ep_"), "endpoint_id").alias("id"), F.lit("ENDPOINT").alias("node_kind"), F.col("http_method").alias("method"),
        F.col("route_pattern").alias("route"), "file_id", F.col("line_number").alias("line"),
    )
    snk = sinks.select(
        F.concat(F.lit("sink_"), "sink_id").alias("id"), F.lit("SINK").alias("node_kind"), "vuln_class",
        F.col("triage_severity").alias("severity"), "file_id", F.col("line_number").alias("line"), F.col("sink_expression").alias("expression"),
    )
    return sym.unionByName(end, allowMissingColumns=True).unionByName(snk, allowMissingColumns=True)


def active(evidence: DataFrame, edge_id: int | None = None) -> DataFrame:
    """Active pieces of evidence, of one edge if it is given."""
    rows = evidence.filter("is_active")
    return rows if edge_id is None else rows.filter(F.col("edge_id") == edge_id)


def edges_with_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every edge with each of its active pieces of evidence; one row with defaults if it has none."""
    pieces = active(evidence).select(F.col("edge_id").alias("_e"), "resolution_method", "confidence")
    joined = edges.join(pieces, F.col("edge_id") == F.col("_e"), "left")
    return joined.select(
        *edges.columns,
        F.coalesce("resolution_method", F.lit("DETERMINISTIC")).alias("provenance"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def graph_edges(endpoints: DataFrame, sinks: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(src, dst, edge_type, confidence, provenance, ord): handler, containment and logical edges, in this order."""
    handler = endpoints.filter("handler_symbol_id is not null").select(
        F.concat(F.lit("ep_"), "endpoint_id").alias("src"), F.concat(F.lit("sym_"), "handler_symbol_id").alias("dst"),
        F.lit("HANDLER").alias("edge_type"), F.lit(1.0).alias("confidence"), F.lit("DETERMINISTIC").alias("provenance"),
        F.struct(F.lit(0).alias("k"), F.col("endpoint_id").alias("i")).alias("ord"),
    )
    contains = sinks.filter("symbol_id is not null").select(
        F.concat(F.lit("sym_"), "symbol_id").alias("src"), F.concat(F.lit("sink_"), "sink_id").alias("dst"),
        F.lit("CONTAINS_SINK").alias("edge_type"), F.lit(1.0).alias("confidence"), F.lit("DETERMINISTIC").alias("provenance"),
        F.struct(F.lit(1).alias("k"), F.col("sink_id").alias("i")).alias("ord"),
    )
    logical = edges_with_evidence(edges, evidence).select(
        F.concat(F.lit("sym_"), "caller_symbol_id").alias("src"), F.concat(F.lit("sym_"), "callee_symbol_id").alias("dst"),
        "edge_type", "confidence", "provenance", F.struct(F.lit(2).alias("k"), F.col("edge_id").alias("i")).alias("ord"),
    )
    return handler.unionByName(contains).unionByName(logical)


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One edge per ordered pair, as in a simple digraph: the last one's attributes, the first one's place."""
    last = F.struct("edge_type", "confidence", "provenance")
    return edges.groupBy("src", "dst").agg(F.max_by(last, "ord").alias("e"), F.min("ord").alias("ord")).select("src", "dst", "e.*", "ord")


def _numbered(edges: DataFrame) -> DataFrame:
    """Edges with ``place``, which sorts a source's edges as ``ord`` does.

    The order is taken over all edges by a range sort, so a hub's edges needn't meet in one task: a place is the number
    of the sorted part and the number inside it.
    """
    ordered = edges.repartitionByRange("src", "ord").sortWithinPartitions("src", "ord")
    return ordered.withColumn("place", F.monotonically_increasing_id())


def simple_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = S.MAX_HOPS) -> DataFrame:
    """All simple paths from ``pairs.source`` to ``pairs.target`` with at most ``max_hops`` edges.

    (source, target, nodes, hops, confidence, edge_types, ord). A path ends when it first meets its target;
    a source that is its target has one path without edges. ``ord`` sorts paths as a depth-first
    search would find them. One multi-source search for all pairs; each round is one equi-join
    and is written, so a lost executor costs a round.
    """
    step = materialize(_numbered(edges).select("src", "dst", "place", F.col("confidence").alias("c"), F.coalesce("edge_type", F.lit("")).alias("t")), "graph-edges")
    known = step.select(F.col("src").alias("n")).union(step.select("dst")).distinct()
    wanted = pairs.join(known, pairs["source"] == known["n"], "left_semi").join(known, pairs["target"] == known["n"], "left_semi").distinct()
    front = wanted.select(
        "source", "target", F.col("source").alias("at"), F.array("source").alias("nodes"), F.lit(0).alias("hops"),
        F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("edge_types"), F.array().cast("array<long>").alias("ord"),
    )
    front = materialize(front, "paths-0")
    found = front.filter("source = target").drop("at")
    open_paths = front.filter("source <> target")
    for hop in range(1, max_hops + 1):
        grown = open_paths.join(step, F.col("at") == F.col("src")).filter(~F.array_contains("nodes", F.col("dst")))
        grown = grown.select(
            "source", "target", F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"), F.lit(hop).alias("hops"),
            F.least("confidence", "c").alias("confidence"), F.concat("edge_types", F.array("t")).alias("edge_types"),
            F.concat("ord", F.array("place")).alias("ord"),
        )
        grown = materialize(grown, f"paths-{hop}")
        found = found.unionByName(grown.filter("at = target").drop("at"))
        open_paths = grown.filter("at <> target")
        if open_paths.isEmpty():
            break
    return found


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that can be read again; one that ``materialize`` returned is that already."""
    return df if getattr(df, "_casegraph_path", None) else materialize(df, name)


def _split(edges: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges into the nodes of ``ends`` (node), and all others, written apart: rounds that don't end need only the second table."""
    into = ends.select(F.col("node").alias("dst"))
    return materialize(edges.join(into, "dst", "left_semi"), "edges-into"), materialize(edges.join(into, "dst", "left_anti"), "edges-inner")


#: Up to so many hops nothing is pruned: two rounds grow before the last edge, and the search against the edges costs more than they do.
FEW_HOPS = 3


def paths_to_targets(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = S.MAX_HOPS, ordered: bool = True) -> DataFrame:
    """``simple_paths`` from all of ``sources.source`` to all of ``targets.target`` in one search.

    For graphs whose targets have no outgoing edges (as sinks): a path needn't know where it is going,
    so no pair of a source and a target is formed before a path has joined them. Only edges that don't end at a target
    take part in the rounds, and beyond ``FEW_HOPS`` only nodes from which a target is within the hops left; the last
    edge is joined once, to the paths of all rounds. Without ``ordered`` there is no ``ord``, and edges needn't be sorted.
    """
    plain = edges.select("src", "dst", F.col("confidence").alias("c"), F.coalesce("edge_type", F.lit("")).alias("t"), *(["ord"] if ordered else []))
    ends = materialize(targets.select(F.col("target").alias("node")).distinct(), "ends")
    into, inner = _split(materialize(_numbered(plain).drop("ord"), "graph-numbers") if ordered else _written(plain, "graph-edges"), ends)
    front = sources.select("source").distinct().select(
        "source", F.col("source").alias("at"), F.array("source").alias("nodes"), F.lit(0).alias("hops"), F.lit(1.0).alias("confidence"),
        F.array().cast("array<string>").alias("edge_types"), *([F.array().cast("array<long>").alias("ord")] if ordered else []),
    )
    front = materialize(front, "reach-0")
    found = front.join(ends, F.col("at") == F.col("node"), "left_semi")
    front = front.join(ends, F.col("at") == F.col("node"), "left_anti")
    if max_hops > FEW_HOPS:
        onward = materialize(_ways_on(into, inner, max_hops), "reach-onward")
        inner = materialize(inner.join(onward.select(F.col("node").alias("dst"), "onward"), "dst"), "reach-edges")
        front = front.join(onward, F.col("at") == F.col("node"), "left_semi")

    def grown(front: DataFrame, step: DataFrame) -> DataFrame:
        longer = front.join(step, F.col("at") == F.col("src")).filter(~F.array_contains("nodes", F.col("dst")))
        return longer.select(
            "source", F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"), (F.col("hops") + 1).alias("hops"),
            F.least("confidence", "c").alias("confidence"), F.concat("edge_types", F.array("t")).alias("edge_types"),
            *([F.concat("ord", F.array("place")).alias("ord")] if ordered else []),
        )

    rounds = front if max_hops > 0 else front.filter(F.lit(False))
    for hop in range(1, max_hops):
        step = inner.filter(F.col("onward") <= max_hops - hop) if max_hops > FEW_HOPS else inner
        front = materialize(grown(front, step), f"reach-{hop}")
        if front.isEmpty():
            break
        rounds = rounds.unionByName(front)
    return found.unionByName(grown(rounds, into)).withColumnRenamed("at", "target")


def simple_paths_sql(edge_view: str, source: str, target: str, max_hops: int) -> str:
    """The same search for one pair as a recursive query over a view (src, dst, confidence)."""
    return f"""
        WITH RECURSIVE walk AS (
          SELECT '{source}' AS at, array('{source}') AS nodes, 0 AS hops, CAST(1.0 AS DOUBLE) AS confidence
          UNION ALL
          SELECT e.dst, concat(w.nodes, array(e.dst)), w.hops + 1, least(w.confidence, e.confidence)
          FROM walk w JOIN {edge_view} e ON e.src = w.at
          WHERE w.at <> '{target}' AND w.hops < {max_hops} AND NOT array_contains(w.nodes, e.dst)
        )
        SELECT nodes, hops, confidence FROM walk WHERE at = '{target}'
    """


def first_paths(paths: DataFrame) -> DataFrame:
    """The path per pair that a depth-first search finds first."""
    picked = paths.groupBy("source", "target").agg(F.min_by(F.struct("nodes", "hops", "confidence", "edge_types"), "ord").alias("p"))
    return picked.select("source", "target", "p.*")


def _ways_on(into: DataFrame, inner: DataFrame, max_hops: int) -> DataFrame:
    """(node, onward): the least number of edges, one at least, from a node to a target, for nodes that have a way there.

    ``into`` and ``inner``: what ``_split`` returns. A breadth-first search against the edges: what leads to a target has
    been found by the first round, so later rounds read ``inner`` alone; only the nodes that a round adds are looked up among
    those known before.
    """
    front = materialize(into.select(F.col("src").alias("node")).distinct().withColumn("onward", F.lit(1)), "distances")
    known = front
    for hop in range(2, max_hops + 1):
        if front.isEmpty():
            break
        moved = inner.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        front = materialize(moved.join(known, "node", "left_anti").withColumn("onward", F.lit(hop)), "distances")
        known = known.unionByName(front)
    return known


def _before(rounds: DataFrame, reached: DataFrame, keys: list[str], best: Column) -> DataFrame:
    """``best`` of all rounds for the keys in ``reached`` alone.

    ``reached`` is a written table, so Spark knows its size: while it is small it is broadcast, and the rounds aren't moved.
    """
    return rounds.join(reached.select(*keys), keys, "left_semi").groupBy(*keys).agg(best.alias("_before"))


def first_routes(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_hops: int = S.MAX_HOPS, apart: bool = False) -> DataFrame:
    """(source, target, nodes, hops, confidence, edge_types): the first path to each target, in the order of a depth-first search.

    ``starts`` (source, label): the searches start in the order of ``label``, so a target's first path comes from the first source that
    reaches it at all. ``targets`` (target). With ``apart``, ``targets`` is (source, target) and each source has a first path of its own.

    Round k holds, per node, the first simple path with exactly k edges that comes before all shorter ones. That is enough: let P be the
    first path to a node t and v the node before t. If some path Q to v came before P's part up to v (and were no longer than the limit
    allows), Q and the edge to t would make a path before P, or, if Q meets t, Q's part up to t would. So P's part up to v is v's
    first path, and only first paths need to grow; a path that would close a cycle is left out. A node has at most one row
    per round, whatever the number of sources or paths. Beyond ``FEW_HOPS``, nodes from which no target is within the hops left are never
    entered. Rounds hold only nodes that a search can leave again; the last edge, into a target, is joined once, to the rows of all rounds.
    """
    keys = ["source", "node"] if apart else ["node"]
    plain = edges.select("src", "dst", F.col("confidence").alias("c"), F.coalesce("edge_type", F.lit("")).alias("t"), "ord")
    numbered = materialize(_numbered(plain).drop("ord"), "route-numbers")
    ends = materialize(targets.select(F.col("target").alias("node")).distinct(), "ends")
    into, inner = _split(numbered, ends)
    first_nodes = materialize(starts.select("source", "label").distinct().withColumn("node", F.col("source")), "route-starts")
    # A search may go on through a target that has edges of its own.
    through = ends.join(numbered.join(ends, F.col("src") == F.col("node"), "left_semi").select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    if max_hops > FEW_HOPS:
        onward = materialize(_ways_on(into, inner, max_hops), "route-onward")
        through = through.join(onward, "node")
        step = inner.join(onward.withColumnRenamed("node", "dst"), "dst")
        begin = first_nodes.join(onward, "node", "left_semi")
    else:
        through, step, begin = through.withColumn("onward", F.lit(1)), inner.withColumn("onward", F.lit(1)), first_nodes
    step = materialize(step.unionByName(into.join(through.withColumnRenamed("node", "dst"), "dst")), "route-edges")

    def route(label, order, nodes, confidence, types) -> Column:
        return F.struct(label.alias("label"), order.alias("ord"), nodes.alias("nodes"), confidence.alias("confidence"), types.alias("edge_types")).alias("route")

    def begun(rows: DataFrame) -> DataFrame:
        return rows.select("source", "node", route(F.col("label"), F.array().cast("array<long>"), F.array("source"), F.lit(1.0), F.array().cast("array<string>")))

    def grown(front: DataFrame, step: DataFrame) -> DataFrame:
        longer = front.join(step, F.col("node") == F.col("src")).filter(~F.array_contains("route.nodes", F.col("dst")))
        return longer.select("source", F.col("dst").alias("node"), route(
            F.col("route.label"), F.concat("route.ord", F.array("place")), F.concat("route.nodes", F.array("dst")), F.least("route.confidence", "c"),
            F.concat("route.edge_types", F.array("t")),
        ))

    front = materialize(begun(begin), "routes")
    rounds, written = front if max_hops > 0 else front.filter(F.lit(False)), [front]
    for hop in range(1, max_hops):
        first = grown(front, step.filter(F.col("onward") <= max_hops - hop)).groupBy(*keys).agg(F.min("route").alias("route"))
        reached = materialize(first.select(F.element_at("route.nodes", 1).alias("source"), "node", "route"), "routes-reached")
        written.append(reached)
        if reached.isEmpty():
            break
        place = F.struct(F.col("route.label"), F.col("route.ord"))
        # Written first: if no node has been met before, nothing is compared or moved.
        before = materialize(_before(rounds, reached, keys, F.min(place)), "routes-before")
        front = reached
        if not before.isEmpty():
            better = reached.join(before, keys, "left").filter(F.col("_before").isNull() | (place < F.col("_before")))
            front = materialize(better.select("source", "node", "route"), "routes")
            written.append(front)
        release(before)
        if front.isEmpty():
            break
        rounds = rounds.unionByName(front)
    # The last edge of all paths is joined once. A source that is a target has a path without edges, if the graph has it.
    found = grown(rounds, into)
    itself = materialize(first_nodes.join(ends, "node", "left_semi"), "route-starts")
    if not itself.isEmpty():
        met = numbered.select(F.col("src").alias("node")).union(numbered.select("dst")).join(ends, "node", "left_semi").distinct()
        found = found.unionByName(begun(itself.join(met, "node", "left_semi")))
    if apart:
        found = found.join(targets.withColumnRenamed("target", "node"), keys, "left_semi")
    firsts = found.groupBy(*keys).agg(F.min("route").alias("r"))
    firsts = firsts.select(
        F.element_at("r.nodes", 1).alias("source"), F.col("node").alias("target"), "r.nodes", (F.size("r.nodes") - 1).alias("hops"), "r.confidence", "r.edge_types"
    )
    out = materialize(firsts, "first-routes")
    for table in (*written, step, into, inner, numbered, first_nodes, itself, ends):
        release(table)
    return out


def first_paths_between(edges: DataFrame, pairs: DataFrame, max_hops: int = S.MAX_HOPS) -> DataFrame:
    """The path per pair (source, target) that a depth-first search finds first, without enumerating the others."""
    pairs = materialize(pairs.select("source", "target"), "pairs")  # read for the starts, the ends and the results
    out = first_routes(edges, pairs.select("source", F.lit(0).cast("long").alias("label")), pairs, max_hops, apart=True)
    release(pairs)
    return out


def best_reach(edges: DataFrame, sources: DataFrame, max_hops: int = S.MAX_HOPS) -> DataFrame:
    """(source, node, confidence, hops): the best weakest link, and the least hops, to each node in reach.

    Relaxation rounds over (source, node) pairs; a pair goes on only if a round has improved it.
    """
    plain = _written(edges.select("src", "dst", F.col("confidence").alias("c")), "reach-input")
    heads = plain.select(F.col("src").alias("dst")).distinct().withColumn("open", F.lit(True))
    # Parallel edges needn't be collapsed: each round takes the best per pair. Nodes without edges of their own end a way.
    step = materialize(plain.join(heads, "dst", "left").withColumn("open", F.coalesce("open", F.lit(False))), "reach-edges")
    front = sources.select(F.col("source"), F.col("source").alias("node"), F.lit(1.0).alias("confidence"), F.lit(0).alias("hops"), F.lit(True).alias("open"))
    changed = materialize(front.distinct(), "reach")
    rounds, again = changed, False
    for hop in range(1, max_hops + 1):
        moved = changed.filter("open").drop("open").join(step, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), F.least("confidence", "c").alias("confidence"), "open")
        reached = materialize(moved.groupBy("source", "node").agg(F.max("confidence").alias("confidence"), F.lit(hop).alias("hops"), F.max("open").alias("open")), "reach-reached")
        before = materialize(_before(rounds, reached, ["source", "node"], F.max("confidence")), "reach-before")
        # Only what a round has improved is kept; the best of all rounds is taken at the end.
        if before.isEmpty():
            changed = reached
        else:
            again = True
            better = reached.join(before, ["source", "node"], "left").filter(F.col("_before").isNull() | (F.col("confidence") > F.col("_before")))
            changed = materialize(better.select(*reached.columns), "reach")
            release(reached)
        release(before)
        rounds = rounds.unionByName(changed)
        if changed.filter("open").isEmpty():
            break
    if not again:  # no pair has been met twice
        return rounds.drop("open")
    return rounds.groupBy("source", "node").agg(F.max("confidence").alias("confidence"), F.min("hops").alias("hops"))


def subgraph_nodes(nodes: DataFrame, symbol: str | None = None) -> DataFrame:
    """Repository scope, or symbol scope: symbols of that name, and all endpoints and sinks."""
    return nodes if symbol is None else nodes.filter((F.col("node_kind") != "SYMBOL") | (F.col("name") == symbol))


def endpoint_nodes(nodes: DataFrame, route: str) -> DataFrame:
    return nodes.filter((F.col("node_kind") == "ENDPOINT") & (F.col("route") == route))


def path_step_nodes(paths: DataFrame, path_id: str) -> DataFrame:
    rows = paths.filter(F.col("path_id") == path_id).select("path_id", F.posexplode("call_sequence").alias("k", "node_reference"))
    return rows.select(
        F.concat(F.lit("path_step_"), (F.col("k") + 1).cast("string")).alias("id"), F.lit("PATH_STEP").alias("node_kind"), "node_reference", "path_id"
    )


def trace_nodes(dossiers: DataFrame, dossier_id: str) -> DataFrame:
    rows = dossiers.filter(F.col("dossier_id") == dossier_id).select("title", F.posexplode("source_trace").alias("k", "s"))
    return rows.select(
        F.concat(F.lit("trace_"), (F.col("k") + 1).cast("string")).alias("id"), F.lit("TRACE_NODE").alias("node_kind"),
        F.coalesce("s.file", F.lit("")).alias("file"), F.coalesce("s.line", F.lit(1)).alias("line"), F.col("title").alias("finding_title"),
    )


def graph_scope(read: Callable[[str], DataFrame], scope: str, key: str | None = None) -> DataFrame:
    """Nodes of one of five scopes; ``read`` gives the data model's tables, ``key`` names the symbol, route, path or finding."""
    if scope == "finding":
        return trace_nodes(read("scan_dossiers"), key)
    if scope == "path":
        return path_step_nodes(read("scan_candidate_paths"), key)
    nodes = graph_nodes(read("symbols"), read("endpoints"), read("candidate_sinks"))
    if scope == "endpoint":
        columns = ("id", "node_kind", "file_id", "method", "route", "line")
        return endpoint_nodes(nodes, key).select(*columns)
    if scope not in ("repository", "symbol"):
        raise ValueError(f"unknown scope {scope}")
    return subgraph_nodes(nodes, key if scope == "symbol" else None)

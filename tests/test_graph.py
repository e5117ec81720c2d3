import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import graph as graph_module
from casegraph.operators.graph import best_reach, collapse_edges, edges_with_evidence, first_paths, first_paths_between, first_routes, paths_to_targets, simple_paths


def graph(spark, pairs):
    rows = [(a, b, "E", float(c), i) for i, (a, b, c) in enumerate(pairs)]
    return spark.createDataFrame(rows, "src string, dst string, edge_type string, confidence double, ord long")


def pair(spark, s, t):
    return spark.createDataFrame([(s, t)], "source string, target string")


def depth_first(pairs, source, target, hops):
    """Paths in the order of a depth-first search over edges in order."""
    after = {}
    for a, b, _ in pairs:
        after.setdefault(a, []).append(b)
    out = []

    def walk(path):
        if path[-1] == target:
            out.append(tuple(path))
            return
        if len(path) - 1 < hops:
            for b in after.get(path[-1], []):
                if b not in path:
                    walk([*path, b])

    walk([source])
    return out


def test_cycle_is_left_out(spark, rows):
    edges = graph(spark, [("ep", "a", 0.98), ("a", "b", 0.95), ("b", "a", 1), ("b", "sink", 0.7)])
    found = simple_paths(edges, pair(spark, "ep", "sink"))
    assert rows(found, "nodes", "hops", "confidence") == [(["ep", "a", "b", "sink"], 3, 0.7)]


@pytest.mark.parametrize(("hops", "n"), [(20, 0), (25, 1)])
def test_hop_limit(spark, hops, n):
    edges = graph(spark, [(f"n{i}", f"n{i + 1}", 1) for i in range(25)])
    assert simple_paths(edges, pair(spark, "n0", "n25"), hops).count() == n


def test_ends(spark, rows):
    edges = graph(spark, [("a", "b", 1)])
    assert simple_paths(edges, pair(spark, "a", "x")).count() == 0
    assert rows(simple_paths(edges, pair(spark, "a", "a")), "hops", "confidence") == [(0, 1.0)]
    assert simple_paths(edges, pair(spark, "b", "a")).count() == 0


def test_order_is_depth_first(spark):
    rng = random.Random(3)
    pairs = list({(rng.randrange(6), rng.randrange(6)): 0 for _ in range(16)})
    pairs = [(f"n{a}", f"n{b}", 1) for a, b in pairs if a != b]
    expected = depth_first(pairs, "n0", "n5", 5)
    found = simple_paths(graph(spark, pairs), pair(spark, "n0", "n5"), 5)
    assert [tuple(r["nodes"]) for r in found.orderBy("ord").collect()] == expected
    if expected:
        assert tuple(first_paths(found).first()["nodes"]) == expected[0]


@pytest.mark.parametrize("seed", [1, 4])
def test_first_path_is_the_first_of_all(spark, seed):
    rng = random.Random(seed)
    pairs = list({(rng.randrange(8), rng.randrange(8)): 0 for _ in range(14 + 4 * seed)})
    pairs = [(f"n{a}", f"n{b}", rng.choice([0.5, 0.75, 1])) for a, b in pairs if a != b]
    hops = 3 + seed // 4
    nodes = sorted({n for a, b, _ in pairs for n in (a, b)})
    wanted = [(a, b) for a in nodes[:3] for b in nodes] + [("n0", "nowhere"), ("nowhere", "n0")]
    found = first_paths_between(graph(spark, pairs), spark.createDataFrame(wanted, "source string, target string"), hops)
    by_pair = {(r["source"], r["target"]): r for r in found.collect()}
    weights = {(a, b): c for a, b, c in pairs}
    for a, b in wanted:
        expected = depth_first(pairs, a, b, hops) if {a, b} <= set(nodes) else []
        assert ((a, b) in by_pair) == bool(expected)
        if expected:
            first = expected[0]
            assert tuple(by_pair[a, b]["nodes"]) == first and by_pair[a, b]["hops"] == len(first) - 1
            assert by_pair[a, b]["confidence"] == min([1.0, *[weights[e] for e in zip(first, first[1:])]])
    # All sources in one search: the first source that reaches a node, and its first path.
    starts = spark.createDataFrame([(n, k) for k, n in enumerate(nodes[:3])], "source string, label long")
    together = first_routes(graph(spark, pairs), starts, spark.createDataFrame([(n,) for n in nodes], "target string"), hops)
    reached = {r["target"]: tuple(r["nodes"]) for r in together.collect()}
    for n in nodes:
        options = [p[0] for p in (depth_first(pairs, s, n, hops) for s in nodes[:3]) if p]
        assert reached.get(n) == (options[0] if options else None)


def written_rows(monkeypatch):
    """Rows of every table that the graph operators write."""
    sizes, plain = [], graph_module.materialize

    def counted(df, name, *rest):
        out = plain(df, name, *rest)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(graph_module, "materialize", counted)
    return sizes


def test_dense_layers_are_not_enumerated(spark, monkeypatch):
    """20 layers of 20 nodes, each joined to all of the next: 20^18 paths between the ends."""
    sizes = written_rows(monkeypatch)
    layer = lambda k: [f"l{k:02}_{i:02}" for i in range(20)] if 0 < k < 19 else [f"l{k:02}_00"]
    pairs = [(a, b, 1) for k in range(19) for a in layer(k) for b in reversed(layer(k + 1))]
    found = first_paths_between(graph(spark, pairs), pair(spark, "l00_00", "l19_00")).collect()
    assert [r["nodes"] for r in found] == [["l00_00", *[f"l{k:02}_19" for k in range(1, 19)], "l19_00"]]
    assert max(n for name, n in sizes if name.startswith("routes")) <= 20


def test_many_endpoints_on_one_hub(spark, monkeypatch):
    """Ten thousand endpoints reach one hub, a chain and its sinks: one row per node and round, not per endpoint and node."""
    sizes = written_rows(monkeypatch)
    edges = [(f"ep_{i}", "hub", 1) for i in range(3, 10_003)] + [("hub", "m0", 1)] + [(f"m{k}", f"m{k + 1}", 1) for k in range(9)]
    edges += [(f"m{k}", f"sink_{k}", 0.5) for k in range(10)] + [("ep_1", "m7", 1), ("ep_2", "far", 1)]
    starts = spark.createDataFrame([(f"ep_{i}", i) for i in range(1, 10_003)], "source string, label long")
    found = first_routes(graph(spark, edges), starts, spark.createDataFrame([(f"sink_{k}",) for k in range(10)], "target string"))
    assert {r["target"]: r["source"] for r in found.collect()} == {f"sink_{k}": "ep_1" if k >= 7 else "ep_3" for k in range(10)}
    rounds = [n for name, n in sizes if name == "routes"]
    assert rounds[0] == 10_001 and sum(rounds[1:]) <= 2 * 22


def test_a_late_smaller_label_does_not_hide_an_early_one(spark):
    """The first source reaches the hub after 3 edges, the second after 1; the sink is 2 further, the limit is 4."""
    edges = [("a", "x", 1), ("x", "y", 1), ("y", "hub", 1), ("b", "hub", 1), ("hub", "z", 1), ("z", "sink", 1)]
    starts = spark.createDataFrame([("a", 1), ("b", 2)], "source string, label long")
    for hops, source in ((4, "b"), (5, "a")):
        found = first_routes(graph(spark, edges), starts, spark.createDataFrame([("sink",)], "target string"), hops)
        assert [r["source"] for r in found.collect()] == ([source] if source else [])


def test_multi_source_agrees_with_pairs(spark, rows):
    edges = graph(spark, [("e1", "a", 0.9), ("e2", "a", 0.5), ("a", "s1", 1), ("a", "b", 0.8), ("b", "s2", 1), ("b", "s1", 1)])
    starts, ends = spark.createDataFrame([("e1",), ("e2",)], "source string"), spark.createDataFrame([("s1",), ("s2",)], "target string")
    together = paths_to_targets(edges, starts, ends)
    apart = simple_paths(edges, starts.crossJoin(ends))
    columns = ("source", "target", "nodes", "hops", "confidence")
    assert rows(together, *columns) == rows(apart, *columns)


def test_best_reach(spark, rows):
    edges = graph(spark, [("a", "b", 0.5), ("a", "c", 0.9), ("c", "b", 0.8), ("b", "a", 1)])
    found = best_reach(edges, spark.createDataFrame([("a",)], "source string"))
    assert rows(found, "node", "confidence", "hops") == [("a", 1.0, 0), ("b", 0.8, 1), ("c", 0.9, 1)]


def test_parallel_edges_collapse_to_the_last(spark, rows):
    edges = spark.createDataFrame([("a", "b", "X", 0.1, "p", 0), ("a", "b", "Y", 0.2, "q", 1)], "src string, dst string, edge_type string, confidence double, provenance string, ord int")
    assert rows(collapse_edges(edges)) == [("a", "b", "Y", 0.2, "q", 0)]


def test_inactive_evidence_leaves_defaults(spark, rows):
    edges = spark.createDataFrame([(1,), (2,)], "edge_id long")
    evidence = spark.createDataFrame([(1, "AST", 0.5, True), (1, "LLM", 0.4, True), (2, "AST", 0.5, False)], "edge_id long, resolution_method string, confidence double, is_active boolean")
    assert rows(edges_with_evidence(edges, evidence)) == [(1, "AST", 0.5), (1, "LLM", 0.4), (2, "DETERMINISTIC", 1.0)]
    assert edges_with_evidence(edges, evidence.filter(F.lit(False))).count() == 2


def test_paths_to_targets_enter_only_what_leads_there(spark, rows, monkeypatch):
    """Of a hundred chains one leads to the sink; only its nodes are entered."""
    edges = graph(spark, [(f"e{i}", f"a{i}", 1) for i in range(100)] + [(f"a{i}", f"b{i}", 1) for i in range(100)] + [("b7", "sink", 0.5)])
    starts, ends = spark.createDataFrame([(f"e{i}",) for i in range(100)], "source string"), spark.createDataFrame([("sink",), ("e1",)], "target string")
    sizes = written_rows(monkeypatch)
    found = paths_to_targets(edges, starts, ends, 5, ordered=False)
    assert rows(found, "source", "target", "hops", "confidence") == [("e1", "e1", 0, 1.0), ("e7", "sink", 3, 0.5)]
    assert max(n for name, n in sizes if name in [f"reach-{k}" for k in range(1, 6)]) <= 1
    assert "ord" not in found.columns and "ord" in paths_to_targets(edges, starts, ends, 5).columns


def test_targets_are_no_rows_of_first_route_rounds(spark, monkeypatch):
    """Ends that lead nowhere are joined once, at the end; a target with edges of its own is passed through."""
    sizes = written_rows(monkeypatch)
    edges = graph(spark, [("s", "a", 1)] + [("a", f"t{i}", 1) for i in range(50)] + [("t3", "u", 0.5)])
    wanted = spark.createDataFrame([("s", f"t{i}") for i in range(50)] + [("s", "u"), ("s", "s"), ("none", "none")], "source string, target string")
    for hops in (3, 5):
        found = {r["target"]: r["nodes"] for r in first_paths_between(edges, wanted, hops).collect()}
        assert found == {f"t{i}": ["s", "a", f"t{i}"] for i in range(50)} | {"u": ["s", "a", "t3", "u"], "s": ["s"]}
    assert max(n for name, n in sizes if name in ("routes-reached", "routes-before")) <= 1


def test_best_reach_does_not_carry_on_what_has_no_edges(spark, rows, monkeypatch):
    """Two rounds reach all; the second round's nodes have no edges, so there is no third, and nothing is written twice."""
    sizes = written_rows(monkeypatch)
    found = best_reach(graph(spark, [("a", "b", 0.5), ("a", "b", 0.9), ("b", "c", 0.8), ("b", "d", 1)]), spark.createDataFrame([("a",)], "source string"), 9)
    assert rows(found, "node", "confidence", "hops") == [("a", 1.0, 0), ("b", 0.9, 1), ("c", 0.8, 2), ("d", 0.9, 2)]
    assert [n for name, n in sizes if name == "reach-reached"] == [1, 2] and [n for name, n in sizes if name == "reach"] == [1]

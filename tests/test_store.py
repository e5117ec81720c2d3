import threading
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.operators.incremental import cached_results, change_feed, impact_plan, reusable_dossiers, snapshot_diff
from casegraph.operators.store import Store, close_scan, deactivate, delete_files, invalidate_files, last_arrivals, part_of, resolve_paths, upsert
from casegraph.sources.sinks import write_document
from casegraph.streaming.events import EventLog, StoreEventLog, critical, durable_sink, log_rows, path_states, read_log, stream_log


def test_upsert_keeps_and_replaces(spark, rows):
    base = spark.createDataFrame([(1, "a", "old", "x"), (2, "b", "old", "x")], "id long, k string, kept string, v string")
    delta = spark.createDataFrame([(9, "b", "new", "y", 1), (9, "b", "newer", None, 2), (9, "c", "new", "z", 3)], "id long, k string, kept string, v string, seq int")
    assert rows(upsert(base, delta, ["k"], ["id", "kept"], "seq")) == [(1, "a", "old", "x"), (2, "b", "old", None), (9, "c", "new", "z")]


def test_upsert_null_keys_and_empty_sides(spark, rows):
    base = spark.createDataFrame([(None, 1)], "k string, v int")
    assert rows(upsert(base, spark.createDataFrame([(None, 2)], "k string, v int"), ["k"])) == [(None, 2)]
    assert rows(upsert(base.limit(0), base, ["k"])) == [(None, 1)]
    assert rows(upsert(base, base.limit(0), ["k"])) == [(None, 1)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=8))
def test_upsert_is_idempotent(spark, delta):
    base = spark.createDataFrame([(0, -1), (9, -1)], "k int, v int")
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(delta)], "k int, v int, seq int")
    once = upsert(base, df, ["k"], (), "seq")
    expected = {0: -1, 9: -1} | dict(delta)
    assert {r.k: r.v for r in once.collect()} == expected
    assert {r.k: r.v for r in upsert(once, df, ["k"], (), "seq").collect()} == expected


def test_last_arrival(spark, rows):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0)], "k string, v int, seq int")
    assert rows(last_arrivals(df, ["k"], "seq")) == [("a", 1)]


def model(spark):
    def df(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    return {
        "files": df([(1, "f1"), (2, "f2")], "file_id long, rel_path string"),
        "symbols": df([(10, 1), (11, 1), (20, 2)], "symbol_id long, file_id long"),
        "endpoints": df([(5, 2, 10)], "endpoint_id long, file_id long, handler_symbol_id long"),
        "candidate_sinks": df([(7, 1, 10), (8, 2, 11)], "sink_id long, file_id long, symbol_id long"),
        "graph_edges": df([(100, 10, 20), (101, 20, 20), (102, 20, 11)], "edge_id long, caller_symbol_id long, callee_symbol_id long"),
        "graph_edge_evidence": df([(100, True), (101, True), (102, True), (102, True)], "edge_id long, is_active boolean"),
        "scan_candidate_paths": df([("p7", 7, 5, "RESOLVED"), ("p8", 8, None, "RESOLVED")], "path_id string, sink_id long, endpoint_id long, state string"),
        "scan_dossiers": df([("d7", "p7"), ("d8", "p8")], "dossier_id string, path_id string"),
    }


def test_invalidate(spark, rows):
    m = model(spark)
    evidence, paths = invalidate_files(m["graph_edges"], m["graph_edge_evidence"], m["scan_candidate_paths"], m["symbols"], m["candidate_sinks"], m["files"].filter("file_id = 1"))
    assert rows(evidence, "edge_id", "is_active") == [(100, False), (101, True), (102, False), (102, False)]
    assert rows(paths, "path_id", "state") == [("p7", "UNRESOLVED"), ("p8", "RESOLVED")]


def test_cascade(spark, rows):
    m = model(spark)
    after = delete_files(m, m["files"].filter("file_id = 1"))
    assert rows(after["symbols"], "symbol_id") == [(20,)]
    assert rows(after["graph_edges"], "edge_id") == [(101,)] and rows(after["graph_edge_evidence"], "edge_id") == [(101,)]
    assert rows(after["endpoints"], "endpoint_id", "handler_symbol_id") == [(5, None)]
    assert rows(after["candidate_sinks"], "sink_id", "symbol_id") == [(8, None)]
    assert rows(after["scan_dossiers"]) == [("d7", None), ("d8", "p8")]


def test_store_versions_and_evolution(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("files").count() == 0
    one = spark.createDataFrame([("a.py", "h1")], "rel_path string, file_hash string")
    first = store.merge("files", one).select("file_id", "rel_path", "is_vendor", "execution_domain").first()
    assert first["is_vendor"] is False and first["execution_domain"] == "APPLICATION_RUNTIME"
    store.merge("files", spark.createDataFrame([("a.py", "h2"), ("b.py", "h3")], "rel_path string, file_hash string"))
    assert rows(store.read("files"), "rel_path", "file_hash") == [("a.py", "h2"), ("b.py", "h3")]
    assert store.read("files").filter("rel_path = 'a.py'").first()["file_id"] == first["file_id"]
    # An attempt that never finished isn't seen.
    (tmp_path / "s" / "files" / "v9").mkdir()
    assert store.read("files").count() == 2
    with pytest.raises(Exception, match="(?i)divide|zero"):
        store.update("files", lambda f: f.withColumn("loc", F.expr("1 div (length(rel_path) - length(rel_path))")))
    assert store.read("files").count() == 2


def test_tables_commit_together(spark, tmp_path, rows, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))

    def named(path, status):
        return {
            "files": S.evolve(spark.createDataFrame([(path,)], "rel_path string"), "files"), "scans": S.evolve(spark.createDataFrame([("s", status)], "scan_id string, status string"), "scans")
        }

    store.commit(named("a.py", "INDEXING"))
    before = store.read("files")
    # A writer that dies between two tables, or before the commit is named, changes nothing.
    broken = named("b.py", "COMPLETED")
    broken["scans"] = broken["scans"].withColumn("status", F.expr("if(length(scan_id) > 0, raise_error('lost'), status)"))
    with pytest.raises(Exception, match="lost"):
        store.commit(broken)
    assert rows(store.read("files"), "rel_path") == [("a.py",)] and rows(store.read("scans"), "status") == [("INDEXING",)]
    store.commit(named("c.py", "COMPLETED"))
    other = Store(spark, str(tmp_path / "s"))
    assert rows(other.read("files"), "rel_path") == [("c.py",)] and rows(other.read("scans"), "status") == [("COMPLETED",)]
    assert rows(before, "rel_path") == [("a.py",)]  # a reader at work keeps its version


def test_a_merge_touches_the_parts_of_its_keys(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    many = spark.range(20_000).select(F.concat(F.lit("f"), "id").alias("rel_path"), F.lit("old").alias("file_hash"))
    store.merge("files", many)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "s" / "files").rglob("*.parquet")}
    assert len({f.parent.name for f in before}) == 64
    ids = dict(store.read("files").select("rel_path", "file_id").collect())
    delta = [(f"f{k * 977}", "new") for k in range(9)] + [("another", "new")]
    store.merge("files", spark.createDataFrame(delta, "rel_path string, file_hash string"))
    written = {f for f in (tmp_path / "s" / "files").rglob("*.parquet")} - set(before)
    assert 1 <= len({f.parent.name for f in written}) <= 10
    assert all(f.stat().st_mtime_ns == at for f, at in before.items() if f.exists())
    after = store.read("files")
    assert after.count() == 20_001 and rows(after.filter("file_hash = 'new'"), "rel_path") == sorted((p,) for p, _ in delta)
    assert all(ids[r["rel_path"]] == r["file_id"] for r in after.filter("rel_path <> 'another'").collect())
    # The base of such a merge is read from the parts of its keys alone.
    touched = [r[0] for r in spark.createDataFrame(delta, "rel_path string, file_hash string").select(part_of("files", 64)).distinct().collect()]
    assert len(store.read("files", touched).inputFiles()) < len(after.inputFiles()) / 3
    # What no state needs any more is gone after the next commit.
    store.merge("files", spark.createDataFrame(delta, "rel_path string, file_hash string"))
    assert sum("v1" in str(f) for f in (tmp_path / "s" / "files").rglob("*.parquet")) < len(before)
    assert store.read("files").count() == 20_001


def test_an_update_touches_the_parts_of_its_rows(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.merge("graph_edge_evidence", spark.range(2_000).select(F.col("id").alias("edge_id"), F.lit(0.5).alias("confidence")))
    store.merge("graph_edge_evidence", spark.createDataFrame([(7, 0.9)], "edge_id long, confidence double"))
    before = set((tmp_path / "s" / "graph_edge_evidence").rglob("*.parquet"))
    hit = spark.createDataFrame([(7,), (11,), (99_999,)], "edge_id long")
    after = store.update("graph_edge_evidence", lambda e: deactivate(e, hit), touched=hit)
    assert rows(after.filter("not is_active"), "edge_id", "confidence") == [(11, 0.5), (7, 0.5), (7, 0.9)] and after.count() == 2_001
    written = set((tmp_path / "s" / "graph_edge_evidence").rglob("*.parquet")) - before
    assert 1 <= len({f.parent.name for f in written}) <= 3
    # Nothing is touched, or there is nothing to touch.
    assert store.update("graph_edge_evidence", lambda e: deactivate(e, hit), touched=hit.limit(0)).count() == 2_001
    assert store.update("scan_candidate_paths", lambda p: p, touched=spark.createDataFrame([("p",)], "path_id string")).count() == 0


def test_one_transaction_over_merges(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"), parts=4)
    file = lambda name: spark.createDataFrame([(name, "h")], "rel_path string, file_hash string")
    store.merge("files", file("a"))
    other = Store(spark, str(tmp_path / "s"))
    with pytest.raises(RuntimeError):
        with store.transaction():
            store.merge("files", file("b"))
            assert rows(store.read("files"), "rel_path") == [("a",), ("b",)]  # its own writes are seen inside
            assert rows(other.read("files"), "rel_path") == [("a",)]
            raise RuntimeError
    assert rows(store.read("files"), "rel_path") == [("a",)]
    with store.transaction():
        store.merge("files", file("c"))
        store.merge("scans", spark.createDataFrame([("s", "INDEXING")], "scan_id string, status string"))
        with store.transaction():
            store.merge("files", file("d"))
    # A table keeps its number of parts, whoever opens it.
    assert rows(other.merge("files", file("e")), "rel_path") == [("a",), ("c",), ("d",), ("e",)] and other.read("scans").count() == 1
    assert {f.name for f in (tmp_path / "s" / "files").glob("v*/part=*")} <= {f"part={k}" for k in range(4)}
    assert not list((tmp_path / "s" / "files").glob("v2"))  # left by the writer that died


def test_paths_are_resolved_alone(spark, rows):
    paths = spark.createDataFrame([("p", "QUEUED", 1.0), ("q", "QUEUED", 1.0)], "path_id string, state string, reachability_confidence double")
    found = spark.createDataFrame([("q", 0.5), ("z", 0.1)], "path_id string, reachability_confidence double")
    assert rows(resolve_paths(paths, found)) == [("p", "QUEUED", 1.0), ("q", "RESOLVED", 0.5)]


def test_evidence_accumulates(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([(1, 0.5)], "edge_id long, confidence double")
    store.merge("graph_edge_evidence", row)
    store.merge("graph_edge_evidence", row)
    assert store.read("graph_edge_evidence").filter("is_active").count() == 2


def test_violations(spark, rows):
    tables = {
        "files": S.evolve(spark.createDataFrame([(1, "a"), (2, "a")], "file_id long, rel_path string"), "files"),
        "symbols": S.evolve(spark.createDataFrame([(1, 3, "n", "MACRO")], "symbol_id long, file_id long, name string, kind string"), "symbols"),
    }
    assert rows(S.violations(tables)) == [("files", "unique rel_path", 1), ("symbols", "enum kind", 1), ("symbols", "foreign file_id", 1)]


def test_close_scan(spark):
    scans = S.evolve(spark.createDataFrame([("s",)], "scan_id string"), "scans")
    done = close_scan(scans, "s", "COMPLETED", {"n": "1"}).first()
    assert done["status"] == "COMPLETED" and done["completed_at"] is not None and done["stats"] == {"n": "1"}
    assert close_scan(scans, "s", "INDEXING").first()["completed_at"] is None


def test_snapshots(spark, rows):
    old = spark.createDataFrame([("f1", "a"), ("f2", "b"), ("f4", None)], "rel_path string, file_hash string")
    new = spark.createDataFrame([("f1", "x"), ("f3", "c"), ("f4", None)], "rel_path string, file_hash string")
    assert rows(snapshot_diff(old, new)) == [("f1", "MODIFIED"), ("f2", "DELETED"), ("f3", "ADDED"), ("f4", "UNCHANGED")]
    feed = change_feed(spark.createDataFrame([("a\\b",), ("",)], "rel_path string"), spark.createDataFrame([("a/b",)], "rel_path string"))
    assert rows(feed) == [("a/b",)]
    indexed = spark.createDataFrame([("f1", 1), ("f2", 2), ("f5", 5)], "rel_path string, file_id long")
    changed = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "rel_path string")
    assert rows(impact_plan(changed, new, indexed)) == [("f1", "CHANGED", 1), ("f2", "DELETED", 2), ("f3", "CHANGED", None), ("f5", "UNAFFECTED", 5)]


def test_reuse(spark, rows):
    d = spark.createDataFrame([("d1", "p1", "e"), ("d2", "p2", "e"), ("d3", "p1", "other")], "dossier_id string, path_id string, engine_fingerprint string")
    p = spark.createDataFrame([("p1", 1), ("p2", 2)], "path_id string, sink_id long")
    s = spark.createDataFrame([(1, 1), (2, 2)], "sink_id long, file_id long")
    f = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, rel_path string")
    changed = spark.createDataFrame([("b",)], "rel_path string")
    assert rows(reusable_dossiers(d, p, s, f, changed, "e")) == [("d1", "a")]
    assert reusable_dossiers(d, p, s, f, changed, "new").count() == 0


def test_cache_takes_the_newest(spark, rows):
    d = spark.createDataFrame([("d1", "p", "e", 1), ("d2", "p", "e", 2), ("d3", "p", "e", 2), ("d4", "q", "e", 9)], "dossier_id string, path_id string, engine_fingerprint string, created_at int")
    assert rows(cached_results(d.filter("path_id = 'p'"), d), "dossier_id") == [("d3",)]


def test_event_log_with_four_writers(spark, tmp_path):
    log = EventLog(str(tmp_path / "e" / "x.jsonl"), "s")
    kinds = ["SCAN_STARTED", "PATH_TRANSITION"]
    threads = [threading.Thread(target=lambda: [log.log("c", kinds[i % 2], {"i": i}) for i in range(25)]) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    events = read_log(spark, str(tmp_path / "e"))
    assert events.count() == 100 and events.select("event_id").distinct().count() == 100
    assert critical(events).count() == 48


def test_path_states(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("p", "QUEUED", 1), ("p", "RESOLVED", 3), ("p", "RUNNING", 2), ("q", "NONSENSE", 1)], "path_id string, state string, seq long").coalesce(1).write.parquet(str(source))
    stream = path_states(spark.readStream.schema("path_id string, state string, seq long").parquet(str(source)))

    def keep(batch, number):
        batch.write.mode("append").parquet(str(out))

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(out)).collect()] == [("p", "RESOLVED", 3)]


def test_resolved_and_abandoned_paths_leave_the_state(spark, rows, tmp_path):
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "c"
    schema = "path_id string, state string, seq long, second long"

    def arrive(transitions):
        spark.createDataFrame(transitions, schema).coalesce(1).write.mode("append").parquet(str(source))
        timed = spark.readStream.schema(schema).parquet(str(source)).withColumn("at", F.timestamp_seconds("second"))
        stream = path_states(timed, "at", delay="1 second", linger_ms=60_000, abandoned_ms=600_000)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(str(out))).option("checkpointLocation", str(checkpoint))
        query.trigger(availableNow=True).start().awaitTermination()
        held = spark.read.format("statestore").load(str(checkpoint)).select("key.path_id", "value.groupState.state")
        return {r["path_id"]: r["state"] for r in held.collect()}

    many = [(f"r{k}", "RESOLVED", 5, 1_000) for k in range(50)]
    assert set(arrive([("q", "QUEUED", 1, 1_000), ("w", "RUNNING", 1, 1_000), *many])) == {"q", "w", *[p for p, *_ in many]}
    # A replay while a path is remembered changes nothing; when its timer has run out it leaves.
    assert len(arrive([("r1", "RUNNING", 4, 1_010)])) == 52
    assert arrive([("q", "RUNNING", 2, 1_200)]) == {"q": "RUNNING", "w": "RUNNING"}
    assert rows(spark.read.parquet(str(out)).filter("path_id in ('q', 'r1')"), "path_id", "state", "seq") == [("q", "QUEUED", 1), ("q", "RUNNING", 2), ("r1", "RESOLVED", 5), ("r1", "RESOLVED", 5)]
    # Nobody has moved the other on.
    assert arrive([("z", "QUEUED", 1, 1_700)]) == {"q": "RUNNING", "z": "QUEUED"}


def test_many_events_leave_few_files(spark, rows, tmp_path):
    folder = tmp_path / "log"
    events = spark.range(10_000, numPartitions=6).select(
        F.lit("c").alias("component"), F.when(F.col("id") % 2 == 0, "PATH_TRANSITION").otherwise("SCAN_STARTED").alias("event_type"),
        F.create_map(F.lit("i"), F.col("id").cast("string")).alias("payload"),
    )
    log_rows(events, str(folder), "s")
    files = [f for f in folder.rglob("*") if f.is_file() and not f.name.endswith(".crc")]
    assert len(files) == 6 and not list(folder.glob("_pending*"))
    found = read_log(spark, str(folder))
    assert found.count() == found.select("event_id").distinct().count() == 10_000 and critical(found).count() == 5_000
    assert found.filter("scan_id = 's' and timestamp like '20%T%+00:00'").count() == 10_000
    # A batch that fails leaves none of its events, wherever it fails.
    broken = events.withColumn("component", F.expr("if(payload['i'] = '9999', raise_error('lost'), component)"))
    with pytest.raises(Exception, match="lost"):
        log_rows(broken, str(folder), "s")
    assert read_log(spark, str(folder)).count() == 10_000 and not list(folder.glob("_pending*"))
    # Beside single events, as the driver logs them.
    StoreEventLog(spark, str(folder), "s").log("c", "SCAN_STARTED")
    assert read_log(spark, str(folder)).count() == 10_001


def test_a_stream_of_events_appears_once(spark, rows, tmp_path):
    source, folder, checkpoint = tmp_path / "in", tmp_path / "log", tmp_path / "c"
    schema = "event_id string, timestamp string, scan_id string, component string, event_type string, payload map<string,string>"

    def arrive(first, n):
        made = spark.range(first, first + n).select(F.col("id").cast("string").alias("event_id"), *[F.lit("x").alias(c) for c in ("timestamp", "scan_id", "component", "event_type")], F.create_map(F.lit("i"), F.lit("1")).alias("payload"))
        made.write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        durable_sink(stream, str(folder), str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    arrive(0, 100)
    arrive(100, 50)
    assert rows(read_log(spark, str(folder)), "event_id") == sorted((str(k),) for k in range(150))
    assert sorted(f.name for f in folder.iterdir() if f.name[0] != "_") == ["b000000000", "b000000001"]
    # The last batch is committed again after a restart: it is the same batch.
    (checkpoint / "commits" / "1").unlink()
    (checkpoint / "commits" / ".1.crc").unlink(missing_ok=True)
    arrive(150, 5)
    assert rows(read_log(spark, str(folder)), "event_id") == sorted((str(k),) for k in range(155))
    assert stream_log(spark, str(folder)).isStreaming


def test_a_document_is_written_in_order(spark, tmp_path):
    pieces = spark.range(5_000, numPartitions=7).select((F.col("id") % 3).alias("part"), F.col("id").alias("ord"), F.concat(F.col("id").cast("string"), F.lit("é ")).alias("text"))
    write_document(pieces.repartition(5), str(tmp_path / "doc.txt"), "part", "ord")
    assert (tmp_path / "doc.txt").read_text() == "".join(f"{k}é " for part in range(3) for k in range(5_000) if k % 3 == part)
    broken = pieces.withColumn("text", F.expr("if(ord = 4999, raise_error('lost'), text)"))
    with pytest.raises(Exception, match="lost"):
        write_document(broken, str(tmp_path / "other.txt"), "part", "ord")
    assert [f.name for f in tmp_path.iterdir()] == ["doc.txt"]
    write_document(pieces.limit(0), str(tmp_path / "none.txt"), "part", "ord")
    assert (tmp_path / "none.txt").read_text() == ""

import json

import duckdb
import pytest

from casegraph.operators.indexer import index_source
from casegraph.operators.report import blueprints, markdown_document, sarif_document, severity_order
from casegraph.operators.store import Store
from casegraph.plans.diff import diff, report, report_file
from casegraph.plans.scan import resume, scan
from casegraph.queries import load_all
from casegraph.streaming.events import read_log

SF = "/root/testdata/sf0.001"


def test_a_scan_that_dies_leaves_the_state_before_it(spark, repository, tmp_path, monkeypatch):
    audit = str(tmp_path / "audit")
    scan(spark, str(repository), audit)
    store = Store(spark, audit)
    names = ("files", "symbols", "endpoints", "candidate_sinks", "graph_edges", "graph_edge_evidence", "scan_candidate_paths", "scan_dossiers")
    before = {n: sorted(map(str, store.read(n).collect())) for n in names}
    (repository / "new.py").write_text("import os\ndef run(x):\n    os.system(x)\n")
    plain = Store.merge

    def dying(self, table, *rest):
        if table == "graph_edges":
            raise KeyboardInterrupt
        return plain(self, table, *rest)

    monkeypatch.setattr(Store, "merge", dying)
    with pytest.raises(KeyboardInterrupt):
        scan(spark, str(repository), audit)
    monkeypatch.undo()
    assert {n: sorted(map(str, Store(spark, audit).read(n).collect())) for n in names} == before


@pytest.fixture
def repository(tmp_path):
    files = {
        "package.json": '{"dependencies":{"express":"4"}}',
        "server.js": "const express = require('express');\nconst app = express();\napp.use(authMiddleware);\nconst api = require('./routes/login');\napp.use('/api/v1', api);\n",
        "routes/login.js": "function loginController(req, res) {\n  helper(req.body.url);\n}\nfunction helper(u) {\n  fetch(u);\n}\nrouter.post('/login', loginController);\n",
        "app.py": "import os\ndef run(x):\n    os.system(x)\n",
        "tests/a.spec.js": "eval(x)\n",
        "node_modules/p/index.js": "eval(x)\n",
    }
    root = tmp_path / "repo"
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_scan_diff_report_resume(spark, repository, tmp_path):
    audit = str(tmp_path / "audit")
    scan_id = scan(spark, str(repository), audit)
    store = Store(spark, audit)
    found = {r["title"]: r for r in store.read("scan_dossiers").collect()}
    assert set(found) == {"SSRF in login.js:5", "RCE in app.py:3"}
    ssrf, rce = found["SSRF in login.js:5"], found["RCE in app.py:3"]
    assert (ssrf["verdict"], ssrf["reachability_confidence"]) == ("EXPLOITABLE", 0.95)
    assert "/api/v1/login" in ssrf["repro_curl_template"] and "BT_FLOW_MARKER_001" in ssrf["repro_curl_template"]
    assert rce["verdict"] == "INSUFFICIENT_CONTEXT" and rce["repro_curl_template"] is None
    assert store.read("scans").first()["status"] == "COMPLETED"
    events = read_log(spark, f"{audit}/events/{scan_id}")
    assert sorted(r["event_type"] for r in events.collect()) == ["PATH_TRANSITION", "SCAN_STARTED"]
    path = store.read("scan_candidate_paths").filter("hop_count > 1").first()
    assert path["hop_count"] == 3 and path["state"] == "RESOLVED"

    markdown = report(spark, audit, scan_id)
    assert markdown.startswith("# Security Review Research Dossier") and "**Total Findings:** 2" in markdown
    sarif = json.loads(report(spark, audit, scan_id, "sarif"))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == 2
    assert len(json.loads(report(spark, audit, scan_id, "graph"))["nodes"]) == 6

    for kind in ("md", "sarif", "graph"):
        report_file(spark, audit, scan_id, f"file://{tmp_path}/out.{kind}", kind)
        assert (tmp_path / f"out.{kind}").read_text() == report(spark, audit, scan_id, kind)
    assert not list(tmp_path.glob("_pending*"))

    graph = json.loads(report(spark, audit, scan_id, "graph"))
    assert {n["kind"] for n in graph["nodes"]} == {"SYMBOL", "ENDPOINT", "SINK"} and set(graph["edges"][0]) == {"caller_symbol_id", "callee_symbol_id", "edge_type", "provenance", "confidence"}
    scopes = {"symbol": "helper", "endpoint": "/api/v1/login", "path": path["path_id"], "finding": ssrf["dossier_id"]}
    sizes = {scope: len(json.loads(report(spark, audit, None, "graph", scope, key))["nodes"]) for scope, key in scopes.items()}
    assert sizes == {"symbol": 4, "endpoint": 1, "path": 4, "finding": 1}
    assert json.loads(report(spark, audit, None, "graph", "path", "nowhere")) == {"nodes": [], "edges": []}

    edges = store.read("graph_edges").count()
    assert resume(spark, audit, scan_id) == 0
    assert store.read("graph_edges").count() == edges

    (repository / "app.py").write_text("def run(x):\n    pass\n")
    (repository / "routes/login.js").unlink()
    plan = diff(spark, str(repository), audit)
    fate = {r["rel_path"]: r["status"] for r in plan.paths.collect()}
    assert fate["app.py"] == "CHANGED" and fate["routes/login.js"] == "DELETED" and fate["server.js"] == "UNAFFECTED"
    assert store.read("endpoints").count() == 0 and store.read("graph_edges").count() == 0
    assert store.read("scan_candidate_paths").select("state").first()[0] == "UNRESOLVED"
    assert resume(spark, audit, scan_id) == 1


def test_index():
    python = index_source("import os\nfrom a import b as c\nclass AuthService:\n    def verify_token(self):\n        return db.execute(q)\ndef authenticate_user():\n    pass\n", "python")
    assert [(s[0], s[1]) for s in python.symbols] == [("AuthService", "CLASS"), ("verify_token", "METHOD"), ("authenticate_user", "FUNCTION")]
    assert [i[0] for i in python.imports] == ["os", "b"] and [c[0] for c in python.calls] == ["db.execute"]
    script = index_source("import {x} from 'm';\nfunction handleRequest(req) {\n  exec(req.cmd);\n}\nclass A {\n  go(a) { run(a); }\n}\nconst f = (a) => { g(a); };", "javascript")
    assert [(s[0], s[1], s[7]) for s in script.symbols] == [("handleRequest", "FUNCTION", "global"), ("A", "CLASS", "global"), ("go", "METHOD", "global.A"), ("f", "FUNCTION", "global")]
    assert [(c[0], c[3]) for c in script.calls] == [("exec", "global.handleRequest"), ("run", "global.A.go"), ("g", "global.f")]
    for broken in (index_source("def (", "python"), index_source("x", "cobol"), index_source(None, "python"), index_source("function (((", "javascript")):
        assert not broken.symbols


def test_index_by_grammar():
    go = index_source('package p\nimport "fmt"\n// func no() {}\nfunc Run[T any](a T) {\n\tif (true) { fmt.Println("f(", a) }\n}\nfunc (r *R) Method() { help() }\n', "go")
    assert [(s[0], s[1], s[2], s[4]) for s in go.symbols] == [("Run", "FUNCTION", 4, 6)] and [(c[0], c[3]) for c in go.calls] == [("fmt.Println", "global.Run"), ("Method", "global"), ("help", "global")]
    java = index_source("package a;\n/* class No {} */ public class A { class B { void m() {} } }\nclass C {}\n", "java")
    assert [(s[0], s[7]) for s in java.symbols] == [("A", "global"), ("B", "global.A"), ("C", "global")] and not java.calls
    php = index_source("<?php\n# function no() {}\nfunction a($x) { return '}'; }\nclass K { function m() { if (1) { } } }\nfunction b() {}\n", "php")
    assert [(s[0], s[1]) for s in php.symbols] == [("a", "FUNCTION"), ("K", "CLASS"), ("b", "FUNCTION")]
    ruby = index_source("# skip(1)\nuser.find(1)\nputs('x(y)')\nif (a) then save!(b) end\n", "ruby")
    assert [c[0] for c in ruby.calls] == ["user.find", "puts", "save!"] and not ruby.symbols
    for name in ("go", "java", "php", "ruby"):
        assert index_source("}" * 50 + "{" * 50, name) is not None


@pytest.mark.parametrize("way", ["names", "everything"])
def test_diff_by_other_feeds(spark, repository, tmp_path, way):
    audit = str(tmp_path / "audit")
    scan(spark, str(repository), audit)
    names = spark.createDataFrame([("app.py",), ("routes\\login.js",)], "rel_path string")
    plan = diff(spark, str(repository), audit, everything=way == "everything", **({"tracked": names} if way == "names" else {}))
    changed = {r["rel_path"] for r in plan.paths.filter("status = 'CHANGED'").collect()}
    there = {r["rel_path"] for r in plan.paths.collect()}
    assert changed == ({"app.py", "routes/login.js"} if way == "names" else there) and len(there) == 6
    assert plan.reusable.count() == 0


DOSSIER = (
    "dossier_id string, scan_id string, title string, vuln_class string, severity string, cwe_id string, verdict string, confidence double, "
    "source_trace array<struct<file:string,line:int>>, sanitizer_analysis map<string,string>, repro_curl_template string, mitigation_notes string"
)


def test_documents(spark):
    rows = [
        ("d1", "s", "Injection \"x\"", "RCE", "HIGH", "CWE-78", "EXPLOITABLE", 0.9, [("a.py", 3), ("b.py", 4)], {"bypass_notes": "n", "empty": ""}, "curl x\n", "fix"),
        ("d2", "s", "T2", "RCE", "LOW", "CWE-78", "SAFE_PROVEN", 0.95, [], None, None, None), ("d3", "s", "T3", "SSRF", "CRITICAL", None, "EXPLOITABLE", 0.5, None, {}, "", ""),
    ]
    dossiers = severity_order(spark.createDataFrame(rows, DOSSIER))
    sarif = json.loads(sarif_document(dossiers).first()[0])["runs"][0]
    assert [r["id"] for r in sarif["tool"]["driver"]["rules"]] == ["SSRF", "CWE-78"]
    results = {r["message"]["text"].split(":")[0]: r for r in sarif["results"]}
    assert len(results['Injection "x"']["codeFlows"][0]["threadFlows"][0]["locations"]) == 2
    assert "codeFlows" not in results["T2"] and results["T2"]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "unknown"
    text = markdown_document(dossiers, "s").first()[0]
    assert "### 1. T3" in text and "**Bypass Notes:** n" in text and "Empty" not in text and "```bash\ncurl x\n```" in text and "fix" in text
    assert "**Total Findings:** 0" in markdown_document(dossiers.limit(0)).first()[0]
    assert json.loads(sarif_document(dossiers.limit(0)).first()[0])["runs"][0]["results"] == []


def test_report_documents_hold_every_dossier(spark):
    orders = {}
    for key, customer in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        orders.setdefault(f"c{customer}", []).append(key)
    found = load_all()[0]["report_documents"](spark, SF).collect()
    markdown, sarif = ({r["scan_id"]: r["document"] for r in found if r["kind"] == kind} for kind in ("md", "sarif"))
    assert len(found) == 2 * len(orders) and set(markdown) == set(sarif) == set(orders)
    for scan_id, keys in orders.items():
        assert f"**Scan ID:** `{scan_id}`\n**Total Findings:** {len(keys)}\n" in markdown[scan_id]
        assert all(f"| `d{key}` |" in markdown[scan_id] for key in keys)
        run = json.loads(sarif[scan_id])["runs"][0]
        # A result's place is its dossier's, in the order of keys.
        lines = [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]]
        assert lines == [1 if key % 5 == 0 else key % 9 + 1 for key in sorted(keys)]
        assert {r["ruleId"] for r in run["results"]} == {r["id"] for r in run["tool"]["driver"]["rules"]}


def test_blueprints(spark):
    ddl = "method string, route string, auth_state string, param_location string, param_name string, siblings array<struct<location:string,name:string,dummy:string>>, sink string"
    rows = [("POST", "/x", "REQUIRED", "BODY", "id", [(None, "n", "1")], "eval"), (None, None, "UNKNOWN", None, None, None, "eval"), ("get", "/y", "UNKNOWN", None, None, None, "eval")]
    post, bare, get = blueprints(spark.createDataFrame(rows, ddl)).collect()
    assert "Bearer ${AUTH_TOKEN}" in post["curl_command"] and "BT_FLOW_MARKER_001" in post["curl_command"] and post["reproduction_type"] == "HTTP_TEMPLATE"
    assert bare["reproduction_type"] == "NON_HTTP_TEMPLATE" and bare["curl_command"] is None
    assert get["curl_command"].startswith("curl -G ") and "Bearer" not in get["curl_command"]


CHECKED = sorted(set(load_all()[1]))


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_oracle(spark, name):
    queries, oracles = load_all()
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.sql(oracles[name])
    found = queries[name](spark, SF)
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)

    def shown(value):
        return f"{value:.9g}" if isinstance(value, float) else str(value)

    left = sorted(tuple(shown(v) for v in r) for r in found.select(*columns).collect())
    right = sorted(tuple(shown(v) for v in r) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall())
    assert left == right


def test_tool_output_is_gated_and_placed(spark, repository, tmp_path):
    from casegraph.sources.tools import read_endpoints, read_findings, read_secrets

    def raw(value):
        return spark.createDataFrame([(json.dumps(value),)], "raw string")

    endpoints = read_endpoints(raw({"endpoints": [{"url": "/new", "details": {"file": "app.py", "line": 2}}, {"url": "/no", "details": {"file": "tests/a.spec.js"}}]}))
    findings = read_findings(raw({"results": [
        {"check_id": "r.ssrf", "path": p, "start": {"line": 1}, "extra": {"message": "m", "severity": "WARNING", "lines": "x"}} for p in ("unseen.py", "tests/a.spec.js")
    ]}))
    secrets = read_secrets(raw({"file": "keys.txt", "Raw": "k"}))
    audit = str(tmp_path / "audit")
    scan(spark, str(repository), audit, endpoints=endpoints, findings=findings, secrets=secrets)
    store = Store(spark, audit)
    assert {r[0] for r in store.read("endpoints").select("route_pattern").collect()} == {"/new", "/api/v1/login"}
    assert {r[0] for r in store.read("files").filter("language = 'unknown'").select("rel_path").collect()} == {"unseen.py", "keys.txt"}
    found = {r["title"]: r for r in store.read("scan_dossiers").collect()}
    assert set(found) == {"SSRF in login.js:5", "RCE in app.py:3", "SSRF in unseen.py:1"}
    # The tool's endpoint lies in the sink's own file: a match with less confidence than a path.
    assert (found["RCE in app.py:3"]["verdict"], found["RCE in app.py:3"]["reachability_confidence"]) == ("EXPLOITABLE", 0.85)
    assert found["SSRF in unseen.py:1"]["severity"] == "HIGH"


def test_command_line(spark, repository, tmp_path, capsys, monkeypatch):
    from casegraph import __main__ as command

    monkeypatch.chdir(tmp_path)
    assert command.main(["scan", str(repository)]) == 0
    out = tmp_path / "r.sarif"
    assert command.main(["report", str(repository), "--format", "sarif", "--output", str(out)]) == 0
    assert len(json.loads(out.read_text())["runs"][0]["results"]) == 2
    assert command.main(["diff", str(repository)]) == 0
    assert "changed files: 0, reusable dossiers: 2" in capsys.readouterr().out
    assert command.main(["resume", str(repository)]) == 0
    assert command.main(["diff", str(repository), "--everything"]) == 0
    assert "changed files: 6, reusable dossiers: 0" in capsys.readouterr().out
    assert command.main(["report", str(repository), "--format", "graph", "--scope", "endpoint", "--key", "/api/v1/login"]) == 0
    assert len(json.loads(capsys.readouterr().out)["nodes"]) == 1
    with pytest.raises(SystemExit):
        command.main(["report", str(tmp_path / "nowhere")])

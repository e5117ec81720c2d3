import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith

from casegraph.functions.scoring import engine_fingerprint, engine_fingerprints
from casegraph.operators.classify import classify_scope, eligible
from casegraph.operators.routes import harvest_vendor, identify_framework, mount_of, resolve_routes
from casegraph.sources.files import describe_files, hydrate_snippet, inside_root, line_range, listing, listing_rounds, read_contents, scan_repository
from casegraph.sources.reader import RepositoryReader, open_repository
from casegraph.sources.tools import read_endpoints, read_findings, read_secrets


def test_file_rules(spark, rows):
    contents = [
        ("app.py", b"x = 1\n"), ("node_modules/p/index.js", b"a"), ("min.js", b"x" * 2000), ("big.py", b"\n" * (2 * 1024 * 1024 + 1)),
        ("bin.py", b"a\x00b"), ("empty.rb", b""), ("latin.go", b"\xff\n"),
    ]
    found = describe_files(spark.createDataFrame(contents, "rel_path string, content binary"))
    assert rows(found, "rel_path", "language", "is_vendor", "loc") == [
        ("app.py", "python", False, 1), ("empty.rb", "ruby", False, 0), ("latin.go", "go", False, 1), ("node_modules/p/index.js", "javascript", True, 1),
    ]
    assert all(len(r["file_hash"]) == 64 for r in found.collect())


def test_scan_sees_hidden_files(spark, tmp_path, rows):
    for name in ("a.py", ".github/workflows/ci.yml", "pkg/__init__.py", ".git/config", "we ird [x]*.js"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x\n")
    assert rows(scan_repository(spark, str(tmp_path)), "rel_path") == [(".github/workflows/ci.yml",), ("a.py",), ("pkg/__init__.py",), ("we ird [x]*.js",)]


def test_listing_goes_down_any_depth(spark, tmp_path, rows):
    names = ["a.py", "x/b.py", "x/y/c.py", "x/y/z/d.py", "x/y/z/w/v/e.py", "x/.git/no.py", "node_modules/p/q/r/s.js", "__pycache__/no.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    (tmp_path / "empty").mkdir()
    found = listing(spark, str(tmp_path))
    assert rows(found, "rel_path", "length") == sorted((n, 2) for n in names if ".git" not in n and "__pycache__" not in n)
    assert rows(read_contents(spark, f"file://{tmp_path}"), "rel_path") == rows(found, "rel_path")


def test_one_deep_folder_is_listed_by_several_tasks(spark, tmp_path, rows):
    """All files lie below one third-level folder, in 300 folders of three levels."""
    for k in range(100):
        for inner in ("", "/m", "/m/n"):
            folder = tmp_path / f"a/b/c/d{k}{inner}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "f.py").write_text("x\n")
    rounds = listing_rounds(spark, str(tmp_path), most=20)
    files = [r.filter("not left") for r in rounds]
    assert sum(f.count() for f in files) == 300
    # The first round has one folder to begin with; in the following ones every task has its share.
    assert files[0].select("task").distinct().count() == 1 and files[1].select("task").distinct().count() == spark.sparkContext.defaultParallelism
    assert all(r.groupBy("task").count().agg(F.max("count")).first()[0] <= 20 + 100 for r in rounds)
    assert len(rounds) <= 6
    assert rows(listing(spark, str(tmp_path)), "rel_path") == sorted((f"a/b/c/d{k}{i}/f.py",) for k in range(100) for i in ("", "/m", "/m/n"))


def test_a_repository_as_a_data_source(spark, tmp_path, rows):
    names = ["a.py", "src/b.py", "src/y/c.js", "src/y/z/d.py", "lib/src/e.py", "x/.git/no.py", "__pycache__/no.py", ".github/w.yml", "srcs/f.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "big.py").write_bytes(b"\n" * (2 * 1024 * 1024 + 1))
    whole = open_repository(spark, str(tmp_path))
    assert rows(describe_files(whole)) == rows(scan_repository(spark, str(tmp_path)))
    assert rows(whole, "rel_path") == sorted((n,) for n in names if "no.py" not in n)
    for condition in ("rel_path like 'src/%'", "rel_path like 'sr%'", "rel_path = 'src/y/c.js'", "rel_path in ('a.py', 'lib/src/e.py')", "rel_path like '%.py' and rel_path like 'src/y%'", "length(rel_path) > 8", "rel_path = 'none'"):
        assert rows(whole.filter(condition), "rel_path") == rows(read_contents(spark, str(tmp_path)).filter(condition), "rel_path"), condition
    reader = RepositoryReader(str(tmp_path), 4)
    other = EqualTo(("content",), b"x")
    assert list(reader.pushFilters([StringStartsWith(("rel_path",), "src/"), other])) == [other]
    met = []
    plain = reader._list
    reader._list = lambda folder: met.append(folder) or plain(folder)
    found = [n for share in reader.partitions() for batch in reader.read(share) for n in batch.column("rel_path").to_pylist()]
    assert sorted(found) == ["src/b.py", "src/y/c.js", "src/y/z/d.py"]
    assert set(met) == {"", "src", "src/y", "src/y/z"}  # no other folder is listed


def test_tools_can_be_added(spark, rows):
    from casegraph.sources import tools

    raw = spark.createDataFrame([('{"endpoints":[{"url":"/a"}]}',)], "raw string")
    tools.register_adapter(tools.Adapter("mapper", "endpoints", read_endpoints))
    try:
        found = tools.read_tools({"mapper": raw, "noir": raw, "semgrep": None, "other": raw})
    finally:
        del tools.ADAPTERS["mapper"]
    assert set(found) == {"endpoints"} and found["endpoints"].count() == 2


@pytest.mark.parametrize("few", [200, 0])
def test_mounts_fit_either_way(spark, rows, few):
    files = spark.createDataFrame([("src/routes/user.js",), ("lib/admin.js",), ("lib/none.js",), ("a/user.ts",)], "rel_path string")
    mounts = spark.createDataFrame([("routes/user", "/u", 2), ("very/admin/place", "/a", 1), ("user", "/first", 0), ("", "/any", 9)], "import_key string, prefix string, ord int")
    expected = []
    for (path,) in files.collect():
        stem = path.rsplit("/", 1)[1].rsplit(".", 1)[0]
        fits = [(o, p) for k, p, o in mounts.collect() if k in path or stem in k]
        expected.append((path, min(fits)[1]))
    assert rows(mount_of(files, mounts, few)) == sorted(expected)


def test_root_is_a_fence(tmp_path):
    assert inside_root("a/b", str(tmp_path)).startswith(str(tmp_path))
    with pytest.raises(ValueError):
        inside_root("../x", str(tmp_path))


@pytest.mark.parametrize(
    ("path", "domain", "role"),
    [
        (".github/workflows/ci.yml", "CI_CD_PIPELINE", "CONFIGURATION"), ("frontend/src/app.spec.ts", "TEST_MOCK", "UTILITY_HELPER"),
        ("routes/login.ts", "APPLICATION_RUNTIME", "ROUTE_HANDLER"), ("infra/main.tf", "INFRASTRUCTURE_IAC", "CONFIGURATION"),
        ("frontend/src/assets/private/three.js", "VENDOR_DEPENDENCY", "UTILITY_HELPER"), ("x/y.txt", "APPLICATION_RUNTIME", "UNKNOWN"),
    ],
)
def test_scope(spark, path, domain, role):
    files = spark.createDataFrame([(path, None, False)], "rel_path string, language string, is_vendor boolean")
    found = classify_scope(files).first()
    assert (found["execution_domain"], found["runtime_role"]) == (domain, role)


def test_eligibility(spark):
    cases = spark.createDataFrame(
        [("TEST_MOCK", "SSRF", False), ("VENDOR_DEPENDENCY", "XSS", False), ("APPLICATION_RUNTIME", "SQLI", True), ("CI_CD_PIPELINE", "SECRETS", True),
         ("CI_CD_PIPELINE", "", False), ("INFRASTRUCTURE_IAC", "SSRF", False), (None, "SSRF", True)],
        "d string, t string, expected boolean",
    )
    assert cases.filter(eligible(F.col("d"), F.col("t")) != F.col("expected")).count() == 0


def test_snippets(spark):
    df = spark.createDataFrame([("a\nb \nc",)], "t string")
    one = lambda c: df.select(c).first()[0]
    assert one(hydrate_snippet(F.lit("requires login"), F.col("t"), F.lit(2))) == "b"
    assert one(hydrate_snippet(F.lit("Requires Login "), F.lit(None).cast("string"), F.lit(2))) == "Requires Login "
    assert one(hydrate_snippet(F.lit("own"), F.col("t"), F.lit(2))) == "own"
    assert one(hydrate_snippet(F.lit(""), F.col("t"), F.lit(9))) == ""
    assert one(line_range(F.col("t"), F.lit(-3), F.lit(1))) == "a"
    assert one(line_range(F.lit(None).cast("string"), F.lit(1), F.lit(2))) == ""


def test_tool_output(spark, rows):
    def raw(x):
        return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),)], "raw string")

    endpoints = read_endpoints(raw({"endpoints": [{"method": "post", "url": "/api/v1/user", "details": {"file": "app.py", "line": 42}}]}))
    assert rows(endpoints, "http_method", "route_pattern", "rel_path", "line_number") == [("POST", "/api/v1/user", "app.py", 42)]
    finding = {"results": [{"check_id": "py.rce", "path": "server.py", "start": {"line": 15, "col": 1}, "extra": {"message": "m", "metadata": {"cwe": ["CWE-78", "x"]}, "severity": "ERROR", "lines": "x"}}]}
    assert rows(read_findings(raw(finding)), "rel_path", "vuln_class", "triage_severity", "line_number", "cwe_id") == [("server.py", "RCE", "CRITICAL", 15, "CWE-78")]
    secret = json.dumps({"SourceMetadata": {"Data": {"Filesystem": {"file": "config.py"}}}, "DetectorName": "AWS", "Verified": True, "Raw": "k", "line": 12})
    assert rows(read_secrets(raw(secret + "\nbroken {\n\n")), "rel_path", "detector_name", "verified", "line_number") == [("config.py", "AWS", True, 12)]
    for reader in (read_endpoints, read_findings, read_secrets):
        assert reader(raw("not json")).count() == 0


def test_routes(spark, rows):
    files = spark.createDataFrame(
        [("server.js", "const api = require('./routes/login');\napp.use(authMiddleware);\napp.use(express);\napp.use('/api/v1/', api);\n"),
         ("routes/login.js", "\nrouter.post('/login', loginController);\nrouter.route('/items').get(list).post(check, add);\n"),
         ("node_modules/x.js", "router.get('/no', h)")],
        "rel_path string, text string",
    )
    assert rows(resolve_routes(files), "http_method", "route_pattern", "line_number", "handler_symbol", "auth_state") == [
        ("GET", "/api/v1/items", 3, "list", "REQUIRED"), ("POST", "/api/v1/items", 3, "add", "REQUIRED"), ("POST", "/api/v1/login", 2, "loginController", "REQUIRED"),
    ]


def test_route_states_without_global_middleware(spark, rows):
    code = "app.get('/public/health', h);\napp.get('/custom', customGuard, h);\napp.get('/x', passportCheck, h);"
    files = spark.createDataFrame([("a.js", code)], "rel_path string, text string")
    assert rows(resolve_routes(files), "route_pattern", "auth_state") == [("/custom", "UNKNOWN"), ("/public/health", "NOT_REQUIRED"), ("/x", "REQUIRED")]


def test_frameworks(spark):
    def named(*files):
        return identify_framework(spark.createDataFrame(list(files), "rel_path string, text string")).first()[0]

    assert named(("package.json", '{"dependencies":{"koa":"1"},"devDependencies":{"fastify":"1"}}')) == "fastify"
    assert named(("package.json", "broken"), ("yarn.lock", "Express")) == "express"
    assert named(("requirements.txt", "Django==5")) == "django"
    assert named(("src/a.ts", 'import e from "express"')) == "express"
    assert named(("README.md", "express()")) is None


def test_vendor_harvest(spark, rows):
    files = spark.createDataFrame(
        [("node_modules/db-helper/index.js", "exports.rawQuery = f; exports.safeMethod = g;"), ("node_modules/@a/b/b.py", "def exec_command(x): pass"),
         ("node_modules/db-helper/lib/deep.js", "exports.execAll = 1")],
        "rel_path string, text string",
    )
    assert rows(harvest_vendor(files), "package_name", "api_name", "potential_sink_class") == [("@a/b", "exec_command", "RCE"), ("db-helper", "rawQuery", "SQLI")]


def test_fingerprints_of_rows_are_those_of_values(spark):
    configs = [{"mode": "FULL"}, {}, {"mode": "é\U0001f600\"\\/", "ünï": "x"}, {"schema_version": "7", "a": "1"}, {"resolver_version": "own", "z": "a\nb"}]
    cases = [(k, config, lock) for k, config in enumerate(configs) for lock in (None, "", "lock é")]
    df = spark.createDataFrame(cases, "k long, config map<string,string>, lock string")
    found = [r["f"] for r in df.withColumn("f", engine_fingerprints(F.col("config"), F.col("lock"))).orderBy("k", F.col("lock").asc_nulls_first()).collect()]
    assert found == [engine_fingerprint(config, None if lock is None else lock.encode()) for _, config, lock in cases]


def test_frameworks_of_many_repositories(spark, rows):
    files = [
        ("a", "package.json", '{"dependencies":{"koa":"1"}}'), ("a", "yarn.lock", "express"), ("b", "yarn.lock", "express"), ("b", "requirements.txt", "flask"),
        ("c", "Pipfile", "Flask"), ("d", "src/x.js", "express()"), ("e", "node_modules/x.js", "express()"),
    ]
    found = identify_framework(spark.createDataFrame(files, "repo string, rel_path string, text string"), ("repo",))
    assert rows(found) == [("a", "koa"), ("b", "express"), ("c", "flask"), ("d", "express"), ("e", None)]

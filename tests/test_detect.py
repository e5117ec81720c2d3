"""Snippets and the classes they must (and must not) give."""

import pytest

from casegraph.operators.detect import SINKS, SOURCES, TRANSFORMS, analyze_authorization, detect, veto_sinks
from casegraph.sources.files import lines_of, stripped_code_lines


def sinks_of(spark, path, code):
    files = spark.createDataFrame([(path, code)], "rel_path string, text string")
    found = veto_sinks(detect(stripped_code_lines(lines_of(files)), SINKS))
    return sorted(r["name"] for r in found.collect())


@pytest.mark.parametrize(
    ("path", "code", "expected"),
    [
        ("a.js", "needle.get(req.query.url)\nlibxmljs.parseXmlString(x)\nUser.find({ $where: q })", ["NOSQLI", "SSRF", "XXE"]),
        ("a.js", "const p = path.join(base, name);\nfs.readFile(p, cb)", ["PATH_TRAVERSAL"]),
        ("v.pug", "p!= user.html", ["XSS"]),
        ("a.js", "if (a !== b) {}\nif (a != b) {}", []),
        ("a.js", "fetch('http://fixed')\nrequest(app)\nfs.readFile('x.txt')", []),
        ("a.js", "fetch(`http://${host}/`)", ["SSRF"]),
        ("a.js", "// eval(x)\n# eval(x)\n* eval(x)\n/* eval(x) */", []),
        ("a.py", "requests.get(url)\nos.system(cmd)", ["RCE", "SSRF"]),
        ("a.py", "yaml.load(x)\npickle.loads(y)", ["DESERIALIZATION", "DESERIALIZATION"]),
    ],
)
def test_sinks(spark, path, code, expected):
    assert sinks_of(spark, path, code) == expected


def test_sources_and_transforms(spark, rows):
    files = spark.createDataFrame([("a.js", "const x = parseInt(req.body.id); path.join(a, req.params)")], "rel_path string, text string")
    lines = stripped_code_lines(lines_of(files))
    assert rows(detect(lines, SOURCES), "name", "expression") == [("HTTP_BODY", "req.body.id"), ("HTTP_PARAMS", "req.params")]
    assert rows(detect(lines, TRANSFORMS), "name") == [("PATH_CONSTRUCTION",), ("TYPE_CONSTRAINT",)]


def test_matches_keep_their_order(spark):
    files = spark.createDataFrame([("a.js", "eval(a); eval(b)")], "rel_path string, text string")
    found = detect(lines_of(files), SINKS).orderBy("ord").collect()
    assert [r["expression"] for r in found] == ["eval(a)", "eval(b)"]


@pytest.mark.parametrize(
    ("route", "code", "gap", "relation"),
    [
        ("/x", "Basket.findByPk(req.params.id)", True, "OWNER"),
        ("/x/:id", "Basket.findOne({ where: { userId: u } })", False, "OWNER"),
        ("/x/:id", "Basket.findOne({ tenantid: t })", False, "TENANT"),
        ("/x/:id", "if (req.user.role !== 1) { return }", False, "ROLE"),
        ("/x/:id", "b = load(); if (b.userId !== req.user.id) { deny() }", False, "OWNER"),
        ("/health", "res.send(1)", False, "NONE"),
        ("/x/:id", "router.get('/y')", False, "NONE"),
    ],
)
def test_authorization(spark, route, code, gap, relation):
    found = analyze_authorization(spark.createDataFrame([(route, code)], "route string, code string")).first()
    assert (found["has_gap"], found["relationship"]) == (gap, relation)


def test_line_numbers_of_every_match(spark, tmp_path):
    from casegraph.queries import load_all

    texts = {1: "th\n" * 57 + "x thth\n\nth", 2: "none", 3: None, 4: "th " * 30}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for doc_id, text in texts.items():
        places = [i for i in range(len(text or "")) if text.startswith("th", i)]
        expected += [(doc_id, k, text.count("\n", 0, at) + 1) for k, at in enumerate(places, 1)]
    found = load_all()[0]["match_line_numbers"](spark, str(tmp_path)).select("doc_id", "k", "line").collect()
    assert sorted(tuple(r) for r in found) == expected

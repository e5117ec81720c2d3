"""Pattern detection, authorization gaps, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.operators.detect import SINKS, SOURCES, TRANSFORMS, Pattern, analyze_authorization, detect, first_argument, veto_sinks
from casegraph.operators.indexer import calls_of, index_files, link_calls, symbols_of
from casegraph.operators.routes import auth_state, compose_path, harvest_vendor, matches_with_lines, mount_of, resolve_routes
from casegraph.queries import register, table
from casegraph.queries.scans import LINES_SQL
from casegraph.queries.standins import CODE_LINES_SQL, HANDLERS_SQL, code_lines, handlers
from casegraph.sources.files import lines_of, stripped_code_lines

#: A matrix for the shared tables' texts, where web code is rare.
TEXT_MATRIX = (
    Pattern("SECRET", "TOKEN", r'token = "[0-9a-f]+"', "CRITICAL", "CWE-798", marks=('token = "',)),
    Pattern("LICENSE", "GPL", r"GNU General Public License, version [0-9]", "INFO", marks=("GNU General",)),
    Pattern("LICENSE", "APACHE", r"Apache License", "INFO", marks=("Apache License",)),
    Pattern("PII", "ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "MEDIUM"),
)
PAGE_MATRIX = (Pattern("SINK", "CALL", r"track\([0-9]+\)", "LOW", marks=("track(",)),)


def _matrix_sql(patterns: tuple[Pattern, ...], source: str, columns: str, plain: bool = False) -> str:
    """The matrix as a union over patterns; look-arounds are word ends on ASCII code."""
    parts = []
    for p in patterns:
        regex = p.regex.replace(r"(?<![\p{L}\p{N}_])", r"\b").replace(r"(?![\p{L}\p{N}_])", r"\b").replace("'", "''")
        parts.append(f"SELECT {columns}, '{p.family}' AS family, '{p.name}' AS name, unnest(regexp_extract_all(text, '{regex}')) AS expression FROM {source}")
    return " UNION ALL ".join(parts)


@register("pattern_matrix_documents", f"""WITH {LINES_SQL}, l AS (SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line, unnest(ls) AS text FROM cut)
{_matrix_sql(TEXT_MATRIX, 'l', 'doc_id, line')}""")
def pattern_matrix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(lines_of(table(spark, sf_dir, "documents"), "doc_id"), TEXT_MATRIX).select("doc_id", "line", "family", "name", "expression")


@register("pattern_matrix_pages", _matrix_sql(PAGE_MATRIX, "(SELECT page_id, html AS text FROM pages)", "page_id"))
def pattern_matrix_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return detect(pages, PAGE_MATRIX).select("page_id", "family", "name", "expression")


_BARE = f"(SELECT * FROM ({CODE_LINES_SQL}) WHERE NOT starts_with(text, '//'))"


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripped_code_lines(code_lines(spark, sf_dir))


@register("pattern_sources", _matrix_sql(SOURCES, _BARE, "line, rel_path"))
def pattern_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_code(spark, sf_dir), SOURCES).select("line", "rel_path", "family", "name", "expression")


@register("pattern_transforms", _matrix_sql(TRANSFORMS, _BARE, "line, rel_path"))
def pattern_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_code(spark, sf_dir), TRANSFORMS).select("line", "rel_path", "family", "name", "expression")


_SINKS_SQL = _matrix_sql(SINKS, _BARE, "line, rel_path")


@register("pattern_sinks", _SINKS_SQL)
def pattern_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_code(spark, sf_dir), SINKS).select("line", "rel_path", "family", "name", "expression")


_ARG = r"trim(regexp_extract(expression, '\(\s*([^,)]+)', 1))"
_LITERAL = f"(regexp_matches({_ARG}, '^[''\"]') AND regexp_matches({_ARG}, '[''\"]$') OR starts_with({_ARG}, '`') AND NOT contains({_ARG}, '${{'))"


@register("sink_veto", f"""SELECT line, name, expression FROM ({_SINKS_SQL}) WHERE NOT (
(starts_with(expression, '!=') AND NOT ends_with(rel_path, '.pug')) OR (name = 'SSRF' AND (contains(expression, 'request(app)') OR {_LITERAL}))
OR (name = 'PATH_TRAVERSAL' AND {_LITERAL} AND NOT regexp_matches(expression, '\\$\\{{|\\+|path\\.join')))""")
def sink_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veto_sinks(detect(_code(spark, sf_dir), SINKS)).select("line", "name", "expression")


@register("sink_arguments", f"SELECT line, name, {_ARG} AS argument FROM ({_SINKS_SQL}) WHERE name = 'SSRF'")
def sink_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(_code(spark, sf_dir), SINKS).filter("name = 'SSRF'")
    return found.select("line", "name", first_argument(F.col("expression")).alias("argument"))


@register("authz_cascade", f"""WITH h AS (SELECT o_orderkey, code, nullif(regexp_extract(code, '(?i)\\breq\\.(?:params|query|body)\\.(?:[a-zA-Z0-9_$]*id|id)\\b'), '') AS k, contains(route, ':id') AS r FROM ({HANDLERS_SQL})),
m AS (SELECT *, coalesce(k, CASE WHEN r THEN 'req.params.id' END) AS key,
 [x FOR x IN regexp_extract_all(code, '(?i)\\b([A-Z][a-zA-Z0-9_]*)\\.(?:findByPk|findById|findOne|find|get)\\s*\\(', 1) IF lower(x) NOT IN ('app','router','express','req','request','res','response')][1] AS model,
 regexp_matches(code, '(?i)if\\s*\\([^)]*(?:req\\.user\\.(?:role|roles)|is_admin|isAdmin|hasRole|hasPermission)[^)]*\\)') AS guarded,
 regexp_matches(code, '(?is)\\b([A-Z][a-zA-Z0-9_]*)\\.(?:findOne|find|findAll|filter)\\s*\\(.*?\\b(?:userId|ownerid|tenantid)\\b') AS scoped,
 regexp_matches(code, '(?i)if\\s*\\([^)]*(?:userId|ownerid|tenantid)[^)]*!==?[^)]*req\\.user\\.id[^)]*\\)') AS owned FROM h),
c AS (SELECT *, CASE WHEN key IS NULL THEN 'NONE' WHEN guarded THEN 'ROLE' WHEN scoped THEN CASE WHEN regexp_matches(code, '(?i)\\btenant_?id\\b') THEN 'TENANT' ELSE 'OWNER' END
 WHEN owned THEN 'OWNER' WHEN model IS NOT NULL THEN 'GAP' ELSE 'NONE' END AS kind FROM m)
SELECT o_orderkey, kind = 'GAP' AS has_gap, CASE WHEN kind = 'GAP' THEN 'MISSING_AUTHZ_PREDICATE' WHEN kind = 'NONE' THEN 'NO_OBJECT_KEY' ELSE 'AUTHZ_CONSTRAINT_PRESENT' END AS status,
CASE WHEN kind <> 'NONE' THEN key END AS object_key, CASE WHEN kind = 'GAP' THEN 'OWNER' ELSE kind END AS relationship FROM c""")
def authz_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze_authorization(handlers(spark, sf_dir)).select("o_orderkey", "has_gap", "status", "object_key", "relationship")


@register("href_routes", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS route FROM pages")
def href_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(matches_with_lines(F.col("html"), r'href="([^"]*)"', 1))
    return table(spark, sf_dir, "pages").select("page_id", found.alias("m")).select("page_id", F.col("m.g1").alias("route"))


@register("match_line_numbers", """WITH p AS (SELECT doc_id, string_split(text, 'th') AS g FROM documents), q AS (SELECT doc_id, unnest(range(1, len(g) + 1)) AS k, unnest(g) AS part, len(g) AS n FROM p)
SELECT doc_id, k, CAST(line AS INTEGER) AS line FROM (SELECT doc_id, k, n, sum(length(part) - length(replace(part, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY k) + 1 AS line FROM q) WHERE k < n""")
def match_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(matches_with_lines(F.col("text"), "(th)", 1))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("m"))
    return rows.select("doc_id", (F.col("m.ord") + 1).cast("long").alias("k"), F.col("m.line").alias("line"))


@register("mount_prefix_join", """WITH m AS (SELECT n_nationkey AS ord, 'r' || CAST(n_nationkey AS VARCHAR) AS key, '/p' || CAST(n_nationkey AS VARCHAR) AS prefix FROM nation),
j AS (SELECT doc_id, prefix, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM documents d JOIN m ON contains('src/r' || CAST(doc_id % 30 AS VARCHAR) || '/x.js', m.key))
SELECT d.doc_id, coalesce(j.prefix, '') || '/login' AS route FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id AND j.k = 1""")
def mount_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/r"), (F.col("doc_id") % 30).cast("string"), F.lit("/x.js")).alias("path"))
    number = F.col("n_nationkey").cast("string")
    mounts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("r"), number).alias("import_key"), F.concat(F.lit("/p"), number).alias("prefix"))
    hits = mount_of(docs.select(F.col("path").alias("rel_path")).distinct(), mounts).withColumnRenamed("rel_path", "path")
    return docs.join(hits, "path", "left").select("doc_id", compose_path(F.coalesce("prefix", F.lit("")), F.lit("login")).alias("route"))


@register("mount_by_stem", """SELECT s_suppkey, '/m' || CAST(min(n_nationkey) AS VARCHAR) AS prefix FROM supplier JOIN nation
ON contains('lib/s' || CAST(s_suppkey % 30 AS VARCHAR) || 'x/index', 's' || CAST(n_nationkey AS VARCHAR) || 'x') AND n_nationkey = s_suppkey % 30 GROUP BY s_suppkey""")
def mount_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other way round: the stem of a file's name is part of the mount's key."""
    number = F.col("n_nationkey").cast("string")
    mounts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("lib/s"), number, F.lit("x/index")).alias("import_key"), F.concat(F.lit("/m"), number).alias("prefix"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("q/s"), (F.col("s_suppkey") % 30).cast("string"), F.lit("x.js")).alias("rel_path"))
    return rows.join(mount_of(rows.select("rel_path").distinct(), mounts), "rel_path").select("s_suppkey", "prefix")


@register("auth_states", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'NOT_REQUIRED' WHEN 1 THEN 'REQUIRED' ELSE 'UNKNOWN' END AS auth_state FROM orders""")
def auth_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 3
    names = F.when(key == 0, F.array().cast("array<string>")).when(key == 1, F.array(F.lit("log"), F.lit("checkJWT"))).otherwise(F.array(F.lit("log")))
    return table(spark, sf_dir, "orders").select("o_orderkey", auth_state(names).alias("auth_state"))


def _repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per customer, and an entry file that mounts one router."""
    key = F.col("c_custkey")
    code = F.concat(
        F.lit("// file\nrouter.get('/a"), key, F.lit("', authGuard, h"), key, F.lit(");\nrouter.route('/b').get(x).post(log, y);\n")
    )
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("routes/c"), key, F.lit(".js")).alias("rel_path"), code.alias("text"))
    entry = "const r = require('./routes/c7.js');\napp.use('/api/', r);\n"
    first = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit("server.js").alias("rel_path"), F.lit(entry).alias("text"))
    return rows.unionByName(first)


@register("resolve_routes", """WITH c AS (SELECT c_custkey, 'routes/c' || CAST(c_custkey AS VARCHAR) || '.js' AS rel_path,
CASE WHEN c_custkey = 7 THEN '/api' ELSE '' END AS p FROM customer)
SELECT rel_path, 'GET' AS http_method, p || '/a' || CAST(c_custkey AS VARCHAR) AS route_pattern, 2 AS line_number, 'h' || CAST(c_custkey AS VARCHAR) AS handler_symbol, 'REQUIRED' AS auth_state FROM c
UNION ALL SELECT rel_path, 'GET', p || '/b', 3, 'x', 'NOT_REQUIRED' FROM c UNION ALL SELECT rel_path, 'POST', p || '/b', 3, 'y', 'UNKNOWN' FROM c""")
def resolve_routes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_routes(_repository(spark, sf_dir))
    return found.select("rel_path", "http_method", "route_pattern", "line_number", "handler_symbol", "auth_state")


@register("vendor_harvest", """SELECT '@s/p' || CAST(p_partkey AS VARCHAR) AS package_name, 'rawQuery' AS api_name, 'SQLI' AS potential_sink_class FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 'exec_command', 'RCE' FROM part WHERE p_partkey % 2 = 1""")
def vendor_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    script = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(
        F.concat(F.lit("node_modules/@s/p"), key, F.lit("/index.js")).alias("rel_path"), F.lit("exports.rawQuery = f;\nexports.safe = g;").alias("text")
    )
    python = table(spark, sf_dir, "part").filter("p_partkey % 2 = 1").select(
        F.concat(F.lit("node_modules/p"), key, F.lit("/p"), key, F.lit(".py")).alias("rel_path"), F.lit("def exec_command(x):\n    pass\n").alias("text")
    )
    return harvest_vendor(script.unionByName(python)).select("package_name", "api_name", "potential_sink_class")


def _python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    code = F.concat(
        F.lit("import os\nclass A:\n    def m"), key, F.lit("(self):\n        return helper("), key, F.lit(")\n\ndef helper(x):\n    os.system(x)\n\ndef top():\n    helper(1)\n")
    )
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key, F.lit(".py")).alias("rel_path"), F.lit("python").alias("language"), code.alias("text"))


@register("python_index", """SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.py' AS rel_path, unnest(['A', 'm' || CAST(s_suppkey AS VARCHAR), 'helper', 'top']) AS name,
unnest(['CLASS', 'METHOD', 'FUNCTION', 'FUNCTION']) AS kind, unnest([2, 3, 6, 9]) AS start_line, unnest(['global', 'global.A', 'global', 'global']) AS scope FROM supplier""")
def python_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols_of(index_files(_python_files(spark, sf_dir))).select("rel_path", "name", "kind", "start_line", "scope")


@register("python_calls_linked", """SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.py' AS file_id, unnest(['m' || CAST(s_suppkey AS VARCHAR), 'top']) AS caller, 'helper' AS callee FROM supplier""")
def python_calls_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_files(_python_files(spark, sf_dir))
    symbols = symbols_of(index).select(F.col("rel_path").alias("file_id"), "name", F.concat_ws("|", "rel_path", "name").alias("symbol_id"), "seq")
    calls = calls_of(index).select(F.col("rel_path").alias("file_id"), "caller_scope", "callee_name")
    linked = link_calls(calls, symbols)
    caller, callee = F.split("caller_symbol_id", r"\|"), F.split("callee_symbol_id", r"\|")
    return linked.select(caller[0].alias("file_id"), caller[1].alias("caller"), callee[1].alias("callee"))


#: A small source per language, with what an index of it holds; the name stands for the supplier's number.
_SOURCES = {
    "javascript": (
        "import {x as y} from 'm';\nfunction f#(a) {\n  run(a); // skip(a)\n}\nclass C {\n  go(a) { f#(a); }\n}\n",
        [("f#", "FUNCTION", 2, 4, "global"), ("C", "CLASS", 5, 7, "global"), ("go", "METHOD", 6, 6, "global.C")], [("run", "global.f#"), ("f#", "global.C.go")],
    ),
    "go": ("package p\nfunc f#(a int) {\n  fmt.Println(a) // no(a)\n  if (a > 1) { g(a) }\n}\n", [("f#", "FUNCTION", 2, 5, "global")], [("fmt.Println", "global.f#"), ("g", "global.f#")]),
    "java": ("package p;\nclass A# extends B {\n  void run() { go(); }\n}\n", [("A#", "CLASS", 2, 4, "global")], []),
    "php": ("<?php\nfunction f#($a) {\n  return g($a);\n}\nclass A {\n  function m() { }\n}\n", [("f#", "FUNCTION", 2, 4, "global"), ("A", "CLASS", 5, 7, "global")], []),
    "ruby": ("def m#\n  obj.call(1) # no(1)\n  puts(2)\nend\n", [], [("obj.call", "global"), ("puts", "global")]),
}


def _index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per supplier and language."""
    out = None
    for language, (source, *_) in _SOURCES.items():
        text = F.replace(F.lit(source), F.lit("#"), F.col("s_suppkey").cast("string")) if language != "ruby" else F.replace(F.lit(source), F.lit("m#"), F.concat(F.lit("m"), F.col("s_suppkey").cast("string")))
        rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit(f"{language}/"), F.col("s_suppkey").cast("string")).alias("rel_path"), F.lit(language).alias("language"), text.alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return index_files(out)


def _index_sql(columns: tuple[str, ...], part: int) -> str:
    def shown(value: object) -> str:
        return str(value) if isinstance(value, int) else "replace('" + str(value) + "', '#', CAST(s_suppkey AS VARCHAR))"

    rows = [f"SELECT '{language}/' || CAST(s_suppkey AS VARCHAR) AS rel_path, " + ", ".join(f"{shown(v)} AS {c}" for v, c in zip(row, columns, strict=True)) + " FROM supplier" for language, given in _SOURCES.items() for row in given[part]]
    return " UNION ALL ".join(rows)


@register("script_index", _index_sql(("name", "kind", "start_line", "end_line", "scope"), 1))
def script_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols_of(_index_of(spark, sf_dir)).select("rel_path", "name", "kind", "start_line", "end_line", "scope")


@register("script_calls", _index_sql(("callee_name", "caller_scope"), 2))
def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(_index_of(spark, sf_dir)).select("rel_path", "callee_name", "caller_scope")


@register("signature_limits", "SELECT s_suppkey, substring('def f(' || repeat('a', 150) || CAST(s_suppkey AS VARCHAR) || ', ' || repeat('b', 150) || '):', 1, 200) AS signature FROM supplier")
def signature_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    code = F.concat(F.lit("def f(" + "a" * 150), key, F.lit(", " + "b" * 150 + "):\n    pass\n"))
    files = table(spark, sf_dir, "supplier").select(key.alias("rel_path"), F.lit("python").alias("language"), code.alias("text"))
    return symbols_of(index_files(files)).select(F.col("rel_path").cast("long").alias("s_suppkey"), "signature")

"""Sources and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.functions.text import basename, extension, first_json, last_segment, line_count, python_round, scrub, stem, strip, title_case
from casegraph.operators.classify import API_CLASSES, ROLE_RULES, RULE_CLASSES, SCOPE_RULES, api_class, authz_relevant, classify_scope, eligible, rule_class, tool_severity
from casegraph.operators.incremental import all_changed, change_feed, impact_plan, snapshot_diff
from casegraph.operators.matching import files_in_order, gated_items, indexable
from casegraph.operators.routes import identify_framework
from casegraph.queries import register, table
from casegraph.operators.store import Store
from casegraph.queries.standins import FILES_SQL, files
from casegraph.scratch import materialize, new_path
from casegraph.sources.files import describe_files, grep, hydrate_snippet, is_vendor, language_of, line_range, lines_of
from casegraph.sources.tools import read_endpoints, read_findings, read_secrets, read_tools

LINES_SQL = """lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents),
cut AS (SELECT doc_id, text, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS ls FROM lines)"""


@register("file_scan_profile", f"""WITH {LINES_SQL}
SELECT doc_id, sha256(text) AS file_hash, CAST(len(ls) AS BIGINT) AS loc, CAST(length(text) AS BIGINT) AS chars
FROM cut WHERE octet_length(encode(text)) <= 2097152 AND (len(ls) = 0 OR length(text) / CAST(len(ls) AS DOUBLE) <= 1000)""")
def file_scan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), F.col("text").cast("binary").alias("content"))
    found = describe_files(contents)
    return found.select(F.col("rel_path").cast("long").alias("doc_id"), "file_hash", "loc", F.length("text").cast("long").alias("chars"))


LANGUAGE_SQL = """CASE WHEN rel_path LIKE '%.py' THEN 'python' WHEN rel_path LIKE '%.ts' THEN 'typescript' WHEN rel_path LIKE '%.js' OR rel_path LIKE '%.jsx' THEN 'javascript'
WHEN rel_path LIKE '%.java' THEN 'java' WHEN rel_path LIKE '%.rb' THEN 'ruby' WHEN rel_path LIKE '%.php' THEN 'php' WHEN rel_path LIKE '%.go' THEN 'go' END"""


@register("language_lookup", f"SELECT doc_id, {LANGUAGE_SQL} AS language FROM ({FILES_SQL})")
def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", language_of(F.col("rel_path")).alias("language"))


@register("vendor_flag", f"SELECT doc_id, list_has_any(string_split(rel_path, '/'), ['node_modules','vendor','site-packages','.venv','venv']) AS is_vendor FROM ({FILES_SQL})")
def vendor_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", is_vendor(F.col("rel_path")).alias("is_vendor"))


@register("line_explode", f"WITH {LINES_SQL} SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line, unnest(ls) AS text FROM cut")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents"), "doc_id")


@register("json_props_parse", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("tool_endpoints", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS http_method, '/u/' || CAST(user_id AS VARCHAR) AS route_pattern,
CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 50 AS INTEGER) ELSE 1 END AS line_number FROM events""")
def tool_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", F.concat(
        F.lit('{"endpoints":[{"url":"/u/'), F.col("user_id"), F.lit('"'), F.when(F.col("event_id") % 2 == 0, ',"method":"post"').otherwise(""),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"details":{"file":"a.py","line":'), F.col("event_id") % 50, F.lit("}"))).otherwise(""), F.lit("}]}"),
    ).alias("raw"))
    # The reader drops other columns: the id travels in the file name of a second document.
    keyed = raw.withColumn("raw", F.replace("raw", F.lit('"url":"'), F.concat(F.lit('"url":"'), F.col("event_id"), F.lit("|"))))
    found = read_endpoints(keyed)
    parts = F.split("route_pattern", r"\|")
    return found.select(parts[0].cast("long").alias("event_id"), "http_method", parts[1].alias("route_pattern"), "line_number")


@register("tool_findings", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'RCE' WHEN o_orderkey % 3 = 1 THEN 'SQLI' ELSE 'GENERAL_VULN' END AS vuln_class,
CASE WHEN o_orderkey % 4 = 0 THEN 'HIGH' WHEN o_orderkey % 4 = 1 THEN 'MEDIUM' ELSE 'CRITICAL' END AS triage_severity, CAST(o_orderkey % 97 + 1 AS INTEGER) AS line_number,
CASE WHEN o_orderkey % 2 = 0 THEN 'CWE-1' ELSE 'CWE-2' END AS cwe_id FROM orders""")
def tool_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rule = F.when(key % 3 == 0, "js.command-injection").when(key % 3 == 1, "py.sqli").otherwise("misc.rule")
    severity = F.when(key % 4 == 0, ',"severity":"WARNING"').when(key % 4 == 1, ',"severity":"INFO"').otherwise("")
    cwe = F.when(key % 2 == 0, '["CWE-1","CWE-9"]').otherwise('"CWE-2"')
    raw = table(spark, sf_dir, "orders").select(F.concat(
        F.lit('{"results":[{"check_id":"'), rule, F.lit('","path":"'), key, F.lit('","start":{"line":'), key % 97 + 1, F.lit(',"col":1},"extra":{"message":"m","lines":"x","metadata":{"cwe":'),
        cwe, F.lit("}"), severity, F.lit("}}]}"),
    ).alias("raw"))
    return read_findings(raw).select(F.col("rel_path").cast("long").alias("o_orderkey"), "vuln_class", "triage_severity", "line_number", "cwe_id")


@register("tool_secrets", """SELECT CAST(doc_id AS VARCHAR) AS rel_path, 'AWS' AS detector_name, doc_id % 2 = 0 AS verified, sha256('k' || CAST(doc_id AS VARCHAR)) AS secret_hash FROM documents""")
def tool_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select(F.concat(
        F.lit('{"SourceMetadata":{"Data":{"Filesystem":{"file":"'), F.col("doc_id"), F.lit('"}}},"DetectorName":"AWS","Raw":"k'), F.col("doc_id"),
        F.lit('","Verified":'), (F.col("doc_id") % 2 == 0).cast("string"), F.lit("}\nnot json\n\n"),
    ).alias("raw"))
    return read_secrets(raw).select("rel_path", "detector_name", "verified", "secret_hash")


@register("snippet_hydrate", f"""WITH {LINES_SQL}
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'given' WHEN len(ls) >= 2 THEN trim(ls[2]) ELSE 'requires login' END AS snippet FROM cut""")
def snippet_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    snippet = F.when(F.col("doc_id") % 3 == 0, "given").otherwise("requires login")
    return table(spark, sf_dir, "documents").select("doc_id", hydrate_snippet(snippet, F.col("text"), F.lit(2)).alias("snippet"))


@register("line_range", f"WITH {LINES_SQL} SELECT doc_id, coalesce(array_to_string(ls[2:4], chr(10)), '') AS part FROM cut")
def line_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", line_range(F.col("text"), F.lit(2), F.lit(4)).alias("part"))


@register("grep_top50", f"""WITH {LINES_SQL}, l AS (SELECT doc_id AS file, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line, unnest(ls) AS text FROM cut)
SELECT file, line, trim(text) AS text FROM l WHERE regexp_matches(text, 'token = "[0-9a-f]+"|License') ORDER BY file, line LIMIT 50""")
def grep_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep(lines_of(table(spark, sf_dir, "documents"), "doc_id"), r'token = "[0-9a-f]+"|License', "doc_id")


SNAPSHOT_SQL = """prev AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0),
curr AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 1)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string").alias("rel_path")
    old = docs.filter("doc_id % 10 <> 0").select(path, F.sha2("text", 256).alias("file_hash"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return old, docs.filter("doc_id % 10 <> 1").select(path, F.sha2(changed, 256).alias("file_hash"))


@register("snapshot_diff", f"""WITH {SNAPSHOT_SQL}
SELECT CAST(coalesce(prev.doc_id, curr.doc_id) AS VARCHAR) AS rel_path, CASE WHEN prev.doc_id IS NULL THEN 'ADDED' WHEN curr.doc_id IS NULL THEN 'DELETED'
WHEN prev.h = curr.h THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status FROM prev FULL JOIN curr USING (doc_id)""")
def snapshot_diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(*_snapshots(spark, sf_dir))


@register("change_feed", "SELECT DISTINCT replace(x, chr(92), '/') AS rel_path FROM (SELECT 'a' || chr(92) || CAST(doc_id % 50 AS VARCHAR) AS x FROM documents UNION ALL SELECT 'a/' || CAST(doc_id % 80 AS VARCHAR) FROM documents)")
def change_feed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tracked = docs.select(F.concat(F.lit("a\\"), (F.col("doc_id") % 50).cast("string")).alias("rel_path"))
    return change_feed(tracked, docs.select(F.concat(F.lit("a/"), (F.col("doc_id") % 80).cast("string")).alias("rel_path")))


@register("impact_plan", """WITH c AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS p FROM documents WHERE doc_id % 4 = 0), t AS (SELECT CAST(doc_id AS VARCHAR) AS p FROM documents WHERE doc_id % 8 <> 0),
i AS (SELECT CAST(doc_id AS VARCHAR) AS p, doc_id FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(i.p, c.p) AS rel_path, CASE WHEN c.p IS NULL THEN 'UNAFFECTED' WHEN t.p IS NOT NULL THEN 'CHANGED' ELSE 'DELETED' END AS status, coalesce(i.doc_id, -1) AS file_id
FROM i FULL JOIN c ON i.p = c.p LEFT JOIN t ON coalesce(i.p, c.p) = t.p""")
def impact_plan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), F.col("doc_id").alias("file_id"))
    plan = impact_plan(docs.filter("file_id % 4 = 0"), docs.filter("file_id % 8 <> 0"), docs.filter("file_id % 3 <> 0"))
    return plan.withColumn("file_id", F.coalesce("file_id", F.lit(-1)))


def _ladder(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"


def _contains(column: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in marks) + ")"


_RULES = [(_contains("rel_path", marks) + ("".join(f" OR rel_path LIKE '%{e}'" for e in ext)), rule) for rule in SCOPE_RULES for *_, marks, ext in [rule]]
_DOMAIN_SQL = _ladder([(c, f"'{r[0]}'") for c, r in _RULES], "'APPLICATION_RUNTIME'")
_ROLE_SQL = _ladder([(c, f"'{r[1]}'") for c, r in _RULES] + [(_contains("rel_path", m), f"'{name}'") for name, m in ROLE_RULES], "'UNKNOWN'")
_CONF_SQL = _ladder([(c, str(r[3])) for c, r in _RULES] + [(_contains("rel_path", m), "0.92") for _, m in ROLE_RULES], "0.75")
SCOPE_SQL = f"SELECT doc_id, {_DOMAIN_SQL} AS execution_domain, {_ROLE_SQL} AS runtime_role, CAST({_CONF_SQL} AS DOUBLE) AS confidence FROM (SELECT doc_id, lower(rel_path) AS rel_path FROM ({FILES_SQL}))"


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("doc_id", "rel_path", language_of(F.col("rel_path")).alias("language"), is_vendor(F.col("rel_path")).alias("is_vendor"))
    return classify_scope(rows)


@register("scope_classify", SCOPE_SQL)
def scope_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).select("doc_id", "execution_domain", "runtime_role", F.col("classification_confidence").alias("confidence"))


@register("scope_gate", f"""SELECT s.doc_id, d.detector, CASE WHEN execution_domain IN ('TEST_MOCK','VENDOR_DEPENDENCY','BUILD_OUTPUT_GENERATED','DATA_SEED_TUTORIAL') THEN false
WHEN execution_domain = 'CI_CD_PIPELINE' THEN d.detector IN ('SUPPLY_CHAIN_CI','SECRETS') WHEN execution_domain = 'INFRASTRUCTURE_IAC' THEN d.detector IN ('INFRASTRUCTURE_CONFIG','SECRETS') ELSE true END AS eligible
FROM ({SCOPE_SQL}) s, (SELECT unnest(['SSRF','SECRETS','SUPPLY_CHAIN_CI','INFRASTRUCTURE_CONFIG']) AS detector) d""")
def scope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    detectors = F.explode(F.array(*[F.lit(d) for d in ("SSRF", "SECRETS", "SUPPLY_CHAIN_CI", "INFRASTRUCTURE_CONFIG")])).alias("detector")
    rows = _scoped(spark, sf_dir).select("doc_id", "execution_domain", detectors)
    return rows.select("doc_id", "detector", eligible(F.col("execution_domain"), F.col("detector")).alias("eligible"))


@register("rule_class", f"SELECT p_partkey, {_ladder([(_contains('h', m), repr(n)) for n, m in RULE_CLASSES], repr('GENERAL_VULN'))} AS vuln_class FROM (SELECT p_partkey, lower(p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'Command' WHEN 1 THEN 'sql-injection' WHEN 2 THEN 'Path' ELSE p_type END) AS h FROM part)")
def rule_class_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 4
    word = F.when(key == 0, "Command").when(key == 1, "sql-injection").when(key == 2, "Path").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", rule_class(F.col("p_name"), word).alias("vuln_class"))


@register("severity_map", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM orders")
def severity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    raw = F.when(key == 0, "error").when(key == 1, "WARNING").when(key == 2, "").otherwise("note")
    return table(spark, sf_dir, "orders").select("o_orderkey", tool_severity(raw).alias("severity"))


@register("vendor_sink_class", f"SELECT p_partkey, {_ladder([(_contains('a', m), repr(n)) for n, m in API_CLASSES], 'NULL')} AS sink_class FROM (SELECT p_partkey, lower(CASE p_partkey % 5 WHEN 0 THEN 'rawQuery' WHEN 1 THEN 'spawnSync' WHEN 2 THEN 'doFetch' WHEN 3 THEN 'compileIt' ELSE p_brand END) AS a FROM part)")
def vendor_sink_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 5
    api = F.when(key == 0, "rawQuery").when(key == 1, "spawnSync").when(key == 2, "doFetch").when(key == 3, "compileIt").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", api_class(api).alias("sink_class"))


@register("framework_first_hit", "SELECT 'fastify' AS framework")
def framework_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey") % 5
    rows = table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(
        F.when(key == 0, "package.json").when(key == 1, "yarn.lock").when(key == 2, "requirements.txt").when(key == 3, "a.js").otherwise("README.md").alias("rel_path"),
        F.when(key == 0, '{"dependencies":{"left-pad":"1"}}').when(key == 1, "fastify@4").when(key == 2, "Flask").when(key == 3, "express()").otherwise("").alias("text"),
    )
    return identify_framework(rows)


# Manifests, lockfiles and sources by customer, so that each step of the ladder decides for some repositories.
_LADDER = (
    ("package.json", "c_custkey % 7 = 0", "'{\"dependencies\":{\"express\":\"4\"}}'", "express"), ("package.json", "c_custkey % 7 = 1", "'{\"devDependencies\":{\"koa\":\"2\"}}'", "koa"),
    ("package.json", "c_custkey % 7 > 1", "'{\"dependencies\":{\"left-pad\":\"1\"}}'", None), ("yarn.lock", "c_nationkey % 3 = 0", "'Fastify@4'", "fastify"),
    ("requirements.txt", "c_mktsegment = 'BUILDING'", "'Django==5'", "django"), ("pyproject.toml", "c_mktsegment IN ('BUILDING', 'MACHINERY')", "'deps = [fastapi]'", "fastapi"),
    ("src/a.ts", "c_acctbal > 5000", "'express()'", "express"), ("node_modules/x.js", "c_custkey > 0", "'express()'", None),
)


@register("framework_by_repository", "SELECT c_custkey, CASE " + " ".join(f"WHEN {when} THEN '{name}'" for _, when, _, name in _LADDER if name) + " END AS framework FROM customer")
def framework_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository per customer, all identified in one pass."""
    customers = table(spark, sf_dir, "customer")
    held = F.array(*[F.when(F.expr(when), F.struct(F.lit(path).alias("rel_path"), F.expr(text).alias("text"))) for path, when, text, _ in _LADDER])
    files = customers.select("c_custkey", F.explode(held).alias("f")).filter("f is not null").select("c_custkey", "f.*")
    return identify_framework(files, ("c_custkey",))


@register("text_functions", """WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS w, CASE o_orderkey % 4 WHEN 0 THEN '.tar.GZ' WHEN 1 THEN '.py' WHEN 2 THEN '' ELSE '.env' END AS s FROM orders)
SELECT o_orderkey, k || 'c' AS last_part, CASE WHEN s = '.env' THEN s ELSE 'name' || k || s END AS base,
CASE WHEN s = '.env' THEN s WHEN s = '.tar.GZ' THEN 'name' || k || '.tar' ELSE 'name' || k END AS stem, CASE s WHEN '.tar.GZ' THEN '.gz' WHEN '.py' THEN s ELSE '' END AS ext,
'Bypass ' || upper(substring(s, 2, 1)) || lower(substring(s, 3)) || ' K' || k AS title, w || ':ok' || k AS scrubbed,
CASE WHEN o_orderkey % 2 = 0 THEN '{"a": {"b": ' || k || '}' END AS json, CAST(3 + o_orderkey % 5 AS BIGINT) AS n_lines, 'x' || k AS stripped FROM o""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, k = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    suffix = F.when(key % 4 == 0, ".tar.GZ").when(key % 4 == 1, ".py").when(key % 4 == 2, "").otherwise(".env")
    path = F.concat(F.lit("a/b"), k, F.lit("/"), F.when(suffix == ".env", "").otherwise(F.concat(F.lit("name"), k)), suffix)
    title = F.concat(F.lit("bypass_"), F.substring(suffix, 2, 9), F.lit("_k"), k)
    thought = F.concat(F.lit("<thought> Defender:"), F.col("o_orderpriority"), F.lit("scratchpad::ok"), k, F.lit(" </thought>\n"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", last_segment(F.concat(F.lit("a.b."), k, F.lit("c"))).alias("last_part"), basename(path).alias("base"), stem(path).alias("stem"), extension(path).alias("ext"),
        title_case(title).alias("title"), scrub(thought).alias("scrubbed"),
        first_json(F.when(key % 2 == 0, F.concat(F.lit('say {"a": {"b": '), k, F.lit("}} now"))).otherwise(F.concat(F.lit("none"), k))).alias("json"),
        line_count(F.concat(F.lit("a\r\nb\x0bc"), F.repeat(F.lit("\nd"), (key % 5).cast("int")), F.lit("\n"))).alias("n_lines"),
        strip(F.concat(F.lit("\t x"), k, F.lit(" \n"))).alias("stripped"),
    )


@register("python_rounding", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice, 2) AS DOUBLE) AS price FROM lineitem")
def python_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", python_round(F.col("l_extendedprice")).alias("price"))


@register("indexable_files", f"SELECT doc_id FROM ({FILES_SQL}) WHERE NOT list_has_any(string_split(rel_path, '/'), ['node_modules','vendor','site-packages','.venv','venv'])")
def indexable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexable(files(spark, sf_dir).withColumn("is_vendor", is_vendor(F.col("rel_path")))).select("doc_id")


@register("authz_paths", f"SELECT doc_id FROM ({FILES_SQL}) WHERE regexp_matches(lower(rel_path), 'route|controller|server|app')")
def authz_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(authz_relevant(F.col("rel_path"))).select("doc_id")


@register("files_by_id", f"SELECT doc_id AS file_id, rel_path, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS place FROM ({FILES_SQL})")
def files_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files_in_order(files(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "rel_path"))
    # Sorted parts follow each other: a row's place is its place in its part after all parts before.
    numbered = materialize(rows.select("file_id", "rel_path", F.monotonically_increasing_id().alias("n")), "files-by-id")
    part, inside = F.shiftright("n", 33), F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    # One row a part, so one running sum.
    before = sizes.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return numbered.withColumn("p", part).join(before, "p").select("file_id", "rel_path", (F.col("first") + inside + 1).cast("long").alias("place"))


@register("tool_gate", f"""WITH s AS ({SCOPE_SQL}), f AS (SELECT doc_id, rel_path FROM ({FILES_SQL})), k AS (SELECT DISTINCT rel_path, execution_domain FROM f JOIN s USING (doc_id) WHERE NOT starts_with(rel_path, 'p0/')),
i AS (SELECT doc_id, rel_path, CASE WHEN doc_id % 2 = 0 THEN 'SECRETS' ELSE 'SSRF' END AS vuln_class FROM f)
SELECT doc_id, vuln_class FROM i LEFT JOIN k USING (rel_path) WHERE execution_domain IS NULL OR NOT (execution_domain IN ('TEST_MOCK','VENDOR_DEPENDENCY','BUILD_OUTPUT_GENERATED','DATA_SEED_TUTORIAL')
OR execution_domain = 'CI_CD_PIPELINE' AND vuln_class = 'SSRF' OR execution_domain = 'INFRASTRUCTURE_IAC' AND vuln_class = 'SSRF')""")
def tool_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = _scoped(spark, sf_dir)
    items = scoped.select("doc_id", "rel_path", F.when(F.col("doc_id") % 2 == 0, "SECRETS").otherwise("SSRF").alias("vuln_class"))
    discovered = scoped.filter("not startswith(rel_path, 'p0/')").select("rel_path", "execution_domain").distinct()
    return gated_items(items, discovered, F.col("vuln_class")).select("doc_id", "vuln_class")


@register("tool_outputs", """SELECT event_id, 'endpoints' AS kind FROM events UNION ALL SELECT doc_id, 'secrets' FROM documents""")
def tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tools asked for, one without output and one unknown among them."""
    endpoints = table(spark, sf_dir, "events").select(F.concat(F.lit('{"endpoints":[{"url":"'), F.col("event_id"), F.lit('"}]}')).alias("raw"))
    secrets = table(spark, sf_dir, "documents").select(F.concat(F.lit('{"file":"'), F.col("doc_id"), F.lit('","Raw":"k"}')).alias("raw"))
    found = read_tools({"noir": endpoints, "semgrep": None, "trufflehog": secrets, "unheard-of": endpoints})
    assert set(found) == {"endpoints", "secrets"}
    left = found["endpoints"].select(F.col("route_pattern").cast("long").alias("event_id"), F.lit("endpoints").alias("kind"))
    return left.unionByName(found["secrets"].select(F.col("rel_path").cast("long").alias("event_id"), F.lit("secrets").alias("kind")))


@register("findings_hydrated", f"""WITH {LINES_SQL}
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'given' WHEN len(ls) >= 2 THEN trim(ls[2]) WHEN doc_id % 3 = 1 THEN 'requires login' ELSE 'm' END AS expression FROM cut""")
def findings_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("doc_id") % 3 == 0, "given").when(F.col("doc_id") % 3 == 1, "requires login").otherwise("")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), "text", "doc_id")
    raw = docs.select(F.concat(
        F.lit('{"results":[{"check_id":"r","path":"'), "rel_path", F.lit('","start":{"line":2},"extra":{"message":"m","lines":"'), shown, F.lit('"}}]}')
    ).alias("raw"))
    found = read_findings(raw, files=docs.select("rel_path", "text"))
    return found.select(F.col("rel_path").cast("long").alias("doc_id"), F.col("sink_expression").alias("expression"))


@register("all_changed", "SELECT DISTINCT 'd' || CAST(doc_id % 40 AS VARCHAR) || '/x' AS rel_path FROM documents WHERE doc_id % 40 <> 3")
def all_changed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id") % 40
    folder = F.when(number == 3, ".audit").otherwise(F.concat(F.lit("d"), number.cast("string")))
    return all_changed(table(spark, sf_dir, "documents").select(F.concat(folder, F.lit("/x")).alias("rel_path")))


@register("store_commit", """SELECT 'files' AS t, CAST(o_orderkey AS VARCHAR) AS k, 'APPLICATION_RUNTIME' AS v FROM orders UNION ALL SELECT 'scans', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 'COMPLETED' ELSE 'INITIALIZING' END FROM customer""")
def store_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables committed together, one of them changed later, a third written but not committed."""
    store = Store(spark, new_path(spark, "store"))
    paths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("rel_path"))
    scans = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("scan_id"))
    store.commit({"files": store.merged("files", paths), "scans": store.merged("scans", scans)})
    store.update("scans", lambda s: s.withColumn("status", F.when(F.col("scan_id").cast("long") % 2 == 0, "COMPLETED").otherwise(F.col("status"))))
    scans.limit(0).write.parquet(f"{store.root}/files/v9")
    left = store.read("files").select(F.lit("files").alias("t"), F.col("rel_path").alias("k"), F.col("execution_domain").alias("v"))
    return left.unionByName(store.read("scans").select(F.lit("scans").alias("t"), F.col("scan_id").alias("k"), F.col("status").alias("v")))

"""Reports, events and extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.functions.scoring import engine_fingerprint, engine_fingerprints
from casegraph.operators.graph import graph_edges
from casegraph.operators.matching import first_endpoints, of_scan
from casegraph.operators.report import (
    SARIF_BETWEEN, SARIF_END, SARIF_HEAD, TOOL_NAME, TOOL_VERSION, blueprints, dossier_records, markdown_document, markdown_lines, markdown_rows, sarif_document,
    sarif_lines, sarif_results, sarif_rules, severity_order,
)
from casegraph.operators.verify import AGAINST_HEAD, AGAINST_PROMPT, FOR_HEAD, FOR_PROMPT, JUDGE_PROMPT, Router, complete, debate, infer_links, link_tables, parse_verdicts
from casegraph.plans.scan import judge
from casegraph.queries import register, table
from casegraph.queries.graphs import _first_sql, _model
from casegraph.queries.standins import SEVERITY_SQL
from casegraph.scratch import materialize, new_path
from casegraph.sources.sinks import write_document
from casegraph.streaming.events import critical, distinct_events, log_rows, path_states, read_log, sessions, tumbling

CWE_SQL = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('CWE-', CAST(o_custkey % 7 AS VARCHAR(9))) END"


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "concat('d', CAST(o_orderkey AS VARCHAR(20))) AS dossier_id", "o_orderstatus AS scan_id", "concat('T', CAST(o_custkey AS VARCHAR(20))) AS title",
        "o_orderstatus AS vuln_class", f"{SEVERITY_SQL} AS severity", f"{CWE_SQL} AS cwe_id", "'EXPLOITABLE' AS verdict", "CAST(0.9 AS DOUBLE) AS confidence", "o_orderkey AS ord",
        "o_orderkey", "o_custkey",
    )
    trace = F.array(F.struct(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("line")))
    return rows.withColumns({
        "source_trace": F.when(F.col("o_orderkey") % 5 == 0, F.slice(trace, 1, 0)).otherwise(trace),
        "sanitizer_analysis": F.create_map(F.lit("bypass_notes"), F.col("title"), F.lit("empty"), F.lit("")),
        "repro_curl_template": F.when(F.col("o_orderkey") % 2 == 0, "curl x "), "mitigation_notes": F.lit(""),
    })


DOSSIERS_SQL = f"""SELECT o_orderkey, o_custkey, concat('d', CAST(o_orderkey AS VARCHAR)) AS dossier_id, concat('T', CAST(o_custkey AS VARCHAR)) AS title, o_orderstatus AS vuln_class,
{SEVERITY_SQL} AS severity, {CWE_SQL} AS cwe_id FROM orders"""


@register("distinct_rules_first", f"""SELECT coalesce(cwe_id, vuln_class) AS id, arg_min(vuln_class, o_orderkey) AS name, arg_min(title, o_orderkey) AS text,
arg_min(CASE WHEN severity IN ('CRITICAL','HIGH') THEN 'error' ELSE 'warning' END, o_orderkey) AS level, min(o_orderkey) AS ord FROM ({DOSSIERS_SQL}) GROUP BY 1""")
def distinct_rules_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarif_rules(dossiers(spark, sf_dir)).select("id", "name", "text", "level", "ord")


@register("sarif_rows", f"""SELECT o_orderkey AS ord, coalesce(cwe_id, vuln_class) AS rule, CASE WHEN severity IN ('CRITICAL','HIGH') THEN 'error' ELSE 'warning' END AS level,
title || ': EXPLOITABLE (confidence: 0.9)' AS message, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'f' || CAST(o_custkey AS VARCHAR) END AS uri,
CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE CAST(o_orderkey % 9 + 1 AS INTEGER) END AS line, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Trace step in f' || CAST(o_custkey AS VARCHAR) || ':' || CAST(o_orderkey % 9 + 1 AS VARCHAR) END AS step FROM ({DOSSIERS_SQL})""")
def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sarif_results(dossiers(spark, sf_dir))
    place = F.col("result.locations")[0]["physicalLocation"]
    step = F.get(F.get(F.get(F.col("result.codeFlows"), F.lit(0))["threadFlows"], F.lit(0))["locations"], F.lit(0))["location"]["message"]["text"]
    return rows.select(
        "ord", F.col("result.ruleId").alias("rule"), F.col("result.level").alias("level"), F.col("result.message.text").alias("message"),
        place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("line"), step.alias("step"),
    )


SECTION_SQL = """'- **Vulnerability Class:** `' || vuln_class || '` (' || coalesce(cwe_id, 'None') || ')' || chr(10) || '- **Severity:** `' || severity || '`' || chr(10) || '- **Taint Verdict:** `EXPLOITABLE`' || chr(10) || '- **Confidence:** 0.9'
|| chr(10) || chr(10) || '#### Sanitizer & Bypass Analysis' || chr(10) || '**Bypass Notes:** ' || title || chr(10)
|| CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '#### Reproduction Blueprint (curl)' || chr(10) || '```bash' || chr(10) || 'curl x' || chr(10) || '```' || chr(10) ELSE '' END || chr(10) || '---'"""


@register("markdown_rows", f"""SELECT dossier_id, '| `' || dossier_id || '` | ' || title || ' | `' || vuln_class || '` | **' || severity || '** | `EXPLOITABLE` | 0.9 |' AS summary,
{SECTION_SQL} AS section FROM ({DOSSIERS_SQL})""")
def markdown_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_rows(dossiers(spark, sf_dir)).drop("title")


_FIRST_SQL = """o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'f' || CAST(o_custkey AS VARCHAR) END AS uri, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 9 + 1 END AS line"""
_PLACE_SQL = """'{"artifactLocation":{"uri":"' || uri || '"},"region":{"startLine":' || CAST(line AS VARCHAR) || '}}'"""
_REPORTS_SQL = f"""WITH d AS ({DOSSIERS_SQL}), p AS (SELECT *, coalesce(cwe_id, vuln_class) AS rule, CASE WHEN severity IN ('CRITICAL','HIGH') THEN 'error' ELSE 'warning' END AS level FROM d),
u AS (SELECT o_custkey, '{{"id":"' || rule || '","name":"' || arg_min(vuln_class, o_orderkey) || '","shortDescription":{{"text":"' || arg_min(title, o_orderkey) || '"}},"defaultConfiguration":{{"level":"' || arg_min(level, o_orderkey) || '"}}}}' AS j, min(o_orderkey) AS ord FROM p GROUP BY o_custkey, rule),
ur AS (SELECT o_custkey, string_agg(j, ',' ORDER BY ord, j) AS rules FROM u GROUP BY o_custkey),
f AS (SELECT p.*, uri, line FROM p JOIN (SELECT {_FIRST_SQL} FROM orders) q USING (o_orderkey)),
r AS (SELECT o_custkey, o_orderkey, '{{"ruleId":"' || rule || '","level":"' || level || '","message":{{"text":"' || title || ': EXPLOITABLE (confidence: 0.9)"}},"locations":[{{"physicalLocation":' || {_PLACE_SQL} || '}}]'
 || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',"codeFlows":[{{"threadFlows":[{{"locations":[{{"location":{{"physicalLocation":' || {_PLACE_SQL} || ',"message":{{"text":"Trace step in ' || uri || ':' || CAST(line AS VARCHAR) || '"}}}}}}]}}]}}]' END || '}}' AS j FROM f),
rr AS (SELECT o_custkey, string_agg(j, ',' ORDER BY o_orderkey) AS results FROM r GROUP BY o_custkey),
m AS (SELECT o_custkey, o_orderkey, dossier_id, title, severity, row_number() OVER (PARTITION BY o_custkey ORDER BY severity, dossier_id) AS k,
 '| `' || dossier_id || '` | ' || title || ' | `' || vuln_class || '` | **' || severity || '** | `EXPLOITABLE` | 0.9 |' AS summary, {{section}} AS section FROM d),
md AS (SELECT o_custkey, count(*) AS n, string_agg(summary || chr(10), '' ORDER BY k) AS t, string_agg(chr(10) || '### ' || CAST(k AS VARCHAR) || '. ' || title || chr(10) || section, '' ORDER BY k) AS s FROM m GROUP BY o_custkey)
SELECT 'c' || CAST(o_custkey AS VARCHAR) AS scan_id, 'sarif' AS kind, '{SARIF_HEAD}{{"name":"{TOOL_NAME}","semanticVersion":"{TOOL_VERSION}","rules":[' || rules || ']}}{SARIF_BETWEEN}' || results || '{SARIF_END}' AS document FROM ur JOIN rr USING (o_custkey)
UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'md', '# Security Review Research Dossier' || chr(10) || '**Scan ID:** `c' || CAST(o_custkey AS VARCHAR) || '`' || chr(10) || '**Total Findings:** ' || CAST(n AS VARCHAR) || chr(10) || chr(10) || '## Executive Summary' || chr(10) || chr(10)
 || '| Finding ID | Title | Vuln Class | Severity | Verdict | Confidence |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || t || chr(10) || '---' || chr(10) || chr(10) || '## Detailed Vulnerability Theories & Reproductions' || chr(10) || s FROM md"""


@register("report_documents", _REPORTS_SQL.replace("{section}", SECTION_SQL))
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both documents of every scan, over all orders; a scan stands for one customer's orders."""
    own = dossiers(spark, sf_dir).withColumn("scan_id", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    ranked = severity_order(own.drop("ord"))
    sarif, markdown = sarif_document(own, by=("scan_id",)), markdown_document(ranked, by="scan_id")
    return sarif.withColumn("kind", F.lit("sarif")).unionByName(markdown.withColumn("kind", F.lit("md")))


@register("report_pieces", "SELECT * FROM (" + _REPORTS_SQL.replace("{section}", SECTION_SQL) + ") WHERE scan_id = (SELECT 'c' || CAST(min(o_custkey) AS VARCHAR) FROM orders)")
def report_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan's documents put together from their pieces."""
    all_own = dossiers(spark, sf_dir).withColumn("scan_id", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    scan_id = f"c{table(spark, sf_dir, 'orders').agg(F.min('o_custkey')).first()[0]}"
    own = of_scan(all_own, scan_id)
    pieces = {"md": markdown_lines(severity_order(own.drop("ord")), scan_id), "sarif": sarif_lines(own)}
    out = None
    for kind, lines in pieces.items():
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "text"))), lambda x: x["text"]), "")
        one = lines.agg(text.alias("document")).select(F.lit(scan_id).alias("scan_id"), F.lit(kind).alias("kind"), "document")
        out = one if out is None else out.unionByName(one)
    return out


@register("dossier_records", """SELECT 'dos_' || substring(sha256('scan1|fp' || CAST(o_orderkey AS VARCHAR)), 1, 12) AS dossier_id, 'scan1' AS scan_id, 'e1' AS engine_fingerprint, 'path_scan1_' || CAST(o_orderkey AS VARCHAR) AS path_id,
CASE WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, CASE WHEN o_orderkey % 3 = 0 THEN 'CWE-Unknown' ELSE 'CWE-1' END AS cwe_id, CAST(1.0 AS DOUBLE) AS reachability_confidence, CAST(1 AS INTEGER) AS fingerprint_schema_version, true AS dated, o_custkey AS sink_id FROM orders""")
def dossier_records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("fp"), key).alias("finding_fingerprint"), F.concat(F.lit("path_scan1_"), key).alias("path_id"), F.when(F.col("o_orderkey") % 2 == 0, "high").otherwise("Low").alias("severity"),
        F.when(F.col("o_orderkey") % 3 != 0, "CWE-1").alias("cwe_id"), F.lit(None).cast("double").alias("reachability_confidence"), F.col("o_custkey").alias("sink_id"),
    )
    found = dossier_records(rows, "scan1", "e1", ("sink_id",))
    return found.select("dossier_id", "scan_id", "engine_fingerprint", "path_id", "severity", "cwe_id", "reachability_confidence", "fingerprint_schema_version", F.col("created_at").isNotNull().alias("dated"), "sink_id")


@register("severity_alpha_sort", f"SELECT dossier_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY severity, dossier_id) AS ord FROM (SELECT o_orderstatus, d.* FROM ({DOSSIERS_SQL}) d JOIN orders o ON o.o_orderkey = d.o_orderkey)")
def severity_alpha_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_order(dossiers(spark, sf_dir).drop("ord")).select("dossier_id", "ord")


@register("collect_trace", "SELECT l_orderkey, string_agg('Trace step in f' || CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR), '>' ORDER BY l_linenumber, l_suppkey) AS trace FROM lineitem GROUP BY l_orderkey")
def collect_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested locations of a finding's code flow, an order's lines as its trace."""
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    trace = F.transform("s", lambda x: F.struct(F.concat(F.lit("f"), x["l_suppkey"].cast("string")).alias("file"), x["l_linenumber"].cast("int").alias("line")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(steps.alias("s")).withColumns({
        "source_trace": trace, **{c: F.lit("x") for c in ("cwe_id", "vuln_class", "severity", "title", "verdict", "confidence")},
    })
    found = sarif_results(rows, "l_orderkey")
    locations = F.col("result.codeFlows")[0]["threadFlows"][0]["locations"]
    return found.select(F.col("ord").alias("l_orderkey"), F.array_join(F.transform(locations, lambda x: x["location"]["message"]["text"]), ">").alias("trace"))


_URL = '"${TARGET_URL:-http://localhost:3000}/o/'


@register("repro_template", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NON_HTTP_TEMPLATE' ELSE 'HTTP_TEMPLATE' END AS reproduction_type, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN
'curl -G {_URL}' || CAST(o_orderkey AS VARCHAR) || '"' || h || ' --data-urlencode "id=BT_FLOW_MARKER_001"' ELSE
'curl -X POST {_URL}' || CAST(o_orderkey AS VARCHAR) || '"' || h || ' -H "Content-Type: application/json" -d ''{{"id": "BT_FLOW_MARKER_001", "n": "1"}}''' END AS curl_command
FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN ' -H "Authorization: Bearer ${{AUTH_TOKEN}}"' ELSE '' END AS h FROM orders)""")
def repro_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 5 == 0, None).when(key % 2 == 0, "get").otherwise("POST").alias("method"), F.concat(F.lit("/o/"), key.cast("string")).alias("route"),
        F.when(F.col("o_orderstatus") == "O", "REQUIRED").otherwise("UNKNOWN").alias("auth_state"), F.when(key % 2 == 0, "query").otherwise("body").alias("param_location"),
        F.lit("id").alias("param_name"), F.array(F.struct(F.lit("BODY").alias("location"), F.lit("n").alias("name"), F.lit("1").alias("dummy"))).alias("siblings"), F.lit("eval").alias("sink"),
    )
    return blueprints(rows).select("o_orderkey", "reproduction_type", "curl_command")


@register("event_log_batch", "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, sum(CAST(props->>'$.k' AS BIGINT)) AS k FROM events GROUP BY event_type")
def event_log_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log, one JSON object a line, read back."""
    path = new_path(spark, "event-log")
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("string").alias("timestamp"), F.col("user_id").cast("string").alias("scan_id"),
        F.lit("c").alias("component"), "event_type", F.from_json("props", "map<string,string>").alias("payload"),
    )
    log.write.json(path)
    number = F.col("event_id").cast("long")
    found = read_log(spark, path).groupBy("event_type")
    return found.agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("first_id"), F.max(number).alias("last_id"), F.sum(F.col("payload")["k"].cast("long")).alias("k"))


@register("path_states", """SELECT CAST(user_id AS VARCHAR) AS path_id, arg_max(s, event_id) AS state, max(event_id) AS seq
FROM (SELECT *, CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'RESOLVED' WHEN 'signup' THEN 'UNRESOLVED' END AS s FROM events) WHERE s IS NOT NULL GROUP BY user_id""")
def path_states_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine over the events as a stream; of its updates, the last of each path."""
    names = F.create_map(*[F.lit(x) for pair in (("view", "QUEUED"), ("click", "RUNNING"), ("purchase", "RESOLVED"), ("signup", "UNRESOLVED"), ("error", "NONE")) for x in pair])
    stream = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("path_id"), names[F.col("event_type")].alias("state"), F.col("event_id").alias("seq"), "ts")
    out, checkpoint = new_path(spark, "path-states"), new_path(spark, "path-states-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(out)

    states = path_states(stream, "ts")
    states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.schema("path_id string, state string, seq long").parquet(out)
    return updates.groupBy("path_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


@register("critical_events", "SELECT event_id, 'PATH_TRANSITION' AS event_type FROM events WHERE event_type = 'purchase'")
def critical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "PATH_TRANSITION").otherwise("SCAN_STARTED")
    return critical(table(spark, sf_dir, "events").select("event_id", kind.alias("event_type")))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, the table's own file only."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, to a folder, and read it."""
    out, checkpoint = new_path(spark, name), new_path(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@register("stream_dedupe", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_id FROM events) GROUP BY user_id")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir)
    rows = _drain(spark, distinct_events(stream.unionByName(stream), "event_id"), "stream-dedupe")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@register("ext_window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tumbling(table(spark, sf_dir, "events"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("ext_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, k""")
def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@register("ext_rollup", f"SELECT severity, o_orderstatus AS status, count(*) AS n FROM (SELECT *, {SEVERITY_SQL} AS severity FROM orders) GROUP BY ROLLUP (severity, o_orderstatus)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.expr(SEVERITY_SQL).alias("severity"), F.col("o_orderstatus").alias("status"))
    return rows.rollup("severity", "status").agg(F.count(F.lit(1)).alias("n"))


def _answer(prompt: str) -> str:
    """A stand-in for a completion service: its answer depends on the prompt's length only."""
    if len(prompt) % 3 == 0:
        return "no json here"
    verdict = "EXPLOITABLE" if len(prompt) % 3 == 1 else "MAYBE"
    return f'Sure: {{"verdict": "{verdict}", "confidence": 0.75, "reasoning": "r"}}'


@register("completion_stub_verdict", "SELECT conv_id, turn, CASE WHEN length(text) % 3 = 1 THEN 'EXPLOITABLE' ELSE 'INSUFFICIENT_CONTEXT' END AS verdict, CAST(CASE WHEN length(text) % 3 = 1 THEN 0.75 ELSE 0 END AS DOUBLE) AS confidence FROM conversations")
def completion_stub_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = complete(prompts, Router(_answer, retries=0), text_col="answer")
    return parse_verdicts(answered, "answer").select("conv_id", "turn", "verdict", "confidence")


def _answers_sql(length: str, ways: tuple[str, str, str]) -> str:
    return f"CASE ({length}) % 3 WHEN 0 THEN {ways[0]} WHEN 1 THEN {ways[1]} ELSE {ways[2]} END"


def _debate_sql() -> str:
    """The stand-in's answers depend on lengths, so the three prompts' lengths decide."""
    sizes = tuple(str(len(_answer("x" * n))) for n in (3, 1, 2))
    first, second = ("length(text) + %d" % len(head) for head in (FOR_PROMPT, AGAINST_PROMPT))
    last = f"{len(JUDGE_PROMPT)} + length(text) + {len(FOR_HEAD)} + {_answers_sql(first, sizes)} + {len(AGAINST_HEAD)} + {_answers_sql(second, sizes)}"
    return f"SELECT conv_id, turn, CASE WHEN n % 3 = 1 THEN 'EXPLOITABLE' ELSE 'INSUFFICIENT_CONTEXT' END AS verdict, CAST(CASE WHEN n % 3 = 1 THEN 0.75 ELSE 0 END AS DOUBLE) AS confidence FROM (SELECT conv_id, turn, {last} AS n FROM conversations)"


@register("debate_stub", _debate_sql())
def debate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("slice"))
    return debate(slices, Router(_answer, retries=0)).select("conv_id", "turn", "verdict", "confidence")


class _Flaky:
    """A service that fails as often as the prompt says, and the waits of the router that asks it."""

    def __init__(self) -> None:
        self.calls, self.waited = 0, 0.0

    def __call__(self, prompt: str) -> str:
        self.calls += 1
        if self.calls <= int(prompt.split("|")[0]):
            raise OSError("not now")
        return self.said()

    def said(self) -> str:
        answer = f"{self.calls}:{self.waited:g}"
        self.calls, self.waited = 0, 0.0
        return answer

    def wait(self, seconds: float) -> None:
        self.waited += seconds


@register("completion_retries", """SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '1:0' WHEN 1 THEN '2:1' WHEN 2 THEN '3:3' ELSE 'F3:3' END AS answer FROM conversations""")
def completion_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts with doubled waits between them, then the fallback."""
    fails = ((F.col("conv_id") + F.col("turn")) % 4).cast("string")
    prompts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(fails, F.lit("|x")).alias("prompt"))
    service = _Flaky()
    router = Router(service, lambda prompt: "F" + service.said(), retries=2, backoff=1.0, sleep=service.wait)
    return complete(prompts, router, text_col="answer").select("conv_id", "turn", "answer")


@register("linker_stub", """SELECT s_suppkey AS caller_symbol_id, (SELECT min(p_partkey) FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) AS callee_symbol_id, 'DYNAMIC_DISPATCH' AS edge_type, CAST(0.85 AS DOUBLE) AS confidence
FROM supplier WHERE s_suppkey % 3 <> 0""")
def linker_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    key = F.col("s_suppkey")
    good = F.lit(f'{{"target_symbol": "{name}", "confidence": 0.85}}')
    turns = table(spark, sf_dir, "supplier").select(key.alias("caller_symbol_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("turn"))
    text = F.when((F.col("caller_symbol_id") % 3 == 0) & (F.col("turn") < 3), "none").when(F.col("turn") == 1, "none").otherwise(good)
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("name"))
    return infer_links(turns.withColumn("text", text), symbols).drop("provenance")


@register("linker_persisted", """WITH l AS (SELECT s_suppkey AS a, (SELECT min(p_partkey) FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) AS b FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT a AS caller_symbol_id, b AS callee_symbol_id, a % 3 = 1 AS known, 'AGENT_INFERRED' AS resolution_method, CAST(0.85 AS DOUBLE) AS confidence, true AS is_active FROM l
UNION ALL SELECT a, b, true, 'AST', CAST(0.5 AS DOUBLE), true FROM l WHERE a % 3 = 1""")
def linker_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred links in the tables, beside edges that were there and keep their ids."""
    links = linker_stub(spark, sf_dir).withColumn("provenance", F.lit("AGENT_INFERRED"))
    old = links.filter("caller_symbol_id % 3 = 1").select((-F.col("caller_symbol_id") - 1).alias("edge_id"), "caller_symbol_id", "callee_symbol_id", "edge_type")
    evidence = old.select("edge_id", F.lit("AST").alias("resolution_method"), F.lit(0.5).alias("confidence"))
    after = link_tables(links, S.evolve(old, "graph_edges"), S.evolve(evidence, "graph_edge_evidence"))
    joined = after["graph_edge_evidence"].join(after["graph_edges"], "edge_id")
    known = (F.col("edge_id") == -F.col("caller_symbol_id") - 1).alias("known")
    return joined.select("caller_symbol_id", "callee_symbol_id", known, "resolution_method", "confidence", "is_active")


_IDENTITY = '{"engine_version": "0.2.0", "lockfile_hash": "none", "mode": "FULL", "resolver_version": "0.2.0", "schema_version": 1}'


@register("engine_fingerprint", f"SELECT r_regionkey, sha256('{_IDENTITY}') AS fingerprint FROM region")
def engine_fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", F.lit(engine_fingerprint({"mode": "FULL"})).alias("fingerprint"))


@register("engine_fingerprints", """WITH s AS (SELECT o_orderkey, '{"engine_version": "0.2.0", "kind": "' || o_orderstatus || '", "lockfile_hash": "' || CASE WHEN o_custkey % 3 = 0 THEN 'none' ELSE sha256('lock' || CAST(o_custkey AS VARCHAR)) END
|| '", "mode": "' || o_orderpriority || '", "resolver_version": "' || CASE WHEN o_custkey % 2 = 0 THEN 'own' ELSE '0.2.0' END || '", "schema_version": 1}' AS j FROM orders) SELECT o_orderkey, sha256(j) AS fingerprint FROM s""")
def engine_fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan per order: its configuration, a lockfile in some, a value that replaces the engine's own in others."""
    own = F.create_map(F.lit("mode"), F.col("o_orderpriority"), F.lit("kind"), F.col("o_orderstatus"))
    config = F.when(F.col("o_custkey") % 2 == 0, F.map_concat(own, F.create_map(F.lit("resolver_version"), F.lit("own")))).otherwise(own)
    lock = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("lock"), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", engine_fingerprints(config, lock).alias("fingerprint"))


@register("event_batches", """SELECT CASE WHEN event_type = 'purchase' THEN 'PATH_TRANSITION' ELSE 'SCAN_STARTED' END AS event_type, count(*) AS n, count(*) AS n_ids, CAST(sum(event_id) AS BIGINT) AS ids,
min('s1') AS scan_id, true AS stamped FROM events GROUP BY 1""")
def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events written as one batch of the log by tasks, and read back with their ids and UTC times."""
    folder = new_path(spark, "event-batches")
    kind = F.when(F.col("event_type") == "purchase", "PATH_TRANSITION").otherwise("SCAN_STARTED")
    rows = table(spark, sf_dir, "events").select(F.lit("c").alias("component"), kind.alias("event_type"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("payload"))
    log_rows(rows, folder, "s1")
    stamped = F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$")
    return read_log(spark, folder).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"), F.sum(F.col("payload")["id"].cast("long")).alias("ids"), F.min("scan_id").alias("scan_id"), F.min(stamped).alias("stamped"),
    )


@register("report_file_lines", f"""WITH m AS (SELECT row_number() OVER (ORDER BY severity, dossier_id) AS k, dossier_id, title, vuln_class, severity FROM ({DOSSIERS_SQL})),
t AS (SELECT '| `' || dossier_id || '` | ' || title || ' | `' || vuln_class || '` | **' || severity || '** | `EXPLOITABLE` | 0.9 |' AS line, k AS pos FROM m
UNION ALL SELECT '### ' || CAST(k AS VARCHAR) || '. ' || title, k + (SELECT count(*) FROM m) FROM m) SELECT line, row_number() OVER (ORDER BY pos) AS place FROM t""")
def report_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report of all orders as a file, written by tasks and published by a commit; its table lines and headings with their places as read back."""
    path = f"{new_path(spark, 'report-file')}/report.md"
    own = dossiers(spark, sf_dir).drop("ord").withColumn("scan_id", F.lit("all"))
    write_document(markdown_lines(severity_order(own), "all"), path, "part", "ord")
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).filter("value like '### %' or value like '| `d%'")
    kept = materialize(lines.select(F.col("value").alias("line"), "n"), "report-read")
    # The file is read in parts that follow each other: a line's place is its place in its part after all parts before.
    inside = kept.withColumn("p", F.shiftright("n", 33)).withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("n")))
    before = inside.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    before = before.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return inside.join(F.broadcast(before), "p").select("line", (F.col("first") + F.col("i")).cast("long").alias("place"))


@register("derived_ids", f"""WITH f AS ({_first_sql(True)}) SELECT sink_id, 'path_scan1_' || CAST(sink_id AS VARCHAR) AS path_id, 'dos_scan1_' || CAST(sink_id AS VARCHAR) AS dossier_id, 'RCE in ' || s_name || ':3' AS title,
endpoint_id, hops, coalesce(reach, 0) AS reachability_confidence, sha256('v1|RCE|' || CASE WHEN endpoint_id IS NULL THEN 'NONE' ELSE 'GET ' || c_name END || '|HTTP|' || s_name || '|src/' || s_name) AS finding_fingerprint
FROM f JOIN supplier ON s_suppkey = sink_id LEFT JOIN customer ON c_custkey = endpoint_id""")
def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers of all sinks as a scan judges them: ids from scan and sink, titles, fingerprints."""
    _, endpoints, sinks, edges, evidence = _model(spark, sf_dir)
    name = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("src/"), "s_name").alias("rel_path"), F.lit("APPLICATION_RUNTIME").alias("execution_domain"))
    matched = first_endpoints(sinks.withColumn("cwe_id", F.lit(None).cast("string")), endpoints, graph_edges(endpoints, sinks, edges, evidence))
    endpoints = endpoints.withColumn("auth_state", F.lit("UNKNOWN"))
    found = judge(matched, name, endpoints, "scan1", "e1")
    return found.select("sink_id", "path_id", "dossier_id", "title", "endpoint_id", "hops", "reachability_confidence", "finding_fingerprint")

"""Reports: SARIF, Markdown, graph JSON, reproduction blueprints with inert markers."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.functions.scoring import sarif_level
from casegraph.functions.text import strip, title_case
from casegraph.scratch import materialize

# The report formats' constants, and the marker that does nothing.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"
MARKER = "BT_FLOW_MARKER_001"
BEARER = "Authorization: Bearer ${AUTH_TOKEN}"
TARGET = "${TARGET_URL:-http://localhost:3000}"

TOOL_NAME = "casegraph"
TOOL_VERSION = "0.1.0"


SARIF_HEAD = f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":'
SARIF_BETWEEN, SARIF_END = '},"results":[', "]}]}"
# The headings of the Markdown report.
MARKDOWN_BETWEEN = "\n---\n\n## Detailed Vulnerability Theories & Reproductions\n"


def _sarif_rule() -> Column:
    return F.struct("id", "name", F.struct(F.col("text")).alias("shortDescription"), F.struct(F.col("level")).alias("defaultConfiguration"))


def _markdown_head(scan: Column, findings: Column) -> Column:
    return F.concat(
        F.lit("# Security Review Research Dossier\n**Scan ID:** `"), scan, F.lit("`\n**Total Findings:** "), findings,
        F.lit("\n\n## Executive Summary\n\n| Finding ID | Title | Vuln Class | Severity | Verdict | Confidence |\n|---|---|---|---|---|---|\n"),
    )


def rule_id(dossiers_cwe: Column, vuln_class: Column) -> Column:
    filled = F.when(dossiers_cwe != "", dossiers_cwe)
    return F.coalesce(filled, vuln_class, F.lit("SEC-VULN"))


def sarif_rules(dossiers: DataFrame, order: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """(id, name, text, level, ord): a rule per id, inside each value of ``by``; its first finding supplies the rest."""
    rows = dossiers.select(
        rule_id(F.col("cwe_id"), F.col("vuln_class")).alias("id"), F.coalesce("vuln_class", F.lit("SecurityVulnerability")).alias("name"),
        F.coalesce("title", F.lit("")).alias("text"), sarif_level(F.coalesce("severity", F.lit(""))).alias("level"), F.col(order).alias("ord"), *by,
    )
    picked = rows.groupBy(*by, "id").agg(F.min_by(F.struct("name", "text", "level"), "ord").alias("r"), F.min("ord").alias("ord"))
    return picked.select("id", "r.*", "ord", *by)


def message(title: Column, verdict: Column, confidence: Column) -> Column:
    return F.concat(title, F.lit(": "), verdict, F.lit(" (confidence: "), confidence.cast("string"), F.lit(")"))


def sarif_results(dossiers: DataFrame, order: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """(ord, result): one result struct per finding, and the columns ``by``."""
    first = F.get(F.col("source_trace"), F.lit(0))
    file, line = F.coalesce(first["file"], F.lit("unknown")), F.coalesce(first["line"], F.lit(1))

    def place(uri: Column, number: Column) -> Column:
        return F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(number.cast("int").alias("startLine")).alias("region"))

    def step(s: Column) -> Column:
        uri, number = F.coalesce(s["file"], F.lit("unknown")), F.coalesce(s["line"], F.lit(1))
        text = F.concat(F.lit("Trace step in "), uri, F.lit(":"), number.cast("string"))
        return F.struct(F.struct(place(uri, number).alias("physicalLocation"), F.struct(text.alias("text")).alias("message")).alias("location"))

    flows = F.when(F.size("source_trace") > 0, F.array(F.struct(F.array(F.struct(F.transform("source_trace", step).alias("locations"))).alias("threadFlows"))))
    result = F.struct(
        rule_id(F.col("cwe_id"), F.col("vuln_class")).alias("ruleId"),
        sarif_level(F.coalesce("severity", F.lit(""))).alias("level"),
        F.struct(message(F.col("title"), F.col("verdict"), F.col("confidence")).alias("text")).alias("message"),
        F.array(F.struct(place(file, line).alias("physicalLocation"))).alias("locations"),
        flows.alias("codeFlows"),
    )
    return dossiers.select(F.col(order).alias("ord"), result.alias("result"), *by)


def sarif_document(dossiers: DataFrame, order: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (document): the SARIF log as JSON, its pieces (``sarif_lines``) joined.

    ``by``: a document for each value of these columns instead, beside them, by grouped aggregates.
    """
    if not by:
        return joined(sarif_lines(dossiers, order))

    def listed(df: DataFrame, value: Column) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(F.col("ord"), value.alias("v"))))
        return df.groupBy(*by).agg(F.transform(pairs, lambda p: p["v"]).alias("items"))

    rules = listed(sarif_rules(dossiers, order, by), _sarif_rule()).withColumnRenamed("items", "rules")
    # Results hold optional parts, which don't compare: they are sorted as JSON text, by their place.
    results = sarif_results(dossiers, order, by).select("ord", F.to_json("result").alias("r"), *by)
    results = listed(results, F.col("r")).withColumnRenamed("items", "results")
    driver = F.to_json(F.struct(F.lit(TOOL_NAME).alias("name"), F.lit(TOOL_VERSION).alias("semanticVersion"), F.col("rules")))
    text = F.concat(F.lit(SARIF_HEAD), driver, F.lit(SARIF_BETWEEN), F.array_join("results", ","), F.lit(SARIF_END))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    return rules.alias("l").join(results.alias("r"), reduce(and_, same)).select(*[f"l.{c}" for c in by], text.alias("document"))


def markdown_rows(dossiers: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(dossier_id, summary, section) per finding, and the columns ``keep``; the section lacks its number."""
    confidence = F.col("confidence").cast("string")
    summary = F.concat(
        F.lit("| `"), F.col("dossier_id"), F.lit("` | "), F.col("title"), F.lit(" | `"), F.col("vuln_class"), F.lit("` | **"), F.col("severity"),
        F.lit("** | `"), F.col("verdict"), F.lit("` | "), confidence, F.lit(" |"),
    )
    facts = F.concat(
        F.lit("- **Vulnerability Class:** `"), F.col("vuln_class"), F.lit("` ("), F.coalesce("cwe_id", F.lit("None")), F.lit(")\n- **Severity:** `"),
        F.col("severity"), F.lit("`\n- **Taint Verdict:** `"), F.col("verdict"), F.lit("`\n- **Confidence:** "), confidence,
        F.lit("\n\n#### Sanitizer & Bypass Analysis"),
    )
    entries = F.filter(F.map_entries(F.coalesce("sanitizer_analysis", F.create_map().cast("map<string,string>"))), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    analysis = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("\n**"), title_case(e["key"]), F.lit(":** "), e["value"], F.lit("\n"))), "")
    curl = F.when(F.coalesce("repro_curl_template", F.lit("")) != "", F.concat(F.lit("\n#### Reproduction Blueprint (curl)\n```bash\n"), strip(F.col("repro_curl_template")), F.lit("\n```\n"))).otherwise("")
    mitigation = F.when(F.coalesce("mitigation_notes", F.lit("")) != "", F.concat(F.lit("\n#### Mitigation & Remediation\n"), strip(F.col("mitigation_notes")), F.lit("\n"))).otherwise("")
    return dossiers.select("dossier_id", summary.alias("summary"), F.concat(facts, analysis, curl, mitigation, F.lit("\n---")).alias("section"), "title", *keep)


def markdown_document(dossiers: DataFrame, scan_id: str | None = None, order: str = "ord", by: str | None = None) -> DataFrame:
    """One row (document): the report, its pieces (``markdown_lines``) joined. Findings in the order of ``order``.

    ``by``: a document for each value of this column instead, beside it, which stands for ``scan_id``.
    """
    if by is None:
        return joined(markdown_lines(dossiers, scan_id, order))
    rows = markdown_rows(dossiers.withColumn("_o", F.col(order)), ("_o", by))
    whole = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_o", "summary", "title", "section"))).alias("f"))
    head = _markdown_head(F.coalesce(F.col(by).cast("string"), F.lit("N/A")), F.size("f").cast("string"))
    table = F.array_join(F.transform("f", lambda x: F.concat(x["summary"], F.lit("\n"))), "")
    sections = F.array_join(
        F.transform("f", lambda x, i: F.concat(F.lit("\n### "), (i + 1).cast("string"), F.lit(". "), x["title"], F.lit("\n"), x["section"])), ""
    )
    return whole.select(by, F.concat(head, table, F.lit(MARKDOWN_BETWEEN), sections).alias("document"))


def dossier_records(
    rows: DataFrame, scan_id: str, fingerprint: str, beside: tuple[str, ...] = (),
) -> DataFrame:
    """Verdicts with their findings as rows of ``scan_dossiers``, and the columns ``beside``.

    Severities are upper case; a missing id is a hash of the finding's fingerprint; a missing weakness number is unknown.
    """
    given = {c.lower() for c in rows.columns}
    own = F.concat(F.lit("dos_"), F.substring(F.sha2(F.concat_ws("|", F.lit(scan_id), "finding_fingerprint"), 256), 1, 12))
    fixed = {
        "dossier_id": F.coalesce("dossier_id", own) if "dossier_id" in given else own,
        "scan_id": F.lit(scan_id), "engine_fingerprint": F.lit(fingerprint), "severity": F.upper("severity"),
        "cwe_id": F.coalesce("cwe_id", F.lit("CWE-Unknown")), "created_at": F.current_timestamp(),
    }
    columns = [(fixed.get(f.name, F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType)).alias(f.name) for f in S.TABLES["scan_dossiers"].schema.fields]
    defaults = S.TABLES["scan_dossiers"].defaults
    shaped = rows.select(*columns, *beside)
    return shaped.withColumns({c: F.coalesce(c, F.lit(v).cast(shaped.schema[c].dataType)) for c, v in defaults.items()})


def markdown_lines(dossiers: DataFrame, scan_id: str | None = None, order: str = "ord") -> DataFrame:
    """(part, ord, text): ``markdown_document`` in pieces, to be put together in this order; no task holds the document."""
    rows = markdown_rows(dossiers.withColumn("_o", F.col(order).cast("long")), ("_o",))
    head = dossiers.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), _markdown_head(F.lit(scan_id or "N/A"), F.col("n").cast("string")).alias("text")
    )
    table = rows.select(F.lit(1).alias("part"), F.col("_o").alias("ord"), F.concat("summary", F.lit("\n")).alias("text"))
    between = head.select(F.lit(2).alias("part"), "ord", F.lit(MARKDOWN_BETWEEN).alias("text"))
    numbered = F.concat(F.lit("\n### "), F.col("_o").cast("string"), F.lit(". "), F.col("title"), F.lit("\n"), F.col("section"))
    return head.unionByName(table).unionByName(between).unionByName(rows.select(F.lit(3).alias("part"), F.col("_o").alias("ord"), numbered.alias("text")))


def sarif_lines(dossiers: DataFrame, order: str = "ord") -> DataFrame:
    """(part, ord, text): ``sarif_document`` in pieces, to be put together in this order."""
    def listed(df: DataFrame, part: int, text: Column) -> DataFrame:
        first = df.agg(F.min("ord").alias("least"))
        comma = F.when(F.col("ord") > F.col("least"), ",").otherwise("")
        # The least place is one row.
        return df.crossJoin(F.broadcast(first)).select(F.lit(part).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat(comma, text).alias("text"))

    def fixed(part: int, text: str) -> DataFrame:
        return dossiers.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit(text).alias("text"))

    rules = listed(sarif_rules(dossiers, order), 1, F.to_json(_sarif_rule()))
    results = listed(sarif_results(dossiers, order), 3, F.to_json("result"))
    return fixed(0, SARIF_HEAD + f'{{"name":"{TOOL_NAME}","semanticVersion":"{TOOL_VERSION}","rules":[').unionByName(rules).unionByName(
        fixed(2, "]" + "}" + SARIF_BETWEEN)).unionByName(results).unionByName(fixed(4, SARIF_END))


def graph_lines(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(part, ord, text): the graph {"nodes": [...], "edges": [...]} in pieces, each list sorted by its text."""
    spark = nodes.sparkSession

    def listed(df: DataFrame, part: int) -> DataFrame:
        texts = df.select(F.to_json(F.struct(*df.columns)).alias("text")).repartitionByRange("text").sortWithinPartitions("text")
        placed = materialize(texts.select(F.lit(part).alias("part"), F.monotonically_increasing_id().alias("ord"), "text"), "graph-lines")
        first = placed.agg(F.min("ord")).first()[0]
        return placed.withColumn("text", F.concat(F.when(F.col("ord") == first, "").otherwise(","), "text")) if first is not None else placed

    def fixed(part: int, text: str) -> DataFrame:
        return spark.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit(text).alias("text"))

    out = fixed(0, '{"nodes":[').unionByName(listed(nodes, 1)).unionByName(fixed(2, '],"edges":['))
    return (out if edges is None else out.unionByName(listed(edges, 3))).unionByName(fixed(4, "]}"))


def graph_document(nodes: DataFrame, edges: DataFrame | None = None, **beside: str) -> DataFrame:
    """One row (document): the pieces of ``graph_lines`` joined, and the fixed columns ``beside`` before it."""
    return joined(graph_lines(nodes, edges), **beside)


#: Bytes of the longest text that a row holds: Spark's rows end at 2^31 - 16 bytes, other columns included.
LARGEST_TEXT = 2**31 - 1024


def _text(column: pa.Array) -> pa.Array:
    """The texts of a batch as one; no text counts as an empty one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column.fill_null("")), "")


def blocks(pieces: DataFrame) -> DataFrame:
    """(part, ord, text): sorted pieces, an Arrow batch of neighbours as one text at the place of its first; no task holds more than a batch."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0).slice(0, 1), batch.column(1).slice(0, 1), _text(batch.column(2))], names=["part", "ord", "text"])

    placed = pieces.select(F.col("part").cast("int").alias("part"), F.col("ord").cast("long").alias("ord"), "text")
    return placed.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").mapInArrow(pack, "part int, ord long, text string")


def joined(pieces: DataFrame, **beside: str) -> DataFrame:
    """(document): pieces (part, ord, text) as one text, and the fixed columns ``beside`` before it, for documents that one row can hold.

    One task sorts the blocks, and its Python worker holds the text once while it grows, so no row has to be gathered with all
    others. A document beyond ``LARGEST_TEXT`` is refused, not cut: it stays in pieces, as ``graph_lines`` and the others give
    them, or goes to a file (``write_document``).
    """
    def join(batches: Iterator[pa.RecordBatch], most: int = LARGEST_TEXT) -> Iterator[pa.RecordBatch]:
        whole = bytearray()
        for batch in batches:
            text = memoryview(_text(batch.column(0))[0].as_buffer())
            if len(whole) + len(text) > most:
                raise ValueError(f"a document of more than {most} bytes is no text of one row: take its pieces, or write it to a file")
            whole += text
        document = pa.StringArray.from_buffers(1, pa.py_buffer(struct.pack("=2i", 0, len(whole))), pa.py_buffer(whole))
        yield pa.record_batch([*(pa.array([v], pa.string()) for v in beside.values()), document], names=[*beside, "document"])

    # An empty piece, so that a document without pieces is an empty text.
    empty = pieces.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("text"))
    ordered = blocks(pieces).unionByName(empty).repartition(1).sortWithinPartitions("part", "ord").select("text")
    return ordered.mapInArrow(join, ", ".join(f"{c} string" for c in (*beside, "document")))


def blueprints(rows: DataFrame) -> DataFrame:
    """``rows`` (method, route, auth_state, param_location, param_name, siblings, sink) with reproduction columns.

    Markers are inert: a blueprint shows a flow, it carries no payload.
    """
    http = F.col("method").isNotNull() & F.col("route").isNotNull() & (F.col("method") != "") & (F.col("route") != "")
    method = F.upper("method")
    location = F.upper(F.coalesce("param_location", F.lit("QUERY")))
    name = F.coalesce("param_name", F.lit("q"))
    header = F.when(F.col("auth_state") == "REQUIRED", f' -H "{BEARER}"').otherwise("")
    url = F.concat(F.lit(f'"{TARGET}'), F.col("route"), F.lit('"'))
    get = F.concat(F.lit("curl -G "), url, header, F.lit(' --data-urlencode "'), name, F.lit(f'={MARKER}"'))

    def pair(key: Column, value: Column) -> Column:
        return F.concat(_json_text(key), F.lit(": "), _json_text(value))

    # A name that occurs again replaces the value and keeps its place.
    own = F.map_from_arrays(F.array(name), F.array(F.lit(MARKER)))
    dummies = F.map_from_entries(F.transform(
        F.coalesce("siblings", F.array().cast("array<struct<location:string,name:string,dummy:string>>")),
        lambda s: F.struct(F.coalesce(s["name"], F.lit("sibling")), F.coalesce(s["dummy"], F.lit("dummyVal"))),
    ))
    body = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(F.map_concat(own, dummies)), lambda e: pair(e["key"], e["value"])), ", "), F.lit("}"))
    post = F.concat(F.lit("curl -X "), method, F.lit(" "), url, header, F.lit(' -H "Content-Type: application/json" -d \''), body, F.lit("'"))
    description = F.when(http, F.concat(F.lit(f"Marker '{MARKER}' propagates into server-side sink "), F.col("sink"), F.lit("."))).otherwise(
        F.concat(F.lit("CLI / message parameter '"), F.coalesce("param_name", F.lit("arg")), F.lit("' reaches sink "), F.col("sink"))
    )
    tainted = F.struct(
        location.alias("location"), name.alias("name"), F.lit("string").alias("type"), F.lit(True).alias("is_tainted_target"), F.lit(MARKER).alias("marker_value")
    )
    others = F.transform(
        F.coalesce("siblings", F.array().cast("array<struct<location:string,name:string,dummy:string>>")),
        lambda s: F.struct(
            F.coalesce(s["location"], location).alias("location"), F.coalesce(s["name"], F.lit("param")).alias("name"), F.lit("string").alias("type"),
            F.lit(False).alias("is_tainted_target"), F.coalesce(s["dummy"], F.lit("dummyVal")).alias("marker_value"),
        ),
    )
    return rows.withColumns({
        "reproduction_type": F.when(http, "HTTP_TEMPLATE").otherwise("NON_HTTP_TEMPLATE"),
        "assertion_type": F.when(http, "PARAMETER_REACHABILITY").otherwise("CLI_PARAMETER_REACHABILITY"),
        "assertion": description,
        "parameters": F.when(http, F.concat(F.array(tainted), others)),
        "header_placeholder": F.when(http & (F.col("auth_state") == "REQUIRED"), BEARER),
        "curl_command": F.when(http, F.when((method == "GET") | (location == "QUERY"), get).otherwise(post)),
    })


def _json_text(value: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)


def severity_order(dossiers: DataFrame) -> DataFrame:
    """``dossiers`` with ``ord``, a scan's findings numbered from 1: severity as text (CRITICAL, HIGH, INFO, LOW, MEDIUM), then id.

    All findings are range-sorted once; a number is what stands in the sorted parts before, by scan, and the place inside
    the part. So a scan's findings needn't meet in one task.
    """
    order = ("scan_id", "severity", "dossier_id")
    kept = [c for c in dossiers.columns if c != "ord"]
    ordered = dossiers.select(*kept).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")), "severity-order")
    # A row for each scan in each part.
    runs = placed.groupBy(F.col("scan_id").alias("_scan"), F.col("_part").alias("_in")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_scan").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_scan", "_in", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    joined = placed.join(runs, (F.col("_part") == F.col("_in")) & F.col("scan_id").eqNullSafe(F.col("_scan")))
    return joined.select(*kept, (F.col("_before") + F.col("_place") - F.col("_first") + 1).cast("long").alias("ord"))

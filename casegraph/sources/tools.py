"""Readers for the output of external tools: rows of raw text in, canonical rows out.

The engine doesn't run tools; their output is landed and read. Broken documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.functions.text import LINE_END, strip
from casegraph.operators.classify import rule_class, tool_severity
from casegraph.sources.files import hydrate_snippet

ENDPOINT_JSON = (
    "endpoints array<struct<method:string,url:string,details:struct<file:string,line:int>,"
    "params:array<struct<name:string,`in`:string>>>>"
)
RESULT_JSON = (
    "results array<struct<check_id:string,path:string,start:struct<line:int,col:int>,"
    "extra:struct<message:string,metadata:struct<cwe:string,category:string>,severity:string,lines:string>>>"
)
SECRET_JSON = (
    "SourceMetadata struct<Data:struct<Filesystem:struct<file:string>>>, file string, DetectorName string, "
    "Verified boolean, Raw string, line int"
)


def read_endpoints(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Endpoint discovery JSON -> (http_method, route_pattern, rel_path, line_number, auth_required, parameters, tool_provenance)."""
    parsed = raw.select(F.from_json(column, ENDPOINT_JSON).alias("d")).select(F.explode("d.endpoints").alias("e"))
    return parsed.select(
        F.upper(F.coalesce("e.method", F.lit("GET"))).alias("http_method"),
        F.coalesce("e.url", F.lit("")).alias("route_pattern"),
        F.coalesce("e.details.file", F.lit("")).alias("rel_path"),
        F.coalesce("e.details.line", F.lit(1)).alias("line_number"),
        F.lit(False).alias("auth_required"),
        F.coalesce("e.params", F.array().cast("array<struct<name:string,in:string>>")).alias("parameters"),
        F.lit("Noir").alias("tool_provenance"),
    )


def read_findings(raw: DataFrame, column: str = "raw", files: DataFrame | None = None) -> DataFrame:
    """Static-analysis JSON -> rows of candidate sinks; a list of CWEs gives its first.

    With ``files`` (rel_path, text) an expression that the tool withheld is the line of the file.
    """
    parsed = raw.select(F.from_json(column, RESULT_JSON).alias("d")).select(F.explode("d.results").alias("r"))
    rule = F.coalesce("r.check_id", F.lit("unknown-rule"))
    message = F.coalesce("r.extra.message", F.lit(""))
    # A list arrives as its JSON text: take its first string.
    cwe = F.col("r.extra.metadata.cwe")
    first = F.when(F.startswith(cwe, F.lit("[")), F.get(F.from_json(cwe, "array<string>"), F.lit(0))).otherwise(cwe)
    lines = strip(F.coalesce("r.extra.lines", F.lit("")))
    found = parsed.select(
        F.coalesce("r.path", F.lit("")).alias("rel_path"),
        rule_class(rule, message).alias("vuln_class"),
        tool_severity(F.coalesce("r.extra.severity", F.lit("ERROR"))).alias("triage_severity"),
        F.coalesce("r.start.line", F.lit(1)).alias("line_number"),
        first.alias("cwe_id"),
        F.when(lines != "", lines).otherwise(message).alias("sink_expression"),
        rule.alias("raw_rule_id"),
        F.lit("Semgrep").alias("tool_provenance"),
        ((lines == "") | (F.lower(lines) == "requires login")).alias("_withheld"),
    )
    if files is None:
        return found.drop("_withheld")
    # Only files with a withheld line are read.
    texts = files.select("rel_path", F.col("text").alias("_text")).join(found.filter("_withheld").select("rel_path").distinct(), "rel_path", "left_semi")
    joined = found.join(texts, "rel_path", "left")
    hydrated = F.coalesce(hydrate_snippet(F.lit(None).cast("string"), F.col("_text"), F.col("line_number")), "sink_expression")
    return joined.withColumn("sink_expression", F.when(F.col("_withheld"), hydrated).otherwise(F.col("sink_expression"))).drop("_withheld", "_text")


def read_secrets(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Secret-scanner JSON lines -> rows; the secret itself is replaced by its hash."""
    lines = raw.select(F.explode(F.split(column, LINE_END)).alias("line")).withColumn("line", strip(F.col("line")))
    parsed = lines.filter("line <> ''").select(F.from_json("line", SECRET_JSON + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("s"))
    return parsed.filter("s is not null and s._bad is null").select(
        F.coalesce("s.SourceMetadata.Data.Filesystem.file", "s.file", F.lit("")).alias("rel_path"),
        F.coalesce("s.DetectorName", F.lit("GenericSecret")).alias("detector_name"),
        F.coalesce("s.Verified", F.lit(False)).alias("verified"),
        F.sha2(F.coalesce("s.Raw", F.lit("")), 256).alias("secret_hash"),
        F.coalesce("s.line", F.lit(1)).alias("line_number"),
        F.lit("TruffleHog").alias("tool_provenance"),
    )


@dataclass(frozen=True)
class Adapter:
    """A tool whose output can be read: its name, what its rows are, and the reader of its raw output."""

    name: str
    kind: str
    read: Callable[[DataFrame], DataFrame]


# The tools that are known from the start.
ADAPTERS: dict[str, Adapter] = {
    a.name: a
    for a in (Adapter("noir", "endpoints", read_endpoints), Adapter("semgrep", "findings", read_findings), Adapter("trufflehog", "secrets", read_secrets))
}


def register_adapter(adapter: Adapter) -> None:
    """Read another tool's output, or a known one's in another way."""
    ADAPTERS[adapter.name] = adapter


def read_tools(outputs: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
    """Rows by kind (endpoints, findings, secrets) from raw outputs by tool; a tool without output or adapter is no failure."""
    found: dict[str, DataFrame] = {}
    for name, raw in outputs.items():
        adapter = ADAPTERS.get(name)
        if adapter is not None and raw is not None:
            rows = adapter.read(raw)
            found[adapter.kind] = found[adapter.kind].unionByName(rows, allowMissingColumns=True) if adapter.kind in found else rows
    return found

"""The data model: tables, enums, defaults, evolution and constraint checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations of the data model.
DOMAINS = (
    "APPLICATION_RUNTIME", "CLIENT_SPA", "CI_CD_PIPELINE", "INFRASTRUCTURE_IAC", "TEST_MOCK", "DATA_SEED_TUTORIAL",
    "VENDOR_DEPENDENCY", "BUILD_OUTPUT_GENERATED",
)
ROLES = (
    "ROUTE_HANDLER", "MIDDLEWARE", "SERVICE_BUSINESS_LOGIC", "DATA_ACCESS_ORM", "CONFIGURATION", "UTILITY_HELPER", "UNKNOWN",
)
SYMBOL_KINDS = ("FUNCTION", "METHOD", "CLASS", "INTERFACE", "VARIABLE")
AUTH_STATES = ("REQUIRED", "NOT_REQUIRED", "UNKNOWN")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
SCAN_MODES = ("FULL", "DIFF")
SCAN_STATES = ("INITIALIZING", "INDEXING", "TRIAGING", "VERIFYING", "COMPLETED", "FAILED", "ABORTED")
VERDICTS = ("EXPLOITABLE", "LIKELY_EXPLOITABLE_PARTIAL_SANITIZATION", "INSUFFICIENT_CONTEXT", "SAFE_PROVEN")
PENDING_STATES = ("QUEUED", "UNRESOLVED", "RUNNING")
TERMINAL_STATES = ("COMPLETED", "FAILED", "ABORTED")
CRITICAL_EVENTS = ("PATH_TRANSITION", "DOSSIER_SYNTHESIZED", "CIRCUIT_BREAKER_TRIGGERED")

# Operating limits.
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_MEAN_LINE = 1000
BINARY_SNIFF_BYTES = 1024
MAX_HOPS = 20
MAX_AGENT_TURNS = 8
MAX_LINKER_TURNS = 2
MAX_GREP_ROWS = 50
MIN_REACH_CONFIDENCE = 0.60


@dataclass(frozen=True)
class Table:
    """A table: its columns, natural key, defaults, and what an upsert leaves alone."""

    name: str
    ddl: str
    key: tuple[str, ...]
    defaults: dict[str, object] = field(default_factory=dict)
    #: Columns that keep their old value when a row with the same key arrives.
    kept: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table(
            "files",
            "file_id long, rel_path string, language string, is_vendor boolean, file_hash string, loc long, execution_domain string, "
            "runtime_role string, environment string, artifact_type string, classification_confidence double, "
            "classification_evidence string, last_indexed_commit string, last_indexed_at timestamp",
            ("rel_path",),
            {
                "is_vendor": False, "execution_domain": "APPLICATION_RUNTIME", "runtime_role": "UNKNOWN",
                "environment": "PRODUCTION", "artifact_type": "UNKNOWN", "classification_confidence": 0.8,
            },
            kept=("file_id",),
            enums={"execution_domain": DOMAINS, "runtime_role": ROLES},
        ),
        Table(
            "symbols",
            "symbol_id long, file_id long, name string, kind string, start_line int, start_col int, end_line int, end_col int, "
            "signature string, scope string",
            ("file_id", "name", "kind", "start_line", "start_col"),
            kept=("symbol_id",),
            enums={"kind": SYMBOL_KINDS},
            foreign={"file_id": ("files", "file_id")},
        ),
        Table(
            "endpoints",
            "endpoint_id long, file_id long, http_method string, route_pattern string, handler_symbol_id long, line_number int, "
            "auth_state string, auth_required boolean, parameters array<struct<name:string,`in`:string>>, tool_provenance string",
            ("file_id", "http_method", "route_pattern", "line_number"),
            {"auth_state": "UNKNOWN", "auth_required": False},
            kept=("endpoint_id",),
            enums={"auth_state": AUTH_STATES},
            foreign={"file_id": ("files", "file_id"), "handler_symbol_id": ("symbols", "symbol_id")},
        ),
        Table(
            "candidate_sinks",
            "sink_id long, file_id long, symbol_id long, vuln_class string, triage_severity string, line_number int, cwe_id string, "
            "sink_expression string, raw_rule_id string, tool_provenance string",
            ("file_id", "line_number", "raw_rule_id"),
            {"triage_severity": "MEDIUM"},
            kept=("sink_id", "cwe_id", "symbol_id"),
            enums={"triage_severity": SEVERITIES},
            foreign={"file_id": ("files", "file_id")},
        ),
        Table(
            "graph_edges",
            "edge_id long, caller_symbol_id long, callee_symbol_id long, edge_type string",
            ("caller_symbol_id", "callee_symbol_id", "edge_type"),
            kept=("edge_id",),
            foreign={"caller_symbol_id": ("symbols", "symbol_id"), "callee_symbol_id": ("symbols", "symbol_id")},
        ),
        Table(
            "graph_edge_evidence",
            "evidence_id long, edge_id long, resolution_method string, confidence double, evidence map<string,string>, "
            "indexed_commit string, is_active boolean, created_at timestamp",
            (),  # evidence has no key: it is appended
            {"is_active": True},
            foreign={"edge_id": ("graph_edges", "edge_id")},
        ),
        Table(
            "vendor_signatures",
            "sig_id long, package_name string, api_name string, potential_sink_class string, signature_pattern string",
            ("package_name", "api_name"),
            kept=("sig_id",),
        ),
        Table(
            "scans",
            "scan_id string, target_path string, scan_mode string, base_commit string, target_commit string, engine_fingerprint string, "
            "status string, started_at timestamp, completed_at timestamp, config map<string,string>, stats map<string,string>",
            ("scan_id",),
            {"status": "INITIALIZING"},
            enums={"scan_mode": SCAN_MODES, "status": SCAN_STATES},
        ),
        Table(
            "scan_candidate_paths",
            "path_id string, scan_id string, endpoint_id long, sink_id long, hop_count int, call_sequence array<string>, "
            "priority_score double, reachability_confidence double, state string, retry_count int, created_at timestamp, "
            "updated_at timestamp",
            ("path_id",),
            {"reachability_confidence": 1.0, "state": "QUEUED", "retry_count": 0},
            kept=("scan_id", "endpoint_id", "sink_id", "hop_count", "call_sequence", "retry_count", "created_at"),
            foreign={"sink_id": ("candidate_sinks", "sink_id")},
        ),
        Table(
            "scan_dossiers",
            "dossier_id string, scan_id string, fingerprint_schema_version int, finding_fingerprint string, path_id string, "
            "engine_fingerprint string, title string, vuln_class string, severity string, cwe_id string, verdict string, "
            "reachability_confidence double, exploitability_confidence double, confidence double, "
            "source_trace array<struct<file:string,line:int>>, sanitizer_analysis map<string,string>, "
            "evidence_bundle map<string,string>, repro_curl_template string, mitigation_notes string, created_at timestamp",
            ("dossier_id",),
            {
                "fingerprint_schema_version": 1, "reachability_confidence": 1.0, "exploitability_confidence": 0.85, "confidence": 0.85,
            },
            kept=("scan_id", "path_id", "title", "vuln_class", "severity", "cwe_id", "finding_fingerprint", "engine_fingerprint", "fingerprint_schema_version", "created_at"),
            enums={"severity": SEVERITIES, "verdict": VERDICTS},
        ),
    )
}


def evolve(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the table's columns and types: missing ones are added with their defaults, others dropped."""
    spec = TABLES[table]
    have = {c.lower(): c for c in df.columns}
    columns = []
    for f in spec.schema.fields:
        found = F.col(have[f.name]) if f.name in have else F.lit(None)
        column = found.cast(f.dataType)
        if f.name in spec.defaults:
            column = F.coalesce(column, F.lit(spec.defaults[f.name]).cast(f.dataType))
        columns.append(column.alias(f.name))
    return df.select(*columns)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: what a UNIQUE constraint would refuse."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference names no parent row; null references are allowed."""
    keys = parent.select(F.col(parent_column).alias("_parent")).distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def outside_enum(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value a CHECK constraint would refuse."""
    return df.filter(~F.col(column).isin(*allowed))


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, constraint, n) for every constraint of the data model that the tables break."""
    found: DataFrame | None = None
    for name, df in tables.items():
        spec = TABLES[name]
        checks = [(f"enum {c}", outside_enum(df, c, allowed)) for c, allowed in spec.enums.items()]
        checks += [
            (f"foreign {c}", orphans(df, c, tables[parent], parent_column))
            for c, (parent, parent_column) in spec.foreign.items() if parent in tables
        ]
        if spec.key:
            checks.append(("unique " + ",".join(spec.key), duplicate_keys(df, list(spec.key))))
        for what, offenders in checks:
            row = offenders.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit(what).alias("constraint"), "n")
            found = row if found is None else found.unionByName(row)
    assert found is not None
    return found.filter("n > 0")

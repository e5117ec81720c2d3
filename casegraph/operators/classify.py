"""Classifiers as ordered CASE expressions: scope, rules, severities, vendor interfaces, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.text import any_of, extension, posix

# Scope rules in order; a path matches if its lower-case form contains one of the marks.
# (domain, role, environment, confidence, evidence, marks, extensions)
SCOPE_RULES = (
    ("VENDOR_DEPENDENCY", "UTILITY_HELPER", "BUILD_TIME", 1.0, "Path matches vendor dependency or bundled third-party asset",
     ("node_modules/", "vendor/", "site-packages/", "assets/private/", "three.js", ".min.js", "dat.gui"), ()),
    ("CI_CD_PIPELINE", "CONFIGURATION", "BUILD_TIME", 0.98, "Path matches CI/CD pipeline workflow directory",
     (".github/", ".gitlab-ci", "jenkinsfile", ".circleci/"), ()),
    ("INFRASTRUCTURE_IAC", "CONFIGURATION", "BUILD_TIME", 0.95, "Infrastructure definition path",
     ("dockerfile", "k8s/"), (".tf", ".hcl", ".tfvars")),
    ("TEST_MOCK", "UTILITY_HELPER", "TEST", 0.95, "Path or filename matches test specification convention",
     (".spec.", ".test.", "tests/", "__tests__/", "fixtures/"), ()),
    ("DATA_SEED_TUTORIAL", "UTILITY_HELPER", "TEST", 0.90, "Directory matches static seed or tutorial coding challenges",
     ("codefixes/", "data/static/challenges", "seeds/"), ()),
    ("CLIENT_SPA", "UTILITY_HELPER", "PRODUCTION", 0.90, "Directory path matches frontend client SPA structure",
     ("frontend/", "client/", "static/", "public/", "views/"), ()),
)
# Roles of runtime code, and the evidence texts of scope rules that depend on more than the rule.
ROLE_RULES = (
    ("ROUTE_HANDLER", ("routes/", "controllers/", "api/", "endpoints/")),
    ("MIDDLEWARE", ("middleware/", "guards/", "interceptors/")),
    ("SERVICE_BUSINESS_LOGIC", ("services/", "domain/", "usecases/")),
    ("DATA_ACCESS_ORM", ("models/", "entities/", "repositories/", "repos/")),
)
ROLE_EVIDENCE = {
    "ROUTE_HANDLER": "Directory matches web application route/controller handler",
    "MIDDLEWARE": "Directory matches middleware/guard pattern",
    "SERVICE_BUSINESS_LOGIC": "Directory matches service business logic pattern",
    "DATA_ACCESS_ORM": "Directory matches model/data-access ORM pattern",
    "UNKNOWN": "Default application runtime classification",
}
IAC_EVIDENCE = "File extension or pattern '%s' matches Infrastructure as Code"
# Classes of rules by words in their id and message.
RULE_CLASSES = (
    ("RCE", ("rce", "command", "exec", "system")),
    ("SQLI", ("sqli", "sql-injection", "sqlite")),
    ("SSRF", ("ssrf",)),
    ("PATH_TRAVERSAL", ("traversal", "path", "zip-slip")),
    ("XSS", ("xss",)),
)
# Classes of vendor interfaces by parts of their lower-case names.
API_CLASSES = (
    ("SQLI", ("query", "rawquery", "sql", "execsql")),
    ("RCE", ("exec", "spawn", "fork", "popen", "system", "command")),
    ("SSRF", ("fetch", "request", "http", "axios", "ssrf")),
    ("PATH_TRAVERSAL", ("readfile", "writefile", "unlink", "traversal")),
    ("CODE_INJECTION", ("eval", "runincontext", "compile")),
)
# What a detector may look at.
NEVER_SCANNED = ("TEST_MOCK", "VENDOR_DEPENDENCY", "BUILD_OUTPUT_GENERATED", "DATA_SEED_TUTORIAL")
PIPELINE_DETECTORS = ("SUPPLY_CHAIN_CI", "SECRETS")
INFRASTRUCTURE_DETECTORS = ("INFRASTRUCTURE_CONFIG", "SECRETS")
AUTHZ_PATHS = ("route", "controller", "server", "app")


def first_class(text: Column, table: tuple[tuple[str, tuple[str, ...]], ...], otherwise: Column) -> Column:
    out = None
    for name, marks in table:
        hit = any_of(text, marks)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(otherwise)


def classify_scope(files: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """``files`` (language, is_vendor and a path) with the six scope columns; the first rule wins."""
    path = F.lower(posix(F.col(path_col)))
    ext = extension(F.col(path_col))
    role = first_class(path, ROLE_RULES, F.lit("UNKNOWN"))
    conditions = []
    for i, (*_, marks, extensions) in enumerate(SCOPE_RULES):
        hit = any_of(path, marks)
        if extensions:
            hit = hit | ext.isin(*extensions)
        conditions.append((F.coalesce(F.col("is_vendor"), F.lit(False)) | hit) if i == 0 else hit)

    def ladder(place: int, otherwise: Column) -> Column:
        out = None
        for hit, rule in zip(conditions, SCOPE_RULES, strict=True):
            out = F.when(hit, F.lit(rule[place])) if out is None else out.when(hit, F.lit(rule[place]))
        return out.otherwise(otherwise)

    evidence = F.create_map(*[F.lit(x) for pair in ROLE_EVIDENCE.items() for x in pair])[role]
    kind = F.coalesce(F.col("language"), F.when(ext != "", F.substring(ext, 2, 100)), F.lit("unknown"))
    return files.withColumn("execution_domain", ladder(0, F.lit("APPLICATION_RUNTIME"))).withColumns(
        {
            "runtime_role": ladder(1, role),
            "environment": ladder(2, F.lit("PRODUCTION")),
            "artifact_type": F.upper(kind),
            "classification_confidence": ladder(3, F.when(role == "UNKNOWN", 0.75).otherwise(0.92)),
            "classification_evidence": F.when(
                F.col("execution_domain") == "INFRASTRUCTURE_IAC", F.format_string(IAC_EVIDENCE, ext)
            ).otherwise(ladder(4, evidence)),
        }
    )


def eligible(domain: Column, detector: Column) -> Column:
    """Whether a detector may report on a file of that domain; a null domain is allowed."""
    return F.coalesce(
        F.when(domain.isin(*NEVER_SCANNED), False)
        .when(domain == "CI_CD_PIPELINE", detector.isin(*PIPELINE_DETECTORS))
        .when(domain == "INFRASTRUCTURE_IAC", detector.isin(*INFRASTRUCTURE_DETECTORS)),
        F.lit(True),
    )


def rule_class(rule: Column, message: Column) -> Column:
    return first_class(F.lower(F.concat_ws(" ", rule, message)), RULE_CLASSES, F.lit("GENERAL_VULN"))


def tool_severity(severity: Column) -> Column:
    upper = F.upper(severity)
    return (
        F.when(upper == "ERROR", "CRITICAL").when(upper == "WARNING", "HIGH").when(upper.isin("INFO", ""), "MEDIUM").otherwise("LOW")
    )


def api_class(name: Column) -> Column:
    """The sink class of a vendor interface; null for a harmless one."""
    return first_class(F.lower(name), API_CLASSES, F.lit(None).cast("string"))


def authz_relevant(path: Column) -> Column:
    return any_of(F.lower(path), AUTHZ_PATHS)

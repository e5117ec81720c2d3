"""Pattern detection: a matrix of patterns as data, and one explode over lines.

Patterns run in the JVM. Java's ``\\b`` and ``\\w`` differ from other engines' on
letters beyond ASCII, so word ends are spelt out by the classes below.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.text import any_of, strip

#: A word starts or ends here (letters, digits and _ of any script).
START, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
CALL = r"\s*\([^)]+\)"


@dataclass(frozen=True)
class Pattern:
    family: str
    name: str
    regex: str
    severity: str | None = None
    cwe: str | None = None
    context: str | None = None
    #: Plain texts of which a line with a match holds one at least; the expression runs on such lines only.
    marks: tuple[str, ...] = ()


def _calls(*names: str) -> str:
    return START + "(?:" + "|".join(names) + ")" + CALL


# The patterns of untrusted sources.
SOURCES = tuple(
    Pattern("SOURCE", name, rf"{START}(?:req|request)\.{part}(?:\.[a-zA-Z0-9_$]+)?{END}", marks=(f".{part}",))
    for name, part in (
        ("HTTP_BODY", "body"), ("HTTP_QUERY", "query"), ("HTTP_PARAMS", "params"), ("HTTP_HEADERS", "headers"), ("HTTP_COOKIES", "cookies"),
    )
)
# The patterns of transforms.
TRANSFORMS = (
    Pattern("TRANSFORM", "PATH_CONSTRUCTION", _calls(r"path\.join", r"os\.path\.join"), marks=("path.join",)),
    Pattern("TRANSFORM", "TYPE_CONSTRAINT", _calls("parseInt", "Number", "parseFloat", "int", "float"), marks=("Int", "Number", "Float", "int", "float")),
    Pattern("TRANSFORM", "ENCODING_DECODING", _calls("decodeURIComponent", "unquote", "b64decode"), marks=("decode", "unquote")),
    Pattern("TRANSFORM", "SANITIZER", _calls("sanitize", "escapeHtml", "DOMPurify"), marks=("sanitize", "escapeHtml", "DOMPurify")),
)
# The patterns of sinks with their class, severity, weakness number and context.
SINKS = (
    Pattern("SINK", "SSRF", _calls(r"(?:needle|axios|urllib\.request|requests)\.(?:get|post|put|delete|head)", "fetch", "request"),
            "CRITICAL", "CWE-918", "HTTP_REQUEST", (".get", ".post", ".put", ".delete", ".head", "fetch", "request")),
    Pattern("SINK", "XXE", _calls(r"(?:libxmljs\.)?parseXmlString", r"xml2js\.parseString", r"etree\.fromstring"),
            "CRITICAL", "CWE-611", "XML_PARSING", ("parseXmlString", "parseString", "fromstring")),
    Pattern("SINK", "NOSQLI", START + r"(?:[a-zA-Z0-9_$]+\.)+find(?:One)?\s*\(\s*\{.*?\$(?:where|regex)", "HIGH", "CWE-943", "NOSQL_QUERY", ("find",)),
    Pattern("SINK", "SQLI", _calls(r"(?:models\.)?sequelize\.query", r"db\.raw", r"cursor\.execute"), "CRITICAL", "CWE-89", "SQL_EXECUTION", ("sequelize.query", "db.raw", "cursor.execute")),
    Pattern("SINK", "PATH_TRAVERSAL", _calls(r"res\.sendFile", r"fs\.readFile", r"fs\.readFileSync", "open"), "HIGH", "CWE-22", "FILESYSTEM_ACCESS", ("sendFile", "readFile", "open")),
    Pattern("SINK", "RCE", _calls(r"child_process\.exec", r"os\.system", r"os\.popen", r"subprocess\.(?:Popen|run|call)", "eval", r"vm\.runInContext", r"new\s+Function"),
            "CRITICAL", "CWE-78", "COMMAND_EXECUTION", ("process.exec", "os.system", "os.popen", "subprocess", "eval", "runInContext", "Function")),
    Pattern("SINK", "DESERIALIZATION", _calls(r"yaml\.load", r"pickle\.loads", "unserialize"), "HIGH", "CWE-502", "OBJECT_DESERIALIZATION", ("yaml.load", "pickle.loads", "unserialize")),
    Pattern("SINK", "XSS", rf"!=[^\n]+|\|\s*safe{END}|{START}(?:dangerouslySetInnerHTML|bypassSecurityTrustHtml|bypassSecurityTrustScript){END}",
            "HIGH", "CWE-79", "TEMPLATE_HTML_OUTPUT", ("!=", "|", "dangerouslySetInnerHTML", "bypassSecurityTrust")),
)
TEMPLATE_SUFFIXES = (".pug", ".jade", ".ejs")


def detect(lines: DataFrame, patterns: tuple[Pattern, ...], text_col: str = "text") -> DataFrame:
    """``lines`` with one row per match: family, name, severity, cwe, context, expression, ord.

    ``ord`` numbers a line's matches by pattern and place: later operators need an order of arrival.
    """
    def struct_of(place: int, p: Pattern) -> Callable[[Column, Column], Column]:
        return lambda m, j: F.struct(
            F.lit(p.family).alias("family"), F.lit(p.name).alias("name"), F.lit(p.severity).cast("string").alias("severity"),
            F.lit(p.cwe).cast("string").alias("cwe"), F.lit(p.context).cast("string").alias("context"), m.alias("expression"),
            (F.lit(place << 40) + j).cast("long").alias("ord"),
        )

    text = F.col(text_col)

    def matches(p: Pattern) -> Column:
        every = F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
        return F.when(any_of(text, p.marks), every).otherwise(F.array().cast("array<string>")) if p.marks else every

    found = [F.transform(matches(p), struct_of(i, p)) for i, p in enumerate(patterns)]
    # Lines without any mark are told apart before the arrays are built.
    bare = [p.regex for p in patterns if not p.marks]
    some = any_of(text, tuple(sorted({m for p in patterns for m in p.marks})))
    if bare:
        some = some | text.rlike("|".join(f"(?:{r})" for r in bare))
    rows = lines.filter(some).withColumn("_m", F.explode(F.concat(*found)))
    return rows.select(*lines.columns, "_m.*")


def first_argument(call: Column) -> Column:
    """What stands between the first ``(`` and the next ``,`` or ``)``; null if nothing does."""
    found = F.regexp_extract(call, r"\(\s*([^,)]+)", 1)
    return F.when(found != "", strip(found))


def _literal(argument: Column) -> Column:
    quoted = argument.rlike("^['\"]") & argument.rlike("['\"]$")
    return quoted | (F.startswith(argument, F.lit("`")) & ~F.contains(argument, F.lit("${")))


def veto_sinks(matches: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """Drop sink matches that cannot be tainted; adds ``argument``."""
    expression, name = F.col("expression"), F.col("name")
    template = F.lit(False)
    for suffix in TEMPLATE_SUFFIXES:
        template = template | F.endswith(F.col(path_col), F.lit(suffix))
    argument = F.when(name.isin("SSRF", "PATH_TRAVERSAL"), first_argument(expression))
    literal = F.coalesce(_literal(argument), F.lit(False))
    test_client = F.contains(expression, F.lit("request(app)")) | F.contains(expression, F.lit("request(server)"))
    composed = expression.rlike(r"\$\{|\+|path\.join")
    dropped = (
        (F.startswith(expression, F.lit("!=")) & ~template)
        | ((name == "SSRF") & (test_client | literal))
        | ((name == "PATH_TRAVERSAL") & literal & ~composed)
    )
    return matches.filter(~dropped).withColumn("argument", argument)


# The patterns of the authorization analysis.
OBJECT_KEY = rf"(?i){START}req\.(?:params|query|body)\.(?:[a-zA-Z0-9_$]*id|id){END}"
ROLE_GUARD = r"(?i)if\s*\([^)]*(?:req\.user\.(?:role|roles)|is_admin|isAdmin|hasRole|hasPermission)[^)]*\)"
SCOPED_QUERY = rf"(?is){START}([A-Z][a-zA-Z0-9_]*)\.(?:findOne|find|findAll|filter)\s*\(.*?{START}(?:userId|ownerid|tenantid){END}"
TENANT = rf"(?i){START}(?:tenantid|tenant_id){END}"
OWNER_GUARD = r"(?i)if\s*\([^)]*(?:userId|ownerid|tenantid)[^)]*!==?[^)]*req\.user\.id[^)]*\)"
LOOKUP = rf"(?i){START}([A-Z][a-zA-Z0-9_]*)\.(?:findByPk|findById|findOne|find|get)\s*\("
ROUTE_IDS = (":id", ":basketId", ":orderId")
NOT_MODELS = ("app", "router", "express", "req", "request", "res", "response")


def analyze_authorization(handlers: DataFrame, route_col: str = "route", code_col: str = "code") -> DataFrame:
    """``handlers`` with has_gap, gap_type, status, object_key, principal, retrieval_op, relationship."""
    code, route = F.col(code_col), F.col(route_col)
    in_code = F.regexp_extract(code, OBJECT_KEY, 0)
    in_route = F.lit(False)
    for mark in ROUTE_IDS:
        in_route = in_route | F.contains(route, F.lit(mark))
    key = F.when(in_code != "", in_code).when(in_route, F.lit("req.params.id"))
    models = F.filter(F.regexp_extract_all(code, F.lit(LOOKUP), F.lit(1)), lambda m: ~F.lower(m).isin(*NOT_MODELS))
    model = F.get(models, F.lit(0))
    scoped = F.when(code.rlike(TENANT), "TENANT").otherwise("OWNER")
    relation = (
        F.when(key.isNull(), "NONE").when(code.rlike(ROLE_GUARD), "ROLE").when(code.rlike(SCOPED_QUERY), scoped)
        .when(code.rlike(OWNER_GUARD), "OWNER").otherwise(F.when(model.isNotNull(), "GAP").otherwise("NONE"))
    )
    rows = handlers.withColumn("_r", relation)
    gap, held = F.col("_r") == "GAP", F.col("_r").isin("ROLE", "TENANT", "OWNER")
    return rows.select(
        *handlers.columns,
        gap.alias("has_gap"),
        F.when(gap, "CANDIDATE_AUTHZ_GAP").alias("gap_type"),
        F.when(gap, "MISSING_AUTHZ_PREDICATE").when(held, "AUTHZ_CONSTRAINT_PRESENT").otherwise("NO_OBJECT_KEY").alias("status"),
        F.when(gap | held, key).alias("object_key"),
        F.when(gap, "req.user.id").alias("principal"),
        F.when(gap, F.concat(model, F.lit(".lookup"))).alias("retrieval_op"),
        F.when(gap, "OWNER").otherwise(F.col("_r")).alias("relationship"),
    )


"""Stand-ins: the data model's rows made from the shared tables, in expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casegraph.queries import table

PATHS = (
    "src/app.py", "routes/user.ts", "tests/x.spec.js", "node_modules/p/index.js", ".github/workflows/ci.yml", "infra/main.tf",
    "frontend/src/a.jsx", "services/pay.java", "models/user.rb", "seeds/data.php", "middleware/auth.go", "README.md", "k8s/job.yaml",
)
CODE = (
    "const u = req.body.url; fetch(u);", "axios.get('http://fixed')", "eval(request.query.code)", "os.system(cmd)", "fs.readFile(path.join(dir, name))",
    "cursor.execute(sql)", "res.sendFile('static.html')", "// eval(x)", "parseInt(req.params.id)", "User.find({ name: { $where: x } })",
    "pickle.loads(data)", "sanitize(req.headers.host)", "request(app).get(x)", "a != b", "fetch(`$~{base}/x`)", "open('a' + name)",
)
HANDLERS = (
    "Basket.findByPk(req.params.id)", "Basket.findOne({ where: { id: req.params.id, userId: u } })", "if (req.user.role == 1) { x(req.query.orderId) }",
    "Order.find({ tenantid: t, id: req.body.id })", "res.send(1)", "const b = get(req.params.id); if (b.userId !== req.user.id) { deny() }",
    "router.get('/x', req.query.id)",
)


def _choose(values: tuple[str, ...], column: str) -> str:
    quoted = [v.replace("'", "''") for v in values]
    return "CASE " + " ".join(f"WHEN {column} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


def _spark(sql: str) -> str:
    """Spark reads backslashes in literals as escapes, and quotes by a backslash."""
    return sql.replace("\\", "\\\\").replace("''", "\\'")


PATH_SQL = f"concat('p', CAST(doc_id % 7 AS VARCHAR(9)), '/', {_choose(PATHS, 'doc_id')})"
#: The tilde keeps Spark from reading a variable in the literal.
CODE_SQL = f"replace({_choose(CODE, 'o_orderkey')}, '$~', '$')"
HANDLER_SQL = _choose(HANDLERS, "o_orderkey")
SEVERITY_SQL = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'OTHER' END"
)
#: Cross-type hashing: integers as long, floating point as double on both sides.
FILES_SQL = f"SELECT doc_id, {PATH_SQL} AS rel_path, text FROM documents"
CODE_LINES_SQL = f"SELECT o_orderkey AS line, concat('f', CAST(o_orderkey % 5 AS VARCHAR(9)), CASE WHEN o_orderkey % 3 = 0 THEN '.pug' ELSE '.js' END) AS rel_path, {CODE_SQL} AS text FROM orders"
HANDLERS_SQL = f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '/x/:id' ELSE '/x' END AS route, {HANDLER_SQL} AS code FROM orders"


def spark_sql(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """One of the statements above over a table, without touching the session's catalogue."""
    body = _spark(sql.split(" FROM ")[0].removeprefix("SELECT "))
    return table(spark, sf_dir, name).selectExpr(*_columns(body))


def _columns(body: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, quoted, current = [], 0, False, ""
    previous = ""
    for char in body:
        if char == "'" and previous != "\\":
            quoted = not quoted
        if not quoted:
            depth += (char == "(") - (char == ")")
        if char == "," and depth == 0 and not quoted:
            out.append(current)
            current = ""
        else:
            current += char
        previous = char
    return [*out, current]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, "documents", FILES_SQL)


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, "orders", CODE_LINES_SQL)


def handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, "orders", HANDLERS_SQL)

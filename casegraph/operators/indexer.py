"""Code index: symbols, imports and calls per file, and calls linked to symbols of the same file.

Parsing is the one thing here that needs Python on the executors: the standard
parser for Python files, a brace-and-token scanner for script languages, and one
by small grammars for Go, Java, PHP and Ruby. A file that cannot be parsed gives
no rows and stops nothing.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.functions.text import last_segment

SYMBOL = "struct<name:string,kind:string,start_line:int,start_col:int,end_line:int,end_col:int,signature:string,scope:string>"
IMPORT = "struct<imported_name:string,module_source:string,alias:string,line:int>"
CALL = "struct<callee_name:string,line:int,col:int,caller_scope:string>"
FUNCTION_SIGNATURE, CLASS_SIGNATURE = 200, 100


@dataclass
class Index:
    symbols: list[tuple] = field(default_factory=list)
    imports: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)


class _PythonVisitor(ast.NodeVisitor):
    def __init__(self, source: str):
        # The parser ends lines at these only.
        self.lines, self.out, self.scope, self.in_class = re.split("\r\n|[\n\r]", source), Index(), ["global"], [False]

    def _define(self, node: ast.AST, kind: str, limit: int) -> None:
        # Columns count bytes; the signature is what the definition's first line holds of it.
        line = self.lines[node.lineno - 1].encode()
        end = node.end_col_offset if node.end_lineno == node.lineno else len(line)
        signature = line[node.col_offset : end].decode(errors="replace")[:limit]
        self.out.symbols.append((node.name, kind, node.lineno, node.col_offset, node.end_lineno, node.end_col_offset, signature, ".".join(self.scope)))
        self.scope.append(node.name)
        self.in_class.append(kind == "CLASS")
        self.generic_visit(node)
        self.scope.pop()
        self.in_class.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._define(node, "METHOD" if self.in_class[-1] else "FUNCTION", FUNCTION_SIGNATURE)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "CLASS", CLASS_SIGNATURE)

    def visit_Import(self, node: ast.Import) -> None:
        self.out.imports += [(a.name, None, a.asname, node.lineno) for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.out.imports += [(a.name, "." * node.level + (node.module or ""), a.asname, node.lineno) for a in node.names]

    def visit_Call(self, node: ast.Call) -> None:
        self.out.calls.append((ast.unparse(node.func), node.lineno, node.col_offset, ".".join(self.scope)))
        self.generic_visit(node)


def index_python(source: str) -> Index:
    visitor = _PythonVisitor(source)
    visitor.visit(ast.parse(source))
    return visitor.out


_SCRIPT = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"
    r"|\bclass\s+(?P<cls>[A-Za-z_$][\w$]*)[^{;]*(?P<cls_open>\{)"
    r"|\bfunction\s*\*?\s*(?P<fn>[A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::\s*[^{;=]+)?(?P<fn_open>\{)"
    r"|\b(?:const|let|var)\s+(?P<arrow>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>\s*(?P<arrow_open>\{)"
    r"|\bimport\s+(?P<imp>[^;'\"]*?)\s*from\s*['\"](?P<src>[^'\"]+)['\"]"
    r"|(?P<call>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\((?P<args>[^()]*\)\s*(?P<method_open>\{))?"
    r"|(?P<open>\{)|(?P<close>\})",
    re.DOTALL,
)
_MODULE = re.compile(r"\s*['\"]([^'\"]+)['\"]")
_NOT_CALLS = frozenset("if for while switch catch return function typeof new await super constructor".split())


def index_script(source: str) -> Index:
    """A scanner that follows braces: functions, classes, methods, imports, calls and their scopes."""
    out, scopes, open_symbols = Index(), ["global"], []
    starts = [0] + [m.end() for m in re.finditer("\n", source)]

    def where(offset: int) -> tuple[int, int]:
        low, high = 0, len(starts)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if starts[middle] <= offset else (low, middle)
        return low + 1, offset - starts[low]

    def define(name: str, kind: str, start: int, brace: int, limit: int) -> None:
        line, col = where(start)
        signature = source[start:brace].strip()[:limit]
        open_symbols.append((len(out.symbols), name))
        out.symbols.append((name, kind, line, col, line, col, signature, ".".join(scopes)))
        scopes.append(name)

    in_class = [False]
    at = 0
    while (hit := _SCRIPT.search(source, at)) is not None:
        at = hit.end()
        if hit["skip"]:
            continue
        if hit["cls"]:
            define(hit["cls"], "CLASS", hit.start(), hit.start("cls_open"), CLASS_SIGNATURE)
            in_class.append(True)
        elif hit["fn"]:
            define(hit["fn"], "FUNCTION", hit.start(), hit.start("fn_open"), FUNCTION_SIGNATURE)
            in_class.append(False)
        elif hit["arrow"]:
            define(hit["arrow"], "FUNCTION", hit.start(), hit.start("arrow_open"), FUNCTION_SIGNATURE)
            in_class.append(False)
        elif hit["src"]:
            line = where(hit.start())[0]
            for name in re.findall(r"[A-Za-z_$][\w$]*(?:\s+as\s+[A-Za-z_$][\w$]*)?|\*\s+as\s+[A-Za-z_$][\w$]*", hit["imp"]):
                imported, _, alias = name.partition(" as ")
                out.imports.append((imported.strip(), hit["src"], alias.strip() or None, line))
        elif hit["call"]:
            name = hit["call"]
            if hit["method_open"] and in_class[-1] and "." not in name and name not in _NOT_CALLS - {"constructor"}:
                define(name, "METHOD", hit.start(), hit.start("method_open"), FUNCTION_SIGNATURE)
                in_class.append(False)
                continue
            at = source.index("(", hit.end("call")) + 1
            if name not in _NOT_CALLS:
                out.calls.append((name, *where(hit.start()), ".".join(scopes)))
                if name == "require" and (module := _MODULE.match(source, at)):
                    out.imports.append((module[1], module[1], None, where(hit.start())[0]))
        elif hit["open"]:
            open_symbols.append((-1, ""))
            in_class.append(in_class[-1] and False)
        elif open_symbols:
            number, _ = open_symbols.pop()
            in_class.pop()
            if number >= 0:
                scopes.pop()
                name, kind, line, col, *_, signature, scope = out.symbols[number]
                end_line, end_col = where(hit.end() - 1)
                out.symbols[number] = (name, kind, line, col, end_line, end_col + 1, signature, scope)
    return out


@dataclass(frozen=True)
class Grammar:
    """What a scanner of one language knows: patterns of what is skipped and of what defines a symbol, and whether calls count."""

    skip: str
    functions: str = r"(?!)"
    classes: str = r"(?!)"
    calls: bool = True
    not_calls: frozenset[str] = frozenset()
    #: Signs that open and close a body.
    body: tuple[str, str] = (r"\{", r"\}")


_NAME, _C_COMMENTS = r"[A-Za-z_$][\w$]*", r"//[^\n]*|/\*.*?\*/"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
#: Go has functions and calls, Java classes, PHP functions and classes, Ruby calls: what an index of these languages holds.
GRAMMARS = {
    "go": Grammar(
        f"{_C_COMMENTS}|{_QUOTED}|`[^`]*`", functions=rf"\bfunc\s+(?P<fn>{_NAME})\s*(?:\[[^\]]*\])?\s*\(",
        not_calls=frozenset("func if for switch select return go defer range type var const import".split()),
    ),
    "java": Grammar(rf"{_C_COMMENTS}|\"\"\".*?\"\"\"|{_QUOTED}", classes=rf"\bclass\s+(?P<cls>{_NAME})", calls=False),
    "php": Grammar(
        rf"{_C_COMMENTS}|#(?!\[)[^\n]*|{_QUOTED}", functions=rf"\bfunction\s+&?\s*(?P<fn>{_NAME})\s*\(", classes=rf"\bclass\s+(?P<cls>{_NAME})", calls=False,
    ),
    "ruby": Grammar(
        rf"\#[^\n]*|^=begin\b.*?^=end\b|{_QUOTED}", body=(r"(?!)", r"(?!)"),
        not_calls=frozenset("if unless while until elsif return and or not def class module puts yield super when case".split()) - {"puts"},
    ),
}


def index_by_grammar(source: str, grammar: Grammar) -> Index:
    """A scanner that follows braces, by a language's grammar: top-level functions, classes, calls and their scopes."""
    out, scopes, bodies, waiting = Index(), ["global"], [], None
    starts = [0] + [m.end() for m in re.finditer("\n", source)]
    opened, closed = grammar.body
    call = rf"(?P<call>{_NAME}[!?]?(?:\s*(?:\.|&\.|::)\s*{_NAME}[!?]?)*)\s*\(" if grammar.calls else r"(?P<call>(?!))"
    token = re.compile(rf"(?P<skip>{grammar.skip})|{grammar.classes}|{grammar.functions}|{call}|(?P<open>{opened})|(?P<close>{closed})", re.DOTALL | re.MULTILINE)
    groups = token.groupindex

    def where(offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(starts, offset)
        return line, offset - starts[line - 1]

    at = 0
    while (hit := token.search(source, at)) is not None:
        at = max(hit.end(), at + 1)
        name = next((hit[g] for g in ("cls", "fn") if g in groups and hit[g]), None)
        if hit["skip"]:
            continue
        if name:
            kind = "CLASS" if "cls" in groups and hit["cls"] else "FUNCTION"
            # PHP's methods aren't functions; what stands in a class body is left to its class.
            if kind == "FUNCTION" and any(b is not None and out.symbols[b][1] == "CLASS" for b in bodies):
                waiting = None
                continue
            line, col = where(hit.start())
            limit = CLASS_SIGNATURE if kind == "CLASS" else FUNCTION_SIGNATURE
            out.symbols.append((name, kind, line, col, line, col, source[hit.start() : hit.start() + limit].strip(), ".".join(scopes)))
            waiting = len(out.symbols) - 1
        elif hit["call"]:
            called = re.sub(r"\s+", "", hit["call"])
            if called not in grammar.not_calls:
                out.calls.append((called, *where(hit.start()), ".".join(scopes)))
        elif hit["open"]:
            bodies.append(waiting)
            if waiting is not None:
                scopes.append(out.symbols[waiting][0])
            waiting = None
        elif bodies:
            number = bodies.pop()
            if number is not None:
                scopes.pop()
                end_line, end_col = where(hit.end() - 1)
                out.symbols[number] = (*out.symbols[number][:4], end_line, end_col + 1, *out.symbols[number][6:])
    return out


def _by_grammar(grammar: Grammar) -> Callable[[str], Index]:
    return lambda source: index_by_grammar(source, grammar)


PARSERS: dict[str, Callable[[str], Index]] = {
    "python": index_python, "javascript": index_script, "typescript": index_script, **{name: _by_grammar(g) for name, g in GRAMMARS.items()},
}


def index_source(source: str | None, language: str | None) -> Index:
    """Unknown languages and broken code give an empty index."""
    parser = PARSERS.get(language or "")
    if parser is None or not source:
        return Index()
    try:
        return parser(source)
    except (SyntaxError, ValueError, RecursionError):
        return Index()


def index_files(files: DataFrame) -> DataFrame:
    """(rel_path, symbols, imports, calls) for files (rel_path, language, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [index_source(t, lang) for t, lang in zip(batch["text"], batch["language"], strict=True)]
            names = {
                "symbols": ("name", "kind", "start_line", "start_col", "end_line", "end_col", "signature", "scope"),
                "imports": ("imported_name", "module_source", "alias", "line"),
                "calls": ("callee_name", "line", "col", "caller_scope"),
            }
            out = {"rel_path": batch["rel_path"]}
            for part, columns in names.items():
                out[part] = [[dict(zip(columns, row, strict=True)) for row in getattr(index, part)] for index in found]
            yield pd.DataFrame(out)

    schema = f"rel_path string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, calls array<{CALL}>"
    return files.select("rel_path", "language", "text").mapInPandas(run, schema)


def symbols_of(index: DataFrame) -> DataFrame:
    return index.select("rel_path", F.posexplode("symbols").alias("seq", "s")).select("rel_path", "seq", "s.*")


def calls_of(index: DataFrame) -> DataFrame:
    return index.select("rel_path", F.posexplode("calls").alias("seq", "c")).select("rel_path", "seq", "c.*")


def link_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_symbol_id, callee_symbol_id) of calls whose two names are symbols of the same file.

    ``calls`` (file_id, caller_scope, callee_name), ``symbols`` (file_id, name, symbol_id, seq): the last
    definition of a name counts; calls of itself are dropped.
    """
    names = symbols.groupBy("file_id", "name").agg(F.max_by("symbol_id", "seq").alias("symbol_id"))
    callers = names.select("file_id", F.col("name").alias("caller_name"), F.col("symbol_id").alias("caller_symbol_id"))
    callees = names.select("file_id", F.col("name").alias("callee_name"), F.col("symbol_id").alias("callee_symbol_id"))
    rows = calls.withColumn("caller_name", last_segment(F.col("caller_scope")))
    linked = rows.join(callers, ["file_id", "caller_name"]).join(callees, ["file_id", "callee_name"])
    return linked.filter("caller_symbol_id <> callee_symbol_id").select("caller_symbol_id", "callee_symbol_id").distinct()

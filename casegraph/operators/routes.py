"""Routes of web applications, the framework in use, and interfaces of vendor packages."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.text import basename, extension, let, stem, strip
from casegraph.operators.classify import api_class
from casegraph.scratch import materialize

# The patterns of route definitions.
MOUNT = r"app\.use\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*([a-zA-Z0-9_$]+)\s*\)"
GLOBAL_MIDDLEWARE = r"app\.use\s*\(\s*([a-zA-Z0-9_$]+)\s*\)"
IMPORT = r"(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
ROUTE = r"(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]\s*,([^)]+)\)"
CHAIN = r"(?:app|router)\.route\s*\(\s*['\"]([^'\"]+)['\"]\s*\)((?:\s*\.(?:get|post|put|delete|patch)\s*\([^)]+\))+)"
CHAINED_CALL = r"\.(get|post|put|delete|patch)\s*\(([^)]+)\)"
AUTH_WORDS = ("auth", "jwt", "passport", "login", "authenticated", "session")
SKIPPED_PARTS = ("node_modules", ".git", ".venv", "dist")
# Names looked for in manifests, in order.
PACKAGE_FRAMEWORKS = (("express", "express"), ("@nestjs/core", "nestjs"), ("fastify", "fastify"), ("koa", "koa"))
LOCK_FRAMEWORKS = (("express", "express"), ("fastify", "fastify"), ("@nestjs/core", "nestjs"))
PYTHON_FRAMEWORKS = (("fastapi", "fastapi"), ("django", "django"), ("flask", "flask"))
NODE_LOCKS = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock")
PYTHON_MANIFESTS = ("requirements.txt", "poetry.lock", "pyproject.toml", "Pipfile")
EXPRESS_IMPORTS = ("require('express')", 'from "express"', "express()")
# The patterns of exported names.
SCRIPT_EXPORT = r"(?:exports\.|export\s+(?:function|const|let|var)\s+|module\.exports\s*=\s*\{[^}]*?)(\b[a-zA-Z0-9_$]+\b)"
PYTHON_DEF = r"def\s+([a-zA-Z0-9_]+)\s*\("


def matches_with_lines(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<g1..gn, line, whole, ord>> of a pattern's matches, with the line each starts in.

    Matches are cut out one by one: the text before the k-th is what split() leaves of the text.
    """

    def body(t: Column) -> Column:
        whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        parts = [F.regexp_extract_all(t, F.lit(pattern), F.lit(k)) for k in range(1, groups + 1)]
        gaps = F.transform(F.split(t, pattern, -1), _breaks)
        own = F.transform(whole, _breaks)
        # Line breaks before match k: those of gaps 0..k and of matches 0..k-1.
        start = F.struct(F.lit(0).alias("seen"), F.array().cast("array<int>").alias("lines"))

        def step(state: Column, pair: Column) -> Column:
            here = state["seen"] + pair["gap"]
            return F.struct((here + pair["own"]).alias("seen"), F.concat(state["lines"], F.array(here + 1)).alias("lines"))

        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), own, lambda g, o: F.struct(g.alias("gap"), o.alias("own")))
        lines = F.aggregate(pairs, start, step, lambda s: s["lines"])
        named = F.arrays_zip(*[p.alias(f"g{k}") for k, p in enumerate(parts, 1)], whole.alias("whole"), lines.alias("line"))
        fields = [*[f"g{k}" for k in range(1, groups + 1)], "whole", "line"]
        return F.transform(named, lambda x, i: F.struct(*[x[f].alias(f) for f in fields], i.alias("ord")))

    return let(text, body)


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _arguments(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda a: a != "")


def auth_state(middleware: Column) -> Column:
    """NOT_REQUIRED without middleware, REQUIRED if a name speaks of authentication, else UNKNOWN."""
    guarded = F.exists(middleware, lambda m: F.lower(m).rlike("|".join(AUTH_WORDS)))
    return F.when(F.size(middleware) == 0, "NOT_REQUIRED").when(guarded, "REQUIRED").otherwise("UNKNOWN")


def compose_path(prefix: Column, sub: Column) -> Column:
    path = F.concat(prefix, F.lit("/"), F.regexp_replace(sub, "^/+", ""))
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def script_files(files: DataFrame) -> DataFrame:
    skipped = F.arrays_overlap(F.split("rel_path", "/"), F.array(*[F.lit(p) for p in SKIPPED_PARTS]))
    return files.filter(F.regexp_extract(basename(F.col("rel_path")), r"^.+(\.[^.]+)$", 1).isin(".js", ".ts") & ~skipped)


def mount_prefixes(files: DataFrame) -> DataFrame:
    """(import_key, prefix, ord): where routers are mounted; the last definition of a name wins."""
    scripts = files.select("rel_path", "text")

    def pairs(pattern: str, a: str, b: str) -> DataFrame:
        found = scripts.select("rel_path", F.posexplode(matches_with_lines(F.col("text"), pattern, 2)).alias("k", "m"))
        seq = F.struct("rel_path", "k")
        return found.select(F.col(f"m.{a}").alias("name"), F.col(f"m.{b}").alias("value"), seq.alias("seq"))

    imports = pairs(IMPORT, "g1", "g2").groupBy("name").agg(F.max_by("value", "seq").alias("target"))
    mounts = pairs(MOUNT, "g2", "g1").groupBy("name").agg(F.max_by("value", "seq").alias("prefix"), F.min("seq").alias("ord"))
    key = F.replace(F.regexp_replace("target", "^[./]+", ""), F.lit("\\"), F.lit("/"))
    joined = mounts.join(imports, "name").select(key.alias("import_key"), F.regexp_replace("prefix", "/+$", "").alias("prefix"), "ord")
    return joined.groupBy("import_key").agg(F.max_by("prefix", "ord").alias("prefix"), F.min("ord").alias("ord"))


def _substrings(text: Column, lengths: Column) -> Column:
    """All distinct parts of a text that have one of the lengths."""
    def of_length(k: Column) -> Column:
        last = F.length(text) - k + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


#: Up to so many mounts are held against each path where it stands.
FEW_MOUNTS = 200


def mount_of(files: DataFrame, mounts: DataFrame, few: int = FEW_MOUNTS) -> DataFrame:
    """(rel_path, prefix) of files (rel_path) that a mount (import_key, prefix, ord) fits; the first one by ``ord`` wins.

    A mount fits if its key is part of the path, or holds the path's stem. Up to ``few`` mounts are one constant, and a path
    is looked up in it without a join. More of them don't need a join of all with all either: paths are cut into their
    parts of the keys' lengths and keys into their parts of the stems' lengths, and the parts are joined by
    equality. Lengths are few, as names are short.
    """
    first = mounts.groupBy("import_key").agg(F.min_by("prefix", "ord").alias("prefix"), F.min("ord").alias("ord"))
    known = first.orderBy("ord", "import_key").limit(few + 1).collect()
    if len(known) <= few:
        listed = json.dumps([{"k": r["import_key"], "p": r["prefix"]} for r in known])
        constant = F.from_json(F.lit(listed), "array<struct<k:string,p:string>>")
        path = F.col("rel_path")
        fits = F.filter(constant, lambda m: F.contains(path, m["k"]) | F.contains(m["k"], stem(path)))
        return files.select("rel_path", F.get(fits, F.lit(0)).alias("m")).filter("m is not null").select("rel_path", F.col("m.p").alias("prefix")).distinct()
    names = files.select("rel_path", stem(F.col("rel_path")).alias("stem"))
    stems = names.select("stem").distinct()

    def lengths(df: DataFrame, column: str) -> Column:
        found = [r[0] for r in df.select(F.length(column)).distinct().collect() if r[0] is not None]
        return F.array(*[F.lit(n) for n in sorted(found)]).cast("array<int>")

    inside = names.select("rel_path", F.explode(_substrings(F.col("rel_path"), lengths(first, "import_key"))).alias("import_key")).join(first, "import_key")
    parts = first.select("prefix", "ord", F.explode(_substrings(F.col("import_key"), lengths(stems, "stem"))).alias("stem"))
    by_stem = parts.join(stems, "stem").groupBy("stem").agg(F.min_by("prefix", "ord").alias("prefix"), F.min("ord").alias("ord"))
    around = names.join(by_stem, "stem").select("rel_path", "prefix", "ord")
    return inside.select("rel_path", "prefix", "ord").unionByName(around).groupBy("rel_path").agg(F.min_by("prefix", "ord").alias("prefix"))


def resolve_routes(files: DataFrame) -> DataFrame:
    """Endpoints of script files: (http_method, route_pattern, rel_path, line_number, handler_symbol, middleware, auth_state).

    Global middleware stands before every route's own; it is one row with the names in order, as each result holds them.
    """
    scripts = script_files(files).select("rel_path", "text")
    shared = scripts.select("rel_path", F.posexplode(F.regexp_extract_all("text", F.lit(GLOBAL_MIDDLEWARE), F.lit(1))).alias("k", "m"))
    shared = shared.filter("m <> 'express'").agg(F.transform(F.array_sort(F.collect_list(F.struct("rel_path", "k", "m"))), lambda x: x["m"]).alias("shared"))
    prefixed = mount_of(scripts, materialize(mount_prefixes(scripts), "mounts"))

    direct = scripts.select("rel_path", F.explode(matches_with_lines(F.col("text"), ROUTE, 3)).alias("m")).select(
        "rel_path", F.lit(0).alias("kind"), F.col("m.ord").alias("ord"), F.lit(0).alias("sub"),
        F.col("m.g1").alias("verb"), F.col("m.g2").alias("path"), F.col("m.g3").alias("args"), F.col("m.line").alias("line_number"),
    )
    chains = scripts.select("rel_path", F.explode(matches_with_lines(F.col("text"), CHAIN, 2)).alias("c"))
    calls = chains.select("rel_path", "c", F.posexplode(matches_with_lines(F.col("c.g2"), CHAINED_CALL, 2)).alias("sub", "m")).select(
        "rel_path", F.lit(1).alias("kind"), F.col("c.ord").alias("ord"), "sub",
        F.col("m.g1").alias("verb"), F.col("c.g1").alias("path"), F.col("m.g2").alias("args"), F.col("c.line").alias("line_number"),
    )
    found = direct.unionByName(calls).join(prefixed, "rel_path", "left").crossJoin(F.broadcast(shared))
    args = _arguments(F.col("args"))
    rows = found.withColumn("_a", args).withColumn(
        "middleware", F.concat("shared", F.when(F.size("_a") > 1, F.slice("_a", F.lit(1), F.size("_a") - 1)).otherwise(F.array().cast("array<string>")))
    )
    return rows.select(
        F.upper("verb").alias("http_method"),
        compose_path(F.coalesce("prefix", F.lit("")), F.col("path")).alias("route_pattern"),
        "rel_path",
        F.col("line_number").cast("int").alias("line_number"),
        F.when(F.size("_a") > 0, F.element_at("_a", -1)).alias("handler_symbol"),
        "middleware",
        auth_state(F.col("middleware")).alias("auth_state"),
        F.struct("kind", "ord", "sub").alias("seq"),
    )


def _named(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    out = None
    for mark, name in table:
        hit = F.contains(text, F.lit(mark))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def identify_framework(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (framework): the first hit in manifests, lockfiles, Python manifests, then imports; null if none.

    ``by``: a row for each value of these columns (repositories, say), beside them.
    """
    names = F.map_keys(
        F.map_concat(
            F.coalesce(F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,string>"), F.create_map().cast("map<string,string>")),
            F.coalesce(F.from_json(F.get_json_object("text", "$.devDependencies"), "map<string,string>"), F.create_map().cast("map<string,string>")),
        )
    )
    package = None
    for mark, name in PACKAGE_FRAMEWORKS:
        hit = F.array_contains(names, mark)
        package = F.when(hit, F.lit(name)) if package is None else package.when(hit, F.lit(name))
    lower = F.lower("text")
    ladder = [("package.json", package)]
    ladder += [(f, _named(lower, LOCK_FRAMEWORKS)) for f in NODE_LOCKS]
    ladder += [(f, _named(lower, PYTHON_FRAMEWORKS)) for f in PYTHON_MANIFESTS]
    picks = [F.max(F.when(F.col("rel_path") == name, hit)).alias(f"p{i}") for i, (name, hit) in enumerate(ladder)]
    parts = F.split("rel_path", "/")
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(p) for p in (".git", "node_modules", ".venv")]))
    imports = F.lit(False)
    for mark in EXPRESS_IMPORTS:
        imports = imports | F.contains("text", F.lit(mark))
    picks.append(F.max(F.when(extension(F.col("rel_path")).isin(".js", ".ts") & ~skipped & imports, F.lit("express"))).alias("last"))
    found = files.groupBy(*by).agg(*picks)
    return found.select(*by, F.coalesce(*[F.col(c) for c in found.columns if c not in by]).alias("framework"))


def harvest_vendor(files: DataFrame, root: str = "node_modules") -> DataFrame:
    """(package_name, api_name, potential_sink_class, signature_pattern) of dangerous exports.

    Only a package's own entry files are read: index.js, main.js, index.ts, __init__.py, <package>.py.
    """
    below = F.regexp_replace("rel_path", f"^(?:.*/)?{root}/", "")
    package = F.regexp_extract(below, r"^(@[^/]+/[^/]+|[^@/][^/]*)/[^/]+$", 1)
    entry = basename(F.col("rel_path"))
    own = F.concat(F.substring_index("package_name", "/", -1), F.lit(".py"))
    rows = files.filter(F.col("rel_path").rlike(f"(^|/){root}/")).withColumn("package_name", package)
    rows = rows.filter((F.col("package_name") != "") & (entry.isin("index.js", "main.js", "index.ts", "__init__.py") | (entry == own)))
    python = F.endswith("rel_path", F.lit(".py"))
    found = [
        rows.filter(python if p == PYTHON_DEF else ~python).select(
            "package_name", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)), F.regexp_extract_all("text", F.lit(p), F.lit(0)))).alias("m")
        )
        for p in (SCRIPT_EXPORT, PYTHON_DEF)
    ]
    named = found[0].unionByName(found[1]).select("package_name", F.col("m.0").alias("api_name"), strip(F.col("m.1")).alias("signature_pattern"))
    return named.withColumn("potential_sink_class", api_class(F.col("api_name"))).filter("potential_sink_class is not null")


#: Resolvers of endpoints by framework: files (rel_path, text) in, rows of ``resolve_routes`` out.
RESOLVERS: dict[str, Callable[[DataFrame], DataFrame]] = {"express": resolve_routes}


def register_resolver(framework: str, resolver: Callable[[DataFrame], DataFrame]) -> None:
    """Resolve the endpoints of another framework, or of a known one in another way."""
    RESOLVERS[framework] = resolver

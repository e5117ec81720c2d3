"""Scores, fingerprints and levels."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegraph.functions.text import strip

# Weights of the priority score.
SEVERITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2, "INFO": 0.05}
OTHER_SEVERITY = 0.1
EXPOSURE = {"NOT_REQUIRED": 1.5, "UNKNOWN": 1.1, "REQUIRED": 1.0}
DOMAIN_WEIGHTS = {
    "APPLICATION_RUNTIME": 1.0, "CLIENT_SPA": 0.8, "CI_CD_PIPELINE": 0.6, "INFRASTRUCTURE_IAC": 0.5, "TEST_MOCK": 0.1,
    "DATA_SEED_TUTORIAL": 0.05, "VENDOR_DEPENDENCY": 0.01, "BUILD_OUTPUT_GENERATED": 0.01,
}
# The engine's identity in fingerprints.
ENGINE_VERSION = "0.2.0"
RESOLVER_VERSION = "0.2.0"
FINGERPRINT_SCHEMA = 1
LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "Pipfile.lock")


def lookup(value: Column, table: Mapping[str, float], otherwise: Column) -> Column:
    out = None
    for key, weight in table.items():
        out = F.when(value == key, F.lit(weight)) if out is None else out.when(value == key, F.lit(weight))
    return out.otherwise(otherwise)


def priority_score(
    severity: Column, reach: Column, hops: Column, auth_state: Column, unauthenticated: Column, domain: Column
) -> Column:
    """severity x reachability x exposure x scope, damped by the square root of the hops."""
    exposure = lookup(auth_state, EXPOSURE, F.when(F.coalesce(unauthenticated, F.lit(True)), 1.5).otherwise(1.0))
    damping = F.greatest(F.lit(1.0), F.sqrt(F.greatest(F.lit(1), hops).cast("double")))
    scope = lookup(F.upper(F.coalesce(domain, F.lit("APPLICATION_RUNTIME"))), DOMAIN_WEIGHTS, F.lit(1.0))
    return lookup(F.upper(severity), SEVERITY_WEIGHTS, F.lit(OTHER_SEVERITY)) * reach * exposure * scope / damping


def scan_priority(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), 0.9).otherwise(0.5)


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").otherwise("warning")


def finding_fingerprint(
    vuln_class: Column, endpoint: Column, source: Column, sink: Column, path: Column, version: int = FINGERPRINT_SCHEMA
) -> Column:
    """sha256 of the finding's identity; the line after ``file:`` is left out, so it outlives line churn."""
    file = F.when(F.contains(path, F.lit(":")) & ~F.startswith(path, F.lit("http")), F.substring_index(path, ":", 1)).otherwise(path)
    parts = [F.upper(strip(vuln_class)), strip(endpoint), strip(source), strip(sink), strip(file)]
    return F.sha2(F.concat_ws("|", F.lit(f"v{version}"), *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def engine_fingerprint(config: Mapping[str, object], lockfile: bytes | None = None) -> str:
    """sha256 of the engine's versions, the lockfile's hash and the configuration; one value per scan."""
    identity = {
        "engine_version": ENGINE_VERSION,
        "schema_version": FINGERPRINT_SCHEMA,
        "resolver_version": RESOLVER_VERSION,
        "lockfile_hash": hashlib.sha256(lockfile).hexdigest() if lockfile is not None else "none",
    }
    return hashlib.sha256(json.dumps({**identity, **config}, sort_keys=True).encode()).hexdigest()


def engine_fingerprints(config: Column, lockfile: Column) -> Column:
    """``engine_fingerprint`` of every row: ``config`` is a map of texts, ``lockfile`` text or bytes, null if there is none."""
    def text(value: Column) -> Column:
        """A JSON string with letters beyond ASCII spelt by their code units, as ``json.dumps`` writes it."""
        plain = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        units = F.regexp_extract_all(F.hex(F.encode(plain, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
        spelt = F.transform(units, lambda u: F.when(u < "0080", F.decode(F.unhex(F.substring(u, 3, 2)), "UTF-8")).otherwise(F.concat(F.lit("\\u"), F.lower(u))))
        return F.when(plain.rlike(r"[^\x00-\x7F]"), F.array_join(spelt, "")).otherwise(plain)

    lock = F.when(lockfile.isNull(), "none").otherwise(F.sha2(lockfile.cast("binary"), 256))
    identity = F.create_map(
        F.lit("engine_version"), F.lit(ENGINE_VERSION), F.lit("resolver_version"), F.lit(RESOLVER_VERSION), F.lit("lockfile_hash"), lock,
        F.lit("schema_version"), F.lit(str(FINGERPRINT_SCHEMA)),
    )
    # A given value replaces the engine's own; the schema's version is a number where it is the engine's.
    whole = F.map_concat(F.map_filter(identity, lambda k, v: ~F.array_contains(F.map_keys(config), k)), config)
    number = ~F.array_contains(F.map_keys(config), "schema_version")
    pairs = F.transform(F.array_sort(F.map_entries(whole)), lambda e: F.concat(
        text(e["key"]), F.lit(": "), F.when(number & (e["key"] == "schema_version"), e["value"]).otherwise(text(e["value"]))
    ))
    return F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), 256)

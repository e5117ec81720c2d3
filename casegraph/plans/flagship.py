"""From text to a ranked list of findings, in one plan without a UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions.scoring import finding_fingerprint, priority_score
from casegraph.operators.classify import classify_scope
from casegraph.operators.detect import detect
from casegraph.operators.triage import top
from casegraph.queries.detection import TEXT_MATRIX
from casegraph.queries.standins import files
from casegraph.sources.files import is_vendor, language_of, lines_of


def flagship(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    """Documents as files: scope, pattern matches, fingerprint, score, first per fingerprint, top k."""
    source = files(spark, sf_dir)
    known = source.select("doc_id", "rel_path", language_of(F.col("rel_path")).alias("language"), is_vendor(F.col("rel_path")).alias("is_vendor"))
    scoped = classify_scope(known).select("doc_id", "rel_path", "execution_domain", "runtime_role")
    hits = detect(lines_of(source, "doc_id"), TEXT_MATRIX).join(scoped, "doc_id")
    score = priority_score(F.col("severity"), F.lit(1.0), F.lit(1), F.lit("UNKNOWN"), F.lit(True), F.col("execution_domain"))
    fingerprint = finding_fingerprint(F.col("name"), F.lit(""), F.col("family"), F.col("expression"), F.col("rel_path"))
    items = hits.select(
        fingerprint.alias("path_id"), score.alias("priority"), (F.col("doc_id") * 1_000_000 + F.col("line")).alias("seq"),
        "doc_id", "rel_path", "execution_domain", "runtime_role", "line", "family", "name", "severity", "expression",
    )
    return top(items, k)

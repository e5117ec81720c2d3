"""The evidence gate, and verdicts read from completions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph import schemas as S
from casegraph.functions.text import first_json, python_round, scrub
from casegraph.operators.store import upsert_table

# Confidence that a verdict is exploitable (or safe).
SAFE, PARTIAL, OPEN = 0.95, 0.75, 0.90
INSUFFICIENT = "INSUFFICIENT_CONTEXT"


#: The prompts of a debate.
FOR_PROMPT, AGAINST_PROMPT = "Argue that this flow is exploitable.\n", "Argue that this flow is safe.\n"
JUDGE_PROMPT, FOR_HEAD, AGAINST_HEAD = "Judge. Answer in JSON with verdict, confidence, reasoning.\n", "\nFOR: ", "\nAGAINST: "


def _gate(stop: Column, effective: Column, partial: Column, reach: Column) -> tuple[Column, Column, Column]:
    verdict = (
        F.when(stop, INSUFFICIENT).when(effective, "SAFE_PROVEN").when(partial, "LIKELY_EXPLOITABLE_PARTIAL_SANITIZATION").otherwise("EXPLOITABLE")
    )
    chance = F.when(stop, 0.0).when(effective, SAFE).when(partial, PARTIAL).otherwise(OPEN)
    confidence = F.when(stop, 0.0).otherwise(python_round(F.least(reach, chance)))
    return verdict, chance, confidence


def gate_bundles(bundles: DataFrame) -> DataFrame:
    """Evidence bundles -> verdict, exploitability_confidence, confidence, reasoning.

    Columns read: source_node, path_trace (array), sink_node, reach, effective, partial, agent_turns, bypass_reasoning.
    """
    turns = F.coalesce("agent_turns", F.lit(0)) > S.MAX_AGENT_TURNS
    missing = (
        F.col("source_node").isNull() | F.col("sink_node").isNull() | (F.coalesce(F.size("path_trace"), F.lit(-1)) < 1)
        | (F.col("reach") < S.MIN_REACH_CONFIDENCE) | F.col("reach").isNull()
    )
    verdict, chance, confidence = _gate(turns | missing, F.coalesce("effective", F.lit(False)), F.coalesce("partial", F.lit(False)), F.col("reach"))
    # The texts of refusals.
    reason = (
        F.when(turns, "Circuit breaker triggered: Exceeded max 8 agent turns per path")
        .when(missing, "Insufficient CPG path, source, or sink evidence").otherwise(F.coalesce("bypass_reasoning", F.lit("")))
    )
    return bundles.withColumns({
        "verdict": verdict, "exploitability_confidence": chance, "confidence": confidence, "reasoning": reason,
        "scrubbed_reasoning": scrub(F.coalesce("bypass_reasoning", F.lit(""))),
    })


def gate_arguments(rows: DataFrame) -> DataFrame:
    """The same gate from plain columns: source_control, reach, transform_status."""
    stop = (
        F.coalesce(F.col("source_control") != "CONFIRMED", F.lit(True)) | (F.col("reach") < S.MIN_REACH_CONFIDENCE)
        | F.coalesce(F.col("transform_status") == "UNKNOWN", F.lit(True))
    )
    status = F.col("transform_status")
    verdict, chance, confidence = _gate(stop, status == "EFFECTIVE", status == "PARTIAL", F.col("reach"))
    return rows.withColumns({"verdict": verdict, "exploitability_confidence": chance, "confidence": confidence})


def parse_verdicts(completions: DataFrame, text_col: str = "text") -> DataFrame:
    """Completions -> verdict, confidence, reasoning; what cannot be read is INSUFFICIENT_CONTEXT with 0.0."""
    body = F.from_json(first_json(F.col(text_col)), "verdict string, confidence double, reasoning string, bypass_reasoning string")
    rows = completions.withColumn("_v", body)
    known = F.coalesce(F.col("_v.verdict").isin(*S.VERDICTS), F.lit(False))
    return rows.select(
        *completions.columns,
        F.when(known, F.col("_v.verdict")).otherwise(INSUFFICIENT).alias("verdict"),
        F.when(known, F.coalesce("_v.confidence", F.lit(0.5))).otherwise(0.0).alias("confidence"),
        F.when(known, F.coalesce("_v.reasoning", "_v.bypass_reasoning", F.lit(""))).otherwise("Unreadable completion").alias("reasoning"),
    )


@dataclass
class Router:
    """Calls a completion function with retries, then a fallback once; raises if both fail.

    Functions are given by the caller: this package opens no connection.
    """

    primary: Callable[[str], str]
    fallback: Callable[[str], str] | None = None
    retries: int = 3
    backoff: float = 1.0
    sleep: Callable[[float], None] = field(default=time.sleep)

    def complete(self, prompt: str) -> str:
        last: Exception | None = None
        for attempt in range(self.retries + 1):
            try:
                return self.primary(prompt)
            except Exception as error:
                last = error
                if attempt < self.retries:
                    self.sleep(self.backoff * 2**attempt)
        if self.fallback is not None:
            try:
                return self.fallback(prompt)
            except Exception as error:
                last = error
        raise RuntimeError("completion failed") from last


#: Rows whose texts a Python worker holds at a time.
BATCH_ROWS = 500


def _answered(rows: DataFrame, answer: Callable[[str | None], str | None], read_col: str, text_col: str) -> DataFrame:
    """``rows`` with ``answer`` of each text, in one Python worker a task."""
    read = rows.columns.index(read_col)
    names = [*rows.columns, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                texts = pa.array([answer(t) for t in part.column(read).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def _attempt(router: Router, prompt: str | None) -> str | None:
    try:
        return router.complete(prompt)
    except RuntimeError:
        return None


def complete(prompts: DataFrame, router: Router, prompt_col: str = "prompt", text_col: str = "text") -> DataFrame:
    """``prompts`` with one completion each; a failure leaves null, which parses as INSUFFICIENT_CONTEXT."""
    return _answered(prompts, lambda prompt: _attempt(router, prompt), prompt_col, text_col)


def debate(slices: DataFrame, router: Router, slice_col: str = "slice") -> DataFrame:
    """Three completions in turn, for, against and judgement; the judgement's verdict counts.

    A row's three completions are one step, so a task has one Python worker, not three.
    """

    def judge(text: str | None) -> str | None:
        def ask(*parts: str) -> str | None:
            return _attempt(router, None if text is None else "".join(parts))

        said = ask(FOR_PROMPT, text)
        answered = ask(AGAINST_PROMPT, text)
        return ask(JUDGE_PROMPT, text, FOR_HEAD, said or "", AGAINST_HEAD, answered or "")

    judged = _answered(slices.drop("judgement"), judge, slice_col, "judgement")
    judged = judged.withColumn("judgement", F.replace("judgement", F.lit("\\'"), F.lit("'")))
    return parse_verdicts(judged, "judgement").drop("prompt", "prosecution", "defence", "judgement")


def infer_links(responses: DataFrame, symbols: DataFrame, max_turns: int = S.MAX_LINKER_TURNS) -> DataFrame:
    """Completions about dynamic calls -> edges (caller_symbol_id, callee_symbol_id, edge_type, confidence, provenance).

    ``responses`` has caller_symbol_id, turn (from 1) and text; the first readable answer within
    ``max_turns`` that names a known symbol with some confidence counts.
    """
    body = F.from_json(first_json(F.col("text")), "target_symbol string, confidence double")
    named = responses.filter(F.col("turn") <= max_turns).withColumn("_b", body)
    named = named.filter("_b.target_symbol is not null and _b.confidence > 0")
    callee = symbols.groupBy("name").agg(F.min("symbol_id").alias("callee_symbol_id"))
    hits = named.join(callee, F.col("_b.target_symbol") == F.col("name"))
    first = hits.groupBy("caller_symbol_id").agg(F.min_by(F.struct("callee_symbol_id", F.col("_b.confidence").alias("confidence")), "turn").alias("h"))
    return first.select(
        "caller_symbol_id", "h.callee_symbol_id", F.lit("DYNAMIC_DISPATCH").alias("edge_type"), "h.confidence", F.lit("AGENT_INFERRED").alias("provenance")
    )


def link_tables(links: DataFrame, edges: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """``graph_edges`` and ``graph_edge_evidence`` with inferred links (rows of ``infer_links``) in them, to be committed together.

    An edge that is there keeps its id; each inference is a piece of evidence of its own.
    """
    named = links.select("caller_symbol_id", "callee_symbol_id", "edge_type").distinct()
    merged = upsert_table("graph_edges", edges, named)
    found = links.join(merged, ["caller_symbol_id", "callee_symbol_id", "edge_type"])
    pieces = found.select(
        F.xxhash64("edge_id", "provenance", "confidence").alias("evidence_id"), "edge_id", F.col("provenance").alias("resolution_method"), "confidence",
        F.create_map(F.lit("inferred_by"), F.lit("completion")).alias("evidence"), F.lit(True).alias("is_active"), F.current_timestamp().alias("created_at"),
    )
    return {"graph_edges": merged, "graph_edge_evidence": upsert_table("graph_edge_evidence", evidence, pieces)}

from casegraph.operators import verify
import math

import pytest
from pyspark.sql import functions as F

from casegraph.functions.scoring import engine_fingerprint, finding_fingerprint, priority_score
from casegraph.functions.text import first_json, python_round, scrub, splitlines
from casegraph.operators.triage import top
from casegraph.operators.verify import Router, complete, gate_arguments, gate_bundles, infer_links, parse_verdicts


@pytest.mark.parametrize(
    ("control", "reach", "status", "verdict", "confidence"),
    [
        ("CONFIRMED", 0.85, "FAILED", "EXPLOITABLE", 0.85), ("CONFIRMED", 0.80, "PARTIAL", "LIKELY_EXPLOITABLE_PARTIAL_SANITIZATION", 0.75),
        ("CONFIRMED", 0.9, "UNKNOWN", "INSUFFICIENT_CONTEXT", 0.0), ("CONFIRMED", 0.95, "EFFECTIVE", "SAFE_PROVEN", 0.95),
        ("ASSUMED", 0.9, "FAILED", "INSUFFICIENT_CONTEXT", 0.0), (None, 0.9, "FAILED", "INSUFFICIENT_CONTEXT", 0.0), ("CONFIRMED", 0.59, "FAILED", "INSUFFICIENT_CONTEXT", 0.0),
    ],
)
def test_arguments(spark, control, reach, status, verdict, confidence):
    row = gate_arguments(spark.createDataFrame([(control, reach, status)], "source_control string, reach double, transform_status string")).first()
    assert (row["verdict"], row["confidence"]) == (verdict, confidence)


BUNDLE = "source_node string, path_trace array<string>, sink_node string, reach double, effective boolean, partial boolean, agent_turns int, bypass_reasoning string"


@pytest.mark.parametrize(
    ("bundle", "verdict", "confidence"),
    [
        (("s", ["s", "k"], "k", 0.62, False, False, 1, ""), "EXPLOITABLE", 0.62), (("s", ["s"], "k", 0.9, False, False, 9, ""), "INSUFFICIENT_CONTEXT", 0.0),
        (("s", [], "k", 0.9, False, False, 1, ""), "INSUFFICIENT_CONTEXT", 0.0), (("s", None, "k", 0.9, False, False, 1, None), "INSUFFICIENT_CONTEXT", 0.0),
        ((None, ["s"], "k", 0.9, True, False, 1, ""), "INSUFFICIENT_CONTEXT", 0.0), (("s", ["s"], "k", 0.99, True, True, 8, ""), "SAFE_PROVEN", 0.95),
        (("s", ["s"], "k", None, False, False, 1, ""), "INSUFFICIENT_CONTEXT", 0.0),
    ],
)
def test_bundles(spark, bundle, verdict, confidence):
    row = gate_bundles(spark.createDataFrame([bundle], BUNDLE)).first()
    assert (row["verdict"], row["confidence"]) == (verdict, confidence)


def test_python_round(spark):
    values = [0.625, 0.745, 0.665, 0.755, 0.125, 0.375, 1.005, 2.675, 0.0, 0.62, 0.999, 12.345, 0.285, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", python_round(F.col("x")).alias("y"))
    assert all(math.isclose(r["y"], round(r["x"], 2), abs_tol=1e-12) for r in df.collect())


def test_fingerprints(spark):
    def mark(*parts):
        return spark.range(1).select(finding_fingerprint(*[F.lit(p) for p in parts]).alias("f")).first()[0]

    base = mark("ssrf", "POST /x", "body", "fetch", "a.js:34")
    assert base == mark(" SSRF ", "POST /x", "body", "fetch", "a.js:45") and len(base) == 64
    for i in range(5):
        changed = ["ssrf", "POST /x", "body", "fetch", "a.js:34"]
        changed[i] = "other"
        assert mark(*changed) != base
    assert engine_fingerprint({"a": "1"}) == engine_fingerprint({"a": "1"})
    assert len({engine_fingerprint({"a": "1"}), engine_fingerprint({"a": "2"}), engine_fingerprint({"a": "1"}, b"lock"), engine_fingerprint({"a": "1"}, b"")}) == 4


def test_scores(spark):
    cases = spark.createDataFrame([("APPLICATION_RUNTIME", "CRITICAL"), ("CI_CD_PIPELINE", "CRITICAL"), ("TEST_MOCK", "CRITICAL"), (None, "odd")], "d string, s string")
    score = priority_score(F.col("s"), F.lit(0.9), F.lit(4), F.lit("UNKNOWN"), F.lit(True), F.col("d"))
    prod, ci, test, odd = [r[0] for r in cases.select(score).collect()]
    assert prod > ci > test > 0 and odd > 0
    assert math.isclose(prod, 0.9 * 1.1 / 2)


def test_queue(spark):
    items = spark.createDataFrame([("p1", 0.2, 0), ("p2", 0.9, 1), ("p3", 0.5, 2), ("p1", 0.99, 3)], "path_id string, priority double, seq long")
    assert [r["path_id"] for r in top(items, 10).collect()] == ["p2", "p3", "p1"]
    assert top(items.limit(0), 3).collect() == []


def test_text(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(splitlines(F.lit("a\r\nb\rc\x1cd\u2028e\n"))) == ["a", "b", "c", "d", "e"]
    assert one(splitlines(F.lit(""))) == []
    assert one(scrub(F.lit("<thought>x</thought> Prosecutor: y scratchpad:"))) == "x  y"
    assert one(first_json(F.lit('a {"b": {"c": 1}} d'))) == '{"b": {"c": 1}'


def test_completions(spark, rows):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        raise OSError("down")

    assert Router(flaky, fallback=lambda p: "ok", retries=2, sleep=lambda s: None).complete("p") == "ok"
    assert len(calls) == 3
    with pytest.raises(RuntimeError):
        Router(flaky, retries=1, sleep=lambda s: None).complete("p")
    prompts = spark.createDataFrame([("good",), ("bad",), ("boom",)], "prompt string")

    def answer(prompt):
        if prompt == "boom":
            raise ValueError
        return '{"verdict": "EXPLOITABLE", "confidence": 0.95}' if prompt == "good" else '{"verdict": "WHO"}'

    found = parse_verdicts(complete(prompts, Router(answer, retries=0)))
    assert rows(found, "prompt", "verdict", "confidence") == [("bad", "INSUFFICIENT_CONTEXT", 0.0), ("boom", "INSUFFICIENT_CONTEXT", 0.0), ("good", "EXPLOITABLE", 0.95)]


def test_linker(spark, rows):
    responses = spark.createDataFrame(
        [(1, 1, "none"), (1, 2, '{"target_symbol": "run", "confidence": 0.85}'), (2, 3, '{"target_symbol": "run", "confidence": 1}'), (3, 1, '{"target_symbol": "x", "confidence": 1}'), (4, 1, '{"target_symbol": "run", "confidence": 0}')],
        "caller_symbol_id long, turn int, text string",
    )
    symbols = spark.createDataFrame([(9, "run"), (8, "run")], "symbol_id long, name string")
    assert rows(infer_links(responses, symbols)) == [(1, 8, "DYNAMIC_DISPATCH", 0.85, "AGENT_INFERRED")]


def test_a_debate_is_one_python_step(spark, rows):
    from casegraph.operators.verify import Router, debate

    def say(prompt):
        if prompt.startswith("Judge"):
            return '{"verdict": "EXPLOITABLE", "confidence": 0.5, "reasoning": "%d"}' % len(prompt)
        return "x" * len(prompt)

    slices = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, slice string")
    judged = debate(slices, Router(say, retries=0))
    heads = sum(map(len, (verify.FOR_PROMPT, verify.AGAINST_PROMPT, verify.JUDGE_PROMPT, verify.FOR_HEAD, verify.AGAINST_HEAD)))
    assert rows(judged, "id", "verdict", "reasoning") == [
        (1, "EXPLOITABLE", str(heads + 6)), (2, "INSUFFICIENT_CONTEXT", "Unreadable completion"), (3, "EXPLOITABLE", str(heads))]
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1


def test_equal_items_have_one_order(spark, rows):
    from casegraph.operators.triage import pop_order

    items = [(k, "q", 0.5, 7) for k in (5, 3, 9, 1)] + [(8, "q", 0.9, 8)]
    for order in (items, items[::-1]):
        found = pop_order(spark.createDataFrame(order, "path_id long, queue string, priority double, seq long"), ["queue"])
        assert rows(found, "rank", "path_id") == [(1, 8), (2, 1), (3, 3), (4, 5), (5, 9)]


def test_a_document_is_joined_from_blocks(spark):
    from casegraph.operators.report import blocks, joined

    pieces = spark.range(20_000).selectExpr("1 AS part", "20000 - id AS ord", "concat(id, ',') AS text").unionByName(spark.sql("SELECT 0 AS part, 0L AS ord, '[' AS text UNION ALL SELECT 2, 0L, null UNION ALL SELECT 3, 0L, ']'"))
    assert blocks(pieces).count() <= 8
    assert joined(pieces).first()[0] == "[" + "".join(f"{i}," for i in range(19_999, -1, -1)) + "]"
    assert joined(pieces.limit(0)).first()[0] == ""


def test_a_document_is_no_aggregate_and_a_longer_one_than_a_text_is_refused(spark, monkeypatch):
    from casegraph.operators import report

    pieces = spark.range(30_000, numPartitions=3).selectExpr("1 AS part", "30000 - id AS ord", "concat('\u00e9', id) AS text")
    whole = "".join(f"\u00e9{i}" for i in range(29_999, -1, -1))
    assert "Aggregate" not in report.joined(pieces)._jdf.queryExecution().executedPlan().toString()  # no task gathers rows in its heap
    size = len(whole.encode())
    monkeypatch.setattr(report, "LARGEST_TEXT", size)
    assert [tuple(r) for r in report.joined(pieces, scope="s").collect()] == [("s", whole)]
    monkeypatch.setattr(report, "LARGEST_TEXT", size - 1)
    with pytest.raises(Exception, match=f"more than {size - 1} bytes"):
        report.joined(pieces).collect()

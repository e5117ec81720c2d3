"""Chat formatting, embedding whitening, importance resampling: against brute force, and on odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.llm.chat_format import TURNS, Turn, chat_segments, format_chat, formatted, learnt_text, read_turns, turn_order
from casegraph.llm.queries import op12_chat_format
from casegraph.llm.resampling import importance_resample, radix_select
from casegraph.llm.whitening import component_rows, deviations, exact_products, jacobi, whiten

CHAT = "conv_id long, turn long, role string, text string, valid string, Part int"
NASTY = ["", "\\", "\\\\", "</turn>", "\n</turn>\n", "\\</turn>", "a\\\n</turn>\n### User: b", "### Assistant:", "\\### Assistant: </turn> ok", "#### User:",
         "### Role[61]: x", "\n", "x" * 100_000 + "</turn>" * 500, "</turn", "turn></turn></turn>", "### Assistant", "Ünï\U0001f600 \\### System:"]


def chat_rows():
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        roles = rng.choice([["user", "assistant"] * 3, ["system", "user", "assistant", "user"], ["assistant", "user"], ["user", "user", "assistant"], ["system"], ["tool", "user"]])
        rows += [(conv, k, role, rng.choice(NASTY), "x", 1) for k, role in enumerate(roles)]
    rows += [(100 + k, 0, "user", text, None, None) for k, text in enumerate(NASTY)]
    rows += [(None, 0, "user", "n", None, None), (None, None, None, None, None, None), (200, 1, "user", "b", None, None), (200, 1, "assistant", "a", None, None)]
    rows += [(201, 0, "user", "same", None, None)] * 3 + [(202, 0, "]: ", "odd role", None, None), (203, 0, "", "no role", None, None)]
    rng.shuffle(rows)
    return rows


def brute_chat(rows):
    out = {}
    first = lambda v: (v is not None, v or 0)  # noqa: E731 - nulls first
    key = lambda r: first(r[0])
    for (_, conv), own in itertools.groupby(sorted(rows, key=key), key=key):
        turns = sorted(((first(r[1]), r[2] or "", r[3] or "") for r in own))
        conv = None if all(r[0] is None for r in rows if first(r[0]) == (_, conv)) else conv
        state, broken = "start", []
        for (there, turn), role, _text in turns:
            to = TURNS.steps.get((state, role))
            if to is None:
                broken.append(turn if there else None)
                to = next((s for (_, r), s in TURNS.steps.items() if r == role), "")
            state = to
        known = [b for b in broken if b is not None]
        out[conv] = ([(r, t) for _, r, t in turns], not broken and state in TURNS.final, min(known, default=None))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_chat_against_brute_force(spark, parts):
    rows = chat_rows()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = format_chat(spark.createDataFrame(rows, CHAT).repartition(parts))
        read = out.select("*", formatted(F.col("segments")).alias("whole")).select("*", read_turns(F.col("whole")).alias("turns"), learnt_text(F.col("segments")).alias("learnt"))
        found = {r["conv_id"]: r for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    expected = brute_chat(rows)
    assert set(found) == set(expected)
    for conv, (turns, valid, broken) in expected.items():
        r = found[conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["learnt"] == "".join(t for role, t in turns if role == "assistant")
        assert (r["valid"], r["broken_at"]) == (valid, broken), conv
        assert [s["kind"] for s in r["segments"]] == ["opening", "text", "closing"] * len(turns)
        assert not any(s["loss"] for s in r["segments"] if s["kind"] != "text")


def test_chat_segments_are_the_same_rows(spark):
    chats = spark.createDataFrame(chat_rows(), CHAT)
    assert chat_segments(chats).count() == 3 * chats.count()
    own = chat_segments(chats).filter("conv_id = 201").select("text", "loss").collect()
    assert Counter((r["text"], r["loss"]) for r in own) == {("### User: ", False): 3, ("same", False): 3, ("\n</turn>\n", False): 3}
    empty = chats.limit(0)
    assert format_chat(empty).count() == turn_order(empty).count() == chat_segments(empty).count() == 0


def test_chat_stays_in_the_jvm(spark):
    plan = op12_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn|ExistingRDD", plan)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("change", [
    {"closing": "### User:x"}, {"closing_before": ""}, {"closing_before": "\\"}, {"other": "a\\"}, {"closing_before": "<"}, {"other_after": "<"},
    {"steps": {("start", "user"): "a", ("a", "user"): "b"}}, {"steps": {("start", "nobody"): "a"}}, {"turns": TURNS.turns | {"x": Turn("> ###")}},
])
def test_templates_that_could_not_be_read_back(change):
    with pytest.raises(ValueError):
        replace(TURNS, **change)


def brute_features(text):
    tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)]
    return len(tokens), [zlib.crc32(f.encode()) % 10000 for f in runs]


def brute_resample(docs, target):
    feats = [brute_features(t) for _, t in docs]
    corpus, wanted = Counter(b for _, f in feats for b in f), Counter(b for t in target for b in brute_features(t)[1])
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((corpus[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for (i, _), (n, f) in zip(docs, feats, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: 5 * len(fit) // 100])}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in rows), key=repr)


def test_resampling_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "été", "x1", "\U0001f600", "don't", "a-b", "Zürich", "日本"] + [f"w{k}" for k in range(300)]
    docs = [(k * 7 - 300, " ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 19, 20, 60])))) for k in range(400)]
    docs += [(None, "a b " * 40), (5000, None), (5001, ""), (5002, "!!! ..."), (5003, "word " * 30_000), (6000, "same words here " * 10), (6000, "same words here " * 10)]
    target = ["alpha beta w1 w2 w3 " * 5, "", None, "w4 w5 a b"]
    df = spark.createDataFrame([(i, t, 1.0, "r") for i, t in docs], "doc_id long, text string, score double, rank string")
    out = importance_resample(df.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_resample(docs, target)


def test_resampling_odd_tables(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance_resample(empty, target).count() == 0
    some = spark.createDataFrame([(k, "a b c d " * 6) for k in range(40)], "doc_id long, text string")
    assert sorted(r["rank"] for r in importance_resample(some, target.limit(0)).collect() if r["rank"]) == [1, 2]
    # One id and text in a third of all rows: exactly the number asked for is drawn, each rank once.
    many = some.union(spark.createDataFrame([(99, "a b c d " * 6)] * 400, "doc_id long, text string"))
    assert sorted(r["rank"] for r in importance_resample(many, target, percent=60).collect() if r["rank"]) == list(range(1, 265))


@pytest.mark.parametrize("span", [3, 10**6, 2**62])
def test_radix_selection(spark, span):
    rng = random.Random(span)
    keys = [(rng.randrange(-span, span), rng.choice([None, rng.randrange(-(2**62), 2**62), rng.randrange(5)])) for _ in range(300)]
    df = spark.createDataFrame(keys, "score long, id long")
    order = sorted(keys, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    for k in (0, 1, 7, 150, 299, 300, 400):
        last = order[min(k, 300) - 1] if k else None
        expected = [x for x in order if k and order.index(x) <= order.index(last)]
        assert sorted(map(tuple, df.filter(radix_select(df, k)).collect()), key=repr) == sorted(expected, key=repr)


def brute_whitening(vectors):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=float)
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    sums = [int(s) for s in fit.sum(axis=0)]
    out = {}
    for i, x in good:
        deviation = sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        white = [abs((np.array(x) - fit.mean(axis=0)) @ axes[:, -k] / math.sqrt(values[-k])) for k in range(1, 5)]
        out[i] = (len(fit), deviation, white, [values[-k] / values.sum() for k in range(1, 5)])
    return out


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    points = (rng.standard_normal((300, 12)) * np.linspace(2, 0.1, 12) + 1.5).astype(np.float32).astype(float).tolist()
    vectors = list(enumerate(points)) + [(1000 + k, points[0]) for k in range(200)]
    bad = [(2000, None), (2001, []), (2002, [float("nan")] + points[1][1:]), (2003, [float("inf")] + points[1][1:]), (2004, [None] + points[1][1:]), (2005, [-float("inf")] * 12)]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in vectors + bad], "vec_id long, embedding array<double>, component int, n string").repartition(7)
    found = {}
    for r in component_rows(whiten(df)).collect():
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    expected = brute_whitening(vectors)
    assert set(found) == set(expected) and all(set(rows) == {1, 2, 3, 4} for rows in found.values())
    for i, (n, deviation, white, explained) in expected.items():
        for k, r in found[i].items():
            assert (r["n"], int(r["deviation"])) == (n, deviation)
            assert abs(r["whitened"]) == pytest.approx(white[k - 1], abs=1e-9) and r["explained"] == pytest.approx(explained[k - 1], rel=1e-9)
            assert r["identity_error"] < 1e-10
    # The same whatever the partitions: sums are exact.
    again = {r["vec_id"]: r["whitened"] for r in whiten(df.repartition(3)).collect()}
    assert all(again[i] == [found[i][k]["whitened"] for k in (1, 2, 3, 4)] for i in found)


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    make = lambda rows: component_rows(whiten(spark.createDataFrame(rows, kind))).collect()
    assert make([]) == [] and make([(1, None), (2, [])]) == []
    assert [r["whitened"] for r in make([(1, [0.5, 0.25])] * 3)] == [None] * 6  # no variance at all
    flat = make([(None, [1.0, 2.0]), (None, [2.0, 2.0]), (3, [1.0]), (4, [1.0, 2.0])])  # one dimension varies; another length
    assert sorted((r["vec_id"] or 0, r["component"], r["whitened"] and abs(r["whitened"])) for r in flat) == [(0, 1, 1.0), (0, 1, 1.0), (0, 2, None), (0, 2, None), (4, 1, 1.0), (4, 2, None)]
    huge = make([(1, [3.0e38, 1.0]), (2, [1.0e10, 1.0]), (3, [2.0e10, 1.5]), (4, [1.5e10, 0.5])])
    assert {r["vec_id"] for r in huge} == {2, 3, 4} and all(r["identity_error"] < 1e-4 for r in huge if r["whitened"] is not None)


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 16, 33):
        m = rng.standard_normal((3 * d, d))
        values, vectors = jacobi(m.T @ m)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(m.T @ m))[::-1], rtol=1e-10)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12) and np.allclose(m.T @ m @ vectors, vectors * values, atol=1e-9 * values[0])
    # Scaled by powers of two from both sides, the matrix keeps its small eigenvalues to full precision.
    scale = 2.0 ** -np.arange(0, 60, 4)
    core = np.eye(15) + 0.1 * np.ones((15, 15))
    values = jacobi(core * np.outer(scale, scale))[0]
    # Exact value of the product of all eigenvalues: det(core) * prod(scale)^2.
    assert np.log2(values).sum() == pytest.approx(np.log2(1 + 1.5) + 2 * np.log2(scale).sum(), rel=1e-13)
    assert values[-1] < 1e-33
    assert jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_integer_sums_are_exact():
    y = np.array([[2**40, 3], [-(2**41), 5], [7, 11]], np.int64)
    assert exact_products(y).tolist() == [[2**80 + 2**82 + 49, 3 * 2**40 - 5 * 2**41 + 77], [3 * 2**40 - 5 * 2**41 + 77, 9 + 25 + 121]]

    class Model:
        n, sums = 10**6, [2**60, 5]

    assert deviations(Model, np.array([[2**40, 1]], np.int64)) == [(10**6 * 2**40 - 2**60) ** 2 + (10**6 - 5) ** 2]

"""BPE, token files, mixing, exact dedup, line dedup on small inputs with odd rows."""

import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casegraph.llm.bpe import BpeCodec, LibraryCodec, bpe_round_trip
from casegraph.llm.exact_dedup import exact_dedup
from casegraph.llm.line_dedup import line_dedup
from casegraph.llm.mixing import mix_documents, plan_mix, source_targets, training_position
from casegraph.llm.queries import tokenizer_path
from casegraph.llm.token_files import SHARD_SCHEMA, read_token_shards, write_token_shards
from casegraph.llm.wavelet import Wavelet, write_wavelet

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path()
DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


ODD_TEXTS = [
    "", "   ", "Hello  World's 12ab", "é ÉCOLE ß µ ª", "<|endoftext|> a<|startoftext|>", "\x1c\x85 ​", "İΣς ﬁ é", "🙂🙂", "it's don't WE'LL", "a" * 5000,
    "x-y_z...!!", "\t\n", "１２ 你好", "'s 'T",
]


@pytest.mark.parametrize("kind", [BpeCodec, LibraryCodec])
@pytest.mark.parametrize("text", ODD_TEXTS)
def test_encoding_equals_the_library(library, kind, text):
    ids = np.frombuffer(_codec(kind).encode_bytes(text), "<i4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_many_texts_at_once_equal_the_library(library):
    """Plain and other texts in one call; plain ones alone, none, and every plain character between words, in both cases."""
    own = _codec(LibraryCodec)
    plain = [chr(c) for c in range(0x180) if own._splitting.apart(chr(c))]
    texts = ["", *ODD_TEXTS, " lead", "trail ", *(f"Ab{c}Cd {c} {c}x" for c in plain), "".join(plain), "word " * 3000]
    for some in (texts, texts[::-1], [t for t in texts if own._splitting.apart(t)], ["🙂"], [""], []):
        assert [ids.tolist() for ids in own.encode_all(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_many_texts_look_a_piece_up_once(monkeypatch):
    """CPU follows the distinct pieces of a slice, not its words."""
    own, asked = LibraryCodec(PATH), []
    piece = own._piece
    monkeypatch.setattr(own, "_piece", lambda p: asked.append(p) or piece(p))
    own.encode_all(["some words, some WORDS again " * 500] * 20)
    assert sorted(filter(None, asked)) == ["again", "some", "words", "words,"]


@functools.cache
def _codec(kind):
    return kind(PATH)


_reference = functools.cache(tokenizers.Tokenizer.from_file)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    reference = _reference(PATH)
    ids = reference.encode(text, add_special_tokens=False).ids
    assert _codec(BpeCodec).encode(text) == ids
    assert np.frombuffer(_codec(LibraryCodec).encode_bytes(text), "<i4").tolist() == ids
    assert _codec(BpeCodec).decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark, library):
    rows = [(1, None, "x"), (1, "Ab c", "x"), (None, "", None), (1, "Ab c", "x"), (2, "long " * 3000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe_round_trip(df, PATH).collect()
    assert len(found) == 5 and found[0].asDict().keys() == {"doc_id", "text", "ids", "decoded"}
    for r in found:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe_round_trip(df.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=200), st.integers(5, 9))
def test_wavelet(ids, bits):
    array = np.array(ids, np.uint16)
    shard = Wavelet(write_wavelet(array, bits, np.array([7]), np.array([False]), np.array([len(ids)])))
    assert shard.decode().tolist() == ids and [shard.access(i) for i in range(len(ids))] == ids
    for token in {*ids, 21}:
        places = [i for i, x in enumerate(ids) if x == token]
        assert shard.occurrences(token) == places and shard.count(token) == len(places)
        assert [shard.rank(token, e) for e in (0, len(ids) // 2, len(ids) + 5)] == [sum(p < e for p in places) for e in (0, len(ids) // 2, len(ids) + 5)]
    with pytest.raises(IndexError):
        shard.select(21, 0)


def test_wavelet_over_many_chunks():
    ids = np.random.default_rng(0).integers(0, 49_408, 300_000).astype(np.uint16)
    shard = Wavelet(write_wavelet(ids, 16, np.arange(3), np.zeros(3, bool), np.array([100_000] * 3)))
    assert (shard.decode() == ids).all()
    for i in (0, 65_535, 65_536, 299_999):
        assert shard.access(i) == ids[i] and shard.select(int(ids[i]), shard.rank(int(ids[i]), i)) == i
    with pytest.raises(ValueError):
        write_wavelet(ids, 10, np.arange(3), np.zeros(3, bool), np.array([100_000] * 3))


def test_token_files(spark, library, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "Word", "x1", "été"]) for _ in range(rng.randrange(40))), "s") for i in range(200)] + [(500, None, "s"), (7, "b again", "s"), (None, "null id", "s")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    write_token_shards(docs, str(tmp_path / "t"), PATH, shard_tokens=300)
    assert spark.read.schema(SHARD_SCHEMA).parquet(str(tmp_path / "t")).count() > 5
    found = sorted(read_token_shards(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in found] == [r[0] for r in ordered]
    for r, (_, text, _) in zip(found, ordered, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    write_token_shards(docs.limit(0), str(tmp_path / "e"), PATH)
    assert read_token_shards(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("hot", [100_000, 20])
def test_token_files_with_an_id_in_many_rows(spark, library, tmp_path, monkeypatch, hot):
    monkeypatch.setattr("casegraph.llm.token_files.HOT_ID", hot)
    rows = [(5 if i % 3 else i, f"text {i % 7} " + "word " * (i % 4), "s") for i in range(120)] + [(None, "n", "s")] * 30 + [(3, "long " * 20_000, "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"source": "head"}).withColumn("place", F.lit(1)).repartition(4)
    write_token_shards(docs, str(tmp_path / "t"), PATH, shard_tokens=100)
    found = sorted(read_token_shards(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in found] == [sum(r["n_tokens"] for r in found[:k]) for k in range(len(found))]
    wanted = sorted((d or -1, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, t, _ in rows)
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in found) == wanted


def test_a_shard_is_one_file(spark, library, tmp_path):
    """A shard outside its envelope: opened in place, without a copy in memory."""
    import mmap

    docs = spark.createDataFrame([(1, "one two two", "s"), (2, None, "s")], DOCS).coalesce(1)
    write_token_shards(docs, str(tmp_path / "t"), PATH)
    (tmp_path / "shard").write_bytes(spark.read.schema(SHARD_SCHEMA).parquet(str(tmp_path / "t")).first()["file"])
    ids = [*library.encode("one two two", add_special_tokens=False).ids, 1, 1]
    with (tmp_path / "shard").open("rb") as file, mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as held:
        shard = Wavelet(held)
        assert shard.decode().tolist() == ids and shard.occurrences(ids[1]) == [1, 2] and shard.count(1) == 2
        assert [(d, x.tolist()) for d, x in shard.documents()] == [(1, ids[:-1]), (2, [1])]
        shard._view.release()


def test_what_workers_remember_is_bounded():
    from casegraph.llm.common import Remembered

    known = Remembered(str.upper, limit=10, chars=100)
    for i in range(1000):
        assert known[f"word{i}"] == f"WORD{i}" and len(known) <= 10 and sum(map(len, known)) <= 100
    assert known["x" * 5000] == "X" * 5000 and "x" * 5000 not in known


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), budget * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        weight = sum(w[s] for s in names if s not in full)
        over = [s for s in names if s not in full and rest * w[s] / weight > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else rest * w[s] / weight for s in names}
        full |= set(over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 7}, {"a": 5}, {"a": 0, "b": 10}, {"b": 100, "Z": 100, "é": 100, "a": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r["source"]: r["target"] for r in source_targets(df).collect()}
    expected = brute_targets(sizes)
    assert all(math.isclose(found[s], expected[s], abs_tol=1e-6) for s in sizes)


def mixed_docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(30))), rng.choice(["a", "b", "c", "c", "c"])) for i in range(300)]
    rows += [(900, None, None), (901, "one\ttwo\x0bthree", None), (902, "same", "a"), (902, "same", "a"), (None, "x y", "b"), (903, "y " * 4000, "b")]
    return rows, spark.createDataFrame(rows, DOCS)


def test_plan(spark):
    rows, docs = mixed_docs(spark)
    found = plan_mix(docs, bucket=20).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    targets = brute_targets(sizes)
    for source, target in targets.items():
        own = [r for r in found if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"] == sizes[source]
        assert abs(sum(r["taken"] for r in own) - target) <= 1
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["positions"])
        assert all(0 <= p["position"] <= 1 for p in r["positions"])
    again = plan_mix(docs.repartition(7), bucket=20).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert plan_mix(docs.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in plan_mix(spark.createDataFrame([(1, None, "a"), (2, " ", "b")], DOCS)).collect())


def test_query_sorts_the_mix(spark, monkeypatch, tmp_path):
    from casegraph.llm import mixing
    from casegraph.llm.queries import queries

    _, docs = mixed_docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    written = {}
    keep = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name, *a: written.setdefault(name, keep(df, name, *a)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = queries()["op4_mixing"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = [(r["f"], r["position"]) for r in written["mix-order"].select(F.input_file_name().alias("f"), "position").collect()]
    assert len({f for f, _ in ordered}) > 1
    by_file = sorted(ordered, key=lambda r: r[0])  # stable: rows of a file stay in their order
    assert [p for _, p in by_file] == sorted(p for _, p in ordered)
    columns = ("size", "source_size", "target", "taken", "positions")
    expected = plan_mix(docs).select(F.col("id").alias("doc_id"), *columns).collect()
    assert sorted(map(str, found)) == sorted(map(str, expected))
    assert len(ordered) == sum(len(r["positions"]) for r in expected)


def test_mix(spark):
    _, docs = mixed_docs(spark)
    docs = docs.withColumn("size", F.lit("clash")).withColumn("position", F.lit(1))
    taken = {(r["id"], r["size"]): r["taken"] for r in plan_mix(docs, bucket=20).collect() if r["id"] not in (902, None)}
    mixed = mix_documents(docs, bucket=20)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        if r["doc_id"] not in (902, None):
            words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert words == {k[0]: v for k, v in taken.items() if v}


def test_a_row_that_is_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr("casegraph.llm.mixing.LOT", 3)
    monkeypatch.setattr("casegraph.llm.mixing.BLOCK", 2)
    rows = [(1, "a b c", "s")] * 700 + [(i, "w " * i, "s") for i in range(40)] + [(2, "x y", None)] * 5
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = plan_mix(docs, bucket=4).collect()
    assert len(found) == len(rows)
    for source, target in brute_targets({"s": 2100 + sum(range(40)), None: 10}).items():
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - target) <= 1 and all(r["taken"] <= 2 * r["size"] for r in own)
    mixed = mix_documents(docs, bucket=4).collect()
    assert len(mixed) == sum(len(r["positions"]) for r in found)
    assert sum(len(r["text"].split()) for r in mixed) == sum(r["taken"] for r in found)


def test_training_position(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    found = [r[0] for r in df.select(training_position(F.col("u"), F.array(F.lit(1.5), F.lit(1.0), F.lit(0.5)))).collect()]
    for i, t in enumerate(found):
        area = 1.5 * t - 0.5 * t * t if t <= 1 else 1  # the integral of 1.5 - t, whose total is 1
        assert math.isclose(area, i / 100, abs_tol=1e-9)


def test_exact_dedup(spark):
    rows = [(3, "a  b", "x"), (1, "a\tb", "x"), (2, "c", "x"), (None, "c", "x"), (5, None, "x"), (6, "", "x"), (7, "A b", "x"), (2, "c", "x"), (None, "z", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    expected = {}
    for i, text, _ in rows:
        expected.setdefault(" ".join((text or "").replace("\t", " ").split(" ")).replace("  ", " "), []).append(i)
    for hasher in (F.md5, lambda t: F.substring(F.md5(t), 1, 0), lambda t: F.when(t == "c", "1").otherwise("2")):
        found = exact_dedup(docs, hasher=hasher).collect()
        assert len(found) == len(rows)
        for r in found:
            group = next(g for t, g in expected.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
            least = min((i for i in group if i is not None), default=None)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (least, len(group), r["doc_id"] == least)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_of_long_texts(spark):
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, long), (2, long + "x"), (3, long.replace(" ", "\t\n"))], "doc_id long, text string").withColumns({"k": F.lit("clash"), "t": F.lit(0)})
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()}
    assert found == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)}


def brute_line_dedup(rows, width=3):
    """The same rule in plain Python, for distinct (id, text) rows with distinct ids."""
    seen, gone = {}, {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        for p in range(len(lines) - width + 1):
            block = "\n".join(lines[p : p + width])
            if not block.strip():
                continue
            if block in seen:
                gone.setdefault(i, set()).update(range(p, p + width))
            else:
                seen[block] = True
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["text"] for r in line_dedup(docs).collect()} == brute_line_dedup(rows)


def test_line_dedup_odd_rows(spark):
    passage = "p1\np2\np3\np4"
    rows = [(1, passage + "\nown", 1), (2, "head\n" + passage, 2), (3, None, 3), (4, "", 4), (5, "one\ntwo", 5), (6, passage, 6), (7, "x\nx\nx\nx\nx", 7), (None, "n\n" + passage, 8), (8, "q\nq2\nq3", 9), (8, "q\nq2\nq3", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version int").withColumn("removed", F.lit(0))
    found = line_dedup(docs)
    assert found.columns == docs.columns
    texts = {r["version"]: r["text"] for r in found.collect()}
    # A null id sorts first, so its passage is the first.
    assert texts == {8: "n\n" + passage, 1: "own", 2: "head", 3: None, 4: "", 5: "one\ntwo", 6: "", 7: "x", 9: "q\nq2\nq3", 10: "q\nq2\nq3"}
    assert line_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_line_dedup_by_either_join(spark, monkeypatch, limit):
    monkeypatch.setattr("casegraph.llm.line_dedup.BROADCAST_STARTS", limit)
    monkeypatch.setattr("casegraph.llm.common.BROADCAST_ROWS", limit)
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(1, long), (2, "own\n" + long), (3, "x" * 300_000), (4, "a\nb\nc\nd"), (4, "a\nb\nc\nd"), (5, "b\nc\nd\ne")]
    found = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == [(1, long), (2, "own"), (3, "x" * 300_000), (4, "a\nb\nc\nd"), (4, "a\nb\nc\nd"), (5, "e")]


def test_line_dedup_stays_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    plan = line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_what_is_used_again_is_remembered():
    from casegraph.llm.common import Remembered

    computed = []
    known = Remembered(lambda k: computed.append(k) or k.upper(), limit=10)
    for i in range(100):
        assert known["often"] == "OFTEN" and known[f"once{i}"] == f"ONCE{i}"
        assert len(known) + len(known.old) <= 10
    assert computed.count("often") == 1


def test_slices_hold_few_texts():
    import pyarrow as pa

    from casegraph.llm.bpe import BATCH_CHARS, text_slices

    batch = pa.RecordBatch.from_pydict({"k": range(6), "t": ["x" * 600_000, None, "é" * 600_000, "", "z", None]})
    parts = list(text_slices(batch, "t"))
    assert [p.column("k").to_pylist() for p, _ in parts] == [[0, 1, 2], [3, 4, 5]] and [t for _, own in parts for t in own] == ["x" * 600_000, "", "é" * 600_000, "", "z", ""]
    assert BATCH_CHARS <= 1_000_000

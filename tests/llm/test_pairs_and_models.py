"""N-gram join, embedding dedup, components, toxicity, quality, HTML, and the pipeline."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.llm.components import component_roots, connected_components
from casegraph.llm.embedding_dedup import embedding_dedup, passes_for
from casegraph.llm.html_extraction import common, extract, extract_main_text, label, merge_wrappers, page_expression
from casegraph.llm.html_tree import Page
from casegraph.llm.ngram_join import agreeing_groups, choose_bands, keep_one, least_agreement, mix64, ngram_join, ngram_set, signatures, similar
from casegraph.llm.common import Remembered
from casegraph.llm.labelled import sample_texts
from casegraph.llm.quality import QualityModel, _directions, _rows, fit_quality, piece_terms, score_quality, text_terms, train_quality, vote
from casegraph.llm.toxicity import fit_nnpu, score_toxicity, train_toxicity


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


@pytest.mark.parametrize("limit", [0, 10, 10**6])
def test_components(spark, limit):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(200 + i, 201 + i) for i in range(60)] + [(300, k) for k in range(301, 340)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), limit).collect()}
    groups = Groups()
    for a, b in edges:
        groups.union(a, b)
    assert set(found) == {x for e in edges for x in e}
    for a in found:
        assert groups.find(found[a]) == groups.find(a)
    assert len({found[a] for a in found}) == len({groups.find(a) for a in found})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_roots():
    hits = np.zeros((5, 5), bool)
    hits[0, 3] = hits[3, 0] = hits[3, 4] = hits[4, 3] = True
    assert component_roots(hits).tolist() == [0, 1, 2, 0, 0]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:320], rng.integers(0, 2**63, 80, dtype=np.uint64)]))
    s = signatures([a, b, a[:1], np.empty(0, np.uint64)], 2048)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.05
    assert (s[2] != np.iinfo(np.uint64).max).all()
    assert 1 - (1 - 0.8**8) ** choose_bands(0.8, 0.9995, 8) >= 0.9995


def test_agreement_in_a_bucket():
    """Linked pairs are found through each other; what only a hash collision brought together stays apart."""
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    chain = [base]
    for _ in range(4):
        chain.append(np.unique(np.concatenate([chain[-1][: int(0.95 * len(base))], rng.integers(0, 2**63, 15, dtype=np.uint64)])))
    other = np.unique(np.concatenate([base[:170], rng.integers(0, 2**63, 130, dtype=np.uint64)]))  # a similarity of 0.4
    bins = mix64(signatures([*chain, other], 336)).astype(np.uint8)
    order = rng.permutation(6)
    roots = agreeing_groups(bins[order], least_agreement(336, 0.8))
    place = {k: i for i, k in enumerate(order.tolist())}
    assert len({roots[place[k]] for k in range(5)}) == 1 and roots[place[5]] == place[5]


@pytest.mark.parametrize("bucket", [4096, 2])
def test_ngram_join_by_either_bucket(spark, monkeypatch, bucket):
    monkeypatch.setattr("casegraph.llm.ngram_join.BUCKET", bucket)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = [(i, " ".join([*base[:k], "new", *base[k:]])) for i, k in enumerate(range(0, 200, 20))] + [(100, " ".join(f"v{i}" for i in range(50)))]
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {**{i: (0, 9) for i in range(10)}, 100: (100, 0)}


def test_similar_is_exact():
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 40))], np.uint64)) for _ in range(40)] + [np.arange(50, dtype=np.uint64)] * 12
    found = similar(sets, 0.8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert found[i, j] == (jaccard(set(a.tolist()), set(b.tolist())) >= 0.8)


def near_docs():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(40 if g == 0 else 4):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += ["", None, "  ", "two words", "two words", "two  words", " ".join(rng.choice(words) for _ in range(5000))]
    rows += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_ngram_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("casegraph.llm.ngram_join.BLOCK_ROWS", 8)  # large groups are cut into blocks
    rows = near_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    sets = {i: shingles(t) for i, t in rows}
    links, groups = dict.fromkeys(sets, 0), Groups()
    for i in sets:
        groups.find(i)
        for j in sets:
            if i < j and sets[i] and jaccard(sets[i], sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                groups.union(i, j)
    found = {r["doc_id"]: r for r in ngram_join(docs).collect()}
    assert set(found) == set(sets)
    assert {i: r["n_links"] for i, r in found.items()} == links
    assert {i: r["class_id"] for i, r in found.items()} == {i: groups.find(i) for i in sets}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if groups.find(i) == i)


def test_ngram_join_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (4, text + " more"), (5, None), (5, ""), (6, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["copies"]) for r in ngram_join(docs).collect()), key=str)
    assert found == sorted([(1, 1, 3, 3), (1, 1, 3, 3), (None, 1, 3, 3), (4, 1, 3, 1), (5, 5, 0, 1), (5, 5, 0, 1), (6, 6, 0, 1)], key=str)
    assert sorted((str(r["doc_id"]), r["text"] is None) for r in keep_one(docs).collect()) == [("1", False), ("5", False), ("5", True), ("6", False)]
    assert ngram_join(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0
    assert len(ngram_set("a b c d e f")) == 2 and len(ngram_set("a b")) == 1 and len(ngram_set(" ")) == 0


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("casegraph.llm.embedding_dedup.BLOCK_ROWS", 16)
    rng = np.random.default_rng(9)
    vectors = []
    for label_, groups, size, noise in ((0, 3, 60, 0.13), (1, 20, 3, 0.1), (2, 60, 1, 0)):
        for _ in range(groups):
            base = rng.standard_normal(16)
            base /= np.linalg.norm(base)
            vectors += [(base + noise * rng.standard_normal(16) / 4, label_) for _ in range(size)]
    rows = [(i, [float(np.float32(x)) for x in v], int(y)) for i, (v, y) in enumerate(vectors)]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, [2 * x for x in rows[0][1]], 0), (n + 2, rows[0][1], 1), (n + 3, rows[0][1], None), (n + 4, rows[0][1], None), (n + 5, None, 0)]
    rows += [(n + 6, [0.0] * 16, 0), (n + 7, [0.0] * 16, 0), (n + 8, [float("nan")] * 16, 0), (n + 9, [float("inf")] + [0.0] * 15, 0), (n + 10, [None] + [1.0] * 15, 0), (n + 11, [], 0), (n + 12, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).repartition(5)
    good = {}
    for i, v, y in rows:
        if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, float) / np.linalg.norm(np.array(v, float)), y)
    links, groups = {i: 0 for i, *_ in rows}, Groups()
    for i, (a, y) in good.items():
        for j, (b, z) in good.items():
            if i < j and y == z and len(a) == len(b) and a @ b >= 0.98:
                links[i] += 1
                links[j] += 1
                groups.union(i, j)
    found = {r["vec_id"]: r for r in embedding_dedup(df, window=8).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == links
    assert {i: r["component_id"] for i, r in found.items()} == {i: groups.find(i) for i in links}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert embedding_dedup(df.limit(0)).count() == 0
    assert passes_for(10**9) > passes_for(10**4) >= 4


@pytest.mark.parametrize("block_rows", [512, 16])
def test_dense_labels_lose_no_links(spark, monkeypatch, block_rows):
    """Vectors of one label that share a direction: in blocks, and (smaller blocks) by measured passes."""
    monkeypatch.setattr("casegraph.llm.embedding_dedup.BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(4)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    rest = unit(rng.standard_normal((2600, 64)))
    shared = unit(rng.standard_normal(64))
    base = unit(np.sqrt(0.8) * shared + np.sqrt(0.2) * rest)
    away = unit(rng.standard_normal((400, 64)))
    vectors = unit(np.concatenate([base, base[:400] + 0.196 * unit(away - (away * base[:400]).sum(1, keepdims=True) * base[:400])]))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").repartition(5)
    expected = (vectors @ vectors.T >= 0.98).sum(axis=1) - 1
    assert expected.sum() >= 800
    found = np.array([r["n_links"] for r in embedding_dedup(df).orderBy("vec_id").collect()])
    assert (found <= expected).all()
    assert found.sum() == expected.sum() if block_rows == 512 else found.sum() >= 0.995 * expected.sum()


def toxic_docs(n=1500):
    rng = random.Random(11)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        bad = rng.random() < 0.12
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["Blarg!", "zonk" + rng.choice("abcdef"), "fnord."]))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.6:
            labels.append((i, int(bad), 1))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_docs()
    docs = spark.createDataFrame([*rows, (None, None), (9000, ""), (9001, "blarg")], "doc_id long, text string").withColumn("features", F.lit(1))
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    model = train_toxicity(docs, table)
    scored = score_toxicity(docs, model)
    assert scored.columns == [*docs.columns, "score"]
    scores = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert len(scores) == len(rows) + 3 and all(0 <= s <= 1 for s in scores.values())
    truth = {i: y for i, y, _ in labels}
    import zlib

    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.7) == truth[i] for i in held]) > 0.97
    # Labels of the held-out fold change nothing.
    flipped = table.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = train_toxicity(docs, flipped)
    assert (again.weights == model.weights).all() and again.bias == model.bias
    none = table.filter("toxic = 0")
    assert train_toxicity(docs, none) is None
    assert {r["score"] for r in score_toxicity(docs, None).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_risk_is_corrected():
    """Positives inside the unlabelled sample don't teach the model that their feature is clean."""
    positive = [np.array([1, 5], np.int32)] * 50
    unlabelled = [np.array([5], np.int32)] * 160 + [np.array([1, 5], np.int32)] * 40
    model = fit_nnpu(positive, unlabelled, 0.2)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert model.bias + weight[1] > 0 > model.bias and 5 not in weight


def test_risk_gradient_against_differences():
    """One step of the fit moves each weight against the numerical gradient of the risk it states."""
    positive = [np.array([1, 2], np.int32)] * 30 + [np.array([2], np.int32)] * 10
    unlabelled = [np.array([1], np.int32)] * 5 + [np.array([9], np.int32)] * 95
    for prior in (0.05, 0.9):  # a negative part above and below 0
        one = fit_nnpu(positive, unlabelled, prior, steps=1)
        place = {f: i for i, f in enumerate(one.features.tolist())}

        def risk(w, b):
            def loss(texts, sign):
                s = np.array([b + sum(w[place[f]] for f in t.tolist() if f in place) for t in texts])
                return np.logaddexp(0, -sign * s).mean()

            negative = loss(unlabelled, -1) - prior * loss(positive, -1)
            return prior * loss(positive, 1) + negative if negative >= 0 else -negative

        zero, h = np.zeros(len(place)), 1e-5
        slopes = [(risk(zero + h * np.eye(len(place))[k], 0.0) - risk(zero - h * np.eye(len(place))[k], 0.0)) / (2 * h) for k in range(len(place))]
        assert len(place) >= 2 and all(np.sign(w) == -np.sign(g) for w, g in zip(one.weights, slopes, strict=True))
        assert np.sign(one.bias) == -np.sign(risk(zero, h) - risk(zero, -h))


def test_samples_are_bounded(spark):
    """An id in a third of all rows, repeated rows, and long texts don't fill the task that fits."""
    rows = [(7, f"t{i}") for i in range(300)] + [(1, "same")] * 300 + [(i, "w" * 50) for i in range(1000, 1300)]
    texts = spark.createDataFrame(rows, "id long, t string").repartition(6)
    found = sample_texts(texts, 100, 10**6, 3, len(rows)).collect()
    again = sample_texts(texts.repartition(2), 100, 10**6, 3, len(rows)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and 60 <= len(found) <= 100
    assert len({(r["id"], r["t"]) for r in found}) == len(found)
    assert sum(len(r["t"]) for r in sample_texts(texts, 600, 1000, 3).collect()) <= 1000
    assert sample_texts(texts.limit(0), 10, 10, 3, 0).count() == 0


def test_models_on_odd_tables(spark):
    text = "plain words of a text"
    rows = [(1, text), (1, text), (1, "x " * 60_000), (2, "Blarg blarg"), (3, "blarg blarg"), (4, "zz blarg"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("slot", F.lit(1)).withColumn("t", F.lit(2))
    table = spark.createDataFrame([(i, int(i > 1), int(i == 1)) for i in range(1, 6)] * 2, "doc_id long, toxic int, quality int")
    for train, score in ((train_toxicity, score_toxicity), (train_quality, score_quality)):
        scored = score(docs, train(docs, table))
        assert sorted(scored.columns) == sorted(docs.columns)
        found = scored.collect()
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
        assert len({r["score"] for r in found if r["text"] == text}) == 1
        assert train(docs.limit(0), table) is None
        assert score(docs.limit(0), train(docs, table)).count() == 0 and score(docs, None).count() == len(rows)


def test_vote_against_a_loop():
    rng = np.random.default_rng(3)
    references = rng.standard_normal((60, 8)).astype(np.float32)
    references[30:40] = references[20:30]  # ties
    references /= np.linalg.norm(references, axis=1, keepdims=True)
    model = QualityModel(np.empty(0), np.empty(0), np.empty(0), references, rng.integers(0, 2, 60).astype(np.float32))
    vectors = np.concatenate([rng.standard_normal((20, 8)), references[20:25], np.zeros((1, 8))]).astype(np.float32)
    for found, v in zip(vote(model, vectors, 7, 4), vectors, strict=True):
        near = sorted(((-round(float(v.astype(float) @ r.astype(float)), 6), i) for i, r in enumerate(references)))[:7]
        weights = [max(-s, 0) ** 4 for s, _ in near]
        expected = sum(w * model.labels[i] for w, (_, i) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) else model.labels.mean()
        assert abs(found - expected) < 1e-4


def test_quality_hears_words():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "dolor"]) if rng.random() < 0.7 else rng.choice(["good", "fine"] if y else ["poor", "weak"]) for _ in range(40)) for y in [0, 1] * 150]
    known = Remembered(piece_terms)
    found = [text_terms(t, known) for t in texts]
    model = fit_quality(found[:200], np.array([0, 1] * 100))
    scores = vote(model, _directions(_rows(found[200:], model.terms, model.weights), model.axes))
    assert ((scores >= 0.5) == np.array([0, 1] * 50)).mean() > 0.95


def test_quality(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        text = [("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))) for _ in range(rng.randrange(5, 120))]
        rows.append((i, " ".join(text if good else [f"{w.upper()}!!" for w in text])))
        if rng.random() < 0.5:
            labels.append((i, 0, int(good)))
    docs = spark.createDataFrame([*rows, (None, None), (9000, " "), (9001, "w " * 20_000)], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, toxic int, quality int")
    model = train_quality(docs, table)
    scores = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    assert len(scores) == len(rows) + 3 and all(0 <= s <= 1 for s in scores.values())
    truth = {i: y for i, _, y in labels}
    assert np.mean([(scores[i] >= 0.3) == truth[i] for i in truth]) > 0.98
    assert train_quality(docs, table.limit(0)) is None
    assert {r["score"] for r in score_quality(docs, None).collect()} == {0.0}


ARTICLE = (
    '<html><head><title>T</title></head><body><header class="site-header"><a href="/">Home</a></header><nav><ul><li><a>M</a></ul></nav>'
    '<div class="cookie-notice">Cookies</div><main><article><header><h1>Title %s</h1></header><p>One %s <span class="ad">Buy</span> and <b>more</b><p>Two &lt;x&gt; %s'
    '<form>Name<input></form><aside>side</aside><section id="comments"><p>nice!</p></section><footer>tags</footer></article></main>'
    '<div id="sidebar"><p>Side text</p></div><footer>&copy;</footer><script>var t="</p>";</script></body></html>'
)
PLAIN = (
    '<body><div id=top><a href=1>A</a> <a href=2>B</a></div><div class="wrap"><div class="content"><h1>Head %s</h1><p>Long text %s of the page, its main part by far.</p>'
    "<ul><li>i %s<li>j</ul><div>Read our other stories</div></div><div class=box><p>small</p></div></div><div>Imprint</div></body>"
)


def test_marked_article():
    assert extract(ARTICLE % (1, 2, 3), None) == "Title 1\nOne 2 and more\nTwo <x> 3"


def test_wrapper_of_a_host(spark):
    rows = [(i, f"http://a.example/{i}", ARTICLE % (i, i, i)) for i in range(6)] + [(10 + i, f"https://B.example:80/{i}", PLAIN % (i, i, i)) for i in range(6)]
    rows += [(30, None, PLAIN % (1, 2, 3)), (31, "no host", "just text"), (32, "http://a.example/x", None), (33, "http://a.example/y", ""), (10, "https://b.example:80/0", PLAIN % (0, 0, 0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("wrapper", F.lit("w"))
    for limit in (10**9, 0):
        found = extract_main_text(pages, broadcast_bytes=limit)
        assert found.columns == [*pages.columns, "text"]
        texts = {r["page_id"]: r["text"] for r in found.collect()}
        assert texts[3] == "Title 3\nOne 3 and more\nTwo <x> 3"
        # The same text on every page of the host is template; a page alone cannot know that.
        assert texts[12] == "Head 2\nLong text 2 of the page, its main part by far.\ni 2\nj"
        assert texts[30].endswith("Read our other stories")
        assert (texts[31], texts[32], texts[33]) == ("just text", "", "")
        assert found.count() == len(rows)
    assert extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [10, 140, 149, 150, 200, 5000])
def test_depth_loses_nothing(depth):
    noise = '<footer>tags</footer><nav><ul><li><a>M</a></ul></nav><aside><div>side</div></aside><section id="comments"><p>nice!</p></section>'
    deep = "<div>" * depth + "<p>one<p>two" + noise + "<p>three" + "</div>" * depth
    after = "<p>four</p><div><p>five</p></div>"
    whole = "one\ntwo\nthree\nfour\nfive"
    assert extract(f"<body><article>{deep}{after}</article><p>outside</p></body>", None) == whole
    inner = "<div>" * depth + f"<article><p>one<p>two{noise}<p>three</article>" + "</div>" * depth
    assert extract(f"<body>{inner}<p>outside</p></body>", None) == "one\ntwo\nthree"


@pytest.mark.parametrize("tag", ["div", "x", "tbody"])
def test_deep_pages_take_linear_time(tag):
    began = time.perf_counter()
    Page(f"<{tag}>" * 60_000 + "<p>a" + "</y>" * 60_000 + "<p>b" * 1000)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("words", [5, 400])
def test_template_of_any_length(spark, words):
    template = "same words on every page " * words
    page = '<body><div><div class="text"><p>%s</p></div><div class="box">' + template + "</div></div></body>"
    own = [f"article {i} " + f"own words of number {i} " * words for i in range(5)]
    pages = spark.createDataFrame([(i, f"http://t.example/{i}", page % own[i]) for i in range(5)], "page_id long, url string, html string").repartition(3)
    assert [r["text"] for r in extract_main_text(pages).orderBy("page_id").collect()] == [t.strip() for t in own]


def brute_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    return table[0][0]


def test_alignment_against_brute_force():
    rng = random.Random(1)
    for _ in range(2000):
        letters = "abcdef"[: rng.randrange(1, 7)]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(14))] for _ in range(2))
        found = common(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x < y and v < w for (x, v), (y, w) in zip(found, found[1:], strict=False))
        assert len(found) == brute_length(a, b)


def test_very_long_pages():
    rng = random.Random(2)

    def page(words):
        return "<body>" + "".join(f'<{rng.choice(["p", "h2", "pre", "ul"])} class={rng.choice("abcdefgh")}>{words} {i}' for i in range(20_000))

    began = time.perf_counter()
    wrapper = label(merge_wrappers(__import__("json").dumps(page_expression(Page(page(w))).pack()) for w in "xyz"))
    assert len(extract(page("w"), wrapper)) > 10_000
    assert time.perf_counter() - began < 60


def test_hints_are_judged_by_what_is_there():
    """A class name that only hints at noise deletes neither prose nor the article's frame."""
    prose = "Earlier studies have looked at this in other ways. " * 20
    links = "".join(f"<a href=/{i}>story number {i}</a> " for i in range(30))
    page = f'<body><article><p>Text of its own.</p><section class="related-work"><p>{prose}</p></section><div class="related">{links}</div><div class="entry-social-widget">Share</div></article></body>'
    assert extract(page, None) == "Text of its own.\n" + prose.strip()
    assert extract('<body><article><div class="widget"><p>All the text</p></div><div class="share">Tell</div></article></body>', None) == "All the text"
    assert extract(f'<body><article><p>One</p><div class="comments"><p>{prose}</p></div></article></body>', None) == "One"


def test_expressions_of_a_host_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr("casegraph.llm.html_extraction.FAN", 3)
    pages = [(i, f"http://h.example/{i}", "<body><div id=nav><a href=1>A</a></div><div class=c>" + "".join(f"<p class={c}>{c} {i}</p>" for c in "abcdefgh" if (i + 1) * 37 >> ord(c) - 97 & 1) + "<div>Same end</div></div>") for i in range(24)]
    found = extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()
    assert {r["page_id"]: r["text"] for r in found} == {i: "\n".join(f"{c} {i}" for c in "abcdefgh" if (i + 1) * 37 >> ord(c) - 97 & 1) for i, *_ in pages}


def test_expression_is_union_free():
    import json

    pages = ["<div><h1>a</h1><p>x</p><p>y</p></div>", "<div><p>z</p></div>", "<div><h1>b</h1><table></table><p>w</p></div>", "<dl><dt>a<dd>b<dt>c<dd>d</dl>"]
    packed = [json.dumps(page_expression(Page(p)).pack()) for p in pages]
    assert label(merge_wrappers(packed[:3])).expression() == "<#page> <div> (<h1> # </>)? (<table/>)? (<p> # </>)+ </> </>"
    assert merge_wrappers(packed[3:]).expression() == '<#page> <dl> (( <dt> # </> <dd> # </> ))+ </> </>'


@pytest.mark.parametrize("page", ["<", "<p", '<a href="x', "</div>", "<!-- x", "<script>x", "<div><p>x</div></div></p>y", "<![CDATA[a<b]]>", "<" * 2000, "<div>" * 3000 + "deep"])
def test_broken_markup_never_raises(page):
    assert isinstance(extract(page, None), str)


@pytest.mark.parametrize("rows", [0, 12])
def test_pipeline_stages_on_odd_tables(spark, tmp_path, rows):
    """Empty tables, repeated rows, nulls everywhere, and columns named like the operators' own."""
    import corpus_pipeline

    text = "\n".join(f"line {i} of a text" for i in range(9))
    given = [(1, text, "en", "s", 5)] * 5 + [(2, "blarg " + text, None, None, None), (None, text, "en", "s", 1), (3, None, None, None, None), (3, "", "en", "s", 0), (4, "one\ntwo", "en", "t", 1), (5, "word " * 30_000, "en", "t", 9), (6, "blarg", "en", "t", 9)]
    names = ("score", "toxicity_score", "rid", "version", "removed", "position", "words", "size", "part", "rversion")
    docs = spark.createDataFrame(given[:rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit("clash") for n in names})
    spark.createDataFrame([(2, 1), (6, 1), (1, 0), (None, 1), (4, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, current, str(tmp_path))
        assert following.columns == docs.columns
        found = following.collect()
        assert all(r[n] == "clash" for r in found for n in names)
        if name != "mixing":
            assert len(found) == current.count() or (name, rows) == ("ngram_join", 12)
        current = spark.createDataFrame(found, following.schema)
    assert bool(rows) == bool(corpus_pipeline.STAGES[-1][1](spark, current, str(tmp_path)).count())


def test_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(13)
    passage = "shared line one of many\nshared line two of many\nshared line three of many"
    docs = []
    for i in range(250):
        words = [f"v{rng.randrange(500)}" for _ in range(80)]
        text = " ".join(words)
        if i % 10 == 0:
            text = text + " blarg zonk fnord"
        if i % 7 == 0:
            text = passage + "\n" + text
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
    docs += [(300 + k, docs[3][1] + f" tail{k}", "en", "s0", 1) for k in range(3)] + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    import tempfile

    folder = tempfile.mkdtemp()
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(250)], "doc_id long, quality int, toxic int")
    table.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "bpe"]
    current, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, folder)
        if name != "bpe":
            assert current.columns == table.columns
        seen[name] = current.collect()
    left = {r["doc_id"] for r in seen["toxicity"]}
    assert not left & {i for i in range(0, 250, 10)} and {i for i in range(250) if i % 10} <= left and {400, 401} <= left
    assert sum((r["text"] or "").startswith("shared line one") for r in seen["line_dedup"]) == 1
    assert {r["doc_id"] for r in seen["ngram_join"]} & {3, 300, 301, 302} == {3}
    assert {r["doc_id"] for r in seen["line_dedup"]} - {r["doc_id"] for r in seen["ngram_join"]} == {300, 301, 302}
    words = sum(len((r["text"] or "").split()) for r in seen["ngram_join"])
    assert abs(sum(len(r["text"].split()) for r in seen["mixing"]) - 1.5 * words) < 5
    assert all(r["n_tokens"] == len(r["ids"]) for r in seen["bpe"]) and len(seen["bpe"]) == len(seen["mixing"])
    assert corpus_pipeline.run(spark, folder).count() == len(seen["bpe"])

"""Toxicity by non-negative positive-unlabelled learning.

The learner sees two bounded, hash-chosen samples: texts confirmed as toxic (P)
and texts of the corpus whose labels it does not look at (U). With the class
prior ``pi`` it minimises, for a linear model on word features,

    pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)])

so that toxic texts inside U are accounted for, and takes the step back that
the estimator prescribes when the second part turns negative (the model has
begun to fit U's toxic texts as clean). The prior is the share of toxic ones
among the labelled rows that may be learned from.

Features of a text are which words occur and which word beginnings of three to
six letters, so that a stem with new endings is known. Features that are
clearly more frequent in P than in U are kept; all others have weight 0.

Learning looks at most at ``POSITIVES`` and ``UNLABELLED`` texts, and of each at
most at ``FIT_CHARS`` characters together (documented bounds of the sample, not
of what is scored; texts are taken whole or not at all): every row of the table
is scored, over its whole text, in one pass without a shuffle.

Results for odd input: a null or empty text has no features and gets the
model's base score; without any confirmed toxic text, every score is 0; a
document with several label rows is toxic if one of them says so; label rows
with null ids or null labels are ignored; a null id is scored like any other;
repeated rows are scored each, and learned from once; equal texts have equal
scores; a very long text is scored whole; an empty table gives no model and an
empty result; other columns pass through, and one named like the score column
is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm.common import Remembered, text_of, worker_memory
from casegraph.llm.labelled import fit_in_one_task, remainder, sample_ids, sample_texts

POSITIVES = 6_000
UNLABELLED = 12_000
FIT_CHARS = 64_000_000
FEATURE_SPACE = 1 << 22
STEPS = 400
REJECT = 0.7
SEED = 6

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings.
_STEMS = (3, 4, 5, 6)


def piece_features(piece: str) -> tuple[int, ...]:
    """Feature numbers of the words in a piece of lower-case text between white space."""
    found = []
    for word in _WORD.findall(piece):
        found.append(zlib.crc32(f"{word} ".encode()) % FEATURE_SPACE)
        found += [zlib.crc32(word[:k].encode()) % FEATURE_SPACE for k in _STEMS if len(word) > k]
    return tuple(found)


def text_features(text: str, pieces: Remembered) -> np.ndarray:
    found: set[int] = set()
    for piece in set(text.lower().split()):
        found.update(pieces[piece])
    return np.fromiter(found, np.int32, len(found))


@dataclass
class ToxicityModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


class _Adam:
    def __init__(self, n: int, rate: float = 0.05):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> ToxicityModel:
    """Fit the linear model by the non-negative risk estimator."""
    n_p, n_u = len(positive), len(unlabelled)
    df_p = np.bincount(np.concatenate(positive), minlength=FEATURE_SPACE)
    df_u = np.bincount(np.concatenate(unlabelled), minlength=FEATURE_SPACE) if n_u else np.zeros(FEATURE_SPACE, int)
    seen = np.flatnonzero(df_p >= 3)
    p, u = (df_p[seen] + 0.5) / (n_p + 1), (df_u[seen] + 0.5) / (n_u + 1)
    z = (p - u) / np.sqrt(u * (1 - u) * (1 / n_p + 1 / max(n_u, 1)) + 1e-12)
    chosen = seen[(p > 1.5 * u) & (z > 4)]
    place = np.full(FEATURE_SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def sparse(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        column = place[np.concatenate(texts)] if texts else np.empty(0, int)
        return owner[column >= 0], column[column >= 0], len(texts)

    rows_p, rows_u = sparse(positive), sparse(unlabelled)
    w, b, adam = np.zeros(len(chosen)), 0.0, _Adam(len(chosen) + 1)

    def margins(rows: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        return b + np.bincount(rows[0], weights=w[rows[1]], minlength=rows[2])

    for _ in range(steps):
        s_p, s_u = margins(rows_p), margins(rows_u)
        negative_part = np.logaddexp(0, s_u).sum() / max(n_u, 1) - prior * np.logaddexp(0, s_p).mean()
        as_positive, as_negative = -(1 - _sigmoid(s_p)) / n_p, _sigmoid(s_p) / n_p
        from_u = _sigmoid(s_u) / max(n_u, 1)
        if negative_part >= 0:
            g_p, g_u = prior * as_positive - prior * as_negative, from_u
        else:  # the step back: raise the negative part towards 0
            g_p, g_u = prior * as_negative, -from_u
        gradient = np.bincount(rows_p[1], weights=g_p[rows_p[0]], minlength=len(chosen))
        gradient = gradient + np.bincount(rows_u[1], weights=g_u[rows_u[0]], minlength=len(chosen)) + 1e-4 * w
        change = adam.step(np.append(gradient, g_p.sum() + g_u.sum()))
        w, b = w - change[:-1], b - change[-1]
    return ToxicityModel(chosen, w, float(b), prior)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    modulus: int = 3,
    held_out: int = 1,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    fit_chars: int = FIT_CHARS,
) -> ToxicityModel | None:
    """Learn from documents outside the held-out fold; None if no document is confirmed toxic."""
    usable = remainder(id_col, modulus) != held_out
    known = (
        labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).alias("toxic"))
    )
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    if not n_toxic:
        return None
    texts = docs.filter(usable).select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    toxic_ids = sample_ids(known.filter("toxic = 1").select("id"), positives, SEED)
    confirmed = sample_texts(texts.join(F.broadcast(toxic_ids), "id"), positives, fit_chars, SEED)
    pool = sample_texts(texts, unlabelled, fit_chars, SEED + 1, texts.count())
    drawn = confirmed.withColumn("p", F.lit(1)).unionByName(pool.withColumn("p", F.lit(0)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_memory("toxicity").setdefault("pieces", Remembered(piece_features, 100_000))
        for batch in batches:
            sets = [text_features(t.as_py(), pieces) for t in batch.column("t")]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("slot"), lists], names=["p", "slot", "f"])

    rows = drawn.select("p", "slot", "t").mapInArrow(features, "p int, slot long, f array<int>")
    prior = n_toxic / n_known

    def fit(table: pa.Table) -> ToxicityModel | None:
        def part(p: int) -> list[np.ndarray]:
            own = [(s, np.sort(np.asarray(f.values))) for q, s, f in zip(table.column("p").to_pylist(), table.column("slot").to_pylist(), table.column("f"), strict=True) if q == p]
            own.sort(key=lambda x: x[0])
            return [f for _, f in own]

        confirmed = part(1)
        return fit_nnpu(confirmed, part(0), prior) if confirmed else None

    return fit_in_one_task(rows, fit)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic."""
    kept = [c for c in docs.columns if c.lower() != score_col.lower()]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score_col, T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        worker_memory("toxicity scores")
        weight = dict(zip(own.features.tolist(), own.weights.tolist(), strict=True)) if own else {}
        pieces = Remembered(lambda piece: tuple(f for f in piece_features(piece) if f in weight))
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if own:
                for start in range(0, batch.num_rows, 256):
                    for i, text in enumerate(batch.column(text_col).slice(start, 256).to_pylist(), start):
                        found = {f for piece in set((text or "").lower().split()) for f in pieces[piece]}
                        scores[i] = own.bias + sum(weight[f] for f in sorted(found))
                scores = _sigmoid(scores)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(scores)], names=[*kept, score_col])

    return docs.select(*[docs[c] for c in kept]).mapInArrow(run, schema)

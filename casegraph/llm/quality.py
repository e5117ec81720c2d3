"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes counts of terms: its words (lower case), the shape of every piece
between white space (letters by case, digits and runs shortened, signs kept),
pairs of neighbouring shapes, repeats of the piece before, and distinct pieces.
Counts are shares of the text's pieces, square-rooted and weighted by inverse
document frequency. A truncated singular value decomposition of labelled texts
gives the latent space. The labelled texts' vectors are broadcast (their number
is bounded by ``REFERENCES``), every document is compared with all of them by
exact cosine, in blocks of documents, and the labels of the nearest
``NEIGHBOURS`` vote with a power of their similarity.

Learning looks at no more than ``REFERENCES`` labelled texts outside the
held-out fold with ``FIT_CHARS`` characters together (documented bounds of the
sample); every row of the table is scored over its whole text in one pass
without a shuffle.

Ties: of references at equal similarity the first ones, in the order of their
hashes, vote; similarities are rounded to six digits before they are compared,
so that the order in which a product is summed up decides nothing.

Results for odd input: a null or empty text has no direction and gets the share
of label 1 among the references; without any usable label every score is 0; a
document with several label rows takes their rounded mean; label rows with null
ids or null labels are ignored; repeated rows and null ids are scored like any
other, and learned from once; a very long text is scored whole; an empty table
gives no model and an empty result; other columns pass through, and one named
like the score column is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm.common import Remembered, text_of, worker_memory
from casegraph.llm.labelled import fit_in_one_task, remainder, sample_ids, sample_texts

REFERENCES = 4096
FIT_CHARS = 64_000_000
NEIGHBOURS = 15
DIMENSIONS = 64
POWER = 4
#: Numbers of shapes and pairs of shapes; words have as many more.
TERM_SPACE = 1 << 15
#: Terms of the latent space, of either kind: the most frequent ones that occur in two texts at least.
TERMS = 2048
#: What a word counts beside its shape.
WORD_SHARE = 0.25
ACCEPT = 0.3
SEED = 10
BLOCK = 512

_LETTERS, _DIGITS, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def _case(match: re.Match) -> str:
    word = match[0]
    if word.isupper() and len(word) > 1:
        return "A"
    return "C" if word[0].isupper() else "a"


def shape(piece: str) -> str:
    """``Word,`` -> ``C,``; ``WORD!!`` -> ``A!!``; ``ab1234`` -> ``a0``; longer runs of a sign become two."""
    return _RUN.sub(r"\1\1", _DIGITS.sub("0", _LETTERS.sub(_case, piece)))


def _number(term: str) -> int:
    return zlib.crc32(term.encode()) % TERM_SPACE


def piece_terms(piece: str) -> tuple[int, tuple[int, ...]]:
    """The term number of a piece's shape, and those of its words, which have a space of their own."""
    return _number(shape(piece)), tuple(TERM_SPACE + _number(word) for word in _LETTERS.findall(piece.lower()))


_AGAIN, _DISTINCT = _number("= again"), _number("= distinct")


def text_terms(text: str, known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, ascending, and their shares of the text's pieces; ``known`` remembers ``piece_terms``."""
    pieces = text.split()
    n = len(pieces)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    found = [known[p] for p in pieces]
    forms = np.array([f for f, _ in found], np.int64)
    pairs = ((forms[:-1] * 40_503 + forms[1:]) * 2_654_435_761 >> 16) % TERM_SPACE
    words = np.array([w for _, ws in found for w in ws], np.int64)
    numbers = np.concatenate([forms, pairs, words, [_AGAIN, _DISTINCT]])
    counts = [1.0] * 3 + [2.0 * sum(map(eq, pieces, pieces[1:])), float(len(set(pieces)))]
    shares = np.repeat(np.array(counts) * [1, 0.5, WORD_SHARE, 1, 1] / n, [n, n - 1, len(words), 1, 1])
    terms, place = np.unique(numbers, return_inverse=True)
    return terms.astype(np.int32), np.bincount(place, weights=shares).astype(np.float32)


@dataclass
class QualityModel:
    terms: np.ndarray  # term numbers, ascending
    weights: np.ndarray  # inverse document frequencies
    axes: np.ndarray  # terms x dimensions
    references: np.ndarray  # unit vectors of the labelled texts
    labels: np.ndarray


def _rows(texts: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), len(terms)), np.float32)
    if not len(terms):
        return out
    for row, (numbers, shares) in zip(out, texts, strict=True):
        at = np.minimum(np.searchsorted(terms, numbers), len(terms) - 1)
        known = terms[at] == numbers
        row[at[known]] = np.sqrt(shares[known]) * weights[at[known]]
    return out


def _directions(matrix: np.ndarray, axes: np.ndarray) -> np.ndarray:
    out = matrix @ axes
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-12)


def fit_quality(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS) -> QualityModel:
    """Latent semantic axes by a randomised singular value decomposition with power steps."""
    df = np.bincount(np.concatenate([t[0] for t in texts]), minlength=2 * TERM_SPACE)
    kinds = np.split(np.argsort(-df.reshape(2, TERM_SPACE), axis=1, kind="stable")[:, :TERMS], 2)
    frequent = np.concatenate([kinds[0][0], TERM_SPACE + kinds[1][0]])
    terms = np.sort(frequent[df[frequent] >= min(2, len(texts))]).astype(np.int32)
    weights = (np.log((1 + len(texts)) / (1 + df[terms])) + 1).astype(np.float32)
    matrix = _rows(texts, terms, weights)
    start = np.random.default_rng(SEED).standard_normal((matrix.shape[1], dimensions + 10)).astype(np.float32)
    basis = matrix @ start
    for _ in range(4):
        basis = matrix @ (matrix.T @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    axes = np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:dimensions].T.copy()
    return QualityModel(terms, weights, axes, _directions(matrix, axes), labels.astype(np.float32))


def vote(model: QualityModel, vectors: np.ndarray, neighbours: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
    """Share of label 1 among the nearest references, weighted by similarity to ``power``."""
    k = min(neighbours, len(model.labels))
    # Similarity in millionths, then the place: keys are distinct, so the nearest ones are the same however they are found.
    places = len(model.labels)
    near = np.rint((vectors @ model.references.T).astype(np.float64) * 1e6).astype(np.int64)
    rank = near * places + (places - 1 - np.arange(places))
    top = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
    weight = np.maximum(np.take_along_axis(near, top, axis=1) / 1e6, 0) ** power
    total = weight.sum(axis=1)
    voted = (weight * model.labels[top]).sum(axis=1)
    return np.divide(voted, total, out=np.full(len(vectors), float(model.labels.mean())), where=total > 0).clip(0, 1)


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    modulus: int = 5,
    held_out: int = 0,
    references: int = REFERENCES,
    fit_chars: int = FIT_CHARS,
) -> QualityModel | None:
    """Learn from labelled documents outside the held-out fold; None if there is none."""
    usable = remainder(id_col, modulus) != held_out
    known = (
        labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.round(F.avg(label_col)).cast("int").alias("y"))
    )
    texts = docs.filter(usable).select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    rows = sample_texts(texts.join(F.broadcast(sample_ids(known, references, SEED)), "id"), references, fit_chars, SEED).select("slot", "y", "t")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_memory("quality").setdefault("pieces", Remembered(piece_terms))
        for batch in batches:
            found = [text_terms(t, pieces) for t in batch.column("t").to_pylist()]
            ends = pa.array(np.cumsum([0] + [len(n) for n, _ in found]).astype(np.int32))
            numbers = pa.array(np.concatenate([n for n, _ in found] or [np.empty(0, np.int32)]))
            shares = pa.array(np.concatenate([s for _, s in found] or [np.empty(0, np.float32)]))
            lists = [pa.ListArray.from_arrays(ends, numbers), pa.ListArray.from_arrays(ends, shares)]
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("y"), *lists], names=["slot", "y", "n", "s"])

    def fit(table: pa.Table) -> QualityModel:
        own = [
            (slot, np.asarray(n.values), np.asarray(s.values), y)
            for slot, y, n, s in zip(table.column("slot").to_pylist(), table.column("y").to_pylist(), table.column("n"), table.column("s"), strict=True)
        ]
        own.sort(key=lambda x: x[0])
        return fit_quality([(n, s) for _, n, s, _ in own], np.array([y for *_, y in own]))

    return fit_in_one_task(rows.mapInArrow(terms, "slot long, y int, n array<int>, s array<float>"), fit)


def score_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the vote for label 1 of each whole text."""
    kept = [c for c in docs.columns if c.lower() != score_col.lower()]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score_col, T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces = shared.value, worker_memory("quality").setdefault("pieces", Remembered(piece_terms))
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for start in range(0, batch.num_rows if own else 0, BLOCK):
                found = [text_terms(t or "", pieces) for t in batch.column(text_col).slice(start, BLOCK).to_pylist()]
                vectors = _directions(_rows(found, own.terms, own.weights), own.axes)
                scores[start : start + BLOCK] = vote(own, vectors)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(scores)], names=[*kept, score_col])

    return docs.select(*[docs[c] for c in kept]).mapInArrow(run, schema)

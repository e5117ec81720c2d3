"""BPE encoding and decoding with a tokenizer file.

``BpeCodec.encode`` merges with a priority queue of (rank, position) over a
doubly linked list of symbols; an entry whose symbols have changed since it was
pushed is stale and skipped. ``decode`` concatenates vocabulary strings (the
file names no decoder, so they are joined by one space, as its library does).

White space ends every word of this kind of file, so the text between white
space is encoded once and remembered: a text is then a join of byte strings.
That short cut is taken only for texts of plain characters (below); any other
text is normalised and split by the library's own normaliser and splitter, as
these define the result, and then merged here word by word.

Results for odd input: a null text is an empty text; an empty text has no ids
and decodes to an empty text; texts of any length are encoded whole; ids and
other columns pass through, repeated and null ones too; an empty table gives an
empty result; a column of the input named like an output column is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from casegraph.llm.common import Remembered, fresh, worker_memory

#: Characters on which Python and the library agree about case, normal form and white space.
_PLAIN = re.compile(r"[\t-\r -~¡-įı-ž]*\Z")
#: Characters of text turned into one Arrow batch.
BATCH_CHARS = 1_000_000
#: Words, and pieces between white space, that an encoder remembers.
REMEMBERED = 150_000


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def special_strings(spec: dict) -> list[str]:
    return [t["content"] for t in spec.get("added_tokens", [])]


def split_pattern(spec: dict) -> str:
    return next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]


class Splitting:
    """Decides whether a text may be encoded piece by piece between white space."""

    def __init__(self, spec: dict):
        self._specials = special_strings(spec)

    def apart(self, text: str) -> bool:
        return _PLAIN.match(text) is not None and not any(s in text for s in self._specials)


class BpeCodec:
    """Encoder and decoder for one word-level BPE file with byte-level symbols and a word-end suffix."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self._vocab: dict[str, int] = dict(model["vocab"])
        for token in spec.get("added_tokens", []):
            self._vocab[token["content"]] = token["id"]
        self._suffix = model.get("end_of_word_suffix") or ""
        self._strings = [""] * (max(self._vocab.values()) + 1)
        for string, i in self._vocab.items():
            self._strings[i] = string
        self._merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._merges[self._vocab[left], self._vocab[right]] = (rank, self._vocab[left + right])
        self._bytes = byte_symbols()
        library = Tokenizer.from_file(path)
        self._normalise = library.normalizer.normalize_str
        self._presplit = library.pre_tokenizer.pre_tokenize_str
        self._words = regex.compile(split_pattern(spec)).findall
        self._specials = special_strings(spec)
        self._special = re.compile("|".join(map(re.escape, self._specials)) or r"(?!)")
        self._splitting = Splitting(spec)
        self._by_word = Remembered(self._word, REMEMBERED)
        self._by_piece = Remembered(self._piece, REMEMBERED)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge adjacent symbols, lowest rank first and leftmost among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        before, after, alive, merges = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n, self._merges
        queue = []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or symbols[i] != left or symbols[j] != right:
                continue  # stale
            symbols[i], alive[j] = merged, False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((merged, symbols[k])):
                    heapq.heappush(queue, (found[0], i, merged, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((symbols[h], merged))):
                heapq.heappush(queue, (found[0], h, symbols[h], merged, found[1]))
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = after[i]
        return out

    def _word(self, word: str) -> bytes:
        """ids, as little-endian 32-bit integers, of a word spelt in byte symbols."""
        if not word:
            return b""
        vocab = self._vocab
        symbols = [vocab[c] for c in word[:-1]] + [vocab[word[-1] + self._suffix]]
        return np.array(self.merge(symbols), dtype="<i4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spell, by_word = self._bytes, self._by_word
        return b"".join(by_word["".join([spell[b] for b in w.encode()])] for w in self._words(piece))

    def _whole(self, text: str) -> bytes:
        parts, at = [], 0
        for hit in [*self._special.finditer(text), None]:
            between = text[at : hit.start()] if hit else text[at:]
            parts += [self._by_word[w] for w, _ in self._presplit(self._normalise(between))] if between else []
            if hit:
                parts.append(np.array([self._vocab[hit[0]]], dtype="<i4").tobytes())
                at = hit.end()
        return b"".join(parts)

    def encode_bytes(self, text: str) -> bytes:
        if self._splitting.apart(text):
            return b"".join(map(self._by_piece.__getitem__, text.lower().split()))
        return self._whole(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self._strings.__getitem__, ids))


class LibraryCodec:
    """The same interface, encoding with the tokenizers library itself.

    Words of plain texts go straight to the library's model, and ``remembered`` of them are kept; any
    other text goes through the whole library.
    """

    def __init__(self, path: str, remembered: int = 1_000_000):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._splitting = Splitting(spec)
        self._words = regex.compile(split_pattern(spec)).findall
        self._bytes = byte_symbols()
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._model = self._library.model
        self.size = self._library.get_vocab_size()
        self._by_word = Remembered(self._word, remembered)

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() else "".join([self._bytes[b] for b in word.encode()])
        return array("i", [t.id for t in self._model.tokenize(spelt)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._by_word[piece]
        if piece[:-1].isalpha():  # a word and one digit or sign: two words, in every such pattern
            return self._by_word[piece[:-1]] + self._by_word[piece[-1]]
        return b"".join(map(self._by_word.__getitem__, self._words(piece)))

    def encode_bytes(self, text: str) -> bytes:
        if self._splitting.apart(text):
            return b"".join(map(self._piece, text.lower().split()))
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, in views of one array. Arrow splits the plain texts, and each distinct piece among them is looked up once."""
        apart = [self._splitting.apart(t) for t in texts]
        plain = pa.array([t for t, a in zip(texts, apart, strict=True) if a], pa.large_string())
        # On plain characters Arrow's case and white space are Python's; the empty pieces at outer white space have no ids.
        split = pc.ascii_split_whitespace(pc.utf8_lower(plain))
        pieces = split.flatten().dictionary_encode()
        known = list(map(self._piece, pieces.dictionary.to_numpy(zero_copy_only=False)))
        coded = pa.array(known, pa.large_binary()).take(pieces.indices)
        _, places, data = coded.buffers()
        ids = np.frombuffer(data or b"", "<i4")
        ends = (np.frombuffer(places, "<i8")[split.offsets.to_numpy()] // 4).tolist() if len(plain) else [0]
        own = (ids[a:b] for a, b in pairwise(ends))
        return [next(own) if a else np.frombuffer(self.encode_bytes(t), "<i4") for t, a in zip(texts, apart, strict=True)]


def codec(path: str, kind: type = BpeCodec) -> BpeCodec | LibraryCodec:
    """One codec per worker process and file, so that its memory lasts over tasks."""
    held = worker_memory(f"{kind.__name__} {path}")
    if "codec" not in held:
        held["codec"] = kind(path)
    return held["codec"]


def text_slices(batch: pa.RecordBatch, column: str, chars: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about ``chars`` characters of text each, and their texts (null as empty); only one part's texts are Python strings at a time."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= chars or i == len(sizes) - 1:
            part = batch.slice(start, i + 1 - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start, held = i + 1, 0


def bpe_round_trip(
    docs: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str = "decoded",
) -> DataFrame:
    """``docs`` with the ids of each whole text and the text they decode to.

    No shuffle and one pass; a worker holds one slice of a batch (module docstring: odd input).
    ``tokenizer_path`` must be readable by every executor.
    """
    outputs = {ids_col.lower(), decoded_col.lower()}
    kept = [c for c in docs.columns if c.lower() not in outputs]
    # The text column may itself be replaced; then it is read under another name.
    replaced = text_col.lower() in outputs
    source = fresh(docs, "bpe_source")[0] if replaced else text_col
    wanted = docs.select(*[docs[c] for c in kept], *([docs[text_col].alias(source)] if replaced else []))
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded_col, T.StringType(), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            for part, texts in text_slices(batch, source):
                coded = [np.frombuffer(own.encode_bytes(t), dtype="<i4") for t in texts]
                ends = np.cumsum([0] + [len(c) for c in coded])
                flat = np.concatenate(coded) if coded else np.empty(0, "<i4")
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                decoded = pa.array([own.decode(c.tolist()) for c in coded], pa.string())
                columns = [part.column(c) for c in kept] + [ids, decoded]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids_col, decoded_col])

    return wanted.mapInArrow(run, schema)

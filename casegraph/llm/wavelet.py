"""A wavelet matrix: a sequence of token ids as bit planes with rank and select.

File format (little endian), one file per shard::

    magic    8 bytes  b"WAVEMTX1"
    header   uint64   length of the JSON header, then the header (UTF-8):
             n (ids), bits (planes), chunk (bits per chunk), zeros (per plane),
             docs (number of documents), sizes (bytes of every part)
    parts    zstd-compressed, in the order of ``sizes``: document ids (int64),
             document null flags (uint8), document lengths (int64), for each
             plane the ones before each chunk (uint64), then for each plane its
             chunks of packed bits

A plane holds one bit of every id, most significant first; after each plane the
ids are stably partitioned by that bit. Chunks are decompressed on demand, so a
look-up reads a few chunks and not the file.
"""

from __future__ import annotations

import json
import struct
from collections import OrderedDict

import numpy as np
import zstandard

MAGIC = b"WAVEMTX1"
CHUNK = 1 << 16
#: Decompressed chunks that an open file keeps.
KEPT = 256


def write_wavelet(ids: np.ndarray, bits: int, doc_ids: np.ndarray, doc_nulls: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard. ``ids`` are below 2**bits; ``lengths`` sum to their number."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits")
    pack = zstandard.ZstdCompressor(level=1).compress
    current = np.ascontiguousarray(ids, dtype=np.uint16 if bits <= 16 else np.uint32)
    zeros, ones_before, planes = [], [], []
    for plane in range(bits - 1, -1, -1):
        set_bits = (current >> plane) & 1 == 1
        # Positions and takes: several times as fast as boolean masks on random bits.
        ones, rest = np.flatnonzero(set_bits), np.flatnonzero(~set_bits)
        zeros.append(len(rest))
        ends = np.append(np.arange(0, len(current), CHUNK), len(current))
        ones_before.append(pack(np.searchsorted(ones, ends).astype("<u8").tobytes()))
        planes.append([pack(np.packbits(set_bits[i : i + CHUNK]).tobytes()) for i in range(0, len(current), CHUNK)])
        current = np.concatenate([current.take(rest), current.take(ones)])
    parts = [pack(np.asarray(doc_ids, "<i8").tobytes()), pack(np.asarray(doc_nulls, "u1").tobytes())]
    parts += [pack(np.asarray(lengths, "<i8").tobytes()), *ones_before, *(c for plane in planes for c in plane)]
    header = {"n": len(ids), "bits": bits, "chunk": CHUNK, "zeros": zeros, "docs": len(lengths), "sizes": [len(p) for p in parts]}
    head = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *parts])


class Wavelet:
    """Reads a file that ``write_wavelet`` made, from bytes or a memory map."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a wavelet file")
        (size,) = struct.unpack("<Q", view[8:16])
        head = json.loads(bytes(view[16 : 16 + size]))
        self.n, self.bits, self.chunk, self.zeros = head["n"], head["bits"], head["chunk"], head["zeros"]
        starts = 16 + size + np.concatenate([[0], np.cumsum(head["sizes"])]).astype(np.int64)
        self._view, self._starts = view, starts
        self._unpack = zstandard.ZstdDecompressor().decompress
        self.doc_ids = np.frombuffer(self._part(0), "<i8")
        self.doc_nulls = np.frombuffer(self._part(1), "u1").astype(bool)
        self.lengths = np.frombuffer(self._part(2), "<i8")
        self._ones = [np.frombuffer(self._part(3 + p), "<u8").astype(np.int64) for p in range(self.bits)]
        self._chunks = -(-self.n // self.chunk)
        self._open: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def _part(self, i: int) -> bytes:
        return self._unpack(bytes(self._view[self._starts[i] : self._starts[i + 1]]))

    def _bits_of(self, plane: int, chunk: int) -> np.ndarray:
        data = self._part(3 + self.bits + plane * self._chunks + chunk)
        return np.unpackbits(np.frombuffer(data, "u1"), count=min(self.chunk, self.n - chunk * self.chunk))

    def _block(self, plane: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's bits, and the ones before each of them in the whole plane."""
        if (plane, chunk) not in self._open:
            bits = self._bits_of(plane, chunk)
            before = self._ones[plane][chunk] + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            self._open[plane, chunk] = bits, before
            if len(self._open) > KEPT:
                self._open.popitem(last=False)
        self._open.move_to_end((plane, chunk))
        return self._open[plane, chunk]

    def _ones_before(self, plane: int, i: int) -> int:
        if i >= self.n:
            return int(self._ones[plane][-1])
        return int(self._block(plane, i // self.chunk)[1][i % self.chunk])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit = int(self._block(plane, i // self.chunk)[0][i % self.chunk])
            ones = self._ones_before(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before position ``end``."""
        if token >> self.bits or token < 0:
            return 0
        low, high = 0, min(max(end, 0), self.n)
        for plane in range(self.bits):
            a, b = self._ones_before(plane, low), self._ones_before(plane, high)
            if token >> (self.bits - 1 - plane) & 1:
                low, high = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence of ``token``, from 0; IndexError if there is none."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        low = 0
        for plane in range(self.bits):
            a = self._ones_before(plane, low)
            low = self.zeros[plane] + a if token >> (self.bits - 1 - plane) & 1 else low - a
        i = low + k
        for plane in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - plane) & 1
            i = self._select_bit(plane, one, i - self.zeros[plane] if one else i)
        return i

    def _select_bit(self, plane: int, one: int, k: int) -> int:
        starts = np.arange(self._chunks + 1, dtype=np.int64) * self.chunk
        before = self._ones[plane] if one else np.minimum(starts, self.n) - self._ones[plane]
        chunk = int(np.searchsorted(before, k, side="right")) - 1
        bits, _ = self._block(plane, chunk)
        return chunk * self.chunk + int(np.flatnonzero(bits == one)[k - before[chunk]])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, unwinding the partitions from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        current = np.zeros(self.n, kind)
        for plane in range(self.bits - 1, -1, -1):
            ones = np.empty(self.n, bool)
            for c in range(self._chunks):
                ones[c * self.chunk : (c + 1) * self.chunk] = self._bits_of(plane, c)
            before = np.empty_like(current)
            before[np.flatnonzero(~ones)] = current[: self.zeros[plane]]
            before[np.flatnonzero(ones)] = current[self.zeros[plane] :] | kind(1 << (self.bits - 1 - plane))
            current = before
        return current

    def documents(self):
        """(doc id or None, ids) of every document, in file order."""
        ends, ids = np.cumsum(self.lengths), self.decode()
        for doc, null, length, end in zip(self.doc_ids.tolist(), self.doc_nulls.tolist(), self.lengths.tolist(), ends.tolist(), strict=True):
            yield (None if null else doc), ids[end - length : end]

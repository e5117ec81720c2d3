"""Token-ID output: documents in id order, encoded, one wavelet-matrix file per shard.

Texts are range-partitioned by document id (a sampled range shuffle; the only
shuffle of texts) and sorted inside each partition. Where one id has more than
``HOT_ID`` rows the range goes on with the texts' first characters and the rows'
place in the input, so that no task gets all rows of an id. A task encodes its texts
with the tokenizers library, a slice of ``SLICE_CHARS`` characters at a time, and closes
a shard whenever it holds ``SHARD_TOKENS`` ids, so memory is bounded by a slice, a shard
and its longest document.
Shards are ordered by (partition, sequence).

The files travel as rows (partition, sequence, n_docs, n_tokens, file) that
Spark's own writer commits: the folder can be in any store that Spark writes
to, a lost executor's attempt leaves nothing behind, and a retried task writes
the same bytes. ``file`` is the complete file of ``casegraph.llm.wavelet``;
Parquet is its envelope and isn't compressed again.

Results for odd input: a null or empty text is the end id alone; null ids come
first; rows with the same id are ordered by text (by its first ``HEAD``
characters where an id has more than ``HOT_ID`` rows), and equal rows each have
their own ids in the files; texts of any length are encoded whole, and a shard
ends after the document that fills it; other columns are ignored, whatever their
names; an empty table writes no shard. Ids must be integers.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from casegraph.llm.bpe import LibraryCodec, codec, text_slices
from casegraph.llm.common import text_of
from casegraph.llm.wavelet import Wavelet, write_wavelet

END_ID = 1
SHARD_TOKENS = 4_000_000
#: Characters of text that are encoded together: a word is looked up once in so many.
SLICE_CHARS = 8_000_000
#: Rows of one id from which on it is split, and the characters of text that split it.
HOT_ID, HEAD = 100_000, 256
SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, file binary"
DOC_SCHEMA = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def write_token_shards(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Write the shards of ``docs`` to ``path`` (module docstring: format, odd input)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path, LibraryCodec)
        bits = max(own.size - 1, end_id).bit_length()
        end = np.array([end_id], "<i4")
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            nulls = np.array([d is None for d in doc_ids])
            known = np.array([d or 0 for d in doc_ids], np.int64)
            file = write_wavelet(np.concatenate(ids), bits, known, nulls, np.array(lengths, np.int64))
            row = [[part], [seq], [len(doc_ids)], [held], [file]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "n_docs", "n_tokens", "file"]
            )
            seq, held = seq + 1, 0
            for one in (ids, doc_ids, lengths):
                one.clear()
            return out

        # Remembered words hold no cycles; collections would only walk through them again and again.
        gc.disable()
        try:
            for batch in batches:
                for piece, texts in text_slices(batch, "t", SLICE_CHARS):
                    for doc, coded in zip(piece.column("id").to_pylist(), own.encode_all(texts), strict=True):
                        ids += [coded.astype(np.uint16 if bits <= 16 else np.uint32), end.astype(np.uint16 if bits <= 16 else np.uint32)]
                        doc_ids.append(doc)
                        lengths.append(len(coded) + 1)
                        held += len(coded) + 1
                        if held >= shard_tokens:
                            yield close()
            if doc_ids:
                yield close()
        finally:
            gc.enable()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    most = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > HOT_ID:
        split = rows.withColumn("head", F.substring("t", 1, HEAD)).withColumn("place", F.spark_partition_id())
        ordered = split.repartitionByRange("id", "head", "place").sortWithinPartitions("id", "t").select("id", "t")
    else:
        ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "t")
    ordered.mapInArrow(build, SHARD_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, file in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "file")), strict=True):
                shard = Wavelet(file)
                ends = np.cumsum(shard.lengths)
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in shard.documents()]
                n = len(sums)
                columns = [
                    pa.array([part] * n, pa.int32()),
                    pa.array([seq] * n, pa.int32()),
                    pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_nulls),
                    pa.array(ends - shard.lengths, pa.int64()),
                    pa.array(shard.lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    # Sums inside each part, and over the parts, of which there are as many as tasks wrote.
    def before(column: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("held")).select("part", before("held", Window.orderBy("part")).alias("first"))
    inside = shards.select("part", "seq", before("n_tokens", Window.partitionBy("part").orderBy("seq")).alias("later"))
    bases = inside.join(parts, "part").select("part", "seq", (F.col("first") + F.col("later")).alias("base"))
    documents = shards.select("part", "seq", "file").mapInArrow(digest, DOC_SCHEMA)
    return documents.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )

"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

1. toxicity    documents that the positive-unlabelled model rejects go
2. line_dedup  later occurrences of repeated three-line windows go
3. ngram_join  one document of each group of near duplicates stays
4. mixing      documents are repeated, cut or left out to meet the sources' targets, in training order
5. bpe         documents become token ids

All stages but the last return the columns of ``documents``, and any other columns that they are
given, whatever their names; where a stage has changed a text, ``n_chars`` follows it.

Results for odd input, at every stage: an empty table gives an empty one with the same columns; null
ids, sources and texts take part; very long texts are read whole. What each stage does beyond that
stands with it, and the operators' modules say the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.bpe import bpe_round_trip
from casegraph.llm.common import fresh
from casegraph.llm.line_dedup import line_dedup
from casegraph.llm.mixing import mix_documents
from casegraph.llm.ngram_join import keep_one
from casegraph.llm.queries import tokenizer_path
from casegraph.llm.toxicity import REJECT, score_toxicity, train_toxicity
from casegraph.scratch import materialize


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that the model rejects.

    Null and empty texts have the model's base score; repeated rows stay or go together; without any
    confirmed toxic document all stay.
    """
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")[0]
    scored = score_toxicity(docs, model, score_col=score)
    return scored.filter(F.col(score) < REJECT).drop(score)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs``, row for row, without later occurrences of three-line windows.

    Null texts stay null, a text whose lines all go stays empty; rows with one id and text lose the same lines.
    """
    return _counted(line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts without a word stay; of repeated rows one stays. Later copies have lost their repeated lines in the
    stage before, so what is compared here is what is left of them.
    """
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` in training order, each as often and as far as its source's target takes it.

    A null source is a source; texts without a word are not in the mix; of rows equal in id, text and source, one
    row's other columns count.
    """
    return _counted(mix_documents(docs))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, in the order of the rows; a null text has none."""
    coded = bpe_round_trip(docs.select("doc_id", "source", "text"), tokenizer_path())
    return coded.select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("ngram_join", near_duplicates),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: The model of the first stage, the sketches of the third and the encoder of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

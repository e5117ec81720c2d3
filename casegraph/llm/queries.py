"""The registered queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.bpe import bpe_round_trip
from casegraph.llm.chat_format import format_chat, formatted, learnt_text, read_turns
from casegraph.llm.embedding_dedup import embedding_dedup
from casegraph.llm.exact_dedup import exact_dedup
from casegraph.llm.line_dedup import line_dedup
from casegraph.llm.mixing import ordered_plan
from casegraph.llm.ngram_join import ngram_join
from casegraph.llm.html_extraction import extract_main_text
from casegraph.llm.labelled import remainder
from casegraph.llm.resampling import importance_resample
from casegraph.llm.quality import ACCEPT, score_quality, train_quality
from casegraph.llm.token_files import read_token_shards, write_token_shards
from casegraph.llm.toxicity import REJECT, score_toxicity, train_toxicity
from casegraph.llm.whitening import component_rows, whiten
from casegraph.scratch import new_path

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_round_trip(docs, tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = ordered_plan(_table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "positions")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    held_out = remainder("doc_id", 3) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    write_token_shards(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_token_shards(spark, path)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, _table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    held_out = remainder("doc_id", 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = component_rows(whiten(_table(spark, sf_dir, "embeddings")))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


#: A text that quotes the template's own marks, with escapes.
QUOTING = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    quoting = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(QUOTING).alias("text"))
    out = format_chat(chats.unionByName(quoting)).select("*", formatted(F.col("segments")).alias("whole"))
    read = out.select("*", read_turns(F.col("whole")).alias("turns"), learnt_text(F.col("segments")).alias("learnt"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
        "valid",
        F.col("broken_at").cast("long").alias("broken_at"),
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""

OP5_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS body FROM p),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS k
      FROM w WHERE trim(translate(body, chr(10) || chr(13) || chr(9), '   ')) <> ''),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS i FROM f WHERE k > 1),
hit AS (SELECT DISTINCT doc_id FROM gone),
s AS (SELECT l.doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM l JOIN hit USING (doc_id)),
kept AS (SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.i) AS text
         FROM s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i WHERE g.i IS NULL GROUP BY s.doc_id),
r AS (SELECT d.doc_id, CASE WHEN hit.doc_id IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
      FROM documents d LEFT JOIN hit USING (doc_id) LEFT JOIN kept USING (doc_id))
SELECT doc_id, text, sha256(text) AS text_sha256 FROM r
"""


OP3_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
f AS (SELECT * FROM v WHERE len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
g AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM f),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, p.y FROM r JOIN p ON r.reach = p.x),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id), d AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(d.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN d ON d.x = vec_id
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g FROM i), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT x, y, k = nx.c AND k = ny.c AS same FROM j JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE k >= 0.8 * (nx.c + ny.c - k) - 1e-9),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, p.y FROM r JOIN p ON r.reach = p.x),
c AS (SELECT id, min(reach) AS class_id FROM r GROUP BY id), d AS (SELECT x, count(*) AS n, count(*) FILTER (WHERE same) AS m FROM p GROUP BY x)
SELECT doc_id, class_id, coalesce(d.n, 0) AS n_links, coalesce(d.m, 0) + 1 AS copies
FROM documents JOIN c ON c.id = doc_id LEFT JOIN d ON d.x = doc_id
"""


OP12_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) q(k, r)),
e AS (SELECT *, regexp_replace(t, '(### System:|### User:|### Assistant:|### Role\[|</turn>)', '\\\1', 'g') AS esc,
      CASE WHEN role IN ('system', 'user', 'assistant') THEN length('### : ') + length(role)
           ELSE length('### Role[]: ') + 2 * octet_length(encode(role)) END + length(' </turn> ') AS marks,
      lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, t) AS before,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, t DESC) AS last FROM c),
f AS (SELECT *, coalesce(before, 'start') || '>' || role IN
      ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS good FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(marks + length(esc)) AS BIGINT) AS formatted_chars,
       bool_and(good) AND bool_or(last = 1 AND role IN ('user', 'assistant')) AS valid, min(turn) FILTER (WHERE NOT good) AS broken_at
FROM f GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_bpe": op2_bpe,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_mixing": op4_mixing,
        "op5_line_dedup": op5_line_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_ngram_join": op8_ngram_join,
        "op9_token_files": op9_token_files,
        "op10_quality": op10_quality,
        "op11_whitening": op11_whitening,
        "op12_chat_format": op12_chat_format,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3_SQL, "op5_line_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_ngram_join": OP8_SQL, "op12_chat_format": OP12_SQL}

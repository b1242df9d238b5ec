"""Registered queries of this subpackage, with DuckDB text where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscope.llm import (
    decontam, langid, middle, quality, repeats, secrets, simhash, spm, tokenfile, toxicity, urls, vafile, whitening,
)
from voidscope.llm.common import fold, held_out, table

#: Folder of the public vocabulary files; a parameter of the deployment, never part of the repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
WORD_MODEL = f"{TOKENIZERS}/word_bpe_49k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    found = quality.score(docs, quality.learn(docs, labels))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find_secrets(docs, secrets.learn(docs)))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_MODEL)
    return tokenfile.summary(files)


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.learn(urls.labelled_urls(pages)))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Model from the rows of the learning folds only, labelled or not."""
    learning = fold("doc_id", 5) != 0
    return toxicity.learn(
        docs.filter(learning), labels.filter(learning).select("doc_id", F.col("toxic").alias("label")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document in fill-in-middle order, and of the text rebuilt from it."""
    return middle.digest(middle.rearrange(middle.write_frames(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every valid embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents less the bytes of 50-byte strings that an earlier document holds."""
    return repeats.digest(repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_langid, op3_quality, op4_sentencepiece, op5_decontaminate, op6_secrets, op7_topk,
    op8_tokenids, op9_urlfilter, op10_toxicity, op11_fill_in_middle,
    op12_whitening, op13_suffix_dedup)}

ORACLES = {
    "op7_topk": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_fill_in_middle": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
        ), u AS (
            SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
                   ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
                   ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4
            FROM t
        ), c AS (
            SELECT *, CAST(len(units) AS BIGINT) AS n,
                   CAST(least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS a,
                   CAST(greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM u
        ), p AS (
            SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
                   array_to_string(units[b + 1:], '') AS suffix
            FROM c
        )
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN CAST(len(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(len(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_suffix_dedup": """
        WITH t AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), w AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
            FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS p FROM t)
        ), o AS (
            SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
        ), hit AS (
            SELECT w.doc_id, w.p FROM w JOIN o ON w.s = o.s AND w.doc_id > o.first_id
        ), g AS (
            SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
            FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)
        ), spans AS (
            SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY doc_id, run
        ), gaps AS (
            SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
            UNION ALL
            SELECT t.doc_id, coalesce(max(s.z), 0), len(any_value(t.h)) // 2 FROM t LEFT JOIN spans s ON t.doc_id = s.doc_id
            GROUP BY t.doc_id
        ), kept AS (
            SELECT gaps.doc_id, string_agg(substr(t.h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept
            FROM gaps JOIN t ON gaps.doc_id = t.doc_id GROUP BY gaps.doc_id
        )
        SELECT t.doc_id, CAST(len(t.h) // 2 AS BIGINT) AS n_bytes,
               CAST((len(t.h) - len(kept)) // 2 AS BIGINT) AS n_removed,
               CAST((SELECT count(*) FROM spans s WHERE s.doc_id = t.doc_id) AS BIGINT) AS n_spans,
               sha256(unhex(kept)) AS kept_sha256
        FROM t JOIN kept ON t.doc_id = kept.doc_id
    """,
}

"""Queries of the training-data operators: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .exact_dedup import exact_duplicates
from .license_scan import scan
from .lm import backoff_scores
from .packing import pack_documents
from .piece_bpe import tokenize
from .quality import quality_scores
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .warc import roundtrip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, distance=2)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(_table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(_table(spark, sf_dir, "documents"), with_ids=False)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("log10_score", 5).alias("log10_score"), F.round("mean_log10", 7).alias("mean_log10"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_exact_dedup, op3_nearest_neighbours, op4_best_fit_packing, op5_simhash_near_dedup, op6_warc, op7_quality_classifier, op8_substring_dedup, op9_sentencepiece, op10_lm_scoring, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm""",
    # n-grams as rows of their words: ' ' is the begin mark, which no word can be
    "op10_lm_scoring": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
        n AS (SELECT r, doc_id, len(w) AS n_words, sum(len(w)) OVER () - len(w) AS rest FROM d),
        u AS (SELECT r, unnest(range(len(w) + 1)) AS p, unnest(list_concat([' '], w)) AS w0 FROM d),
        g AS (SELECT r, p, w0, lag(w0) OVER o AS w1, lag(w0, 2) OVER o AS w2 FROM u WINDOW o AS (PARTITION BY r ORDER BY p)),
        o1 AS (SELECT r, w0, count(*) AS c FROM g GROUP BY ALL), t1 AS (SELECT w0, sum(c) AS c FROM o1 GROUP BY ALL),
        o2 AS (SELECT r, w1, w0, count(*) AS c FROM g WHERE p > 0 GROUP BY ALL), t2 AS (SELECT w1, w0, sum(c) AS c FROM o2 GROUP BY ALL),
        o3 AS (SELECT r, w2, w1, w0, count(*) AS c FROM g WHERE p > 1 GROUP BY ALL), t3 AS (SELECT w2, w1, w0, sum(c) AS c FROM o3 GROUP BY ALL),
        e1 AS (SELECT o1.r, o1.w0, t1.c - o1.c AS c FROM o1 JOIN t1 USING (w0)),
        e2 AS (SELECT o2.r, o2.w1, o2.w0, t2.c - o2.c AS c FROM o2 JOIN t2 USING (w1, w0)),
        e3 AS (SELECT o3.r, o3.w2, o3.w1, o3.w0, t3.c - o3.c AS c FROM o3 JOIN t3 USING (w2, w1, w0)),
        s AS (SELECT g.r, CASE WHEN p > 1 AND e3.c > 0 THEN log10(e3.c / greatest(f2.c, 1))
                WHEN e2.c > 0 THEN log10(e2.c / greatest(f1.c, 1)) + (least(3, p + 1) - 2) * log10(0.4)
                ELSE log10(greatest(e1.c, 0.5) / greatest(n.rest, 1)) + (least(3, p + 1) - 1) * log10(0.4) END AS v
              FROM g JOIN n ON g.r = n.r JOIN e1 ON e1.r = g.r AND e1.w0 = g.w0 JOIN e2 ON e2.r = g.r AND e2.w1 = g.w1 AND e2.w0 = g.w0
              JOIN e1 f1 ON f1.r = g.r AND f1.w0 = g.w1
              LEFT JOIN e3 ON e3.r = g.r AND e3.w2 = g.w2 AND e3.w1 = g.w1 AND e3.w0 = g.w0
              LEFT JOIN e2 f2 ON f2.r = g.r AND f2.w1 = g.w2 AND f2.w0 = g.w1 WHERE p > 0),
        z AS (SELECT r, sum(v) AS v FROM s GROUP BY r)
        SELECT doc_id, n_words, round(coalesce(v, 0), 5) AS log10_score, CASE WHEN n_words > 0 THEN round(v / n_words, 7) END AS mean_log10 FROM n LEFT JOIN z ON z.r = n.r""",
}

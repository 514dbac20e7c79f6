"""Queries of the operators that find repeated passages and similar documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, substring
from .registry import query, table


@query(
    "op3_substring_dedup",
    r"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), win AS (
      SELECT doc_id, i, list_slice(ws, i, i + 19) AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
    ), again AS (
      SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win
      ) WHERE n > 1
    ), gone AS (
      SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest(range(0, 20)) AS k)
    ), marks AS (
      SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
    )
    SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
      sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(
        list_filter(ws, lambda x, k: NOT list_contains(gone, k)), ' ') END) AS kept_sha256
    FROM w LEFT JOIN marks USING (doc_id)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


@query(
    "op8_jaccard_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws
      FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i
        FROM w WHERE len(ws) > 0)
    ), n AS (
      SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), common AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL
    ), link AS (
      SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * k >= 75 * (x.n + y.n - k)
    ), reach AS (
      SELECT a AS doc_id, a AS other FROM link
      UNION
      SELECT doc_id, b FROM reach JOIN link ON other = a
    ), part AS (
      SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id
    )
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(c, w.doc_id), w.doc_id) AS component_id
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN part USING (doc_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))

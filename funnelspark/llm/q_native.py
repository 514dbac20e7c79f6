"""Queries of the operators built from DataFrame functions alone, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, quality, urls
from .registry import query, table

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
RULE_SCHEMA = "host string, path string, verdict string"
#: A conversation whose texts hold the template's own marks.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"),
         (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
TURN_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@query(
    "op1_quality_rules",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
    ), w AS (
      SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)),
          lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM d
    ), win AS (
      SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8
    ), twice AS (
      SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(ws, i, i + 7)) AS n FROM win
    ), rep AS (
      SELECT r, count(DISTINCT i + k) AS n_repeat_words
      FROM twice, (SELECT unnest(range(0, 8)) AS k) WHERE n > 1 GROUP BY r
    ), f AS (
      SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(t) - length(translate(t, '!', '')) AS n_exclamations,
        length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper,
        length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters,
        len(string_split(t, chr(10))) AS n_lines,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutters
      FROM w LEFT JOIN rep USING (r)
    ), b AS (
      SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR 10 * n_symbols > n_words OR 5 * n_exclamations > n_words
        OR 2 * n_upper > n_letters OR 3 * n_dup_lines > n_lines
        OR 10 * n_stutters > 3 * n_words) AS kept
    FROM b
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).drop("rejected_by")


@query(
    "op2_url_filters",
    r"""
    WITH rules(rhost, rpath, rverdict) AS (
      VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
             ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
    ), parts AS (
      SELECT row_number() OVER () AS r, page_id,
        translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
      FROM pages
    ), fit AS (
      SELECT r, rhost || rpath AS rule, rverdict,
        row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC) AS place
      FROM parts JOIN rules
        ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    )
    SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
    FROM parts LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (r)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


@query(
    "op4_chat_formatting",
    r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations
      UNION ALL
      SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'),
        (1, 'assistant', '\### Assistant: </turn> ok'))
    ), f AS (
      SELECT *, 15 + length(regexp_replace(role, '([\\:<#])', '\\\1', 'g'))
          + length(regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g')) AS n,
        row_number() OVER s AS i, count(*) OVER (PARTITION BY conv_id) AS total
      FROM t WINDOW s AS (PARTITION BY conv_id ORDER BY turn, role, text)
    ), c AS (
      SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f
    ), g AS (
      SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
        coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
        sum(upto) FILTER (role = 'assistant' OR i = total) AS formatted_chars
      FROM c GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
      sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
    FROM g
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PROBE, TURN_SCHEMA))
    return chat.read_back(chat.format_examples(turns))

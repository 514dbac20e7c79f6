"""Queries of the source audit, the manifest and the near-duplicate vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, merkle, near_vectors
from .registry import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _levels(first: str, name: str, levels: int, keys: str) -> str:
    """SQL of the levels above ``first`` (keys, pos, h, n nodes in the tree); level k is ``name``k."""
    out, group = "", f"{keys}, pos // 16" if keys else "pos // 16"
    lead = f"{keys}, " if keys else ""
    for k in range(levels):
        below = first if k == 0 else f"{name}{k}"
        out += f""", {name}{k + 1} AS (SELECT {lead}pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h,
        (any_value(n) + 15) // 16 AS n FROM {below} WHERE n > 1 GROUP BY {group})"""
    return out


def _climb(path: str, nodes: str, levels: int, same: str) -> str:
    """SQL that adds the siblings of one level after the other to ``proof`` and folds them into ``f``.

    ``same`` says that node x is in the tree of row p. Level k of the way is ``path``k.
    """
    out = ""
    for k in range(levels):
        out += f""", {path}_sib{k} AS (SELECT p.r,
        coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < p.pos), '') AS a,
        coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > p.pos), '') AS b
        FROM {path}{k} p JOIN {nodes}{k} x ON {same} AND x.pos // 16 = p.pos // 16 AND x.n > 1 GROUP BY p.r),
        {path}{k + 1} AS (SELECT p.r, p.k, p.pos // 16 AS pos, p.proof || coalesce(s.a || s.b, '') AS proof,
        CASE WHEN s.r IS NULL THEN p.f ELSE sha256(s.a || p.f || s.b) END AS f
        FROM {path}{k} p LEFT JOIN {path}_sib{k} s USING (r))"""
    return out


def _manifest_sql(levels: int = 5, top_levels: int = 3) -> str:
    """The manifest level by level, for up to 16 ** levels rows a source and 16 ** top_levels sources."""

    def part(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(part(x) for x in ['doc_id', 'source', 'lang', 'n_chars', text])})"

    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    subroots = " UNION ALL ".join(
        f"SELECT k, h FROM h{k} WHERE n = 1" for k in range(levels + 1)
    )
    roots = " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(top_levels + 1))
    return f"""
    WITH crc AS (
      SELECT *, row_number() OVER () AS r, xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
          lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS crc
      FROM documents
    ), d AS (
      SELECT r, doc_id, coalesce('=' || source, '') AS k, {leaf('text')} AS leaf,
        CASE WHEN crc % 5 = 0 THEN {leaf(lowered)} END AS changed FROM crc
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY k) AS n FROM d
    ), h0 AS (SELECT k, pos, leaf AS h, n FROM placed){_levels('h0', 'h', levels, 'k')}
    , sub AS ({subroots})
    , t0 AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos, h, count(*) OVER () AS n FROM sub)
    {_levels('t0', 't', top_levels, '')}
    , root AS ({roots})
    , low0 AS (SELECT r, k, pos, '' AS proof, coalesce(changed, leaf) AS f FROM placed)
    {_climb('low', 'h', levels, 'x.k = p.k')}
    , up0 AS (SELECT r, k, t0.pos, proof, f FROM low{levels} JOIN t0 USING (k)){_climb('up', 't', top_levels, 'true')}
    SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(up.proof) AS proof_sha256, up.f AS folded_root,
      up.f = root.h AS verified
    FROM placed JOIN up{top_levels} up USING (r) JOIN sub ON sub.k = placed.k, root
    """


@query("op13_merkle_manifest", _manifest_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", UPPER, LOWER)
    other = merkle.leaf_digest([lowered if c == "text" else F.col(c) for c in merkle.FIELDS])
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(docs, altered=F.when(fifth, other)).drop("source", "place")


@query(
    "op12_source_divergence",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents
    ), occ AS (
      SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
    ), kept AS (
      SELECT lang, term, count(*) AS n FROM occ GROUP BY ALL HAVING count(DISTINCT r) >= 3
    ), v AS (
      SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
    ), g AS (
      SELECT DISTINCT lang, source FROM d
    ), c AS (
      SELECT lang, source, term, count(*)::HUGEINT AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL
    ), s AS (
      SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
    ), p AS (
      SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (size + v) AS p,
        1 + 1000000000 * (k.n::HUGEINT + 1) // (total + v) AS q
      FROM s JOIN kept k ON k.lang = s.lang JOIN v ON v.lang = s.lang
      LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
    ), pair AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
    ), both_parts AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
      LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts
    ) WHERE part = 'pair' OR rank <= 200
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query("op11_near_vectors")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))

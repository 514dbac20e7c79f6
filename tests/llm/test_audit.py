"""Manifest, source audit and near-duplicate vectors against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelspark.llm import divergence, merkle, near_vectors
from funnelspark.llm.q_audit import LOWER, UPPER

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, place string, digest string, path int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, [[(left, right), ...] per node]) of a list of digests."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, kept = [], []
        for i in range(0, len(nodes), 16):
            run = nodes[i : i + 16]
            for k in range(len(run)):
                for o in owners[i + k]:
                    paths[o].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            kept.append([o for own in owners[i : i + 16] for o in own])
        nodes, owners = above, kept
    return nodes[0], paths


def plain_manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    def lowered(row):
        return (*row[:4], row[4] and row[4].translate({c: c + 32 for c in range(65, 91)}))

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own])))
    if not trees:
        return []
    root, tops = tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf(lowered(r)) if hit else leaf(r)
            for a, b in path + top:
                folded = sha(a + folded + b)
            proof = sha("".join(a + b for a, b in path + top))
            out.append((r[0], leaf(r), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def spark_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "p", "d", 3) for r in rows], DOCS)
    lowered = F.translate("text", UPPER, LOWER)
    other = merkle.leaf_digest([lowered if c == "text" else F.col(c) for c in merkle.FIELDS])
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.manifest(docs, altered=F.when(fifth, other)).drop("source", "place")
    return sorted((tuple(r) for r in made.collect()), key=str)


HARD_ROWS = [
    (1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abc"), (1, "a", None, None, None), (None, None, None, None, ""),
    (None, "a", "en", 1, "X"), (7, "", "en", 2, "Yé"), (8, None, "de", 0, "日本"), (-5, "é", "", 9, "Z" * 60_000),
]


def test_manifest_of_rows_that_are_hard_to_handle(spark):
    assert spark_manifest(spark, HARD_ROWS) == plain_manifest(HARD_ROWS)
    assert spark_manifest(spark, []) == []
    assert spark_manifest(spark, HARD_ROWS[:1]) == plain_manifest(HARD_ROWS[:1])


@pytest.mark.parametrize("sizes", [[16], [17, 256, 257, 1], [5000, 3] + [2] * 20, [4096, 4097]])
def test_manifest_of_many_sources(spark, sizes):
    rows = [(k * 7 % n, f"s{s}", "en", k, f"Text {k}") for s, n in enumerate(sizes) for k in range(n)]
    got = spark_manifest(spark, rows)
    assert got == plain_manifest(rows)
    changed = [r for r in got if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert not any(r[-1] for r in changed) and all(r[-1] for r in got if r not in changed)


def test_blocks_of_a_tree_are_the_tree():
    leaves = [sha(str(i)) for i in range(300)]
    root, paths = tree(leaves)
    made = merkle.ascend(leaves, alone=True)
    assert made[-1] == [root]
    found = merkle.descend(made, "")
    assert [merkle._steps(p) for p in found] == paths
    assert all(merkle.fold(d, p) == root for d, p in zip(leaves, found))


def plain_divergence(rows, top=200):
    """Rows are (text, lang, source)."""
    docs = [
        ([m.translate({c: c + 32 for c in range(65, 91)}) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")],
         lang or "", source or "")
        for t, lang, source in rows
    ]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        seen = Counter(t for d in own for t in set(d[0]))
        kept = {t for t, n in seen.items() if n >= 3}
        every = Counter(t for d in own for t in d[0] if t in kept)
        by = {s: Counter() for s in {d[2] for d in own}}
        for terms, _, s in own:
            by[s].update(t for t in terms if t in kept)

        def share(counts, t):
            return 1 + 1_000_000_000 * (counts[t] + 1) // (sum(counts.values()) + len(kept))

        p = {s: {t: share(c, t) for t in kept} for s, c in by.items()}
        q = {t: share(every, t) for t in kept}
        for s in by:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in by if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                for rank, (value, item) in enumerate(sorted(found), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item.decode(), -value, rank))
    return sorted(out)


def spark_divergence(spark, rows, **options):
    docs = spark.createDataFrame([(t, a, b, 1, "x") for t, a, b in rows], "text string, lang string, source string, n int, term string")
    return sorted(tuple(r) for r in divergence.source_divergence(docs, **options).collect())


LONG = ["abcdefgh", "abcdefghi", "abcdefghabcdefgh", "abcdefghabcdefghx", "é" * 40, "日本語のテキスト", "x" * 50_000, "x" * 50_001]


def random_rows(seed, n=150):
    r = random.Random(seed)
    words = [w for k in range(30) for w in (f"w{chr(97 + k % 26)}{'abc'[k % 3]}", f"Tërm{chr(97 + k % 26)}")] + LONG[:6]
    rows = []
    for _ in range(n):
        text = r.choice([" ", "1", "_\n"]).join(r.choice(words) for _ in range(r.randint(0, 60)))
        rows.append((text, r.choice(["en", "en", "de", None]), r.choice(["a", "a", "b", "c", None, "é"])))
    return rows


def test_divergence_of_random_texts(spark):
    for seed in range(2):
        rows = random_rows(seed)
        assert spark_divergence(spark, rows) == plain_divergence(rows)


def test_divergence_of_texts_that_are_hard_to_handle(spark):
    rows = [(" ".join(LONG), "en", s) for s in "abc"] + [(None, "en", "d"), ("", None, None), ("only once", "fr", "a"),
            ("1 2 3", "fr", "b"), ("A a A b", "es", "z"), ("A a A b", "es", "z"), ("a A", "es", "z")]
    assert spark_divergence(spark, rows) == plain_divergence(rows)
    assert spark_divergence(spark, rows, top_terms=2) == plain_divergence(rows, 2)
    assert spark_divergence(spark, []) == []


def test_radix_order_is_a_stable_sort():
    r = np.random.default_rng(0)
    words = r.integers(0, 1 << 63, 500, dtype=np.uint64)[r.integers(0, 500, 3000)]
    assert divergence.radix_order(words).tolist() == np.argsort(words, kind="stable").tolist()


def test_large_counts_stay_exact(spark):
    made = spark.range(1).selectExpr("10000000000000 AS c", "30000000000000 AS s", "7L AS v")
    got = made.selectExpr(divergence._share("c", "s", "v") + " AS p").first()["p"]
    assert got == 1 + 1_000_000_000 * (10**13 + 1) // (3 * 10**13 + 7)


def plain_links(rows, threshold=0.95):
    """Rows are (vec_id, vector)."""
    def good(i, v):
        return i is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    nodes = sorted({(i, tuple(x + 0.0 for x in v)) for i, v in rows if good(i, v)})
    links, root = Counter(), {i: i for i, _ in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for size in {len(v) for _, v in nodes}:
        own = [n for n in nodes if len(n[1]) == size]
        m = np.array([v for _, v in own], np.float64)
        norms = np.sqrt((m * m).sum(axis=1))
        near = m @ m.T / np.outer(norms, norms) >= threshold
        for a, b in zip(*np.nonzero(near)):
            if a != b:
                links[own[a]] += 1
                x, y = sorted((find(own[a][0]), find(own[b][0])))
                root[y] = x
    out = []
    for i, v in rows:
        if good(i, v):
            c = find(i)
            out.append((i, links[i, tuple(x + 0.0 for x in v)], c, c == i))
        else:
            out.append((i, 0, i, True))
    return sorted(out, key=str)


def spark_links(spark, rows, kind="float"):
    df = spark.createDataFrame(
        [(i, v, "n", 1, "d") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, node string, weight int, digest string"
    )
    return sorted((tuple(r) for r in near_vectors.near_duplicates(df).collect()), key=str)


def single(v):
    return [float(x) for x in np.asarray(v, np.float32)]


def clustered(seed, count, dim=16):
    """Vectors with copies, near copies and chains of neighbours."""
    r = np.random.default_rng(seed)
    out = [r.standard_normal(dim)]
    for _ in range(count - 1):
        kind, old = r.random(), out[r.integers(len(out))]
        if kind < 0.2:
            out.append(old)
        elif kind < 0.5:
            out.append(old + r.standard_normal(dim) * np.linalg.norm(old) * r.uniform(0.02, 0.1))
        else:
            out.append(r.standard_normal(dim))
    return [(int(i), single(v)) for i, v in zip(r.permutation(count), out)]


def test_links_of_clustered_vectors(spark, monkeypatch):
    for rows, kind in [(clustered(0, 700), "float"), (clustered(1, 300, 3), "double")]:
        assert spark_links(spark, rows, kind) == plain_links(rows)
    # Many small cells, and cells dealt as pairs of blocks, give the same links.
    rows = clustered(2, 1500, 24)
    monkeypatch.setattr(near_vectors, "CELL_ROWS", 40)
    near_vectors.plan.cache_clear()
    assert near_vectors.plan(1000)[1] > 5
    want = plain_links(rows)
    assert spark_links(spark, rows) == want
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 30)
    assert spark_links(spark, rows) == want
    near_vectors.plan.cache_clear()


def test_links_of_vectors_that_are_hard_to_handle(spark):
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, -0.0]), (4, None), (5, []), (6, [0.0, 0.0]),
        (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]),
        (11, [-1.0, 0.0]), (12, [0.95, 0.3122499]), (13, [0.95, 0.3122]), (14, [0.0, 1.0]), (14, [1.0, 0.01]), (15, [0.01, 1.0]),
    ]
    got = spark_links(spark, rows, "double")
    assert got == plain_links(rows)
    assert spark_links(spark, []) == []


def test_a_vector_that_very_many_rows_share(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(5000)] + [(5000 + i, [float(i), 1.0, -50.0]) for i in range(40)]
    assert spark_links(spark, rows) == plain_links(rows)


def test_plan_reaches_the_wanted_recall():
    lines, rounds, enough = near_vectors.plan(1 << 20)
    r = np.random.default_rng(5)
    one = r.standard_normal((4000, 64))
    one /= np.linalg.norm(one, axis=1)[:, None]
    across = r.standard_normal((4000, 64))
    across -= (across * one).sum(axis=1)[:, None] * one
    across /= np.linalg.norm(across, axis=1)[:, None]
    two, ones = 0.95 * one + np.sqrt(1 - 0.95**2) * across, np.ones(4000)
    width = near_vectors.WIDTH * np.sqrt(0.1)
    a, b = (near_vectors.cell_keys(v, ones, lines, rounds, width) for v in (one, two))
    gaps = [near_vectors.project(v, ones, near_vectors._lines(64, near_vectors.LINES, 3)) for v in (one, two)]
    close = np.abs(gaps[0] - gaps[1]) <= near_vectors.HALF * np.sqrt(0.1)
    assert ((a == b).any(axis=1) & (close.sum(axis=1) >= enough)).mean() > 0.995

import random

import numpy as np
import plain
import pytest

from funnelspark.llm import ann, jaccard, sketch, substring
from funnelspark.llm.components import components
from funnelspark.llm.hashing import text_bytes, window_hashes


def corpus(seed, n=120):
    """Texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    shared = [r.choice(vocabulary) for _ in range(40)]
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.3:
            ws = list(r.choice(texts))
            for _ in range(r.randint(0, 3)):
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
        else:
            ws = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        if kind > 0.8:
            ws = ws + shared + ws[:25]
        texts.append(ws)
        rows.append((i, r.choice([" ", "  ", "\n"]).join(ws)))
    return rows


def test_windows_are_equal_when_their_words_are():
    import pyarrow as pa

    texts = ["a b c d e", "b  c\td x", None, "", "bc d", "a b c d e"]
    data, offsets = text_bytes(pa.array(texts))
    (h,), windows, words = window_hashes(data, offsets, 2, 1)
    runs = [tuple(w[i : i + 2]) for w in map(plain.words, texts) for i in range(len(w) - 1)]
    assert windows.tolist() == [4, 3, 0, 0, 1, 4] and words.tolist() == [5, 4, 0, 0, 2, 5]
    assert len({*zip(h.tolist(), runs)}) == len(set(h.tolist())) == len(set(runs))


def test_sketch_never_counts_too_little():
    shape = sketch.Layout(rows=2, bits=16, cut=3, chunks=4)
    r = np.random.default_rng(0)
    chunks = [np.unique(r.integers(0, 3000, 1500).astype(np.uint64)) for _ in range(4)]
    true = np.bincount(np.concatenate(chunks).astype(int), minlength=3000)
    asked = [sketch.requests(i, c, np.ones(len(c), int), shape).to_pylist() for i, c in enumerate(chunks)]
    total = {}
    for blocks in asked:
        for b in blocks:
            for at, n in zip(sketch._unpacked(b["counters"]).tolist(), b["counts"]):
                key = (b["line"], b["bucket"], at)
                total[key] = total.get(key, 0) + n
    for c, blocks in zip(chunks, asked):
        answers = [
            b | {"counts": bytes(total[b["line"], b["bucket"], at] for at in sketch._unpacked(b["counters"]).tolist())}
            for b in blocks
        ]
        assert (sketch.estimates(c, answers, shape) >= true[c.astype(int)]).all()


@pytest.mark.parametrize("rows", [plain.HARD, corpus(1), corpus(2)])
def test_dedup_equals_plain_code(spark, rows):
    got = substring.dedup_substrings(plain.documents(spark, rows), keep=["key", "chunk"]).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == sorted(plain.dedup(rows))
    assert {r["chunk"] for r in got} == {"c"}


def test_dedup_keeps_untouched_texts_whole_if_asked(spark):
    got = substring.dedup_substrings(plain.documents(spark), whole=True).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[11][0]["n_removed"] > 0
    assert by_id[5][0]["text"] == "   \n\t " and by_id[1][0]["text"] == plain.LOREM
    assert sorted(r["n_removed"] > 0 for r in by_id[10]) == [True, True]


def test_dedup_without_ids_and_rows(spark):
    rows = [(None, plain.LOREM), (None, plain.LOREM), (1, plain.LOREM)]
    got = substring.dedup_substrings(plain.documents(spark, rows)).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 400, 400]
    assert [r["doc_id"] for r in got if not r["n_removed"]] == [1]
    assert substring.dedup_substrings(plain.documents(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [plain.HARD, corpus(3), corpus(4)])
def test_similar_documents_equal_plain_code(spark, rows):
    got = jaccard.similar_documents(plain.documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(plain.similar(rows))


def test_similar_documents_without_ids_and_rows(spark):
    got = jaccard.similar_documents(plain.documents(spark, [(None, plain.LOREM), (2, plain.LOREM)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (2, 2)}
    assert jaccard.similar_documents(plain.documents(spark, [])).count() == 0


def groups(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if v in (x, y) else v for v in root]
    return root


@pytest.mark.parametrize("sides", [False, True])
def test_tree_links_connect_what_all_pairs_connect(sides):
    r = np.random.default_rng(6)
    base = r.integers(1, 1 << 62, (6, 60)).astype(np.uint64)
    sets = []
    for _ in range(150):
        s = base[r.integers(0, 6)].copy()
        change = r.integers(0, 60, r.integers(0, 14))
        s[change] = r.integers(1, 1 << 62, len(change)).astype(np.uint64)
        sets.append(np.unique(s[: r.integers(40, 61)]))
    side = r.integers(0, 2, 150) if sides else None
    group = np.arange(150)
    group[:10] = 0
    true = [
        (i, j) for i in range(150) for j in range(i)
        if (side is None or side[i] != side[j])
        and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    ]
    known = [(0, i) for i in range(10)]
    found = jaccard.tree_links(sets, group, side)
    assert {(max(p), min(p)) for p in found} <= set(true)
    assert groups(150, found + known) == groups(150, true + known)


def test_blocks_of_a_cluster_lose_no_component(spark):
    r = np.random.default_rng(8)
    base = r.integers(1, 1 << 62, 200).astype(np.int64)
    sets = []
    for _ in range(90):
        s = base.copy()
        change = r.integers(0, 200, r.integers(0, 34))
        s[change] = r.integers(1, 1 << 62, len(change))
        sets.append(np.unique(s))
    rows = [(i, len(s), s.astype("<i8").tobytes(), 0) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "doc bigint, n_shingles bigint, shingles binary, cluster bigint")
    found = components(jaccard.block_links(members, block=10)).collect()
    root = {i: i for i in range(90)} | {r["node"]: r["component"] for r in found}
    true = [
        (i, j) for i in range(90) for j in range(i)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    ]
    assert [root[i] for i in range(90)] == groups(90, true)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 98), (98, 98)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | {98: 98, 99: 98}


VECTORS = "vec_id bigint, embedding array<float>, label string, dim int"


def brute(rows, k):
    out = []
    good = [
        (i, np.array(v, float)) for i, v in rows
        if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
    ]
    for q, a in good:
        if q % 20 == 0:
            near = sorted(
                (float(np.sqrt(((b - a) ** 2).sum())), i) for i, b in good if i != q and len(b) == len(a)
            )
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return out


def test_neighbours_recall_and_scores(spark):
    r = np.random.default_rng(9)
    centres = r.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.4 * r.standard_normal(24)).astype("f4").tolist()) for i in range(2500)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    got = ann.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    want = brute(rows, 10)
    assert len(got) == len(want)
    hits = {(r["query_id"], r["vec_id"]) for r in got} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len(want)
    vectors = dict(rows)
    for r in got[:200]:
        gap = np.array(vectors[r["query_id"]]) - np.array(vectors[r["vec_id"]])
        assert r["score"] == pytest.approx(float(np.sqrt((gap**2).sum())), abs=1e-12)


def test_neighbours_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.0, 2.0]), (20, [5.0, 5.0, 5.0]),
        (40, [3.0, 0.0]), (60, [0.0, 0.0]), (None, [1.0, 1.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(brute(rows, 3))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_words_that_polynomials_confuse(spark):
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    pairs = [("".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])) for n in (1024, 2048)]
    rows = [(1, pairs[0][0]), (2, pairs[0][1]), (3, pairs[1][0]), (4, pairs[1][1])]
    rows += [(5 + k, " ".join([w] * 20 + ["x", w])) for k, w in enumerate(w for p in pairs for w in p)]
    docs = plain.documents(spark, rows)
    got = sorted(tuple(r) for r in jaccard.similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == plain.similar(rows)
    done = substring.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "text").collect()
    assert sorted(tuple(r) for r in done) == plain.dedup(rows)


def test_pairs_of_hashes_that_share_one():
    one, two = np.array([5, 5, 3, 5, 3], np.uint64), np.array([1, 2, 9, 1, 9], np.uint64)
    distinct, first, inverse = substring.unlike(one, two)
    assert distinct.tolist() == [3, 5, 5] and first.tolist() == [2, 0, 1] and inverse.tolist() == [1, 2, 0, 1, 0]

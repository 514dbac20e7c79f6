"""Similar documents by the Jaccard overlap of their word shingles, with signature trees.

1. A count-min sketch over the corpus bounds in how many documents a shingle is. Shingles in one
   document are in no intersection, so a document with too many of them has no link and is done.
2. Documents with equal sets become one. A pair above the threshold shares one of its first shingles
   in the order (estimated count, hash); components over shared first shingles are clusters, and
   no link leaves a cluster.
3. Clusters are cut into blocks of bounded size. Inside a block, and between two blocks of a
   cluster, signature trees are joined: nodes hold the OR of their documents' bitmaps and the range of
   their set sizes, and pairs of nodes whose largest possible overlap is too small are dropped.
   What is left is compared exactly. Pairs that are already connected are skipped: that
   loses no component.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import sketch
from .components import components, groups
from .hashing import mix, text_bytes, window_hashes

SHINGLE = 5
# Percent of the union that two linked sets share at least.
PERCENT = 75
ROWS, PER_SHINGLE = 1, 16
BLOCK = 256
LEAF, FAN = 16, 8
BITS = 2048

SETS = "doc bigint, n_shingles bigint, digest binary, ones int, shingles binary"
EDGES = "a bigint, b bigint"


def overlap_needed(a, b, percent: int = PERCENT):
    """Smallest intersection of sets of these sizes that makes a link."""
    return -(-percent * (a + b) // (100 + percent))


def signatures(sets: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Bitmap of each set, as rows of 64-bit words."""
    out = np.zeros((len(sets), bits), dtype=bool)
    for row, s in zip(out, sets):
        row[(mix(s) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


class SignatureTree:
    """Levels of nodes over documents in the given order; level 0 has the leaves.

    Per node: OR of bitmaps, smallest and largest set, and the most shingles that share bits in one set.
    """

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        extra = sizes - np.bitwise_count(bitmaps).sum(axis=1).astype(np.int64)
        self.leaf, self.fan = leaf, fan
        self.levels = []
        maps, low, high, step = bitmaps, sizes, sizes, leaf
        while len(maps):
            cut = np.arange(0, len(maps), step)
            maps = np.bitwise_or.reduceat(maps, cut, axis=0)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            extra = np.maximum.reduceat(extra, cut)
            self.levels.append((maps, low, high, extra))
            step = fan
            if len(maps) == 1:
                break

    def documents(self, level: int, node: int, n: int) -> tuple[int, int]:
        """Range of documents below a node."""
        width = self.leaf * self.fan**level
        return node * width, min(n, (node + 1) * width)


def _overlap_bound(x, i: int, y, j: np.ndarray) -> np.ndarray:
    """Largest overlap any two documents below node ``i`` of level ``x`` and nodes ``j`` of ``y`` can have."""
    shared = np.bitwise_count(x[0][i] & y[0][j]).sum(axis=-1).astype(np.int64)
    return shared + np.minimum(x[3][i], y[3][j])


def tree_links(
    sets: list[np.ndarray], group: np.ndarray, side: np.ndarray | None = None,
    percent: int = PERCENT,
) -> list[tuple[int, int]]:
    """Links that connect documents of different groups, as pairs of positions.

    ``sets`` are sorted hashes; ``group`` numbers the parts already known to be connected. With
    ``side`` only pairs of different sides are compared. Components of the links and the groups are
    those of all links. Links inside a group are not looked for.
    """
    n = len(sets)
    order = np.array(sorted(range(n), key=lambda i: int(sets[i].min()) if len(sets[i]) else 0))
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    bitmaps = signatures([sets[i] for i in order])
    root = np.asarray(group)[order].copy()
    sides = None if side is None else np.asarray(side)[order]
    tree = SignatureTree(bitmaps, sizes)
    links: list[tuple[int, int]] = []

    def compare(a: int, lo: int, hi: int) -> None:
        """Document ``a`` with those of ``lo:hi``."""
        open_ = root[lo:hi] != root[a]
        if sides is not None:
            open_ &= sides[lo:hi] != sides[a]
        at = np.flatnonzero(open_) + lo
        if not len(at):
            return
        need = overlap_needed(sizes[a], sizes[at], percent)
        # Each bit that one has and the other lacks is a shingle the other lacks.
        best = np.minimum(
            sizes[a] - np.bitwise_count(bitmaps[a] & ~bitmaps[at]).sum(axis=1),
            sizes[at] - np.bitwise_count(bitmaps[at] & ~bitmaps[a]).sum(axis=1),
        )
        own = sets[order[a]]
        for b, least in zip(at[best >= need].tolist(), need[best >= need].tolist()):
            if root[a] == root[b]:
                continue
            other = sets[order[b]]
            where = np.searchsorted(own, other)
            where[where == len(own)] = 0
            if int((own[where] == other).sum()) >= least:
                links.append((int(order[a]), int(order[b])))
                root[root == root[b]] = root[a]

    stack = [(len(tree.levels) - 1, 0, 0)] if n else []
    while stack:
        level, i, j = stack.pop()
        a0, a1 = tree.documents(level, i, n)
        b0, b1 = tree.documents(level, j, n)
        if (root[a0:a1] == root[a0]).all() and (root[b0:b1] == root[a0]).all():
            continue
        if level == 0:
            for a in range(a0, a1):
                compare(a, max(b0, a + 1), b1)
            continue
        below = tree.levels[level - 1]
        count = len(below[0])
        firsts = range(i * FAN, min(count, (i + 1) * FAN))
        for x in firsts:
            ys = np.arange(max(j * FAN, x), min(count, (j + 1) * FAN))
            if not len(ys):
                continue
            need = overlap_needed(below[1][x], below[1][ys], percent)
            fits = (
                (_overlap_bound(below, x, below, ys) >= need)
                & (100 * below[2][ys] >= percent * below[1][x])
                & (100 * below[2][x] >= percent * below[1][ys])
            )
            stack += [(level - 1, x, int(y)) for y in ys[fits][::-1]]
    return links


def _shingle_sets(table, size: int):
    """(sets in order of rows as (row, hash) arrays without repeats, shingles per row)."""
    data, offsets = text_bytes(table.column("text"))
    hashes, per_doc, _ = window_hashes(data, offsets, size, 1, lower=True, short=True)
    row = np.repeat(np.arange(table.num_rows), per_doc)
    order = np.lexsort((hashes[0], row))
    h, r = hashes[0][order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new], np.bincount(r[new], minlength=table.num_rows)


def shingle_sets(
    docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Rows of SETS. Only documents that can have a link carry their shingles, by (count, hash)."""
    shape = sketch.layout(docs, text, ROWS, PER_SHINGLE)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), body), F.lit(shape.chunks)).cast("int").alias("chunk"),
        F.col(f"`{doc_id}`").cast("bigint").alias("doc"),
        body.alias("text"),
    )
    chunks = rows.groupBy("chunk")

    def ask(table):
        _, h, _ = _shingle_sets(table, size)
        distinct, counts = np.unique(h, return_counts=True)
        chunk = table.column("chunk")[0].as_py()
        return sketch.requests(chunk, distinct, np.minimum(counts, sketch.MOST), shape)

    def tell(table, answers):
        import pyarrow as pa

        _, h, sizes = _shingle_sets(table, size)
        distinct, inverse = np.unique(h, return_inverse=True)
        known = sketch.estimates(distinct, answers.to_pylist(), shape)[inverse]
        digests, ones, kept = [], [], []
        ends = np.cumsum(sizes).tolist()
        for b, n in zip(ends, sizes.tolist()):
            s, count = h[b - n : b], known[b - n : b]
            alone = int((count < 2).sum())
            ones.append(alone)
            if n and 100 * (n - alone) >= percent * n:
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                kept.append(s[np.lexsort((s, count))].astype("<u8").tobytes())
            else:
                digests.append(None)
                kept.append(None)
        return pa.Table.from_arrays(
            [
                table.column("doc"),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(ones, pa.int32()),
                pa.array(kept, pa.binary()),
            ],
            ["doc", "n_shingles", "digest", "ones", "shingles"],
        )

    estimated = sketch.merged(chunks.applyInArrow(ask, sketch.BLOCKS))
    return chunks.cogroup(estimated.groupBy("chunk")).applyInArrow(tell, SETS)


def first_shingles(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(shingle, doc): the shingles of which every linked pair shares one, without unshared ones.

    Among the first n - ceil(p n) + 1 shingles of a set of n, in any order that is the same everywhere.
    """

    def pick(batches):
        import pyarrow as pa

        for batch in batches:
            shingles, docs = [], []
            sizes, ones = (batch.column(c).to_pylist() for c in ("n_shingles", "ones"))
            names = batch.column("doc").to_pylist()
            for name, n, alone, held in zip(names, sizes, ones, batch.column("shingles")):
                s = np.frombuffer(held.as_buffer(), "<i8")
                s = s[alone : n - -(-percent * n // 100) + 1]
                shingles.append(s)
                docs.append(np.full(len(s), name, dtype=np.int64))
            if shingles:
                arrays = [pa.array(np.concatenate(shingles)), pa.array(np.concatenate(docs))]
                yield pa.RecordBatch.from_arrays(arrays, ["shingle", "doc"])

    return sets.select("doc", "n_shingles", "ones", "shingles").mapInArrow(
        pick, "shingle bigint, doc bigint"
    )


def _table_links(table, own_side: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    docs = table.column("doc").to_numpy()
    order = np.argsort(docs, kind="stable")
    sets = [np.sort(np.frombuffer(table.column("shingles")[int(i)].as_py(), "<u8")) for i in order]
    group = table.column("component").to_numpy()[order]
    side = table.column("side").to_numpy()[order] if own_side else None
    return group, tree_links(sets, group, side)


def _links_of(grouped, own_side: bool) -> DataFrame:
    """Edges between the components that links of each group connect."""

    def solve(table):
        import pyarrow as pa

        known, links = _table_links(table, own_side)
        # Which parts are connected, as edges to the smallest: long chains would take many rounds.
        parts = groups([int(known[i]) for i, _ in links], [int(known[j]) for _, j in links])
        a, b = list(parts), list(parts.values())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return grouped.applyInArrow(solve, EDGES)


def _placed(members: DataFrame, block: int) -> DataFrame:
    """Members with band and sub (their block), the blocks of their cluster and the first of those."""
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / PERCENT)))
    members = members.withColumn("band", band.cast("int"))
    bands = members.groupBy("cluster", "band").agg(
        F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_subs")
    )
    clusters = bands.groupBy("cluster").agg(
        F.sum("_subs").alias("_blocks"), F.min("band").alias("_first")
    )
    members = members.join(bands.join(clusters, "cluster"), ["cluster", "band"])
    return members.withColumn("sub", F.pmod(F.xxhash64("doc"), F.col("_subs")).cast("int")).drop("_subs")


def block_links(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges whose components are those of all links, from (doc, n_shingles, shingles, cluster).

    Documents of a cluster are banded by size, so that links join equal or neighbouring bands, and
    bands are cut into blocks of about ``block`` documents. Blocks are joined with themselves, then
    with the first of their cluster, then with each other where they are not connected yet.
    """
    members = stage(_placed(members, block), "members")
    alone = members.withColumn("component", F.col("doc"))
    links = stage(_links_of(alone.groupBy("cluster", "band", "sub"), False), "links")
    many = members.filter("_blocks > 1")
    if many.isEmpty():
        return links
    for rest in (False, True):
        found = components(links).select(F.col("node").alias("doc"), F.col("component").alias("_c"))
        label = F.coalesce("_c", F.col("doc"))
        spans = (
            many.select("doc", "cluster", "band", "sub", "_first").join(found, "doc", "left")
            .groupBy("cluster", "band", "sub", "_first")
            .agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
        )
        a = spans.select("cluster", "_first", *[F.col(c).alias(f"a_{c}") for c in ("band", "sub", "_lo", "_hi")])
        b = spans.select("cluster", *[F.col(c).alias(f"b_{c}") for c in ("band", "sub", "_lo", "_hi")])
        near = F.abs(F.col("a_band") - F.col("b_band")) <= 1
        apart = ~((F.col("a__lo") == F.col("a__hi")) & (F.col("b__lo") == F.col("b__hi"))
                  & (F.col("a__lo") == F.col("b__lo")))
        pairs = a.join(b, "cluster").filter(
            near & apart & (F.struct("a_band", "a_sub") < F.struct("b_band", "b_sub"))
        )
        if not rest:
            pairs = pairs.filter((F.col("a_band") == F.col("_first")) & (F.col("a_sub") == 0))
        sides = F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("a_band").alias("band"), F.col("a_sub").alias("sub")),
            F.struct(F.lit(1).alias("side"), F.col("b_band").alias("band"), F.col("b_sub").alias("sub")),
        ))
        pair = F.xxhash64("cluster", "a_band", "a_sub", "b_band", "b_sub")
        wanted = pairs.select("cluster", pair.alias("pair"), sides.alias("_s")).select(
            "cluster", "pair", "_s.*"
        )
        if rest:
            wanted = stage(wanted, "pairs")
            if wanted.isEmpty():
                break
        met = wanted.join(many.drop("_blocks", "_first"), ["cluster", "band", "sub"])
        met = met.join(found, "doc", "left").withColumn("component", label).drop("_c")
        more = _links_of(met.groupBy("cluster", "pair"), True)
        links = stage(links.unionByName(more), "links")
    return links


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach, itself included.

    Texts are lower-cased (A-Z), sets are of SHINGLE-word runs, or of the whole text if it is shorter. Null
    texts and texts without words have an empty set and no link; rows without an id are left out of links
    and have no component. Repeated rows stay, and are linked if they have words. Other columns
    are not read.
    """
    sets = stage(shingle_sets(docs, doc_id, text), "sets")
    can = sets.filter("digest is not null and doc is not null")
    reps = can.groupBy("digest").agg(
        F.min(F.struct("doc", "n_shingles", "ones", "shingles")).alias("_r")
    ).select("digest", "_r.*")
    reps = stage(reps, "sets")
    first = first_shingles(reps)
    least = first.groupBy("shingle").agg(F.min("doc").alias("other"), F.max("doc").alias("_top"))
    least = least.filter("other < _top").drop("_top")
    near = first.join(least, "shingle").select(F.col("doc").alias("a"), F.col("other").alias("b"))
    clusters = components(near.filter("a != b").distinct())
    members = reps.select("doc", "n_shingles", "shingles").join(
        clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), "doc"
    )
    found = components(block_links(members)).select(
        F.col("node").alias("doc"), F.col("component").alias("_c")
    )
    # Every copy has the component of the one that stands for it.
    known = reps.select("digest", "doc").join(found, "doc", "left").select(
        "digest", F.coalesce("_c", F.col("doc")).alias("_c")
    )
    ids = sets.select(F.col("doc").alias("doc_id"), "n_shingles", "digest")
    return ids.join(known, "digest", "left").select(
        "doc_id", "n_shingles", F.when(
            F.col("doc_id").isNotNull(), F.coalesce("_c", F.col("doc_id"))
        ).alias("component_id")
    )
